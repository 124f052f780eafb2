import random

import pytest
from pyspark.sql import functions as F

from verdigris.llm import encode as E

HERE = E.DEFAULT_DIR


def reference_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{HERE}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return [t.encode(x, add_special_tokens=False).ids if x else [] for x in texts]


def sample_texts():
    rng = random.Random(7)
    words = ["the", " it's", "we'll", "'", "'r", "e", "   ", "\n\n", "\t", "ab12", "...", "漢字", "é", "😀", " ", "x" * 40, "<|endoftext|>", "\r\n", "9" * 10, "ß'T"]
    return ["".join(rng.choice(words) for _ in range(n)) for n in (0, 1, 5, 60, 300, 900, 901, 2500)] + [None, "", " " * 700, "a" * 900, "a" * 300 + " b" * 300, "🙂" * 400]


@pytest.mark.parametrize("chunk,overlap", [(64, 16), (200, 50), (16384, 1024)])
def test_same_ids_as_the_second_library(spark, chunk, overlap):
    texts = sample_texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").withColumn("k", F.lit("clash")).withColumn("ids", F.lit(1)).repartition(3)
    got = {r.doc_id: r.ids for r in E.encode(df, chunk=chunk, overlap=overlap).collect()}
    assert [got[i] for i in range(len(texts))] == reference_ids(texts)


def test_a_long_run_is_not_quadratic(spark):
    df = spark.createDataFrame([(1, "z" * 400_000)], "doc_id bigint, text string")
    row = E.round_trip(df).collect()[0]
    assert row.same and 0 < row.n_tokens <= 400_000


def test_empty_table(spark):
    assert E.encode(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_round_trip(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(sample_texts())], "doc_id bigint, text string")
    assert all(r.same for r in E.round_trip(df).collect())


def test_repeated_and_null_keys_and_carried_columns(spark):
    long = "word " * 9000
    df = spark.createDataFrame([(1, long, "a"), (1, long, "b"), (None, long + "x", "c"), (None, None, "d"), (1, "hi", None)], "doc_id bigint, text string, source string")
    got = sorted((r.source or "", r.doc_id or 0, len(r.ids)) for r in E.encode(df, keep=("source",)).collect())
    n, m = (len(x) for x in reference_ids([long, long + "x"]))
    assert got == [("", 1, 1), ("a", 1, n), ("b", 1, n), ("c", 0, m), ("d", 0, 0)]
