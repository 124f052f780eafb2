"""Finding and replacing personal information over tables of documents."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm import personal
from verdigris.runtime import broadcast_if_small, materialise, release

#: A task hands on its counts when it holds this many.
HELD_COUNTS = 200_000
#: Listed name parts are a fixed small table; more rows than this are refused.
MAX_PARTS = 100_000


def fit_model(documents: DataFrame, name_parts: DataFrame) -> personal.Model:
    """A model with a lexicon of all ``documents`` (text) and the listed ``name_parts`` (part_name, kind)."""
    parts = name_parts.where("part_name IS NOT NULL").select("part_name", "kind").limit(MAX_PARTS + 1).collect()
    if len(parts) > MAX_PARTS:
        raise ValueError("name_parts is no small table")
    return personal.train_with(name_lexicon(documents, [p.part_name for p in parts if p.kind == "given"], [p.part_name for p in parts if p.kind == "family"]))


def name_lexicon(documents: DataFrame, given: list[str], family: list[str], least: int = 2, rounds: int = 2) -> personal.Lexicon:
    """:func:`personal.learn_lexicon` over a table: counts stay distributed, only names and common words are collected."""
    g, f = {w.lower() for w in given}, {w.lower() for w in family}
    listed = g | f

    def rows(totals):
        pairs, large, small = totals
        words = list(large.keys() | small.keys())
        a, b = words + [x for x, _ in pairs], [None] * len(words) + [y for _, y in pairs]
        none = [0] * len(pairs)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array([large[w] for w in words] + none, pa.int64()), pa.array([small[w] for w in words] + none, pa.int64())], ["a", "b", "large", "small"])

    def run(batches):
        totals = Counter(), Counter(), Counter()
        for batch in batches:
            for total, seen in zip(totals, personal.company(batch["text"].to_pylist(), listed)):
                total.update(seen)
            if sum(map(len, totals)) > HELD_COUNTS:
                yield rows(totals)
                totals = Counter(), Counter(), Counter()
        yield rows(totals)

    counts = documents.where("text <> ''").select("text").mapInArrow(run, "a string, b string, large bigint, small bigint")
    counts = materialise(counts.groupBy("a", "b").agg(F.sum("large").alias("large"), F.sum("small").alias("small")), "name-company")
    pairs = counts.where("b IS NOT NULL").select("a", "b")
    common = counts.where(F.col("b").isNull() & (F.col("small") >= F.lit(0.2) * (F.col("small") + F.col("large")))).select(F.col("a").alias("word"))

    def beside(names, side, other):
        """Words that stand beside ``least`` different ones of ``names`` and are not common."""
        known = broadcast_if_small(documents.sparkSession.createDataFrame([(w,) for w in sorted(names)], f"{side} string"))
        near = pairs.join(known, side).groupBy(F.col(other).alias("word")).count().where(F.col("count") >= least)
        return {r.word for r in near.join(common, "word", "left_anti").select("word").collect()}

    for _ in range(rounds):
        lasts, firsts = beside(g, "a", "b"), beside(f, "b", "a")
        f |= lasts - g
        g |= firsts - f
    words = set(common.toArrow()["word"].to_pylist())
    release(counts)
    return personal.Lexicon(given, family, g - listed, f - listed, words - listed)


def find_personal(documents: DataFrame, model: personal.Model, key: str = "doc_id") -> DataFrame:
    """(key, kind, found): one row per distinct string of each kind in a row's text, exactly as it stands there.

    Null and empty texts and texts without finds give no rows; extra columns are ignored.
    """
    kind = documents.schema[key].dataType.simpleString()
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            keys, kinds, found = [], [], []
            for k, t in zip(b["k"].to_pylist(), b["t"].to_pylist()):
                for what, string in sorted({(what, t[s:e]) for s, e, what in held.value.find(t)}):
                    keys.append(k)
                    kinds.append(what)
                    found.append(string)
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field("k").type), pa.array(kinds, pa.string()), pa.array(found, pa.string())], ["k", "kind", "found"])

    rows = documents.where("text <> ''").select(F.col(key).alias("k"), F.col("text").alias("t"))
    return rows.mapInArrow(run, f"k {kind}, kind string, found string").withColumnRenamed("k", key)


def replace_personal(documents: DataFrame, model: personal.Model, key: str = "doc_id") -> DataFrame:
    """(key, text) of every row, finds replaced by ``[EMAIL]``, ``[PHONE]``, ``[IDENTITY]``, ``[ADDRESS]``, ``[NAME]``.

    Null stays null, and everything outside finds stays as it is.
    """
    kind = documents.schema[key].dataType.simpleString()
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["k"], pa.array([held.value.replace(t) for t in b["t"].to_pylist()], pa.string())], ["k", "text"])

    return documents.select(F.col(key).alias("k"), F.col("text").alias("t")).mapInArrow(run, f"k {kind}, text string").withColumnRenamed("k", key)
