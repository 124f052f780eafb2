"""Languages of texts and of their segments over tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm import language

#: The classifier is fitted on at most this many labelled rows, the same ones on every run.
SAMPLE_ROWS = 6_000


def fit_model(rows: DataFrame, text: str = "text", label: str = "language") -> language.Model:
    """A model fitted on a bounded sample of rows with a text; their labels may be missing, wrong or several.

    Equal texts with equal labels count once, and what the bound cuts is cut in hash order, so neither copies nor the
    order of a scan shape the model.
    """
    filled = rows.where(F.col(text) != "").select(F.col(text).alias("t"), F.col(label).alias("l"))
    n = filled.agg(F.count_distinct(F.xxhash64("t", "l"))).first()[0]
    share = 1.0 if n <= SAMPLE_ROWS else 1.05 * SAMPLE_ROWS / n
    drawn = filled.where(F.pmod(F.xxhash64("t"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).distinct()
    picked = drawn.orderBy(F.pmod(F.xxhash64("t"), F.lit(1_000_000)), "t", "l").limit(SAMPLE_ROWS).toArrow()
    return language.train(list(zip(picked["t"].to_pylist(), picked["l"].to_pylist())))


def _mapped(rows: DataFrame, model: language.Model, key: str, columns: dict, run, *more: str) -> DataFrame:
    """Rows of ``run(model, text, *more)`` for every row with a text, under its key."""
    kind = rows.schema[key].dataType.simpleString()
    held = rows.sparkSession.sparkContext.broadcast(model)

    def batches_of(batches):
        for b in batches:
            keys, out = [], []
            for k, *rest in zip(*[b.column(i).to_pylist() for i in range(b.num_columns)]):
                for row in run(held.value, *rest):
                    keys.append(k)
                    out.append(row)
            cols = list(zip(*out)) if out else [()] * len(columns)
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), *(pa.array(c, t) for c, (_, t) in zip(cols, columns.values()))], ["k", *columns])

    schema = f"k {kind}, " + ", ".join(f"`{c}` {sql}" for c, (sql, _) in columns.items())
    return rows.select(F.col(key).alias("k"), *more).mapInArrow(batches_of, schema).withColumnRenamed("k", key)


_LANGUAGE = {"language": ("string", pa.string()), "confidence": ("double", pa.float64())}


def text_languages(rows: DataFrame, model: language.Model, key: str = "qid", text: str = "text") -> DataFrame:
    """(key, language, confidence) of every row with a text; a text without a word has no language and confidence 0.

    Null texts give no rows.  The confidence is the share of the language among the sentences.
    """

    def run(m, t):
        code, sure = m.document(t)
        yield code, round(sure, 6)

    return _mapped(rows.where(F.col(text).isNotNull()), model, key, _LANGUAGE, run, text)


def segment_languages(rows: DataFrame, model: language.Model, key: str = "qid", text: str = "text") -> DataFrame:
    """(key, segment, start, end, language, confidence): the segments of every text in order, offsets in characters."""
    columns = {"segment": ("int", pa.int32()), "start": ("int", pa.int32()), "end": ("int", pa.int32()), **_LANGUAGE}

    def run(m, t):
        for i, (s, e, code, sure) in enumerate(m.segments(t)):
            yield i + 1, s, e, code, round(sure, 6)

    return _mapped(rows.where(F.col(text).isNotNull()), model, key, columns, run, text)


def unnamed_languages(rows: DataFrame, model: language.Model, key: str = "qid", text: str = "text", label: str = "language") -> DataFrame:
    """(key, language), distinct: languages of at least one whole sentence that the row's label does not name."""

    def run(m, t, named):
        for code in sorted(m.sentence_languages(t) - language.named_languages(named)):
            yield (code,)

    found = _mapped(rows.where(F.col(text).isNotNull() & F.col(key).isNotNull()), model, key, {"language": ("string", pa.string())}, run, text, label)
    return found.distinct()
