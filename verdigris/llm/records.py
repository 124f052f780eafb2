"""The text records that several operators share."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shown_texts(hits: DataFrame) -> DataFrame:
    """(rec, text): one row per hit_id that was delivered with a text; of several texts the one logged last."""
    there = hits.where("hit_id IS NOT NULL AND text IS NOT NULL").select("hit_id", "logged_at", "text")
    return there.groupBy("hit_id").agg(F.max(F.struct("logged_at", "text")).alias("last")).select(F.col("hit_id").alias("rec"), F.col("last.text").alias("text"))


def corpus_texts(corpus: DataFrame) -> DataFrame:
    """(rec, text) of the corpus rows with an id and a text."""
    return corpus.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").alias("rec"), "text")
