"""Queries of problem 5: oversized texts in pieces."""

from functools import reduce

from pyspark.sql import functions as F

from verdigris.llm.records import corpus_texts, shown_texts
from verdigris.llm.split import split_oversized
from verdigris.runtime import read_table

MAKERS = {"corpus": corpus_texts, "hits": shown_texts}


def p5_pieces(spark, sf_dir):
    """One branch per collection; the limits are a fixed table of one row for each, and a second row is an error."""
    given = read_table(spark, sf_dir, "split_limits").where(F.col("collection").isin(*MAKERS)).groupBy("collection")
    limits = given.agg(F.count("*").alias("n"), F.first("max_chars").alias("max_chars"), F.first("overlap_chars").alias("overlap_chars")).collect()
    if any(r.n > 1 for r in limits):
        raise ValueError("split_limits gives a collection more than one limit")
    parts = [split_oversized(MAKERS[r.collection](read_table(spark, sf_dir, r.collection)), r.max_chars, r.overlap_chars).select(F.lit(r.collection).alias("collection"), "*") for r in limits]
    return reduce(lambda a, b: a.unionByName(b), parts)


def p5_found(spark, sf_dir):
    return p5_pieces(spark, sf_dir).where("piece = 1").select("rec")


def p5_rebuilt(spark, sf_dir):
    """Whether pieces keep their limits, and the hash of what they give without their overlaps; a group is one text."""
    limits = read_table(spark, sf_dir, "split_limits")
    pieces = p5_pieces(spark, sf_dir).join(F.broadcast(limits.where(F.col("collection").isin(*MAKERS))), "collection")
    kept = (F.char_length("text") <= F.col("max_chars")) & (F.col("overlap") <= F.col("overlap_chars"))
    own = F.transform(F.array_sort(F.collect_list(F.struct("piece", F.substr("text", F.col("overlap") + 1).alias("own")))), lambda x: x["own"])
    whole = pieces.groupBy("rec").agg(F.bool_and(kept & (F.col("piece") <= F.col("n_pieces"))).alias("kept"), F.sha1(F.array_join(own, "")).alias("sha"))
    return whole.select("rec", "sha", "kept")


QUERIES = {"p5_found": p5_found, "p5_pieces": p5_pieces, "p5_rebuilt": p5_rebuilt}
SQL = {
    "p5_rebuilt": """
SELECT doc_id AS rec, sha1(text) AS sha, true AS kept FROM corpus, split_limits WHERE collection = 'corpus' AND doc_id IS NOT NULL AND length(text) > max_chars
UNION ALL
SELECT hit_id, sha1(text), true FROM (SELECT hit_id, text, row_number() OVER (PARTITION BY hit_id ORDER BY logged_at DESC NULLS LAST, text DESC) AS rn FROM hits WHERE hit_id IS NOT NULL AND text IS NOT NULL), split_limits
WHERE rn = 1 AND collection = 'hits' AND length(text) > max_chars""",
    "p5_found": """
SELECT doc_id AS rec FROM corpus, split_limits WHERE collection = 'corpus' AND doc_id IS NOT NULL AND length(text) > max_chars
UNION ALL
SELECT hit_id FROM (SELECT hit_id, text, row_number() OVER (PARTITION BY hit_id ORDER BY logged_at DESC NULLS LAST, text DESC) AS rn FROM hits WHERE hit_id IS NOT NULL AND text IS NOT NULL), split_limits
WHERE rn = 1 AND collection = 'hits' AND length(text) > max_chars"""
}
