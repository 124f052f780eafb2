"""Queries of problem 4: the five most similar vectors of every vector."""

from pyspark.sql import functions as F

from verdigris.llm.nearest import float_vectors, most_similar
from verdigris.runtime import read_table


def vectors(spark, sf_dir):
    """(key, vec) of both tables; of a cache row written twice the later one counts."""
    view = float_vectors(read_table(spark, sf_dir, "candidate_view"), "id", "embedding")
    cache = read_table(spark, sf_dir, "vector_cache").where("k IS NOT NULL").groupBy("k").agg(F.max(F.struct("updated_at", "v")).alias("last"))
    return view.unionByName(cache.select(F.col("k").alias("key"), F.col("last.v").alias("vec")))


def p4_neighbours(spark, sf_dir):
    return most_similar(vectors(spark, sf_dir))


def p4_found(spark, sf_dir):
    near = p4_neighbours(spark, sf_dir).where("cosine >= 0.85")
    return near.select(F.least("key", "neighbour").alias("key_a"), F.greatest("key", "neighbour").alias("key_b")).distinct()


QUERIES = {"p4_found": p4_found, "p4_neighbours": p4_neighbours}
SQL = {
    # every pair by brute force; the bytes of a cached vector are read as little-endian float32
    "p4_found": """
WITH latest AS (SELECT k, hex(v) AS h, row_number() OVER (PARTITION BY k ORDER BY updated_at DESC NULLS LAST, v DESC NULLS LAST) AS rn FROM vector_cache WHERE k IS NOT NULL),
words AS (SELECT k, list_transform(range(64), lambda i: ('0x' || h[8 * i + 7 : 8 * i + 8] || h[8 * i + 5 : 8 * i + 6] || h[8 * i + 3 : 8 * i + 4] || h[8 * i + 1 : 8 * i + 2])::BIGINT) AS w FROM latest WHERE rn = 1 AND length(h) = 512),
vectors AS (
  SELECT id AS k, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM candidate_view WHERE id IS NOT NULL AND len(embedding) = 64 AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)
  UNION ALL
  SELECT k, list_transform(w, lambda b: CASE WHEN b & 2147483647 = 0 THEN 0e0 ELSE (CASE WHEN b >= 2147483648 THEN -1 ELSE 1 END) * (CASE WHEN (b >> 23) & 255 = 0 THEN (b & 8388607) * pow(2e0, -149) ELSE (8388608 + (b & 8388607)) * pow(2e0, ((b >> 23) & 255) - 150) END) END)
  FROM words WHERE NOT list_contains(list_transform(w, lambda b: (b >> 23) & 255 = 255), true)),
lengths AS (SELECT k, x, sqrt(list_inner_product(x, x)) AS n FROM vectors),
units AS (SELECT k, list_transform(x, lambda v: v / n)::DOUBLE[64] AS u FROM lengths WHERE n > 0),
near AS (SELECT a.k AS k, b.k AS other, array_inner_product(a.u, b.u) AS c FROM units a JOIN units b ON a.k <> b.k),
ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(c, 6) DESC, other) AS r FROM near)
SELECT DISTINCT least(k, other) AS key_a, greatest(k, other) AS key_b FROM ranked WHERE r <= 5 AND c >= 0.85"""
}
