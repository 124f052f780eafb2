"""Queries of problem 3: one ranking per search from dense, score and share."""

from verdigris.llm.rank_walk import latest_hits, rank_walk
from verdigris.runtime import read_table


def p3_ranked(spark, sf_dir):
    return rank_walk(latest_hits(read_table(spark, sf_dir, "hits"))).select("search_id", "hit_id", "id", "stationary", "walk_rank")


def p3_found(spark, sf_dir):
    return rank_walk(latest_hits(read_table(spark, sf_dir, "hits"))).where("pair_winner").select("search_id", "id")


QUERIES = {"p3_found": p3_found, "p3_ranked": p3_ranked}
SQL = {
    "p3_found": """
WITH ranked AS (
  SELECT hit_id, search_id, id, CASE WHEN isnan(dense) THEN NULL ELSE dense END AS dense, CASE WHEN isnan(score) THEN NULL ELSE score END AS score,
         CASE WHEN verification.total > 0 THEN verification.passed::DOUBLE / verification.total END AS share,
         row_number() OVER (PARTITION BY hit_id ORDER BY logged_at DESC NULLS LAST, search_id DESC, id DESC) AS rn
  FROM hits WHERE hit_id IS NOT NULL),
h AS (SELECT * FROM ranked WHERE rn = 1 AND search_id IS NOT NULL),
lost AS (
  SELECT DISTINCT a.search_id, a.hit_id FROM h a JOIN h b ON a.search_id = b.search_id AND a.hit_id <> b.hit_id
  WHERE (CASE WHEN a.dense > b.dense OR (a.dense IS NOT NULL AND b.dense IS NULL) THEN 1 ELSE 0 END)
      + (CASE WHEN a.score > b.score OR (a.score IS NOT NULL AND b.score IS NULL) THEN 1 ELSE 0 END)
      + (CASE WHEN a.share > b.share OR (a.share IS NOT NULL AND b.share IS NULL) THEN 1 ELSE 0 END) < 2),
many AS (SELECT search_id FROM h GROUP BY search_id HAVING count(*) > 1)
SELECT h.search_id, h.id FROM h JOIN many USING (search_id) WHERE NOT EXISTS (SELECT 1 FROM lost l WHERE l.search_id = h.search_id AND l.hit_id = h.hit_id)"""
}
