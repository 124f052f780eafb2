"""Queries on versions: contents, history, differences, change sets, lineage, views over all versions."""

from pyspark.sql import functions as F

from verdigris.functions.evidence import recency
from verdigris.operators import versions as V
from verdigris.operators.snapshot_diff import snapshot_rows, snapshots
from verdigris.plans.change_queries import _STATES
from verdigris.runtime import read_table


def _rows(spark, sf_dir, absent=False):
    """(store, version, snap, uid, sha) of all delivered snapshots."""
    return snapshot_rows(read_table(spark, sf_dir, "manifests"), read_table(spark, sf_dir, "store_versions"), absent).select("store", "version", F.col("snap").cast("bigint").alias("snap"), F.col("path").alias("uid"), "sha")


def _snaps(spark, sf_dir):
    return snapshots(read_table(spark, sf_dir, "manifests"), read_table(spark, sf_dir, "store_versions")).withColumn("snap", F.col("snap").cast("bigint"))


def content_hash(spark, sf_dir):
    return read_table(spark, sf_dir, "corpus").select("doc_id", F.sha1("text").alias("sha"))


def diff_first_last(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    ends = _snaps(spark, sf_dir).groupBy("store").agg(F.max("snap").alias("last"))
    old = rows.where("snap = 1")
    new = rows.join(ends, "store").where("snap = last")
    return V.diff_counts(V.diff(old, new, "store"), "store")


def changeset_apply(spark, sf_dir):
    """Every snapshot read as a change set on the one before it."""
    rows = _rows(spark, sf_dir, absent=True)
    base = rows.where("sha IS NOT NULL").withColumn("snap", F.col("snap") + 1).join(_snaps(spark, sf_dir).select("store", "snap"), ["store", "snap"], "left_semi")
    return V.apply_changes(base, rows.where("snap > 1"), "store", "snap")


def lineage(spark, sf_dir):
    return V.lineage(_rows(spark, sf_dir), _snaps(spark, sf_dir))


def occurrences(spark, sf_dir):
    return V.occurrences(_rows(spark, sf_dir))


def all_versions_view(spark, sf_dir):
    items = V.all_versions(_rows(spark, sf_dir), _snaps(spark, sf_dir))
    bonus = F.round(recency(F.col("latest_index"), F.col("n_versions")), 9)
    return items.select("store", "sha", "id", "uid", F.array_join("versions", ",").alias("versions"), "first", "last", F.col("latest_index").cast("bigint").alias("latest_index"), F.col("n_versions").cast("bigint").alias("n_versions"), bonus.alias("bonus"))


def incremental_contents(spark, sf_dir):
    return V.new_contents(_rows(spark, sf_dir))


QUERIES = {f.__name__: f for f in (content_hash, diff_first_last, changeset_apply, lineage, occurrences, all_versions_view, incremental_contents)}
SQL = {
    "content_hash": "SELECT doc_id, sha1(text) AS sha FROM corpus",
    "diff_first_last": _STATES
    + """, ends AS (SELECT store, max(snap) AS last FROM snaps GROUP BY store),
  o AS (SELECT store, path, sha FROM states WHERE snap = 1), n AS (SELECT s.store, path, sha FROM states s JOIN ends e ON s.store = e.store AND s.snap = e.last)
SELECT coalesce(n.store, o.store) AS store, count(*) FILTER (o.sha IS NULL) AS added, count(*) FILTER (n.sha IS NULL) AS removed,
  count(*) FILTER (o.sha <> n.sha) AS modified, count(*) FILTER (o.sha = n.sha) AS unchanged
FROM o FULL JOIN n ON o.store = n.store AND o.path = n.path GROUP BY 1""",
    "changeset_apply": _STATES
    + """, changes AS (SELECT store, snap, path, sha FROM ranked JOIN snaps USING (store, version) WHERE rn = 1 AND snap > 1)
SELECT store, s.snap + 1 AS snap, path AS uid, sha FROM states s WHERE EXISTS (SELECT 1 FROM snaps n WHERE n.store = s.store AND n.snap = s.snap + 1) AND NOT EXISTS (SELECT 1 FROM changes c WHERE c.store = s.store AND c.snap = s.snap + 1 AND c.path = s.path)
UNION ALL SELECT store, snap, path, sha FROM changes WHERE sha IS NOT NULL""",
    "lineage": _STATES
    + """, grid AS (SELECT p.store, p.path, s.snap, t.sha FROM (SELECT DISTINCT store, path FROM states) p JOIN snaps s USING (store) LEFT JOIN states t ON t.store = p.store AND t.path = p.path AND t.snap = s.snap),
  c AS (SELECT *, sha IS DISTINCT FROM lag(sha) OVER (PARTITION BY store, path ORDER BY snap) AS changed, min(snap) OVER (PARTITION BY store, path, sha) AS first FROM grid)
SELECT store, path AS uid, snap, sha, changed, CASE WHEN changed AND sha IS NOT NULL AND first < snap THEN first END AS reverted_to FROM c""",
    "occurrences": _STATES + "SELECT store, sha, snap, path AS uid, count(*) OVER (PARTITION BY store, sha) AS n, min(snap) OVER (PARTITION BY store, sha) AS first FROM states",
    "all_versions_view": _STATES
    + """, once AS (SELECT store, sha, snap, min(path) AS uid FROM states GROUP BY ALL), total AS (SELECT store, count(*) AS n_versions FROM snaps GROUP BY store),
  items AS (SELECT o.store, o.sha, arg_min(uid, o.snap) AS uid, string_agg(version, ',' ORDER BY o.snap) AS versions, arg_min(version, o.snap) AS first, arg_max(version, o.snap) AS last, max(o.snap) - 1 AS latest_index
    FROM once o JOIN snaps s ON o.store = s.store AND o.snap = s.snap GROUP BY o.store, o.sha)
SELECT store, sha, uid || '@' || sha[1:8] AS id, uid, versions, first, last, latest_index, n_versions, round(1e-3::DOUBLE * (latest_index + 1) / n_versions, 9) AS bonus FROM items JOIN total USING (store)""",
    "incremental_contents": _STATES
    + """, seen AS (SELECT DISTINCT store, snap, sha FROM states), f AS (SELECT store, sha, min(snap) AS first FROM seen GROUP BY ALL)
SELECT store, snap, count(*) AS n_contents, count(*) FILTER (snap = first) AS n_new FROM seen JOIN f USING (store, sha) GROUP BY store, snap""",
}
