"""Queries on snapshots delivered in full (problem 6) and their SQL."""

from verdigris.operators.snapshot_diff import snapshot_changes, snapshot_counts
from verdigris.runtime import read_table


def p6_found(spark, sf_dir):
    changes = snapshot_changes(read_table(spark, sf_dir, "manifests"), read_table(spark, sf_dir, "store_versions"))
    return changes.select("store", "version", "uid", "change")


def p6_counts(spark, sf_dir):
    return snapshot_counts(read_table(spark, sf_dir, "manifests"), read_table(spark, sf_dir, "store_versions"))


_STATES = r"""
WITH named AS (
  SELECT store, version, array_to_string(list_filter(string_split(replace(trim(uid), '\', '/'), '/'), lambda p: p NOT IN ('', '.')), '/') AS path,
         CASE WHEN sha IS NULL OR trim(sha) = '' THEN NULL ELSE coalesce(nullif(regexp_replace(lower(trim(sha)), '^(0x)?0*', ''), ''), '0') END AS sha, delivered_at
  FROM manifests),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY store, version, path ORDER BY delivered_at DESC NULLS LAST, sha DESC NULLS LAST) AS rn FROM named WHERE path <> ''),
snaps AS (
  SELECT store, version, row_number() OVER (PARTITION BY store ORDER BY seq, version) AS snap
  FROM (SELECT DISTINCT store, version FROM manifests) JOIN (SELECT store, version, min(seq) AS seq FROM store_versions WHERE seq IS NOT NULL GROUP BY ALL) USING (store, version)),
states AS (
  SELECT store, snap, path, sha FROM ranked JOIN snaps USING (store, version) WHERE rn = 1 AND sha IS NOT NULL),
sides AS (
  SELECT coalesce(n.store, o.store) AS store, coalesce(n.snap, o.snap + 1) AS snap, coalesce(n.path, o.path) AS uid, n.sha AS new_sha, o.sha AS old_sha
  FROM states n FULL JOIN states o ON n.store = o.store AND n.snap = o.snap + 1 AND n.path = o.path),
labelled AS (
  SELECT b.store, s.version, b.uid, CASE WHEN old_sha IS NULL THEN 'added' WHEN new_sha IS NULL THEN 'removed' WHEN old_sha <> new_sha THEN 'modified' ELSE 'unchanged' END AS change
  FROM sides b JOIN snaps s ON b.store = s.store AND b.snap = s.snap WHERE b.snap > 1)
"""

QUERIES = {"p6_found": p6_found, "p6_counts": p6_counts}
SQL = {
    "p6_found": _STATES + "SELECT store, version, uid, change FROM labelled WHERE change <> 'unchanged'",
    "p6_counts": _STATES
    + """SELECT s.store, s.version, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed,
         count(*) FILTER (change = 'modified') AS modified, count(*) FILTER (change = 'unchanged') AS unchanged
         FROM snaps s LEFT JOIN labelled l ON s.store = l.store AND s.version = l.version WHERE s.snap > 1 GROUP BY s.store, s.version""",
}
