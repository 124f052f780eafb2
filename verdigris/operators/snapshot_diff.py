"""What changed between consecutive full snapshots, by comparing Merkle trees before rows.

Method: the paths of each snapshot fall into hash ranges (the leaves of a tree of fan-out 16).  A leaf's digest
combines the hashes of its (path, content) rows, an inner node's digest those of its children.  Two consecutive
snapshots of a store are compared from the root down; a level is only looked at below nodes whose digests differ,
and rows are only compared inside leaves whose digests differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from verdigris.runtime import materialise

FANOUT_BITS = 4
#: Rows of the largest snapshot that a leaf should hold on average, and the deepest tree.
LEAF_ROWS = 64
MAX_LEVELS = 7


def canonical_path(uid: Column) -> Column:
    """The shortest forward-slash spelling of a relative path; case is kept.

    ``\\`` becomes ``/``, empty and ``.`` segments go, ``x/..`` cancels, outer blanks go.
    """
    parts = F.filter(F.split(F.trim(F.replace(uid, F.lit("\\"), F.lit("/"))), "/"), lambda p: ~p.isin("", "."))
    resolved = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, p: F.when(
            (p == "..") & (F.size(done) > 0) & (F.coalesce(F.element_at(done, -1), F.lit("")) != ".."),
            F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
        ).otherwise(F.concat(done, F.array(p))),
    )
    # only the few paths with a parent step pay for the fold
    return F.array_join(F.when(F.array_contains(parts, ".."), resolved).otherwise(parts), "/")


def canonical_hex(sha: Column) -> Column:
    """A hexadecimal number in one spelling: lower case, no blanks, no ``0x``, no leading zeros; blank is null."""
    bare = F.regexp_replace(F.lower(F.trim(sha)), "^(0x)?0*", "")
    return F.when(sha.isNull() | (F.trim(sha) == ""), None).when(bare == "", "0").otherwise(bare)


def snapshots(manifests: DataFrame, store_versions: DataFrame) -> DataFrame:
    """(store, version, snap): the delivered versions of each store, numbered in the order of ``seq``.

    Repeated announcements count once (the smallest seq, should they disagree).  A delivered version that was
    never announced has no place in the order and is left out.
    """
    delivered = manifests.select("store", "version").distinct()
    order = store_versions.where("seq IS NOT NULL").groupBy("store", "version").agg(F.min("seq").alias("seq"))
    per_store = W.partitionBy("store").orderBy("seq", "version")
    return delivered.join(order, ["store", "version"]).select("store", "version", F.row_number().over(per_store).alias("snap"))


def snapshot_rows(manifests: DataFrame, store_versions: DataFrame, absent: bool = False) -> DataFrame:
    """(store, version, snap, path, sha, h): one row for each path that is present in a snapshot.

    With ``absent`` also the paths that a snapshot says are gone, with a null sha.

    Of several rows of one path the one delivered last counts (at equal times the largest sha, a row without sha
    coming first); if that has no sha the path is absent.  Rows without a uid, or whose path is empty, are no path.
    """
    return _rows_in_order(manifests, snapshots(manifests, store_versions), absent)


def _rows_in_order(manifests: DataFrame, order: DataFrame, absent: bool) -> DataFrame:
    # paths are spelt in few ways: the expensive spelling rules see each distinct row once, before the shuffle
    named = manifests.select("store", "version", canonical_path(F.col("uid")).alias("path"), canonical_hex(F.col("sha")).alias("sha"), "delivered_at").where("path <> ''")
    last = named.groupBy("store", "version", "path").agg(F.max(F.struct("delivered_at", "sha")).alias("last"))
    kept = last.select("store", "version", "path", F.col("last.sha").alias("sha"))
    kept = kept if absent else kept.where("sha IS NOT NULL")
    return kept.join(order, ["store", "version"]).withColumn("h", F.xxhash64("path"))


def _digest(*parts: Column) -> list[Column]:
    """Two order-free 64-bit sums of independent hashes and a count; a collision needs all three to agree."""
    return [F.bit_xor(F.xxhash64(*parts)).alias("d1"), F.sum(F.xxhash64(*parts, F.lit(7)).cast("decimal(20,0)")).alias("d2"), F.count("*").alias("n")]


def _node(level: int, hashed: Column) -> Column:
    """The node of a level: the first ``level * FANOUT_BITS`` bits of the path's hash."""
    return F.shiftrightunsigned(hashed, 64 - FANOUT_BITS * level) if level else F.lit(0).cast("bigint")


def tree(rows: DataFrame, levels: int) -> list[DataFrame]:
    """Digests (store, snap, node, d1, d2, n) of every level, root first; each level is made from the one below."""
    leaf = rows.groupBy("store", "snap", _node(levels, F.col("h")).alias("node")).agg(*_digest(F.col("path"), F.col("sha")))
    out = [materialise(leaf, "merkle-leaf")]
    for _ in range(levels):
        below = out[0]
        out.insert(0, below.groupBy("store", "snap", F.shiftrightunsigned("node", FANOUT_BITS).alias("node")).agg(F.bit_xor(F.xxhash64("node", "d1", "d2", "n")).alias("d1"), F.sum(F.xxhash64("node", "d1", "d2", "n", F.lit(7)).cast("decimal(20,0)")).alias("d2"), F.sum("n").alias("n")))
    return out


def _levels(rows: DataFrame) -> int:
    largest = rows.groupBy("store", "snap").count().agg(F.max("count")).first()[0] or 0
    levels = 1
    while levels < MAX_LEVELS and (1 << (FANOUT_BITS * levels)) * LEAF_ROWS < largest:
        levels += 1
    return levels


def differing_leaves(trees: list[DataFrame], pairs: DataFrame) -> DataFrame:
    """(store, snap, node): leaves in which ``snap`` and ``snap - 1`` differ, found from the root down.

    ``pairs`` (store, snap) are the comparisons to make.
    """
    open_nodes = pairs.select("store", "snap", F.lit(0).cast("bigint").alias("node"))
    for depth, level in enumerate(trees):
        if depth:  # the children of the nodes that differed
            open_nodes = open_nodes.select("store", "snap", F.explode(F.transform(F.sequence(F.lit(0), F.lit((1 << FANOUT_BITS) - 1)), lambda i: F.shiftleft("node", FANOUT_BITS) + i)).alias("node"))
        new = level.select("store", "snap", "node", F.struct("d1", "d2", "n").alias("new"))
        old = level.select("store", (F.col("snap") + 1).alias("snap"), "node", F.struct("d1", "d2", "n").alias("old"))
        compared = open_nodes.join(new, ["store", "snap", "node"], "left").join(old, ["store", "snap", "node"], "left")
        open_nodes = compared.where(~F.col("new").eqNullSafe(F.col("old"))).select("store", "snap", "node")
    return open_nodes


def snapshot_changes(manifests: DataFrame, store_versions: DataFrame) -> DataFrame:
    """(store, version, uid, change, old_sha, new_sha) for every path that differs from the store's previous snapshot.

    ``change`` is added, removed or modified; the first snapshot of a store gives no rows.  A snapshot all of whose
    paths are absent still counts: everything of the one before is removed.  Extra columns are ignored.
    """
    return _changes(*_written(manifests, store_versions))


def _written(manifests: DataFrame, store_versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of all snapshots and the order of the snapshots, each made once."""
    order = materialise(snapshots(manifests, store_versions), "snapshot-order")
    return materialise(_rows_in_order(manifests, order, False), "snapshot-rows"), order


def _changes(rows: DataFrame, order: DataFrame) -> DataFrame:
    levels = _levels(rows)
    leaves = materialise(differing_leaves(tree(rows, levels), order.where("snap > 1")), "merkle-differing")
    keyed = rows.select("store", "snap", "path", "sha", _node(levels, F.col("h")).alias("node"))
    at = ["store", "snap", "node"]
    new = keyed.join(leaves, at, "left_semi").select("store", "snap", "path", F.col("sha").alias("new_sha"), F.lit(None).cast("string").alias("old_sha"))
    old = keyed.withColumn("snap", F.col("snap") + 1).join(leaves, at, "left_semi").select("store", "snap", "path", F.lit(None).cast("string").alias("new_sha"), F.col("sha").alias("old_sha"))
    both = new.unionByName(old).groupBy("store", "snap", "path").agg(F.max("new_sha").alias("new_sha"), F.max("old_sha").alias("old_sha")).where("NOT (new_sha <=> old_sha)")
    change = F.when(F.col("old_sha").isNull(), "added").when(F.col("new_sha").isNull(), "removed").otherwise("modified")
    return both.join(order, ["store", "snap"]).select("store", "version", F.col("path").alias("uid"), change.alias("change"), "old_sha", "new_sha")


def snapshot_counts(manifests: DataFrame, store_versions: DataFrame) -> DataFrame:
    """(store, version, added, removed, modified, unchanged) of each snapshot but a store's first."""
    rows, order = _written(manifests, store_versions)
    kinds = _changes(rows, order).groupBy("store", "version").agg(*[F.count_if(F.col("change") == k).alias(k) for k in ("added", "removed", "modified")])
    sizes = rows.groupBy("store", "version").agg(F.count("*").alias("n_rows"))
    zero = {k: 0 for k in ("added", "removed", "modified", "n_rows")}
    out = order.where("snap > 1").join(kinds, ["store", "version"], "left").join(sizes, ["store", "version"], "left").fillna(zero)
    return out.select("store", "version", "added", "removed", "modified", (F.col("n_rows") - F.col("added") - F.col("modified")).alias("unchanged"))
