"""Version algebra on (store, version, uid, sha) manifests: differences, change sets, lineage, occurrences, views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from verdigris.runtime import broadcast_if_small

CHANGES = ("added", "removed", "modified", "unchanged")


def change_of(old: Column, new: Column) -> Column:
    return F.when(old.isNull(), "added").when(new.isNull(), "removed").when(old != new, "modified").otherwise("unchanged")


def diff(old: DataFrame, new: DataFrame, *by: str) -> DataFrame:
    """(by..., uid, change, old_sha, new_sha) of two (by..., uid, sha) listings.

    An aggregation rather than an outer join: both sides combine before the shuffle, and a hot store stays spread by uid.
    """
    keys = [*by, "uid"]
    none = F.lit(None).cast("string")
    sides = new.select(*keys, F.col("sha").alias("new_sha"), none.alias("old_sha")).unionByName(old.select(*keys, none.alias("new_sha"), F.col("sha").alias("old_sha")))
    both = sides.groupBy(*keys).agg(F.max("old_sha").alias("old_sha"), F.max("new_sha").alias("new_sha")).where("old_sha IS NOT NULL OR new_sha IS NOT NULL")
    return both.select(*keys, change_of(F.col("old_sha"), F.col("new_sha")).alias("change"), "old_sha", "new_sha")


def diff_counts(changes: DataFrame, *by: str) -> DataFrame:
    counts = [F.count_if(F.col("change") == c).alias(c) for c in CHANGES]
    return changes.groupBy(*by).agg(*counts) if by else changes.agg(*counts)


def apply_changes(base: DataFrame, changes: DataFrame, *by: str) -> DataFrame:
    """``base`` (by..., uid, sha) minus the uids of ``changes``, plus those of its rows that have a sha."""
    keys = [*by, "uid"]
    live = changes.where("sha IS NOT NULL").select(*keys, "sha")
    return base.select(*keys, "sha").join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(live)


def lineage(rows: DataFrame, versions: DataFrame, only_changes: bool = False) -> DataFrame:
    """(store, uid, snap, sha, changed, reverted_to) for every path in every version of its store.

    ``rows`` is (store, snap, uid, sha), ``versions`` (store, snap).  ``changed`` compares with the version before, of
    which the first has none; ``reverted_to`` is the first version with the same content, where it was there before
    the change.  A path that a version lacks has a null sha.  With ``only_changes`` just the rows that changed.

    Every row knows the row of its path before and after it, so absences are told from the gaps between them; paths
    and versions are never crossed.
    """
    last = broadcast_if_small(versions.groupBy("store").agg(F.max("snap").alias("last")))
    path = W.partitionBy("store", "uid").orderBy("snap")
    known = rows.select("store", "uid", "snap", "sha").withColumns({
        "before": F.lag("snap").over(path), "old": F.lag("sha").over(path), "after": F.lead("snap").over(path), "first": F.min("snap").over(W.partitionBy("store", "uid", "sha")),
    }).join(last, "store")
    same = (F.col("before") == F.col("snap") - 1) & (F.col("old") == F.col("sha"))
    changed = ~F.coalesce(same, F.lit(False))
    own = F.struct(F.col("snap"), F.col("sha"), changed.alias("changed"), F.when(changed & (F.col("first") < F.col("snap")), F.col("first")).alias("reverted_to"))
    absent = lambda snap, first: F.struct(snap.alias("snap"), F.lit(None).cast("string").alias("sha"), first.alias("changed"), F.lit(None).cast(rows.schema["snap"].dataType).alias("reverted_to"))
    until = F.coalesce(F.col("after") - 1, F.col("last"))
    none = F.array().cast(f"array<{rows.schema['snap'].dataType.simpleString()}>")
    if only_changes:
        gone = F.when(F.col("snap") + 1 <= until, F.array(F.col("snap") + 1)).otherwise(none)
        full = known.select("store", "uid", F.explode(F.concat(F.array(own), F.transform(gone, lambda s: absent(s, F.lit(True))))).alias("x"))
        return full.select("store", "uid", "x.*").where("changed")
    gone = F.when(F.col("snap") + 1 <= until, F.sequence(F.col("snap") + 1, until)).otherwise(none)
    ahead = F.when(F.col("before").isNull() & (F.col("snap") > 1), F.sequence(F.lit(1).cast(rows.schema["snap"].dataType), F.col("snap") - 1)).otherwise(none)
    everything = F.concat(F.array(own), F.transform(gone, lambda s: absent(s, s == F.col("snap") + 1)), F.transform(ahead, lambda s: absent(s, F.lit(False))))
    return known.select("store", "uid", F.explode(everything).alias("x")).select("store", "uid", "x.*")


def occurrences(rows: DataFrame) -> DataFrame:
    """(store, sha, snap, uid, n, first): every place where a content occurs, how many there are, and the first version.

    Rows, not lists: a content that half of all paths share stays spread; only its pre-aggregated count is joined.
    """
    counts = rows.groupBy("store", "sha").agg(F.count("*").alias("n"), F.min("snap").alias("first"))
    return rows.select("store", "sha", "snap", "uid").join(counts, ["store", "sha"])


def all_versions(rows: DataFrame, versions: DataFrame) -> DataFrame:
    """One item per distinct content of a store: (store, sha, id, uid, versions, first, last, latest_index, n_versions).

    ``rows`` is (store, snap, version, uid, sha).  ``uid`` is the first occurrence's (smallest uid within a version),
    ``latest_index`` counts versions from 0.
    """
    n = versions.groupBy("store").agg(F.count("*").cast("int").alias("n_versions"))
    # a content many paths share in one version is one entry before it travels
    once = rows.groupBy("store", "sha", "snap", "version").agg(F.min("uid").alias("uid"))
    items = once.groupBy("store", "sha").agg(F.min_by("uid", "snap").alias("uid"), F.min("snap").alias("a"), F.max("snap").alias("b"), F.array_sort(F.collect_list(F.struct("snap", "version"))).alias("at"))
    names = F.transform("at", lambda x: x["version"])
    named = items.withColumn("versions", names).join(n, "store")
    return named.select("store", "sha", F.concat("uid", F.lit("@"), F.substring("sha", 1, 8)).alias("id"), "uid", "versions", F.get("versions", F.lit(0)).alias("first"), F.element_at("versions", -1).alias("last"), (F.col("b") - 1).cast("int").alias("latest_index"), "n_versions")


def new_contents(rows: DataFrame) -> DataFrame:
    """(store, snap, n_contents, n_new): contents of each version, and how many no version before it had."""
    first = rows.groupBy("store", "sha").agg(F.min("snap").alias("first"))
    seen = rows.select("store", "snap", "sha").distinct().join(first, ["store", "sha"])
    return seen.groupBy("store", "snap").agg(F.count("*").alias("n_contents"), F.count_if(F.col("first") == F.col("snap")).alias("n_new"))


def distinct_blobs(texts: DataFrame) -> DataFrame:
    """(sha, text) of distinct non-null texts, keyed by the hash of their content."""
    return texts.where("text IS NOT NULL").select(F.sha1("text").alias("sha"), "text").dropDuplicates(["sha"])


def with_texts(rows: DataFrame, blobs: DataFrame) -> DataFrame:
    """Rows joined with the texts of their sha; a row whose content is missing raises when it is read.

    Two writers may both have added a content; one of equal ones is taken.
    """
    joined = rows.join(blobs.select("sha", "text").dropDuplicates(["sha"]), "sha", "left")
    missing = F.concat(F.lit("no content for sha "), F.col("sha"))
    return joined.withColumn("text", F.when(F.col("text").isNull() & F.col("sha").isNotNull(), F.raise_error(missing).cast("string")).otherwise(F.col("text")))
