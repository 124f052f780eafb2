"""Mixing sources to target shares of all tokens.

Method (temperature mixing): the share of a source is its target share t when every source can supply it, and else
t**(1-e) * c**e, normalised, where c is what the source can supply at most (its tokens times its permitted
repeats); the exponent e is bisected to the smallest one under which no source is repeated beyond its limit.
Without targets the shares are natural shares to a power that is bisected to meet a given entropy.  A source's budget
becomes whole passes over its documents and one pass cut at the budget, each pass being a permutation of hash blocks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from verdigris.llm.encode import DEFAULT_DIR, DEFAULT_NAME, encode
from verdigris.runtime import materialise

BLOCK_DOCS = 256
MAX_BLOCKS = 1 << 17
#: More sources than this are no fixed table of targets.
MAX_SOURCES = 10_000


def source_name(source: Column) -> Column:
    """One spelling of a source: lower case, runs of blanks, hyphens and underscores as one underscore."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s_-]+", "_")


def bisect(holds, low: float, high: float, rounds: int = 100) -> float:
    """The smallest point at which the monotone ``holds`` is true, given that it is at ``high``."""
    if holds(low):
        return low
    for _ in range(rounds):
        mid = (low + high) / 2
        low, high = (low, mid) if holds(mid) else (mid, high)
    return high


def normalised(weights: dict) -> dict:
    total = sum(weights.values())
    return {k: w / total for k, w in weights.items()} if total else weights


def tempered_shares(targets: dict, most: dict, total: float) -> tuple[dict, float]:
    """Shares and exponent for a mix of ``total`` tokens of which source s can give ``most[s]``."""

    def shares(e):
        return normalised({s: math.exp((1 - e) * math.log(t) + e * math.log(most[s])) for s, t in targets.items()})

    def possible(e):
        return all(total * w <= most[s] * (1 + 1e-12) for s, w in shares(e).items())

    e = bisect(possible, 0.0, 1.0)
    return shares(e), e


def entropy_shares(tokens: dict, entropy: float) -> tuple[dict, float]:
    """Natural shares to the largest power in [0, 1] whose entropy (in nats) is at least ``entropy``."""

    def shares(power):
        return normalised({s: math.exp(power * math.log(n)) for s, n in tokens.items()})

    def met(drop):
        return -sum(w * math.log(w) for w in shares(1 - drop).values() if w > 0) >= entropy

    drop = bisect(met, 0.0, 1.0)
    return shares(1 - drop), 1 - drop


def sized(documents: DataFrame, folder: str = DEFAULT_DIR, name: str = DEFAULT_NAME) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents with a source, an id and at least one token."""
    rows = documents.where("doc_id IS NOT NULL AND source IS NOT NULL").select("doc_id", "text", source_name(F.col("source")).alias("source"))
    coded = encode(rows, "doc_id", folder=folder, name=name, keep=("source",))
    return coded.select("doc_id", "source", F.size("ids").cast("bigint").alias("n_tokens")).where("n_tokens > 0")


def mix(sizes: DataFrame, targets: DataFrame, total: float | str | None = None, entropy: float | str | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """The mix and its report.

    ``sizes`` is (doc_id, source, n_tokens), ``targets`` (source, target_share, max_repeats).  ``total`` is the size of
    the mix in tokens; by default the largest at which every source that has documents reaches its target share, so
    a scarce source bounds the size rather than missing its share; ``"available"`` stands for all tokens of the target
    sources, each once, which tempers the shares wherever a source is scarce.  With ``entropy`` (in nats, or
    ``"targets"`` for that of the target shares) the shares are natural ones tempered to it instead, at the largest size
    that no repetition limit forbids.  Sources that are absent, have no positive share or
    no permitted repeat get nothing, and the others share what is left in proportion.  Sources without a target are
    not used.

    The mix is (doc_id, source, copy, block, n_tokens), one row for each use of a document, ``copy`` counting from 1;
    within a copy, blocks in the order of ``block`` are a random order of the source.  The report is one row for each
    target: (source, target_share, max_repeats, available_tokens, exponent, planned_share, tokens, reached_share, n_docs, n_rows,
    most_used); ``exponent`` is how far the shares were tempered, 0 being the target shares and 1 those of the supply.
    """
    targets = targets.where("source IS NOT NULL").groupBy(source_name(F.col("source")).alias("source")).agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    supply = sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    plan = targets.join(supply, "source", "left").limit(MAX_SOURCES + 1).collect()  # the fixed table of targets
    if len(plan) > MAX_SOURCES:
        raise ValueError("too many target sources")
    usable = [r for r in plan if r.tokens and (r.target_share or 0) > 0 and (r.max_repeats or 0) > 0]
    wanted = normalised({r.source: r.target_share for r in usable})
    most = {r.source: r.tokens * r.max_repeats for r in usable}
    fits = lambda shares: min([most[s] / w for s, w in shares.items()], default=0.0)
    shares, exponent, size = {}, 0.0, 0.0
    if usable and entropy is not None:
        goal = -sum(w * math.log(w) for w in wanted.values()) if entropy == "targets" else entropy
        shares, power = entropy_shares({r.source: r.tokens for r in usable}, goal)
        exponent, size = power, min(fits(shares), total if isinstance(total, (int, float)) else math.inf)
    elif usable:
        size = fits(wanted) if total is None else min(sum(r.tokens for r in usable) if total == "available" else total, sum(most.values()))
        shares, exponent = tempered_shares(wanted, most, size)
    spark = sizes.sparkSession
    budgets = []
    for r in usable:
        budget = min(size * shares[r.source], most[r.source])
        whole = min(int(budget * (1 + 1e-12) // r.tokens), r.max_repeats)
        budgets.append((r.source, whole, max(0.0, budget - whole * r.tokens) if whole < r.max_repeats else 0.0, max(1, min(MAX_BLOCKS, r.docs // BLOCK_DOCS)), float(shares[r.source])))
    plans = spark.createDataFrame(budgets, "source string, whole int, rest double, n_blocks bigint, planned double")
    at = lambda *salt: F.xxhash64(F.lit(seed), *salt)
    placed = sizes.join(F.broadcast(plans), "source")
    # whole passes need no order across documents, only a block number
    passes = placed.where("whole > 0").select("doc_id", "source", F.explode(F.sequence(F.lit(1), "whole")).alias("copy"), "n_tokens", "n_blocks")
    passes = passes.select("doc_id", "source", "copy", F.pmod(at("doc_id", "copy"), "n_blocks").alias("block"), "n_tokens")
    cut = placed.where("rest > 0").select("doc_id", "source", (F.col("whole") + 1).alias("copy"), "n_tokens", "rest", F.pmod(at("doc_id", F.col("whole") + 1), "n_blocks").alias("block"))
    blocks = cut.groupBy("source", "block").agg(F.sum("n_tokens").alias("in_block"))
    blocks = blocks.withColumn("before", F.sum("in_block").over(W.partitionBy("source").orderBy("block")) - F.col("in_block"))
    cut = cut.join(blocks, ["source", "block"]).where("before < rest")
    inner = cut.where("before + in_block <= rest").select("doc_id", "source", "copy", "block", "n_tokens")
    running = F.sum("n_tokens").over(W.partitionBy("source", "block").orderBy(at("doc_id", F.lit("in")), "doc_id"))
    # the document that crosses the budget stays if more than half of it fits
    edge = cut.where("before + in_block > rest").withColumn("upto", F.col("before") + running).where("upto - n_tokens / 2 <= rest").select("doc_id", "source", "copy", "block", "n_tokens")
    mixed = materialise(passes.unionByName(inner).unionByName(edge), "mix")
    per_doc = mixed.groupBy("source", "doc_id").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("uses"))
    used = per_doc.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n_docs"), F.sum("uses").alias("n_rows"), F.max("uses").alias("most_used"))
    all_tokens = mixed.agg(F.sum("n_tokens")).first()[0] or 0
    report = targets.join(used, "source", "left").join(supply.select("source", F.col("tokens").alias("available_tokens")), "source", "left").join(F.broadcast(plans.select("source", F.col("planned").alias("planned_share"))), "source", "left")
    report = report.withColumn("exponent", F.lit(float(exponent))).fillna(0, ["tokens", "n_docs", "n_rows", "most_used", "available_tokens"]).fillna(0.0, ["planned_share"])
    reached = F.col("tokens") / F.lit(float(all_tokens)) if all_tokens else F.lit(0.0)
    return mixed, report.select("source", "target_share", "max_repeats", "available_tokens", "exponent", "planned_share", "tokens", reached.alias("reached_share"), "n_docs", "n_rows", "most_used")
