"""One ranking from several differently-scaled scores: a random walk over the items of a group.

Method: standing on an item, the walk picks one of the scores at random and jumps uniformly to an item that is at
least as good in it (itself included).  Only orders matter, so no scale can drown another.  The stationary
probabilities come from power iteration with damping; a step over one score is a prefix sum over its sorted order.

Missing scores (null or not a number) rank below every present one and tie with each other; equal scores tie.
Stationary probabilities shrink with the size of a group, so they are compared and rounded relative to themselves.
Items with equal stationary probability are ordered by id and hit_id.  Rows without a group key are in no group.

An item that is better than each other in most scores (``pair_winner``) is found through the walk: the items are tried
in the order of their probability, and whatever comes after one that failed must be better than it in most scores.  A
winner of n items is reached from each other item by at least two of three scores, so its probability is at least
(1 - DAMPING / 3) / n; items below that are never tried.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from verdigris.llm.batches import whole_groups
from verdigris.runtime import broadcast_if_small, materialise, release

DAMPING = 0.85
#: The walk stops when no probability changes by more than this part of itself.
TOLERANCE = 1e-10
MAX_STEPS = 200
#: Groups of more rows than this are ranked by the distributed walk.
HOT_ROWS = 100_000
SCORES = ("dense", "score", "share")


def latest_hits(hits: DataFrame, *more: str) -> DataFrame:
    """One row per hit_id, the one logged last (at equal times the greatest values), with ``share`` = passed/total.

    ``share`` is missing without verification or when total is 0 or less.  Rows without a hit_id are left out.
    """
    v = F.col("verification")
    share = F.when(v["total"] > 0, v["passed"].cast("double") / v["total"])
    narrow = hits.where("hit_id IS NOT NULL").select("hit_id", "logged_at", "search_id", "id", *[F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) for c in ("dense", "score")], share.alias("share"), *more)
    rest = [c for c in narrow.columns if c not in ("hit_id", "logged_at")]
    return narrow.groupBy("hit_id").agg(F.max(F.struct("logged_at", *rest)).alias("last")).select("hit_id", *[F.col(f"last.{c}").alias(c) for c in rest])


def _levels(group: np.ndarray, values: np.ndarray):
    """Sorted order of one score inside each group, and per sorted place the first and last place of its tie."""
    missing = np.isnan(values)
    order = np.lexsort((np.where(missing, 0.0, values), ~missing, group))
    g, v, m = group[order], values[order], missing[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (m[1:] != m[:-1]) | ((v[1:] != v[:-1]) & ~m[1:])
    starts = np.flatnonzero(new)
    tie = np.cumsum(new) - 1
    return order, starts[tie], np.append(starts[1:], len(g))[tie] - 1


def walk(group: np.ndarray, scores: list[np.ndarray], damping=DAMPING, tolerance=TOLERANCE, steps=MAX_STEPS):
    """Stationary probability of every item, and its tie level in every score.

    ``group`` is non-decreasing from 0; the groups are independent walks taken together.
    """
    n = len(group)
    size = np.bincount(group)
    end = np.cumsum(size)
    base = (end - size)[group]
    prepared, levels = [], []
    for values in scores:
        order, first, last = _levels(group, values)
        inverse = np.empty(n, np.int64)
        inverse[order] = np.arange(n)
        prepared.append((order, 1.0 / (end[group] - first), last[inverse] + 1))
        levels.append(first[inverse])
    p = 1.0 / size[group]
    rest = (1 - damping) / size[group]
    cum = np.zeros(n + 1, np.longdouble)  # it runs over all groups, whose probabilities may be far smaller
    for _ in range(steps):
        q = np.zeros(n)
        for order, share, until in prepared:
            np.cumsum(p[order] * share, dtype=np.longdouble, out=cum[1:])
            q += (cum[until] - cum[base]).astype(float)
        q = rest + damping / len(scores) * q
        moved = (np.abs(q - p) / q).max(initial=0.0)
        p = q
        if moved < tolerance:
            break
    return p, levels


def rounded(p: np.ndarray) -> np.ndarray:
    """Nine digits after the point of a binary mantissa in [1, 2), so that no size of group makes ties."""
    mantissa, exponent = np.frexp(p)
    return np.ldexp(np.round(2 * mantissa, 9), exponent - 1)


def _rounded(p: Column) -> Column:
    """:func:`rounded` in SQL."""
    unit = F.pow(F.lit(2.0), F.floor(F.log2(p)))
    return F.round(p / unit, 9) * unit


def least_of_a_winner(n, scores: int = len(SCORES), damping: float = DAMPING):
    """The least stationary probability of an item that beats each of the others in most of the scores."""
    need = scores // 2 + 1
    return (1 - damping + damping * need / scores) / n * (1 - 1e-9)


def _pair_winner(p: np.ndarray, group: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """True for an item that is better than each other of its group in most scores.

    Items come in walk order (by group, most probable first).  Every group's first item that is still possible is held
    against all others; if it does not win, only items that are better than it stay possible.
    """
    need, n_groups = len(levels) // 2 + 1, int(group[-1]) + 1 if len(group) else 0
    won, size, rows = np.zeros(len(group), bool), np.bincount(group, minlength=n_groups), np.stack(levels, axis=1)
    possible = (p >= least_of_a_winner(size[group], len(levels))) & (size[group] > 1)
    while possible.any():
        at = np.flatnonzero(possible)
        tried = at[np.concatenate([[True], group[at][1:] != group[at][:-1]])]
        of = np.full(n_groups, -1)
        of[group[tried]] = tried
        these = np.flatnonzero(of[group] >= 0)
        mine, theirs = rows[these], rows[of[group[these]]]
        beaten = np.bincount(group[these], ((theirs > mine).sum(1) >= need), n_groups)
        winners = tried[beaten[group[tried]] == size[group[tried]] - 1]
        won[winners] = True
        above = np.zeros(len(group), bool)
        above[these] = (mine > theirs).sum(1) >= need
        above[np.isin(group, group[winners])] = False
        possible &= above
    return won


def _walk_batches(batches, tolerance=TOLERANCE):
    for table in whole_groups(batches, ["search_id"]):
        search = table["search_id"].to_numpy()
        group = np.cumsum(np.concatenate([[False], search[1:] != search[:-1]])).astype(np.int64)
        p, levels = walk(group, [table[c].to_numpy(zero_copy_only=False).astype(float) for c in SCORES], tolerance=tolerance)
        # rows arrive by id and hit_id, so a stable sort breaks ties by them
        p = rounded(p)
        order = np.lexsort((np.arange(len(p)), -p, group))
        size = np.bincount(group)
        end = np.cumsum(size)
        rank = np.empty(len(p), np.int32)
        rank[order] = np.arange(len(p)) - (end - size)[group[order]] + 1
        winner = np.zeros(len(p), bool)
        winner[order] = _pair_winner(p[order], group[order], [x[order] for x in levels])
        yield pa.RecordBatch.from_arrays([*(table[c].combine_chunks() for c in ("search_id", "hit_id", "id")), pa.array(p), pa.array(rank), pa.array(winner)], ["search_id", "hit_id", "id", "stationary", "walk_rank", "pair_winner"])


_OUT = "search_id bigint, hit_id string, id string, stationary double, walk_rank int, pair_winner boolean"


def rank_walk(items: DataFrame, hot_rows: int = HOT_ROWS, tolerance: float = TOLERANCE) -> DataFrame:
    """(search_id, hit_id, id, stationary, walk_rank, pair_winner) for items (search_id, hit_id, id, dense, score, share).

    Groups up to ``hot_rows`` rows are walked whole, many at once, in one task; larger ones by :func:`_walk_hot`.
    """
    narrow = items.where("search_id IS NOT NULL").select("search_id", "hit_id", "id", *[F.nullif(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in SCORES])
    narrow = materialise(narrow, "walk-items")
    hot = materialise(narrow.groupBy("search_id").agg(F.count("*").alias("total")).where(F.col("total") > hot_rows), "walk-hot")
    if hot.isEmpty():
        cool = narrow
    else:
        hot = broadcast_if_small(hot)
        cool = narrow.join(hot, "search_id", "left_anti")
    ranked = cool.repartition("search_id").sortWithinPartitions("search_id", "id", "hit_id").mapInArrow(functools.partial(_walk_batches, tolerance=tolerance), _OUT)
    return ranked if cool is narrow else ranked.unionByName(_walk_hot(narrow.join(hot, "search_id"), tolerance))


def _numbered(rows: DataFrame, by: list[str], order: list[Column], to: str) -> DataFrame:
    """Places from 1 in each group of ``by``, for groups of any size: rows are range-partitioned by the whole order, each
    task counts on its own, and what lies in the tasks before is added."""
    kinds, names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), rows.columns

    def count(batches):
        from pyspark import TaskContext

        task, seen, last = TaskContext.get().partitionId(), 0, None
        for b in batches:
            if not b.num_rows:
                continue
            codes = np.array([hash(k) for k in zip(*(b[c].to_pylist() for c in by))])
            place = np.arange(1, b.num_rows + 1)
            new = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            begun = np.repeat(place[new] - 1, np.diff(np.append(new, b.num_rows)))
            place -= begun
            if codes[0] == last:
                place[: new[1] if len(new) > 1 else b.num_rows] += seen
            last, seen = codes[-1], int(place[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, task, np.int32)), pa.array(place)], [*names, "task", "place"])

    sliced = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    placed = materialise(sliced.mapInArrow(count, f"{kinds}, task int, place bigint"), "walk-placed")
    held = placed.groupBy(*by, "task").agg(F.max("place").alias("held"))
    before = held.select(*by, "task", (F.sum("held").over(W.partitionBy(*by).orderBy("task")) - F.col("held")).alias("before"))  # a row for each task and group in it
    return placed.join(broadcast_if_small(before), [*by, "task"]).withColumn(to, F.col("place") + F.col("before")).drop("task", "place", "before")


#: Levels of a block whose prefix sums one window holds, and over how many keys a level with many items is spread.
BLOCK_LEVELS, SALTS = 4096, 64
#: A level or state with more than this part of a group's items is spread.
HOT_PART = 1 / 500


def _cumulated(levels: DataFrame, amount: str) -> DataFrame:
    """Adds ``cum``: the sum of ``amount`` over the levels up to and including each; ``level`` counts from 1."""
    at = ["search_id", "s"]
    levels = levels.withColumn("block", F.floor((F.col("level") - 1) / BLOCK_LEVELS))
    blocks = levels.groupBy(*at, "block").agg(F.sum(amount).alias("whole"))
    blocks = blocks.withColumn("before", F.sum("whole").over(W.partitionBy(*at).orderBy("block")) - F.col("whole")).drop("whole")
    inside = F.sum(amount).over(W.partitionBy(*at, "block").orderBy("level").rowsBetween(W.unboundedPreceding, 0))
    return levels.withColumn("inside", inside).join(broadcast_if_small(blocks), [*at, "block"]).withColumn("cum", F.col("before") + F.col("inside")).drop("inside", "before", "block")


def _looked_up(rows: DataFrame, table: DataFrame, keys: list[str], spread_by: str) -> DataFrame:
    """``rows`` joined with a ``table`` of distinct keys; the keys marked ``hot`` there are spread over SALTS copies.

    Hot keys hold more than HOT_PART of a group each, so there are at most 1 / HOT_PART of them in a group.
    """
    hot = broadcast_if_small(table.where("hot").select(*keys, F.lit(True).alias("spread")))
    salted = rows.join(hot, keys, "left").withColumn("salt", F.when(F.col("spread"), F.pmod(F.xxhash64(spread_by), F.lit(SALTS))).otherwise(F.lit(0).cast("bigint"))).drop("spread")
    copies = F.when(F.col("hot"), F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint")))
    return salted.join(table.withColumn("salt", F.explode(copies)), [*keys, "salt"]).drop("salt")


def _walk_hot(items: DataFrame, tolerance: float = TOLERANCE, steps: int = MAX_STEPS) -> DataFrame:
    """The same walk for groups too large for a task; ``items`` carry their group's ``total``.

    Items of equal value share a level, and items with the same levels in all scores share a state, so a tie of any
    size is one row of the iteration.  Prefix sums run inside blocks of levels and over the blocks.
    """
    low, n = F.lit(float("-inf")), len(SCORES)
    # a present minus infinity stays above a missing score
    scores = F.explode(F.array(*[F.struct(F.lit(i).alias("s"), F.col(c).isNotNull().cast("int").alias("there"), F.coalesce(F.col(c), low).alias("value")) for i, c in enumerate(SCORES)]))
    long = materialise(items.select("search_id", "hit_id", "total", scores.alias("x")).select("search_id", "hit_id", "total", "x.*"), "walk-long")
    counts = long.groupBy("search_id", "s", "there", "value").agg(F.count("*").alias("n"), F.first("total").alias("total"))
    numbered = _numbered(counts, ["search_id", "s"], [F.col("there"), F.col("value")], "level")
    levels = _cumulated(numbered, "n").withColumn("at_least", F.col("total") - F.col("cum") + F.col("n")).withColumn("hot", F.col("n") > HOT_PART * F.col("total"))
    levels = materialise(levels.select("search_id", "s", "there", "value", "level", "at_least", "hot"), "walk-levels")
    placed = _looked_up(long, levels, ["search_id", "s", "there", "value"], "hit_id")
    legs_of = [F.max(F.when(F.col("s") == i, F.struct("level", "at_least", "hot"))).alias(f"l{i}") for i in range(n)]
    wide = materialise(placed.groupBy("search_id", "hit_id").agg(F.first("total").alias("total"), *legs_of), "walk-wide")
    names = [f"l{i}" for i in range(n)]
    states = wide.groupBy("search_id", *names).agg(F.count("*").alias("m"), F.first("total").alias("total")).withColumn("state", F.monotonically_increasing_id())
    states = materialise(states, "walk-states")
    legs = F.explode(F.array(*[F.struct(F.lit(i).alias("s"), f"l{i}.*") for i in range(n)])).alias("x")
    legs = materialise(states.select("search_id", "state", "m", "total", legs).select("search_id", "state", "m", "total", "x.*"), "walk-legs")
    hot = levels.select("search_id", "s", "level", "hot")
    p = materialise(states.select("search_id", "state", (1 / F.col("total")).alias("p")), "walk-p")
    for _ in range(steps):
        mass = legs.join(p, ["search_id", "state"]).groupBy("search_id", "s", "level").agg(F.sum(F.col("p") * F.col("m") / F.col("at_least")).alias("w"), F.first("hot").alias("hot"))
        got = materialise(_cumulated(mass, "w").select("search_id", "s", "level", "hot", F.col("cum").alias("got")), "walk-got")
        new = _looked_up(legs.drop("hot"), got, ["search_id", "s", "level"], "state").groupBy("search_id", "state").agg(((1 - DAMPING) / F.first("total") + DAMPING / n * F.sum("got")).alias("p"))
        new = materialise(new, "walk-p")
        moved = new.join(p.withColumnRenamed("p", "old"), ["search_id", "state"]).agg(F.max(F.abs(F.col("p") - F.col("old")) / F.col("p"))).first()[0]
        release(p, got)
        p = new
        if moved < tolerance:
            break
    states = states.join(p, ["search_id", "state"]).select("search_id", "state", *[F.col(f"{c}.level").alias(c) for c in names], "m", "total", _rounded(F.col("p")).alias("p"), (F.col("m") > HOT_PART * F.col("total")).alias("hot"))
    states = materialise(states, "walk-ranked-states")
    winners = _hot_winners(states, names)
    flat = wide.select("search_id", "hit_id", *[F.col(f"{c}.level").alias(c) for c in names])
    found = _looked_up(flat, states.select("search_id", *names, "state", "p", "hot"), ["search_id", *names], "hit_id").join(winners, ["search_id", "state"], "left")
    found = found.select("search_id", "hit_id", "p", F.coalesce("won", F.lit(False)).alias("pair_winner")).join(items.select("search_id", "hit_id", "id"), ["search_id", "hit_id"])
    ranked = _numbered(found, ["search_id"], [F.desc("p"), F.col("id"), F.col("hit_id")], "walk_rank")
    return ranked.select("search_id", "hit_id", "id", F.col("p").alias("stationary"), F.col("walk_rank").cast("int").alias("walk_rank"), "pair_winner")


def _hot_winners(states: DataFrame, names: list[str]) -> DataFrame:
    """(search_id, state, won): :func:`_pair_winner` over the states of large groups, one tried state a group and round."""
    need = len(names) // 2 + 1
    better = lambda a, b: sum((F.col(f"{a}{c}") > F.col(f"{b}{c}")).cast("int") for c in names) >= need
    possible = states.where(F.col("p") >= least_of_a_winner(F.col("total"), len(names)))
    won = None
    while True:
        tried = possible.groupBy("search_id").agg(F.max_by(F.struct("state", "m", *names), F.struct("p", -F.col("state"))).alias("t")).select("search_id", F.col("t.state").alias("tried"), F.col("t.m").alias("copies"), *[F.col(f"t.{c}").alias(f"t{c}") for c in names])
        tried = materialise(tried, "walk-tried")  # a row for each large group
        if tried.isEmpty():
            break
        held = broadcast_if_small(tried)
        tally = states.join(held, "search_id").groupBy("search_id", "tried", "copies").agg(F.sum(F.when(better("t", ""), F.col("m")).otherwise(0)).alias("beaten"), F.first("total").alias("total"))
        new = materialise(tally.where("copies = 1 AND beaten = total - 1").select("search_id", F.col("tried").alias("state"), F.lit(True).alias("won")), "walk-won")
        won = new if won is None else won.unionByName(new)
        possible = materialise(possible.join(held, "search_id").where(better("", "t")).select(*states.columns).join(new.select("search_id"), "search_id", "left_anti"), "walk-possible")
    return won if won is not None else states.select("search_id", "state", F.lit(True).alias("won")).limit(0)
