import datetime as dt
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from verdigris.llm import rank_walk as R

ITEMS = "search_id bigint, hit_id string, id string, dense double, score double, share double"


def brute(rows):
    """Stationary distribution by the full matrix, and the winner over all others."""
    # a present minus infinity is above a missing score
    v = np.array([[-np.inf if x is None or x != x else max(x, -1e300) for x in r] for r in rows], float)
    n = len(v)
    p = np.zeros((n, n))
    for s in range(v.shape[1]):
        up = v[None, :, s] >= v[:, None, s]
        p += up / up.sum(1, keepdims=True) / v.shape[1]
    pi = np.full(n, 1 / n)
    for _ in range(500):
        pi = (1 - R.DAMPING) / n + R.DAMPING * pi @ p
    wins = [i for i in range(n) if n > 1 and all((v[i] > v[j]).sum() >= 2 for j in range(n) if j != i)]
    return pi, set(wins)


def made(seed, sizes):
    rng = random.Random(seed)
    value = lambda: rng.choice([None, float("nan"), 0.0, 1.0, rng.random(), rng.random() * 1e6, float("-inf")])
    return {g: [(value(), value(), rng.choice([None, 0.0, 0.5, 1.0])) for _ in range(n)] for g, n in enumerate(sizes)}


def rows_of(groups):
    return [(g, f"h{g}-{i:03}", f"d{i:03}", *v) for g, rows in groups.items() for i, v in enumerate(rows)]


def check(spark, groups, hot_rows, tolerance=R.TOLERANCE, apart=1e-7):
    df = spark.createDataFrame(rows_of(groups), ITEMS).withColumn("p", F.lit("clash")).withColumn("walk_rank", F.lit(0)).repartition(3)
    got = {}
    for r in R.rank_walk(df, hot_rows, tolerance).collect():
        got.setdefault(r.search_id, []).append(r)
    assert set(got) == set(groups)
    for g, rows in groups.items():
        pi, wins = brute(rows)
        mine = sorted(got[g], key=lambda r: r.hit_id)
        assert np.allclose([r.stationary for r in mine], pi, atol=apart)
        assert {i for i, r in enumerate(mine) if r.pair_winner} == wins
        assert sorted(r.walk_rank for r in mine) == list(range(1, len(rows) + 1))
        order = sorted(mine, key=lambda r: (-r.stationary, r.id))
        assert [r.walk_rank for r in order] == list(range(1, len(rows) + 1))


def test_against_the_full_matrix(spark):
    check(spark, made(1, [1, 2, 3, 7, 30, 12, 2, 2]), R.HOT_ROWS)


def test_hot_groups_take_the_distributed_walk(spark):
    groups = made(2, [3, 25])
    # one item that wins over all others, among many ties
    groups[1][4] = (9e9, 9e9, 2.0)
    check(spark, groups, 10, 1e-6)


def test_winners_come_through_the_walk(monkeypatch):
    """Items are tried in walk order, and another walk gives other rows."""
    rng = np.random.default_rng(4)
    group = np.repeat(np.arange(300), 8)
    scores = [np.round(rng.random(len(group)), 1) for _ in range(3)]
    p, levels = R.walk(group, scores)
    order = np.lexsort((-p, group))
    right = R._pair_winner(p[order], group, [x[order] for x in levels])
    want = [i for g in range(300) for i in range(8) if all(sum(s[8 * g + i] > s[8 * g + j] for s in scores) >= 2 for j in range(8) if j != i) for i in [8 * g + i]]
    assert sorted(order[right]) == want and len(want) > 30
    assert (p[want] >= R.least_of_a_winner(8)).all()
    upside = 1 / p / 64
    order = np.lexsort((-upside, group))
    assert R._pair_winner(upside[order], group, [x[order] for x in levels]).sum() < len(want) / 2


def test_large_group_with_a_tie_of_a_third(spark):
    """The distributed walk equals the one in a task on a group whose scores are tied for many items."""
    rng = random.Random(9)
    rows = [(None if rng.random() < 0.2 else float(rng.randint(0, 400)), rng.random(), rng.choice([1.0, 1.0, None, 0.0, rng.random()])) for _ in range(6000)] + [(None, None, None)] * 3000
    df = spark.createDataFrame(rows_of({5: rows}), ITEMS).repartition(4)
    cool, hot = ({r.hit_id: r for r in R.rank_walk(df, h, 1e-8).collect()} for h in (R.HOT_ROWS, 100))
    assert len(hot) == 9000 and sorted(r.walk_rank for r in hot.values()) == list(range(1, 9001))
    assert all(abs(cool[h].stationary / hot[h].stationary - 1) < 1e-7 for h in cool) and all(cool[h].pair_winner == hot[h].pair_winner for h in cool)
    assert sum(cool[h].walk_rank == hot[h].walk_rank for h in cool) > 8900


def test_no_scale_drowns_another(spark):
    groups = {0: [(0.9, 1e6, 0.9), (0.8, 2e6, 0.8), (0.1, 9e9, 0.1)]}
    best = min(R.rank_walk(spark.createDataFrame(rows_of(groups), ITEMS)).collect(), key=lambda r: r.walk_rank)
    assert best.id == "d000"


def test_empty(spark):
    assert R.rank_walk(spark.createDataFrame([], ITEMS)).count() == 0


def test_latest_hits(spark):
    t = dt.datetime(2024, 1, 1)
    v = "struct<tier string, passed int, total int>"
    rows = [("a", t, 1, "x", 1.0, 2.0, ("t", 1, 2)), ("a", t + dt.timedelta(1), 1, "x", 3.0, None, ("t", 1, 0)), ("b", None, 1, "y", float("nan"), 1.0, None), (None, t, 1, "z", 1.0, 1.0, None)]
    got = {r.hit_id: (r.dense, r.score, r.share) for r in R.latest_hits(spark.createDataFrame(rows, f"hit_id string, logged_at timestamp_ntz, search_id bigint, id string, dense double, score double, verification {v}")).collect()}
    assert got == {"a": (3.0, None, None), "b": (None, 1.0, None)}


def test_large_groups_are_not_ranked_by_id():
    """The probabilities of a large group are small, but no ties; small groups beside it change nothing."""
    n, more = 30_000, 10_000
    rng = np.random.default_rng(5)
    search = np.concatenate([np.repeat(np.arange(more // 20), 20), np.full(n, more)])
    ids = [f"d{i:05}" for i in range(n + more)]
    scores = [rng.random(n + more) for _ in R.SCORES]
    batch = pa.RecordBatch.from_arrays([pa.array(search), pa.array(ids), pa.array(ids), *map(pa.array, scores)], ["search_id", "hit_id", "id", *R.SCORES])
    out = pa.Table.from_batches(R._walk_batches([batch]))
    mine = out.slice(more)
    p, _ = R.walk(np.zeros(n, np.int64), [s[more:] for s in scores], tolerance=1e-14)
    got, rank = mine["stationary"].to_numpy(), mine["walk_rank"].to_numpy()
    assert len(np.unique(got)) > 0.999 * n and np.allclose(got, p, rtol=3e-9, atol=0)
    assert (np.diff(p[np.argsort(rank)]) < 3e-9 * p.max()).all() and (np.argsort(rank) == np.argsort(-p, kind="stable")).mean() > 0.999
