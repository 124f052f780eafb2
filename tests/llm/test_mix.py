import math

import pytest
from pyspark.sql import functions as F

from verdigris.llm import mix as X


def sizes(spark, spec):
    rows = [(f"{s}-{i}", s, n) for s, (docs, n) in spec.items() for i in range(docs)]
    return spark.createDataFrame(rows, "doc_id string, source string, n_tokens bigint").withColumn("copy", F.lit(9)).withColumn("block", F.lit("x"))


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def run(spark, spec, wanted, **kw):
    mixed, report = X.mix(sizes(spark, spec), targets(spark, wanted), **kw)
    return mixed, {r.source: r for r in report.collect()}


def test_targets_are_met_and_nobody_is_repeated_too_often(spark):
    spec = {"big": (4000, 50), "mid": (900, 40), "small": (60, 30), "extra": (100, 10)}
    mixed, got = run(spark, spec, [("Big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.1, 4), ("absent", 0.1, 3)])
    for s, t in (("big", 0.5 / 0.9), ("mid", 0.3 / 0.9), ("small", 0.1 / 0.9)):
        assert abs(got[s].reached_share - t) < 0.01 and got[s].most_used <= {"big": 1, "mid": 2, "small": 4}[s]
    assert got["absent"].tokens == 0 and "extra" not in got
    assert got["small"].most_used == 4 and got["small"].n_rows == 240  # the scarce source bounds the mix
    assert mixed.groupBy("doc_id", "copy").count().where("count > 1").count() == 0


def test_a_larger_mix_tempers_the_shares(spark):
    spec = {"big": (1000, 50), "small": (10, 50)}
    _, got = run(spark, spec, [("big", 0.5, 1), ("small", 0.5, 2)], total=20_000)
    assert got["small"].most_used <= 2 and 0.04 < got["small"].reached_share < 0.5 and abs(sum(r.reached_share for r in got.values()) - 1) < 1e-9
    _, all_of_it = run(spark, spec, [("big", 0.5, 1), ("small", 0.5, 2)], total=1e12)
    assert all_of_it["big"].n_rows == 1000 and all_of_it["small"].n_rows == 20


def test_all_available_tokens_temper_the_shares(spark):
    """The exponent is the smallest that no repetition limit forbids, and the shares planned are reached."""
    spec = {"big": (4000, 50), "mid": (900, 40), "small": (60, 30)}
    mixed, got = run(spark, spec, [("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 4)], total="available")
    assert 0 < got["small"].exponent < 1 and got["small"].most_used <= 4 and sum(r.tokens for r in got.values()) == pytest.approx(237_800, rel=0.01)
    assert all(abs(r.planned_share - r.reached_share) < 0.01 for r in got.values())
    most = {"big": 200_000, "mid": 72_000, "small": 7_200}
    below = X.normalised({s: t ** (1 - e) * most[s] ** e for s, t, e in (("big", 0.5, got["big"].exponent - 1e-3), ("mid", 0.3, got["big"].exponent - 1e-3), ("small", 0.2, got["big"].exponent - 1e-3))})
    assert any(237_800 * w > most[s] for s, w in below.items())


def test_entropy_mix_is_realised(spark):
    spec = {"big": (4000, 50), "mid": (900, 40), "small": (60, 30)}
    wanted = [("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 4)]
    mixed, got = run(spark, spec, wanted, entropy="targets")
    goal = -sum(t * math.log(t) for _, t, _ in wanted)
    assert -sum(r.planned_share * math.log(r.planned_share) for r in got.values()) == pytest.approx(goal, abs=1e-6)
    assert all(abs(r.planned_share - r.reached_share) < 0.01 and r.most_used <= r.max_repeats for r in got.values()) and 0 < got["big"].exponent < 1


def test_same_every_time(spark):
    spec = {"a": (300, 7), "b": (300, 5)}
    one, two = (sorted(map(tuple, run(spark, spec, [("a", 0.9, 1), ("b", 0.1, 1)])[0].collect())) for _ in range(2))
    assert one == two and len(one) > 300


def test_nothing_to_mix(spark):
    mixed, got = run(spark, {}, [("a", 1.0, 1)])
    assert mixed.count() == 0 and got["a"].reached_share == 0.0
    mixed, got = run(spark, {"a": (5, 3)}, [("a", 0.0, 1), (None, 1.0, 1)])
    assert mixed.count() == 0 and set(got) == {"a"}
    assert run(spark, {"a": (5, 3)}, [])[1] == {}


def test_spellings_and_sizes(spark):
    rows = [(1, "hello world", " Judge-Forum "), (2, "x", "judge_forum"), (3, None, "a"), (4, "", "a"), (5, "x", None), (None, "x", "a")]
    got = {r.doc_id: (r.source, r.n_tokens) for r in X.sized(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert got == {1: ("judge_forum", 2), 2: ("judge_forum", 1)}


def test_entropy():
    shares, power = X.entropy_shares({"a": 1000, "b": 10}, 0.5)
    assert abs(-sum(w * __import__("math").log(w) for w in shares.values()) - 0.5) < 1e-6 and 0 < power < 1
    assert X.entropy_shares({"a": 1000, "b": 10}, 0.0)[1] == pytest.approx(1.0)
