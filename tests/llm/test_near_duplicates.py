import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.llm import near_duplicates as N
from verdigris.llm.components import components


def texts_with_copies(seed=3, families=40):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 4000)}"
    out = {}
    for f in range(families):
        base = [word() for _ in range(rng.randint(4, 120))]
        for k in range(rng.choice([1, 1, 2, 5])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                i = rng.randrange(len(own))
                rng.choice([lambda: own.__setitem__(i, word()), lambda: own.insert(i, word()), lambda: own.pop(i) if len(own) > 4 else None])()
            out[f"r{f:03}-{k}"] = rng.choice([" ", "\n", ", "]).join(own)
    return out | {"copy1": "a b c d", "copy2": "A, b; C d!", "copy3": "a b c d", "short": "a b", "empty": "", "null": None, "long": "x y z " * 20_000, "long2": "x y z " * 19_000}


def brute(texts, width, threshold):
    sets = {}
    for r, t in texts.items():
        tokens = N._TOKEN.findall((t or "").lower().encode())
        if len(tokens) >= width:
            sets[r] = {tuple(tokens[i : i + width]) for i in range(len(tokens) - width + 1)}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9}


def found(spark, texts, width, threshold, **kw):
    df = spark.createDataFrame(list(texts.items()), "rec string, text string").withColumn("vid", F.lit(1)).withColumn("sig", F.lit("x"))
    return N.near_duplicates(df, width, threshold, **kw)


@pytest.mark.parametrize("region", [N.REGION, 12, 2])
def test_all_pairs_against_brute_force(spark, region):
    """With small regions crowded ones are sorted anew, deeper, and at last scanned in blocks; wide gaps stay found."""
    texts = texts_with_copies()
    links, members = found(spark, texts, 3, 0.6, region=region)
    rows = [(r.rec_a, r.rec_b) for r in N.all_pairs(links, members).collect()]
    want = brute(texts, 3, 0.6)
    assert len(rows) == len(set(rows)) and set(rows) <= want
    assert set(rows) == want if region == N.REGION else len(rows) >= 0.99 * len(want)


@pytest.mark.parametrize("region,block", [(20, 30), (90, N.BLOCK)])
def test_crowded_group_against_brute_force(spark, region, block):
    """Rewrites of one text, most pairs hardly above the threshold, crowd every order, some at each depth; no pair may
    be lost for it."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(200)]
    texts = {f"r{k:03}": " ".join(w if rng.random() > 0.07 else f"v{rng.randint(0, 99999)}" for w in base) for k in range(300)}
    links, members = found(spark, texts, 3, 0.6, region=region, block=block)
    rows = {(r.rec_a, r.rec_b) for r in N.all_pairs(links, members).collect()}
    want = brute(texts, 3, 0.6)
    assert len(want) > 1000 and rows <= want and len(rows) >= 0.99 * len(want)


def test_orders_make_up_for_depth():
    for threshold in (0.5, 0.6, 0.8, 0.95):
        for depth in N.DEPTHS:
            assert (1 - threshold**depth) ** N.orders_needed(threshold, depth) <= N.MISS
    a, b = N.min_hashes(np.arange(50, dtype=np.uint64), 4, 10), N.min_hashes(np.arange(50, dtype=np.uint64), 4, 30)
    assert (a == b[:10]).all() and (N.min_hashes(np.arange(50, dtype=np.uint64), 6, 10) != a).all()


def test_classes(spark):
    texts = texts_with_copies(4, 15)
    links, members = found(spark, texts, 3, 0.6)
    got = {r.rec: (r.class_id, r.n_links) for r in N.classes(links, members).collect()}
    pairs = brute(texts, 3, 0.6)
    assert got["copy1"][0] == got["copy2"][0] == got["copy3"][0] == "copy1" and got["copy1"][1] == 0
    assert all(got[a][0] == got[b][0] for a, b in pairs) and "short" not in got and "null" not in got
    group = {r: r for r in got}
    find = lambda x: x if group[x] == x else find(group[x])
    for a, b in pairs:
        group[find(a)] = find(b)
    assert len({c for c, _ in got.values()}) == len({find(r) for r in got})


def test_many_copies_are_one_representative(spark):
    texts = {f"c{i:03}": "one two three four five six" for i in range(300)} | {"near": "one two three four five six seven"}
    links, members = found(spark, texts, 3, 0.6)
    assert links.count() == 1 and members.count() == 301 and members.select("vid").distinct().count() == 2
    assert N.all_pairs(links, members).count() == 301 * 300 // 2


def test_five_words_by_default_and_empty(spark):
    texts = {"a": "a b c d e f g h i j k l m n o p q r s t", "b": "a b c d e f g h i j k l m n o p q r s u", "c": "a b c d"}
    links, members = N.near_duplicates(spark.createDataFrame(list(texts.items()), "rec string, text string"))
    assert links.count() == 1 and members.count() == 2
    links, members = N.near_duplicates(spark.createDataFrame([], "rec string, text string"))
    assert N.all_pairs(links, members).count() == 0 and N.classes(links, members).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(5000, 5001), (7, 7), (None, 3)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[1000 + i] for i in range(80)} == {1000} and got[5001] == 5000
