import numpy as np
import pytest

from verdigris.llm import nearest as K
from verdigris.llm import quantise as Q


def data(n, seed=0, clusters=20):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, 64))
    x = rng.normal(size=(n, 64)) + 0.6 * centres[rng.integers(0, clusters, n)]
    near = rng.integers(0, n, n // 2)
    x[: n // 2] = x[near] + 0.1 * rng.normal(size=(n // 2, 64))
    return x.astype("<f4")


def brute(x, k):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    return s, [set(np.argsort(-row, kind="stable")[:k].tolist()) for row in s]


def table(spark, x):
    return spark.createDataFrame([(f"k{i:05}", r.tobytes()) for i, r in enumerate(x)], "key string, vec binary")


def recall(spark, x, k=5, **kw):
    got = {}
    for r in K.most_similar(table(spark, x), k, **kw).collect():
        got.setdefault(int(r.key[1:]), set()).add(int(r.neighbour[1:]))
    _, want = brute(x, k)
    return sum(len(got.get(i, set()) & w) for i, w in enumerate(want)) / (k * len(x)), got


def test_recall_against_brute_force(spark):
    x = data(3000)
    share, got = recall(spark, x)
    assert share >= 0.95 and all(len(v) == 5 for v in got.values())


def test_more_leaves_than_probes(spark, monkeypatch):
    monkeypatch.setattr(K, "LEAF_ROWS", 32)
    monkeypatch.setattr(K, "GROUP_ROWS", 256)
    monkeypatch.setattr(K, "UNIT_QUERIES", 500)  # groups are searched in several units
    assert recall(spark, data(3000, 1), probes=24)[0] >= 0.9


def test_hot_leaf_is_split_and_dealt(spark, monkeypatch):
    monkeypatch.setattr(K, "GROUP_ROWS", 200)
    monkeypatch.setattr(K, "HOT_TIMES", 1)
    rng = np.random.default_rng(3)
    x = data(900, 2)
    x[:400] = x[0] + 1e-3 * rng.normal(size=(400, 64)).astype("<f4")  # a third and more in one place
    assert recall(spark, x.astype("<f4"))[0] >= 0.9


def test_copies_and_unusable_vectors(spark):
    x = data(40, 5)
    rows = [(f"k{i:05}", r.tobytes()) for i, r in enumerate(x)] + [(f"c{i:03}", x[0].tobytes()) for i in range(30)]
    bad = np.full(64, np.nan, "<f4")
    rows += [("nan", bad.tobytes()), ("zero", bytes(256)), ("short", b"\0" * 8), ("empty", b""), ("null", None), (None, x[1].tobytes()), ("k00001", x[1].tobytes())]
    got = {}
    for r in K.most_similar(spark.createDataFrame(rows, "key string, vec binary").repartition(3)).collect():
        got.setdefault(r.key, []).append((r.rank, r.neighbour, r.cosine))
    assert set(got) == {f"k{i:05}" for i in range(40)} | {f"c{i:03}" for i in range(30)}
    assert all(len(v) == 5 for v in got.values())
    assert [n for _, n, _ in sorted(got["k00000"])] == [f"c{i:03}" for i in range(5)]
    assert [n for _, n, _ in sorted(got["c002"])] == ["c000", "c001", "c003", "c004", "c005"]


@pytest.mark.parametrize("n", [0, 1, 2])
def test_tiny_tables(spark, n):
    assert K.most_similar(table(spark, data(8, 7)[:n])).count() == n * (n - 1)


def test_array_embeddings(spark):
    rows = [("a", [1.0] * 64), ("b", [2.0] * 63), ("c", None), ("d", [None] * 64), (None, [1.0] * 64)]
    assert [r.key for r in K.float_vectors(spark.createDataFrame(rows, "id string, e array<float>"), "id", "e").collect()] == ["a"]


def test_codes_favour_the_parallel_error():
    x = Q.unit(data(2000, 9))
    centres = Q.kmeans(x, 8)
    leaf = Q.nearest(x, centres, 1)[:, 0]
    u, length = Q.residuals(x, centres, leaf)
    books = Q.fit_books(u, x)
    codes = Q.choose_codes(u, x, books)
    assert (Q.unpack(Q.pack(codes)) == codes).all()
    decoded = books[np.arange(books.shape[0])[None], codes].reshape(len(u), -1)
    q = x[:50]
    scanned = Q.scan(Q.tables(q, books), codes)
    assert np.allclose(scanned, decoded @ q.T, atol=1e-4)
    e = u - decoded
    parallel = (e * x).sum(1) ** 2
    assert parallel.mean() < 0.5 * (e**2).sum(1).mean() / 64 * 3
