import datetime as dt
import random

from verdigris.operators import snapshot_diff as S

T0 = dt.datetime(2024, 1, 1)
M = "store string, version string, uid string, sha string, delivered_at timestamp_ntz, h bigint, path string, snap int"
V = "store string, version string, seq int, parent string, created timestamp_ntz, source string, node bigint"


def tables(spark, manifest, versions):
    """Rows with extra columns whose names clash with those used inside."""
    m = spark.createDataFrame([(*r, 1, "x", 9) for r in manifest], M)
    return m, spark.createDataFrame([(s, v, q, None, T0, None, 3) for s, v, q in versions], V)


def changes(spark, manifest, versions):
    return {(r.store, r.version, r.uid, r.change) for r in S.snapshot_changes(*tables(spark, manifest, versions)).collect()}


def test_spellings_last_delivery_and_absence(spark):
    later = T0 + dt.timedelta(hours=1)
    manifest = [
        ("s", "a", "x/f.py", "00AB", T0), ("s", "a", "x/g.py", "01", T0), ("s", "a", "x/h.py", "02", T0), ("s", "a", None, "07", T0), ("s", "a", "x/k.py", "09", None),
        ("s", "b", ".\\x\\f.py", "0xab", T0), ("s", "b", "x/./g.py", "03", T0), ("s", "b", "x//g.py", "04", later), ("s", "b", "x/h.py", "02", T0), ("s", "b", "x/h.py", None, later), ("s", "b", "x/k.py", "9", T0),
        ("s", "b", "y/../new.py", "05", T0), ("s", "b", "y/../new.py", "05", T0), ("s", "never", "q.py", "1", T0),
    ]
    got = changes(spark, manifest, [("s", "a", 1), ("s", "a", 1), ("s", "b", 5), ("s", "announced", 3)])
    assert got == {("s", "b", "x/g.py", "modified"), ("s", "b", "x/h.py", "removed"), ("s", "b", "new.py", "added")}


def test_empty_tables_and_single_snapshots(spark):
    assert changes(spark, [], []) == set()
    assert changes(spark, [("s", "a", "f", "1", T0)], [("s", "a", 1)]) == set()
    # a snapshot that only says what is gone
    got = changes(spark, [("s", "a", "f", "1", T0), ("s", "b", "f", None, T0)], [("s", "a", 1), ("s", "b", 2)])
    assert got == {("s", "b", "f", "removed")}


def test_against_brute_force_with_a_dominant_store(spark, monkeypatch):
    monkeypatch.setattr(S, "LEAF_ROWS", 4)  # a deep tree on a small table
    rng = random.Random(5)
    manifest, versions, want = [], [], set()
    for store, paths, snaps in (("big", 400, 6), ("small", 9, 3), ("one", 5, 1)):
        state = {f"d{i % 7}/f{i}.py": rng.randint(1, 50) for i in range(paths)}
        before = None
        for v in range(snaps):
            versions.append((store, f"v{v}", v))
            for p in list(state):
                roll = rng.random()
                if roll < 0.03:
                    del state[p]
                elif roll < 0.06:
                    state[p] = rng.randint(1, 50)
            state[f"new{v}.py"] = v + 1
            manifest += [(store, f"v{v}", p, f"{s:040x}", T0) for p, s in state.items()]
            if before is not None:
                for p in before.keys() | state.keys():
                    if before.get(p) != state.get(p):
                        want.add((store, f"v{v}", p, "added" if p not in before else "removed" if p not in state else "modified"))
            before = dict(state)
    assert changes(spark, manifest, versions) == want
    counts = {(r.store, r.version): (r.added, r.removed, r.modified, r.unchanged) for r in S.snapshot_counts(*tables(spark, manifest, versions)).collect()}
    assert sum(sum(c[:3]) for c in counts.values()) == len(want) and ("one", "v0") not in counts
