"""The most similar vectors for every vector of a large collection.

Method: score-aware (anisotropic) quantisation.  A bounded sample fits the leaves of a coarse partition and four-bit
codebooks; every row is assigned and coded.  Leaves are gathered into groups of bounded size.  A query visits the
groups of its ``probes`` best leaves, scans the four-bit codes of those leaves by table lookups, and the best of them
are reranked by exact cosine; the best over all groups remain.

Equal directions are one representative, so a group of copies of any size costs one row of search.  A leaf that
holds too many rows is split again on a sample of its own; one that cannot be split (nearly equal rows) is dealt out
over several groups, all of which its queries visit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from verdigris.llm import quantise as Q
from verdigris.runtime import materialise

DIM = 64
#: Rows the partition and the codebooks are fitted on at most.
SAMPLE_ROWS = 65_536
BOOK_ROWS = 8_192
LEAF_ROWS = 256
MAX_LEAVES = 16_384
#: Leaves above this many times LEAF_ROWS are split again, for at most so many rounds.
HOT_TIMES, HOT_ROUNDS, HOT_SAMPLE = 8, 4, 2_048
GROUP_ROWS = 8_192
UNIT_QUERIES = 32_768
PROBES = 48
#: The error of a scanned score stays within this times the member's residual length, nearly always.  A member is
#: reranked if it may still reach the k-th best score that is sure.
MARGIN = 0.06
#: Queries scanned together.
QUERY_BLOCK = 512


def float_vectors(df: DataFrame, key: str, embedding: str) -> DataFrame:
    """(key, vec) with little-endian float32 bytes of array embeddings; null keys and unusable arrays are left out."""

    def pack(batches):
        for b in batches:
            vec = [np.asarray(v, "<f4").tobytes() if v is not None and len(v) == DIM and None not in v else None for v in b["v"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["key"], pa.array(vec, pa.binary())], ["key", "vec"])

    rows = df.where(F.col(key).isNotNull() & (F.size(embedding) == DIM)).select(F.col(key).alias("key"), F.col(embedding).alias("v"))
    return rows.mapInArrow(pack, "key string, vec binary").where("vec IS NOT NULL")


def usable(vectors: DataFrame) -> DataFrame:
    """(key, vec, direction) of the vectors with DIM finite numbers that are not all zero; one row per key.

    Of several rows of a key the one with the greatest bytes stays (callers choose by time before).
    """

    def check(batches):
        for b in batches:
            keys, raw = b["key"].to_pylist(), b["vec"].to_pylist()
            good = [i for i, v in enumerate(raw) if v is not None and len(v) == 4 * DIM]
            x = np.frombuffer(b"".join(raw[i] for i in good), "<f4").reshape(-1, DIM)
            sound = np.isfinite(x).all(1) & (x != 0).any(1)
            u = Q.unit(x[sound]) + np.float32(0)
            kept = [i for i, s in zip(good, sound) if s]
            yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in kept], pa.string()), pa.array([raw[i] for i in kept], pa.binary()), pa.array([r.tobytes() for r in u], pa.binary())], ["key", "vec", "direction"])

    one = vectors.where("key IS NOT NULL").groupBy("key").agg(F.max("vec").alias("vec"))
    return one.mapInArrow(check, "key string, vec binary, direction binary")


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(-1, DIM)


def _sampled(rows: DataFrame, n: int) -> np.ndarray:
    """At most ``n`` unit vectors, the same ones on every run."""
    got = rows.select("direction").orderBy(F.xxhash64("direction"), "direction").limit(n).toArrow()
    return _matrix(got["direction"]).copy() if got.num_rows else np.zeros((0, DIM), np.float32)


def _leaf_counts(rows: DataFrame, centres: np.ndarray) -> np.ndarray:
    held = rows.sparkSession.sparkContext.broadcast(centres)

    def count(batches):
        total = np.zeros(len(held.value), np.int64)
        for b in batches:
            total += np.bincount(Q.nearest(_matrix(b["direction"]), held.value, 1)[:, 0], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["leaf", "n"])

    out = np.zeros(len(centres), np.int64)
    for r in rows.select("direction").mapInArrow(count, "leaf int, n bigint").groupBy("leaf").agg(F.sum("n").alias("n")).collect():  # one row a leaf
        out[r.leaf] = r.n
    return out


def fit_leaves(rows: DataFrame, n_rows: int, sample: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leaf centroids and how many rows each holds."""
    centres = Q.kmeans(sample, int(min(MAX_LEAVES // 4, max(1, n_rows // LEAF_ROWS), max(1, len(sample) // 16))))
    counts = _leaf_counts(rows, centres)
    spark = rows.sparkSession
    typical = max(LEAF_ROWS, n_rows // len(centres))
    for _ in range(HOT_ROUNDS):
        hot = np.flatnonzero(counts > HOT_TIMES * typical)
        room = MAX_LEAVES - len(centres)
        if not len(hot) or room <= 0:
            break
        held, names = spark.sparkContext.broadcast(centres), hot.tolist()
        share = min(1.0, HOT_SAMPLE * len(hot) / counts[hot].sum())

        def pick(batches):
            for b in batches:
                at = Q.nearest(_matrix(b["direction"]), held.value, 1)[:, 0]
                keep = np.flatnonzero(np.isin(at, names))
                yield pa.RecordBatch.from_arrays([pa.array(at[keep]), b["direction"].take(pa.array(keep))], ["leaf", "direction"])

        some = rows.where((F.xxhash64("direction", F.lit(1)) % 1_000_003 / 1_000_003.0 + 1) / 2 < share).select("direction").mapInArrow(pick, "leaf int, direction binary")
        got = some.orderBy(F.xxhash64("direction")).limit(2 * HOT_SAMPLE * len(names)).toArrow()
        leaf, x = got["leaf"].to_numpy(), _matrix(got["direction"])
        new = [Q.kmeans(x[leaf == h], int(min(64, room, -(-counts[h] // typical)))) for h in names if (leaf == h).sum() > 1]
        before = len(centres)
        gone = [h for h in names if (leaf == h).sum() > 1]
        centres = np.concatenate([np.delete(centres, gone, axis=0), *new])
        counts = _leaf_counts(rows, centres)
        if len(centres) == before:
            break
    return centres, counts


def group_leaves(centres: np.ndarray, counts: np.ndarray, rows: int = GROUP_ROWS) -> tuple[list[np.ndarray], np.ndarray]:
    """Groups of neighbouring leaves of at most ``rows`` rows together, by halving along the widest direction.

    Returns the groups, and for each leaf over how many groups its rows are dealt (1 but for oversized leaves, each
    of which fills groups of its own).
    """
    dealt = np.maximum(1, -(-counts // rows))
    groups, todo = [], [np.arange(len(centres))]
    while todo:
        at = todo.pop()
        if len(at) == 1 or counts[at].sum() <= rows:
            groups += [at] * int(dealt[at[0]] if len(at) == 1 else 1)
            continue
        x = centres[at] - centres[at].mean(0)
        side = x @ np.linalg.svd(x, full_matrices=False)[2][0]
        order = at[np.argsort(side, kind="stable")]
        half = int(np.clip(np.searchsorted(np.cumsum(counts[order]), counts[at].sum() / 2), 1, len(at) - 1))
        todo += [order[:half], order[half:]]
    return groups, dealt


_UNIT = "unit bigint, kind int, vid bigint, direction binary, leaf int, length float, code binary, probes array<int>"


class _Index:
    """What every task needs; its size is bounded by MAX_LEAVES."""

    def __init__(self, centres, books, groups, dealt):
        self.centres, self.books, self.dealt = centres, books, dealt
        self.groups_of = [[] for _ in centres]
        for g, leaves in enumerate(groups):
            for leaf in leaves:
                self.groups_of[leaf].append(g)


def _unit_rows(index, probes, salts, vid, x):
    """Rows of one batch for the search units: as members of one group, and as queries of some groups."""
    top = Q.nearest(x, index.centres, probes)
    leaf = top[:, 0]
    u, length = Q.residuals(x, index.centres, leaf)
    code = Q.pack(Q.choose_codes(u, x, index.books))
    raw = [r.tobytes() for r in x]
    unit, kind, at, probed = [], [], [], []
    for i in range(len(x)):
        homes = index.groups_of[leaf[i]]
        home = homes[vid[i] % len(homes)]
        for s in range(salts[home]):
            unit.append(home << 20 | s)
            kind.append(0)
            at.append(i)
            probed.append(None)
        visits: dict[int, list[int]] = {}
        for t in top[i].tolist():
            for g in index.groups_of[t]:
                visits.setdefault(g, []).append(t)
        for g, leaves in visits.items():
            unit.append(g << 20 | hash(int(vid[i]) * 0x9E3779B97F4A7C15 & 0x7FFFFFFFFFFF) % salts[g])
            kind.append(1)
            at.append(i)
            probed.append(leaves)
    member = [k == 0 for k in kind]
    return pa.RecordBatch.from_arrays(
        [pa.array(unit, pa.int64()), pa.array(kind, pa.int32()), pa.array(vid[at], pa.int64()), pa.array([raw[i] for i in at], pa.binary()), pa.array(leaf[at].astype(np.int32), pa.int32()),
         pa.array([length[i] if m else None for i, m in zip(at, member)], pa.float32()), pa.array([code[i].tobytes() if m else None for i, m in zip(at, member)], pa.binary()), pa.array(probed, pa.list_(pa.int32()))],
        ["unit", "kind", "vid", "direction", "leaf", "length", "code", "probes"],
    )


def search_block(index, members: dict, q_vid: np.ndarray, q: np.ndarray, probes: list, k: int):
    """The ``k`` best other members of a unit for each query: row numbers of queries and members, and cosines."""
    table = Q.tables(q, index.books)
    wanted: dict[int, list[int]] = {}
    opening: dict[int, list[int]] = {}
    for i, leaves in enumerate(probes):
        leaves = [leaf for leaf in leaves if leaf in members["places"]]
        for leaf in leaves:
            wanted.setdefault(leaf, []).append(i)
        # the best leaf with enough rows tells what a good score is
        for leaf in leaves:
            low, high = members["places"][leaf]
            if high - low > k:
                opening.setdefault(leaf, []).append(i)
                break

    def approx(leaf, who):
        low, high = members["places"][leaf]
        mine = table if len(who) == len(q) else table[:, :, who]
        return Q.scan(mine, members["codes"][low:high]).T * members["length"][low:high] + (q[who] @ index.centres[leaf])[:, None]

    floor = np.full(len(q), -np.inf, np.float32)
    for leaf, who in opening.items():
        s = approx(leaf, who)
        low, high = members["places"][leaf]
        sure = s - MARGIN * members["length"][low:high]
        floor[who] = np.partition(sure, sure.shape[1] - k, axis=1)[:, sure.shape[1] - k]
    found = []
    for leaf, who in wanted.items():
        s, who = approx(leaf, who), np.asarray(who)
        low, high = members["places"][leaf]
        a, m = np.nonzero(s + MARGIN * members["length"][low:high] >= floor[who][:, None])
        found.append((who[a], m + low))
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    qi, mi = (np.concatenate(c) for c in zip(*found))
    keep = q_vid[qi] != members["vid"][mi]
    qi, mi = qi[keep], mi[keep]
    cos = np.empty(len(qi))
    for i in range(0, len(qi), 65536):
        cos[i : i + 65536] = np.einsum("nd,nd->n", q[qi[i : i + 65536]].astype(np.float64), members["x"][mi[i : i + 65536]].astype(np.float64))
    order = np.lexsort((-cos, qi))
    qi, mi, cos = qi[order], mi[order], cos[order]
    first = np.searchsorted(qi, np.arange(len(q)))
    keep = np.arange(len(qi)) - first[qi] < k
    return qi[keep], mi[keep], cos[keep]


def _members(parts: list[pa.RecordBatch]) -> dict:
    t = pa.Table.from_batches(parts).combine_chunks()
    leaf = t["leaf"].to_numpy()
    order = np.argsort(leaf, kind="stable")
    leaf = leaf[order]
    starts = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1]]))
    ends = np.append(starts[1:], len(leaf))
    code = np.frombuffer(b"".join(t["code"].to_pylist()), np.uint8).reshape(len(leaf), -1)[order]
    return {"vid": t["vid"].to_numpy()[order], "x": _matrix(t["direction"])[order], "length": t["length"].to_numpy()[order], "codes": Q.unpack(code), "places": {int(leaf[a]): (int(a), int(b)) for a, b in zip(starts, ends)}}


def knn(vectors: DataFrame, k: int = 5, probes: int = PROBES) -> DataFrame:
    """(vid, nbr, cosine): about the ``k`` nearest other rows of each of (vid, direction), directions being distinct.

    A query's rows with equal cosine are ordered later; no row of the collection is left out of the index.
    """
    spark = vectors.sparkSession
    out = "vid bigint, nbr bigint, cosine double"
    n_rows = vectors.count()
    if n_rows < 2:
        return spark.createDataFrame([], out)
    sample = _sampled(vectors, SAMPLE_ROWS)
    centres, counts = fit_leaves(vectors, n_rows, sample)
    some = sample[:BOOK_ROWS]
    u, length = Q.residuals(some, centres, Q.nearest(some, centres, 1)[:, 0])
    books = Q.fit_books(u[length > 1e-6] if (length > 1e-6).any() else u, some[length > 1e-6] if (length > 1e-6).any() else some)
    groups, dealt = group_leaves(centres, counts)
    index = spark.sparkContext.broadcast(_Index(centres, books, groups, dealt))

    def visits(batches):
        total = np.zeros(len(groups), np.int64)
        for b in batches:
            top = Q.nearest(_matrix(b["direction"]), index.value.centres, probes)
            for row in top:
                for g in {g for t in row.tolist() for g in index.value.groups_of[t]}:
                    total[g] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["g", "n"])

    n_queries = np.zeros(len(groups), np.int64)
    for r in vectors.select("direction").mapInArrow(visits, "g bigint, n bigint").groupBy("g").agg(F.sum("n").alias("n")).collect():  # one row a group
        n_queries[r.g] = r.n
    salts = np.maximum(1, -(-n_queries // UNIT_QUERIES)).tolist()

    def spread(batches):
        for b in batches:
            x, vid = _matrix(b["direction"]), b["vid"].to_numpy()
            for i in range(0, len(x), 2048):
                yield _unit_rows(index.value, probes, salts, vid[i : i + 2048], x[i : i + 2048])

    def search(batches):
        unit, parts, members = None, [], None
        for b in batches:
            units, kinds = b["unit"].to_numpy(), b["kind"].to_numpy()
            edges = np.flatnonzero((units[1:] != units[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for low, high in zip(np.append(0, edges), np.append(edges, len(units))):
                if units[low] != unit:
                    unit, parts, members = units[low], [], None
                piece = b.slice(low, high - low)
                if kinds[low] == 0:
                    parts.append(piece)
                    continue
                if not parts:
                    continue
                members = members or _members(parts)
                # queries of one leaf stand together, so that a block of them wants few leaves
                piece = piece.take(pa.array(np.argsort(piece["leaf"].to_numpy(), kind="stable")))
                for i in range(0, piece.num_rows, QUERY_BLOCK):
                    block = piece.slice(i, QUERY_BLOCK)
                    q_vid = block["vid"].to_numpy()
                    qi, mi, cos = search_block(index.value, members, q_vid, _matrix(block["direction"]), block["probes"].to_pylist(), k + 1)
                    yield pa.RecordBatch.from_arrays([pa.array(q_vid[qi]), pa.array(members["vid"][mi]), pa.array(np.minimum(cos, 1.0))], ["vid", "nbr", "cosine"])

    units = vectors.select("vid", "direction").mapInArrow(spread, _UNIT).repartition(max(3 * spark.sparkContext.defaultParallelism, sum(salts) // 4), "unit")
    near = units.sortWithinPartitions("unit", "kind").mapInArrow(search, out)
    best = F.row_number().over(W.partitionBy("vid").orderBy(F.desc("cosine"), "nbr"))
    return near.withColumn("rn", best).where(F.col("rn") <= k + 1).drop("rn")


def most_similar(vectors: DataFrame, k: int = 5, probes: int = PROBES) -> DataFrame:
    """(key, rank, neighbour, cosine): the ``k`` most similar other keys of every usable (key, vec).

    Equal cosines are ordered by key.  Vectors that are null, of another length, not finite or all zero are left out.
    """
    rows = materialise(usable(vectors), "vectors")
    numbered = rows.groupBy("direction").agg(F.count("*").alias("n")).withColumn("vid", F.monotonically_increasing_id())
    reps = materialise(numbered.select("vid", "direction", "n"), "directions")
    near = materialise(knn(reps.select("vid", "direction"), k, probes), "near")
    members = materialise(rows.join(reps.select("vid", "direction"), "direction").select("vid", "key"), "members")
    first = F.row_number().over(W.partitionBy("vid").orderBy("key"))
    few = members.withColumn("rn", first).where(F.col("rn") <= k + 1).drop("rn")  # enough of any group of copies
    own = few.select("vid", F.lit(1.0).alias("cosine"), F.col("key").alias("neighbour"))
    theirs = near.join(few.withColumnRenamed("vid", "nbr"), "nbr").select("vid", "cosine", F.col("key").alias("neighbour"))
    lists = own.unionByName(theirs).groupBy("vid").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("less"), "neighbour"))), 1, (k + 1) * (k + 2)).alias("near"))
    ranked = members.join(lists, "vid").select("key", F.posexplode(F.slice(F.filter("near", lambda s: s["neighbour"] != F.col("key")), 1, k)).alias("i", "s"))
    return ranked.select("key", (F.col("i") + 1).alias("rank"), F.col("s.neighbour").alias("neighbour"), (-F.col("s.less")).alias("cosine"))
