"""Records that share most of their content, across collections too large for pairwise comparison.

Method: an LSH forest.  Each of several orders sorts the records by a signature of min-hashes of their word shingles;
records whose common prefix reaches the depth of their region are neighbours there and candidates.  The depth adapts
to the region: it starts at two min-hashes, and the records of a region that more than REGION of them share are sorted
anew by four, then by six min-hashes.  Deeper orders are less likely to bring a pair together, so there are as many
more of them as keep its chance (:func:`orders_needed`).  What is still crowded at the last depth is nearly alike and
is scanned in whole, block against block, so no size loses a pair.  Candidates pass a sketch estimate well below the
threshold and are then held against the exact shingle sets.

Records with equal shingle sets are one representative throughout.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.batches import whole_groups
from verdigris.llm.components import components
from verdigris.runtime import broadcast_if_small, materialise

#: Min-hashes of a common prefix that makes neighbours, at first and in regions that are crowded.
DEPTHS = (2, 4, 6)
#: The chance to miss a pair right at the threshold in all orders of one depth.
MISS = 0.0008
REGION = 2048
#: Rows of a block in a region crowded at the last depth; larger blocks send each row less often, smaller ones spread the work.
BLOCK = 16_384
#: A sketch keeps two bits of each of so many min-hashes, in WORDS 64-bit words.
SKETCH = 96
WORDS = SKETCH * 2 // 64
#: How far the estimated similarity of a candidate may lie below the threshold, in standard deviations of the sketch.
SIGMAS = 4.0
#: Bytes kept of a shingle's hash: two shingles of a pair of records are mistaken for each other about once in 10^8 pairs.
HASH_BYTES = 5
_TOKEN = re.compile(rb"[a-z0-9_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD_BITS = np.uint64(0x5555555555555555)


def _hashed(tokens: list[bytes]) -> np.ndarray:
    import xxhash

    seen: dict[bytes, int] = {}
    out = np.empty(len(tokens), np.uint64)
    for i, t in enumerate(tokens):
        h = seen.get(t)
        if h is None:
            h = seen[t] = xxhash.xxh3_64_intdigest(t)
        out[i] = h
    return out


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``width`` tokens; tokens are runs of [a-z0-9_] in lower case."""
    words = _hashed(_TOKEN.findall(text.lower().encode("utf-8", "replace")))
    if len(words) < width:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(words) - width + 1, np.uint64)
    for i in range(width):
        h = _scramble(h * _MIX + words[i : len(words) - width + 1 + i] + np.uint64(i + 1))
    return np.unique(h)


def orders_needed(threshold: float, depth: int) -> int:
    """How many orders of ``depth`` min-hashes bring a pair of that similarity together in one, but for MISS."""
    return max(1, int(np.ceil(np.log(MISS) / np.log1p(-min(threshold, 0.999999) ** depth))))


@functools.lru_cache(maxsize=16)
def hash_functions(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and offsets; the first ones of a seed do not depend on ``n``."""
    draw = lambda which: np.random.default_rng([seed, which]).integers(0, 1 << 62, n, dtype=np.uint64)
    return draw(1) | np.uint64(1), draw(2)


def min_hashes(h: np.ndarray, seed: int = 0, n: int = SKETCH) -> np.ndarray:
    """The smallest value of the shingles under each of ``n`` hash functions (upper 32 bits)."""
    a, b = hash_functions(seed, n)
    out = np.full(n, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(h), 1024):
        x = h[i : i + 1024]
        v = ((x[None, :] * a[:, None] + b[:, None]) >> np.uint64(32)).astype(np.uint32)
        np.minimum(out, v.min(1), out=out)
    return out


def sketch_of(m: np.ndarray) -> np.ndarray:
    """Two bits of each min-hash, as WORDS words."""
    two = (m & 3).astype(np.uint64).reshape(WORDS, 32)
    return (two << (2 * np.arange(32, dtype=np.uint64))).sum(1, dtype=np.uint64)


def least_agreement(threshold: float) -> int:
    """How many of the two-bit places must agree; unequal min-hashes agree in one of four."""
    n = WORDS * 32
    p = threshold + (1 - threshold) / 4
    return max(0, int(np.floor(n * p - SIGMAS * np.sqrt(n * p * (1 - p)))))


def agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many places the sketches of two lists (rows, WORDS) agree, row by row."""
    d = x ^ y
    return WORDS * 32 - np.bitwise_count((d | (d >> np.uint64(1))) & _ODD_BITS).sum(1, dtype=np.int64)


def _agreement_with(x: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """In how many places one sketch agrees with each of many, given as (WORDS, rows)."""
    apart = np.zeros(columns.shape[1], np.uint8)
    for w in range(WORDS):
        d = columns[w] ^ x[w]
        d |= d >> np.uint64(1)
        d &= _ODD_BITS
        apart += np.bitwise_count(d)
    return WORDS * 32 - apart.astype(np.int64)


def pack_set(h: np.ndarray) -> bytes:
    """The leading HASH_BYTES bytes of sorted hashes."""
    return h.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].tobytes()


def unpack_set(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // HASH_BYTES, 8), np.uint8)
    out[:, :HASH_BYTES] = np.frombuffer(b, np.uint8).reshape(-1, HASH_BYTES)
    return out.view(">u8").ravel().astype(np.uint64)


_SET = "rec string, digest binary, shingles binary, sig binary, " + ", ".join(f"s{i} bigint" for i in range(WORDS))
_WORDS = [f"s{i}" for i in range(WORDS)]


def shingle_sets(records: DataFrame, width: int, orders: int) -> DataFrame:
    """(rec, digest, shingles, sig, s0...) of the records with at least ``width`` tokens; ``digest`` stands for the set,
    ``sig`` holds the min-hashes of the first ``orders`` orders, the words are the sketch."""
    kept = orders * DEPTHS[0]

    def run(batches):
        for b in batches:
            recs, digests, sets, sigs, words = [], [], [], [], []
            for rec, text in zip(b["rec"].to_pylist(), b["text"].to_pylist()):
                h = shingles(text, width)
                if not len(h):
                    continue
                m = min_hashes(h, 0, max(SKETCH, kept))
                recs.append(rec)
                digests.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
                sets.append(pack_set(h))
                sigs.append(m[:kept].astype(">u4").tobytes())
                words.append(sketch_of(m[:SKETCH]).view(np.int64))
            words = np.array(words, np.int64).reshape(-1, WORDS)
            yield pa.RecordBatch.from_arrays([pa.array(recs, pa.string()), *(pa.array(x, pa.binary()) for x in (digests, sets, sigs)), *(pa.array(words[:, i]) for i in range(WORDS))], ["rec", "digest", "shingles", "sig", *_WORDS])

    return records.where("rec IS NOT NULL AND text IS NOT NULL").select("rec", "text").mapInArrow(run, _SET)


def _words(table) -> np.ndarray:
    return np.stack([table[w].to_numpy().view(np.uint64) for w in _WORDS], axis=1)


def _pair_batch(vids: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """Distinct pairs in order of the two numbers."""
    pairs = np.unique(np.stack([np.minimum(vids[i], vids[j]), np.maximum(vids[i], vids[j])], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _region_pairs(least: int):
    """Close pairs of every region; rows come sorted by region, regions are bounded, and many are done at once."""

    def run(batches):
        for table in whole_groups(batches, ["region"], 32768):
            region, vids, words = table["region"].to_numpy(), table["vid"].to_numpy(), _words(table)
            starts = np.flatnonzero(np.concatenate([[True], region[1:] != region[:-1]]))
            size = np.diff(np.append(starts, len(region)))
            left = np.repeat(starts + size, size) - np.arange(len(region)) - 1  # rows of the region after this one
            at, apart, found = np.flatnonzero(left > 0), 1, []
            while len(at):
                close = agreement(words[at], words[at + apart]) >= least
                found.append(np.stack([at[close], at[close] + apart]))
                apart += 1
                at = at[left[at] >= apart]
            if found:
                i, j = np.concatenate(found, axis=1)
                differ = vids[i] != vids[j]
                yield _pair_batch(vids, i[differ], j[differ])

    return run


def _block_pairs(least: int):
    """Close pairs between the two blocks of each unit (``side`` 0 and 1), or inside a block that is alone in its unit."""

    def run(batches):
        for table in whole_groups(batches, ["region"], 1):
            region, vids, words, side = table["region"].to_numpy(), table["vid"].to_numpy(), _words(table), table["side"].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], region[1:] != region[:-1]]))
            for start, end in zip(starts, np.append(starts[1:], len(region))):
                left, right = start + np.flatnonzero(side[start:end] == 0), start + np.flatnonzero(side[start:end] == 1)
                alone = not len(right)
                facing = np.ascontiguousarray(words[left if alone else right].T)
                found, n = [], 0
                for k, i in enumerate(left):
                    after = k + 1 if alone else 0
                    j = after + np.flatnonzero(_agreement_with(words[i], facing[:, after:]) >= least)
                    if len(j):
                        j = (left if alone else right)[j]
                        found.append(np.stack([np.full(len(j), i), j]))
                        n += len(j)
                    if n >= 1 << 18:
                        yield _pair_batch(vids, *np.concatenate(found, axis=1))
                        found, n = [], 0
                if n:
                    yield _pair_batch(vids, *np.concatenate(found, axis=1))

    return run


def _ordered(rows: DataFrame, orders: int, depth: int) -> DataFrame:
    """A row of (vid, sketch, region) for each order; ``region`` stands for the order and the prefix."""
    step = 4 * depth
    prefixes = F.posexplode(F.array(*[F.substring("sig", 1 + step * t, step) for t in range(orders)])).alias("order", "prefix")
    return rows.select("vid", *_WORDS, prefixes).select("vid", *_WORDS, F.xxhash64("order", "prefix", F.lit(depth)).alias("region"))


def _signed_anew(rows: DataFrame, sets: DataFrame, depth: int, orders: int) -> DataFrame:
    """(vid, sketch, sig) with the signatures of deeper orders, from the exact sets."""

    def run(batches):
        for b in batches:
            sig = [min_hashes(unpack_set(x), depth, orders * depth).astype(">u4").tobytes() for x in b["shingles"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["vid"], *(b[w] for w in _WORDS), pa.array(sig, pa.binary())], ["vid", *_WORDS, "sig"])

    given = rows.join(sets.select(F.col("rec").alias("first"), "shingles"), "first").select("vid", *_WORDS, "shingles")
    return given.mapInArrow(run, "vid bigint, " + ", ".join(f"{w} bigint" for w in _WORDS) + ", sig binary")


def forest_candidates(reps: DataFrame, sets: DataFrame, threshold: float, region: int = REGION, block: int = BLOCK) -> DataFrame:
    """(a, b), a < b: pairs of (vid, first, sig, sketch) rows that are neighbours in some order and whose sketches are close.

    ``sets`` (rec, shingles) has the set of each row's ``first`` record.
    """
    least = least_agreement(threshold)
    rows, found = reps, []
    for depth in DEPTHS:
        orders = orders_needed(threshold, depth)
        if depth != DEPTHS[0]:
            rows = materialise(_signed_anew(rows, sets, depth, orders), "signed-anew")
        keyed = _ordered(rows, orders, depth)
        crowded = materialise(keyed.groupBy("region").count().where(F.col("count") > region), "crowded")
        if crowded.isEmpty():
            found.append(_pairs_by_region(keyed, _region_pairs(least)))
            break
        hot = broadcast_if_small(crowded)
        found.append(_pairs_by_region(keyed.join(hot, "region", "left_anti"), _region_pairs(least)))
        within = keyed.join(hot, "region")
        if depth == DEPTHS[-1]:
            found.append(_pairs_by_region(_blocks(within, block), _block_pairs(least)))
        else:  # the rows of crowded regions are sorted anew, deeper and in more orders
            rows = reps.select("vid", "first", *_WORDS).join(within.select("vid").distinct(), "vid", "left_semi")
    return functools.reduce(DataFrame.unionByName, found).distinct()


def _blocks(within: DataFrame, block: int) -> DataFrame:
    """Units of two blocks of a region (``side`` 0 and 1), or of one block alone; each block meets itself and every other one."""
    blocks = within.withColumn("n", F.ceil(F.col("count") / block)).withColumn("mine", F.pmod(F.xxhash64("vid"), "n"))
    met = blocks.select("vid", *_WORDS, "region", "mine", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    unit = F.xxhash64("region", F.least("mine", "other"), F.greatest("mine", "other")).alias("region")
    return met.select("vid", *_WORDS, unit, (F.col("mine") > F.col("other")).cast("int").alias("side"))


def _pairs_by_region(rows: DataFrame, run) -> DataFrame:
    return rows.repartition("region").sortWithinPartitions("region").mapInArrow(run, "a bigint, b bigint")


def verified(candidates: DataFrame, sets: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """(a, b, jaccard) of the candidates whose exact similarity reaches ``threshold``."""

    def check(batches):
        for b in batches:
            keep, value = [], []
            for i, (x, y) in enumerate(zip(b["x"].to_pylist(), b["y"].to_pylist())):
                p, q = unpack_set(x), unpack_set(y)
                both = len(np.intersect1d(p, q, assume_unique=True))
                total = len(p) + len(q) - both
                if both >= threshold * total - 1e-9:
                    keep.append(i)
                    value.append(both / total)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b["a"].take(at), b["b"].take(at), pa.array(value, pa.float64())], ["a", "b", "jaccard"])

    candidates = materialise(candidates, "candidates")
    named = candidates.select(F.explode(F.array("a", "b")).alias("vid")).distinct().join(reps.select("vid", "first"), "vid")
    # only sets of candidates travel; while the candidates are few the scan itself is filtered by them
    some = sets.select(F.col("rec").alias("first"), "shingles").join(broadcast_if_small(materialise(named, "named")), "first").select("vid", "shingles")
    pairs = candidates.join(some.select(F.col("vid").alias("a"), F.col("shingles").alias("x")), "a").join(some.select(F.col("vid").alias("b"), F.col("shingles").alias("y")), "b")
    return pairs.select("a", "b", "x", "y").mapInArrow(check, "a bigint, b bigint, jaccard double")


def near_duplicates(records: DataFrame, width: int = 5, threshold: float = 0.8, region: int = REGION, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Links between representatives, and which representative stands for each record.

    ``records`` is (rec, text) with distinct recs.  Returns (a, b, jaccard), a < b, and (rec, vid).  Records without
    text or with fewer than ``width`` tokens are in neither.  Extra columns are ignored.
    """
    full = materialise(shingle_sets(records, width, orders_needed(threshold, DEPTHS[0])), "shingles")
    # the numbering is made once and written, so every later reader sees the same
    one = full.groupBy("digest", "sig", *_WORDS).agg(F.min("rec").alias("first"))
    reps = materialise(one.withColumn("vid", F.monotonically_increasing_id()), "representatives")
    members = full.select("rec", "digest").join(reps.select("digest", "vid"), "digest").select("rec", "vid")
    links = verified(forest_candidates(reps, full, threshold, region, block), full, reps, threshold)
    return materialise(links, "near-links"), materialise(members, "near-members")


def all_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """(rec_a, rec_b): every pair of records, copies included; the output, not the work, is quadratic in copies."""
    a, b = members.select("vid", F.col("rec").alias("r")), members.select("vid", F.col("rec").alias("s"))
    copied = members.groupBy("vid").count().where("count > 1").select("vid")
    inside = a.join(copied, "vid", "left_semi").join(b, "vid").where("r < s").select("r", "s")
    across = links.select("a", "b").join(a.withColumnRenamed("vid", "a"), "a").join(b.withColumnRenamed("vid", "b"), "b").select("r", "s")
    return inside.unionByName(across).select(F.least("r", "s").alias("rec_a"), F.greatest("r", "s").alias("rec_b"))


def classes(links: DataFrame, members: DataFrame) -> DataFrame:
    """(rec, class_id, n_links): one row per record; ``class_id`` is the smallest rec of its class, ``n_links`` counts
    the different texts its text is linked to."""
    found = components(links.select("a", "b"))
    degree = links.select(F.explode(F.array("a", "b")).alias("vid")).groupBy("vid").agg(F.count("*").alias("n_links"))
    rooted = members.join(found.withColumnRenamed("node", "vid"), "vid", "left").withColumn("root", F.coalesce("root", "vid"))
    named = rooted.groupBy("root").agg(F.min("rec").alias("class_id"))
    return rooted.join(named, "root").join(degree, "vid", "left").select("rec", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
