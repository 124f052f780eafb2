"""Encoding whole texts with a public byte-level BPE tokenizer.

Method: a text longer than a chunk is cut into overlapping chunks.  Each is pre-tokenised on its own; where two
neighbours have a pre-token boundary at the same place of their overlap, their scans agree from there on (a scan
looks only forward), so the text can be cut there.  The pieces between such cuts are encoded in parallel and their
ids strung together.  A text with an overlap without a common boundary (an unbroken run longer than the overlap)
is encoded as a whole.  Decoding concatenates the bytes of the ids.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

DEFAULT_DIR = "/opt/tokenizers"
DEFAULT_NAME = "byte_bpe_50k"
CHUNK_CHARS = 16384
OVERLAP_CHARS = 1024
# Fixed value: the pre-token pattern of the public vocabulary.
PRE_TOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The last characters of a chunk whose pre-tokens may depend on what follows (the longest contraction).
BLIND = 4
#: Longer pre-tokens go through the merge queue of the second library: the first one's time is quadratic there.
LONG_PRE_TOKEN = 256
_PRE_TOKEN = regex.compile(PRE_TOKEN)
_LONG_RUN = regex.compile(rf"\p{{L}}{{{LONG_PRE_TOKEN},}}+|\p{{N}}{{{LONG_PRE_TOKEN},}}+|[^\s\p{{L}}\p{{N}}]{{{LONG_PRE_TOKEN},}}+|\s{{{LONG_PRE_TOKEN},}}+")


@functools.lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@functools.lru_cache(maxsize=4)
def encoder(folder: str = DEFAULT_DIR, name: str = DEFAULT_NAME):
    """text -> ids without special tokens; loaded once in each Python worker."""
    import tiktoken

    fast = tiktoken.Encoding(name, pat_str=PRE_TOKEN, mergeable_ranks=load_ranks(f"{folder}/{name}.tiktoken"), special_tokens={})

    @functools.lru_cache(maxsize=1)
    def queued():
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(f"{folder}/{name}.json")
        t.encode_special_tokens = True
        return t

    def encode_text(text: str) -> list[int]:
        if len(text) >= LONG_PRE_TOKEN and _LONG_RUN.search(text):
            return queued().encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode_text


def decode_bytes(ids, folder: str = DEFAULT_DIR, name: str = DEFAULT_NAME) -> bytes:
    """The bytes of the ids, strung together."""
    return b"".join(map(_tokens(folder, name).__getitem__, ids))


@functools.lru_cache(maxsize=4)
def _tokens(folder: str, name: str) -> dict[int, bytes]:
    return {rank: token for token, rank in load_ranks(f"{folder}/{name}.tiktoken").items()}


def _id_lists(lists) -> pa.Array:
    return pa.array(lists, pa.list_(pa.int32()))


def _encode_batches(folder, name, text_at, out_names):
    def run(batches):
        enc = encoder(folder, name)
        for b in batches:
            ids = _id_lists([enc(t) if t else [] for t in b.column(text_at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns) if i != text_at), ids], out_names)

    return run


def chunk_boundaries(text: str, chunk: int, overlap: int, last: bool) -> tuple[list[int], list[int]]:
    """Pre-token boundaries in the head of a chunk, and in its tail relative to where the next chunk starts."""
    head, tail, sure = [], [], len(text) if last else len(text) - BLIND
    for m in _PRE_TOKEN.finditer(text):
        at = m.start()
        if at <= overlap:
            head.append(at)
        if chunk <= at <= sure:
            tail.append(at - chunk)
    return head, tail


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = DEFAULT_DIR, name: str = DEFAULT_NAME, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, keep..., ids) for every row; the ids of an empty or null text are an empty list.

    Rows with a null or repeated key are encoded one by one like any other.  Columns not named are left out.
    """
    if not BLIND < overlap < chunk:
        raise ValueError("needs overlap < chunk, and an overlap longer than a contraction")
    carried = [f"keep{i}" for i in range(len(keep))]
    rows = docs.select(F.col(key).alias("k"), *[F.col(c).alias(a) for c, a in zip(keep, carried)], F.col(text).alias("t"))
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    fixed = ["k", *carried]
    short = rows.where(f"t IS NULL OR char_length(t) <= {chunk}").mapInArrow(_encode_batches(folder, name, len(fixed), [*fixed, "ids"]), f"{kinds}ids array<int>")
    # a long text is known by its row, as keys may repeat
    long = rows.where(f"char_length(t) > {chunk}").withColumn("r", F.monotonically_increasing_id())
    # linear cutting: the chunks follow each other, then each gets the start of its successor
    parts = long.select(*fixed, "r", F.regexp_extract_all("t", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0)).alias("c"))
    parts = parts.select(*fixed, "r", F.posexplode(F.transform("c", lambda x, i: F.struct(x.alias("own"), F.coalesce(F.left(F.get("c", i + 1), F.lit(overlap)), F.lit("")).alias("next"), (i == F.size("c") - 1).alias("last")))).alias("i", "x")).select(*fixed, "r", "i", "x.*")
    parts = parts.repartition("r", "i")

    def scan(batches):
        for b in batches:
            heads, tails = [], []
            for own, nxt, last in zip(b["own"].to_pylist(), b["next"].to_pylist(), b["last"].to_pylist()):
                head, tail = chunk_boundaries(own + nxt, chunk, overlap, last or len(nxt) < overlap)
                heads.append(head)
                tails.append(tail)
            yield pa.RecordBatch.from_arrays([*b.columns, _id_lists(heads), _id_lists(tails)], [*b.schema.names, "head", "tail"])

    scanned = parts.mapInArrow(scan, f"{kinds}r bigint, i int, own string, next string, last boolean, head array<int>, tail array<int>")
    order = W.partitionBy("r").orderBy("i")
    synced = scanned.withColumn("upto", F.array_min(F.array_intersect("tail", F.lead("head").over(order)))).withColumn("from", F.coalesce(F.lag("upto").over(order), F.lit(0)))
    synced = synced.withColumn("broken", F.max(F.col("upto").isNull() & ~F.col("last")).over(W.partitionBy("r")))
    whole = F.concat("own", F.left("next", F.coalesce("upto", F.lit(0))))
    pieces = synced.where("NOT broken").select(*fixed, "r", "i", F.substring(whole, F.col("from") + 1, F.lit(2 * chunk)).alias("t"))
    first = [F.first(c).alias(c) for c in fixed]
    joined = synced.where("broken").groupBy("r").agg(*first, F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "own"))), lambda s: s["own"]), "").alias("t")).select(*fixed, "r", F.lit(0).alias("i"), "t")
    coded = pieces.unionByName(joined).mapInArrow(_encode_batches(folder, name, len(fixed) + 2, [*fixed, "r", "i", "ids"]), f"{kinds}r bigint, i int, ids array<int>")
    strung = coded.groupBy("r").agg(*first, F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "ids"))), lambda s: s["ids"])).alias("ids"))
    return short.unionByName(strung.drop("r")).select(F.col("k").alias(key), *[F.col(a).alias(c) for c, a in zip(keep, carried)], "ids")


def round_trip(docs: DataFrame, key: str = "doc_id", folder: str = DEFAULT_DIR, name: str = DEFAULT_NAME) -> DataFrame:
    """(key, n_tokens, same): whether decoding a text's ids gives its bytes back (null counts as empty).

    The texts' hashes travel with the ids, so nothing is joined.
    """
    kind = docs.schema[key].dataType.simpleString()
    coded = encode(docs.select(key, "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha")), key, folder=folder, name=name, keep=("sha",))

    def check(batches):
        for b in batches:
            ids = b["ids"].to_pylist()
            same = [hashlib.sha256(decode_bytes(x, folder, name)).hexdigest() == sha for x, sha in zip(ids, b["sha"].to_pylist())]
            yield pa.RecordBatch.from_arrays([b[key], pa.array([len(x) for x in ids], pa.int32()), pa.array(same)], [key, "n_tokens", "same"])

    return coded.select(key, "ids", "sha").mapInArrow(check, f"`{key}` {kind}, n_tokens int, same boolean")
