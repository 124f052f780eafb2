"""An encoder whose parameters lie in a folder: token vectors, pooled and normalised."""

from __future__ import annotations

import functools
import hashlib
import os
from dataclasses import dataclass

import numpy as np

#: Texts pooled together; short ones are batched, so a long one never pads them.
BATCH_TOKENS = 1 << 16


@functools.lru_cache(maxsize=2)
def _loaded(folder: str, revision: str):
    """Tokenizer and float32 token vectors, loaded once in each Python worker and checked against the revision."""
    from tokenizers import Tokenizer

    path = os.path.join(folder, "vectors.npy")
    with open(path, "rb") as f:
        found = hashlib.file_digest(f, "sha256").hexdigest()
    if revision and not found.startswith(revision):
        raise ValueError(f"{path} is of revision {found[:12]}, not {revision}")
    return Tokenizer.from_file(os.path.join(folder, "tokenizer.json")), np.ascontiguousarray(np.load(path), np.float32)


@dataclass(frozen=True)
class FolderEncoder:
    """Mean of the vectors of a text's tokens at length 1; a text without tokens is zero.

    The folder, the same on every machine, holds ``tokenizer.json`` and ``vectors.npy`` (a row for each token id).  Only
    names travel to the workers; the parameters are loaded there at first use.  ``revision`` is the beginning of the
    SHA-256 of the vectors and becomes part of the cache's keys, as does the length limit in tokens.
    """

    folder: str
    revision: str = ""
    max_length: int = 1024

    @property
    def name(self) -> str:
        return f"folder:{os.path.basename(self.folder.rstrip('/'))}:{self.revision}"

    def encode(self, texts: list[str]) -> np.ndarray:
        tokenizer, vectors = _loaded(self.folder, self.revision)
        ids = [np.array(e.ids[: self.max_length], np.int64) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
        out = np.zeros((len(texts), vectors.shape[1]), np.float32)
        order, at = sorted((i for i in range(len(ids)) if len(ids[i])), key=lambda i: len(ids[i])), 0
        while at < len(order):
            end, total = at, 0
            while end < len(order) and (end == at or total + len(ids[order[end]]) <= BATCH_TOKENS):
                total += len(ids[order[end]])
                end += 1
            part = [ids[i] for i in order[at:end]]
            starts = np.cumsum([0, *map(len, part[:-1])])
            out[order[at:end]] = np.add.reduceat(vectors[np.concatenate(part)], starts, axis=0)
            at = end
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, length, out=out, where=length > 0)
