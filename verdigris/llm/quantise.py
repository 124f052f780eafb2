"""Score-aware quantisation of vectors (numpy only): a coarse partition, anisotropic four-bit codes, table scans.

A vector x of unit length in the leaf with centroid c is kept as c + |r| * u, where r = x - c and u is one of 16
choices for each pair of dimensions: four bits for each two numbers.  What matters for a maximum inner product is the
error along x, so the loss of an error e is |e|^2 + (ETA - 1) * <e, x>^2, both when codes are chosen (coordinate
descent) and when the codebooks are fitted (one linear system for all of them).
"""

from __future__ import annotations

import numpy as np

SUB = 2
CHOICES = 16
#: The parallel weight for inner products of 0.2 and more, (d - 1) T^2 / (1 - T^2) at d = 64.
ETA = 63 * 0.04 / 0.96


def unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    return (x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)).astype(np.float32)


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Spherical k-means; empty cells restart on random rows."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = nearest(x, centres, 1)[:, 0]
        sums = np.zeros_like(centres, dtype=np.float64)
        np.add.at(sums, at, x)
        empty = np.bincount(at, minlength=k) == 0
        sums[empty] = x[rng.choice(len(x), int(empty.sum()))]
        centres = unit(sums)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, n: int, block: int = 4096) -> np.ndarray:
    """The ``n`` best centres of each row by inner product, best first."""
    n = min(n, len(centres))
    out = np.empty((len(x), n), np.int32)
    for i in range(0, len(x), block):
        s = x[i : i + block] @ centres.T
        if n == 1:
            out[i : i + block, 0] = s.argmax(1)
        else:
            top = np.argpartition(-s, n - 1, axis=1)[:, :n]
            out[i : i + block] = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)
    return out


def residuals(x: np.ndarray, centres: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit residuals and their lengths."""
    r = x - centres[leaf]
    length = np.sqrt((r * r).sum(1))
    return r / np.maximum(length, 1e-12)[:, None], length.astype(np.float32)


def choose_codes(u: np.ndarray, along: np.ndarray, books: np.ndarray, rounds: int = 2) -> np.ndarray:
    """Codes (n, d / SUB) of the unit residuals ``u`` by coordinate descent on the anisotropic loss."""
    parts = books.shape[0]
    us, xs = u.reshape(len(u), parts, SUB), along.reshape(len(u), parts, SUB)
    plain = ((us[:, :, None, :] - books[None]) ** 2).sum(3)
    codes = plain.argmin(2)
    # the error along x of every choice, and of the present choices together
    err = np.einsum("nps,pcs->npc", xs, -books) + (us * xs).sum(2)[:, :, None]
    rows = np.arange(len(u))
    total = np.take_along_axis(err, codes[:, :, None], 2)[:, :, 0].sum(1)
    for _ in range(rounds):
        for p in range(parts):
            rest = total - err[rows, p, codes[:, p]]
            loss = plain[:, p] + (ETA - 1) * (rest[:, None] + err[:, p]) ** 2
            codes[:, p] = loss.argmin(1)
            total = rest + err[rows, p, codes[:, p]]
    return codes.astype(np.uint8)


def fit_books(u: np.ndarray, along: np.ndarray, rounds: int = 4, seed: int = 5) -> np.ndarray:
    """Codebooks (d / SUB, CHOICES, SUB) for unit residuals: codes and a joint least-squares fit in turn."""
    n, d = u.shape
    parts = d // SUB
    rng = np.random.default_rng(seed)
    books = u[rng.choice(n, CHOICES, replace=n < CHOICES)].reshape(CHOICES, parts, SUB).transpose(1, 0, 2).copy()
    for _ in range(6):  # a plain start
        us = u.reshape(n, parts, SUB)
        codes = ((us[:, :, None, :] - books[None]) ** 2).sum(3).argmin(2)
        for p in range(parts):
            count = np.bincount(codes[:, p], minlength=CHOICES)
            for s in range(SUB):
                total = np.bincount(codes[:, p], us[:, p, s], CHOICES)
                books[p, :, s] = np.where(count, total / np.maximum(count, 1), books[p, :, s])
    size = parts * CHOICES * SUB
    for _ in range(rounds):
        codes = choose_codes(u, along, books)
        column = (np.arange(parts)[None] * CHOICES + codes).astype(np.int64)
        places = (column[:, :, None] * SUB + np.arange(SUB)).reshape(n, d)
        a, b = np.zeros((size, size)), np.zeros(size)
        np.add.at(b, places.ravel(), u.ravel())
        a[np.arange(size), np.arange(size)] = np.bincount(places.ravel(), minlength=size) + 1e-3
        b += 1e-3 * books.ravel()
        for i in range(0, n, 2048):
            wide = np.zeros((len(u[i : i + 2048]), size), np.float32)
            np.put_along_axis(wide, places[i : i + 2048], along[i : i + 2048], 1)
            a += (ETA - 1) * (wide.T @ wide)
            b += (ETA - 1) * (wide.T @ (u[i : i + 2048] * along[i : i + 2048]).sum(1))
        books = np.linalg.solve(a, b).reshape(parts, CHOICES, SUB).astype(np.float32)
    return books


def pack(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes in a byte."""
    return (codes[:, 0::2] | (codes[:, 1::2] << 4)).astype(np.uint8)


def unpack(packed: np.ndarray) -> np.ndarray:
    out = np.empty((len(packed), packed.shape[1] * 2), np.uint8)
    out[:, 0::2], out[:, 1::2] = packed & 15, packed >> 4
    return out


def tables(q: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The inner products of each query's parts with every choice: (d / SUB, CHOICES, queries)."""
    return np.ascontiguousarray(np.einsum("qps,pcs->pcq", q.reshape(len(q), books.shape[0], SUB), books, optimize=True))


def scan(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Summed entries (rows, queries) of the codes (rows, parts) in ``table`` (parts, values, queries)."""
    total = table[0].take(codes[:, 0], axis=0)
    part = np.empty_like(total)
    for p in range(1, len(table)):
        np.take(table[p], codes[:, p], axis=0, out=part, mode="clip")
        total += part
    return total
