"""Vectorised word hashing over Arrow string columns.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D``, within one text. All functions
work on slabs of a bounded number of bytes (one text at least), so memory does not follow the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLAB = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_GRAM = U64(0xD1342543DE82EF95)
_GRAM_INV = U64(pow(0xD1342543DE82EF95, -1, 2**64))


def _powers(base: np.uint64, n: int, cache: dict = {}) -> np.ndarray:
    have = cache.get(int(base))
    if have is None or len(have) < n:
        size = max(1024, 1 << int(n).bit_length())
        have = np.ones(size, np.uint64)
        have[1:] = base
        cache[int(base)] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, where, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slabs(offsets: np.ndarray, limit: int = SLAB) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """The words of a slab: ``start``/``end`` byte positions, 64-bit ``hash``, and ``first`` (n_texts + 1)
    giving each text's range of words. ``space``: which bytes part words."""

    __slots__ = ("data", "end", "first", "hash", "start")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, hashed: bool = True, space: np.ndarray = _SPACE):
        solid = ~space[data]
        begin, stop = solid.copy(), solid.copy()
        begin[1:] &= ~solid[:-1]
        stop[:-1] &= ~solid[1:]
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < len(data))]
        begin[cut] = solid[cut]
        stop[cut - 1] = solid[cut - 1]
        self.data = data
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.hash = np.zeros(0, np.uint64)
        if hashed and len(self.start):
            size = self.end - self.start
            at = np.cumsum(size) - size
            place = np.arange(int(size.sum())) - np.repeat(at, size)
            value = _BYTE[data[solid]] * _powers(_BASE, int(size.max()))[place]
            self.hash = mix(np.add.reduceat(value, at) + size.astype(np.uint64))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words (as if the slab were one text; see ``inside``)."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * _powers(_GRAM, n), out=total[1:])
    return mix((total[k:] - total[:-k]) * _powers(_GRAM_INV, n - k + 1))


def inside(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the k-word runs that lie in one text, and each one's text."""
    count = np.maximum(np.diff(first) - k + 1, 0)
    doc = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + first[:-1][doc]
    return at, doc
