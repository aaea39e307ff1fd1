"""Vectorised word and shingle hashing over the Arrow buffers of a text column.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. No Python object is made per word: spans come
from comparisons on the byte buffer and hashes from wrapping prefix sums of ``T[byte] * P**i`` (64 bits).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Text bytes that one vectorised step works on; bounds the memory of a task.
BLOCK_BYTES = 1 << 20
_P, _Q = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that sums of mixed values don't inherit the structure of their parts."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Tables:
    """Powers and their inverses modulo 2**64, grown on demand and kept by the worker process."""

    def __init__(self) -> None:
        self.n = 0

    def get(self, n: int) -> _Tables:
        if n > self.n:
            self.n = max(n, BLOCK_BYTES + 65536)
            self.p, self.ip = _powers(_P, self.n), _powers(pow(_P, -1, 1 << 64), self.n)
            self.q, self.iq = _powers(_Q, self.n), _powers(pow(_Q, -1, 1 << 64), self.n)
        return self


_TABLES = _Tables()
_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


@dataclass
class Block:
    """Some rows of a batch: their positions in it, their bytes and where each row's bytes begin."""

    rows: range
    data: np.ndarray
    offsets: np.ndarray

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of words as byte positions, and for each row the index of its first word (n + 1 values)."""
        n = len(self.data)
        if not n:
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(len(self.rows) + 1, np.int64)
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        solid = ~_SPACE[self.data]
        before = np.empty(n, bool)
        before[0], before[1:] = True, ~solid[:-1]
        after = np.empty(n, bool)
        after[-1], after[:-1] = True, ~solid[1:]
        starts = np.flatnonzero(solid & (before | edge[:-1]))
        ends = np.flatnonzero(solid & (after | edge[1:])) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def word_hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        t = _TABLES.get(len(self.data) + 1)
        total = np.empty(len(self.data) + 1, U64)
        total[0] = 0
        np.cumsum((_BYTE_LOWER if lower else _BYTE)[self.data] * t.p[: len(self.data)], out=total[1:])
        return mix((total[ends] - total[starts]) * t.ip[starts] + (ends - starts).astype(U64))


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp hashes (polynomials modulo 2**64, mixed) of every ``k`` consecutive values."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, U64)
    t = _TABLES.get(n + 1)
    total = np.empty(n + 1, U64)
    total[0] = 0
    np.cumsum(hashes * t.q[:n], out=total[1:])
    return mix((total[k:] - total[:-k]) * t.iq[: n - k + 1])


def blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a string column into blocks of about ``block_bytes``; null is empty. One row is never cut."""
    if pa.types.is_large_string(column.type) or pa.types.is_string_view(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    if not n:
        return
    off = np.frombuffer(offsets, np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + block_bytes, "right")) - 1)
        to = min(to, n)
        yield Block(range(at, to), raw[off[at] : off[to]], off[at : to + 1] - off[at])
        at = to


def shingles(block: Block, k: int, lower: bool = True) -> Iterator[tuple[int, np.ndarray]]:
    """For each row its position and the sorted distinct hashes of its ``k``-word shingles; a row of fewer
    words has its whole sequence as one; a row without words has none."""
    starts, ends, first = block.words()
    words = block.word_hashes(starts, ends, lower)
    rolled = rolling(words, k)
    for i, row in enumerate(block.rows):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= k:
            yield row, np.unique(rolled[a : b - k + 1])
        elif b > a:
            yield row, rolling(words[a:b], b - a) ^ U64(b - a)
        else:
            yield row, rolled[:0]
