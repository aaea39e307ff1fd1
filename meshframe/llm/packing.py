"""Sequence packing as a cutting-stock problem solved by column generation.

Documents are cut only where they exceed a sequence: into whole sequences and a remainder. Remainders form a
histogram of size classes (exact up to ``SMALL`` tokens, then multiples of ``GRAIN``, rounded up), whose size
does not depend on the corpus. A linear program over patterns (how many remainders of each class one sequence
takes) is solved by a revised simplex; a knapsack dynamic program prices new patterns. Patterns are rounded
down, what is left is placed by best fit, and every document finds its sequence by arithmetic from its rank
within its class. Only the histogram reaches the driver.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

#: Remainders up to SMALL tokens have a class for each length; longer ones share classes of GRAIN lengths.
SMALL, GRAIN = 64, 8
#: Pieces that are ranked together in one task, about.
RANKED = 100_000
#: Simplex steps end at this distance from the optimum, or after so many; the solution is feasible after each.
GAP, MAX_STEPS = 2e-3, 1500


def size_class(length, capacity: int):
    """Tokens that a remainder counts as, for arrays or numbers."""
    up = np.minimum(-(-length // GRAIN) * GRAIN, capacity)
    return np.where(length <= SMALL, length, up)


def _best_pattern(value: np.ndarray, size: np.ndarray, capacity: int) -> np.ndarray:
    """The multiset of sizes of the largest value that fits (unbounded knapsack; capacities closer than the least
    size don't depend on each other and are done together)."""
    pad = int(size[-1])
    best = np.full(pad + capacity + 1, -np.inf)
    best[pad:] = 0.0
    took = np.full(capacity + 1, -1)
    step = int(size[0])
    for c in range(step, capacity + 1, step):
        at = np.arange(c, min(c + step, capacity + 1))
        got = best[pad + at[:, None] - size[None, :]] + value[None, :]
        k = got.argmax(axis=1)
        top = got[np.arange(len(at)), k]
        better = top > 1e-12
        best[pad + at] = np.where(better, top, 0.0)
        took[at] = np.where(better, k, -1)
    out, c = np.zeros(len(size)), int(best[pad:].argmax())
    while took[c] >= 0:
        k = took[c]
        out[k] += 1
        c -= int(size[k])
    return out


def _first_basis(size: np.ndarray, demand: np.ndarray, capacity: int) -> np.ndarray:
    """Patterns filled from the largest size on, each used until it exhausts a class: a triangular basis."""
    m = len(size)
    left, todo = demand.copy(), np.ones(m, bool)
    basis = np.zeros((m, m))
    for _ in range(m):
        room, pattern = capacity, np.zeros(m)
        for i in np.flatnonzero(todo)[::-1].tolist():
            first = room == capacity
            if room >= size[i] and (first or left[i] > 1e-9):
                a = min(room // int(size[i]), max(1, int(left[i])))
                pattern[i] = a
                room -= a * int(size[i])
                if room < size[0]:
                    break
        used = np.flatnonzero(pattern)
        times = left[used] / pattern[used]
        k = int(times.argmin())
        left[used] -= times[k] * pattern[used]
        basis[:, used[k]] = pattern
        todo[used[k]] = False
    return basis


def _times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Their product by numpy's own loops: a driver's BLAS brings threads of its own, which can wait for each other."""
    return np.einsum("ij,j->i", matrix, vector, optimize=False)


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan elimination with row pivots, on one thread."""
    m = len(matrix)
    work = np.concatenate([matrix, np.eye(m)], axis=1)
    for c in range(m):
        p = c + int(np.abs(work[c:, c]).argmax())
        if p != c:
            work[[c, p]] = work[[p, c]]
        work[c] /= work[c, c]
        rows = np.flatnonzero(work[:, c])
        rows = rows[rows != c]
        work[rows] -= work[rows, c, None] * work[c]
    return work[:, m:]


def solve(size: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often each is used (fractions) so that demands are met by fewest sequences, up to
    a share of GAP (by the bound that the value of the best pattern gives)."""
    m = len(size)
    if not m:
        return np.zeros((0, 0)), np.zeros(0)
    basis = _first_basis(size, demand, capacity)
    inverse = _inverse(basis)
    use = _times(inverse, demand)
    for step in range(MAX_STEPS):
        if step % 300 == 299:
            inverse = _inverse(basis)
            use = _times(inverse, demand)
        dual = inverse.sum(axis=0)
        column = _best_pattern(np.maximum(dual, 0), size, capacity)
        if (dual * column).sum() <= 1 + GAP:
            break
        turn = _times(inverse, column)
        ratio = np.where(turn > 1e-9, use / np.where(turn > 1e-9, turn, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
        pivot = inverse[out] / turn[out]
        move = ratio[out]
        inverse -= turn[:, None] * pivot
        inverse[out] = pivot
        use -= turn * move
        use[out] = move
    return basis, np.maximum(use, 0)


def plan(hist: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns ``({class: how many}, how often)`` that use up a histogram of size classes exactly."""
    left, out = dict(hist), []
    if full := left.pop(capacity, 0):
        out.append(({capacity: 1}, full))
    for low, high, unit in ((1, SMALL, 1), (SMALL + 1, capacity - 1, GRAIN if capacity % GRAIN == 0 else 1)):
        sizes = np.array(sorted(s for s in left if low <= s <= high), np.int64)
        demand = np.array([left[s] for s in sizes.tolist()], float)
        basis, use = solve(sizes // unit, demand, capacity // unit)
        whole = np.floor(use + 1e-9).astype(np.int64)
        for k in np.flatnonzero(whole).tolist():
            pattern = {int(sizes[i]): int(basis[i, k]) for i in np.flatnonzero(basis[:, k]).tolist()}
            times = min(whole[k], *(left[s] // a for s, a in pattern.items()))
            if times > 0:
                out.append((pattern, int(times)))
                for s, a in pattern.items():
                    left[s] -= a * int(times)
    bins: list[dict[int, int]] = []
    room: list[tuple[int, int]] = []
    for s in sorted(left, reverse=True):
        for _ in range(left[s]):
            at = bisect_left(room, (s, -1))
            space, b = room.pop(at) if at < len(room) else (capacity, len(bins))
            if b == len(bins):
                bins.append({})
            bins[b][s] = bins[b].get(s, 0) + 1
            insort(room, (space - s, b))
    return out + [(b, 1) for b in bins]


class Places:
    """Where the rank of a piece within its class puts it: a sequence and a slot in it."""

    def __init__(self, patterns: list[tuple[dict[int, int], int]]) -> None:
        found: dict[int, list[tuple[int, int, int, int]]] = {}
        rank: dict[int, int] = {}
        base = 0
        for pattern, times in patterns:
            slot = 0
            for s, a in sorted(pattern.items(), reverse=True):
                found.setdefault(s, []).append((rank.get(s, 0), base, a, slot))
                rank[s] = rank.get(s, 0) + a * times
                slot += a
            base += times
        self.by = {s: np.array(v, np.int64).T for s, v in found.items()}

    def find(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, slot = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
        for s in np.unique(size).tolist():
            mine = size == s
            start, base, a, first = self.by[s]
            k = np.searchsorted(start, rank[mine], "right") - 1
            d = rank[mine] - start[k]
            sequence[mine], slot[mine] = base[k] + d // a[k], first[k] + d % a[k]
        return sequence, slot


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens``: one row per whole sequence or remainder of a document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import word_bpe

        encode = word_bpe(tokenizer).encode
        for batch in batches:
            rows, start, length, crc, total = [], [], [], [], []
            for row, own in enumerate(encode(batch.column(1))):
                ids = np.append(own, np.int32(end_id)).astype("<u4")
                for at in range(0, len(ids), capacity):
                    rows.append(row)
                    start.append(at)
                    length.append(min(capacity, len(ids) - at))
                    crc.append(zlib.crc32(ids[at : at + capacity].tobytes()))
                    total.append(len(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, pa.int64()) for c in (start, length, crc, total))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def assign(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces of at most ``capacity`` tokens (column ``length``; ``doc_id``
    and ``start`` rank them). ``pieces`` is read three times: give a written table."""
    up = F.least(F.ceil(F.col("length") / GRAIN).cast("long") * GRAIN, F.lit(capacity))
    sized = pieces.withColumn("size_class", F.when(F.col("length") <= SMALL, F.col("length")).otherwise(up))
    hist = {int(s): int(n) for s, n in sized.groupBy("size_class").count().collect()}  # at most SMALL + capacity / GRAIN rows
    spark = pieces.sparkSession
    places = spark.sparkContext.broadcast(Places(plan(hist, capacity)))
    salts = max(1, -(-sum(hist.values()) // RANKED))
    dealt = sized.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)).cast("int"))
    counts = dealt.groupBy("size_class", "salt").count()
    before = Window.partitionBy("size_class").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("size_class", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("size_class", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(own)).join(offsets, ["size_class", "salt"]).withColumn("rank", F.col("before") + F.col("rank") - 1)
    names = pieces.columns
    placed = ranked.select("size_class", "rank", *names)
    schema = pieces.schema.add("sequence_id", "long").add("slot", "long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, slot = places.value.find(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(2 + i) for i in range(len(names))), pa.array(sequence), pa.array(slot)], names=[*names, "sequence_id", "slot"])

    along = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    found = placed.mapInArrow(place, schema)
    return found.select(*names, "sequence_id", F.coalesce(F.sum("length").over(along), F.lit(0)).alias("offset"))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2) -> DataFrame:
    """Pack the rows of ``docs`` (``doc_id``, ``text``; others are ignored) into sequences.

    Returns ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``, one row per piece. A null or
    empty text is its end id alone; repeated rows are packed as often as they occur; a null ``doc_id`` is packed
    like any; an empty table gives no rows. ``tokenizer`` is the path of a word-level BPE JSON file.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return assign(scratch.written(token_pieces(docs, tokenizer, end_id, capacity), "pieces"), capacity)
