"""Importance resampling towards a target distribution, over hashed features of words.

Features of a text are all runs of 1 to ``max_run`` consecutive words. Each falls into the bucket that the CRC-32 of its
bytes gives. A bucket's gain is the (scaled, floored) logarithm of how much likelier the target is to draw it than the
corpus; a document's weight is the floored mean gain of its features, and the documents of the largest weight plus Gumbel
noise are a sample without replacement in proportion to the exponential of the weights.

Within a task, distinct features of a block of texts are grouped by their byte length into matrices (a row each), all
checksums of a matrix advance column by column, and the buckets are scattered back to the places of the features.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written
from .text import Block, blocks

#: Fixed value: the reversed polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
#: Bytes of a matrix that one step gathers.
STEP = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


@lru_cache(maxsize=1)
def crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(POLYNOMIAL), c >> 1)
    return c


def crc_rows(m: np.ndarray) -> np.ndarray:
    """CRC-32 of every row of a matrix of bytes."""
    table = crc_table()
    c = np.full(len(m), 0xFFFFFFFF, np.uint32)
    for column in m.T:
        c = (c >> 8) ^ table[(c ^ column) & 0xFF]
    return ~c


def gather(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A matrix whose rows are the ``length`` bytes from each start."""
    out = np.empty((len(starts), length), np.uint8)
    step = max(1, STEP // length)
    for i in range(0, len(starts), step):
        out[i : i + step] = data[starts[i : i + step, None] + np.arange(length)]
    return out


def by_length(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each length with the positions that have it."""
    sizes = ends - starts
    order = np.argsort(sizes, kind="stable")
    lengths, first = np.unique(sizes[order], return_index=True)
    for k, length in enumerate(lengths):
        yield int(length), order[first[k] : first[k + 1] if k + 1 < len(first) else None]


def distinct_rows(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A position of each distinct row and, for every row, which of these it equals (bytes are compared, not hashes)."""
    n, length = m.shape
    if length > 64:  # no word holds a zero byte, which such strings would lose at their end
        _, first, which = np.unique(np.ascontiguousarray(m).view(f"S{length}").ravel(), return_index=True, return_inverse=True)
        return first, which
    wide = np.zeros((n, -(-length // 8) * 8), np.uint8)
    wide[:, :length] = m
    first, which = np.zeros(1, np.int64), np.zeros(n, np.int64)
    for column in wide.view(np.uint64).T:
        _, part = np.unique(column, return_inverse=True)
        _, first, which = np.unique(which * (int(part.max()) + 1) + part, return_index=True, return_inverse=True)
    return first, which


def feature_buckets(block: Block, max_run: int, buckets: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """For each row of a block its number of words and the index of its first; for runs of 1, 2, ... words the buckets of all
    runs (as the bucket of each distinct run and which of them stands at each place) with the first word of each."""
    # a space after each row keeps the words of neighbours apart; then words are one space apart
    rows = len(block.rows)
    data = np.insert(_LOWER[block.data], block.offsets[1:], np.uint8(32))
    solid = _WORD[data]
    keep = solid.copy()
    keep[1:] |= solid[:-1]
    row_ends = np.concatenate([[0], np.cumsum(keep)])[block.offsets + np.arange(rows + 1)]
    solid, data = solid[keep], np.where(solid, data, np.uint8(32))[keep]
    ends = np.flatnonzero(~solid)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    first = np.searchsorted(starts, row_ends)
    n = np.diff(first)
    row = np.repeat(np.arange(rows), n)
    word = np.empty(len(starts), np.int64)
    leaders, count = [], 0
    for length, at in by_length(starts, ends):
        lead, which = distinct_rows(gather(data, starts[at], length))
        word[at] = which + count
        leaders.append(at[lead])
        count += len(lead)
    lead = np.concatenate(leaders) if leaders else np.zeros(0, np.int64)
    runs, out = word, []
    for k in range(1, max_run + 1):
        if k > 1:
            # runs that stay within a row, as the run of one word fewer and the last word
            inside = np.flatnonzero(row[k - 1 :] == row[: len(row) - k + 1]) if len(row) >= k else np.zeros(0, np.int64)
            before = np.zeros(len(word), np.int64)
            before[places] = runs
            _, at, runs = np.unique(before[inside] * count + word[inside + k - 1], return_index=True, return_inverse=True)
            places, lead = inside, inside[at]
        else:
            places = np.arange(len(word))
        hashed = np.empty(len(lead), np.int64)
        for length, at in by_length(starts[lead], ends[lead + k - 1]):
            step = max(1, STEP // length)
            for i in range(0, len(at), step):
                some = at[i : i + step]
                hashed[some] = crc_rows(gather(data, starts[lead[some]], length)).astype(np.int64) % buckets
        out.append((hashed, runs, places))
    return n, first, out


def bucket_counts(texts: DataFrame, max_run: int, buckets: int) -> np.ndarray:
    """How often features of ``texts`` (column ``text``) fall into each bucket. A task sums its own; at most ``buckets``
    rows a task are shuffled and as many reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for block in blocks(batch.column(0)):
                for hashed, runs, _ in feature_buckets(block, max_run, buckets)[2]:
                    total += np.bincount(hashed, np.bincount(runs, minlength=len(hashed)), buckets).astype(np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    rows = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of smoothed shares, in doubles."""
    s, t, b = float(corpus.sum()), float(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log(((float(y) + 1) * (s + b)) / ((float(x) + 1) * (t + b)))) for x, y in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, max_run: int) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every row of ``docs`` (``doc_id``, ``text``); null is the empty text, whose
    weight is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                n, first, levels = feature_buckets(block, max_run, len(gain))
                total = np.zeros(first[-1] + 1, np.int64)  # by first word, moved by one
                for hashed, runs, places in levels:
                    np.add.at(total, places + 1, gain[hashed][runs])
                sums = np.diff(np.cumsum(total)[first])
                features = sum(np.maximum(n - k, 0) for k in range(max_run))
                weight = np.floor_divide(sums, np.maximum(features, 1))
                ids = batch.column(0).slice(block.rows.start, len(block.rows))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(x.astype(np.int64)) for x in (n, features, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, max_run: int = 2, buckets: int = 10_000, seed: int = 7, least_words: int = 20) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs`` (``doc_id``, ``text``); ``target`` has ``text``.
    Other columns of both are ignored.

    Of the N documents with at least ``least_words`` words the floor(percent * N / 100) of the highest scores are drawn and
    ranked from 1, ties to the smaller doc_id; the others have no rank. Rows without doc_id have a weight, but no score, and
    take no part in the draw. Rows that repeat a doc_id are drawn one by one. An empty ``docs`` gives no rows; an empty
    ``target`` makes all buckets alike but for the corpus' own counts.

    Scores are whole numbers. Noise keeps under a thousandth of different documents on one score, whatever their texts, and
    their range, under 250,000 values for counts of 64 bits, bounds the histogram that places them; so no task orders
    the table, and the histogram can be broadcast."""
    gain = gains(bucket_counts(docs, max_run, buckets), bucket_counts(target, max_run, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    scored = written(weights(docs, gain, max_run).withColumn("score", F.col("weight") + noise), "importance")
    enough = F.coalesce((F.col("n_words") >= least_words) & F.col("score").isNotNull(), F.lit(False))
    higher = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)  # one row a score
    bins = scored.where(enough).groupBy("score").agg(F.count("*").alias("n"))
    bins = bins.select("score", F.coalesce(F.sum("n").over(higher), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("all"))
    bins = bins.select("score", "before", F.expr(f"{int(percent)} * all div 100").alias("drawn")).where("before < drawn")
    keys = ["doc_id", "n_features", "weight", "score"]
    placed = scored.withColumn("enough", enough).join(F.broadcast(bins.withColumn("enough", F.lit(True))), ["score", "enough"], "left")
    rank = F.col("before") + F.row_number().over(Window.partitionBy("score").orderBy("doc_id", "weight", "n_features"))
    near = placed.where("before is not null").withColumn("rank", rank)
    ranked = near.select(*keys, F.when(F.col("rank") <= F.col("drawn"), F.col("rank")).cast("long").alias("rank"))
    return ranked.unionByName(placed.where("before is null").select(*keys, F.lit(None).cast("long").alias("rank")))


def draw(docs: DataFrame, target: DataFrame, **how: int) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose doc_id ``resample`` draws."""
    chosen = resample(docs, target, **how).where("rank is not null").select("doc_id").distinct()
    return docs.join(chosen, "doc_id", "left_semi")
