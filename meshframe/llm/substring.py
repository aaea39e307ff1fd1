"""Substring deduplication: repeated windows of ``width`` consecutive words are removed from later documents.

Every window is hashed (Rabin-Karp). To count them without one row per word, runs of consecutive windows that
choose the same anchor (the window's smallest hash of ``GRAM`` words, so that equal windows choose alike) are
first counted as one *run* row. A run that a smaller document holds whole is removed whole.

Different runs may still share some windows, at the borders of a repeated passage. Every window holds its anchor,
so of its other ``width - GRAM`` words at least half stand before the anchor or at least half after it: runs that
share a window agree in the words from that half up to the anchor's end, or from its start on (their *sides*).
Runs that agree in a side with a different run of another document are opened: their single windows are counted as
well, for each distinct run in its smallest document only. A line that many documents share opens nothing unless
it is as long as a side. The outcome equals counting each window on its own.

Hot passages never gather: counts are ``min`` aggregates, combined on the map side. Windows and runs are compared
by two independent hashes of 64 bits, sides by one (an agreement too many costs work and changes nothing).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch
from .text import U64, blocks, mix, rolling

#: Words of the pieces whose smallest hash is a window's anchor.
GRAM = 10


def _starts(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First windows of runs, their numbers of windows, the words at which their anchors start and anchors' hashes."""
    gram = min(GRAM, width)
    grams = rolling(words, gram)
    view = np.lib.stride_tricks.sliding_window_view(grams, width - gram + 1)
    at = view.argmin(axis=1) + np.arange(len(view))
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return first, np.diff(np.r_[first, len(at)]), at[first], grams[at[first]]


def _second(words: np.ndarray) -> np.ndarray:
    """Other values of the words, for hashes independent of the first ones."""
    return mix(words + U64(0x2545F4914F6CDD1D))


def _runs(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First windows of runs, two hashes of their windows, their anchors' hashes, and 32 bits of the hash of the left
    side above 32 of the right one's (0 for a side that reaches beyond the run)."""
    first, count, at, anchor = _starts(words, width)
    n = count.astype(U64)
    place = (np.arange(len(words) - width + 1) - np.repeat(first, count)).astype(U64) * U64(0x9E3779B97F4A7C15)
    one = mix(np.add.reduceat(mix(rolling(words, width) + place), first) + n)
    two = mix(np.add.reduceat(mix(rolling(_second(words), width) + place), first) ^ n)
    gram = min(GRAM, width)
    half = (width - gram) // 2
    side = rolling(words, gram + half) >> U64(32) | U64(1)
    left = np.where(at - half >= first, side[np.maximum(at - half, 0)], U64(0))
    right = np.where(at + gram + half <= first + count - 1 + width, side[np.minimum(at, len(side) - 1)], U64(0))
    return first, one, two, anchor, left << U64(32) | right


def _places(js: np.ndarray, words: np.ndarray, width: int) -> np.ndarray:
    """All runs that ``js`` stands for: j is that run alone, -j - 1 every run of the document that equals run j (a word
    that a text repeats over and over gives one run per window, all equal, but one row)."""
    if not (js < 0).any():
        return js
    one = _runs(words, width)[1]
    return np.concatenate([js[js >= 0], np.flatnonzero(np.isin(one, one[-js[js < 0] - 1]))])


def _documents(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, bytes]]:
    """For each row its position, hashes, starts and ends of its words and the block's bytes."""
    for block in blocks(batch.column(column)):
        starts, ends, first = block.words()
        words = block.word_hashes(starts, ends)
        for i, row in enumerate(block.rows):
            a, b = int(first[i]), int(first[i + 1])
            yield row, words[a:b], starts[a:b], ends[a:b], block.data


def duplicate_windows(docs: DataFrame, width: int = 50) -> DataFrame:
    """``doc_id, rk, gone, single`` for each document with removed words: the runs (as ``_places`` reads them) and the single
    windows (by first word) that a smaller document also has. ``rk`` is a hash of the text, which tells rows of one ``doc_id`` apart."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, cols = [], [[] for _ in range(5)]
            for row, words, *_ in _documents(batch, 2):
                if len(words) >= width:
                    _, *hashes = _runs(words, width)
                    _, at, times = np.unique(hashes[0], return_index=True, return_counts=True)
                    rows.append(np.full(len(at), row))
                    for c, v in zip(cols, (np.where(times > 1, -at - 1, at), *(h[at].view(np.int64) for h in hashes)), strict=True):
                        c.append(v)
            if rows:
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(np.concatenate(c)) for c in cols)], names=["doc_id", "rk", "j", "b1", "b2", "ah", "sides"])

    keyed = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("rk"), "text")
    table = scratch.written(keyed.mapInArrow(runs, "doc_id long, rk long, j long, b1 long, b2 long, ah long, sides long"), "runs")
    lows = table.groupBy("b1", "b2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.first("ah").alias("ah"), F.first("sides").alias("sides"))
    several = lows.groupBy("ah").agg(F.count("*").alias("kinds"), F.min("lo").alias("alo"), F.max("hi").alias("ahi")).where("kinds > 1 and alo < ahi").select("ah")
    alike = scratch.written(lows.join(several, "ah", "left_semi").select("b1", "b2", "lo", "hi", "sides"), "alike")
    right = F.col("sides").bitwiseAND(F.lit(0xFFFFFFFF))
    sides = alike.select("b1", "b2", "lo", "hi", F.explode(F.array(F.shiftrightunsigned("sides", 32), -right)).alias("side")).where("side <> 0")
    mixed = sides.groupBy("side").agg(F.count("*").alias("kinds"), F.min("lo").alias("slo"), F.max("hi").alias("shi")).where("kinds > 1 and slo < shi").select("side")
    open_ = sides.join(mixed, "side", "left_semi").select("b1", "b2").distinct().withColumn("open", F.lit(True))
    known = lows.select("b1", "b2", "lo", "hi").join(open_, ["b1", "b2"], "left").where("open or lo < hi").select("b1", "b2", "lo", F.coalesce("open", F.lit(False)).alias("open"))
    known = scratch.written(known, "known")
    told = table.select("doc_id", "rk", "j", "b1", "b2").join(known, ["b1", "b2"]).withColumn("gone", F.col("lo") < F.col("doc_id")).where("gone or open")
    todo = scratch.written(told.groupBy("doc_id", "rk").agg(F.collect_set(F.when(F.col("gone"), F.col("j"))).alias("gone"), F.collect_set(F.when(~F.col("gone"), F.col("j"))).alias("open")), "told")

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = [], []
            for row, words, *_ in _documents(batch, 2):
                first, count, *_ = _starts(words, width)
                mine = np.sort(_places(np.array(batch.column(3)[row].as_py(), np.int64), words, width))
                at = np.concatenate([np.arange(first[j], first[j] + count[j]) for j in mine])
                h = rolling(words, width)[at]
                other = rolling(_second(words), width)[at]
                ids.append(np.full(len(at), row))
                marks.append((at, h.view(np.int64), other.view(np.int64)))
            if ids:
                rows = pa.array(np.concatenate(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *(pa.array(np.concatenate([m[k] for m in marks])) for k in range(3))], names=["doc_id", "rk", "s", "h1", "h2"])

    asked = todo.where(F.size("open") > 0).select("doc_id", "rk", "open")
    windows = keyed.join(asked, ["doc_id", "rk"]).select("doc_id", "rk", "text", "open").mapInArrow(opened, "doc_id long, rk long, s long, h1 long, h2 long")
    windows = scratch.written(windows, "windows")
    lowest = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    later = windows.join(lowest.select("h1", "h2", "lo"), ["h1", "h2"]).where("lo < doc_id").groupBy("doc_id", "rk").agg(F.collect_set("s").alias("single"))
    none = F.array().cast("array<bigint>")
    return todo.select("doc_id", "rk", "gone").join(later, ["doc_id", "rk"], "left").select("doc_id", "rk", "gone", F.coalesce("single", none).alias("single")).where("size(gone) + size(single) > 0")


def remove_repeats(docs: DataFrame, width: int = 50) -> DataFrame:
    """``docs`` with ``text`` replaced by its kept words joined by one space, and ``n_words``, ``n_removed``,
    ``kept_sha256``; ``text`` stays as it is, white space included, where nothing is removed.

    A word goes when a window of ``width`` words that covers it also starts in a document of a smaller
    ``doc_id``, judged on the input. Null text has no words (and stays null); texts under ``width`` words have
    no windows; repeats within a document and between rows of one ``doc_id`` are kept; rows with a null
    ``doc_id`` neither remove nor lose words. Other columns pass through, whatever their names; columns of the
    three new names are replaced.
    """
    docs = docs.drop("n_words", "n_removed", "kept_sha256")
    typed = docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.col("text").cast("string"))
    spans = duplicate_windows(typed.select("doc_id", "text"), width)
    names = [c for c in typed.columns if c != "text"]
    keyed = typed.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "text", "doc_id", F.xxhash64("text").alias("rk"))
    joined = keyed.join(spans, ["doc_id", "rk"], "left").select("text", "gone", "single", "row")
    out = T.StructType([T.StructField("text", T.StringType()), joined.schema["row"], *(T.StructField(c, T.LongType()) for c in ("n_words", "n_removed")), T.StructField("kept_sha256", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, removed, shas = [], [], [], []
            column, whole, single = batch.column(0), batch.column(1), batch.column(2)
            for row, words, starts, ends, data in _documents(batch, 0):
                n = len(words)
                keep = np.ones(n, bool)
                if whole[row].is_valid:
                    gone = np.zeros(n + 1, np.int64)
                    j = _places(np.array(whole[row].as_py(), np.int64), words, width)
                    if len(j):
                        first, count, *_ = _starts(words, width)
                        np.add.at(gone, first[j], 1)
                        np.add.at(gone, first[j] + count[j] - 1 + width, -1)
                    s = np.array(single[row].as_py(), np.int64)
                    np.add.at(gone, s, 1)
                    np.add.at(gone, s + width, -1)
                    keep = np.cumsum(gone)[:n] == 0
                left = b" ".join(bytes(data[starts[0] : ends[-1]]).split()) if n and keep.all() else b" ".join(bytes(data[a:b]) for a, b in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True))
                counts.append(n)
                removed.append(n - int(keep.sum()))
                shas.append(hashlib.sha256(left).hexdigest())
                texts.append(left.decode() if removed[-1] else column[row].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column(3), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.string())], names=["text", "row", "n_words", "n_removed", "kept_sha256"])

    columns = [F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    return joined.mapInArrow(cut, out).select(*columns, "n_words", "n_removed", "kept_sha256")
