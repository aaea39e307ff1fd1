"""BPE encoding with content-defined chunk reuse, and decoding.

A text is cut where a rolling hash of its last bytes hits a mask, so that equal passages give equal chunks
wherever they stand. A distinct chunk is encoded once per worker process and then reused by all documents of the
worker (a bounded two-generation cache: chunks that recur stay).

Chunks are then joined. A pre-token never holds white space behind another sign, so a place where white space
follows another sign is a *seam*: it ends a pre-token whatever stands around it. A chunk's ids between its first
and its last seam are therefore exact in every text. What stands between the last seam of one chunk and the first
of the next is encoded again as one piece; a chunk without a seam joins that piece, until one with a seam agrees.

No shuffle is needed: sharing ids between machines would move every text, while chunks repeat seldom.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import _BYTE, U64, blocks, rolling

#: Bytes that the rolling hash sees, its mask (a chunk has about MASK + 1 bytes) and the least chunk.
SEEN, MASK, LEAST = 16, 255, 48
#: Chunks in each of the two generations of the cache.
CACHE_CHUNKS = 20_000
#: White space, or signs without any, of this length go through the tokenizers library, whose time and stack they don't strain.
LONG = 8192


def cuts(data: np.ndarray) -> np.ndarray:
    """Byte positions at which a block is cut, never inside a character."""
    h = rolling(_BYTE[data], SEEN)
    at = np.flatnonzero((h & U64(MASK)) == 0) + SEEN
    at = at[at < len(data)]
    return at[(data[at] & 0xC0) != 0x80]


class ChunkEncoder:
    """Encodes texts like the library's tokenizer of ``path`` (byte-level, no normaliser, no prefix space)."""

    def __init__(self, path: str) -> None:
        from .tokens import byte_bpe

        self.path = path
        self.core, self.special = byte_bpe(path)
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # white space and its absence as all definitions of \s have it
        self.first_seam = re.compile(r"\S(?=[ \t\n\x0b\x0c\r])").search
        self.last_seam = re.compile(r"(?s).*\S(?=[ \t\n\x0b\x0c\r])").match
        self.strain = re.compile(r"\s{%d}|\S{%d}" % (LONG, LONG)).search
        self.young: dict[bytes, tuple[np.ndarray, str, str]] = {}
        self.old: dict[bytes, tuple[np.ndarray, str, str]] = {}
        self.encoded = self.reused = 0

    def plain(self, text: str) -> list[int]:
        """Ids of a text without special tokens' strings."""
        if len(text) >= LONG and self.strain(text):
            from .tokens import library

            return library(self.path).encode(text, add_special_tokens=False).ids
        return self.core.encode_ordinary(text)

    def chunk(self, data: bytes) -> tuple[np.ndarray, str, str]:
        """The ids between a chunk's first and last seam, and the texts before and after these; a chunk without a seam is
        all before."""
        got = self.young.get(data)
        if got is None:
            got = self.old.get(data)
            if got is None:
                self.encoded += 1
                text = data.decode()
                first, last = self.first_seam(text), self.last_seam(text)
                if first is None:
                    got = np.zeros(0, np.int32), text, ""
                else:
                    a, b = first.end(), last.end()
                    got = np.array(self.plain(text[a:b]), np.int32), text[:a], text[b:]
            else:
                self.reused += 1
            if len(self.young) >= CACHE_CHUNKS:
                self.old, self.young = self.young, {}
            self.young[data] = got
        else:
            self.reused += 1
        return got

    def join(self, parts: list[bytes]) -> np.ndarray:
        """The ids of the concatenation of ``parts``."""
        out: list[np.ndarray] = []
        carry: list[str] = []
        for data in parts:
            ids, before, after = self.chunk(data)
            carry.append(before)
            if after:  # the chunk has a seam
                out += [np.array(self.plain("".join(carry)), np.int32), ids]
                carry = [after]
        out.append(np.array(self.plain("".join(carry)), np.int32))
        return np.concatenate(out)

    def encode(self, data: bytes, at: list[int]) -> np.ndarray:
        """Ids of UTF-8 ``data`` with chunk boundaries ``at``."""
        if self.at_special is None or not any(s.encode() in data for s in self.special):
            marks, last = [0], 0
            for x in at:
                if x - last >= LEAST:
                    marks.append(x)
                    last = x
            marks.append(len(data))
            return self.join([data[a:b] for a, b in zip(marks, marks[1:], strict=False) if b > a])
        out = [np.zeros(0, np.int32)]
        for text in self.at_special.split(data.decode()):
            if text in self.special:
                out.append(np.array([self.special[text]], np.int32))
            elif text:
                out.append(self.join([text.encode()]))
        return np.concatenate(out)


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) for every row of ``docs`` (``doc_id``, ``text``; others are ignored).

    Null and empty texts have no ids. Strings of special tokens in a text are those tokens, as in the library.
    ``tokenizer`` is the path of a byte-level BPE JSON file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer)
        for batch in batches:
            for block in blocks(batch.column(1)):
                at = cuts(block.data)
                first = np.searchsorted(at, block.offsets, "right")
                raw = block.data.tobytes()
                values, sizes = [], [0]
                for i in range(len(block.rows)):
                    a, b = int(block.offsets[i]), int(block.offsets[i + 1])
                    own = at[first[i] : first[i + 1]] - a
                    values.append(bpe.encode(raw[a:b], own[own < b - a].tolist()))
                    sizes.append(len(values[-1]))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), pa.array(np.concatenate(values)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.rows.start, len(block.rows)), lists], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """Add ``decoded`` to rows with ``doc_id`` and ``ids``: the text of the ids, special tokens included; bytes that
    aren't UTF-8 become U+FFFD, as in the library. Null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import byte_table

        table = byte_table(tokenizer)
        for batch in batches:
            lists = batch.column(1)
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            known = lists.is_valid().to_numpy(zero_copy_only=False)
            texts = [b"".join(map(table.__getitem__, flat[a:b].tolist())).decode("utf-8", "replace") if k else "" for a, b, k in zip(ends, ends[1:], known, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")
