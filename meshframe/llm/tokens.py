"""Encoders over the public vocabulary files; their paths are parameters. Tokenizers are loaded once per worker."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed value: how byte-level vocabularies split a text into pre-tokens.
BYTE_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: How the word-level vocabulary cuts a word into pieces, and the words that are cut here.
WORD_PATTERN = r"('s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+)"
SAFE_WORD = "^[!-~¡-įı-ɏ]*$"  # all but the one capital whose small letter is two characters


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable characters of Latin-1 for
    themselves, the other bytes by the characters from U+0100 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def library(path: str):
    """The tokenizers library's tokenizer of a JSON file."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Ranks and special tokens of a byte-level JSON file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet = byte_alphabet()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    return {bytes(alphabet[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}, special


@lru_cache(maxsize=4)
def byte_bpe(path: str):
    """Of a byte-level JSON file without normaliser: a core that encodes ordinary text, and the special tokens' ids."""
    import tiktoken

    ranks, special = _byte_vocabulary(path)
    return tiktoken.Encoding("byte_bpe", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={}), special


@lru_cache(maxsize=4)
def byte_table(path: str) -> list[bytes]:
    """The bytes of every id of a byte-level JSON file."""
    ranks, special = _byte_vocabulary(path)
    table = [b""] * (max([*ranks.values(), *special.values()]) + 1)
    for piece, i in [*ranks.items(), *((k.encode(), v) for k, v in special.items())]:
        table[i] = piece
    return table


class WordBpe:
    """Ids of texts for a lower-casing BPE file with word ends (``</w>``), whole columns at a time.

    White space is dropped by that tokenizer, so that a text's ids are its words' ids in order. A block of texts is
    split into words, whose distinct ones are encoded together: words of Latin letters, digits and signs are cut by the
    file's pattern and merged by rank in one call (``END`` stands for the word end, ``NEXT`` parts the words); all
    other words go through the library itself. Nothing is kept from block to block but the vocabulary."""

    END, NEXT = "\x00", "\x01"

    def __init__(self, path: str) -> None:
        import tiktoken

        self.slow = library(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet, end = byte_alphabet(), spec["model"]["end_of_word_suffix"]
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {}
        for piece, i in spec["model"]["vocab"].items():
            if piece not in special:
                tail = piece.endswith(end) and len(piece) > len(end)
                body = bytes(alphabet[c] for c in (piece[: -len(end)] if tail else piece))
                if tail or not body.endswith(self.END.encode()):
                    ranks[body + self.END.encode() * tail] = i
        self.next_id = ranks[self.NEXT.encode()]
        ranks[self.END.encode()] = max(ranks.values()) + 1  # no word holds it
        self.core = tiktoken.Encoding("word_bpe", pat_str="\x01|[^\x00\x01]+\x00", mergeable_ranks=ranks, special_tokens={})

    def words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``words`` (without white space) in order, and how many each has."""
        if not len(words):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        safe = pc.and_(pc.match_substring_regex(words, SAFE_WORD), pc.invert(pc.match_substring(words, "<|"))).to_numpy(zero_copy_only=False)
        lower = pc.utf8_lower(words.filter(pa.array(safe)))
        letters = pc.match_substring_regex(lower, r"^\pL+$")  # one piece
        mixed = pc.replace_substring_regex(lower.filter(pc.invert(letters)), WORD_PATTERN, r"\1" + self.END)
        one = pc.binary_join_element_wise(lower.filter(letters), self.END, "")
        at = np.empty(len(lower), np.int64)
        at[np.concatenate([np.flatnonzero(letters), np.flatnonzero(pc.invert(letters))])] = np.arange(len(lower))
        pieces = pa.concat_arrays([one, mixed]).take(pa.array(at))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pieces), self.NEXT)[0].as_py()
        ids = np.array(self.core.encode_ordinary(joined + self.NEXT), np.int32)
        cut = ids == self.next_id
        size = np.zeros(len(words), np.int64)
        if safe.any():
            size[safe] = np.diff(np.flatnonzero(cut), prepend=-1) - 1
        ids = ids[~cut]
        if safe.all():
            return ids, size
        own = [np.array(e.ids, np.int32) for e in self.slow.encode_batch(words.filter(pa.array(~safe)).to_pylist(), add_special_tokens=False)]
        size[~safe] = [len(x) for x in own]
        out = np.empty(size.sum(), np.int32)
        from_safe = np.repeat(safe, size)
        out[from_safe], out[~from_safe] = ids, np.concatenate(own)
        return out, size

    def texts(self, column: pa.Array, block_bytes: int = 16 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Block by block of a string column: ids of distinct words, and for each of its words in order where its ids
        start there and how many they are, with the first word of each row (one value more than rows)."""
        at = 0
        column = column.fill_null("") if column.null_count else column
        sizes = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + block_bytes, "right")))
            lists = pc.ascii_split_whitespace(column.slice(at, to - at))
            coded = lists.flatten().dictionary_encode()
            ids, size = self.words(coded.dictionary)
            codes = coded.indices.to_numpy()
            yield ids, (np.cumsum(size) - size)[codes], size[codes], lists.offsets.to_numpy() - lists.offsets[0].as_py()
            at = to

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of every row of a string column; null is empty."""
        for ids, start, size, first in self.texts(column):
            ends = np.cumsum(size)
            all_ids = ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)]
            upto = np.concatenate([[0], ends])[first]
            yield from (all_ids[a:b] for a, b in zip(upto, upto[1:], strict=False))

    def counts(self, column: pa.Array) -> np.ndarray:
        """How many ids every row of a string column has; null has none."""
        out = [np.zeros(0, np.int64)]
        for _, _, size, first in self.texts(column):
            out.append(np.diff(np.concatenate([[0], np.cumsum(size)])[first]))
        return np.concatenate(out)


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def rank_file(path: str) -> dict[bytes, int]:
    """A ``.tiktoken`` file's ranks."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
