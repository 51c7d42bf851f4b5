"""Arrow-native tokenising shared by the text operators: no Python loop runs over tokens."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

NOT_WORD = r"[^\p{L}\p{M}\p{N}\s]+"


def slices(batch: pa.RecordBatch, column: int, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Row ranges of ``batch`` of about ``max_bytes`` of text each (a longer text gets its own)."""
    n = batch.num_rows
    if not n:
        return
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    part = (np.cumsum(lengths) - 1) // max_bytes
    starts = np.flatnonzero(np.diff(part, prepend=part[0] - 1))
    for a, b in zip(starts, [*starts[1:], n], strict=True):
        yield batch.slice(int(a), int(b - a))


def plain(column: pa.Array) -> pa.Array:
    """``column`` as a string array with 32-bit offsets starting at 0 and no nulls."""
    return pc.fill_null(column.cast(pa.string()) if column.type != pa.string() else column, "")


class Words:
    """Tokens of a string array: ``codes`` into ``dictionary``, and ``doc`` as the row of each token."""

    def __init__(self, texts: pa.Array):
        lists = pc.utf8_split_whitespace(texts)
        flat = lists.flatten()
        encoded = flat.dictionary_encode()
        self.rows = len(texts)
        self.dictionary: pa.Array = encoded.dictionary
        codes = encoded.indices.to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(self.rows, dtype=np.int64), np.asarray(pc.list_value_length(lists)))
        empty = pc.index_in(pa.scalar("", pa.string()), value_set=self.dictionary).as_py() if len(self.dictionary) else None
        if empty is not None:  # from white space at either end
            keep = codes != empty
            codes, doc = codes[keep], doc[keep]
        self.codes, self.doc = codes, doc


def fold(texts: pa.Array) -> pa.Array:
    """Lower case, character by character, with one form of the Greek sigma: equal on a whole text and on its words."""
    return pc.replace_substring(pc.utf8_lower(texts), "\u03c2", "\u03c3")


def normal_words(texts: pa.Array) -> Words:
    """Folded runs of letters, marks and digits."""
    return Words(pc.replace_substring_regex(fold(texts), NOT_WORD, " "))


@lru_cache(maxsize=1)
def word_pattern() -> re.Pattern:
    """Python's pattern for the runs that ``normal_words`` finds: characters whose folded form the same engine takes for word ones."""
    ranges: list[list[int]] = []
    for low in range(0, sys.maxunicode + 1, 1 << 11):  # a block at a time, to hold little
        if 0xD800 <= low <= 0xDFFF:
            continue  # surrogates
        word = np.asarray(pc.match_substring_regex(fold(pa.array(map(chr, range(low, low + (1 << 11))), pa.string())), r"[\p{L}\p{M}\p{N}]"))
        for c in (np.flatnonzero(word) + low).tolist():
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]+")


def folded(words: list[str]) -> list[str]:
    return fold(pa.array(words, pa.string())).to_pylist()


def mix64(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit function of each 64-bit value."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_words(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string, the same in every process."""
    from pandas.util import hash_array

    return hash_array(words.to_numpy(zero_copy_only=False), categorize=False) if len(words) else np.zeros(0, np.uint64)
