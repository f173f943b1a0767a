"""Hashed byte n-grams of whole texts, for the classifiers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tidepanel.llm.shared import ALNUM_TABLE, Words, byte_table

#: Letters only: digits and punctuation become blanks, A-Z lower case.
LETTER_TABLE = byte_table(bytes(b for b in range(128) if not (97 <= b <= 122 or 65 <= b <= 90)))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def gram_buckets(data: np.ndarray, edge: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, bucket) of every run of n bytes inside one text whose inner
    bytes are not blanks; the first and the last may be one."""
    m = len(data) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    value = np.full(m, n, np.uint64)
    good = np.ones(m, bool)
    for k in range(n):
        value = (value << np.uint64(8)) | data[k : m + k].astype(np.uint64)
        if 0 < k < n - 1:
            good &= data[k : m + k] != 0x20
    for k in range(1, n):
        crossing = edge[1:-1] - k
        good[crossing[(crossing >= 0) & (crossing < m)]] = False
    at = np.flatnonzero(good)
    return at, ((value[at] * _ODD) >> np.uint64(64 - bits)).astype(np.int64)


def word_buckets(words: Words, bits: int) -> np.ndarray:
    return (words.hashes() >> np.uint64(64 - bits)).astype(np.int64)


def text_of(at: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """The text that each position lies in (positions ascend)."""
    return np.repeat(np.arange(len(edge) - 1), np.diff(np.searchsorted(at, edge)))


class Scan:
    """A batch of texts, translated once for word and n-gram features."""

    def __init__(self, texts: pa.Array, table: bytes = ALNUM_TABLE):
        self.words = Words(texts, table)
        self.data, self.edge = self.words.data, self.words.edge
        self.texts = len(texts)
