"""Words of whole texts and their 64-bit hashes, for operators on word n-grams.

A word is a run of characters other than space and tab to carriage return; A-Z are
lower-cased. All of a batch's words are hashed at once from their bytes, eight at a
time; nothing is remembered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tarn.llm.common import mix64
from tarn.llm.tokens import flat_bytes

STEP = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [2**64 - 1], np.uint64)


def spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of the texts raw[offsets[i]:offsets[i + 1]] begins and ends."""
    edges = np.zeros(len(raw) + 1, bool)
    edges[offsets] = True
    word = _WORD[raw]
    begin, end = word.copy(), word.copy()
    begin[1:] &= ~word[:-1] | edges[1:-1]
    end[:-1] &= ~word[1:] | edges[1:-1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words in turn, and how many each text has."""
    starts, ends = spans(raw, offsets)
    counts = np.diff(np.searchsorted(starts, offsets))
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = _LOWER[raw]
    eight = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    left = ends - starts
    out = mix64(left.astype(np.uint64) * STEP)
    active, at = np.arange(len(starts)), starts
    with np.errstate(over="ignore"):
        while len(active):
            part = eight[at] & _MASK[np.minimum(left, 8)]
            out[active] = mix64((out[active] ^ part) * STEP + np.uint64(1))
            more = left > 8
            active, at, left = active[more], at[more] + 8, left[more] - 8
    return out, counts


def column_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """word_hashes() of a string or binary array without nulls."""
    return word_hashes(*flat_bytes(texts))


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams in order, by position of their first word."""
    size = max(0, len(hashes) - n + 1)
    out = np.zeros(size, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = mix64(out * STEP + hashes[i : i + size] + np.uint64(i))
    return out
