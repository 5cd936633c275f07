"""Word shingles of whole texts as 64-bit tokens."""

from __future__ import annotations

import numpy as np

from bidlake.llm.anchors import span_hashes
from bidlake.llm.common import mixed, words_of

SHINGLE = 5
_WORD_BYTES = np.ones(256, bool)
_WORD_BYTES[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def shingle_sets(data: np.ndarray, starts: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, size of each text's set): per text the distinct ``shingle``-word tokens, ascending.

    A-Z is lower-cased; a text with fewer words is one token of all of them; one without words has
    none.
    """
    data = _LOWER[data]
    begins, ends, text = words_of(data, starts, _WORD_BYTES)
    n = len(starts) - 1
    if not len(begins):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    word = span_hashes(data, begins, ends)
    count = np.bincount(text, minlength=n)
    first = np.cumsum(count) - count
    token, owner = [], []
    full = len(word) - shingle + 1
    if full > 0:
        value = np.zeros(full, np.uint64)
        for k in range(shingle):
            value = mixed(value * np.uint64(0x9E3779B97F4A7C15) + word[k:full + k] + np.uint64(k + 1))
        inside = text[:full] == text[shingle - 1:]
        token.append(value[inside])
        owner.append(text[:full][inside])
    short = np.flatnonzero((count > 0) & (count < shingle))
    for size in range(1, shingle):
        rows = short[count[short] == size]
        value = np.full(len(rows), size << 32, np.uint64)
        for k in range(size):
            value = mixed(value * np.uint64(0x9E3779B97F4A7C15) + word[first[rows] + k] + np.uint64(k + 1))
        token.append(value)
        owner.append(rows)
    token, owner = np.concatenate(token), np.concatenate(owner)
    order = np.lexsort((token, owner))
    token, owner = token[order], owner[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
    return token[new], np.bincount(owner[new], minlength=n)
