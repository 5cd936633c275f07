"""Anchors of fixed-length windows: content-defined places that equal windows share."""

from __future__ import annotations

import numpy as np

from bidlake.llm.common import mixed

GRAM = 16  # bytes of the strings that anchors are chosen from
_BASE = 0x9E3779B97F4A7C15
_LOW = np.uint64(0xFFFFFFFF)
_WIDE, _NARROW = 0xD6E8FEB86659FD93, 1_398_269_437
_PRIME = np.uint64((1 << 31) - 1)
_TABLE = 4096


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of the ``gram`` bytes (a power of two) from every place on."""
    value = data.astype(np.uint64) + np.uint64(1)
    base, n = _BASE, 1
    while n < gram:
        value = value[:len(value) - n] * np.uint64(base) + value[n:] if len(value) > n else value[:0]
        base = base * base % (1 << 64)
        n *= 2
    return mixed(value)


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least value (by its upper 32 bits) in every run of ``width`` values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    values = (values & ~_LOW) | np.arange(len(values), dtype=np.uint64)  # equal values: the left place is less
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(values)] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[width - 1:width - 1 + n]) & _LOW).astype(np.int64)


def anchors(data: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window start, last window start, hash) of every anchor of the texts.

    Each window of ``window`` bytes inside a text belongs to exactly one anchor, the leftmost least
    gram in it; the windows of an anchor are consecutive.
    """
    empty = np.zeros(0, np.int64)
    if len(data) < window:
        return empty, empty, empty, np.zeros(0, np.uint64)
    hashes = gram_hashes(data)
    place = sliding_argmin(hashes, window - GRAM + 1)
    lengths = np.diff(starts)
    whole = np.zeros(len(place), bool)  # the window does not leave its text
    long_ = np.flatnonzero(lengths >= window)
    edge = np.zeros(len(place) + 1, np.int64)
    np.add.at(edge, starts[long_], 1)
    np.add.at(edge, starts[long_ + 1] - window + 1, -1)
    whole = np.cumsum(edge[:-1]) > 0
    at = np.flatnonzero(whole)
    if not len(at):
        return empty, empty, empty, np.zeros(0, np.uint64)
    p = place[at]
    new = np.ones(len(at), bool)
    new[1:] = (p[1:] != p[:-1]) | (at[1:] != at[:-1] + 1)
    # a text border between neighbouring windows also ends a run
    text = np.searchsorted(starts, at, side="right") - 1
    new[1:] |= text[1:] != text[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return text[first], at[first], at[last], hashes[p[first]]


def span_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of every data[begin:end], from running sums of two polynomials.

    Modulo a power of two alone, some long unlike strings agree under every odd base (the Thue-Morse
    word and its complement); the second polynomial is taken modulo a prime.
    """
    value = data.astype(np.uint64) + np.uint64(1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_powers(_WIDE, len(data)) * value, out=sums[1:])
    # divided by the power of the first place, so that equal bytes give equal values anywhere
    wide = (sums[ends] - sums[begins]) * _powers(pow(_WIDE, -1, 1 << 64), len(data) + 1)[begins]
    low, high = _prime_powers(_NARROW, len(data) + 1)
    terms = (high[:, None] * low % _PRIME).ravel()[:len(data)]
    np.cumsum(terms * value % _PRIME, out=sums[1:])  # below 2 ** 64 for any text
    low, high = _prime_powers(pow(_NARROW, -1, int(_PRIME)), len(data) + 1)
    at = begins.astype(np.int64)
    narrow = (sums[ends] - sums[begins]) % _PRIME * (high[at // _TABLE] * low[at % _TABLE] % _PRIME) % _PRIME
    return mixed(mixed(wide) * np.uint64(31) + narrow)


def _prime_powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** 0 ... base ** 4095 and every 4096th power modulo the prime, enough for n powers."""
    low = [1]
    for _ in range(_TABLE - 1):
        low.append(low[-1] * base % int(_PRIME))
    step, high = low[-1] * base % int(_PRIME), [1]
    for _ in range(n // _TABLE):
        high.append(high[-1] * step % int(_PRIME))
    return np.array(low, np.uint64), np.array(high, np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ..., n - 1 modulo 2 ** 64."""
    powers = np.full(n, base, np.uint64)
    powers[:1] = 1
    return np.multiply.accumulate(powers, out=powers)
