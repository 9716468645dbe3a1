"""64-bit hashes of words and word runs, computed over whole arrays of bytes."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240229)
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the base, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        more = np.full(max(n, 2 * len(_powers), 1 << 12), _BASE, np.uint64)
        more[0] = 1
        _powers = np.multiply.accumulate(more)
    return _powers[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX[0]
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX[1]
    return x ^ (x >> np.uint64(33))


def words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs without space and control bytes 9 to 13."""
    gap = _SPACE[np.frombuffer(raw, np.uint8)]
    edges = np.diff(np.concatenate(([1], gap.view(np.int8), [1])))
    return np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)


def word_hashes(raw: bytes, block: int = 1 << 20) -> np.ndarray:
    """One hash for each word, in order. Works in blocks of words of about ``block`` bytes."""
    starts, ends = words(raw)
    data, out = np.frombuffer(raw, np.uint8), np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + block, "right")))
        s, e = starts[at:to], ends[at:to]
        lengths = e - s
        begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        place = np.arange(int(lengths.sum())) - np.repeat(begin, lengths)
        value = BYTE[data[place + np.repeat(s, lengths)]] * powers(int(lengths.max()))[place]
        out[at:to] = mix(np.add.reduceat(value, begin) + lengths.astype(np.uint64))
        at = to
    return out


def shingles(raw: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``n`` words; of the whole sequence if it is shorter; none without words."""
    h = word_hashes(raw)
    if not len(h):
        return h
    n = min(n, len(h))
    x = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        x = mix(x * np.uint64(_BASE) + h[k : len(h) - n + 1 + k])
    return np.unique(x)
