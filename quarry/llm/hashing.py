"""Word bounds and 64-bit hashes of many spans of a text slice at once (numpy)."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Scatters 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        _POWERS[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, dtype=np.uint64)]) for b in (BASE, INVERSE)]
    return _POWERS[0][:n], _POWERS[1][:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Hash of values[start:stop] of every span: a polynomial over scattered values modulo 2 ** 64,
    from running sums, with the length mixed in. Equal spans have equal hashes wherever they stand."""
    up, down = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(mix(values.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    h = (sums[stops] - sums[starts]) * down[starts]
    return mix(h ^ mix((stops - starts).astype(np.uint64)))


def ascii_space(cps: np.ndarray) -> np.ndarray:
    return (cps == 32) | ((cps >= 9) & (cps <= 13))


def word_bounds(cps: np.ndarray, bounds: np.ndarray, space: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, row) of every run without ``space`` (default: ASCII white space) within a row."""
    word = ~(ascii_space(cps) if space is None else space)
    before, after = np.zeros(len(word), dtype=bool), np.zeros(len(word), dtype=bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    full = bounds[:-1] < bounds[1:]
    before[bounds[:-1][full]] = False
    after[bounds[1:][full] - 1] = False
    starts, stops = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return starts, stops, np.searchsorted(bounds, starts, "right") - 1
