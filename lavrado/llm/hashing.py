"""Vectorised 64-bit hashes of words and byte strings, alike on every machine."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64; the longest so far is kept."""
    if len(_POWERS.get(base, ())) < n:
        x = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        x[0] = 1
        _POWERS[base] = np.multiply.accumulate(x)
    return _POWERS[base][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sums(data: np.ndarray) -> np.ndarray:
    """Sums of value(byte) * base**place before each place."""
    values = mixed(np.arange(1, 257, dtype=np.uint64))
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values[data] * _powers(_BASE, len(data)), out=out[1:])
    return out


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of data[start:end] for each span."""
    sums = _sums(data)
    return mixed((sums[ends] - sums[starts]) * _powers(_INVERSE, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))


def rolling(data: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k bytes in a row."""
    if len(data) < k:
        return np.zeros(0, dtype=np.uint64)
    sums = _sums(data)
    return mixed((sums[k:] - sums[:-k]) * _powers(_INVERSE, len(data) + 1)[: len(data) - k + 1])
