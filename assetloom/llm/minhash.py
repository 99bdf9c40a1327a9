"""Shingle hashes, MinHash signatures and band keys over flat arrays, shared by the near-duplicate operators.

Shingles of a batch are held as one flat array with offsets (sorted and distinct within each text), and every
step is a numpy operation over the whole batch.
"""

from __future__ import annotations

import numpy as np

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def coefficients(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and addends of n 64-bit hash functions."""
    raw = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    return raw[:n] | np.uint64(1), raw[n:]


def distinct(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's values sorted and without repeats, with the new sizes."""
    out = values.copy()
    ends = np.cumsum(sizes)
    for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
        out[a:b].sort()
    first = np.ones(len(out), dtype=bool)
    first[1:] = out[1:] != out[:-1]
    first[(ends - sizes)[sizes > 0]] = True
    kept = np.concatenate([[0], np.cumsum(first)])
    return out[first], kept[ends] - kept[ends - sizes]


def signatures(values: np.ndarray, sizes: np.ndarray, n: int, seed: int) -> np.ndarray:
    """MinHash matrix of shape (rows, n) in 32 bits; rows without values hold the largest value."""
    out = np.full((len(sizes), n), 0xFFFFFFFF, dtype=np.uint32)
    full = sizes > 0
    if not full.any():
        return out
    starts = (np.cumsum(sizes) - sizes)[full]
    a, b = coefficients(n, seed)
    for k in range(n):
        # The upper half of a multiply-add is a good 32-bit hash of an already mixed value.
        h = ((values * a[k] + b[k]) >> np.uint64(32)).astype(np.uint32)
        out[full, k] = np.minimum.reduceat(h, starts)
    return out


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """Keys of shape (texts, bands) as signed 64-bit integers; a band's number is part of its key."""
    n, k = signature.shape
    count = k // rows
    out = np.empty((n, count), dtype=np.int64)
    for b in range(count):
        h = np.full(n, (b + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        for r in range(rows):
            h = mixed(h ^ signature[:, b * rows + r].astype(np.uint64))
        out[:, b] = h.view(np.int64)
    return out
