"""Word shingles as 64-bit numbers, computed from word hashes in numpy."""

from __future__ import annotations

import numpy as np

def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _multipliers(width: int) -> np.ndarray:
    """Odd numbers without a pattern: from an arithmetic progression, words that change places in mirrored order would give the same sum."""
    return mix(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def rolling(words: np.ndarray, width: int) -> np.ndarray:
    """A number for each window of ``width`` words (uint64 hashes); none if there are fewer words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j, m in enumerate(_multipliers(width)):
        out += words[j : j + n] * m
    return mix(out)


def shingle_set(words: np.ndarray, width: int = 5) -> np.ndarray:
    """The distinct shingles, ascending; a shorter text is one shingle; no words: none."""
    if len(words) == 0:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return mix(rolling(words, len(words)) + np.uint64(len(words)))
    return np.unique(rolling(words, width))


def needed(n, percent: int):
    """The least overlap that a set of n needs with any set to reach the similarity."""
    return -((-percent * n) // 100)
