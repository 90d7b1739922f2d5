"""Word shingles as sorted 64-bit fingerprints, and MinHash values of them."""

from __future__ import annotations

import hashlib
import re

import numpy as np

WORDS = 5
_FIND = re.compile(r"\w+").findall
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_POWERS = [np.uint64(pow(0xD6E8FEB86659FD93, k, 1 << 64)) for k in range(WORDS + 1)]


class _Fingerprints(dict):
    """Word -> 64-bit fingerprint, remembered."""

    def __missing__(self, word: str) -> int:
        value = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), "little")
        if len(word) <= 40:
            if len(self) > 400_000:
                self.clear()
            self[word] = value
        return value


_known = _Fingerprints()
forget = _known.clear


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and underscores."""
    return _FIND((text or "").lower())


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX
    h = (h ^ (h >> np.uint64(27))) * _STEP
    return h ^ (h >> np.uint64(31))


def in_order(words: list[str], width: int = WORDS) -> np.ndarray:
    """Fingerprints of the shingles at each word; fewer words than a shingle has make one shingle, no words none."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))
    if len(words) < width:
        total = (h * np.array(_POWERS[1 : len(words) + 1])).sum(keepdims=True)
        return _mixed(total + np.uint64(len(words)))
    n = len(words) - width + 1
    total = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        total += h[k : k + n] * _POWERS[k + 1]
    return _mixed(total)


def shingle_set(text: str | None, width: int = WORDS) -> np.ndarray:
    return np.unique(in_order(words_of(text), width))


class MinHash:
    """``count`` hash functions over 64-bit fingerprints, from a seed."""

    def __init__(self, count: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.salts = rng.integers(0, 1 << 63, size=(count, 1), dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, size=(count, 1), dtype=np.uint64)
        self.factors = rng.integers(0, 1 << 63, size=(count, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def values(self, h: np.ndarray) -> np.ndarray:
        """Hash values, one row per function."""
        v = (h ^ self.salts) * self.factors
        return v ^ (v >> np.uint64(32))

    def minima(self, h: np.ndarray, step: int = 1024) -> np.ndarray:
        """Smallest value of each function over the whole set."""
        low = np.full(len(self.salts), ~np.uint64(0))
        for at in range(0, len(h), step):
            np.minimum(low, self.values(h[at : at + step]).min(axis=1), out=low)
        return low
