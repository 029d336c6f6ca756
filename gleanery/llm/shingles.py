"""Hashes of word windows in numpy, and what the similarity joins need of them."""

from __future__ import annotations

import numpy as np
import xxhash

CACHE_WORDS = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of words; a worker remembers those of frequent words."""

    def __init__(self, lower: bool) -> None:
        self.lower, self.known = lower, {}

    def words(self, text: str) -> list[bytes]:
        """Runs of anything but blank, tab, \\n, \\v, \\f and \\r; bytes are split, and lower-cased, as ASCII only."""
        raw = text.encode()
        return (raw.lower() if self.lower else raw).split()

    def hashes(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        except KeyError:
            if len(known) > CACHE_WORDS:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def windows(hashes: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """A hash for each run of width words, in order: a weighted sum of the words' hashes with odd weights, mixed."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    odd = mix(np.arange(1, width + 1, dtype=np.uint64) + np.uint64(1000 * seed)) | np.uint64(1)
    with np.errstate(over="ignore"):
        out = hashes[:n] * odd[0] + np.uint64(width)
        for j in range(1, width):
            out += hashes[j : j + n] * odd[j]
        return mix(out)


def shingle_set(hashes: np.ndarray, width: int) -> np.ndarray:
    """Distinct hashes of the shingles of a text, sorted; a shorter text is one shingle, a text without words none."""
    if not len(hashes):
        return np.zeros(0, dtype=np.uint64)
    return np.unique(windows(hashes, min(width, len(hashes))))


def fingerprint(shingles: np.ndarray) -> int:
    """A hash of a sorted set, as a signed 64-bit number."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)
