"""Words of texts as arrays of 64-bit hashes, and hashes of runs of words."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import held

#: Remembered words of a Python worker.
MEMO = 200_000
MASK = (1 << 64) - 1


class WordHashes(dict):
    """word -> 64-bit hash; emptied when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def split_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Maximal runs of bytes other than U+0020 and U+0009 to U+000D; ``lower`` maps A-Z only."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return (data.lower() if lower else data).split()


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(held("words", WordHashes).__getitem__, words), np.uint64, len(words))


def multipliers(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers, the same on every machine."""
    made = [xxhash.xxh3_64_intdigest(f"{seed}:{i}".encode()) | 1 for i in range(n)]
    return np.array(made, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of sums of products (a finalizer in the style of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_hashes(h: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """A hash of each run of ``len(factors)`` word hashes."""
    n = len(h) - len(factors) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i, f in enumerate(factors):
        total += h[i : i + n] * f
    return mix(total)
