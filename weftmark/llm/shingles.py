"""Sets of hashed word shingles, computed with numpy from whole texts."""

from __future__ import annotations

import numpy as np
import xxhash

EMPTY = np.zeros(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_FACTORS = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


class _Words(dict):
    """Hashes of words; starts afresh when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_hash = _Words().__getitem__


def word_hashes(text: str) -> np.ndarray:
    """One 64-bit hash for each word, A-Z read as a-z."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # ASCII letters and white space alone
    return np.fromiter(map(_hash, words), np.uint64, len(words))


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted distinct hashes of the ``width``-word shingles; of fewer words, of the whole sequence; none for none."""
    words = word_hashes(text or "")
    n = len(words)
    if not n:
        return EMPTY
    size = min(width, n)
    out = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        out += words[k : n - size + 1 + k] * _FACTORS[k]
    out = mix(out + np.uint64(size))
    out.sort()
    return out[np.append(True, out[1:] != out[:-1])]


def set_id(hashes: np.ndarray) -> int:
    """A signed 64-bit fingerprint of the set."""
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)
