"""Words and word shingles of one text, as hashes; the helpers that run inside Arrow tasks."""

from __future__ import annotations

import numpy as np
import xxhash

# Odd multipliers of the position mix.
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.uint64(0xD6E8FEB86659FD93)


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the whole text in UTF-8, with A-Z in lower case."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    """One 64-bit hash per word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _FOLD
    return x ^ (x >> np.uint64(29))


def shingle_hashes(words: list[bytes], size: int = 5) -> np.ndarray:
    """The sorted set of hashes of the ``size``-word shingles; fewer words count as one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    hashes = word_hashes(words)
    width = min(size, len(words))
    count = len(words) - width + 1
    mixed = np.full(count, width, np.uint64)
    for j in range(width):
        mixed = _scramble((mixed ^ hashes[j : j + count]) * _MIX)
    return np.unique(mixed)
