"""Hashed word shingles of whole texts, for whole Arrow batches at a time."""

from __future__ import annotations

import numpy as np
import xxhash

from labelloom.llm.memories import remembered

SHINGLE = 5
_MAX_WORDS = 500_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                     0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB,
                     0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mixed_bits(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, remembered up to a bound."""
    known = remembered("word hashes", _WordHashes)
    if len(known) > _MAX_WORDS:
        known.clear()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash per window of ``width`` words; a shorter sequence is one window."""
    n = len(hashes)
    if n == 0:
        return hashes
    size = min(n, width)
    total = np.zeros(n - size + 1, np.uint64)
    for i in range(size):
        total += hashes[i:n - size + 1 + i] * _FACTORS[i]
    return mixed_bits(total + np.uint64(size))


def window_hashes(hashes: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """What ``windows`` gives for the windows at some starts, each of ``width`` words."""
    total = np.zeros(len(starts), np.uint64)
    for i in range(width):
        total += hashes[starts + i] * _FACTORS[i]
    return mixed_bits(total + np.uint64(width))


def lowered_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct shingles of a text, sorted."""
    return np.unique(windows(word_hashes(lowered_words(text)), SHINGLE))
