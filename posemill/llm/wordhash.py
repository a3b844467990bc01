"""Words and word n-grams of a text as 64-bit hashes, computed over whole byte arrays with numpy.

A word is a run of bytes other than space and 0x09-0x0D. Hashes depend on nothing but the word's bytes, so they agree
between executors and runs.
"""

from __future__ import annotations

import hashlib

import numpy as np

#: Words of more bytes are hashed one by one.
LONG_WORD = 256
_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_GRAM = _RANDOM.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_POWERS = np.cumprod(np.full(1 << 12, 0x9E3779B97F4A7C15, np.uint64))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = np.cumprod(np.full(max(n, 2 * len(_POWERS)), 0x9E3779B97F4A7C15, np.uint64))
    return _POWERS


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) of every word in an array of bytes."""
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = ~_BLANK[data]
    step = np.diff(solid)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(text: bytes) -> np.ndarray:
    data = np.frombuffer(text, np.uint8)
    starts, ends = word_bounds(data)
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    inside = np.flatnonzero(~_BLANK[data])
    place = inside - np.repeat(starts, size)
    value = _BYTE[data[inside]] * _powers(int(size.max()))[place]
    first = np.cumsum(size) - size
    out = mixed(np.add.reduceat(value, first))
    for i in np.flatnonzero(size > LONG_WORD):  # a polynomial with a fixed base has known collisions in long words
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n words, in order; none if there are fewer."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for j in range(n):
        out += words[j:j + count] * _GRAM[j]
    return mixed(out)


def shingle_set(text: bytes, n: int = 5) -> np.ndarray:
    """The distinct n-word shingles, ascending; with 1 to n - 1 words the whole sequence is one shingle."""
    words = word_hashes(text)
    if not len(words):
        return words
    return np.unique(gram_hashes(words, min(n, len(words))))
