r"""Hashes of words and word windows, for many texts at a time in numpy.

A word is a maximal run of bytes that are not separators, with A-Z in lower
case.  Its 64-bit hash is a polynomial over random numbers for the bytes, taken
from running sums, so no word is touched by Python code.  Equal words have equal
hashes; different ones collide with a chance of about 2^-60 a pair.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_U = np.uint64
SPACE = bytes([32, *range(9, 14)])
PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
SEGMENT = 1 << 19


def byte_table(separators: bytes) -> bytes:
    """For ``bytes.translate``: separators become spaces, A-Z become a-z."""
    return bytes(32 if c in separators else c + 32 if 65 <= c <= 90 else c for c in range(256))


@lru_cache(maxsize=4)
def _tables(separators: bytes, length: int) -> tuple[np.ndarray, ...]:
    rng = np.random.default_rng(20240229)
    per_byte = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
    lower = np.frombuffer(byte_table(separators), np.uint8)
    is_sep = np.zeros(256, bool)
    is_sep[list(separators)] = True
    base = int(rng.integers(1 << 40, 1 << 62)) * 2 + 1
    powers = np.full(length, base, np.uint64)
    inverse = np.full(length, pow(base, -1, 1 << 64), np.uint64)
    powers[0] = inverse[0] = 1
    return np.where(is_sep, _U(0), per_byte[lower]), is_sep, np.cumprod(powers), np.cumprod(inverse)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread a 64-bit number over all its bits (one to one)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(texts: list[bytes], separators: bytes = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of all texts, and where each text's words begin (one more for the end)."""
    gap = separators[:1]
    data = np.frombuffer(gap.join(texts) + gap, np.uint8)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    values, is_sep, _, _ = _tables(separators, 1)
    out, at = [], []
    a = 0
    while a < len(data):
        b = min(a + SEGMENT, len(data))
        if b < len(data):  # cut behind a separator
            back = np.flatnonzero(is_sep[data[a:b]])
            b = a + int(back[-1]) + 1 if len(back) else b + int(np.argmax(is_sep[data[b:]])) + 1
        part = data[a:b]
        _, _, powers, inverse = _tables(separators, max(SEGMENT, 1 << int(b - a - 1).bit_length()))
        sep = is_sep[part]
        before = np.concatenate(([True], sep[:-1]))
        starts = np.flatnonzero(~sep & before)
        ends = np.flatnonzero(sep & ~before)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values[part] * powers[: b - a])))
        out.append(mix((sums[ends] - sums[starts]) * inverse[starts]))
        at.append(starts + a)
        a = b
    hashes = np.concatenate(out) if out else np.empty(0, np.uint64)
    places = np.concatenate(at) if at else np.empty(0, np.int64)
    return hashes, np.searchsorted(places, bounds)


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of each window of ``size`` words, in order."""
    if len(words) < size:
        return np.empty(0, np.uint64)
    total = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        total = total * _U(0x9E3779B97F4A7C15) + words[i : len(words) - size + 1 + i]
    return mix(total)
