"""MD5 of numbered names, many at a time: the hashes whose order is a permutation."""

from __future__ import annotations

import hashlib
import math

import numpy as np

_SINES = [int(abs(math.sin(r + 1)) * 2**32) for r in range(64)]
_TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Hashes made at once: words of so many stay in the nearest cache.
_AT_ONCE = 4096


def _compress(words: list) -> list[np.ndarray]:
    """The four words of MD5 over one block each; words are numbers, or arrays where messages differ."""
    size = max(len(w) for w in words if isinstance(w, np.ndarray))
    a, b, c, d = (np.full(size, v, np.uint32) for v in _START)
    for r in range(64):
        if r < 16:
            f, g = d ^ (b & (c ^ d)), r
        elif r < 32:
            f, g = c ^ (d & (b ^ c)), (5 * r + 1) % 16
        elif r < 48:
            f, g = b ^ c ^ d, (3 * r + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * r % 16
        f += a
        if isinstance(words[g], np.ndarray):
            f += words[g]
            f += np.uint32(_SINES[r])
        else:
            f += np.uint32((_SINES[r] + words[g]) % 2**32)
        turned = f >> np.uint32(32 - _TURNS[r])
        f <<= np.uint32(_TURNS[r])
        f |= turned
        f += b
        a, b, c, d = d, f, b, c
    return [w + np.uint32(s) for w, s in zip((a, b, c, d), _START, strict=True)]


def md5_numbered(prefix: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The upper and lower halves of md5(prefix + i) for all i below ``n``, as big-endian numbers."""
    head = prefix.encode()
    if len(head) + len(str(n)) > 55:  # more than one block
        keys = b"".join(hashlib.md5(head + str(i).encode()).digest() for i in range(n))
        high, low = np.frombuffer(keys, ">u8").reshape(-1, 2).T.astype(np.uint64)
        return high, low
    out = np.empty((n, 4), ">u4")
    first, digits = 0, 1
    while first < n:
        message = head + bytes(digits) + b"\x80"
        message += bytes(56 - len(message)) + (8 * (len(head) + digits)).to_bytes(8, "little")
        plain = [int.from_bytes(message[k : k + 4], "little") for k in range(0, 64, 4)]
        end = min(n, 10**digits)
        for at in range(first, end, _AT_ONCE):
            left = np.arange(at, min(end, at + _AT_ONCE), dtype=np.uint32)
            rows = slice(at, at + len(left))
            words: list = list(plain)
            for place in reversed(range(len(head), len(head) + digits)):
                left, digit = np.divmod(left, np.uint32(10))
                words[place // 4] = words[place // 4] + ((digit + np.uint32(48)) << np.uint32(8 * (place % 4)))
            for k, w in enumerate(_compress([w if isinstance(w, np.ndarray) else int(w) for w in words])):
                out[rows, k] = w.byteswap()
        first, digits = end, digits + 1
    high, low = out.view(">u8").T.astype(np.uint64)
    return high, low
