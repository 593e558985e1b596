"""A sorted-string table: one file of keyed values, built once, read by key.

Layout::

    magic
    blocks      zstd; entries (shared, unshared, value size as varints, key tail, value),
                keys ascending and prefix-compressed against the one before
    index       for each block: first key, offset, size, CRC-32, entries, units before it
    Bloom       bits of all keys, double hashing
    footer      fixed size: places of index and Bloom filter, totals, magic

``units`` is a running total that the caller defines (token IDs here), so a block
can be placed in the whole without reading those before it.  A reader needs the
footer, index and filter, then one block for each lookup.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import xxhash
import zstandard

MAGIC = b"LGSST\x00\x01\n"
_FOOTER = struct.Struct("<QQQQIQQI8s")  # index at, size; Bloom at, size; hashes; entries; units; CRC of the index; magic
_INDEX = struct.Struct("<HQIIIQ")  # key size; offset; size; CRC; entries; units before


def key_of(value: object) -> bytes:
    """Order-keeping bytes of an identifier: null, then integers, or strings in UTF-8 order."""
    if value is None:
        return b""
    if isinstance(value, str):
        return b"s" + value.encode("utf-8", "surrogatepass")
    return b"i" + ((int(value) + (1 << 63)) & ((1 << 64) - 1)).to_bytes(8, "big")


def value_of(key: bytes) -> object:
    """The identifier that ``key_of`` made a key of."""
    if not key:
        return None
    return key[1:].decode("utf-8", "surrogatepass") if key[:1] == b"s" else int.from_bytes(key[1:], "big") - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bits(hashes: np.ndarray, m: int, k: int) -> np.ndarray:
    """Filter positions: one row of ``k`` for each 64-bit hash."""
    a, b = hashes & np.uint64(0xFFFFFFFF), hashes >> np.uint64(32) | np.uint64(1)
    return (a[:, None] + np.arange(k, dtype=np.uint64)[None, :] * b[:, None]) % np.uint64(m)


class Writer:
    """Appends entries in key order to a binary stream; holds one block, the index and a hash of each key."""

    def __init__(self, out, block_bytes: int = 1 << 18, bits_per_key: int = 10):
        self.out, self.block_bytes, self.bits_per_key = out, block_bytes, bits_per_key
        self.at = out.write(MAGIC) or len(MAGIC)
        self.index: list[bytes] = []
        self.hashes = array("Q")
        self.lowest = b""
        self.units = self.entries = self.units_before = self.held = 0
        self.parts: list[bytes] = []
        self.size = 0
        self.first = self.last = b""
        self.pack = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, value: bytes, units: int) -> None:
        if self.entries and key < self.last:
            raise ValueError("keys must ascend")
        if not self.entries:
            self.lowest = key
        shared = 0
        if self.held:
            top = min(len(key), len(self.last))
            while shared < top and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first, self.units_before = key, self.units
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:]
        self.parts += (entry, value)
        self.size += len(entry) + len(value)
        self.hashes.append(xxhash.xxh64_intdigest(key))
        self.last = key
        self.held += 1
        self.entries += 1
        self.units += units
        if self.size >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            block = self.pack.compress(b"".join(self.parts))
            self.index.append(_INDEX.pack(len(self.first), self.at, len(block), zlib.crc32(block), self.held, self.units_before) + self.first)
            self.out.write(block)
            self.at += len(block)
            self.parts, self.size, self.held = [], 0, 0

    def close(self) -> None:
        self._flush()
        index = zstandard.compress(b"".join(self.index))
        k = max(1, round(self.bits_per_key * 0.69))
        m = max(64, self.bits_per_key * len(self.hashes) + 7 & ~7)
        bits = np.zeros(m, np.uint8)
        for i in range(0, len(self.hashes), 1 << 16):
            bits[_bits(np.frombuffer(self.hashes[i : i + (1 << 16)], np.uint64), m, k)] = 1
        bloom = np.packbits(bits).tobytes()
        self.out.write(index + bloom)
        self.out.write(_FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), k, self.entries, self.units, zlib.crc32(index), MAGIC))


class Reader:
    """Reads a table from a random-access file (``size()``, ``read_at(n, offset)``)."""

    def __init__(self, file):
        self.file = file
        end = file.size()
        at, size, bloom_at, bloom_size, self.k, self.entries, self.units, crc, magic = _FOOTER.unpack(file.read_at(_FOOTER.size, end - _FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a table of this format")
        packed = file.read_at(size, at)
        if zlib.crc32(packed) != crc:
            raise ValueError("the index is damaged")
        data = zstandard.decompress(packed)
        self.blocks: list[tuple[bytes, int, int, int, int, int]] = []
        i = 0
        while i < len(data):
            n, *rest = _INDEX.unpack_from(data, i)
            i += _INDEX.size
            self.blocks.append((data[i : i + n], *rest))
            i += n
        self.firsts = [b[0] for b in self.blocks]
        self.bloom = np.frombuffer(file.read_at(bloom_size, bloom_at), np.uint8)

    def block(self, n: int) -> Iterator[tuple[bytes, bytes]]:
        """The entries of one block."""
        _, at, size, crc, entries, _ = self.blocks[n]
        packed = self.file.read_at(size, at)
        if zlib.crc32(packed) != crc:
            raise ValueError(f"block {n} is damaged")
        data = zstandard.decompress(packed)
        key, i = b"", 0
        for _ in range(entries):
            shared, i = _read_varint(data, i)
            tail, i = _read_varint(data, i)
            size, i = _read_varint(data, i)
            key = key[:shared] + data[i : i + tail]
            yield key, data[i + tail : i + tail + size]
            i += tail + size

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for n in range(len(self.blocks)):
            yield from self.block(n)

    def may_hold(self, key: bytes) -> bool:
        """False only if the key is not in the table."""
        at = _bits(np.array([xxhash.xxh64_intdigest(key)], np.uint64), len(self.bloom) * 8, self.k)[0].astype(np.int64)
        return bool((self.bloom[at >> 3] >> (7 - (at & 7)) & 1).all())

    def get(self, key: bytes) -> list[bytes]:
        """All values of a key, by the filter, a binary search of the index, and the blocks it can be in."""
        out: list[bytes] = []
        if self.may_hold(key):
            n = max(0, bisect.bisect_left(self.firsts, key) - 1)  # equal keys may begin in the block before
            while n < len(self.blocks) and self.firsts[n] <= key:
                out += [v for k, v in self.block(n) if k == key]
                n += 1
        return out
