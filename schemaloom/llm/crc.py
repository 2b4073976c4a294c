"""CRC-32 as algebra over GF(2): the checksum of joined byte strings from the checksums of the parts.

Appending k zero bytes to a string changes its CRC-32 by a linear map, the k-th power of a 32 x 32 bit matrix. So
crc(a + b) = shift(crc(a), len(b)) ^ crc(b), for whole arrays of strings at once and without the strings.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa


def _lookup(images: np.ndarray) -> np.ndarray:
    """A matrix, given by the images of the 32 bits, as one table for each byte of its argument."""
    table = np.zeros((4, 256), np.uint32)
    for bit in range(32):
        j, k = divmod(bit, 8)
        table[j, 1 << k : 2 << k] = table[j, : 1 << k] ^ images[bit]
    return table


def _apply(table: np.ndarray, v: np.ndarray) -> np.ndarray:
    return table[0][v & 255] ^ table[1][v >> 8 & 255] ^ table[2][v >> 16 & 255] ^ table[3][v >> 24]


def _powers() -> list[np.ndarray]:
    """The matrices of 1, 2, 4, ... zero bytes."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    step = np.array([zlib.crc32(b"\0" * 4 + bytes([i])) ^ zlib.crc32(b"\0" * 5) for i in range(256)], np.uint32)  # of one byte
    images = step[bits & 255] ^ bits >> np.uint32(8)
    out = []
    for _ in range(40):
        out.append(_lookup(images))
        images = _apply(out[-1], images)
    return out


_POWERS = _powers()


def shift(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The checksums' share in longer strings: what each becomes when ``length`` bytes follow."""
    crc, length = crc.astype(np.uint32), np.asarray(length, np.int64)
    top = int(length.max(initial=0))
    for k in range(top.bit_length()):
        at = np.flatnonzero(length >> k & 1)
        crc[at] = _apply(_POWERS[k], crc[at])
    return crc


def joined(a: np.ndarray, b: np.ndarray, length_b: np.ndarray) -> np.ndarray:
    """The checksums of a + b from those of a and b and the bytes of b."""
    return shift(a, length_b) ^ b


def of_strings(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(checksum of the UTF-8 bytes, number of bytes) of each string."""
    raw = [s.encode() for s in strings.to_pylist()]
    return np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw)), np.fromiter(map(len, raw), np.int64, len(raw))
