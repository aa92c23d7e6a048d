"""CRC-32 of concatenations from the checksums of their parts, for whole arrays.

``crc(a + b)`` is ``shift(crc(a), len(b)) ^ crc(b)``, where ``shift`` appends zero bytes: a linear map of the 32 bits. Maps for
short lengths are kept as four tables of 256 numbers each, longer ones are composed from powers of two.
"""

from __future__ import annotations

import numpy as np

POLYNOMIAL = 0xEDB88320  # fixed value: the reflected polynomial of CRC-32
_SHORT = 256


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(POLYNOMIAL), table >> 1)
    return table


def _through(tables: np.ndarray, value: np.ndarray) -> np.ndarray:
    """One linear map (4 x 256) applied to numbers."""
    return tables[0][value & 255] ^ tables[1][value >> 8 & 255] ^ tables[2][value >> 16 & 255] ^ tables[3][value >> 24]


def _maps() -> tuple[np.ndarray, list[np.ndarray]]:
    byte = _byte_table()
    short = np.empty((_SHORT, 4, 256), np.uint32)
    short[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, _SHORT):
        short[n] = byte[short[n - 1] & 255] ^ short[n - 1] >> 8
    powers = [short[1]]
    for _ in range(40):
        powers.append(_through(powers[-1], powers[-1]))
    return short.reshape(-1), powers


_FLAT, _POWERS = _maps()


def shift(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Checksums after ``length`` zero bytes each, without the change that the zero bytes' own checksum makes."""
    crc = np.asarray(crc, np.uint32)
    length = np.asarray(length, np.int64)
    at = np.minimum(length, _SHORT - 1) << 10
    out = _FLAT[at + (crc & 255)] ^ _FLAT[at + 256 + (crc >> 8 & 255)] ^ _FLAT[at + 512 + (crc >> 16 & 255)] ^ _FLAT[at + 768 + (crc >> 24)]
    far = np.flatnonzero(length >= _SHORT)
    if len(far):
        value, left = crc[far], length[far]
        for bit in range(int(left.max()).bit_length()):
            value = np.where(left >> bit & 1, _through(_POWERS[bit], value), value)
        out[far] = value
    return out


def joined(crc: np.ndarray, after: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Checksums of a + b from those of a and b and the number of bytes of b."""
    return shift(crc, length) ^ np.asarray(after, np.uint32)
