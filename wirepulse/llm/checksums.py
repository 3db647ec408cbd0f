"""CRC-32C (Castagnoli) of many byte ranges side by side, and its masked form in record files."""

from __future__ import annotations

import numpy as np

_POLYNOMIAL = np.uint32(0x82F63B78)


def _tables() -> np.ndarray:
    """Tables for eight bytes a step: row k is a byte followed by k zero bytes."""
    first = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        first = np.where(first & 1, (first >> np.uint32(1)) ^ _POLYNOMIAL, first >> np.uint32(1))
    rows = [first]
    for _ in range(7):
        rows.append((rows[-1] >> np.uint32(8)) ^ first[rows[-1] & 255])
    return np.array(rows)


_T = _tables()


_BLOCK = 64


def _after_zeros(crc: np.ndarray, n: int) -> np.ndarray:
    """The register after ``n`` zero bytes."""
    for _ in range(n):
        crc = (crc >> np.uint32(8)) ^ _T[0][crc & 255]
    return crc


# The register after a block of zero bytes is a sum over the register's own four bytes.
_SKIP = np.array([_after_zeros(np.arange(256, dtype=np.uint32) << np.uint32(8 * k), _BLOCK) for k in range(4)])


def _blocks_of(padded: np.ndarray) -> np.ndarray:
    """CRC of each block from a zero register, all blocks side by side, eight bytes a step."""
    words = padded.view("<u4").reshape(-1, _BLOCK // 4)
    crc = np.zeros(len(words), np.uint32)
    for i in range(0, _BLOCK // 4, 2):
        low, high = words[:, i] ^ crc, words[:, i + 1]
        crc = _T[7][low & 255] ^ _T[3][high & 255]
        for j in range(1, 4):
            shift = np.uint32(8 * j)
            crc ^= _T[7 - j][(low >> shift) & 255] ^ _T[3 - j][(high >> shift) & 255]
    return crc


def crc32c(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32C of each range of a byte array.

    Zero bytes before a message leave a zero register as it is, so every range is padded on the left
    to whole blocks; the usual first register of ones is the same as inverting the first four bytes.
    """
    counts = -(-np.maximum(lengths, 4) // _BLOCK)
    ends = np.cumsum(counts)
    padded = np.zeros(int(ends[-1]) * _BLOCK if len(ends) else 0, np.uint8)
    for end, start, n in zip((ends * _BLOCK).tolist(), starts.tolist(), lengths.tolist(), strict=True):
        padded[end - n : end] = data[start : start + n]
        if n >= 4:
            padded[end - n : end - n + 4] ^= 255
    crcs = _blocks_of(padded)
    order = np.argsort(-counts, kind="stable")
    first, left = (ends - counts)[order], counts[order]
    crc = np.zeros(len(order), np.uint32)
    for step in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -step, "left"))  # most blocks first: those with one left
        own = crc[:n]
        crc[:n] = (
            _SKIP[0][own & 255] ^ _SKIP[1][(own >> np.uint32(8)) & 255] ^ _SKIP[2][(own >> np.uint32(16)) & 255]
            ^ _SKIP[3][own >> np.uint32(24)] ^ crcs[first[:n] + step]
        )
    result = np.empty_like(crc)
    result[order] = ~crc
    for i in np.flatnonzero(lengths < 4):
        short = np.full(1, 0xFFFFFFFF, np.uint32)
        for x in data[starts[i] : starts[i] + lengths[i]]:
            short = (short >> np.uint32(8)) ^ _T[0][(short ^ x) & 255]
        result[i] = ~short[0]
    return result


def masked(crc: np.ndarray) -> np.ndarray:
    """Rotated and shifted, so that the checksum of data that holds checksums stays useful."""
    with np.errstate(over="ignore"):
        return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)
