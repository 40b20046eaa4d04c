"""CRC-32 of many byte ranges at once, and of their concatenations without reading them again."""

from __future__ import annotations

import zlib

import numpy as np

_SHORT = 64


def _byte_table() -> np.ndarray:
    """What each low byte does to the register, by the rule of the polynomial."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1).astype(np.uint32)
    return c


_TABLE = _byte_table()


def _shift_tables() -> np.ndarray:
    """[n, j, b]: a register with b as its j-th byte after n zero bytes."""
    now = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    out = [now]
    for _ in range(_SHORT):
        now = _TABLE[now & 255] ^ (now >> 8)
        out.append(now)
    return np.array(out, np.uint32)


_SHIFTS = _shift_tables()


def crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The CRC-32 (unsigned) of data[start[i] : end[i]] for each i."""
    size = end - start
    out = np.zeros(len(start), np.uint32)
    long = np.flatnonzero(size > _SHORT)
    for i in long:
        out[i] = zlib.crc32(data[start[i] : end[i]].tobytes())
    order = np.argsort(-np.where(size > _SHORT, 0, size), kind="stable")
    sizes, at = np.where(size > _SHORT, 0, size)[order], start[order]
    c = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for k in range(int(sizes[0]) if len(sizes) else 0):
        m = int(np.searchsorted(-sizes, -k, side="left"))  # the ranges longer than k come first
        part = c[:m]
        c[:m] = _TABLE[(part ^ data[at[:m] + k]) & 255] ^ (part >> 8)
    short = size[order] <= _SHORT
    out[order[short]] = ~c[short]
    return out


def appended(first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The CRC-32 of A + B, given those of A and of B and the size of B in bytes."""
    c, left = first.astype(np.uint32), size.astype(np.int64)
    while True:
        n = np.minimum(left, _SHORT)
        c = _SHIFTS[n, 0, c & 255] ^ _SHIFTS[n, 1, c >> 8 & 255] ^ _SHIFTS[n, 2, c >> 16 & 255] ^ _SHIFTS[n, 3, c >> 24]
        left = left - n
        if not left.any():
            return c ^ second


def with_byte(c: np.ndarray, byte: int) -> np.ndarray:
    """The CRC-32 of A and one byte more, given that of A."""
    c = ~c.astype(np.uint32)
    return ~(_TABLE[(c ^ np.uint32(byte)) & 255] ^ (c >> 8))
