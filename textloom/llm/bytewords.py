"""Words of whole Arrow string columns as arrays, without a Python object for each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C13  # odd, and 3 mod 4
_INVERSE = pow(_BASE, -1, 2**64)
_VALUE = np.random.Generator(np.random.PCG64(20260101)).integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse up to n."""
    if len(_powers[0]) <= n:
        for k, factor in enumerate((_BASE, _INVERSE)):
            steps = np.full(n + 1, factor, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers


def pieces(batch: pa.RecordBatch, column: int, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows of a batch with about so many bytes of text, or one row."""
    offsets = np.frombuffer(batch.column(column).buffers()[1], np.int32)[batch.column(column).offset :][: len(batch) + 1]
    start = 0
    while start < len(batch):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most_bytes)))
        yield batch.slice(start, min(end, len(batch)) - start)
        start = end


class Words:
    """The words of a string column: start and end of each in ``data``, and where documents begin.

    A word is a maximal run of bytes other than blank, TAB, LF, VT, FF and CR. ``offsets``
    has the number of the first word of each row, and the number of words. Null is empty.
    ``lower``: A-Z in lower case. ``inside`` says which bytes belong to words, if others than these.
    """

    def __init__(self, column: pa.Array, lower: bool = False, inside: Callable[[np.ndarray], np.ndarray] = lambda data: ~_BLANK[data]) -> None:
        column = column.fill_null("") if column.null_count else column
        _, bounds, data = column.buffers()
        at = np.frombuffer(bounds, np.int32)[column.offset :][: len(column) + 1].astype(np.int64)
        self.data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) else np.zeros(0, np.uint8)
        if lower:
            self.data = _LOWER[self.data]
        at = at - at[0]
        # a blank between rows: the first byte of each row begins a word even without one before it
        within = inside(self.data)
        before = np.zeros(len(within), bool)
        before[1:] = within[:-1]
        firsts = at[:-1][at[:-1] < at[1:]]
        before[firsts] = False
        self.start = np.flatnonzero(within & ~before)
        after = np.zeros(len(within), bool)
        after[:-1] = within[1:]
        after[at[1:][at[:-1] < at[1:]] - 1] = False
        self.end = np.flatnonzero(within & ~after) + 1
        self.offsets = np.searchsorted(self.start, at)

    def hashes(self, first: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word, or of its ``first`` bytes, the same in every process."""
        n = len(self.data)
        power, inverse = _tables(n)
        sums = np.zeros(n + 1, np.uint64)
        end = self.end if first is None else np.minimum(self.end, self.start + first)
        with np.errstate(over="ignore"):
            np.cumsum(_VALUE[self.data] * power[:n], out=sums[1:])
            h = (sums[end] - sums[self.start]) * inverse[self.start] + (end - self.start).astype(np.uint64)
            h ^= h >> np.uint64(31)
            h *= np.uint64(0xD6E8FEB86659FD93)
            return h ^ (h >> np.uint64(32))


def mix(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """A hash of the pairs (a[i], b[i]); the order of a pair counts."""
    with np.errstate(over="ignore"):
        x = (a ^ (a >> np.uint64(29))) * _ODD[0] + (b ^ (b >> np.uint64(32))) * _ODD[1] + np.uint64(salt)
        x ^= x >> np.uint64(32)
        x *= _ODD[2]
        return x ^ (x >> np.uint64(29))


def run_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` values, by doubling: a run is two that overlap."""
    now, length = h, 1
    while length < size:
        step = min(length, size - length)
        now = mix(now[:-step], now[step:], length + step)
        length += step
    return now
