"""Array operations over the UTF-8 bytes of text columns.

Words, shingles and windows of a whole Arrow batch are found and hashed with a
few passes over byte arrays, without a Python object for each of them. Work goes
in blocks of whole rows of about ``BLOCK`` bytes; a longer row is one block.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19


def splitmix(n: int, seed: int) -> np.ndarray:
    """The first n values of the public splitmix64 generator."""
    z = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    return mix(z)


def mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def mix_in(z: np.ndarray, scratch: np.ndarray | None = None) -> np.ndarray:
    """``mix`` in place; the scratch array is overwritten."""
    t = np.empty_like(z) if scratch is None else scratch
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        z ^= np.right_shift(z, np.uint64(shift), out=t)
        if factor > 1:
            z *= np.uint64(factor)
    return z


_BYTE = splitmix(256, 11)
_STEP = np.uint64(0xD1342543DE82EF95)
_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        out = np.empty(max(n, 2 * len(_POWERS), 256), np.uint64)
        out[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(np.full(len(out) - 1, _STEP), out=out[1:])
        _POWERS = out
    return _POWERS


def ascii_lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words: all but space and tab to carriage return.
_IN_WORD = np.ones(256, bool)
_IN_WORD[[32, *range(9, 14)]] = False


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) for runs of rows; null is empty. There is one more offset than rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
        end = min(end, n)
        yield row, raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def runs(inside: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of true, cut at the positions ``cuts``."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.empty(n, bool)
    first[0] = True
    np.logical_not(inside[:-1], out=first[1:])
    first[cuts[cuts < n]] = True
    first &= inside
    starts = np.flatnonzero(first)
    last = np.empty(n, bool)
    last[-1] = True
    np.logical_not(inside[1:], out=last[:-1])
    before = cuts[(cuts > 0) & (cuts <= n)] - 1
    last[before] = True
    last &= inside
    return starts, np.flatnonzero(last) + 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of ``[^\\x20\\x09-\\x0D]+`` in a block, and how many words each row has."""
    starts, ends = runs(_IN_WORD[data], offsets[:-1])
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes; runs don't overlap, are in order and not empty."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = ends - starts
    at = np.cumsum(n) - n
    inner = np.arange(int(n.sum())) - np.repeat(at, n)
    v = _BYTE[data[inner + np.repeat(starts, n)]]
    v *= powers(int(n.max()) + 1)[inner]
    h = np.add.reduceat(v, at)
    return mix(h + n.astype(np.uint64))


class HashIndex:
    """Numbers 64-bit hashes in the order met: an open-addressed table of arrays."""

    def __init__(self, bits: int = 16):
        self.size, self.bits = 0, bits
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.full(1 << bits, -1, np.int64)

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 if it has none."""
        slot = self._slots(h)
        got = self.values[slot]
        wrong = np.flatnonzero((got >= 0) & (self.keys[slot] != h))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & (len(self.keys) - 1)
            s = slot[wrong]
            got[wrong] = self.values[s]
            wrong = wrong[(self.values[s] >= 0) & (self.keys[s] != h[wrong])]
        return got

    def add(self, h: np.ndarray) -> None:
        """Number new, distinct hashes."""
        while self.size + len(h) > len(self.keys) // 2:
            keys, values = self.keys, self.values
            self.bits += 1
            self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int64)
            full = values >= 0
            self._put(keys[full], values[full])
        self._put(h, np.arange(self.size, self.size + len(h)))
        self.size += len(h)

    def _put(self, h: np.ndarray, number: np.ndarray) -> None:
        slot = self._slots(h)
        while len(h):
            free = self.values[slot] < 0
            self.keys[slot[free]], self.values[slot[free]] = h[free], number[free]
            done = self.keys[slot] == h
            done &= self.values[slot] == number
            h, number, slot = h[~done], number[~done], (slot[~done] + 1) & (len(self.keys) - 1)


_T = TypeVar("_T")
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def released(value: _T) -> _T:
    """The value, after memory that a task has freed went back to the system: workers are kept for later tasks."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)
    return value


def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; at their end the task's freed memory goes back to the system."""
    yield from batches
    released(None)
