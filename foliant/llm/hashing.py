"""Vectorised word and window fingerprints over Arrow text columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE_BYTES = 1 << 20
#: Odd multipliers of the rolling hashes, modulo 2**64.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93
_TABLE = np.random.Generator(np.random.PCG64(20240817)).integers(1, 2**64, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values; by sorting, which is faster here than a hash table."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) over runs of rows with at most so many bytes, one row at least. Null: empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        end = min(end, n)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


class Words:
    """The words [^\\x20\\x09-\\x0D]+ of a run of texts: byte spans, row of each, words per row, first word of each row, fingerprints."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        rows = len(offsets) - 1
        inside = ~_SPACE[data]
        first = np.zeros(len(data) + 1, dtype=bool)
        first[offsets[:-1]] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | first[1:-1]
        self.start = np.flatnonzero(begins)
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        self.count = np.bincount(self.row, minlength=rows)
        self.first = np.concatenate(([0], np.cumsum(self.count)))
        if not len(self.start):
            self.end, self.hash = self.start, np.zeros(0, np.uint64)
            return
        number = np.cumsum(begins) - 1
        self.end = self.start + np.bincount(number[inside], minlength=len(self.start))
        local = np.arange(len(data)) - self.start[np.maximum(number, 0)]
        powers = _powers(BYTE_BASE, int((self.end - self.start).max()) + 1)
        values = _TABLE[_LOWER[data] if lower else data]
        values *= powers[np.where(inside, local, 0)]
        values[~inside] = 0
        self.hash = mix(np.add.reduceat(values, self.start) + (self.end - self.start).astype(np.uint64))

    def windows(self, k: int) -> np.ndarray:
        """Fingerprint of the k words that start at each word, as if all rows were one; those that leave their row mean nothing."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, np.uint64)
        powers = _powers(WORD_BASE, n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.hash * powers[:n], out=total[1:])
        back = _powers(pow(WORD_BASE, -1, 2**64), n - k + 1)
        return mix((total[k:] - total[: n - k + 1]) * back + U(k))


def spark_hash(x: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of longs, so that Python and SQL deal rows alike. The constants are fixed values of XXH64, the seed is Spark's."""
    p1, p2, p3, p4, p5 = (U(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda v, n: v << U(n) | v >> U(64 - n)
    x = np.ascontiguousarray(x, np.int64).view(np.uint64)
    h = np.full(len(x), 42 + 8, np.uint64) + p5
    h = turn(h ^ turn(x * p2, 31) * p1, 27) * p1 + p4
    h = (h ^ h >> U(33)) * p2
    h = (h ^ h >> U(29)) * p3
    return (h ^ h >> U(32)).view(np.int64)
