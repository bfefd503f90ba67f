"""Vectorised word splitting and hashing over Arrow string columns.

Words are maximal runs of bytes outside space and \\t \\n \\v \\f \\r. Everything works on the
concatenated UTF-8 bytes of a chunk of rows, so there is no Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_STEP = U64(0xD6E8FEB86659FD93)
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {"pow": np.ones(1, U64), "inv": np.ones(1, U64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words, so that all bits depend on all bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["pow"]) < n:
        size = 1 << (n - 1).bit_length()
        base = np.full(size, _BASE, U64)
        inverse = np.full(size, U64(pow(int(_BASE), -1, 1 << 64)), U64)
        base[0] = inverse[0] = 1
        _powers["pow"], _powers["inv"] = np.cumprod(base, dtype=U64), np.cumprod(inverse, dtype=U64)
    return _powers["pow"], _powers["inv"]


@dataclass
class Chunk:
    """Some rows' bytes and words: row i's bytes are data[rows[i]:rows[i+1]], its words words[i]:words[i+1]."""

    first: int
    data: np.ndarray
    rows: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    words: np.ndarray

    def __len__(self) -> int:
        return len(self.rows) - 1

    def hashes(self, lower: bool = False) -> np.ndarray:
        """One 64-bit hash a word."""
        data = TO_LOWER[self.data] if lower else self.data
        power, inverse = _power_tables(len(data) + 1)
        prefix = np.zeros(len(data) + 1, U64)
        np.cumsum((data.astype(U64) + U64(1)) * power[: len(data)], out=prefix[1:])
        raw = (prefix[self.ends] - prefix[self.starts]) * inverse[self.starts]
        return mix(raw + (self.ends - self.starts).astype(U64) * _STEP)

    def windows(self, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of ``width`` words inside one row, and the index of each one's first word."""
        n = len(hashes) - width + 1
        if n <= 0:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        left = np.repeat(self.words[1:], np.diff(self.words))  # the end of each word's row
        at = np.flatnonzero(np.arange(n) + width <= left[:n])
        out = np.zeros(n, U64)
        for k in range(width):
            out = out * _STEP + hashes[k : k + n]
        return mix(out[at]), at


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that few rows are held as Python objects at a time."""
    for batch in batches:
        for k in range(0, max(1, len(batch)), rows):
            yield batch.slice(k, rows)


def chunks(column: pa.Array, budget: int = (1 << 20) - 2) -> Iterator[Chunk]:
    """Split a string column into chunks of about ``budget`` bytes, one row at least; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if large else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    values = column.buffers()[2]
    values = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + budget, "right")) - 1)
        data = values[offsets[first] : offsets[last]]
        rows = offsets[first : last + 1] - offsets[first]
        yield split_words(first, data, rows)
        first = last


def split_words(first: int, data: np.ndarray, rows: np.ndarray) -> Chunk:
    inside = ~IS_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[rows] = True
    start, end = inside.copy(), inside.copy()
    if len(data):
        start[1:] &= ~inside[:-1] | edge[1:-1]
        end[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(start)
    return Chunk(first, data, rows, starts, np.flatnonzero(end) + 1, np.searchsorted(starts, rows))
