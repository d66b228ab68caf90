"""Vectorised word hashing over Arrow text batches, shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE = 1 << 20
_rng = np.random.default_rng(20240511)
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_power = np.ones(1, np.uint64)
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Hand freed memory back to the system at the end of a task: Python workers are reused, and their allocators keep it otherwise."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def _powers(n: int) -> np.ndarray:
    global _power
    while len(_power) < n:
        step = np.uint64(pow(_BASE, len(_power), 2**64))
        _power = np.concatenate((_power, _power * step))
    return _power


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    flag = np.zeros(len(inside) + 2, np.int8)
    flag[1:-1] = inside
    edge = np.flatnonzero(np.diff(flag))
    return edge[0::2], edge[1::2]


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs [start, end) of ``data``."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    first = np.cumsum(size) - size
    total = int(size.sum())
    place = np.arange(total) - np.repeat(first, size)
    value = _BYTE[data[place + np.repeat(starts, size)]]
    value *= _powers(int(size.max()))[place]
    return mix(np.add.reduceat(value, first) + size.astype(np.uint64))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start places of the words ``[^\\x20\\x09-\\x0D]+`` of ``data``, with A-Z lower-cased.

    Works through blocks that end at white space, so memory doesn't follow the length of a text.
    """
    if len(data) <= 2 * PIECE:
        low = _LOWER[data]
        starts, ends = runs(~_SPACE[data])
        return hash_runs(low, starts, ends), starts
    hashes, places, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data):
            gap = np.flatnonzero(_SPACE[data[at:end]])
            if len(gap):
                end = at + int(gap[-1]) + 1
                break
            end = min(len(data), end + PIECE)
        low = _LOWER[data[at:end]]
        starts, ends = runs(~_SPACE[data[at:end]])
        hashes.append(hash_runs(low, starts, ends))
        places.append(starts + at)
        at = end
    return np.concatenate(hashes), np.concatenate(places)


def byte_array(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and row offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and len(bounds) else np.zeros(0, np.uint8)
    return raw, bounds - (bounds[0] if len(bounds) else 0)


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, place of each row) with a line feed after each row.

    A piece holds whole rows of about ``limit`` bytes together, or one longer row.
    """
    raw, bounds = byte_array(column)
    row, n = 0, len(column)
    while row < n:
        end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + limit, "right")) - 1)
        at = bounds[row : end + 1] - bounds[row]
        data = np.insert(raw[bounds[row] : bounds[end]], at[1:], 10)
        yield row, end, data, at[:-1] + np.arange(end - row)
        row = end


def words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, first word of each row and the end)."""
    for row, end, data, place in pieces(column):
        hashes, starts = word_hashes(data)
        first = np.append(np.searchsorted(starts, place), len(hashes))
        yield row, end, hashes, first


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the decimal text of an integer column, modulo ``modulus``; null ids give null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def input_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns with clashing names can't interfere."""
    return df.select(*names)
