"""Columns of a range of keys, packed into few rows so that a shuffle carries little more than their bytes.

A row of a shuffle costs about 20 bytes besides its values.  Operators that
send many small records sort them by range, and send a row for each range with
the records' columns as byte planes: all lowest bytes, then all second bytes,
with the planes that are zero throughout left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def planes(values: np.ndarray) -> bytes:
    """Unsigned 64-bit values as byte planes behind the number of planes."""
    if not len(values):
        return b"\0"
    width = max(1, (int(values.max()).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(data: bytes, n: int) -> np.ndarray:
    """What planes() packed, ``n`` values."""
    out = np.zeros((n, 8), np.uint8)
    if n:
        width = data[0]
        out[:, :width] = np.frombuffer(data, np.uint8, width * n, 1).reshape(width, n).T
    return out.view("<u8").ravel()


def sorted_planes(values: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit values by their differences."""
    return planes(np.diff(values, prepend=np.uint64(0)))


def unsorted_planes(data: bytes, n: int) -> np.ndarray:
    """What sorted_planes() packed, ``n`` values."""
    return np.cumsum(unplanes(data, n), dtype=np.uint64)


def range_bits(df: DataFrame, records: float, each: int = 1 << 20) -> int:
    """Bits of a range number: no more than ``each`` records a range, several ranges a shuffle partition."""
    least = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, math.ceil(math.log2(max(least, records / each))))


def by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows sorted by their first column, the range, gathered: (range, rows without it)."""
    held, rows = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for at, *values in zip(*columns, strict=True):
            if at != held and rows:
                yield held, rows
                rows = []
            held = at
            rows.append(tuple(values))
    if rows:
        yield held, rows


def chunks(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have ``least`` bytes."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= least:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
