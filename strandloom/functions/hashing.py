"""Checksums: CRC-64 over ordered rows and an order-free stream digest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the ECMA-182 polynomial in bit-reversed form.
POLYNOMIAL = 0xC96C5795D7870F42
_MASK = (1 << 64) - 1


def _table() -> list[int]:
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (POLYNOMIAL if byte & 1 else 0)
        out.append(byte)
    return out


_TABLE = _table()


def crc64(data: bytes, crc: int = 0) -> int:
    """CRC-64 with inverted input and output, continuing from ``crc``."""
    crc = ~crc & _MASK
    for byte in data:
        crc = _TABLE[(crc ^ byte) & 0xFF] ^ crc >> 8
    return ~crc & _MASK


def _times(matrix: list[int], vector: int) -> int:
    out, i = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[i]
        vector >>= 1
        i += 1
    return out


_SHIFTS: dict[int, list[list[int]]] = {}


def _zeros(power: int) -> list[list[int]]:
    """Tables of 256 for each byte of a checksum: what 2**power zero bytes make of it."""
    if power in _SHIFTS:
        return _SHIFTS[power]
    matrix = [POLYNOMIAL, *(1 << i for i in range(63))]  # one zero bit
    for _ in range(power + 3):
        matrix = [_times(matrix, x) for x in matrix]
    tables = []
    for byte in range(8):
        table = [0]
        for bit in range(8):
            table += [x ^ matrix[8 * byte + bit] for x in table]
        tables.append(table)
    _SHIFTS[power] = tables
    return tables


def crc64_combine(a: int, b: int, b_length: int) -> int:
    """The checksum of two concatenated parts, from the checksums of the parts."""
    power = 0
    while b_length:
        if b_length & 1:
            moved = 0
            for i, table in enumerate(_zeros(power)):
                moved ^= table[a >> 8 * i & 0xFF]
            a = moved
        b_length >>= 1
        power += 1
    return a ^ b


class Crc64Many:
    """Checksums of many strings at once: one table lookup per column of bytes."""

    table = np.array(_TABLE, np.uint64)

    @classmethod
    def of(cls, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        lengths = np.diff(at)
        crc = np.full(len(lengths), _MASK, np.uint64)
        order = np.argsort(-lengths, kind="stable")
        starts = at[:-1][order]
        sizes = lengths[order]
        live = len(sizes)
        for step in range(int(sizes[0]) if len(sizes) else 0):
            live = int(np.searchsorted(-sizes, -step, side="left"))
            c = crc[:live]
            crc[:live] = cls.table[((c ^ raw[starts[:live] + step]) & np.uint64(0xFF)).astype(np.int64)] ^ (c >> np.uint64(8))
        out = np.empty(len(lengths), np.uint64)
        out[order] = ~crc
        return out


def _row_crcs(names: list[str], n_keys: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns[:n_keys])
            for column in batch.columns[n_keys:]:
                column = column.cast(pa.string()).fill_null("")
                _, offsets, data = column.buffers()
                at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
                raw = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(1, np.uint8)
                columns += [pa.array(Crc64Many.of(raw, at).view(np.int64)), pa.array(np.diff(at))]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def row_crcs(df: DataFrame, keys: list[str], texts: list[str]) -> DataFrame:
    """keys and, for each text, ``crc_<text>`` and ``len_<text>`` (bytes); null is empty."""
    picked = df.select(*keys, *(F.col(t).cast("string").alias(t) for t in texts))
    names = [*keys, *(f"{p}_{t}" for t in texts for p in ("crc", "len"))]
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[: len(keys)]]
    kinds += [f"`{p}_{t}` bigint" for t in texts for p in ("crc", "len")]
    return picked.mapInArrow(_row_crcs(names, len(keys)), ", ".join(kinds))


def hex64(value: Column | str) -> Column:
    """A 64-bit pattern as 16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(F.col(value) if isinstance(value, str) else value)), 16, "0")


def row_digest(*fields: Column | str) -> Column:
    """MD5 of the fields joined by a unit separator; null fields are marked."""
    parts = [F.coalesce(F.concat(F.lit("+"), (F.col(f) if isinstance(f, str) else f).cast("string")), F.lit("-")) for f in fields]
    return F.md5(F.concat_ws("\x1f", *parts).cast("binary"))


def stream_digest(df: DataFrame, *fields: Column | str) -> DataFrame:
    """One row (rows, low, high): the digests of all rows, combined without order.

    Two tables have equal digests if they hold the same rows equally often, in
    any order and partitioning.
    """
    digest = row_digest(*fields)
    low = F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint")
    high = F.conv(F.substring(digest, 17, 12), 16, 10).cast("bigint")
    modulus = F.lit((1 << 61) - 1).cast("decimal(38,0)")
    return df.select(low.alias("l"), high.alias("h")).agg(
        F.count("*").alias("rows"),
        (F.coalesce(F.sum(F.col("l").cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)") % modulus).cast("bigint").alias("low"),
        (F.coalesce(F.sum(F.col("h").cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)") % modulus).cast("bigint").alias("high"),
    )
