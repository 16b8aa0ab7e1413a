"""Compact forms of letters and numbers: 2-bit sequences, fixed and variable length integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pack2(seq: Column | str) -> Column:
    """Letters A, C, G, T in two bits each, the first on top, the last byte filled with A; others count as A."""
    seq = _col(seq)
    digits = F.regexp_replace(F.translate(F.upper(seq), "ACGT", "0123"), "[^0-3]", "0")
    n = F.length(seq)
    padded = F.concat(digits, F.repeat(F.lit("0"), (32 - n % 32) % 32))
    words = F.transform(F.sequence(F.lit(0), F.greatest(F.length(padded) / 32 - 1, F.lit(0)).cast("int")), lambda i: F.lpad(F.conv(F.substring(padded, i * 32 + 1, F.lit(32)), 4, 16), 16, "0"))
    hexed = F.substring(F.array_join(words, ""), F.lit(1), 2 * F.ceil(n / 4).cast("int"))
    return F.when(n == 0, F.lit(b"")).otherwise(F.unhex(hexed))


def unpack2(packed: Column | str, n: Column | str) -> Column:
    """The first ``n`` letters of pack2()."""
    packed, n = _col(packed), _col(n)
    hexed = F.hex(packed)
    padded = F.concat(hexed, F.repeat(F.lit("0"), (16 - F.length(hexed) % 16) % 16))
    words = F.transform(F.sequence(F.lit(0), F.greatest(F.length(padded) / 16 - 1, F.lit(0)).cast("int")), lambda i: F.lpad(F.conv(F.substring(padded, i * 16 + 1, F.lit(16)), 16, 4), 32, "0"))
    return F.when(F.length(hexed) == 0, F.lit("")).otherwise(F.translate(F.substring(F.array_join(words, ""), F.lit(1), n.cast("int")), "0123", "ACGT"))


def letter_at(seq: Column | str, at: Column | str) -> Column:
    """The letter at a 0-based place; null outside."""
    seq, at = _col(seq), _col(at)
    return F.when((at >= 0) & (at < F.length(seq)), F.substring(seq, at.cast("int") + 1, F.lit(1)))


def with_letter(seq: Column | str, at: Column | str, letter: Column | str) -> Column:
    """The sequence with the letter at a 0-based place replaced; as it is where the place is outside."""
    seq, at = _col(seq), _col(at)
    letter = F.lit(letter) if isinstance(letter, str) else letter
    return F.when((at >= 0) & (at < F.length(seq)), F.overlay(seq, letter, at.cast("int") + 1, F.lit(1))).otherwise(seq)


def compare(a: Column | str, b: Column | str) -> Column:
    """-1, 0 or 1: shorter sequences first, those of equal length by their letters; null if either is."""
    a, b = _col(a), _col(b)
    by_length = F.signum(F.length(a) - F.length(b)).cast("int")
    return F.when(by_length != 0, by_length).when(a < b, -1).when(a > b, 1).when(a == b, 0)


def big_endian(value: Column | str, size: int) -> Column:
    """An unsigned integer in ``size`` bytes (1, 4 or 8), highest first; null beyond its range."""
    value = _col(value).cast("long")
    fits = value >= 0 if size == 8 else (value >= 0) & (value < 1 << 8 * size)
    return F.when(fits, F.unhex(F.lpad(F.hex(value), 2 * size, "0")))


def from_big_endian(data: Column | str) -> Column:
    """The unsigned integer of big_endian(), as decimal(20,0)."""
    return F.conv(F.hex(_col(data)), 16, 10).cast("decimal(20,0)")


def varint(value: Column | str) -> Column:
    """A number from 0 on in groups of seven bits, lowest first; all but the last have the top bit set."""
    value = _col(value).cast("long")
    groups = sum((F.when(value >= 1 << 7 * k, 1).otherwise(0) for k in range(1, 9)), F.lit(0))
    parts = [
        F.when(groups >= k, F.lpad(F.hex(F.shiftrightunsigned(value, 7 * k).bitwiseAND(F.lit(127)).bitwiseOR(F.when(groups > k, 128).otherwise(0).cast("long"))), 2, "0")).otherwise("")
        for k in range(9)
    ]
    return F.when(value >= 0, F.unhex(F.concat(*parts)))


def from_varint(data: Column | str) -> Column:
    """The number of varint()."""
    hexed = F.hex(_col(data))
    total = F.lit(0).cast("long")
    for k in range(9):
        byte = F.coalesce(F.conv(F.nullif(F.substring(hexed, 2 * k + 1, 2), F.lit("")), 16, 10).cast("long"), F.lit(0))
        total = total + F.shiftleft(byte.bitwiseAND(F.lit(127)), 7 * k)
    return total
