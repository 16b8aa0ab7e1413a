"""Alignment flags and regions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Flag bits of the SAM format with the letter of the textual form.
FLAGS = {
    "PAIRED": (1, "p"),
    "PROPER_PAIR": (2, "P"),
    "UNMAP": (4, "u"),
    "MUNMAP": (8, "U"),
    "REVERSE": (16, "r"),
    "MREVERSE": (32, "R"),
    "READ1": (64, "1"),
    "READ2": (128, "2"),
    "SECONDARY": (256, "s"),
    "QCFAIL": (512, "f"),
    "DUP": (1024, "d"),
}
#: Fixed value: bits that exclude a read from coverage by default.
EXCLUDED = 4 | 256 | 512 | 1024
#: Fixed value: the end of a region without end.
REGION_END = 1 << 29


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def has_flag(flags: Column | str, name: str) -> Column:
    return _col(flags).bitwiseAND(FLAGS[name][0]) != 0


def flag_names(flags: Column | str) -> Column:
    """Names of the set bits, in bit order."""
    return F.array_compact(F.array(*(F.when(has_flag(flags, n), n) for n in FLAGS)))


def usable(flags: Column | str) -> Column:
    """Mapped, primary, not failed, no duplicate."""
    return _col(flags).bitwiseAND(EXCLUDED) == 0


def parse_flags(text: Column | str) -> Column:
    """Decimal, 0x hexadecimal, or letters; null for anything else."""
    text = _col(text)
    by_letter = F.lit(0)
    for bit, letter in FLAGS.values():
        by_letter = by_letter + F.when(F.contains(text, F.lit(letter)), bit).otherwise(0)
    return (
        F.when(text.rlike("^0[xX][0-9A-Fa-f]+$"), F.conv(F.substring(text, F.lit(3), F.length(text)), 16, 10).cast("int"))
        .when(text.rlike("^[0-9]+$"), text.try_cast("int"))
        .when(text.rlike("^[pPuUrR12sfd]+$"), by_letter)
    )


def format_flags(flags: Column | str, style: str = "decimal") -> Column:
    """decimal, hex (0x..) or letters."""
    flags = _col(flags)
    if style == "decimal":
        return flags.cast("string")
    if style == "hex":
        return F.concat(F.lit("0x"), F.lower(F.hex(flags)))
    return F.concat(*(F.when(has_flag(flags, n), letter).otherwise("") for n, (_, letter) in FLAGS.items()))


def parse_region(text: Column | str) -> Column:
    """``name``, ``name:begin`` or ``name:begin-end``, 1-based and with optional
    commas, to struct<name, begin (0-based), end (exclusive)>."""
    text = _col(text)
    clean = F.regexp_replace(text, ",", "")
    has = clean.rlike("^.+:[0-9]+(-[0-9]+)?$")
    name = F.when(has, F.regexp_extract(clean, "^(.+):[0-9]+(-[0-9]+)?$", 1)).otherwise(text)
    begin = F.when(has, F.regexp_extract(clean, ":([0-9]+)(-[0-9]+)?$", 1).cast("long") - 1).otherwise(F.lit(0).cast("long"))
    end = F.when(clean.rlike(":[0-9]+-[0-9]+$"), F.regexp_extract(clean, "-([0-9]+)$", 1).cast("long")).otherwise(F.lit(REGION_END).cast("long"))
    return F.struct(name.alias("name"), F.greatest(begin, F.lit(0)).alias("begin"), end.alias("end"))


def in_region(seqname: Column | str, pos: Column | str, end: Column, name: str, begin: int = 0, stop: int = REGION_END) -> Column:
    """Alignments that overlap [begin, stop) of a reference; the name and position reach the scan."""
    return (_col(seqname) == name) & (_col(pos) < stop) & (end > begin)
