"""Edit operations of an alignment: array<struct<op:string,len:int>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The operations in the order of their binary codes 0..8.
OPS = "MIDNSHP=X"
_TYPE = "array<struct<op:string,len:int>>"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_cigar(text: Column | str) -> Column:
    """SAM text to operations; null for ``*``, an empty or a malformed string."""
    text = _col(text)
    lens = F.regexp_extract_all(text, F.lit(f"(\\d+)([{OPS}])"), F.lit(1))
    ops = F.regexp_extract_all(text, F.lit(f"(\\d+)([{OPS}])"), F.lit(2))
    pairs = F.zip_with(ops, lens, lambda o, n: F.struct(o.alias("op"), n.cast("int").alias("len")))
    return F.when(text.rlike(f"^(\\d+[{OPS}])+$"), pairs)


def format_cigar(cigar: Column | str) -> Column:
    """Operations to SAM text; ``*`` for null or none."""
    cigar = _col(cigar)
    text = F.array_join(F.transform(cigar, lambda c: F.concat(c["len"].cast("string"), c["op"])), "")
    return F.when(cigar.isNull() | (F.size(cigar) == 0), "*").otherwise(text)


def _total(cigar: Column | str, ops: str) -> Column:
    chosen = F.filter(_col(cigar), lambda c: c["op"].isin(*ops))
    return F.aggregate(chosen, F.lit(0).cast("long"), lambda acc, c: acc + c["len"])


def reference_length(cigar: Column | str, legacy: bool = False) -> Column:
    """Letters of the reference covered: M, D, N, = and X (legacy: M, D, N only)."""
    return _total(cigar, "MDN" if legacy else "MDN=X")


def query_length(cigar: Column | str) -> Column:
    """Letters of the read consumed: M, I, S, = and X."""
    return _total(cigar, "MIS=X")


def coded_length(cigar: Column | str) -> Column:
    """Everything but D, N and H; it must equal the read's length."""
    return _total(cigar, "MIS=XP")


def alignment_end(pos: Column | str, cigar: Column | str, legacy: bool = False) -> Column:
    """0-based exclusive end on the reference."""
    return _col(pos) + reference_length(cigar, legacy)


def clipped(cigar: Column | str) -> Column:
    return _total(cigar, "SH")


def offsets(cigar: Column | str) -> Column:
    """Operations with their offsets in read and reference:
    array<struct<op, len, read_at, ref_at>>; H and P move neither."""
    start = F.struct(
        F.lit(0).alias("read_at"),
        F.lit(0).alias("ref_at"),
        F.array().cast("array<struct<op:string,len:int,read_at:int,ref_at:int>>").alias("out"),
    )

    def step(acc: Column, c: Column) -> Column:
        return F.struct(
            (acc["read_at"] + F.when(c["op"].isin(*"MIS=X"), c["len"]).otherwise(0)).alias("read_at"),
            (acc["ref_at"] + F.when(c["op"].isin(*"MDN=X"), c["len"]).otherwise(0)).alias("ref_at"),
            F.concat(
                acc["out"],
                F.array(F.struct(c["op"].alias("op"), c["len"].alias("len"), acc["read_at"].alias("read_at"), acc["ref_at"].alias("ref_at"))),
            ).alias("out"),
        )

    return F.aggregate(_col(cigar), start, step)["out"]


def reg2bin(begin: Column | str, end: Column | str) -> Column:
    """Smallest bin of the six-level binning scheme that holds [begin, end)."""
    b, e = _col(begin), _col(end) - 1
    out = F.lit(0).cast("long")
    # from the widest level to the narrowest, each 8 times finer
    for level in range(1, 6):
        shift = 29 - 3 * level
        first = ((1 << 3 * level) - 1) // 7
        out = F.when(F.shiftright(b, shift) == F.shiftright(e, shift), F.shiftright(b, shift) + first).otherwise(out)
    return out
