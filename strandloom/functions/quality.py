"""Column expressions on quality strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandloom.functions.nucleotide import letters

#: Breakpoints of the three binnings, as (first value of the bin, bin).
BIN42 = [(0, 1), *((q, q + 1) for q in range(1, 36)), (36, 38), (37, 39), (38, 40), (39, 41)]
BIN16 = [(0, 1), (2, 2), (10, 3), (25, 4), (30, 5), (31, 6), (32, 7), (33, 8), (34, 9), (35, 10), (36, 11), (37, 12), (38, 13), (39, 14), (40, 15)]
DELTA_BIN = [(0, 0), (1, 1), (2, 2), (5, 3), (10, 4), (18, 5), (28, 6), (49, 7)]
DELTA_CAP = 49


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def phred(qual: Column | str, base: int = 33) -> Column:
    """Quality scores as array<int>; null for null, empty for empty."""
    return F.transform(letters(qual), lambda c: F.ascii(c) - base)


def binned(value: Column, steps: list[tuple[int, int]]) -> Column:
    """The bin of a value by breakpoints; a constant array lookup."""
    size = steps[-1][0] + 1
    table, at = [], 0
    for v in range(size):
        while at + 1 < len(steps) and steps[at + 1][0] <= v:
            at += 1
        table.append(steps[at][1])
    lookup = F.array(*(F.lit(t) for t in table))
    return F.element_at(lookup, (F.least(F.greatest(value, F.lit(0)), F.lit(size - 1)) + 1).cast("int"))


def bin42(q: Column) -> Column:
    return binned(q, BIN42)


def bin16(b: Column) -> Column:
    return binned(b, BIN16)


def jump_total(scores: Column, coded: bool) -> Column:
    """Large jumps of a read, at most 49.

    ``coded``: the previous score is binned first, so a step counts when the
    binned one exceeds the score by 1 or more or falls 2 or more below it; the
    first score is compared with bin 0.  Otherwise a step of more than 1 counts.
    """
    start = F.struct(F.lit(None).cast("int").alias("prev"), F.lit(0).alias("n"))

    def step(acc: Column, q: Column) -> Column:
        if coded:
            before = F.when(acc["prev"].isNull(), 0).otherwise(bin42(acc["prev"]))
            hit = ((before - q) < -1) | ((before - q) >= 1)
        else:
            hit = F.coalesce(F.abs(q - acc["prev"]) > 1, F.lit(False))
        return F.struct(q.alias("prev"), F.least(acc["n"] + hit.cast("int"), F.lit(DELTA_CAP)).alias("n"))

    return F.aggregate(scores, start, step)["n"]


def contexts(qual: Column | str, base: int = 33) -> Column:
    """array<struct<q, pos4, delta, q34, q2, q1>>: each score with its model context.

    pos4 is the quarter of the read, delta the binned number of jumps so far, q1
    the binned score before, q2 the coarser bin of the one before that and q34
    the larger coarse bin of the two before those; 0 before the start.
    """
    scores = phred(qual, base)
    quarter = F.ceil(F.size(scores) / 4).cast("int")
    start = F.struct(
        *(F.lit(0).alias(n) for n in ("i", "jumps", "q1", "q2", "q3", "q4")),
        F.array().cast("array<struct<q:int,pos4:int,delta:int,q34:int,q2:int,q1:int>>").alias("out"),
    )

    def step(acc: Column, q: Column) -> Column:
        here = F.struct(
            q.alias("q"),
            F.floor(acc["i"] / quarter).cast("int").alias("pos4"),
            binned(acc["jumps"], DELTA_BIN).alias("delta"),
            F.greatest(acc["q3"], acc["q4"]).alias("q34"),
            acc["q2"].alias("q2"),
            acc["q1"].alias("q1"),
        )
        hit = ((acc["q1"] - q) < -1) | ((acc["q1"] - q) >= 1)
        b = bin42(q)
        return F.struct(
            (acc["i"] + 1).alias("i"),
            F.least(acc["jumps"] + hit.cast("int"), F.lit(DELTA_CAP)).alias("jumps"),
            b.alias("q1"),
            F.when(acc["i"] >= 1, bin16(acc["q1"])).otherwise(0).alias("q2"),
            acc["q2"].alias("q3"),
            acc["q3"].alias("q4"),
            F.concat(acc["out"], F.array(here)).alias("out"),
        )

    return F.aggregate(scores, start, step)["out"]
