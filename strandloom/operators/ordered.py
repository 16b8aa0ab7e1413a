"""Order-dependent operators that do not gather a file in one task.

A file may hold a third of all rows, so nothing here orders a whole file in one
window.  Rows are cut into chunks of ``chunk`` consecutive order values; windows
run inside chunks, and one summary row a chunk carries what the next one needs
(its last row, its total).  Only the summaries are ordered per file.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

CHUNK = 1 << 16


def _chunked(df: DataFrame, order: list[str], chunk: int) -> DataFrame:
    return df.withColumn("_chunk", F.floor(F.col(order[0]) / chunk))


def _same(names: list[str]) -> Column:
    on = None
    for n in names:
        c = F.col(f"r.{n}").eqNullSafe(F.col(f"c.{n}"))
        on = c if on is None else on & c
    return on


def with_previous(df: DataFrame, values: dict[str, Column], part: list[str], order: list[str], chunk: int = CHUNK) -> DataFrame:
    """``df`` with the named values of the row before it in its part; null for the first.

    ``order``: columns that order a part, the first one a number; rows equal in
    all of them are ordered arbitrarily.
    """
    named = _chunked(df, order, chunk).withColumn("_now", F.struct(F.lit(True).alias("_is"), *(c.alias(n) for n, c in values.items())))
    last = named.groupBy(*part, "_chunk").agg(F.max_by("_now", F.struct(*order)).alias("_end"))
    before = last.withColumn("_before", F.lag("_end").over(Window.partitionBy(*part).orderBy("_chunk"))).drop("_end")
    joined = named.alias("r").join(before.alias("c"), _same([*part, "_chunk"]), "left").select("r.*", "c._before")
    inside = Window.partitionBy(*part, "_chunk").orderBy(*order)
    previous = F.coalesce(F.lag("_now").over(inside), F.col("_before"))
    out = joined.withColumn("_previous", previous)
    return out.select(*df.columns, *(F.col(f"_previous.{n}").alias(n) for n in values))


def with_running_sum(df: DataFrame, name: str, value: Column, part: list[str], order: list[str], chunk: int = CHUNK) -> DataFrame:
    """``df`` with the sum of a value over its part up to and with the row."""
    valued = _chunked(df, order, chunk).withColumn("_value", value.cast("long"))
    total = valued.groupBy(*part, "_chunk").agg(F.sum("_value").alias("_total"))
    upto = F.coalesce(F.sum("_total").over(Window.partitionBy(*part).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = total.withColumn("_base", upto).drop("_total")
    joined = valued.alias("r").join(before.alias("c"), _same([*part, "_chunk"]), "left").select("r.*", "c._base")
    inside = Window.partitionBy(*part, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = joined.withColumn(name, F.col("_base") + F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    return out.select(*df.columns, name)


def with_row_number(df: DataFrame, name: str, part: list[str], order: list[str], chunk: int = CHUNK) -> DataFrame:
    """``df`` with the 1-based number of each row of its part."""
    return with_running_sum(df, name, F.lit(1), part, order, chunk)


def run_lengths(df: DataFrame, value: Column, part: list[str], order: list[str], chunk: int = CHUNK) -> DataFrame:
    """(part.., run, value, n): runs of equal consecutive values, numbered from 0; null is a value."""
    rows = df.select(*part, *order, value.alias("value"))
    known = with_previous(rows, {"_was": F.struct(F.col("value"))}, part, order, chunk)
    starts = known.withColumn("_start", (F.col("_was").isNull() | ~F.col("_was.value").eqNullSafe(F.col("value"))).cast("int"))
    numbered = with_running_sum(starts, "run", F.col("_start"), part, order, chunk)
    return numbered.groupBy(*part, (F.col("run") - 1).alias("run")).agg(F.first("value").alias("value"), F.count("*").alias("n"))


def first_seen_index(df: DataFrame, value: str, part: list[str], order: list[str]) -> DataFrame:
    """(part.., value, index, first order columns): dense index of values by first appearance.

    One row per distinct value is ordered, not the rows.
    """
    first = df.where(F.col(value).isNotNull()).groupBy(*part, value).agg(F.min(F.struct(*order)).alias("_first"))
    return first.select(
        *part, value, (F.row_number().over(Window.partitionBy(*part).orderBy("_first")) - 1).alias("index"), F.col(f"_first.{order[0]}").alias("first_at")
    )


def chunk_totals(df: DataFrame, part: list[str], order: list[str], sums: dict[str, Column], reads: int = 5000) -> DataFrame:
    """(part.., chunk, reads, sums..): totals of chunks of ``reads`` consecutive rows."""
    numbered = with_row_number(df, "_no", part, order)
    return numbered.groupBy(*part, F.floor((F.col("_no") - 1) / reads).alias("chunk")).agg(
        F.count("*").alias("reads"), *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for n, c in sums.items())
    )


def _folded(chunks: DataFrame, part: list[str], pick: list[str], name: str, kind: str, start: Callable[[], object], step: Callable) -> DataFrame:
    """``chunks`` with a column from a fold over the chunks of each part in order.

    ``step`` takes the state and the picked values and gives the next state and
    the column's value.  Chunks stream through sorted; nothing of a part is held
    but its state.
    """
    n = len(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None
        for batch in batches:
            out = []
            for *key, at in zip(*(batch.column(i).to_pylist() for i in range(n)), range(batch.num_rows), strict=True):
                if key != held:
                    held, state = key, start()
                state, value = step(state, *(batch.column(c)[at].as_py() for c in pick))
                out.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, batch_kind)], [*batch.schema.names, name])

    batch_kind = pa.int64() if kind == "long" else pa.int32()
    rows = chunks.select(*part, *(c for c in chunks.columns if c not in part))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    ordered = rows.repartition(*part).sortWithinPartitions(*part, "chunk")
    return ordered.mapInArrow(run, f"{kinds}, {name} {kind}").select(*chunks.columns, name)


def block_cuts(chunks: DataFrame, part: list[str], size: str = "bases", most: int = 5_000_000) -> DataFrame:
    """``chunks`` with ``block``: a block ends with the chunk that takes it beyond ``most``.

    The reset makes this a fold, over one row for each 5000 reads.
    """

    def step(state: tuple[int, int], bases: int) -> tuple[tuple[int, int], int]:
        block, held = state
        held += bases
        return ((block + 1, 0) if held > most else (block, held)), block

    return _folded(chunks, part, [size], "block", "long", lambda: (0, 0), step)


def scheme_changes(chunks: DataFrame, part: list[str], low: str = "low", high: str = "high", first: int = 33, width: int = 64) -> DataFrame:
    """``chunks`` with ``base``: the quality base guessed chunk by chunk.

    The base starts at ``first`` and becomes the chunk's minimum whenever a chunk
    goes below it or reaches base + width; chunks without qualities keep it.
    """

    def step(base: int, least: int | None, greatest: int | None) -> tuple[int, int]:
        if least is not None and greatest is not None and (least < base or greatest >= base + width):
            base = least
        return base, base

    return _folded(chunks, part, [low, high], "base", "int", lambda: first, step)


def first_rows(df: DataFrame, n: int, part: list[str], order: list[str]) -> DataFrame:
    """The first ``n`` rows of each part: the limit is the feature."""
    return with_row_number(df, "_no", part, order).where(F.col("_no") <= n).drop("_no")


def reservoir(df: DataFrame, first: int, keep: int, part: list[str], order: list[str]) -> DataFrame:
    """The last ``keep`` of the first ``first`` rows of each part."""
    numbered = with_row_number(df, "_no", part, order).where(F.col("_no") <= first)
    size = numbered.groupBy(*part).agg(F.max("_no").alias("_size"))
    joined = numbered.alias("r").join(size.alias("c"), _same(part)).select("r.*", "c._size")
    return joined.where(F.col("_no") > F.col("_size") - keep).drop("_no", "_size")
