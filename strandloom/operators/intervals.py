"""Overlapping and gapped intervals per entity, with native session windows.

An interval becomes a session that starts at its begin and whose gap duration is
its own length, so that Spark's session_window merges overlapping ones.  Each
entity's axis is cut into tiles of ``tile`` positions by the interval's begin:
sessions are merged inside a tile only, so an entity that holds a third of all
rows is spread over its tiles.  Intervals that overlap are united in each Arrow
batch before they are shuffled, so a tile receives from a batch only periods
that do not overlap, whatever its depth.  A
running maximum of ends over the few tile summaries tells each tile how far the
tiles before it reach; touching and tile-crossing periods are united with it and
gaps follow from ``lead``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def covered_span(pos: Column | str, cigar: Column | str) -> tuple[Column, Column]:
    """Begin and end on the reference: ``pos`` and ``pos`` plus M, D, N, = and X lengths."""
    from strandloom.functions.cigar import reference_length

    pos = F.col(pos) if isinstance(pos, str) else pos
    return pos, pos + reference_length(cigar)


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (keys.., _b, _e, _tile): those of equal keys and tile that overlap as one, with their number ``_n``."""
    for batch in batches:
        group = np.zeros(batch.num_rows, np.int64)
        for column in (*batch.columns[:-3], batch.column(batch.num_columns - 1)):
            coded = column.dictionary_encode(null_encoding="encode")
            group = group * (len(coded.dictionary) + 1) + coded.indices.to_numpy()
            group = np.unique(group, return_inverse=True)[1]
        begin, end = (batch.column(batch.num_columns - k).to_numpy() for k in (3, 2))
        order = np.lexsort((begin, group))
        g, b, e = group[order], begin[order], end[order]
        first = np.append(True, g[1:] != g[:-1])[: len(g)]
        # Ranks of ends, raised by group, so that a running maximum never crosses groups.
        ranked, rank = np.unique(e, return_inverse=True)
        reach = np.maximum.accumulate(g * (len(ranked) + 1) + rank) if len(g) else g
        reach = ranked[reach - g * (len(ranked) + 1)] if len(g) else e
        opens = first | np.append(True, b[1:] > reach[:-1])[: len(g)]
        starts = np.flatnonzero(opens)
        last = np.append(starts[1:], len(g)) - 1
        taken = batch.take(pa.array(order[starts]))
        n = len(taken.columns)
        columns = [*taken.columns[: n - 3], pa.array(b[starts]), pa.array(reach[last] if len(last) else e), taken.column(n - 1), pa.array(np.diff(np.append(starts, len(g))))]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "_n"])


def _tiled(df: DataFrame, keys: list[str], begin: Column, end: Column, tile: int) -> DataFrame:
    """(_k0.., _tile, _b, _e): disjoint sorted periods of each tile, and reach before and next start."""
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), begin.cast("long").alias("_b"), end.cast("long").alias("_e"))
    rows = rows.where("_b < _e").withColumn("_tile", F.floor(F.col("_b") / tile))
    # Spark merges sessions after the shuffle only; what overlaps within a batch is united before it.
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    rows = rows.mapInArrow(_united, f"{kinds}, _n long")
    # one position is one microsecond
    at = F.timestamp_micros("_b")
    length = F.expr("make_interval(0, 0, 0, 0, 0, 0, cast((_e - _b) as decimal(18, 0)) / 1000000BD)")
    merged = rows.withColumn("_at", at).groupBy(*names, "_tile", F.session_window("_at", length).alias("_w")).agg(F.sum("_n").alias("_rows"))
    return merged.select(*names, "_tile", F.unix_micros("_w.start").alias("_b"), F.unix_micros("_w.end").alias("_e"), "_rows")


def _reaches(sessions: DataFrame, names: list[str]) -> DataFrame:
    """Add ``_reach``, the greatest end up to and with each session, and ``_next``, the next begin."""
    tiles = sessions.groupBy(*names, "_tile").agg(F.min("_b").alias("_first"), F.max("_e").alias("_last"))
    along = Window.partitionBy(*names).orderBy("_tile")
    tiles = tiles.select(
        *names, "_tile", F.max("_last").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.lead("_first").over(along).alias("_after")
    )
    same = [F.col(f"s.{n}").eqNullSafe(F.col(f"t.{n}")) for n in [*names, "_tile"]]
    on = same[0]
    for c in same[1:]:
        on = on & c
    joined = sessions.alias("s").join(tiles.alias("t"), on).select("s.*", "t._before", "t._after")
    inside = Window.partitionBy(*names, "_tile").orderBy("_b")
    upto = F.max("_e").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return joined.withColumn("_reach", F.greatest(upto, F.coalesce("_before", upto))).withColumn("_next", F.coalesce(F.lead("_b").over(inside), "_after"))


def gaps(df: DataFrame, keys: list[str], begin: Column, end: Column, tile: int = 1 << 16) -> DataFrame:
    """(keys.., gap_start, gap_end): what lies between two consecutive periods.

    Intervals are [begin, end); touching ones belong to one period.  Rows with a
    null begin or end, or that cover nothing, do not count; null keys are a key.
    An entity of one period has no gap; an empty table gives an empty result.
    Other columns do not matter, whatever their names.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    found = _reaches(_tiled(df, keys, begin, end, tile), names).where("_next > _reach")
    return found.select(*(F.col(n).alias(k) for n, k in zip(names, keys, strict=True)), F.col("_reach").alias("gap_start"), F.col("_next").alias("gap_end"))


def periods(df: DataFrame, keys: list[str], begin: Column, end: Column, tile: int = 1 << 16) -> DataFrame:
    """(keys.., period_start, period_end, intervals): maximal continuous periods.

    ``intervals`` counts the rows of a period.  Same rules as gaps().
    """
    names = [f"_k{i}" for i in range(len(keys))]
    known = _reaches(_tiled(df, keys, begin, end, tile), names)
    inside = Window.partitionBy(*names, "_tile").orderBy("_b")
    before = F.coalesce(F.max("_e").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("_before"))
    before = F.greatest(before, F.coalesce("_before", before))
    opened = known.withColumn("_opens", F.coalesce((F.col("_b") > before).cast("long"), F.lit(1)))
    # Numbering in two steps: openings of the tiles before, then inside the tile.
    per_tile = opened.groupBy(*names, "_tile").agg(F.sum("_opens").alias("_n"))
    per_tile = per_tile.withColumn("_n0", F.sum("_n").over(Window.partitionBy(*names).orderBy("_tile")) - F.col("_n")).drop("_n")
    on = None
    for n in [*names, "_tile"]:
        c = F.col(f"s.{n}").eqNullSafe(F.col(f"t.{n}"))
        on = c if on is None else on & c
    numbered = opened.alias("s").join(per_tile.alias("t"), on).select("s.*", "t._n0").withColumn("_no", F.col("_n0") + F.sum("_opens").over(inside))
    out = numbered.groupBy(*names, "_no").agg(F.min("_b").alias("period_start"), F.max("_reach").alias("period_end"), F.sum("_rows").alias("intervals"))
    return out.select(*(F.col(n).alias(k) for n, k in zip(names, keys, strict=True)), "period_start", "period_end", "intervals")
