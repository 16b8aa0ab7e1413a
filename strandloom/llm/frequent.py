"""Most frequent values with a majority-vote sketch.

Each of ``depth`` rows of a sketch has ``width`` cells.  A cell stores the total
number of votes that fell into it, one candidate and the candidate's surplus:
what is left of its votes after every vote for another value cancelled one.
Two cells merge by cancelling the smaller surplus against the larger.  For a
value x in a cell (V, K, C): if K = x its count is between C and (V + C) / 2,
otherwise at most (V - C) / 2.  A value that holds more than half of one of its
cells is that cell's candidate, so with width well above 1 / share each value
of at least that share is found in one of the independent rows.

Memory is bounded: ``groups_in_memory * depth * width`` cells of 24 bytes a task.
A hot group is sketched inside every input partition before anything is
shuffled; what a partition sends for a group is never more than the smaller of
its distinct values and the sketch.  Cells of different partitions are merged by
(group, layer, cell), never by group, so a group is no task's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.session import cut

_CELLS = "grp string, layer int, cell int, total long, candidate long, surplus long"


class VoteSketch:
    """(depth, width) cells of one group, and the number of rows of the group."""

    def __init__(self, depth: int, width: int):
        self.depth, self.width, self.rows = depth, width, 0
        self.total = np.zeros((depth, width), np.int64)
        self.candidate = np.zeros((depth, width), np.int64)
        self.surplus = np.zeros((depth, width), np.int64)

    def cell_of(self, layer: int, keys: np.ndarray) -> np.ndarray:
        """Layers read disjoint bits of the 64-bit key hash."""
        step = self.width.bit_length() - 1
        return ((keys.view(np.uint64) >> np.uint64(layer * step)) & np.uint64(self.width - 1)).astype(np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Distinct keys with their counts."""
        if not len(keys):
            return
        for layer in range(self.depth):
            cell = self.cell_of(layer, keys)
            order = np.lexsort((keys, counts, cell))
            cell, key, n = cell[order], keys[order], counts[order]
            last = np.append(np.flatnonzero(cell[1:] != cell[:-1]), len(cell) - 1)
            total = np.add.reduceat(n, np.append(0, last[:-1] + 1))
            # All others vote against the largest; where it has no majority the
            # votes cancel in pairs and at most one is left.
            left = np.maximum(2 * n[last] - total, total & 1)
            self.merge(layer, cell[last], total, key[last], left)

    def merge(self, layer: int, cell: np.ndarray, total: np.ndarray, candidate: np.ndarray, surplus: np.ndarray) -> None:
        """Cells of another sketch; each cell at most once."""
        mine, left = self.candidate[layer, cell], self.surplus[layer, cell]
        same, wins = mine == candidate, surplus > left
        self.total[layer, cell] += total
        self.candidate[layer, cell] = np.where(same | ~wins, mine, candidate)
        self.surplus[layer, cell] = np.where(same, left + surplus, np.abs(left - surplus))

    def bounds(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = np.zeros(len(keys), np.int64), np.full(len(keys), np.iinfo(np.int64).max)
        for layer in range(self.depth):
            cell = self.cell_of(layer, keys)
            v, c, hit = self.total[layer, cell], self.surplus[layer, cell], self.candidate[layer, cell] == keys
            low = np.maximum(low, np.where(hit, c, 0))
            high = np.minimum(high, np.where(hit, (v + c) // 2, (v - c) // 2))
        return low, high

    def candidates(self) -> np.ndarray:
        return np.unique(self.candidate[self.total > 0])


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with the sums of their counts."""
    keys, at = np.unique(np.concatenate([p[0] for p in parts] or [np.zeros(0, np.int64)]), return_inverse=True)
    counts = np.concatenate([p[1] for p in parts] or [np.zeros(0, np.int64)])
    return keys, np.bincount(at, counts, len(keys)).astype(np.int64)


def _cells(group: str | None, sketch: VoteSketch) -> pd.DataFrame:
    layer, cell = np.nonzero(sketch.total)
    head = pd.DataFrame({"grp": [group], "layer": -1, "cell": 0, "total": sketch.rows, "candidate": 0, "surplus": 0})
    body = pd.DataFrame({"grp": [group] * len(layer), "layer": layer, "cell": cell, "total": sketch.total[layer, cell], "candidate": sketch.candidate[layer, cell], "surplus": sketch.surplus[layer, cell]})
    return pd.concat([head, body], ignore_index=True)


_SCHEMA = pa.schema([("grp", pa.string()), ("layer", pa.int32()), ("cell", pa.int32()), ("total", pa.int64()), ("candidate", pa.int64()), ("surplus", pa.int64())])


def _sketch_partition(depth: int, width: int, groups_in_memory: int):
    """Per input partition: small groups pass as (value, count), large ones as cells.

    ``layer`` -1 carries a group's number of rows, -2 a value with its count.  A
    value counts as one cell in each layer, so beyond ``width`` values the cells
    are fewer.
    """
    small = width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: dict = {}  # group -> [rows, {value: count}] or a sketch

        def flush():
            frames = []
            for group, state in pending.items():
                if isinstance(state, VoteSketch):
                    frames.append(_cells(group, state))
                else:
                    rows, parts = state
                    keys, counts = _summed(parts)
                    frames.append(pd.DataFrame({"grp": [group] * (len(keys) + 1), "layer": [-1] + [-2] * len(keys), "cell": 0, "total": np.append(rows, counts), "candidate": np.append(0, keys), "surplus": 0}))
            pending.clear()
            if frames:
                yield from pa.Table.from_pandas(pd.concat(frames, ignore_index=True), _SCHEMA, preserve_index=False).to_batches()

        for batch in batches:
            groups, names = pd.factorize(batch.column(0).to_pandas(), use_na_sentinel=False)
            has = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            keys = batch.column(1).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.lexsort((keys, ~has, groups))
            g, k, h = groups[order], keys[order], has[order]
            starts = np.append(0, np.flatnonzero(np.diff(g)) + 1) if len(g) else []
            for start, stop in zip(starts, np.append(starts[1:], len(g)), strict=True):
                name = names[g[start]]
                name = None if pd.isna(name) else name
                mine = k[start:stop][h[start:stop]]
                values, counts = np.unique(mine, return_counts=True)
                state = pending.get(name)
                if state is None:
                    if len(pending) >= groups_in_memory:
                        yield from flush()
                    state = pending[name] = [0, []]
                if not isinstance(state, VoteSketch):
                    state[1].append((values, counts))
                    state[0] += stop - start
                    if sum(len(p[0]) for p in state[1]) > small:
                        sketch = VoteSketch(depth, width)
                        sketch.rows = state[0]
                        sketch.add(*_summed(state[1]))
                        pending[name] = sketch
                else:
                    state.add(values, counts)
                    state.rows += stop - start
        yield from flush()

    return run


def _cell(depth: int, width: int, key: str) -> Column:
    """(layer, cell) of a key in every layer, as VoteSketch.cell_of has them."""
    step = width.bit_length() - 1
    layers = [F.struct(F.lit(i).alias("layer"), F.shiftrightunsigned(key, i * step).bitwiseAND(F.lit(width - 1)).cast("int").alias("cell")) for i in range(depth)]
    return F.array(*layers)


def merged_cells(parts: DataFrame, depth: int, width: int) -> DataFrame:
    """(grp, layer, cell, total, candidate, surplus): the cells of all partitions, merged.

    Votes of one candidate add up, and each vote for another candidate cancels
    one of the strongest.  Partitions send a cell once, so both steps follow one
    shuffle by cell; cells of one group are merged all over the cluster.
    ``layer`` -1 carries the number of rows of the group.
    """
    one = F.array(F.struct("layer", "cell"))
    votes = parts.select(
        "grp", F.inline(F.when(F.col("layer") == -2, _cell(depth, width, "candidate")).otherwise(one)), "total", "candidate",
        F.when(F.col("layer") == -2, F.col("total")).otherwise(F.col("surplus")).alias("surplus"),
    )
    placed = votes.repartition("grp", "layer", "cell")
    by_candidate = placed.groupBy("grp", "layer", "cell", "candidate").agg(F.sum("total").alias("total"), F.sum("surplus").alias("surplus"))
    cells = by_candidate.groupBy("grp", "layer", "cell").agg(
        F.sum("total").alias("total"), F.max_by("candidate", "surplus").alias("candidate"), F.max("surplus").alias("top"), F.sum("surplus").alias("votes")
    )
    left = F.greatest(F.lit(0).cast("long"), 2 * F.col("top") - F.col("votes"))
    return cells.select("grp", "layer", "cell", "total", "candidate", left.alias("surplus"))


def frequent_candidates(
    df: DataFrame,
    value: Column,
    group: Column,
    share: float,
    least: int = 1,
    depth: int = 5,
    width: int = 1024,
    groups_in_memory: int = 64,
) -> DataFrame:
    """(grp, candidate, low, high, group_rows): values that may reach the share.

    ``candidate`` is the 64-bit hash of the value.  Kept are candidates whose
    upper bound reaches both ``share`` of the rows of their group and ``least``.
    Rows with a null value count as rows but are no candidates; a null group is
    a group.  ``width`` is a power of two; depth * log2(width) may be 64 at most.
    """
    if width & (width - 1) or depth * (width.bit_length() - 1) > 64:
        raise ValueError("width must be a power of two and depth * log2(width) at most 64")
    rows = df.select(group.cast("string").alias("grp"), F.when(value.isNotNull(), F.xxhash64(value)).alias("key"))
    parts = rows.mapInArrow(_sketch_partition(depth, width, groups_in_memory), _CELLS)
    cells = cut(merged_cells(parts, depth, width))  # depth * width rows for each group at most
    sizes = cells.where("layer = -1").select(F.col("grp").alias("g"), F.col("total").alias("group_rows"))
    body = cells.where("layer >= 0").withColumn("most", F.floor((F.col("total") + F.col("surplus")) / 2))
    reaches = lambda high: (F.col(high) / F.col("group_rows") >= F.lit(share)) & (F.col(high) >= least)
    strong = body.join(sizes, F.col("grp").eqNullSafe(F.col("g"))).where(reaches("most")).select("grp", "candidate", "group_rows").distinct()
    asked = strong.select(F.col("grp").alias("g"), F.col("candidate").alias("c"), "group_rows", F.inline(_cell(depth, width, "candidate")))
    here = body.join(asked, F.col("grp").eqNullSafe(F.col("g")) & (body["layer"] == asked["layer"]) & (body["cell"] == asked["cell"]))
    own = F.col("candidate") == F.col("c")
    bounds = here.groupBy("grp", "c", "group_rows").agg(
        F.max(F.when(own, F.col("surplus")).otherwise(0)).alias("low"),
        F.min(F.when(own, F.col("most")).otherwise(F.floor((F.col("total") - F.col("surplus")) / 2))).alias("high"),
    )
    return bounds.where(reaches("high")).select("grp", F.col("c").alias("candidate"), "low", "high", "group_rows")


#: Bytes of candidates, at 64 a row, up to which they are sent to every task.
BROADCAST_BYTES = 32 << 20


def _rows_of(df: DataFrame, value: Column, group: Column, found: DataFrame, limit: int) -> DataFrame:
    """(g, v, rows, low, high, group_rows): the candidates' values with their exact counts.

    Values of equal hash are told apart by their counts, which are by value.
    Candidates are fewer than depth / share a group; beyond ``limit`` bytes of
    them all values are counted and the counts joined.
    """
    rows = df.select(group.cast("string").alias("g"), value.alias("v")).where("v is not null")
    on = F.col("g").eqNullSafe(F.col("grp")) & (F.xxhash64("v") == F.col("candidate"))
    if found.count() * 64 > limit:
        return rows.groupBy("g", "v").agg(F.count("*").alias("rows")).join(found, on).drop("grp", "candidate")
    bounds = ("low", "high", "group_rows")
    return rows.join(F.broadcast(found), on).groupBy("g", "v").agg(F.count("*").alias("rows"), *(F.first(c).alias(c) for c in bounds))


def frequent_bounds(df: DataFrame, value: Column, group: Column, share: float, least: int = 1, limit: int = BROADCAST_BYTES, **sketch: int) -> DataFrame:
    """(grp, value, low, high, rows, group_rows): the sketch's answer, next to the exact count.

    Every value whose upper bound reaches the share is listed, whether or not
    its count does; ``high - low`` is the width of the bounds.
    """
    found = cut(frequent_candidates(df, value, group, share, least, **sketch))
    return _rows_of(df, value, group, found, limit).select(F.col("g").alias("grp"), F.col("v").alias("value"), "low", "high", "rows", "group_rows")


def frequent_values(
    df: DataFrame, value: Column, group: Column, share: float, least: int = 1, **options: int
) -> DataFrame:
    """(grp, value, rows, low, high, group_rows): values of at least the share.

    Candidates and their bounds come from the sketch; an exact count of the
    candidates' rows follows and decides.  Clashing column names of ``df`` do
    not matter.
    """
    counted = frequent_bounds(df, value, group, share, least, **options)
    return counted.where((F.col("rows") / F.col("group_rows") >= F.lit(share)) & (F.col("rows") >= least)).select(
        "grp", "value", "rows", "low", "high", "group_rows"
    )
