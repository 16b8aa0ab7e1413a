"""Filling packs of fixed capacity, by a linear program over configurations.

Only the histogram of item sizes matters for how packs are composed, and it has
at most ``grid`` bins: sizes are rounded up to ``grid`` steps of the capacity.  A
configuration is a multiset of steps that fits a pack; the linear program covers
the histogram with as few configurations as possible.  It is solved by
multiplicative weights: each step size has a weight, a knapsack dynamic program
prices all configurations at once, those within ``slack`` of the best price are
used for a part of what is left of their scarcest size, and the weights of sizes
that lag behind grow.  Any weights bound the number of packs from below: the
weight of all items over that of the best configuration.  Uses are rounded to
whole packs as they are chosen; what is left in the end is placed best-fit.

All of that runs on the histogram alone.  Items are then dealt to the slots of
the plan by their rank within their size, which is computed without gathering a
size anywhere: ranks are counted inside hash buckets, as many as the number of
items asks for, and shifted by the counts of the buckets before.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from strandloom.session import cut


def knapsack(weights: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Greatest weight of each room 0..capacity, and the size to place there first (-1: a step of room stays empty).

    ``sizes`` fall, so that of equal weights the larger size is taken.
    """
    best = np.zeros(capacity + 1, np.int64)
    pick = np.full(capacity + 1, -1)
    fits = np.searchsorted(-sizes, -np.arange(capacity + 1))  # the first size that fits a room
    for room in range(int(sizes[-1]), capacity + 1):
        value = best[room - sizes[fits[room] :]] + weights[fits[room] :]
        k = int(value.argmax())
        if value[k] > best[room - 1]:
            best[room], pick[room] = value[k], fits[room] + k
        else:
            best[room] = best[room - 1]
    return best, pick


def price(weights: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Counts per size of a pack of greatest total weight (unbounded knapsack); weights are whole numbers, sizes fall."""
    return _traced(knapsack(weights, sizes, capacity)[1], sizes, capacity, np.zeros(len(sizes), np.int64))


def _traced(pick: np.ndarray, sizes: np.ndarray, room: int, counts: np.ndarray) -> np.ndarray:
    while room > 0:
        k = pick[room]
        if k < 0:
            room -= 1
        else:
            counts[k] += 1
            room -= int(sizes[k])
    return counts


def _top_up(counts: np.ndarray, sizes: np.ndarray, demand: np.ndarray, capacity: int) -> np.ndarray:
    """Counts held to the demand, the room so freed filled with the largest sizes that fit; sizes fall."""
    counts = np.minimum(counts, demand)
    room = capacity - int(counts @ sizes)
    left = demand - counts
    while room >= sizes[-1]:
        fit = np.flatnonzero((sizes <= room) & (left > 0))
        if not len(fit):
            break
        k = fit[0]
        take = min(int(left[k]), room // int(sizes[k]))
        counts[k] += take
        left[k] -= take
        room -= take * int(sizes[k])
    return counts


#: Whole-number weights of a full pack.
_SCALE = 1 << 30


def _solve(
    histogram: dict[int, int], capacity: int, part: float, rounds: int, eta: float = 0.2, most_slack: float = 0.03
) -> tuple[list[tuple[dict[int, int], int]], dict[int, int], float]:
    """Packs chosen by the program, counts that it left, and the bound by its weights.

    A round uses each good configuration for ``part`` of what is left of its
    scarcest size.  One that uses none starts the weights anew for what is left,
    with more slack, up to ``most_slack``.
    """
    slack = 0.0
    sizes = np.array(sorted((s for s, n in histogram.items() if n > 0), reverse=True), np.int64)
    demand = np.array([histogram[int(s)] for s in sizes], np.int64)
    dual = sizes / capacity
    rest, packs, bound, whole = demand.copy(), [], 0.0, True
    for _ in range(rounds):
        weights = np.maximum(1, np.round(dual * _SCALE)).astype(np.int64)
        best, pick = knapsack(weights, sizes, capacity)
        if whole:  # later programs are for a part of the items
            bound = max(bound, float(demand @ weights.astype(float)) / float(best[capacity]))
        used = 0
        priced = weights + best[capacity - sizes]  # the best configuration that has each size
        for k in np.flatnonzero((rest > 0) & (priced >= (1 - slack) * best[capacity])):
            if rest[k] <= 0:
                continue
            counts = np.zeros(len(sizes), np.int64)
            counts[k] = 1
            wanted = _traced(pick, sizes, capacity - int(sizes[k]), counts)
            counts = _top_up(wanted.copy(), sizes, rest, capacity)
            if counts @ weights < (1 - slack) * best[capacity]:
                continue  # what is left of its sizes makes no good pack any more
            on = counts > 0
            times = max(1, int(part * (rest[on] // counts[on]).min()))
            packs.append(({int(s): int(c) for s, c in zip(sizes[on], counts[on], strict=True)}, times))
            rest -= counts * times
            used += times
        if not rest.any():
            break
        if not used:
            slack = max(1 / capacity, 2 * slack)
            if slack > most_slack:
                break
            on = rest > 0
            whole = False
            sizes, demand, rest = sizes[on], rest[on], rest[on].copy()
            dual = sizes / capacity
            continue
        lag = rest / demand
        dual = dual * np.exp(eta * (lag - np.average(lag, weights=sizes * demand)))
        dual /= max(1.0, float((dual * _SCALE).max()) / _SCALE)
    return packs, {int(s): int(n) for s, n in zip(sizes, rest, strict=True)}, bound


def plan_packs(histogram: dict[int, int], capacity: int, rounds: int = 64, parts: tuple[float, ...] = (0.5, 0.25)) -> tuple[list[tuple[dict[int, int], int]], dict]:
    """Packs as (counts by size, repetitions), and the figures of the solution.

    ``histogram``: items by size in steps, every size in 1..capacity.  Figures:
    ``packs``, ``by_program`` of them from the linear program, ``best_fit``, what
    best-fit alone needs, ``bound``, below which no packing of these sizes goes.
    The program is tried with each of ``parts``; what it leaves after at most
    ``rounds`` is placed best-fit, as is everything where that alone gives fewer packs.
    """
    histogram = {s: n for s, n in histogram.items() if n > 0}
    packs = _best_fit(histogram, capacity)
    total = plain = sum(n for _, n in packs)
    by_program, bound = 0, 0.0
    for part in parts if histogram else ():
        chosen, rest, limit = _solve(histogram, capacity, part, rounds)
        mine = chosen + _best_fit(rest, capacity)
        n, bound = sum(n for _, n in mine), max(bound, limit)
        if n < total or n == total and not by_program:
            packs, total, by_program = mine, n, sum(n for _, n in chosen)
    return packs, {"packs": total, "by_program": by_program, "best_fit": plain, "bound": math.ceil(bound - 1e-6)}


def _best_fit(left: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Pack remaining counts: each pack takes the largest size that still fits, repeatedly."""
    left = {s: n for s, n in left.items() if n > 0}
    sizes = sorted(left)
    packs = []
    while sizes:
        room, counts = capacity, {}
        at = len(sizes)
        while True:
            at = bisect.bisect_right(sizes, room, 0, at) - 1
            if at < 0:
                break
            s = sizes[at]
            take = min(left[s], room // s)
            counts[s] = take
            room -= take * s
        times = min(left[s] // c for s, c in counts.items())
        packs.append((counts, times))
        for s, c in counts.items():
            left[s] -= c * times
        sizes = [s for s in sizes if left[s] > 0]
    return packs


class Slots:
    """Where the r-th item of a size goes: arrays over configurations, sorted by rank."""

    def __init__(self, packs: list[tuple[dict[int, int], int]]):
        base = 0
        rows: dict[int, list[tuple[int, int, int]]] = {}
        seen: dict[int, int] = {}
        for counts, times in packs:
            for size, per in counts.items():
                rows.setdefault(size, []).append((seen.get(size, 0), base, per))
                seen[size] = seen.get(size, 0) + per * times
            base += times
        self.packs = base
        self.by_size = {s: np.array(r, np.int64) for s, r in rows.items()}

    def pack_of(self, size: int, ranks: np.ndarray) -> np.ndarray:
        table = self.by_size[size]
        k = np.searchsorted(table[:, 0], ranks, side="right") - 1
        return table[k, 1] + (ranks - table[k, 0]) // table[k, 2]


def _deal(slots: dict[int, Slots], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, step, rank = (batch.column(i).to_numpy() for i in range(3))
            out = np.zeros(len(kind), np.int64)
            order = np.lexsort((step, kind))
            new = np.flatnonzero(np.append(True, (np.diff(kind[order]) != 0) | (np.diff(step[order]) != 0))) if len(kind) else []
            for part in np.split(order, new[1:]) if len(kind) else []:
                out[part] = slots[int(kind[part[0]])].pack_of(int(step[part[0]]), rank[part])
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[3:], pa.array(out)], [batch.schema.names[0], *names, "pack_no"])

    return run


def items(sized: DataFrame, capacities: dict[int, int], row_id: str = "doc_id") -> DataFrame:
    """(pack_id, row_id, part, tok_start, tok_end): texts, and parts of texts larger than a pack.

    Only such texts are split: into full packs and a rest.
    """
    table = F.array(*(F.struct(F.lit(int(k)).alias("pack_id"), F.lit(int(c)).cast("long").alias("capacity")) for k, c in sorted(capacities.items())))
    rows = sized.where("n_tokens > 0").select(row_id, "n_tokens", F.explode(table).alias("p"))
    parts = F.floor((F.col("n_tokens") - 1) / F.col("p.capacity"))
    return rows.select("p.pack_id", "p.capacity", row_id, "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), parts)).alias("part")).select(
        "pack_id",
        "capacity",
        row_id,
        F.col("part").cast("int").alias("part"),
        (F.col("part") * F.col("capacity")).alias("tok_start"),
        F.least("n_tokens", (F.col("part") + 1) * F.col("capacity")).alias("tok_end"),
    )


#: Items of one bucket: a window of one size sorts at most about that many.
BUCKET_ITEMS = 500_000


def _histogram(rows: DataFrame, capacities: dict[int, int], grid: int, rounds: int) -> dict[int, tuple]:
    """Plan and figures for each pack_id, from counts by size: at most ``grid`` of them a capacity."""
    histogram: dict[int, dict[int, int]] = {}
    for r in rows.groupBy("pack_id", "step").agg(F.count("*").alias("n")).collect():
        histogram.setdefault(r["pack_id"], {})[r["step"]] = r["n"]
    return {k: plan_packs(sizes, capacities[k] // max(1, -(-capacities[k] // grid)), rounds=rounds) for k, sizes in histogram.items()}


def _stepped(sized: DataFrame, capacities: dict[int, int], row_id: str, grid: int) -> DataFrame:
    if not capacities or min(capacities.values()) < 1:
        raise ValueError("capacities must be positive")
    unit = F.greatest(F.lit(1), F.ceil(F.col("capacity") / grid)).cast("long")
    full = F.floor(F.col("capacity") / unit)
    return items(sized, capacities, row_id).withColumn("step", F.least(full, F.ceil((F.col("tok_end") - F.col("tok_start")) / unit)).cast("int"))


def pack(sized: DataFrame, capacities: dict[int, int], row_id: str = "doc_id", grid: int = 1024, buckets: int | None = None, rounds: int = 64) -> DataFrame:
    """(pack_id, row_id, part, tok_start, tok_end, pack_no) for every item of every capacity.

    ``sized`` has ``row_id`` and ``n_tokens``; texts of 0 or null tokens need no
    room and are left out.  ``capacities`` maps pack_id to tokens.  Rows are
    kept whole: one row per part, repeated row ids are separate items.
    """
    rows = cut(_stepped(sized, capacities, row_id, grid))
    if buckets is None:
        buckets = max(16, math.ceil(rows.count() / BUCKET_ITEMS))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(row_id, "part"), F.lit(buckets)).cast("int"))
    # At most grid * buckets counts a capacity.
    counted = rows.groupBy("pack_id", "step", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("pack_id", "step").orderBy("bucket")) - F.col("n")
    offsets = cut(counted.withColumn("before", before).drop("n"))
    slots = {k: Slots(packs) for k, (packs, _) in _histogram(rows, capacities, grid, rounds).items()}
    inside = F.row_number().over(Window.partitionBy("pack_id", "step", "bucket").orderBy(row_id, "part")) - 1
    ranked = rows.withColumn("inside", inside).join(offsets, ["pack_id", "step", "bucket"])
    named = ranked.select("pack_id", "step", (F.col("inside") + F.col("before")).alias("rank"), row_id, "part", "tok_start", "tok_end")
    kind = sized.schema[row_id].dataType.simpleString()
    keep = [row_id, "part", "tok_start", "tok_end"]
    return named.mapInArrow(_deal(slots, keep), f"pack_id int, `{row_id}` {kind}, part int, tok_start long, tok_end long, pack_no long")


def pack_summary(packed: DataFrame, capacities: dict[int, int]) -> DataFrame:
    """(pack_id, capacity_tokens, packs, items, tokens, fill, least_packs) per capacity."""
    per = packed.groupBy("pack_id", "pack_no").agg(F.sum(F.col("tok_end") - F.col("tok_start")).alias("tokens"), F.count("*").alias("items"))
    table = F.create_map(*(F.lit(x) for k, c in capacities.items() for x in (int(k), int(c))))
    cap = table[F.col("pack_id")].cast("long")
    return per.groupBy("pack_id").agg(F.count("*").alias("packs"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest")).select(
        "pack_id",
        cap.alias("capacity_tokens"),
        "packs",
        "items",
        "tokens",
        "fullest",
        (F.col("tokens") / (F.col("packs") * cap)).alias("fill"),
        F.ceil(F.col("tokens") / cap).cast("long").alias("least_packs"),
    )


def pack_bounds(sized: DataFrame, capacities: dict[int, int], row_id: str = "doc_id", grid: int = 1024, rounds: int = 64) -> DataFrame:
    """(pack_id, capacity_tokens, packs, by_program, best_fit, bound) per capacity.

    ``by_program`` packs come from the linear program, the rest were placed
    best-fit; best-fit alone needs ``best_fit``.  ``bound`` is the least number
    of packs for the sizes as rounded up to the grid, by the program's dual.
    """
    rows = cut(_stepped(sized, capacities, row_id, grid))
    out = []
    for k, (_, figures) in sorted(_histogram(rows, capacities, grid, rounds).items()):
        out.append((k, capacities[k], *(figures[c] for c in ("packs", "by_program", "best_fit", "bound"))))
    return sized.sparkSession.createDataFrame(out, "pack_id int, capacity_tokens long, packs long, by_program long, best_fit long, bound long")
