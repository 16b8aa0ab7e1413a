"""Mixing sources to target weights along a time-varying curriculum.

Training time runs from 0 to 1.  Each source has a weight schedule over it: its
weights at common knots, linear between them, given as data.  Schedules are
fitted so that at every knot the shares of all sources sum to 1 and each
source's share over all time is what it is to contribute: then time is the
share of all tokens that went before.  Integrated, a schedule says how many of a
source's tokens are due by a given time; inverted, it gives the time at which
the token at a given cumulative offset is due.  Every draw of a document gets
the time of its middle token, and the mixture is the draws sorted by time: their
order needs no coordination between sources.

Cumulative offsets, within a source and over the whole mixture, are computed
without gathering rows: they are summed inside buckets, as many as the number of
rows asks for, and shifted by the sums of the buckets before.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from strandloom.session import cut


#: Rows of one bucket: a window sorts at most about that many.
BUCKET_ROWS = 500_000


def fit_schedules(shares: np.ndarray, weights: np.ndarray, knots: np.ndarray, rounds: int = 500) -> np.ndarray:
    """(sources, knots): shares of the sources at each knot, proportional scaling of ``weights``.

    Columns sum to 1 and the integral of each row is its share of ``shares``.
    Weights must not be negative; a row without weight is level.
    """
    span = np.diff(knots)
    mass = (np.append(span, 0) + np.append(0, span)) / 2  # what a knot counts for in the integral
    table = np.where(weights.sum(1, keepdims=True) > 0, weights, 1.0) + 1e-9
    for _ in range(rounds):
        table = table * (shares / (table @ mass))[:, None]
        table = table / table.sum(0)
        if np.abs(table @ mass - shares).max() < 1e-12:
            break
    return table


def due_time(done: Column, knots: list[float], table: list[Column], upto: list[Column]) -> Column:
    """The time at which ``done`` of all tokens are due from a source with these shares at the knots.

    ``upto`` is the integral up to each knot.  Within a stretch that begins with
    share w and ends with v the integral is w t + (v - w) t^2 / 2 h; its inverse
    is the root that lies in 0..h.
    """
    out = F.lit(1.0)
    for k in reversed(range(len(knots) - 1)):
        h, w, v = knots[k + 1] - knots[k], table[k], table[k + 1]
        rest = F.greatest(F.lit(0.0), done - upto[k])
        root = F.sqrt(F.greatest(F.lit(0.0), w * w + 2 * (v - w) / h * rest))
        here = F.lit(knots[k]) + F.least(F.lit(h), F.coalesce(F.try_divide(2 * rest, w + root), F.lit(0.0)))
        out = F.when(done <= upto[k + 1], here).otherwise(out)
    return out


#: Sources that together hold at most this part of the target shares may fall short of them without holding the total down.
SHORT_SHARE = 0.1


def _plan(sized: DataFrame, targets: DataFrame, source: str, size: str, budget: int | None, short_share: float) -> DataFrame:
    """One row per source that has tokens: tokens, demand; small, as it has no more rows than targets.

    The windows hold these few rows, sorted by the total that a source can serve at its share within its repeats.
    """
    have = sized.where(F.col(size) > 0).groupBy(source).agg(F.sum(size).alias("tokens"))
    plan = targets.select(
        F.col("source").alias(source), F.col("target_share").cast("double").alias("target_share"),
        F.coalesce("max_repeats", F.lit(1)).cast("long").alias("max_repeats"),
    ).where("target_share > 0 and max_repeats > 0").join(have, source)
    most, limit = F.col("tokens") * F.col("max_repeats"), F.col("most") / F.col("target_share")
    plan = plan.withColumn("most", most).withColumn("limit", limit)
    every, upto = Window.partitionBy(), Window.partitionBy().orderBy("limit", source).rowsBetween(Window.unboundedPreceding, 0)
    known = plan.withColumn("all_shares", F.sum("target_share").over(every)).withColumn("short", F.sum("target_share").over(upto))
    known = known.withColumn("before", F.sum("most").over(upto) - F.col("most"))
    total = F.min(F.when(F.col("short") > short_share * F.col("all_shares"), F.col("limit"))).over(every)
    if budget is not None:
        # Where the sources before have given all they have, the rest of the budget falls to this one and those after it.
        needed = (F.lit(float(budget)) - F.col("before")) / (F.col("all_shares") - F.col("short") + F.col("target_share"))
        total = F.least(total, F.max(needed).over(every))
    demand = F.least(F.col("most").cast("double"), F.col("total") * F.col("target_share"))
    return known.withColumn("total", total).withColumn("demand", demand).select(source, "max_repeats", "tokens", "demand")


def _scheduled(plan: DataFrame, schedules: DataFrame | None, source: str) -> tuple[DataFrame, list[float]]:
    """The plan with its fitted shares ``w0``.. and integrals ``u0``.. at the knots; sources and knots are few."""
    rows = plan.collect()  # as many as targets
    given: dict = {}
    if schedules is not None:
        for r in schedules.select("source", "at", "weight").collect():
            given.setdefault(r["source"], {})[float(r["at"])] = float(r["weight"])
    knots = np.array(sorted({0.0, 1.0, *(t for s in given.values() for t in s if 0 <= t <= 1)}))
    weights = np.array([np.interp(knots, *zip(*sorted(given[r[source]].items()), strict=True)) if r[source] in given else np.ones(len(knots)) for r in rows])
    total = sum(r["demand"] for r in rows)
    if rows:
        table = fit_schedules(np.array([r["demand"] / total for r in rows]), weights.reshape(len(rows), len(knots)), knots)
        upto = np.concatenate((np.zeros((len(rows), 1)), np.cumsum((table[:, 1:] + table[:, :-1]) / 2 * np.diff(knots), axis=1)), axis=1)
    out = [(*r, float(total), *map(float, table[i]), *map(float, upto[i])) for i, r in enumerate(rows)]
    kind = plan.schema[source].dataType.simpleString()
    names = [f"{c}{k} double" for c in "wu" for k in range(len(knots))]
    return plan.sparkSession.createDataFrame(out, f"`{source}` {kind}, max_repeats long, tokens long, demand double, total double, " + ", ".join(names)), knots.tolist()


def mix(
    sized: DataFrame,
    targets: DataFrame,
    schedules: DataFrame | None = None,
    row_id: str = "doc_id",
    source: str = "source",
    size: str = "n_tokens",
    budget: int | None = None,
    seed: int = 1,
    buckets: int | None = None,
    short_share: float = SHORT_SHARE,
) -> DataFrame:
    """(row_id, source, repeat_no, n_tokens, due, token_start): the draws of the mixture.

    ``targets`` has source (unique), target_share and max_repeats.  ``schedules``
    has source, at (0..1) and weight: the source's weight at that time, relative
    to its other times; a source without rows keeps its share level, as far as
    the others let it.  A source that
    cannot reach its share gives all it has, max_repeats times, and one without
    tokens nothing; the others are drawn in their target proportions.  The total
    these are held to is the largest at which the sources that fall short hold
    at most ``short_share`` of the target shares of all sources with tokens (0:
    the largest that all of them can serve), or what makes all draws together
    ``budget`` if that is less.  A document is drawn if its middle token falls
    within its source's demand, so the tokens of a source are off by at most
    half a document.  ``repeat_no`` counts from 1 and never exceeds max_repeats.
    ``due`` is the time of a draw, ``token_start`` the number of tokens of all
    draws before it in the order of (due, row_id, repeat_no).  Documents without
    tokens, of a null source, or of a source without target are not drawn;
    repeated row ids are separate documents.
    """
    rows = cut(sized.where((F.col(size) > 0) & F.col(source).isNotNull()).select(row_id, source, F.col(size).cast("long").alias("n")))
    plan, knots = _scheduled(_plan(rows, targets, source, "n", budget, short_share), schedules, source)
    if buckets is None:
        buckets = max(16, math.ceil(rows.count() / BUCKET_ROWS))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), F.col(row_id)), F.lit(buckets)).cast("int"))
    # At most sources * buckets sums.
    sums = rows.groupBy(source, "bucket").agg(F.sum("n").alias("s"))
    starts = sums.withColumn("before", F.sum("s").over(Window.partitionBy(source).orderBy("bucket")) - F.col("s")).drop("s")
    inside = Window.partitionBy(source, "bucket").orderBy(F.xxhash64(F.lit(seed + 1), F.col(row_id)), row_id)
    placed = rows.withColumn("upto", F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0))).join(starts, [source, "bucket"])
    middle = F.col("before") + F.col("upto") - F.col("n") / 2
    known = placed.join(plan, source).withColumn("middle", middle)
    most = F.least(F.col("max_repeats") - 1, F.floor((F.col("demand") - F.col("middle")) / F.col("tokens")))
    drawn = known.where("middle <= demand").withColumn("again", F.explode(F.sequence(F.lit(0).cast("long"), most.cast("long"))))
    done = (F.col("again") * F.col("tokens") + F.col("middle")) / F.col("total")
    every = range(len(knots))
    due = due_time(done, knots, [F.col(f"w{k}") for k in every], [F.col(f"u{k}") for k in every])
    draws = cut(drawn.select(row_id, source, (F.col("again") + 1).cast("int").alias("repeat_no"), F.col("n").alias("n_tokens"), due.alias("due")))
    slices = draws.withColumn("slice", F.floor(F.col("due") * buckets))
    totals = slices.groupBy("slice").agg(F.sum("n_tokens").alias("s"))  # one row a bucket
    totals = totals.select("slice", (F.sum("s").over(Window.orderBy("slice")) - F.col("s")).alias("before"))
    along = Window.partitionBy("slice").orderBy("due", row_id, "repeat_no").rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("before") + F.sum("n_tokens").over(along) - F.col("n_tokens")
    return slices.join(totals, "slice").withColumn("token_start", start).select(row_id, source, "repeat_no", "n_tokens", "due", "token_start")


def in_training_order(draws: DataFrame, row_id: str = "doc_id") -> DataFrame:
    """The draws range-partitioned and sorted by the time they are due."""
    return draws.repartitionByRange("due", row_id, "repeat_no").sortWithinPartitions("due", row_id, "repeat_no")


def shares(draws: DataFrame, targets: DataFrame, source: str = "source") -> DataFrame:
    """(source, target_share, tokens, share, shortfall, most_repeats) for every target source.

    ``shortfall`` is what the share reached lacks of the target share, or 0.
    """
    per = draws.groupBy(source).agg(F.sum("n_tokens").alias("tokens"), F.max("repeat_no").alias("most_repeats"))
    known = targets.select(F.col("source").alias(source), "target_share").join(per, source, "left").fillna(0, ["tokens", "most_repeats"])
    total = F.sum("tokens").over(Window.partitionBy())
    known = known.withColumn("share", F.when(total > 0, F.col("tokens") / total).otherwise(0.0))
    shortfall = F.greatest(F.lit(0.0), F.col("target_share") - F.col("share")).alias("shortfall")
    return known.select(source, "target_share", "tokens", "share", shortfall, "most_repeats")


def slices(
    draws: DataFrame, sized: DataFrame, targets: DataFrame, schedules: DataFrame | None = None, parts: int = 10,
    source: str = "source", size: str = "n_tokens", budget: int | None = None, short_share: float = SHORT_SHARE,
) -> DataFrame:
    """(part, source, tokens, share, scheduled) for each of ``parts`` equal stretches of the token positions."""
    plan, knots = _scheduled(_plan(sized, targets, source, size, budget, short_share), schedules, source)
    grid = np.arange(parts + 1) / parts
    rows = []
    for r in plan.collect():  # as many as targets
        share = [r[f"w{k}"] for k in range(len(knots))]
        fine = np.unique(np.concatenate((grid, knots)))
        at = np.interp(fine, knots, share)
        upto = np.concatenate(([0.0], np.cumsum((at[1:] + at[:-1]) / 2 * np.diff(fine))))
        whole = np.interp(grid, fine, upto)
        rows += [(i, r[source], float(whole[i + 1] - whole[i]) * parts) for i in range(parts)]
    plans = draws.sparkSession.createDataFrame(rows, f"part int, `{source}` {draws.schema[source].dataType.simpleString()}, scheduled double")
    total = draws.agg(F.sum("n_tokens")).scalar()
    part = F.least(F.lit(parts - 1), F.floor((F.col("token_start") + F.col("n_tokens") / 2) * parts / total)).cast("int")
    per = draws.groupBy(part.alias("part"), source).agg(F.sum("n_tokens").alias("tokens"))
    known = plans.join(per, ["part", source], "left").fillna(0, ["tokens"])
    return known.select("part", source, "tokens", (F.col("tokens") / F.sum("tokens").over(Window.partitionBy("part"))).alias("share"), "scheduled")
