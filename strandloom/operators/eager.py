"""Joined aggregation without the imbalance of a few heavy keys.

A join followed by a grouping sends every row of a heavy key to one task.  Here
both inputs are aggregated by join key first, which Spark does inside each input
partition before it shuffles; what is joined are compact states, one for each
join key and output key.  Joining states multiplies: each side's counts scale
the other side's sums.  A final grouping rolls the products up.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Side:
    """One input: join keys by common name, output keys and values by output name.

    ``sums`` are totals over the joined rows, ``extremes`` maps an output name to
    (function, column) with function "min" or "max", which repetition can't change.
    """

    rows: DataFrame
    keys: dict[str, Column]
    groups: dict[str, Column] = field(default_factory=dict)
    sums: dict[str, Column] = field(default_factory=dict)
    extremes: dict[str, tuple[str, Column]] = field(default_factory=dict)

    def states(self, mark: str) -> DataFrame:
        """One row per join key and output key: ``n``, partial sums, extremes."""
        pick = [
            *(c.alias(f"k_{n}") for n, c in self.keys.items()),
            *(c.alias(f"g_{n}") for n, c in self.groups.items()),
            *(c.alias(f"s_{n}") for n, c in self.sums.items()),
            *(c.alias(f"x_{n}") for n, (_, c) in self.extremes.items()),
        ]
        by = [*(f"k_{n}" for n in self.keys), *(f"g_{n}" for n in self.groups)]
        return self.rows.select(*pick).groupBy(*by).agg(
            F.count("*").alias(f"n_{mark}"),
            *(F.sum(f"s_{n}").alias(f"s_{n}") for n in self.sums),
            *(getattr(F, f)(f"x_{n}").alias(f"x_{n}") for n, (f, _) in self.extremes.items()),
        )


def join_aggregate(left: Side, right: Side, how: str = "inner", count: str = "rows", own: tuple[str, str] | None = None) -> DataFrame:
    """Group the join of both sides by their output keys.

    Output: the groups of both sides, ``count`` (joined rows), their sums and
    extremes.  Both sides name the same join keys.  ``how`` is "inner" or
    "left": then left rows without partner count once, with null right groups
    and values.  Null join keys match nothing.  Sums of no non-null value are
    null; an empty input gives an empty result.  Output names must differ.
    ``own`` names two more outputs: how many rows each side itself brings to a
    group (a right row joined from several states of the left side counts for
    each of them).
    """
    if how not in ("inner", "left") or set(left.keys) != set(right.keys):
        raise ValueError("how must be inner or left, and both sides need the same keys")
    a, b = left.states("a"), right.states("b")
    joined = a.join(b, [f"k_{n}" for n in left.keys], how).withColumn("n_b", F.coalesce("n_b", F.lit(1)))
    groups = [F.col(f"g_{n}").alias(n) for n in (*left.groups, *right.groups)]
    return joined.groupBy(*groups).agg(
        F.sum(F.col("n_a") * F.col("n_b")).alias(count),
        *(F.sum(n).alias(name) for n, name in zip(("n_a", "n_b"), own or (), strict=False)),
        *(F.sum(F.col(f"s_{n}") * F.col("n_b")).alias(n) for n in left.sums),
        *(F.sum(F.col(f"s_{n}") * F.col("n_a")).alias(n) for n in right.sums),
        *(getattr(F, f)(f"x_{n}").alias(n) for side in (left, right) for n, (f, _) in side.extremes.items()),
    )


def heavy_keys(df: DataFrame, group: str, key: str, share: float) -> DataFrame:
    """(group, key, rows, group_rows): keys with at least ``share`` of their group's rows with a key.

    The table is joined with itself by group through :func:`join_aggregate`: one
    side's states count the rows of each key, the other's those of the whole
    group, so a group of n rows costs one state a key instead of n * n pairs.
    Null keys do not count; a null group is left out.
    """
    rows = df.where(F.col(key).isNotNull()).select(F.col(group).alias("g"), F.col(key).alias("k"))
    keys = Side(rows, {"group": F.col("g")}, {"of": F.col("g"), "name": F.col("k")})
    whole = Side(rows, {"group": F.col("g")})
    joined = join_aggregate(keys, whole, count="pairs", own=("mine", "all"))
    heavy = joined.where(F.col("mine") / F.col("all") >= F.lit(share))
    return heavy.select(F.col("of").alias(group), F.col("name").alias(key), F.col("mine").alias("rows"), F.col("all").alias("group_rows"))
