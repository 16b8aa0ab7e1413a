"""Connected components, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.session import cut, discard


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction; ``edges`` has (a, b) with a > b.

    Large star: every neighbour above a node moves to the node's smallest
    neighbour.  Small star: every neighbour below it does, and the node too.
    """
    if large:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = near.join(least, "u")
    if large:
        moved = moved.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = moved.select(F.explode(F.array("u", "v")).alias("a"), F.col("m").alias("b"))
    return moved.where("a > b").distinct()


def components(links: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """(id, part): every linked node with the smallest node of its component.

    Links are never collected; only a row count and a checksum reach the driver
    in each round.  Nulls and self links are ignored.  Rounds are logarithmic in
    the longest chain; an unfinished state after ``most_rounds`` is an error.
    """
    edges = cut(
        links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    )
    before = None
    for _ in range(most_rounds):
        last, edges = edges, cut(_star(_star(edges, large=True), large=False))
        discard(last)
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == before:
            done = edges.select(F.col("a").alias("id"), F.col("b").alias("part"))
            return done.unionByName(done.select(F.col("part").alias("id"), "part").distinct())
        before = now
    raise RuntimeError("components did not settle")


def connected(memberships: DataFrame, item: str, label: str) -> DataFrame:
    """(item, part): items that share a label, directly or through others, share a part.

    Each item is linked to the smallest item of each of its labels, so a label
    of n items gives n links and no pairs.
    """
    rows = cut(memberships.select(F.col(item).alias("i"), F.col(label).alias("l")).distinct())
    least = rows.groupBy("l").agg(F.min("i").alias("j"))
    found = components(rows.join(least, "l"), "i", "j")
    items = rows.select("i").distinct().join(found.withColumnRenamed("id", "i"), "i", "left")
    return items.select(F.col("i").alias(item), F.coalesce("part", "i").alias("part"))
