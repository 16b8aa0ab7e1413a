"""Cutting oversized texts at natural boundaries, by pointer doubling.

A text is a row of stretches separated by boundaries (runs of at least
``run_letters`` filler letters).  A piece starts either at a stretch or, where a
stretch is longer than the limit, ``limit - overlap`` letters after the previous
start inside it; these starts are the nodes.  Every node is joined to its
farthest legal successor: behind the last boundary within reach or, if there is
none, at the next forced cut.  Squaring this successor table log2(nodes) times
and following the jumps from the first node marks all greedy cuts at once,
instead of walking the text piece by piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from strandloom.session import cut, discard


def stretches(df: DataFrame, key: Column, text: Column, run_letters: int = 10, filler: str = "N") -> DataFrame:
    """(key, length, stretch, stretch_start, stretch_end) of every text with content.

    ``stretch`` numbers the stretches of a text from 0.  Offsets are 0-based,
    ends exclusive.  Null texts, empty texts and texts of one boundary only have
    none.  The text is split where a boundary begins or ends, in the JVM.
    """
    f = f"[{filler.upper()}{filler.lower()}]"
    begins = f"(?<!{f})(?={f}{{{run_letters}}})"
    ends = f"(?<={f}{{{run_letters}}})(?!{f})"
    rows = df.select(key.alias("key"), text.cast("string").alias("text")).where("length(text) > 0")
    parts = F.split("text", f"{begins}|{ends}")
    sized = rows.select(
        "key",
        F.length("text").cast("long").alias("length"),
        F.posexplode(F.transform(parts, lambda p: F.struct(F.length(p).cast("long").alias("n"), p.rlike(f"^{f}{{{run_letters},}}$").alias("boundary")))).alias("i", "p"),
    )
    order = Window.partitionBy("key").orderBy("i")
    placed = sized.withColumn("b", F.sum("p.n").over(order)).where("not p.boundary and p.n > 0")
    return placed.select(
        "key", "length", (F.row_number().over(order) - 1).alias("stretch"), (F.col("b") - F.col("p.n")).alias("stretch_start"), F.col("b").alias("stretch_end")
    )


def _successors(parts: DataFrame, limit: int, overlap: int) -> DataFrame:
    """(key, node, start, stop, next): each possible piece with the start of its successor.

    ``next`` is null behind the last piece.  A node is its start offset.
    """
    step = limit - overlap
    steps = F.greatest(F.lit(0), F.ceil((F.col("stretch_end") - F.col("stretch_start") - limit) / step))
    starts = parts.select("*", F.explode(F.sequence(F.lit(0).cast("long"), steps.cast("long"))).alias("forced")).withColumn(
        "start", F.col("stretch_start") + F.col("forced") * step
    )
    # The farthest boundary in reach: all stretch ends of the text are in order,
    # so the last one at or below start + limit is the greatest of them.
    ends = parts.select("key", F.col("stretch_end").alias("e"), F.lead("stretch_start").over(Window.partitionBy("key").orderBy("stretch_start")).alias("after"))
    # Ends lie within limit of a start, so both sides meet in at most two tiles.
    reach = starts.select("key", "start", "stretch_end", F.explode(F.array(F.floor(F.col("start") / limit), F.floor(F.col("start") / limit) + 1)).alias("tile"))
    tiled = ends.withColumn("tile", F.floor((F.col("e") - 1) / limit))
    near = reach.join(tiled, ["key", "tile"], "left").where("e > start and e <= start + %d" % limit)
    best = near.groupBy("key", "start").agg(F.max(F.struct("e", "after")).alias("best"))
    joined = starts.select("key", "start").join(best, ["key", "start"], "left")
    return joined.select(
        "key",
        F.col("start").alias("node"),
        F.coalesce(F.col("best.e"), F.col("start") + limit).alias("stop"),
        F.when(F.col("best.e").isNotNull(), F.col("best.after")).otherwise(F.col("start") + step).alias("next"),
    )


def pieces(parts: DataFrame, limit: int, overlap: int) -> DataFrame:
    """(key, piece, piece_start, piece_end, natural) from the output of stretches().

    ``natural`` says whether the piece ends at a boundary or at the end of the
    text; the next piece then starts behind the boundary.  Otherwise the next
    one starts ``overlap`` letters before the cut.  No piece exceeds ``limit``;
    texts within the limit are one piece from their first stretch to their last.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    table = cut(_successors(parts, limit, overlap))
    jump = table.select("key", "node", F.col("next").alias("to"))
    reached = cut(parts.groupBy("key").agg(F.min("stretch_start").alias("node")))
    # Doubling: after round i every node within 2**i pieces of the start is reached.
    size = 0
    while True:
        step = reached.join(jump, ["key", "node"]).where("to is not null").select("key", F.col("to").alias("node"))
        last, reached = reached, cut(reached.unionByName(step).distinct())
        discard(last)
        grown = reached.count()
        if grown == size:
            break
        size = grown
        far = jump.select("key", F.col("node").alias("to"), F.col("to").alias("beyond"))
        last, jump = jump, cut(jump.where("to is not null").join(far, ["key", "to"]).where("beyond is not null").select("key", "node", F.col("beyond").alias("to")))
        discard(last)
    chosen = table.join(reached, ["key", "node"])
    order = Window.partitionBy("key").orderBy("node")
    natural = F.col("next").isNull() | (F.col("next") > F.col("stop"))
    return chosen.select(
        "key",
        (F.row_number().over(order) - 1).alias("piece"),
        F.col("node").alias("piece_start"),
        F.col("stop").alias("piece_end"),
        natural.alias("natural"),
    )


def split_texts(df: DataFrame, key: Column, text: Column, limit: int = 12_000, overlap: int = 200, run_letters: int = 10, filler: str = "N") -> DataFrame:
    """Pieces of every text; see pieces().  Keys must be unique.

    Texts without content have no pieces.  Boundaries at the ends of a text
    belong to no piece.  A null key is not cut (it can't be joined).
    """
    return pieces(stretches(df, key, text, run_letters, filler), limit, overlap)


def stretches_of_pieces(parts: DataFrame, cuts: DataFrame) -> DataFrame:
    """(key, seg_start, seg_end): what the pieces hold between boundaries, put together again.

    A sweep over the edges of pieces and of boundaries, which are what lies
    between two stretches of ``parts``: a segment is where some piece is open and
    no boundary.  Letters that no piece holds break a segment or are missing.
    """
    follows = Window.partitionBy("key").orderBy("stretch_start")
    gaps = parts.select("key", F.col("stretch_end").alias("a"), F.lead("stretch_start").over(follows).alias("b")).where("b is not null")

    def edges(rows: DataFrame, begin: str, end: str, piece: int, boundary: int) -> DataFrame:
        both = F.array(*(F.struct(F.col(c).alias("p"), F.lit(sign * piece).alias("open"), F.lit(sign * boundary).alias("shut")) for c, sign in ((begin, 1), (end, -1))))
        return rows.select("key", F.inline(both))

    every = edges(cuts, "piece_start", "piece_end", 1, 0).unionByName(edges(gaps, "a", "b", 0, 1))
    along = Window.partitionBy("key").orderBy("p")
    steps = every.groupBy("key", "p").agg(F.sum("open").alias("open"), F.sum("shut").alias("shut"))
    inside = (F.sum("open").over(along) > 0) & (F.sum("shut").over(along) == 0)
    steps = steps.select("key", "p", inside.alias("inside")).withColumn("was", F.lag("inside", 1, False).over(along))
    turns = steps.where("inside <> was")  # begins and ends of segments, in turn
    return turns.select("key", F.col("p").alias("seg_start"), F.lead("p").over(along).alias("seg_end"), "inside").where("inside").drop("inside")
