"""Context statistics: how compressible each column is under adaptive models."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from strandloom.functions.quality import BIN16, BIN42, DELTA_BIN, DELTA_CAP, phred
from strandloom.operators.kmers import both_strands, kmer_rows

#: Caps of the prior tables.
PAIR_CAP, GENOME_CAP = 250, 100


def nucleotide_contexts(df: DataFrame, seq: Column, k: int, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """(keep.., context, symbol, at): each letter after its ``k`` preceding ones, ACGT only."""
    rows = kmer_rows(df, seq, k + 1, keep).withColumnRenamed("kmer", "w")
    return rows.select(*keep, "at", F.substring("w", 1, k).alias("context"), F.substring("w", k + 1, 1).alias("symbol"))


def context_counts(rows: DataFrame, context: list[str], symbol: str) -> DataFrame:
    return rows.groupBy(*context, symbol).agg(F.count("*").alias("n"))


def entropy(counts: DataFrame, context: list[str], symbol: str) -> DataFrame:
    """One row (symbols, bits, bits_per_symbol): empirical conditional entropy of counts."""
    joined = counts.withColumn("_t", F.sum("n").over(Window.partitionBy(*context)))  # a context has as many rows as symbols
    bits = F.sum(-F.col("n") * F.log2(F.col("n") / F.col("_t")))
    return joined.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("symbols"), F.coalesce(bits, F.lit(0.0)).alias("bits")).withColumn(
        "bits_per_symbol", F.when(F.col("symbols") > 0, F.col("bits") / F.col("symbols"))
    )


def adaptive_bits(counts: DataFrame, context: list[str], symbol: str, alphabet: int) -> DataFrame:
    """(context.., symbols, bits): code length of an adaptive model without halving.

    Every symbol starts with count 1 and is coded with its share so far.  The
    product of these shares does not depend on the order of the symbols:
    bits = log2((N + A - 1)! / (A - 1)!) - sum(log2(n_s!)), so the counts suffice
    and no order has to be gathered.
    """
    parts = counts.groupBy(*context).agg(F.sum("n").alias("symbols"), F.sum(_log2_factorial(F.col("n"))).alias("_own"))
    whole = _log2_factorial(F.col("symbols") + (alphabet - 1)) - math.lgamma(alphabet) / math.log(2)
    return parts.select(*context, "symbols", (whole - F.col("_own")).alias("bits"))


def _log2_factorial(n: Column) -> Column:
    """log2(n!): exact sums of logarithms to 16, Stirling's series beyond (error below 1e-12)."""
    x = n.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    small = F.array(*(F.lit(math.lgamma(i + 1)) for i in range(17)))
    return F.when(n <= 16, F.element_at(small, (F.least(n, F.lit(16)) + 1).cast("int"))).otherwise(series) / math.log(2)


def halving_bits(rows: DataFrame, context: list[str], order: list[str], symbol: str, alphabet: int, rate: int = 8, delay: int = 1) -> DataFrame:
    """(context.., symbols, bits): code length of a model that forgets.

    Counts start at 1, grow by ``rate`` and are halved, to at least 1, when their
    total exceeds 2**15 at a refresh; shares are those of the last refresh, every
    ``delay`` symbols.  That makes each context a fold in file order, done
    over Arrow batches of the context's rows: choose contexts fine enough, for
    instance with the file, that one of them fits a task.  ``symbol`` counts from 0.
    """

    from strandloom.operators.codec import Model

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        model, bits = Model(alphabet, rate, delay), 0.0
        for s in pdf.sort_values(order)[symbol]:
            bits -= math.log2(model.shares[s] / model.total)
            model.saw(s)
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in context}, "symbols": [len(pdf)], "bits": [bits]})

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in context)
    return rows.select(*context, *order, symbol).groupBy(*context).applyInPandas(fold, f"{kinds}, symbols long, bits double")


def quality_pairs(df: DataFrame, qual: Column, base: int = 33, top: int = 40, cap: int = PAIR_CAP) -> DataFrame:
    """(q0, q1, n): consecutive scores of 0..top, counts capped."""
    scores = phred(qual, base)
    pairs = F.when(
        F.size(scores) >= 2,
        F.zip_with(F.slice(scores, F.lit(1), F.size(scores) - 1), F.slice(scores, F.lit(2), F.size(scores) - 1), lambda a, b: F.struct(a.alias("q0"), b.alias("q1"))),
    )
    rows = df.select(F.explode(pairs).alias("p")).select("p.q0", "p.q1").where(F.col("q0").between(0, top) & F.col("q1").between(0, top))
    return rows.groupBy("q0", "q1").agg(F.least(F.count("*"), F.lit(cap)).alias("n"))


#: Sizes of the context parts pos4, delta, q34, q2, q1 and of the score.
_PARTS = (4, 8, 16, 16, 42, 128)
_NAMES = ("pos4", "delta", "q34", "q2", "q1", "q")


def _lookup(steps: list[tuple[int, int]], size: int) -> np.ndarray:
    table = np.zeros(size, np.int64)
    for first, value in steps:
        table[first:] = value
    return table


def _count_contexts(base: int):
    """Per Arrow batch: every score with its context as one number, counted."""
    bin42, bin16, delta = _lookup(BIN42, 256), _lookup(BIN16, 64), _lookup(DELTA_BIN, DELTA_CAP + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0).cast(pa.string()).drop_null()
            _, offsets, data = column.buffers()
            at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
            raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
            q = np.maximum(raw.astype(np.int64) - base, 0)
            length = np.diff(at)
            start = np.repeat(at[:-1] - at[0], length)
            i = np.arange(len(q)) - start
            binned = bin42[q]

            def before(n: int, values: np.ndarray, i: np.ndarray = i) -> np.ndarray:
                """The value n scores earlier in the same read, 0 before its start."""
                out = np.zeros(len(values), np.int64)
                out[n:] = values[:-n] if n < len(values) else 0
                return np.where(i >= n, out, 0)

            q1 = before(1, binned)
            jump = (q1 - q < -1) | (q1 - q >= 1)
            total = np.concatenate(([0], np.cumsum(jump)))
            jumps = np.minimum(total[:-1] - total[start], DELTA_CAP)
            coarse = bin16[binned]
            quarter = np.repeat(-(-length // 4), length)
            parts = (i // np.maximum(quarter, 1), delta[jumps], np.maximum(before(3, coarse), before(4, coarse)), before(2, coarse), q1, q)
            code = np.zeros(len(q), np.int64)
            for size, part in zip(_PARTS, parts, strict=True):
                code = code * size + part
            codes, counts = np.unique(code, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], ["code", "n"])

    return run


def quality_context_counts(df: DataFrame, qual: Column, base: int = 33) -> DataFrame:
    """(pos4, delta, q34, q2, q1, q, n): scores counted under their model context.

    The context is that of functions.quality.contexts; here the scores of a
    whole Arrow batch are coded at once and only counts leave the batch.
    """
    coded = df.select(qual.cast("string").alias("qual")).mapInArrow(_count_contexts(base), "code long, n long")
    counts = coded.groupBy("code").agg(F.sum("n").alias("n"))
    out, rest = [], F.col("code")
    for name, size in reversed(list(zip(_NAMES, _PARTS, strict=True))):
        out.append(F.pmod(rest, F.lit(size)).cast("int").alias(name))
        rest = F.floor(rest / size)
    return counts.select(*reversed(out), "n")


def genome_prior(df: DataFrame, seq: Column, k: int, cap: int = GENOME_CAP) -> DataFrame:
    """(context, symbol, n): letters after their ``k`` preceding ones on both strands, capped."""
    rows = nucleotide_contexts(both_strands(df, F.upper(seq)), F.col("text"), k)
    return context_counts(rows, ["context"], "symbol").withColumn("n", F.least("n", F.lit(cap)))


def consensus(counts: DataFrame, place: list[str], symbol: str = "symbol") -> DataFrame:
    """(place.., symbol, n): the most frequent symbol of each place, the smallest of equal ones."""
    best = F.max_by(F.struct(symbol, "n"), F.struct("n", -F.ascii(symbol)))
    return counts.groupBy(*place).agg(best.alias("_b")).select(*place, F.col(f"_b.{symbol}").alias(symbol), F.col("_b.n").alias("n"))
