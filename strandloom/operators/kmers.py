"""Counting and indexing k-mers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from strandloom.functions.nucleotide import canonical, kmers, revcomp, tiles

#: K-mer lengths for counting and seeding, largest stored count, positions kept per seed.
COUNT_K, SEED_K, COUNT_CAP, SEED_CAP = 25, 12, 1023, 255


def kmer_rows(df: DataFrame, seq: Column, k: int, keep: list[str] = [], n_as_a: bool = False) -> DataFrame:  # noqa: B006
    """(keep.., kmer, at): all upper-case windows; those with other letters than ACGT are left out.

    ``n_as_a`` reads N as A first.
    """
    text = F.upper(seq)
    text = F.translate(text, "N", "A") if n_as_a else text
    cut = tiles(df, keep, text, k - 1)
    rows = cut.select(*keep, "tile_at", F.posexplode(kmers("tile_text", k)).alias("_at", "kmer"))
    return rows.where(F.col("kmer").rlike(f"^[ACGT]{{{k}}}$")).select(*keep, (F.col("tile_at") + F.col("_at")).alias("at"), "kmer")


def count_kmers(df: DataFrame, seq: Column, k: int = COUNT_K, cap: int | None = None, n_as_a: bool = False) -> DataFrame:
    """(kmer, n): canonical k-mers with their counts, at most ``cap``.

    Counts are summed in each input partition before the shuffle; a k-mer that
    all reads share costs one row a partition.
    """
    counted = kmer_rows(df, seq, k, n_as_a=n_as_a).groupBy(canonical("kmer").alias("kmer")).agg(F.count("*").alias("n"))
    return counted if cap is None else counted.withColumn("n", F.least("n", F.lit(cap)))


def spectrum(counts: DataFrame) -> DataFrame:
    """(n, kmers): how many k-mers occur n times."""
    return counts.groupBy("n").agg(F.count("*").alias("kmers"))


def approximate_counts(df: DataFrame, seq: Column, k: int = COUNT_K, depth: int = 4, width: int = 1 << 20) -> DataFrame:
    """(layer, cell, n): a count-min sketch of the canonical k-mers, depth * width cells at most.

    approximate_lookup() gives an upper bound of any k-mer's count.
    """
    hashed = kmer_rows(df, seq, k).select(canonical("kmer").alias("kmer"))
    cells = hashed.select(F.posexplode(F.array(*(F.pmod(F.xxhash64(F.lit(i), "kmer"), F.lit(width)) for i in range(depth)))).alias("layer", "cell"))
    return cells.groupBy("layer", "cell").agg(F.count("*").alias("n"))


def approximate_lookup(sketch: DataFrame, wanted: DataFrame, depth: int = 4, width: int = 1 << 20) -> DataFrame:
    """(kmer, n) for canonical k-mers in ``wanted.kmer``; 0 if certainly absent."""
    asked = wanted.select("kmer", F.posexplode(F.array(*(F.pmod(F.xxhash64(F.lit(i), "kmer"), F.lit(width)) for i in range(depth)))).alias("layer", "cell"))
    return asked.join(sketch, ["layer", "cell"], "left").groupBy("kmer").agg(F.min(F.coalesce("n", F.lit(0))).alias("n"))


def seed_index(contigs: DataFrame, name: str, seq: str, k: int = SEED_K, cap: int | None = SEED_CAP) -> DataFrame:
    """(kmer, contig, at, reverse): canonical k-mers of contigs with their positions.

    At most ``cap`` positions are kept for a k-mer, the first by contig and
    position, or all with None; Spark drops what is beyond the cap in each input
    partition before the shuffle, so a k-mer of all contigs is no task's.
    ``reverse`` says that the contig holds the reverse complement.
    """
    rows = kmer_rows(contigs, F.col(seq), k, [name]).select(
        F.col(name).alias("contig"), "at", canonical("kmer").alias("kmer"), (F.col("kmer") != canonical("kmer")).alias("reverse")
    )
    if cap is None:
        return rows
    order = Window.partitionBy("kmer").orderBy("contig", "at")
    return rows.withColumn("_no", F.row_number().over(order)).where(F.col("_no") <= cap).drop("_no")


def both_strands(df: DataFrame, seq: Column) -> DataFrame:
    """(text): each sequence and its reverse complement."""
    return df.select(F.explode(F.array(seq, revcomp(seq))).alias("text"))
