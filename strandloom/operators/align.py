"""Seed-and-extend alignment of reads to contigs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from strandloom.functions.nucleotide import canonical, hamming, revcomp
from strandloom.operators import seeding
from strandloom.operators.kmers import SEED_CAP, SEED_K, seed_index
from strandloom.operators.reference import letters_under

#: Seed offsets, hits tried per seed, largest share of mismatches.
SEED_OFFSETS, HITS, MOST_MISMATCHES = (0, 24, 48), 100, 0.22


def seeds(reads: DataFrame, row_id: str, seq: Column, k: int = SEED_K) -> DataFrame:
    """(row_id, text, seed_no, at, kmer, flipped): canonical seeds at their offsets, clamped to the end."""
    rows = reads.select(row_id, F.upper(seq).alias("text")).where(F.length("text") >= k)
    offsets = F.array(*(F.struct(F.lit(i).alias("seed_no"), F.least(F.lit(o), F.length("text") - k).alias("at")) for i, o in enumerate(SEED_OFFSETS)))
    out = rows.select(row_id, "text", F.inline(offsets)).withColumn("word", F.substring("text", F.col("at") + 1, F.lit(k)))
    out = out.where(F.col("word").rlike(f"^[ACGT]{{{k}}}$"))
    return out.select(row_id, "text", "seed_no", "at", canonical("word").alias("kmer"), (F.col("word") != canonical("word")).alias("flipped"))


def seed_hits(reads: DataFrame, contigs: DataFrame, row_id: str, seq: Column, name: str, text: str, k: int = SEED_K, cap: int | None = HITS) -> DataFrame:
    """(row_id, seed_no, contig, begin, reverse): full-length placements that a seed proposes.

    At most ``cap`` index positions are tried for a seed, the first by contig and
    position, or all with None; a placement lies wholly inside its contig.
    """
    index = seed_index(contigs, name, text, k, cap if cap is None else min(SEED_CAP, cap))
    sizes = contigs.select(F.col(name).alias("contig"), F.length(text).alias("size"))
    mine = seeds(reads, row_id, seq, k).withColumn("_n", F.length("text")).drop("text")
    hit = mine.withColumnRenamed("at", "read_at").join(index, "kmer").withColumn("turned", F.col("flipped") != F.col("reverse"))
    begin = F.when(F.col("turned"), F.col("at") - (F.col("_n") - k - F.col("read_at"))).otherwise(F.col("at") - F.col("read_at"))
    placed = hit.withColumn("begin", begin).join(sizes, "contig").where((F.col("begin") >= 0) & (F.col("begin") + F.col("_n") <= F.col("size")))
    return placed.select(row_id, "seed_no", "contig", "begin", F.col("turned").alias("reverse"))


def align(reads: DataFrame, contigs: DataFrame, row_id: str, seq: str, name: str, text: str, k: int = SEED_K, most: float = MOST_MISMATCHES, cap: int | None = HITS) -> DataFrame:
    """(row_id, contig, begin, reverse, mismatches, length): the best placement of each read that has one.

    The smallest number of mismatches wins; of equal ones the earlier seed, then
    contig, then position.  Reads without an accepted placement are left out.
    Against a reference of at most ``seeding.LETTERS`` letters every batch of reads
    is placed where it is; hits and letters are joined otherwise.
    """
    if shared := seeding.packed(contigs, name, text, k):
        index_cap = cap if cap is None else min(SEED_CAP, cap)
        return seeding.place(reads, row_id, seq, shared, dict(contigs.dtypes)[name], k, SEED_OFFSETS, index_cap, most)
    hits = seed_hits(reads, contigs, row_id, F.col(seq), name, text, k, cap)
    tried = hits.groupBy(row_id, "contig", "begin", "reverse").agg(F.min("seed_no").alias("seed_no"))
    texts = reads.select(row_id, F.upper(seq).alias("query"))
    placed = tried.join(texts, row_id)
    n = F.length("query")
    named = contigs.select(F.col(name).alias("seqname"), F.col(text).alias("seq"))
    both = letters_under(placed, named, [row_id, "contig", "begin", "reverse"], "contig", "begin", n)
    side = F.when(F.col("reverse"), revcomp("query")).otherwise(F.col("query"))
    scored = both.select(row_id, "seed_no", "contig", "begin", "reverse", n.alias("length"), hamming(side, F.col("under")).alias("mismatches"))
    good = scored.where(F.col("mismatches") / F.col("length") <= most)
    best = Window.partitionBy(row_id).orderBy("mismatches", "seed_no", "contig", "begin", "reverse")
    return good.withColumn("_no", F.row_number().over(best)).where("_no = 1").drop("_no", "seed_no")


def unaligned(reads: DataFrame, aligned: DataFrame, row_id: str) -> DataFrame:
    """The reads without a placement."""
    return reads.join(aligned.select(row_id), row_id, "left_anti")


def route(reads: DataFrame) -> Column:
    """reference, model or none: aligned reads are coded against their reference, others with letters by the model."""
    placed = (F.col("flags").bitwiseAND(4) == 0) & F.col("seqname").isNotNull() & F.col("pos").isNotNull() & F.col("cigar").isNotNull()
    return F.when(placed, "reference").when(F.col("seq") != "", "model").otherwise("none")


def record_problem(reads: DataFrame) -> Column:
    """What makes a record one that no writer would make; null for sound ones."""
    mapped = F.col("flags").bitwiseAND(4) == 0
    return (
        F.when(F.length("seq") != F.length("qual"), "length of qualities")
        .when(F.col("pos") < 0, "position")
        .when(mapped & F.col("seqname").isNull(), "no reference")
        .when(F.col("id").isNull() | (F.col("id") == ""), "no name")
    )
