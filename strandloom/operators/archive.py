"""A columnar archive of reads in blocks, with a summary table beside it.

An archive is a folder: ``reads`` (Parquet, a block a row group or less, columns
coded separately), ``blocks`` (one row per block: reads, bases, raw and stored
bytes and a CRC-64 for each of id, aux, seq and qual) and ``about.json``.
Listing reads ``blocks`` alone; verifying recomputes the checksums.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from strandloom.functions import hashing, tags
from strandloom.operators.ordered import with_row_number
from strandloom.session import cut
from strandloom.sources import files

#: Reads of a block, archive versions that can be read, and the version written.
BLOCK_READS, VERSIONS, VERSION = 5000, (2, 3, 4), 4
COLUMNS = ("id", "aux", "seq", "qual")


def _numbered(df: DataFrame, part: list[str], order: list[str], reads: int) -> DataFrame:
    numbered = with_row_number(df, "_no", part, order)
    return numbered.withColumn("block", F.floor((F.col("_no") - 1) / reads))


def _combine(kind: str) -> Column:
    """Fold (crc, bytes) of a block's rows in order: pandas UDF over one array a block."""
    @F.pandas_udf("long")
    def fold(parts: pd.Series) -> pd.Series:
        out = []
        for rows in parts:
            crc = 0
            for row in rows:
                crc = hashing.crc64_combine(crc, row["c"] & (1 << 64) - 1, row["n"])
            out.append(crc - (1 << 64) if crc >> 63 else crc)
        return pd.Series(out)

    return fold(F.col(kind))


def block_checksums(df: DataFrame, texts: list[str], part: list[str], order: list[str], reads: int = BLOCK_READS) -> DataFrame:
    """(part.., block, reads, crc_<text>..): CRC-64 of each text column over the rows of a block in order.

    Every row is hashed where it lies; a block gathers (checksum, length) pairs
    of its ``reads`` rows, a fixed number, and combines them.
    """
    blocked = _numbered(df, part, order, reads)
    hashed = hashing.row_crcs(blocked, [*part, "block", "_no"], texts)
    grouped = hashed.groupBy(*part, "block").agg(
        F.count("*").alias("reads"),
        *(F.transform(F.array_sort(F.collect_list(F.struct("_no", F.col(f"crc_{t}").alias("c"), F.col(f"len_{t}").alias("n")))), lambda x: F.struct(x["c"], x["n"])).alias(t) for t in texts),
    )
    return grouped.select(*part, "block", "reads", *(hashing.hex64(_combine(t)).alias(f"crc_{t}") for t in texts))


def _with_text(df: DataFrame) -> DataFrame:
    """Reads with ``aux`` as text; absent columns are null."""
    aux = tags.format_tags("aux") if "aux" in df.columns else F.lit(None).cast("string")
    return df.withColumn("_aux", F.coalesce(aux, F.lit("")))


def block_table(df: DataFrame, part: list[str], order: list[str], reads: int = BLOCK_READS) -> DataFrame:
    """Block summaries with raw bytes and checksums, before anything is stored."""
    texts = _with_text(df).withColumn("aux_text", F.col("_aux"))
    plain = texts.select(*part, *order, "id", F.col("aux_text").alias("aux"), "seq", "qual")
    checks = block_checksums(plain, list(COLUMNS), part, order, reads)
    size = lambda c: F.sum(F.coalesce(F.octet_length(c), F.lit(0))).cast("long")
    totals = _numbered(plain, part, order, reads).groupBy(*part, "block").agg(
        F.sum(F.coalesce(F.length("seq"), F.lit(0))).cast("long").alias("bases"), *(size(c).alias(f"{c}_raw_bytes") for c in COLUMNS)
    )
    both = totals.join(checks, [*part, "block"])
    return both.select(*part, "block", "reads", "bases", *(f"{c}_raw_bytes" for c in COLUMNS), *(F.col(f"crc_{c}").alias(f"{c}_digest") for c in COLUMNS))


def _footers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(path, column, stored) of Parquet files, from their footers."""
    import pyarrow.parquet as pq

    for frame in frames:
        rows = []
        for path in frame["path"]:
            with files.raw(path) as f:
                about = pq.ParquetFile(f).metadata
                for g in range(about.num_row_groups):
                    for c in range(about.num_columns):
                        column = about.row_group(g).column(c)
                        rows.append((path, column.path_in_schema.split(".")[0], column.total_compressed_size))
        yield pd.DataFrame(rows, columns=["path", "column", "stored"])


def stored_bytes(spark: SparkSession, path: str, part: list[str]) -> DataFrame:
    """(part.., block, <column>_comp_bytes): what each column takes on disk.

    A file's bytes come from its footer and are shared out among its blocks by
    their raw bytes, so that the sums are those of the files.
    """
    rows = _with_text(spark.read.parquet(f"{path}/reads").withColumn("_path", F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")))
    text = {c: F.col("_aux") if c == "aux" else F.col(c) for c in COLUMNS}
    raw = rows.groupBy("_path", *part, "block").agg(*(F.sum(F.coalesce(F.octet_length(t), F.lit(0))).cast("double").alias(c) for c, t in text.items()))
    sizes = raw.select(F.col("_path").alias("path")).distinct().mapInPandas(_footers, "path string, column string, stored long")
    sizes = sizes.groupBy(F.col("path").alias("_path")).pivot("column", list(COLUMNS)).agg(F.sum("stored"))
    sizes = sizes.select("_path", *(F.col(c).alias(f"_{c}") for c in COLUMNS))
    along = Window.partitionBy("_path").orderBy(*part, "block")
    every = Window.partitionBy("_path")

    def share(c: str) -> Column:
        upto = lambda w: F.round(F.col(f"_{c}") * F.coalesce(F.try_divide(F.sum(c).over(w), F.sum(c).over(every)), F.lit(0.0)))
        before = along.rowsBetween(Window.unboundedPreceding, -1)
        return (upto(along.rowsBetween(Window.unboundedPreceding, 0)) - F.coalesce(upto(before), F.lit(0.0))).cast("long")

    shared = raw.join(sizes, "_path").select(*part, "block", *(share(c).alias(c) for c in COLUMNS))
    return shared.groupBy(*part, "block").agg(*(F.sum(c).alias(f"{c}_comp_bytes") for c in COLUMNS))


def write(df: DataFrame, path: str, part: list[str] | None = None, order: list[str] | None = None, reads: int = BLOCK_READS, about: dict | None = None, mode: str = "error") -> None:
    """Store reads with their block table; an existing archive is kept unless mode is "overwrite"."""
    part, order = part or ["_file"], order or ["_ord"]
    spark = df.sparkSession
    rows = _numbered(df, part, order, reads).drop("_no")
    rows.repartitionByRange(*part, "block").sortWithinPartitions(*part, "block", *order).write.mode(mode).option("compression", "zstd").parquet(f"{path}/reads")
    # The table describes what was stored, so a damaged write is noticed.
    stored = spark.read.parquet(f"{path}/reads")
    table = block_table(stored, part, order, reads).join(stored_bytes(spark, path, part), [*part, "block"], "left")
    table.write.mode(mode).parquet(f"{path}/blocks")
    text = json.dumps({"version": VERSION, "part": part, "order": order, "block_reads": reads, **(about or {})})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode(mode).text(f"{path}/about")


def about(spark: SparkSession, path: str) -> dict:
    """The archive's description; versions this library can't read are refused."""
    said = json.loads(spark.read.text(f"{path}/about", wholetext=True).first()[0])
    if said["version"] == 1:
        raise ValueError("archive version 1 is no longer read")
    if said["version"] not in VERSIONS:
        raise ValueError(f"archive version {said['version']} is newer than this library")
    return said


def read(spark: SparkSession, path: str) -> DataFrame:
    about(spark, path)
    return spark.read.parquet(f"{path}/reads").drop("block")


def verify(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(part.., block, column, expected, actual, ok); ``strict`` raises if any block is damaged."""
    said = about(spark, path)
    part, order = said["part"], said["order"]
    expected = spark.read.parquet(f"{path}/blocks")
    actual = block_table(spark.read.parquet(f"{path}/reads").drop("block"), part, order, said["block_reads"])
    pick = lambda d, name: d.select(*part, "block", F.explode(F.create_map(*(x for c in COLUMNS for x in (F.lit(c), F.col(f"{c}_digest"))))).alias("column", name))
    both = pick(expected, "expected").join(pick(actual, "actual"), [*part, "block", "column"], "full")
    out = both.withColumn("ok", F.col("expected").eqNullSafe(F.col("actual")))
    if strict:
        out = cut(out)
        bad = out.where(~F.col("ok")).count()
        if bad:
            raise ValueError(f"{bad} block columns are damaged in {path}")
    return out


def summary(blocks: DataFrame) -> DataFrame:
    """(_file, blocks, reads, bases, raw and stored bytes by column) from a block table alone."""
    sized = [f"{c}_{k}_bytes" for c in COLUMNS for k in ("raw", "comp") if f"{c}_{k}_bytes" in blocks.columns]
    return blocks.groupBy("_file").agg(F.count("*").alias("blocks"), F.sum("reads").alias("reads"), F.sum("bases").alias("bases"), *(F.sum(c).alias(c) for c in sized))


def ratios(listed: DataFrame) -> DataFrame:
    """Adds ``ratio`` (stored by raw bytes, one raw byte more for each read), one ratio a column, and bits per base; null where there is nothing."""
    raw = sum((F.col(f"{c}_raw_bytes") for c in COLUMNS), F.col("reads"))
    comp = sum((F.col(f"{c}_comp_bytes") for c in COLUMNS), F.lit(0))
    return listed.select(
        "*",
        F.try_divide(comp, raw).alias("ratio"),
        *(F.try_divide(F.col(f"{c}_comp_bytes"), F.col(f"{c}_raw_bytes")).alias(f"{c}_ratio") for c in COLUMNS),
        F.try_divide(F.col("seq_comp_bytes") * 8, F.col("bases")).alias("bits_per_base"),
    )
