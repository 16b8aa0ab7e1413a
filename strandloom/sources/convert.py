"""Reading, writing and converting reads of any format."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators import archive
from strandloom.sources import NO_QUALITY, READ_SCHEMA, UNMAPPED, bam, fasta, fastq, register, sam
from strandloom.sources.files import expand, format_of_name, output_name, sniff


def as_reads(df: DataFrame) -> DataFrame:
    """Any table of reads in the full schema; absent columns get the defaults of an unaligned read."""
    defaults = {"flags": F.lit(UNMAPPED), "strand": F.lit(False), "map_qual": F.lit(NO_QUALITY), "tlen": F.lit(0)}
    out = []
    for item in _fields():
        name, kind = item
        value = F.col(name) if name in df.columns else defaults.get(name, F.lit(None))
        out.append(value.cast(kind).alias(name))
    return df.select(*out)


def _fields() -> list[tuple[str, str]]:
    """(name, type) of READ_SCHEMA; commas inside brackets belong to a type."""
    parts, depth, start = [], 0, 0
    for i, c in enumerate(READ_SCHEMA):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(READ_SCHEMA[start:i])
            start = i + 1
    parts.append(READ_SCHEMA[start:])
    return [tuple(p.strip().split(" ", 1)) for p in parts]


def _archived(path: str) -> bool:
    return path.rstrip("/").endswith(".reads")


def read(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:  # noqa: A002
    """Reads of files, folders or patterns, separated by commas.

    The format of each is found by content, by its first file, if not given; inputs
    of several formats are united.
    """
    register(spark)
    by_kind: dict[str, list[str]] = {}
    for part in (p.strip() for p in path.split(",")):
        kind = format or ("archive" if _archived(part) else sniff(part if os.path.isdir(f"{part}/blocks") else expand(part)[0])[0])
        by_kind.setdefault(kind, []).append(part)
    out = None
    for kind, parts in by_kind.items():
        for df in _of_kind(spark, kind, parts):
            out = df if out is None else out.unionByName(df)
    return out


def _of_kind(spark: SparkSession, kind: str, parts: list[str]) -> list[DataFrame]:
    if kind == "archive":
        return [as_reads(archive.read(spark, p)) for p in parts]
    if kind == "sam":
        return [as_reads(sam.read(spark, expand(",".join(parts))))]
    if kind in ("fastq", "fasta"):
        return [as_reads(spark.read.format("reads_fastq").load(",".join(parts)))]
    if kind == "bam":
        return [spark.read.format("reads_bam").load(",".join(parts))]
    raise ValueError(f"can't read reads of format {kind}")


def write(df: DataFrame, path: str, format: str, references: DataFrame | None = None, mode: str = "error") -> None:  # noqa: A002
    """Store reads; FASTQ keeps id, seq and qual only, BAM needs the references.  "null" discards them."""
    order = [c for c in ("_file", "_ord") if c in df.columns]
    if format == "fastq":
        fastq.write_text(df, path, order, mode)
    elif format == "sam":
        sam.write(df, path, sam.default_header(df.sparkSession, references), order, mode)
    elif format == "bam":
        if references is None:
            references = df.sparkSession.createDataFrame([], "seqname string, length long")
        bam.write(df, path, references, order=order, overwrite=mode == "overwrite")
    elif format == "archive":
        archive.write(df, path, mode=mode)
    elif format == "null":
        df.write.format("noop").mode("overwrite").save()
    else:
        raise ValueError(f"can't write format {format}")


def convert(spark: SparkSession, source: str, target: str | None = None, to: str | None = None, references: DataFrame | None = None, mode: str = "error") -> str:
    """Any format to any other; name and format of the target follow from each other or the source."""
    kind = to or (format_of_name(target) if target else None) or ("fastq" if _archived(source) else "archive")
    target = target or output_name(source.split(",")[0], kind)
    write(read(spark, source), target, kind, references, mode)
    return target


def list_archive(spark: SparkSession, path: str) -> DataFrame:
    """Reads, bases, raw and stored bytes of each file of an archive, from its block table alone."""
    archive.about(spark, path)
    return archive.summary(spark.read.parquet(f"{path}/blocks"))


def list_archives(spark: SparkSession, paths: list[str], force: bool = False) -> DataFrame:
    """list_archive() of several with their ``archive`` and ratios; names without the ending are left out unless forced."""
    out = None
    for path in paths:
        if force or _archived(path):
            listed = archive.ratios(list_archive(spark, path)).select(F.lit(path).alias("archive"), "*")
            out = listed if out is None else out.unionByName(listed)
    if out is None:
        raise ValueError("no archive among the inputs")
    return out


def test(spark: SparkSession, paths: list[str]) -> int:
    """Read every input and discard it; archives are verified, a damaged one raises.  Returns the reads."""
    total = 0
    for path in paths:
        if _archived(path):
            archive.verify(spark, path)
        total += read(spark, path).count()
    return total


__all__ = ["as_reads", "convert", "fasta", "list_archive", "list_archives", "read", "test", "write"]
