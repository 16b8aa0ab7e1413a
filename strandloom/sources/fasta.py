"""FASTA reference dictionaries."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from strandloom.sources.fastq import FilePartition
from strandloom.sources.files import SPLIT, Lines, lines_from, packing_of, splits

_ARROW = pa.schema([("seqname", pa.string()), ("seq", pa.string()), ("length", pa.int64())])


def sequences(lines: Lines, end: int | None = None) -> Iterator[tuple[str, str]]:
    """(name up to the first blank, letters) of the records that begin before ``end``.

    A record without letters is an error.
    """
    name, parts = None, []
    while (item := lines.next()) is not None:
        at, line = item[0], item[1].strip()
        if line.startswith(b">"):
            if name is not None:
                yield name, _letters(name, parts)
                name = None
            if end is not None and at >= end:
                return
            words = line[1:].split(None, 1)
            name, parts = (words[0].decode() if words else ""), []
        elif line:
            if name is None:
                raise ValueError("letters before the first name")
            parts.append(line)
    if name is not None:
        yield name, _letters(name, parts)


def _letters(name: str, parts: list[bytes]) -> str:
    if not parts:
        raise ValueError(f"sequence {name!r} has no letters")
    return b"".join(parts).decode("ascii")


class FastaReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[FilePartition]:
        return [FilePartition(*x) for x in splits(self.path, self.split)]

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        lines = lines_from(partition.path, partition.begin)
        while partition.begin and (item := lines.next()) is not None:
            if item[1].startswith(b">"):
                lines.back(item)
                break
        end = partition.end if packing_of(partition.path) == "none" else None
        for name, seq in sequences(lines, end):
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([seq]), pa.array([len(seq)], pa.int64())], schema=_ARROW)
        lines.f.close()


class FastaSource(DataSource):
    """``spark.read.format("reads_fasta").load(path)``: seqname, seq, length; plain files in ranges of ``splitBytes``."""

    @classmethod
    def name(cls) -> str:
        return "reads_fasta"

    def schema(self) -> str:
        return "seqname string, seq string, length long"

    def reader(self, schema) -> FastaReader:
        return FastaReader(self.options["path"], int(self.options.get("splitBytes", SPLIT)))


def repeated_names(names: DataFrame) -> DataFrame:
    """(seqname, count): names that occur more than once."""
    return names.groupBy("seqname").count().where("count > 1")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """A dictionary whose names are unique; a repeated name is an error."""
    names = spark.read.format("reads_fasta").load(path)
    wrong = repeated_names(names).limit(1).collect()
    if wrong:
        raise ValueError(f"sequence name {wrong[0]['seqname']!r} is repeated")
    return names


def write_text(names: DataFrame, path: str, width: int = 60, mode: str = "error") -> None:
    """FASTA with lines of ``width`` letters, through Spark's text sink."""
    body = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    names.select(F.concat(F.lit(">"), "seqname", F.lit("\n"), body).alias("value")).write.mode(mode).text(path)
