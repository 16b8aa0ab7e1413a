"""FASTQ: a Python data source that streams Arrow batches, and a writer."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from strandloom.sources.files import SPLIT, Folder, Lines, lines_from, packing_of, splits

BATCH = 5000
FASTQ_SCHEMA = "_file string, _ord long, id string, seq string, qual string"
_ARROW = pa.schema([("_file", pa.string()), ("_ord", pa.int64()), ("id", pa.string()), ("seq", pa.string()), ("qual", pa.string())])


@dataclass
class FilePartition(InputPartition):
    path: str
    begin: int
    end: int


def records(lines: Lines) -> Iterator[tuple[int, str, str, str | None]]:
    """(offset, id, seq, qual) of FASTQ lines.

    A header begins with @ or >; blank lines before it are skipped, carriage
    returns dropped, and what follows + is ignored.  The sequence is one line,
    possibly empty.  Without a + line the record has no quality.  The last line
    needs no end.
    """
    while True:
        head = lines.next()
        while head is not None and not head[1]:
            head = lines.next()
        if head is None:
            return
        at, line = head
        if line[:1] not in (b"@", b">"):
            raise ValueError(f"a read must begin with @ or >, not {line[:20]!r}")
        name = line[1:].decode("utf-8", "surrogateescape")
        seq = (lines.next() or (0, b""))[1]
        plus = lines.next()
        while plus is not None and not plus[1]:
            plus = lines.next()
        if plus is None or not plus[1].startswith(b"+"):
            if plus is not None:
                lines.back(plus)
            yield at, name, seq.decode("ascii"), None
            continue
        qual = (lines.next() or (0, b""))[1]
        if len(qual) != len(seq):
            raise ValueError(f"read {name!r} has {len(seq)} letters and {len(qual)} qualities")
        yield at, name, seq.decode("ascii"), qual.decode("ascii")


def to_first_record(lines: Lines) -> None:
    """Skip lines of a read that begins before the range.

    A quality may begin like a header.  But two lines behind a header with @
    comes a +, and two behind such a quality a sequence; behind a header with >
    comes a sequence, and behind such a quality a header.
    """
    while True:
        ahead = [x for x in (lines.next() for _ in range(4)) if x is not None]
        if not ahead:
            return
        text = [x[1] for x in ahead] + [b""] * (4 - len(ahead))
        full = text[0].startswith(b"@") and text[2].startswith(b"+") and len(text[1]) == len(text[3])
        short = text[0].startswith(b">") and len(ahead) > 1 and re.fullmatch(rb"[A-Za-z.*-]*", text[1]) and (text[2][:1] in (b"@", b">", b"+") or len(ahead) < 3)
        for x in reversed(ahead if full or short else ahead[1:]):
            lines.back(x)
        if full or short:
            return


class FastqReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[FilePartition]:
        return [FilePartition(*x) for x in splits(self.path, self.split)]

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            ords, ids, seqs, quals = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array([partition.path] * len(rows)), pa.array(ords, pa.int64()), pa.array(ids, pa.string()), pa.array(seqs, pa.string()), pa.array(quals, pa.string())],
                schema=_ARROW,
            )

        plain = packing_of(partition.path) == "none"
        lines = lines_from(partition.path, partition.begin)
        if partition.begin:
            to_first_record(lines)
        for record in records(lines):
            if plain and record[0] >= partition.end:
                break  # the next range's
            rows.append(record)
            if len(rows) == BATCH:
                yield batch()
                rows = []
        lines.f.close()
        if rows:
            yield batch()


@dataclass
class Written(WriterCommitMessage):
    hidden: str
    final: str


class FastqWriter(DataSourceWriter):
    """One file a partition, moved into place on commit, removed on abort."""

    def __init__(self, path: str, overwrite: bool):
        self.folder = Folder(path)
        self.old = self.folder.names()
        if self.old and not overwrite:
            raise FileExistsError(f"{path} exists")

    def write(self, rows: Iterator) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        part = task.partitionId() if task else 0
        final = f"part-{part:05d}-{uuid.uuid4().hex[:8]}.fastq"
        with self.folder.create(f".{final}") as f:
            for row in rows:
                f.write(format_record(row["id"], row["seq"], row["qual"]).encode("utf-8", "surrogateescape"))
        return Written(f".{final}", final)

    def commit(self, messages: list[Written | None]) -> None:
        for name in self.old:
            self.folder.remove(name)
        for m in messages:
            if m:
                self.folder.show(m.hidden, m.final)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m:
                self.folder.remove(m.hidden)


def format_record(name: str, seq: str | None, qual: str | None) -> str:
    """Four lines; without quality two lines with >, which is read back as no quality."""
    if qual is None:
        return f">{name}\n{seq or ''}\n"
    return f"@{name}\n{seq or ''}\n+\n{qual}\n"


class FastqSource(DataSource):
    """``spark.read.format("reads_fastq").load(path)``; gzip and bzip2 by content.

    ``_file`` is the whole path and ``_ord`` the offset of the read in the
    (decompressed) file.  Plain files are read in ranges of ``splitBytes``, a
    compressed one in one task.
    """

    @classmethod
    def name(cls) -> str:
        return "reads_fastq"

    def schema(self) -> str:
        return FASTQ_SCHEMA

    def reader(self, schema) -> FastqReader:
        return FastqReader(self.options["path"], int(self.options.get("splitBytes", SPLIT)))

    def writer(self, schema, overwrite: bool) -> FastqWriter:
        return FastqWriter(self.options["path"], overwrite)


def as_text(df: DataFrame) -> Column:
    """The record as one string without the last line end, for ``df.write.text``."""
    full = F.concat(F.lit("@"), "id", F.lit("\n"), F.coalesce("seq", F.lit("")), F.lit("\n+\n"), "qual")
    short = F.concat(F.lit(">"), "id", F.lit("\n"), F.coalesce("seq", F.lit("")))
    return F.when(F.col("qual").isNull(), short).otherwise(full)


def write_text(df: DataFrame, path: str, order: list[str] | None = None, mode: str = "error", compression: str = "none") -> None:
    """FASTQ through Spark's own text sink: distributed, committed, any Hadoop file system."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    rows.select(as_text(rows).alias("value")).write.mode(mode).option("compression", compression).text(path)
