"""Reads that arrive as files, and identifiers coded against the read before."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from strandloom.functions import ident
from strandloom.sources.sam import parse_alignments


def stream_sam(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """A stream of the alignments of SAM files that appear in a folder; ``_ord`` is the line.

    A stream can't number rows, so a file is read as one value, which limits it to 2 GB.
    """
    whole = spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_trigger).option("wholetext", True).text(folder)
    file = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/").alias("_file")
    numbered = whole.select(file, F.posexplode(F.split("value", "\r?\n")).alias("_ord", "value")).withColumn("_ord", F.col("_ord").cast("long"))
    return parse_alignments(numbered.where("value not like '@__\\t%' and value != ''"))


def stream_table(spark: SparkSession, folder: str, schema: str | StructType, files_per_trigger: int = 16) -> DataFrame:
    """A stream of Parquet files of reads."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


#: Rows of a part file at most, so that a micro-batch of 16 of them is bounded whatever the table's size.
PART_ROWS = 20_000


def write_in_order(reads: DataFrame, folder: str, order: list[str], rows: int = PART_ROWS) -> None:
    """Parquet part files of ``rows`` rows at most, sorted by ``order``, that a stream takes up in this order.

    A file stream takes files by their modification time, and parallel tasks end
    in any order: the times are set anew by name.  A file system that does not
    keep them is an error.
    """
    reads.repartitionByRange(*order).sortWithinPartitions(*order).write.option("maxRecordsPerFile", rows).parquet(folder)
    jvm = reads.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(reads.sparkSession._jsc.hadoopConfiguration())
    parts = [x for x in fs.listStatus(path) if x.getPath().getName().startswith("part-")]
    # part-<task>-<job>-c<number in the task>: beyond 999 files a task, names do not sort by number.
    parts.sort(key=lambda x: tuple(int(n) for n in re.fullmatch(r"part-(\d+)-.*?c(\d+)\..*", x.getPath().getName()).groups()))
    start = max((x.getModificationTime() for x in parts), default=0) - 10 * len(parts)
    for i, x in enumerate(parts):
        fs.setTimes(x.getPath(), start + 10 * i, -1)
        if fs.getFileStatus(x.getPath()).getModificationTime() != start + 10 * i:
            raise OSError(f"{folder}: modification times cannot be set")


def windowed_counts(stream: DataFrame, at: str = "loaded_at", late: str = "1 hour", size: str = "1 hour") -> DataFrame:
    """Reads and bases per file and arrival window; later arrivals than ``late`` are dropped by the watermark."""
    return (
        stream.withWatermark(at, late)
        .groupBy(F.window(at, size).alias("window"), "_file")
        .agg(F.count("*").alias("reads"), F.sum(F.length("seq")).alias("bases"))
    )


_OUT = "_file string, read_no long, matches int, tokens int"
_STATE = "tokens array<string>"


def _delta(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Tokens equal to those of the file's read before, across micro-batches."""
    before = list(state.get[0]) if state.exists else []
    rows = pd.concat(list(frames)).sort_values(["_ord", "read_no"])
    out = []
    for row in rows.itertuples():
        tokens = list(row.tokens)
        out.append((key[0], row.read_no, sum(a == b for a, b in zip(tokens, before, strict=False)), len(tokens)))
        before = tokens
    state.update((before,))
    yield pd.DataFrame(out, columns=["_file", "read_no", "matches", "tokens"])


def identifier_matches(stream: DataFrame) -> DataFrame:
    """(_file, read_no, matches, tokens): how much of each identifier repeats the one before.

    Without ``read_no``, as from ``stream_sam``, it is ``_ord``.  State is one identifier a file.  Within a micro-batch rows are ordered, all
    of a file in one task; a file's micro-batches must arrive in order, as those
    of ``write_in_order`` do.
    """
    number = F.col("read_no") if "read_no" in stream.columns else F.col("_ord")
    rows = stream.select("_file", "_ord", number.alias("read_no"), ident.tokens("id").alias("tokens"))
    return rows.groupBy("_file").applyInPandasWithState(_delta, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run to the end of what is there now and stop; exactly once through the file sink's log."""
    return stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
