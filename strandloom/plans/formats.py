"""Registered round trips through every format and the archive, with SQL of what must come back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import ident
from strandloom.operators import archive, assembly
from strandloom.sources import bam, convert, fasta, fastq, files, register, sam
from strandloom.session import checkpoint_dir
from strandloom.streaming import ingest


def place(spark: SparkSession, name: str) -> str:
    """A fresh folder in the cluster's shared one, on its own file system."""
    return f"{checkpoint_dir(spark).rstrip('/')}/formats/{name}-{uuid.uuid4().hex[:12]}"


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/raw_reads.parquet")


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/aligned_reads.parquet")


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/named_seqs.parquet")


def fastq_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every read written as FASTQ and read back; empty and absent sequences are both empty."""
    path = place(spark, "fastq")
    fastq.write_text(_raw(spark, sf_dir), path, ["read_no"])
    register(spark)
    return spark.read.format("reads_fastq").load(path).select("id", "seq", "qual")


def gzip_fastq_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark, "fastq-gz")
    fastq.write_text(_raw(spark, sf_dir), path, ["read_no"], compression="gzip")
    register(spark)
    return spark.read.format("reads_fastq").load(path).groupBy("id").agg(F.count("*").alias("reads"), F.sum(F.length("seq")).alias("bases"))


def bzip2_fastq_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark, "fastq-bz2")
    fastq.write_text(_raw(spark, sf_dir), path, ["read_no"], compression="bzip2")
    register(spark)
    return spark.read.format("reads_fastq").load(path).groupBy("id").agg(F.count("*").alias("reads"), F.sum(F.length("seq")).alias("bases"))


_BACK = ["id", "seq", "qual", "flags", "seqname", "strand", "pos", "map_qual", "mate_seqname", "mate_pos", "tlen"]


def _shown(reads: DataFrame, *more: str) -> DataFrame:
    """Every column of reads in a form that SQL can compare: CIGAR as text, tags as sorted "key:type:value"."""
    number = lambda v: v.cast("float").cast("decimal(20,3)").cast("string")
    value = lambda v: F.coalesce(
        v["s"], v["i"].cast("string"), number(v["f"]), F.array_join(F.transform(v["ai"], lambda x: x.cast("string")), ","), F.array_join(F.transform(v["af"], number), ",")
    )
    tags = F.transform(F.map_entries("aux"), lambda e: F.concat_ws(":", e["key"], F.substring(e["value"]["type"], 1, 1), value(e["value"])))
    cigar = F.array_join(F.transform("cigar", lambda c: F.concat(c["len"].cast("string"), c["op"])), "")
    return reads.select(*more, *_BACK, F.nullif(cigar, F.lit("")).alias("cigar"), F.coalesce(F.array_join(F.array_sort(tags), " "), F.lit("")).alias("tags"))


def sam_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads as they are, whatever their letters' case, through SAM text."""
    path = place(spark, "sam")
    sam.write(_aligned(spark, sf_dir), path, sam.default_header(spark, _names(spark, sf_dir)), ["_file", "_ord", "read_no"])
    return _shown(sam.read(spark, path))


def bam_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads as they are through BAM, which knows no lower case."""
    path = place(spark, "bam")
    reads = _aligned(spark, sf_dir)
    bam.write(reads, path, _names(spark, sf_dir), order=["_file", "_ord", "read_no"])
    register(spark)
    return _shown(spark.read.format("reads_bam").load(path))


def bam_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text tags as they come back from BAM."""
    path = place(spark, "bam-tags")
    bam.write(_aligned(spark, sf_dir), path, _names(spark, sf_dir), order=["_file", "_ord", "read_no"])
    register(spark)
    rows = spark.read.format("reads_bam").load(path).select("id", "flags", F.explode("aux").alias("tag", "v"))
    return rows.where("v.i is not null or v.s is not null").select("id", "flags", "tag", "v.type", "v.s", "v.i")


def sam_to_fastq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SAM converted to FASTQ: alignment columns go, sequences return to their own strand."""
    one, two = place(spark, "sam"), place(spark, "fastq")
    sam.write(_aligned(spark, sf_dir), one, None, ["_file", "_ord", "read_no"])
    convert.convert(spark, one, two, "fastq")
    register(spark)
    return spark.read.format("reads_fastq").load(two).select("id", "seq", "qual")


def fasta_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark, "fasta")
    fasta.write_text(_names(spark, sf_dir), path)
    register(spark)
    return fasta.read_dictionary(spark, path).select("seqname", "seq", "length")


def format_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each written format is recognised as."""
    raw, aligned, names = _raw(spark, sf_dir), _aligned(spark, sf_dir), _names(spark, sf_dir)
    places = {k: place(spark, k) for k in ("fastq", "fastq.gz", "sam", "bam", "fasta")}
    fastq.write_text(raw.where("qual is not null and length(seq) > 0"), places["fastq"], ["read_no"])
    fastq.write_text(raw.where("qual is not null and length(seq) > 0"), places["fastq.gz"], ["read_no"], compression="gzip")
    sam.write(aligned, places["sam"], sam.default_header(spark, names), ["_ord"])
    bam.write(aligned, places["bam"], names)
    fasta.write_text(names, places["fasta"])
    found = [(k, *files.sniff(files.expand(p)[0])) for k, p in places.items()]
    return spark.createDataFrame(found, "written string, format string, compression string")


def archive_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark, "archive")
    archive.write(_aligned(spark, sf_dir), path, order=["_ord", "read_no"])
    archive.verify(spark, path)
    return _shown(archive.read(spark, path), "read_no")


def archive_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block column of a fresh archive against its checksum."""
    path = place(spark, "archive")
    archive.write(_aligned(spark, sf_dir), path, order=["_ord", "read_no"], reads=1000)
    return archive.verify(spark, path).select("_file", "block", "column", "ok")


def archive_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads and bases of the blocks an archive would have."""
    table = archive.block_table(_aligned(spark, sf_dir), ["_file"], ["_ord", "read_no"], 1000)
    return table.select("_file", "block", "reads", "bases", "id_raw_bytes", "seq_raw_bytes", "qual_raw_bytes")


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contigs grown from the unaligned reads."""
    return assembly.assemble(_raw(spark, sf_dir), "read_no", F.col("seq"))


def contig_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contigs of the unaligned reads, how many reads lie on each, and the weight of its motif against what it must be."""
    contigs, placed, motifs = assembly.code_with_contigs(_raw(spark, sf_dir), "read_no", "seq")
    per = placed.groupBy("contig").agg(F.count("*").alias("reads"), F.sum("length").alias("letters"), F.sum("mismatches").alias("mismatches"))
    weight = motifs.groupBy("contig").agg(F.sum("weight").alias("weight"))
    joined = contigs.select("contig", "at", F.length("seq").alias("length")).join(per, "contig", "left").join(weight, "contig")
    return joined.fillna(0, ["reads", "letters", "mismatches"]).withColumn("expected", 50 * F.col("length") + 4 * F.col("letters"))


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reads as a file stream with state: identifiers against the ones before."""
    work = place(spark, "stream")
    ingest.write_in_order(_raw(spark, sf_dir), f"{work}/in", ["_file", "_ord", "read_no"])
    stream = ingest.stream_table(spark, f"{work}/in", _raw(spark, sf_dir).schema)
    query = ingest.to_table(ingest.identifier_matches(stream), f"{work}/out", f"{work}/state")
    query.awaitTermination()
    return spark.read.parquet(f"{work}/out")


QUERIES = {
    f.__name__: f
    for f in (
        fastq_roundtrip, gzip_fastq_read, bzip2_fastq_read, sam_roundtrip, bam_roundtrip, bam_tags, sam_to_fastq, fasta_read,
        format_sniff, archive_roundtrip, archive_verify, archive_blocks, contigs, contig_coding, stream_ingest,
    )
}

_PATTERN = ident.PATTERN.replace("\\t", "\t")
_COUNTS = "select id, count(*) as reads, cast(sum(coalesce(length(seq), 0)) as bigint) as bases from raw_reads group by id"
_FLAGS = "cast(case when cigar is null then flags | 4 else flags end as integer) as flags"
_NUMBER = "cast(cast(cast({} as float) as decimal(20,3)) as varchar)"
_VALUE = f"""coalesce(e.value.s, cast(e.value.i as varchar), {_NUMBER.format('e.value.f')}, array_to_string(list_transform(e.value.ai, lambda x: cast(x as varchar)), ','),
  array_to_string(list_transform(e.value.af, lambda x: {_NUMBER.format('x')}), ','))"""
_REST = f"""seqname, strand, pos, map_qual, mate_seqname, mate_pos, tlen, nullif(array_to_string(list_transform(cigar, lambda c: c.len || c.op), ''), '') as cigar,
  coalesce(array_to_string(list_sort(list_transform(map_entries(aux), lambda e: e.key || ':' || substr(e.value.type, 1, 1) || ':' || {_VALUE})), ' '), '') as tags"""

ORACLES = {
    "fastq_roundtrip": "select id, coalesce(seq, '') as seq, qual from raw_reads",
    "gzip_fastq_read": _COUNTS,
    "bzip2_fastq_read": _COUNTS,
    "sam_roundtrip": f"select id, nullif(seq, '') as seq, nullif(qual, '') as qual, {_FLAGS}, {_REST} from aligned_reads",
    "bam_roundtrip": f"select id, nullif(upper(seq), '') as seq, nullif(qual, '') as qual, flags, {_REST} from aligned_reads",
    "bam_tags": """with e as (select id, flags, unnest(map_entries(aux)) as e from aligned_reads)
select id, flags, e.key as tag, e.value.type as type, e.value.s as s, e.value.i as i from e where e.value.i is not null or e.value.s is not null""",
    "sam_to_fastq": "select id, coalesce(seq, '') as seq, qual from aligned_reads",
    "fasta_read": "select seqname, seq, cast(length(seq) as bigint) as length from named_seqs",
    "format_sniff": "select * from (values ('fastq', 'fastq', 'none'), ('fastq.gz', 'fastq', 'gzip'), ('sam', 'sam', 'none'), ('bam', 'bam', 'gzip'), ('fasta', 'fasta', 'none')) as t(written, format, compression)",
    "archive_roundtrip": f"select read_no, id, seq, qual, flags, {_REST} from aligned_reads",
    "archive_verify": """select _file, (no - 1) // 1000 as block, c as "column", true as ok
from (select _file, row_number() over (partition by _file order by _ord, read_no) as no from aligned_reads), (select unnest(['id', 'aux', 'seq', 'qual']) as c) group by 1, 2, 3""",
    "archive_blocks": """select _file, (no - 1) // 1000 as block, count(*) as reads, cast(sum(coalesce(length(seq), 0)) as bigint) as bases, cast(sum(strlen(id)) as bigint) as id_raw_bytes,
  cast(sum(coalesce(strlen(seq), 0)) as bigint) as seq_raw_bytes, cast(sum(coalesce(strlen(qual), 0)) as bigint) as qual_raw_bytes
from (select *, row_number() over (partition by _file order by _ord, read_no) as no from aligned_reads) group by 1, 2""",
    "stream_ingest": f"""with t as (select _file, _ord, read_no, regexp_extract_all(id, '{_PATTERN}', 1) as t from raw_reads),
p as (select *, lag(t) over (partition by _file order by _ord, read_no) as b from t)
select _file, read_no, cast(coalesce(list_sum(list_transform(range(1, least(len(t), len(b)) + 1), lambda i: cast(t[i] = b[i] as integer))), 0) as integer) as matches, cast(len(t) as integer) as tokens from p""",
}
