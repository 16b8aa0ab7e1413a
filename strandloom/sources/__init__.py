"""Readers and writers of FASTQ, FASTA, SAM and BAM files."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Schema of reads from every format.
READ_SCHEMA = (
    "_file string, _ord long, id string, seq string, qual string, flags int, seqname string, strand boolean, pos long, "
    "map_qual short, cigar array<struct<op:string,len:int>>, mate_seqname string, mate_pos long, tlen int, "
    "aux map<string,struct<type:string,s:string,i:bigint,f:double,ai:array<bigint>,af:array<double>>>"
)
REF_SCHEMA = "seqname string, seq string, length long"
HEADER_SCHEMA = "_file string, line_no int, record string, tags map<string,string>"
#: Flags and mapping quality of a read that was never aligned.
UNMAPPED, NO_QUALITY = 4, 255


def register(spark: SparkSession) -> None:
    """Make the formats "reads_fastq", "reads_fasta" and "reads_bam" known to a session."""
    from strandloom.sources import bam, fasta, fastq

    for source in (fastq.FastqSource, fasta.FastaSource, bam.BamSource):
        spark.dataSource.register(source)
