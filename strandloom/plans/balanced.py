"""Registered queries over intervals and heavy keys, and SQL to check them by."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.cigar import reference_length
from strandloom.operators import eager, intervals


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = _table(spark, sf_dir, "aligned_reads")
    placed = F.col("seqname").isNotNull() & F.col("pos").isNotNull() & F.col("cigar").isNotNull()
    return reads.where((F.col("flags").bitwiseAND(4) == 0) & placed)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.gaps(_aligned(spark, sf_dir), ["_file", "seqname"], *intervals.covered_span("pos", "cigar"))


def p4_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.periods(_aligned(spark, sf_dir), ["_file", "seqname"], *intervals.covered_span("pos", "cigar"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eager.heavy_keys(_table(spark, sf_dir, "aligned_reads"), "_file", "seqname", 0.05).select("_file", "seqname")


def p7_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, aligned bases and reference length of each name, over a join with the references."""
    reads, names = _table(spark, sf_dir, "aligned_reads"), _table(spark, sf_dir, "named_seqs")
    mapped = F.col("flags").bitwiseAND(4) == 0
    left = eager.Side(
        reads,
        {"seqname": F.col("seqname")},
        {"seqname": F.col("seqname")},
        sums={"aligned_bases": F.when(mapped, F.coalesce(reference_length("cigar"), F.lit(0))).otherwise(0).cast("long")},
        extremes={"first_pos": ("min", F.col("pos")), "last_pos": ("max", F.col("pos"))},
    )
    right = eager.Side(names, {"seqname": F.col("seqname")}, extremes={"letters": ("max", F.length("seq"))})
    return eager.join_aggregate(left, right)


def p7_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads for each header line of their reference, where lines may be repeated."""
    reads, lines = _table(spark, sf_dir, "aligned_reads"), _table(spark, sf_dir, "headers")
    left = eager.Side(reads, {"file": F.col("_file"), "name": F.col("seqname")}, {"seqname": F.col("seqname")}, sums={"bases": F.length("seq").cast("long")})
    declared = lines.where(F.col("record") == "SQ")
    right = eager.Side(
        declared, {"file": F.col("_file"), "name": F.col("tags")["SN"]}, sums={"declared_length": F.col("tags")["LN"].cast("long")}
    )
    return eager.join_aggregate(left, right, count="joined")


QUERIES = {f.__name__: f for f in (p4_found, p4_periods, p7_found, p7_names, p7_headers)}

_LENGTH = "list_sum(list_transform(list_filter(cigar, lambda c: c.op in ('M', 'D', 'N', '=', 'X')), lambda c: c.len))"

_PERIODS = f"""
spans as (
  select _file, seqname, pos as b, pos + {_LENGTH} as e, count(*) as n from aligned_reads
  where flags & 4 = 0 and seqname is not null and pos is not null and cigar is not null and {_LENGTH} > 0 group by all
),
marked as (select *, max(e) over (partition by _file, seqname order by b, e rows between unbounded preceding and 1 preceding) as reach from spans),
numbered as (
  select *, sum(case when reach is null or b > reach then 1 else 0 end) over (partition by _file, seqname order by b, e rows unbounded preceding) as no from marked
),
periods as (select _file, seqname, no, min(b) as period_start, max(e) as period_end, sum(n) as intervals from numbered group by _file, seqname, no)"""

ORACLES = {
    "p4_found": f"""with {_PERIODS}, nexts as (
  select _file, seqname, period_end, lead(period_start) over (partition by _file, seqname order by no) as nxt from periods
)
select _file, seqname, cast(period_end as bigint) as gap_start, cast(nxt as bigint) as gap_end from nexts where nxt is not null""",
    "p4_periods": f"with {_PERIODS} select _file, seqname, cast(period_start as bigint) as period_start, cast(period_end as bigint) as period_end, cast(intervals as bigint) as intervals from periods",
    "p7_found": """select _file, seqname from (select _file, seqname, count(*) as n from aligned_reads where seqname is not null group by _file, seqname)
join (select _file, count(seqname) as t from aligned_reads group by _file) using (_file) where n / t >= 0.05""",
    "p7_names": f"""select a.seqname, count(*) as rows, cast(sum(case when flags & 4 = 0 then coalesce({_LENGTH}, 0) else 0 end) as bigint) as aligned_bases,
  min(pos) as first_pos, max(pos) as last_pos, cast(max(length(n.seq)) as integer) as letters
from aligned_reads a join named_seqs n on a.seqname = n.seqname group by a.seqname""",
    "p7_headers": """select a.seqname, count(*) as joined, cast(sum(length(a.seq)) as bigint) as bases, cast(sum(cast(h.tags['LN'] as bigint)) as bigint) as declared_length
from aligned_reads a join headers h on a._file = h._file and h.record = 'SQ' and a.seqname = h.tags['SN'] group by a.seqname""",
}
