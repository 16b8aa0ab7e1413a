"""SAM text through Spark's text reader: every field is a column expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from strandloom.functions.cigar import format_cigar, parse_cigar
from strandloom.functions.flags import parse_flags
from strandloom.functions.nucleotide import revcomp
from strandloom.functions.tags import format_tags, parse_tags


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(_file, _ord, value): lines with their number in the file.

    Files are split: the order of a line is its split's byte offset and its
    number in the split, which sorts as the file does; gaps do no harm.
    """
    lines = spark.read.text(path).select(
        F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/").alias("_file"),
        (F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).alias("_ord"),
        "value",
    )
    return lines.withColumn("value", F.regexp_replace("value", "\r$", ""))


def read_header(spark: SparkSession, path: str) -> DataFrame:
    """(_file, line_no, record, tags) of the @ lines; CO lines keep their text under the key "text"."""
    return parse_header(_lines(spark, path).where("value like '@__\\t%'"))


def parse_header(lines: DataFrame) -> DataFrame:
    fields = F.split("value", "\t")
    pairs = F.transform(F.slice(fields, F.lit(2), F.size(fields)), lambda f: F.struct(F.substring(f, 1, 2).alias("key"), F.substring(f, F.lit(4), F.length(f)).alias("value")))
    firsts = F.filter(pairs, lambda p, i: ~F.exists(F.slice(F.transform(pairs, lambda q: q["key"]), F.lit(1), i), lambda k: k == p["key"]))
    comment = F.map_from_arrays(F.array(F.lit("text")), F.array(F.regexp_replace("value", "^@CO\t", "")))
    record = F.substring("value", 2, 2)
    # A header has a few thousand lines at most, so one window a file is small.
    number = F.row_number().over(Window.partitionBy("_file").orderBy("_ord")) - 1
    return lines.select("_file", number.alias("line_no"), record.alias("record"), F.when(record == "CO", comment).otherwise(F.map_from_entries(firsts)).alias("tags"))


def _null(value: Column, sentinel: str) -> Column:
    return F.when(value != sentinel, value)


def parse_alignments(lines: DataFrame) -> DataFrame:
    """Lines of alignments to reads as sequenced.

    ``*`` becomes null, positions 0-based, RNEXT ``=`` the read's own name.  A
    mapped read without CIGAR is marked unmapped.  A line of less than eleven
    fields, or whose sequence, qualities and CIGAR differ in length, is an error.
    """
    f = F.split("value", "\t")
    raw = lines.select(
        "_file", "_ord",
        F.when(F.size(f) < 11, F.raise_error(F.concat(F.lit("fewer than 11 fields: "), F.substring("value", 1, 80)))).otherwise(f[0]).alias("id"),
        *(F.get(f, i).alias(n) for i, n in enumerate(("_flag", "_rname", "_pos", "_mapq", "_cigar", "_rnext", "_pnext", "_tlen", "_seq", "_qual"), 1)),
        F.slice(f, F.lit(12), F.greatest(F.size(f) - 11, F.lit(0))).alias("_tags"),
    )
    typed = raw.select(
        "*", parse_flags("_flag").alias("_flags"), _null(F.col("_rname"), "*").alias("seqname"), parse_cigar("_cigar").alias("cigar"),
        _null(F.col("_seq"), "*").alias("_text"), _null(F.col("_qual"), "*").alias("_quality"),
    )
    typed = typed.withColumn("flags", F.when(F.col("cigar").isNull(), F.col("_flags").bitwiseOR(4)).otherwise(F.col("_flags")))
    strand = F.col("flags").bitwiseAND(16) != 0
    used = F.aggregate(F.filter("cigar", lambda c: c["op"].isin(*"MIS=X")), F.lit(0), lambda acc, c: acc + c["len"])
    wrong = F.coalesce((used != F.length("_text")) | (F.length("_text") != F.length("_quality")), F.lit(False)) | F.col("_flags").isNull()
    name = F.when(wrong, F.raise_error(F.concat(F.lit("inconsistent alignment of "), "id"))).otherwise(F.col("id"))
    at = lambda c: F.when(c.cast("long") > 0, c.cast("long") - 1)
    return typed.select(
        "_file", "_ord", name.alias("id"),
        F.when(strand, revcomp("_text")).otherwise(F.col("_text")).alias("seq"),
        F.when(strand, F.reverse("_quality")).otherwise(F.col("_quality")).alias("qual"),
        F.col("flags").cast("int").alias("flags"), "seqname", strand.alias("strand"), at(F.col("_pos")).alias("pos"),
        F.col("_mapq").cast("short").alias("map_qual"), "cigar",
        F.when(F.col("_rnext") == "=", F.col("seqname")).otherwise(_null(F.col("_rnext"), "*")).alias("mate_seqname"),
        at(F.col("_pnext")).alias("mate_pos"), F.col("_tlen").cast("int").alias("tlen"), parse_tags("_tags").alias("aux"),
    )


def read(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Reads of SAM files, gzip and bzip2 by ending."""
    return parse_alignments(_lines(spark, path).where("value not like '@__\\t%' and value != ''"))


def as_text(df: DataFrame) -> Column:
    """A read as one SAM line, in reference orientation."""
    text = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("*"))
    strand = F.col("strand")
    mate = F.when(F.col("mate_seqname") == F.col("seqname"), "=").otherwise(F.coalesce("mate_seqname", F.lit("*")))
    number = lambda c: F.coalesce(F.col(c), F.lit(-1)) + 1
    fields = F.concat_ws(
        "\t", "id", F.col("flags").cast("string"), F.coalesce("seqname", F.lit("*")), number("pos").cast("string"),
        F.coalesce("map_qual", F.lit(255)).cast("string"), format_cigar("cigar"), mate, number("mate_pos").cast("string"),
        F.coalesce("tlen", F.lit(0)).cast("string"),
        text(F.when(strand, revcomp("seq")).otherwise(F.col("seq"))), text(F.when(strand, F.reverse("qual")).otherwise(F.col("qual"))),
    )
    aux = format_tags("aux") if "aux" in df.columns else F.lit("")
    return F.when(F.coalesce(aux, F.lit("")) == "", fields).otherwise(F.concat(fields, F.lit("\t"), aux))


def header_text(header: DataFrame) -> Column:
    body = F.array_join(F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), "\t")
    plain = F.concat(F.lit("@"), "record", F.lit("\t"), body)
    return F.when(F.col("record") == "CO", F.concat(F.lit("@CO\t"), F.coalesce(F.col("tags")["text"], F.lit("")))).otherwise(plain)


def default_header(spark: SparkSession, names: DataFrame | None = None) -> DataFrame:
    """An HD line, and an SQ line for each reference in name order."""
    top = spark.createDataFrame([("", 0, "HD", {"VN": "1.0", "SO": "unsorted"})], "_file string, line_no int, record string, tags map<string,string>")
    if names is None:
        return top
    number = F.row_number().over(Window.orderBy("seqname"))
    letters = F.length("seq") if "seq" in names.columns else F.col("length")
    tags = F.create_map(F.lit("LN"), letters.cast("string"), F.lit("SN"), F.col("seqname"))
    return top.unionByName(names.select(F.lit("").alias("_file"), number.cast("int").alias("line_no"), F.lit("SQ").alias("record"), tags.alias("tags")))


def write(df: DataFrame, path: str, header: DataFrame | None = None, order: list[str] | None = None, mode: str = "error") -> None:
    """SAM lines through Spark's text sink; the first file begins with the header."""
    order = order or ["_ord"]
    header = header if header is not None else default_header(df.sparkSession)
    kinds = dict(df.select(*order).dtypes)
    none = [F.lit(None).cast(kinds[c]).alias(f"_o{i}") for i, c in enumerate(order)]
    top = header.select(F.lit(0).alias("_rank"), F.col("line_no").alias("_line"), *none, header_text(header).alias("value"))
    body = df.select(F.lit(1).alias("_rank"), F.lit(0).alias("_line"), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), as_text(df).alias("value"))
    keys = ["_rank", "_line", *(f"_o{i}" for i in range(len(order)))]
    top.unionByName(body).repartitionByRange(*keys).sortWithinPartitions(*keys).select("value").write.mode(mode).text(path)


def merge_headers(header: DataFrame) -> DataFrame:
    """One header of several: distinct lines; lines of a name that disagree are errors."""
    unique = F.coalesce(F.col("tags")["SN"], F.col("tags")["ID"])
    lines = header.where("record != 'HD'").select("record", F.array_sort(F.map_entries("tags")).alias("entries"), unique.alias("name"))
    distinct = lines.distinct()
    clash = distinct.where("name is not null").groupBy("record", "name").count().where("count > 1").limit(1).collect()
    if clash:
        raise ValueError(f"{clash[0]['record']} lines of {clash[0]['name']!r} disagree")
    return distinct.select("record", F.map_from_entries("entries").alias("tags"))


def header_problems(header: DataFrame) -> DataFrame:
    """(_file, line_no, problem): lines without what their record needs."""
    need = {"HD": ["VN"], "SQ": ["SN", "LN"], "RG": ["ID"], "PG": ["ID"]}
    problem = F.lit(None).cast("string")
    for record, keys in need.items():
        for key in keys:
            problem = F.when((F.col("record") == record) & F.col("tags")[key].isNull(), f"{record} without {key}").otherwise(problem)
    problem = F.when(~F.col("record").isin("HD", "SQ", "RG", "PG", "CO"), "unknown record").otherwise(problem)
    return header.select("_file", "line_no", problem.alias("problem")).where("problem is not null")
