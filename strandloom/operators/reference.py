"""Reads against a dictionary of reference sequences.

A read's ``seq`` and ``qual`` are as sequenced; the reference side of a reverse
read is its reverse complement.  The dictionary is joined in tiles: only the
letters under an alignment are fetched, so a chromosome is never copied to each
of its reads, and the join is on (name, tile) rather than on a few heavy names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.cigar import offsets, reference_length
from strandloom.functions.nucleotide import _bytes, revcomp
from strandloom.functions.nucleotide import tiles as nucleotide_tiles

DIFF_TYPE = "array<struct<op:string,read_at:int,ref_at:bigint,nt:string>>"


def reference_side(seq: Column | str, strand: Column | str) -> Column:
    """The sequence in reference orientation; its own inverse."""
    seq = F.col(seq) if isinstance(seq, str) else seq
    strand = F.col(strand) if isinstance(strand, str) else strand
    return F.when(strand, revcomp(seq)).otherwise(seq)


def quality_side(qual: Column | str, strand: Column | str) -> Column:
    qual = F.col(qual) if isinstance(qual, str) else qual
    strand = F.col(strand) if isinstance(strand, str) else strand
    return F.when(strand, F.reverse(qual)).otherwise(qual)


def missing_names(reads: DataFrame, names: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by.., seqname, reads): names used by reads that the dictionary, of the same ``by``, lacks."""
    used = reads.where(F.col("seqname").isNotNull()).groupBy(*by, "seqname").agg(F.count("*").alias("reads"))
    return used.join(names.select(*by, "seqname"), [*by, "seqname"], "left_anti")


def with_reference(reads: DataFrame, names: DataFrame, strict: bool = False) -> DataFrame:
    """Reads with ``ref_length`` of their reference; null name or no match gives null.

    ``strict`` raises on a named read without reference.  Lengths, not
    sequences, are joined: one number for each name.
    """
    lengths = names.select("seqname", F.length("seq").cast("long").alias("ref_length"))
    joined = reads.join(lengths, "seqname", "left")
    if strict:
        wrong = F.col("seqname").isNotNull() & F.col("ref_length").isNull()
        joined = joined.withColumn("ref_length", F.when(wrong, F.raise_error(F.concat(F.lit("no reference named "), "seqname"))).otherwise(F.col("ref_length")))
    return joined


def dictionary_check(a: DataFrame, b: DataFrame) -> DataFrame:
    """(seqname, problem): names missing on either side, repeated, or of another length or content."""
    state = lambda d, s: d.groupBy("seqname").agg(F.count("*").alias(f"n_{s}"), F.max(F.length("seq")).alias(f"l_{s}"), F.max(F.md5(F.upper("seq"))).alias(f"d_{s}"))
    both = state(a, "a").join(state(b, "b"), "seqname", "full")
    problem = (
        F.when(F.col("n_a").isNull(), "only right")
        .when(F.col("n_b").isNull(), "only left")
        .when((F.col("n_a") > 1) | (F.col("n_b") > 1), "repeated")
        .when(F.col("l_a") != F.col("l_b"), "length")
        .when(F.col("d_a") != F.col("d_b"), "content")
    )
    return both.select("seqname", problem.alias("problem")).where("problem is not null")


def header_check(lines: DataFrame, names: DataFrame) -> DataFrame:
    """(_file, seqname, problem): SQ lines that repeat, disagree with, or are not in the dictionary."""
    declared = lines.where(F.col("record") == "SQ").select("_file", F.col("tags")["SN"].alias("seqname"), F.col("tags")["LN"].try_cast("long").alias("ln"))
    per = declared.groupBy("_file", "seqname").agg(F.count("*").alias("n"), F.min("ln").alias("low"), F.max("ln").alias("high"))
    known = names.select("seqname", F.length("seq").cast("long").alias("true_length"))
    problem = (
        F.when(F.col("true_length").isNull(), "unknown")
        .when((F.col("low") != F.col("true_length")) | (F.col("high") != F.col("true_length")), "length")
        .when(F.col("n") > 1, "repeated")
    )
    return per.join(known, "seqname", "left").select("_file", "seqname", problem.alias("problem")).where("problem is not null")


def tiles(names: DataFrame, tile: int) -> DataFrame:
    """(seqname, tile, text): the upper-case dictionary in pieces of ``tile`` letters."""
    cut = nucleotide_tiles(names, ["seqname"], F.upper("seq"), 0, tile)
    return cut.select("seqname", F.floor(F.col("tile_at") / tile).alias("tile"), F.col("tile_text").alias("text"))


def alignable(reads: DataFrame, row_id: str) -> DataFrame:
    """(row_id, seqname, pos, strand, cigar, text): mapped reads with a consistent CIGAR, reference side."""
    mapped = (F.col("flags").bitwiseAND(4) == 0) & F.col("seqname").isNotNull() & F.col("pos").isNotNull() & (F.size("cigar") > 0) & F.col("seq").isNotNull()
    consumed = F.aggregate(F.filter("cigar", lambda c: c["op"].isin(*"MIS=X")), F.lit(0), lambda acc, c: acc + c["len"])
    rows = reads.where(mapped & (consumed == F.length("seq")) & ~F.exists("cigar", lambda c: c["op"] == "P"))
    return rows.select(row_id, "seqname", "pos", "strand", "cigar", F.upper(reference_side("seq", "strand")).alias("text"))


def letters_under(rows: DataFrame, names: DataFrame, row_key: list[str], name: str, begin: str, length: Column, tile: int = 4096) -> DataFrame:
    """``rows`` with ``under``: ``length`` upper-case letters of the reference from ``begin``.

    ``row_key`` identifies a row.  Beyond the end of the reference there are no
    letters.  A row within one tile goes to it once, with all its columns; one
    that spans several fetches each of them and nothing else.
    """
    placed = rows.withColumns({"_first": F.floor(F.col(begin) / tile), "_last": F.floor((F.col(begin) + F.greatest(length, F.lit(1)) - 1) / tile)})
    at = (F.col(begin) - F.col("_first") * tile + 1).cast("int")
    text = tiles(names, tile).select(F.col("seqname").alias("_name"), F.col("tile").alias("_tile"), F.col("text").alias("_t"))
    inside = placed.where("_first = _last or _first is null or _last is null").join(text, (F.col(name) == F.col("_name")) & (F.col("_first") == F.col("_tile")), "left")
    across = placed.where("_first < _last")
    asked = across.select(*row_key, F.col(name).alias("_asked"), F.explode(F.sequence("_first", "_last")).alias("_of"))
    parts = asked.join(text, (F.col("_asked") == F.col("_name")) & (F.col("_of") == F.col("_tile"))).groupBy(*row_key).agg(F.array_sort(F.collect_list(F.struct("_tile", "_t"))).alias("_parts"))
    whole = F.array_join(F.transform("_parts", lambda t: t["_t"]), "")
    both = inside.drop("_name", "_tile").unionByName(across.join(parts, row_key, "left").withColumn("_t", whole).drop("_parts"))
    return both.withColumn("under", F.coalesce(F.substring("_t", at, length.cast("int")), F.lit(""))).drop("_t", "_first", "_last")


def fetch(reads: DataFrame, names: DataFrame, row_id: str, tile: int = 4096) -> DataFrame:
    """``reads`` with ``under``: the reference letters from ``pos`` to the alignment's end."""
    return letters_under(reads, names, [row_id], "seqname", "pos", reference_length("cigar"), tile)


_DIFF = pa.struct([("op", pa.string()), ("read_at", pa.int32()), ("ref_at", pa.int64()), ("nt", pa.string())])
_LETTERS = np.array([chr(c) for c in range(256)], object)


def _inside(size: np.ndarray) -> np.ndarray:
    """0, 1, .. for each of the given sizes."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


def _diffs(cigar: pa.Array, pos: pa.Array, text: pa.Array, under: pa.Array) -> pa.Array:
    """The differences of a batch of alignments, as diff_encode() describes them."""
    offsets_ = cigar.offsets.to_numpy().astype(np.int64)
    ops = cigar.flatten()
    op = ops.field("op").to_numpy(zero_copy_only=False).astype(str)
    size = ops.field("len").to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(cigar)), np.diff(offsets_))

    def before(consumed: np.ndarray) -> np.ndarray:
        upto = np.cumsum(consumed) - consumed
        return upto - np.append(upto, 0)[np.minimum(offsets_[:-1] - offsets_[0], len(upto))][row]

    read_at, ref_at = before(np.where(np.isin(op, list("MIS=X")), size, 0)), before(np.where(np.isin(op, list("MDN=X")), size, 0))
    matched, inserted = np.isin(op, list("M=X")), np.isin(op, list("IS"))
    n = np.where(matched | inserted, np.maximum(size, 0), 0)
    which, k = np.repeat(np.arange(len(op)), n), _inside(n)
    (letters, at), (below, base) = _bytes(text), _bytes(under)
    mine = letters[at[row[which]] + read_at[which] + k]
    place = ref_at[which] + k
    length = np.diff(base)[row[which]]
    theirs = np.append(below, np.uint8(0))[np.where(place < length, base[row[which]] + place, len(below))]
    keep = inserted[which] | (place >= length) | (mine != theirs)
    which, k, mine = which[keep], k[keep], mine[keep]
    counts = np.bincount(row[which], minlength=len(cigar))
    values = pa.StructArray.from_arrays(
        [
            pa.array(op[which], pa.string()), pa.array((read_at[which] + k).astype(np.int32)),
            pa.array(pos.to_numpy(zero_copy_only=False).astype(np.int64)[row[which]] + ref_at[which] + np.where(matched[which], k, 0)), pa.array(_LETTERS[mine], pa.string()),
        ],
        fields=list(_DIFF),
    )
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), values)


def diff_encode(fetched: DataFrame, row_id: str) -> DataFrame:
    """(row_id, seqname, pos, strand, cigar, diff): only what the reference does not say.

    M, = and X leave a mismatch for each differing letter, I and S all their
    letters, D, N and H nothing.  Letters are compared as bytes, a whole Arrow
    batch at once, and only differences leave it.
    """
    diff = F.arrow_udf(_diffs, DIFF_TYPE)("cigar", "pos", "text", "under")
    return fetched.select(row_id, "seqname", "pos", "strand", "cigar", diff.alias("diff"))


def diff_decode(encoded: DataFrame, row_id: str) -> DataFrame:
    """(row_id, seq): the reads, from alignments with ``under`` and ``diff``; upper case, as sequenced.

    Letters are rebuilt operation by operation: matched stretches are copied
    from the reference and overlaid with their mismatches.
    """

    def one(o: Column) -> Column:
        mine = F.filter("diff", lambda d: (d["read_at"] >= o["read_at"]) & (d["read_at"] < o["read_at"] + o["len"]))
        copied = F.substring("under", o["ref_at"] + 1, o["len"])
        patched = F.aggregate(mine, copied, lambda text, d: F.overlay(text, d["nt"], d["read_at"] - o["read_at"] + 1, F.lit(1)))
        spelled = F.array_join(F.transform(mine, lambda d: d["nt"]), "")
        return F.when(o["op"].isin(*"M=X"), patched).when(o["op"].isin(*"IS"), spelled).otherwise("")

    text = F.array_join(F.transform(offsets("cigar"), one), "")
    return encoded.select(row_id, reference_side(text, "strand").alias("seq"))


def pileup(fetched: DataFrame) -> DataFrame:
    """(seqname, at, symbol, n): letters of the reads over each reference position."""
    aligned = F.filter(offsets("cigar"), lambda o: o["op"].isin(*"M=X") & (o["len"] > 0))
    letters = F.flatten(
        F.transform(
            aligned,
            lambda o: F.transform(
                F.sequence(F.lit(0), o["len"] - 1),
                lambda k: F.struct((F.col("pos") + o["ref_at"] + k).cast("long").alias("at"), F.substring("text", o["read_at"] + k + 1, F.lit(1)).alias("symbol")),
            ),
        )
    )
    return fetched.select("seqname", F.inline(letters)).groupBy("seqname", "at", "symbol").agg(F.count("*").alias("n"))


def dictionary_checksum(names: DataFrame) -> DataFrame:
    """One row (sequences, letters, crc): CRC-64 over name and upper-case letters in name order.

    Sequences are hashed where they lie; one (checksum, length) pair of each is
    combined in order.
    """
    from strandloom.functions.hashing import crc64_combine, hex64, row_crcs

    both = names.select("seqname", F.concat("seqname", F.upper("seq")).alias("text"))
    parts = row_crcs(both, ["seqname"], ["text"]).orderBy("seqname").collect()
    crc = 0
    for r in parts:
        crc = crc64_combine(crc, r["crc_text"] & (1 << 64) - 1, r["len_text"])
    signed = crc - (1 << 64) if crc >> 63 else crc
    return names.agg(F.count("*").alias("sequences"), F.sum(F.length("seq")).alias("letters")).withColumn("crc", hex64(F.lit(signed)))
