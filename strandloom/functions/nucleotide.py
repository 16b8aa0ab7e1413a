"""Column expressions on nucleotide strings.  All of them stay in the JVM."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def complement(seq: Column | str) -> Column:
    """A<->T and C<->G keeping the case; every other letter is left alone."""
    return F.translate(_col(seq), "ACGTacgt", "TGCAtgca")


def revcomp(seq: Column | str) -> Column:
    """Reverse complement; an empty string stays empty."""
    return F.reverse(complement(seq))


def canonical(seq: Column | str) -> Column:
    """The smaller of a sequence and its reverse complement, by code point."""
    seq = _col(seq)
    return F.least(seq, revcomp(seq))


def canonical_read(seq: Column | str) -> Column:
    """Strand-free identity of a read: upper case, then the smaller strand.

    Null, empty and all-N sequences have none and give null.
    """
    upper = F.upper(_col(seq))
    return F.when(F.length(F.translate(upper, "N", "")) > 0, canonical(upper))


def is_nucleotides(seq: Column | str) -> Column:
    """True for a non-empty string over ACGTN."""
    return _col(seq).rlike("^[ACGTN]+$")


def n_count(seq: Column | str) -> Column:
    """Number of N or n."""
    seq = _col(seq)
    return F.length(seq) - F.length(F.translate(seq, "Nn", ""))


def n_mask(seq: Column | str) -> Column:
    """One boolean per letter, true for N."""
    return F.transform(letters(seq), lambda c: F.upper(c) == "N")


def gc_count(seq: Column | str) -> Column:
    seq = _col(seq)
    return F.length(seq) - F.length(F.translate(seq, "GCgc", ""))


def letters(text: Column | str) -> Column:
    """The characters of a string as an array; empty for an empty string, null for null."""
    text = _col(text)
    return F.when(F.length(text) > 0, F.split(text, "(?!^)(?!$)")).when(text.isNotNull(), F.array().cast("array<string>"))


def kmers(seq: Column | str, k: int) -> Column:
    """All windows of ``k`` letters in order; empty if the sequence is shorter."""
    seq = _col(seq)
    n = F.length(seq) - F.lit(k - 1)
    return F.when(
        n >= 1, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(seq, i, F.lit(k)))
    ).otherwise(F.array().cast("array<string>"))


TILE = 256


def tiles(df: DataFrame, keep: list[str], text: Column, overlap: int, tile: int = TILE) -> DataFrame:
    """(keep.., tile_at, tile_text): a text in tiles that share ``overlap`` letters with the next.

    A substring of a long string is found by walking to it, so windows are taken
    from tiles and not from the whole text; tiles are cut in one pass.
    """
    parts = df.select(*keep, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{tile}}}"), F.lit(0)).alias("_parts"))
    joined = F.transform(
        "_parts",
        lambda p, i: F.struct(
            (i * tile).alias("tile_at"), F.concat(p, F.substring(F.coalesce(F.get("_parts", i + 1), F.lit("")), F.lit(1), F.lit(overlap))).alias("tile_text")
        ),
    )
    return parts.select(*keep, F.inline(joined))


def kmer_code(kmer: Column | str) -> Column:
    """A=0 C=1 G=2 T=3, first letter most significant, up to 31 letters.

    A k-mer with any other letter has no code and gives null.
    """
    kmer = F.upper(_col(kmer))
    digits = F.translate(kmer, "ACGT", "0123")
    return F.when(kmer.rlike("^[ACGT]{1,31}$"), F.conv(digits, 4, 10).cast("long"))


def kmer_text(code: Column | str, k: int) -> Column:
    """The inverse of kmer_code."""
    return F.translate(F.lpad(F.conv(_col(code).cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def low_complexity(kmer: Column | str, max_period: int = 3) -> Column:
    """True if the k-mer equals itself shifted by 1..max_period letters."""
    kmer = _col(kmer)
    hit = F.lit(False)
    for shift in range(1, max_period + 1):
        hit = hit | ((F.substring(kmer, F.lit(1), F.length(kmer) - shift) == F.substring(kmer, F.lit(shift + 1), F.length(kmer))))
    return hit


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without nulls."""
    column = column.cast(pa.string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def mismatches(a: pa.Array, b: pa.Array) -> pa.Array:
    """Places in which two columns of strings differ, row by row; null if lengths differ or either is null."""
    import pyarrow.compute as pc

    same = pc.fill_null(pc.equal(pc.utf8_length(a), pc.utf8_length(b)), False)
    x, y = a.filter(same), b.filter(same)
    (left, at), (right, other) = _bytes(x), _bytes(y)
    if len(left) == len(right) and (at == other).all() and not (left > 127).any() and not (right > 127).any():
        upto = np.append(0, np.cumsum(left != right))
        counts = upto[at[1:]] - upto[at[:-1]]
    else:  # letters of several bytes
        counts = np.array([sum(c != d for c, d in zip(p, q, strict=True)) for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], np.int64)
    out = np.zeros(len(a), np.int32)
    known = same.to_numpy(zero_copy_only=False)
    out[known] = counts
    return pa.array(out, pa.int32(), mask=~known)


def hamming(a: Column | str, b: Column | str) -> Column:
    """Mismatches between two strings of one length; null if lengths differ.  Whole Arrow batches are compared at once."""
    count = F.arrow_udf(mismatches, "int")
    return count(_col(a), _col(b))


#: The 16 letters of the 4-bit nucleotide code of the BAM format, in code order.
NIBBLE_LETTERS = "=ACMGRSVTWYHKDBN"
