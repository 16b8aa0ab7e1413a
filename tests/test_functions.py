"""Column expressions against plain Python."""

import random

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandloom.functions import cigar, flags, hashing, ident, nucleotide, quality, tags

TURN = str.maketrans("ACGTacgt", "TGCAtgca")


def table(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def column(df, expression):
    return [r[0] for r in df.select(expression).collect()]


def test_strands(spark):
    values = ["", "A", "acgtN", "ACGTNR", None, "GATTACA"]
    df = table(spark, values)
    assert column(df, nucleotide.revcomp("x")) == [v if v is None else v[::-1].translate(TURN) for v in values]
    assert column(df, nucleotide.revcomp(nucleotide.revcomp("x"))) == values
    assert column(df, nucleotide.canonical_read("x")) == [None, "A", "ACGTN", "ACGTNR", None, "GATTACA"]
    assert column(table(spark, ["NNN", "nN", "TTT"]), nucleotide.canonical_read("x")) == [None, None, "AAA"]
    assert column(df, nucleotide.n_count("x")) == [0, 0, 1, 1, None, 0]
    assert column(df, nucleotide.is_nucleotides("x")) == [False, True, False, False, None, True]


def test_kmers(spark):
    values = ["", "ACG", "ACGTA", None]
    df = table(spark, values)
    assert column(df, nucleotide.kmers("x", 4)) == [[], [], ["ACGT", "CGTA"], []]
    codes = table(spark, ["A", "ACGT", "TTTT", "ACNT", "T" * 31])
    assert column(codes, nucleotide.kmer_code("x")) == [0, 27, 255, None, 4**31 - 1]
    assert column(table(spark, [27], "long"), nucleotide.kmer_text("x", 4)) == ["ACGT"]
    simple = table(spark, ["AAAA", "ACACAC", "ACGACG", "ACGTAC"])
    assert column(simple, nucleotide.low_complexity("x")) == [True, True, True, False]


def test_tiles_hold_every_window(spark):
    random.seed(1)
    text = "".join(random.choices("ACGT", k=2000))
    out = nucleotide.tiles(table(spark, [text, "", None, "ACG"]), ["x"], F.col("x"), 10).collect()
    windows = {r["x"]: set() for r in out}
    for r in out:
        t = r["tile_text"]
        windows[r["x"]] |= {(r["tile_at"] + i, t[i : i + 11]) for i in range(len(t) - 10)}
    assert windows[text] == {(i, text[i : i + 11]) for i in range(len(text) - 10)}
    assert windows["ACG"] == set()


def test_hamming(spark):
    df = spark.createDataFrame([("ACGT", "ACCA"), ("", ""), ("A", "AA"), (None, "A")], "a string, b string")
    assert column(df, nucleotide.hamming("a", "b")) == [2, 0, None, None]


def test_identifier_tokens_rebuild_the_identifier(spark):
    values = ["", "SRR1.007 x/1", "a:b::0c", "1.22.333", "007", ":::", "x" * 60, "18446744073709551616"]
    df = table(spark, values)
    assert ["".join(t) for t in column(df, ident.tokens("x"))] == values
    assert column(df, ident.tokens("x"))[1] == ["SRR1", ".007", " x", "/", "1"]
    assert column(table(spark, ["7", "07", "18446744073709551615", "18446744073709551616"]), ident.is_number("x")) == [True, False, True, False]


def test_identifier_delta(spark):
    df = spark.createDataFrame([("5", "5"), ("20", "5"), ("21", "5"), ("4", "5"), ("ab", "ab"), ("ab", "ac"), ("ab", None), ("5", None), ("5", "x")], "t string, p string")
    assert column(df, ident.delta_kind("t", "p")) == ["NUM_OFF", "NUM_OFF", "NUM", "NUM", "MATCH", "STR", "STR", "NUM", "NUM"]
    assert column(df, ident.common_prefix("t", "p")) == [1, 0, 0, 0, 2, 1, 0, 0, 0]


def test_quality(spark):
    df = table(spark, ["!I`", "", None])
    assert column(df, quality.phred("x")) == [[0, 40, 63], [], None]
    scores = table(spark, list(range(0, 45)), "int")
    assert column(scores, quality.bin42(F.col("x")))[34:42] == [35, 36, 38, 39, 40, 41, 41, 41]
    assert column(table(spark, [0, 1, 2, 9, 10, 24, 25, 29, 30, 39, 40, 41], "int"), quality.bin16(F.col("x"))) == [1, 1, 2, 2, 3, 3, 4, 4, 5, 14, 15, 15]
    assert column(table(spark, ["I" * 5, "I!I!"]), quality.jump_total(quality.phred("x"), False)) == [0, 3]


def test_cigar(spark):
    texts = ["10M", "5S3M1I2D4N3=1X2H1P", "*", "", "3Q", None]
    df = table(spark, texts)
    parsed = df.select(cigar.parse_cigar("x").alias("c"))
    assert column(parsed, cigar.format_cigar("c")) == ["10M", "5S3M1I2D4N3=1X2H1P", "*", "*", "*", "*"]
    assert column(parsed, cigar.reference_length("c"))[:2] == [10, 13]
    assert column(parsed, cigar.reference_length("c", legacy=True))[:2] == [10, 9]
    assert column(parsed, cigar.query_length("c"))[:2] == [10, 13]
    walked = column(parsed, cigar.offsets("c"))[1]
    assert [(o["op"], o["read_at"], o["ref_at"]) for o in walked] == [("S", 0, 0), ("M", 5, 0), ("I", 8, 3), ("D", 9, 3), ("N", 9, 5), ("=", 9, 9), ("X", 12, 12), ("H", 13, 13), ("P", 13, 13)]


def test_bins(spark):
    df = spark.createDataFrame([(0, 1), (0, 1 << 14), (0, (1 << 14) + 1), (1 << 17, (1 << 17) + 5), (0, 1 << 29)], "b long, e long")
    assert column(df, cigar.reg2bin("b", "e")) == [4681, 4681, 585, 4689, 0]


def test_flags(spark):
    df = table(spark, [0, 4, 1 | 2 | 16 | 1024, 2047], "int")
    assert column(df, flags.flag_names("x"))[1:3] == [["UNMAP"], ["PAIRED", "PROPER_PAIR", "REVERSE", "DUP"]]
    assert column(df, flags.usable("x")) == [True, False, False, False]
    assert column(df.select(flags.format_flags("x", "hex").alias("t")), flags.parse_flags("t")) == [0, 4, 1043, 2047]
    assert column(df.select(flags.format_flags("x", "letters").alias("t")), flags.parse_flags("t"))[1:] == [4, 1043, 2047]
    assert column(table(spark, ["12", "q", None, ""]), flags.parse_flags("x")) == [12, None, None, None]
    regions = table(spark, ["chr1", "chr1:5", "chr1:1,000-2,000", "a:b:7-9"])
    assert [tuple(r) for r in column(regions, flags.parse_region("x"))] == [("chr1", 0, 1 << 29), ("chr1", 4, 1 << 29), ("chr1", 999, 2000), ("a:b", 6, 9)]


def test_tags(spark):
    fields = ["NM:i:-3", "RG:Z:a b", "XA:A:c", "AS:f:0.5", "XB:B:s,1,-2", "XF:B:f,1.5,2", "bad", "NM:i:300"]
    df = spark.createDataFrame([(fields,), ([],), (None,)], "x array<string>").select(tags.parse_tags("x").alias("aux"))
    got = df.collect()[0]["aux"]
    assert got["NM"]["i"] == 300 and got["XB"]["ai"] == [1, -2] and got["XF"]["af"] == [1.5, 2.0] and "bad" not in got
    text = column(df, tags.format_tags("aux"))
    assert text[0].split("\t") == ["AS:f:0.5", "NM:i:300", "RG:Z:a b", "XA:A:c", "XB:B:s,1,-2", "XF:B:f,1.5,2"]
    assert column(df, tags.text_bytes("aux"))[:2] == [len(text[0]), 0]
    assert column(table(spark, [-1, -127, -128, -32767, -32768, 0, 255, 256, 65535, 65536, None], "long"), tags.narrow_type("x")) == ["c", "c", "s", "s", "i", "C", "C", "S", "S", "I", None]
    assert column(df, tags.tag_text("aux", "RG")) == ["a b", None, None]


def test_short_floats(spark):
    values = [0.0, 0.5, 100000.0, 1e6, 123456789.0, 1e-4, 1e-5, 1.23456789, -2.5, 1e300, None]
    expected = [None if v is None else "%g" % v for v in values]
    assert column(table(spark, values, "double"), tags.short_float(F.col("x"))) == expected


@given(st.binary(max_size=200), st.binary(max_size=200))
def test_crc64_of_parts(a, b):
    whole = hashing.crc64(a + b)
    assert hashing.crc64(b, hashing.crc64(a)) == whole
    assert hashing.crc64_combine(hashing.crc64(a), hashing.crc64(b), len(b)) == whole


def test_crc64_known_value():
    assert hashing.crc64(b"123456789") == 0x995DC9BBDF1939FA


def test_row_crcs_and_digest(spark):
    df = spark.createDataFrame([(1, "ACGT", None), (2, "", "IIII"), (3, "N" * 300, "x")], "k long, seq string, qual string")
    got = {r["k"]: r for r in hashing.row_crcs(df, ["k"], ["seq", "qual"]).collect()}
    for k, seq, qual in ((1, "ACGT", ""), (2, "", "IIII"), (3, "N" * 300, "x")):
        assert got[k]["crc_seq"] & (1 << 64) - 1 == hashing.crc64(seq.encode())
        assert got[k]["crc_qual"] & (1 << 64) - 1 == hashing.crc64(qual.encode())
    one = hashing.stream_digest(df, "seq", "qual").collect()
    assert one == hashing.stream_digest(df.orderBy("k", ascending=False).repartition(3), "seq", "qual").collect()
    assert one != hashing.stream_digest(df.where("k < 3"), "seq", "qual").collect()
