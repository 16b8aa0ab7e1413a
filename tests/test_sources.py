"""Files written, sniffed and read back; the archive; streaming."""

import bz2
import gzip
import io

import pytest
from pyspark.sql import functions as F

from strandloom.operators import archive
from strandloom.sources import bam, bgzf, convert, fasta, fastq, files, register, sam

FASTQ = b"@a 1\tx\r\nACGT\r\n+a 1\r\nIIII\r\n\n\n@empty\n\n+\n\n>short\nAC\n@last\nGG\n+\n!!"


def test_fastq_records():
    assert [r[1:] for r in fastq.records(files.Lines(io.BytesIO(FASTQ)))] == [("a 1\tx", "ACGT", "IIII"), ("empty", "", ""), ("short", "AC", None), ("last", "GG", "!!")]
    assert list(fastq.records(files.Lines(io.BytesIO(b"")))) == []
    assert list(fastq.records(files.Lines(io.BytesIO(b">x\nACGT")))) == [(0, "x", "ACGT", None)]
    for wrong in (b"ACGT\n", b"@a\nACGT\n+\nII\n"):
        with pytest.raises(ValueError):
            list(fastq.records(files.Lines(io.BytesIO(wrong))))


@pytest.mark.parametrize(("name", "pack"), [("x.fastq", bytes), ("x.fastq.gz", gzip.compress), ("x.fastq.bz2", bz2.compress)])
def test_fastq_source(spark, tmp_path, name, pack):
    (tmp_path / name).write_bytes(pack(FASTQ))
    register(spark)
    rows = spark.read.format("reads_fastq").load(str(tmp_path / name)).orderBy("_ord").collect()
    starts = [FASTQ.index(x) for x in (b"@a 1", b"@empty", b">short", b"@last")]  # the order of a read is where it begins
    assert [(r["_ord"], r["id"], r["seq"], r["qual"]) for r in rows] == list(zip(starts, ("a 1\tx", "empty", "short", "last"), ("ACGT", "", "AC", "GG"), ("IIII", "", None, "!!"), strict=True))
    assert files.sniff(str(tmp_path / name)) == ("fastq", {"x.fastq": "none", "x.fastq.gz": "gzip", "x.fastq.bz2": "bzip2"}[name])


def test_fastq_writer(spark, tmp_path):
    register(spark)
    df = spark.createDataFrame([("f", 0, "a", "ACGT", "IIII"), ("f", 1, "b", "", ""), ("f", 2, "c", "AA", None)], fastq.FASTQ_SCHEMA)
    out = str(tmp_path / "out")
    df.write.format("reads_fastq").mode("append").save(out)
    back = spark.read.format("reads_fastq").load(out)
    assert {(r["id"], r["seq"], r["qual"]) for r in back.collect()} == {("a", "ACGT", "IIII"), ("b", "", ""), ("c", "AA", None)}


def test_fasta(spark, tmp_path):
    (tmp_path / "r.fa").write_text(">one first\nAC\nGT\n\n>two\nNNN\n")
    register(spark)
    assert {tuple(r) for r in fasta.read_dictionary(spark, str(tmp_path / "r.fa")).collect()} == {("one", "ACGT", 4), ("two", "NNN", 3)}
    assert files.sniff(str(tmp_path / "r.fa"))[0] == "fasta"
    (tmp_path / "twice.fa").write_text(">one\nA\n>one\nC\n")
    with pytest.raises(ValueError, match="repeated"):
        fasta.read_dictionary(spark, str(tmp_path / "twice.fa"))
    with pytest.raises(ValueError, match="no letters"):
        list(fasta.sequences(files.Lines(io.BytesIO(b">a\n>b\nA\n"))))


SAM = (
    "@HD\tVN:1.0\tSO:unsorted\n@SQ\tSN:chr 1\tLN:1000\n@CO\tfree: text\n"
    "r1\t99\tchr 1\t11\t60\t2S2M\t=\t21\t14\tACGT\tIIII\tNM:i:1\tRG:Z:g:1\tXB:B:c,1,-2\n"
    "r2\t16\tchr 1\t5\t37\t4M\t*\t0\t0\tAACC\t!\"#$\n"
    "r3\t4\t*\t0\t255\t*\t*\t0\t0\t*\t*\n"
    "r4\t0\tchr 1\t7\t0\t*\t*\t0\t0\tAC\t*\n"
)


def test_sam(spark, tmp_path):
    (tmp_path / "x.sam").write_text(SAM)
    path = str(tmp_path / "x.sam")
    assert files.sniff(path) == ("sam", "none")
    rows = {r["id"]: r for r in sam.read(spark, path).collect()}
    assert (rows["r1"]["pos"], rows["r1"]["mate_seqname"], rows["r1"]["mate_pos"], rows["r1"]["aux"]["XB"]["ai"]) == (10, "chr 1", 20, [1, -2])
    assert (rows["r2"]["seq"], rows["r2"]["qual"], rows["r2"]["strand"]) == ("GGTT", "$#\"!", True)
    assert rows["r3"]["seq"] is None and rows["r3"]["seqname"] is None and rows["r3"]["pos"] is None
    assert rows["r4"]["flags"] == 4
    header = sam.read_header(spark, path).orderBy("line_no").collect()
    assert [(h["line_no"], h["record"]) for h in header] == [(0, "HD"), (1, "SQ"), (2, "CO")] and header[2]["tags"] == {"text": "free: text"}
    sam.write(sam.read(spark, path), str(tmp_path / "out"), sam.read_header(spark, path))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text.replace("LN:1000\tSN:chr 1", "SN:chr 1\tLN:1000").replace("SO:unsorted\tVN:1.0", "VN:1.0\tSO:unsorted") == SAM.replace("r4\t0\t", "r4\t4\t")


def test_bad_sam_is_an_error(spark, tmp_path):
    for i, line in enumerate(("r1\t0\tchr\t1\t60\t5M\t*\t0\t0\tACGT\tIIII", "r1\t0\tchr", "r1\t0\tchr\t1\t60\t4M\t*\t0\t0\tACGT\tII")):
        (tmp_path / f"{i}.sam").write_text(line + "\n")
        with pytest.raises(Exception, match="inconsistent|fewer"):
            sam.read(spark, str(tmp_path / f"{i}.sam")).collect()


def test_headers(spark):
    rows = [("a", 0, "SQ", {"SN": "x", "LN": "5"}), ("b", 0, "SQ", {"SN": "x", "LN": "5"}), ("b", 1, "RG", {"LB": "q"}), ("b", 2, "ZZ", {})]
    header = spark.createDataFrame(rows, "_file string, line_no int, record string, tags map<string,string>")
    assert {tuple(r) for r in sam.header_problems(header).collect()} == {("b", 1, "RG without ID"), ("b", 2, "unknown record")}
    assert sam.merge_headers(header.where("record = 'SQ'")).count() == 1
    clash = header.unionByName(spark.createDataFrame([("c", 0, "SQ", {"SN": "x", "LN": "6"})], header.schema))
    with pytest.raises(ValueError, match="disagree"):
        sam.merge_headers(clash)


def test_bgzf():
    data = bytes(range(256)) * 1000
    raw = io.BytesIO()
    raw.close_really, raw.close = raw.close, lambda: None
    out = bgzf.Writer(raw)
    out.write(data)
    out.close()
    packed = raw.getvalue()
    assert gzip.decompress(packed) == data and packed.endswith(bgzf.END)
    assert io.BufferedReader(bgzf.Reader(io.BytesIO(packed))).read() == data
    with pytest.raises(ValueError):
        list(bgzf.blocks(io.BytesIO(gzip.compress(b"plain"))))
    with pytest.raises(Exception):  # noqa: B017
        list(bgzf.blocks(io.BytesIO(packed[:40] + b"\xff" + packed[41:])))


def test_all_conversions_are_lossless(spark, tmp_path):
    (tmp_path / "x.sam").write_text(SAM)
    names = spark.createDataFrame([("chr 1", 1000)], "seqname string, length long")
    columns = ["id", "seq", "qual", "flags", "seqname", "strand", "pos", "map_qual", "mate_seqname", "mate_pos", "tlen"]
    want = {tuple(r) for r in convert.read(spark, str(tmp_path / "x.sam")).select(columns).collect()}
    for first in ("bam", "archive"):
        one = convert.convert(spark, str(tmp_path / "x.sam"), str(tmp_path / f"one.{first}{'.reads' if first == 'archive' else ''}"), first, names)
        two = convert.convert(spark, one, str(tmp_path / f"two-{first}.sam"), "sam", names)
        assert {tuple(r) for r in convert.read(spark, two, "sam").select(columns).collect()} == want
    aux = {r["id"]: r["aux"] for r in convert.read(spark, str(tmp_path / "one.bam")).select("id", "aux").collect()}
    assert aux["r1"]["XB"]["ai"] == [1, -2] and aux["r1"]["RG"]["s"] == "g:1" and aux["r1"]["NM"]["i"] == 1
    plain = convert.convert(spark, str(tmp_path / "x.sam"), str(tmp_path / "y.fastq"))
    got = {r["id"]: (r["seq"], r["qual"], r["flags"]) for r in convert.read(spark, plain).collect()}
    assert got["r2"] == ("GGTT", "$#\"!", 4)
    with pytest.raises(Exception):  # noqa: B017  an existing target is kept
        convert.convert(spark, str(tmp_path / "x.sam"), str(tmp_path / "y.fastq"))
    assert convert.test(spark, [str(tmp_path / "one.archive.reads"), str(tmp_path / "x.sam")]) == 8


def test_archive_notices_damage(spark, tmp_path):
    path = str(tmp_path / "a.reads")
    df = convert.as_reads(spark.createDataFrame([("f", i, f"id{i}", "ACGT" * (i % 3), "IIII" * (i % 3)) for i in range(25)], fastq.FASTQ_SCHEMA))
    archive.write(df, path, reads=10)
    assert archive.verify(spark, path).count() == 12
    listed = convert.list_archive(spark, path).first()
    assert (listed["blocks"], listed["reads"], listed["bases"]) == (3, 25, sum(4 * (i % 3) for i in range(25)))
    changed = spark.read.parquet(f"{path}/reads").withColumn("qual", F.when(F.col("_ord") == 11, "!!!!!!!!").otherwise(F.col("qual")))
    changed.cache().count()
    changed.write.mode("overwrite").parquet(f"{path}/reads2")
    import shutil

    shutil.rmtree(f"{path}/reads")
    shutil.move(f"{path}/reads2", f"{path}/reads")
    spark.catalog.clearCache()
    damaged = archive.verify(spark, path, strict=False).where("not ok").collect()
    assert [(r["block"], r["column"]) for r in damaged] == [(1, "qual")]
    with pytest.raises(ValueError, match="damaged"):
        archive.verify(spark, path)
    spark.createDataFrame([('{"version": 9}',)], "value string").write.mode("overwrite").text(f"{path}/about")
    with pytest.raises(ValueError, match="newer"):
        archive.read(spark, path)


def test_names():
    assert files.format_of_name("a/x.fastq.gz") == "fastq" and files.format_of_name("x") is None
    assert files.output_name("x.fastq.gz", "archive") == "x.fastq.reads" and files.output_name("x.fastq.reads", "fastq") == "x.fastq"
    assert files.output_name("x.sam", "bam") == "x.bam"


def test_unknown_format(tmp_path):
    (tmp_path / "x").write_bytes(b"\x00\x01\x02 nothing known")
    with pytest.raises(ValueError, match="not known"):
        files.sniff(str(tmp_path / "x"))
    with pytest.raises(FileNotFoundError):
        files.expand(str(tmp_path / "none.fastq"))


def test_stream_state_spans_batches(spark, tmp_path):
    from strandloom.streaming import ingest

    schema = "_file string, _ord long, read_no long, id string"
    for i in range(2):
        rows = [("f", 2 * i + j, 2 * i + j, f"run.{2 * i + j} lane") for j in range(2)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = ingest.stream_table(spark, str(tmp_path / "in"), schema, files_per_trigger=1)
    ingest.to_table(ingest.identifier_matches(stream), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {r["read_no"]: (r["matches"], r["tokens"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(got) == 4 and sum(m == 0 for m, _ in got.values()) == 1


def test_stream_ingest_follows_the_order_of_the_reads(spark, tmp_path):
    from strandloom.plans import formats
    from strandloom.streaming import ingest

    # 40 part files whose rows of two files interleave; neighbours in _ord are often equal.
    rows = [(n, "fg"[n % 2], n * 37 % 200, f"run.{n * 37 % 200 // 5} lane") for n in range(200)]
    spark.createDataFrame(rows, "read_no long, _file string, _ord long, id string").repartition(40, "_ord").write.parquet(str(tmp_path / "raw_reads.parquet"))
    want, before = {}, {}
    for n, file, _, name in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        want[n] = sum(a == b for a, b in zip([name.split()[0], name.split()[1]], before.get(file, [None] * 2), strict=True))
        before[file] = name.split()
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))
    try:
        got = formats.stream_ingest(spark, str(tmp_path)).collect()
        table = spark.read.parquet(str(tmp_path / "raw_reads.parquet"))
        ingest.write_in_order(table, str(tmp_path / "in"), ["_file", "_ord", "read_no"], rows=20)
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    stream = ingest.stream_table(spark, str(tmp_path / "in"), table.schema, files_per_trigger=2)
    ingest.to_table(ingest.identifier_matches(stream), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    small = spark.read.parquet(str(tmp_path / "out")).collect()
    # Equal identifiers match in all tokens: as many reads do so as neighbours in order are equal.
    for found in (got, small):
        assert {r["read_no"]: r["matches"] == r["tokens"] for r in found} == {n: m == 2 for n, m in want.items()}


def test_stream_windows(spark, tmp_path):
    from strandloom.streaming import ingest

    spark.sql("select 'f' as _file, 'ACGT' as seq, timestamp'2024-01-01 00:10:00' as loaded_at union all select 'f', 'AC', timestamp'2024-01-01 05:10:00'").write.parquet(str(tmp_path / "in"))
    stream = ingest.windowed_counts(ingest.stream_table(spark, str(tmp_path / "in"), "_file string, seq string, loaded_at timestamp"))
    query = stream.writeStream.format("memory").queryName("windows").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert {(r["reads"], r["bases"]) for r in spark.sql("select * from windows").collect()} == {(1, 4), (1, 2)}


def _nasty_reads(n):
    """Qualities that begin like headers, reads without letters, reads without quality."""
    import random

    random.seed(n)
    out = []
    for i in range(n):
        k = random.choice([0, 1, 2, 5, 40])
        seq = "".join(random.choices("ACGTN", k=k))
        out.append((f"r{i} x", seq, None if random.random() < 0.15 and k else "".join(random.choices("@>+I!", k=k))))
    return out


@pytest.mark.parametrize("split", [1, 37, 512])
def test_fastq_ranges_give_the_same_reads(spark, tmp_path, split):
    register(spark)
    reads = _nasty_reads(120)
    for folder, part in (("run1", reads[:70]), ("run2", reads[70:])):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "a.fastq").write_text("".join(fastq.format_record(*r) for r in part))
    reader = fastq.FastqReader(str(tmp_path), split)
    got = [(r["_file"], r["_ord"], r["id"], r["seq"], r["qual"]) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [g[2:] for g in sorted(got)] == reads and len({g[0] for g in got}) == 2
    if split == 512:
        df = spark.read.format("reads_fastq").option("splitBytes", split).load(str(tmp_path))
        assert df.rdd.getNumPartitions() > 3 and df.count() == len(reads)


@pytest.mark.parametrize("split", [3, 50])
def test_fasta_ranges_give_the_same_sequences(tmp_path, split):
    names = [(f"s{i}", "ACGTN" * (i + 1)) for i in range(12)]
    (tmp_path / "a.fa").write_text("".join(f">{n} text\n{s[:7]}\n\n{s[7:]}\n" for n, s in names))
    reader = fasta.FastaReader(str(tmp_path / "a.fa"), split)
    assert [(r["seqname"], r["seq"]) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()] == names


def test_bam_ranges_give_the_same_records(spark, tmp_path):
    rows = [(i, f"read{i}", "ACGT" * (5 + i % 60), "I" * 4 * (5 + i % 60), "chr1" if i % 3 else None, i * 7) for i in range(6000)]
    df = convert.as_reads(spark.createDataFrame(rows, "_ord long, id string, seq string, qual string, seqname string, pos long")).coalesce(1)
    references = spark.createDataFrame([("chr1", 100000)], "seqname string, length long")
    (path,) = bam.write(df.withColumn("_file", F.lit("f")).repartition(1), str(tmp_path / "b"), references, order=["_file"])
    import os

    one = bam.BamReader(path, 0)
    whole = [r for p in one.partitions() for b in one.read(p) for r in b.to_pylist()]
    assert len(whole) == 6000
    for split in (os.path.getsize(path) // 7, 1000):
        reader = bam.BamReader(path, split)
        assert len(reader.partitions()) > 5
        assert [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()] == whole


def test_several_inputs_do_not_interleave(spark, tmp_path):
    register(spark)
    for folder in ("x", "y"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "r.fastq").write_text("".join(f"@{folder}{i}\nAC\n+\nII\n" for i in range(50)))
    for kind in ("sam", "bam", "fastq"):
        target = str(tmp_path / f"out.{kind}")
        convert.convert(spark, f"{tmp_path}/x,{tmp_path}/y", target, kind)
        back = convert.read(spark, target, kind).orderBy("_file", "_ord").collect()
        assert [r["id"] for r in back] == [f"{f}{i}" for f in "xy" for i in range(50)], kind


def test_commands(spark, tmp_path, capsys):
    from strandloom.__main__ import arguments, run

    for name in ("a", "b"):
        (tmp_path / f"{name}.fastq").write_text("".join(f"@{name}{i}\nACGT\n+\nIIII\n" for i in range(30)))
    target = str(tmp_path / "both.reads")
    run(spark, arguments(["convert", str(tmp_path / "a.fastq"), str(tmp_path / "b.fastq"), "-o", target]))
    run(spark, arguments(["test", target, str(tmp_path / "a.fastq")]))
    with pytest.raises(Exception, match="(?i)exist"):
        run(spark, arguments(["convert", str(tmp_path / "a.fastq"), "-o", target]))
    with pytest.raises(ValueError):
        run(spark, arguments(["list", str(tmp_path / "a.fastq")]))
    run(spark, arguments(["list", target, str(tmp_path / "a.fastq")]))
    shown = capsys.readouterr().out
    assert "a.fastq" in shown and "b.fastq" in shown and "bits_per_base" in shown
    run(spark, arguments(["convert", target, "-o", str(tmp_path / "c.sam"), "-t", "sam", "-f"]))
    assert convert.read(spark, str(tmp_path / "c.sam")).count() == 60
