"""Dataset operators against brute force on small tables."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandloom.operators import align, assembly, eager, graph, intervals, kmers, models, ordered, reference

TURN = str.maketrans("ACGT", "TGCA")


def turned(s):
    return s[::-1].translate(TURN)


# intervals --------------------------------------------------------------------


def brute(rows):
    by = {}
    for k, b, e in rows:
        if b is not None and e is not None and b < e:
            by.setdefault(k, []).append((b, e))
    periods, gaps = set(), set()
    for k, spans in by.items():
        spans.sort()
        start, stop = spans[0]
        for b, e in spans[1:]:
            if b > stop:
                periods.add((k, start, stop))
                gaps.add((k, stop, b))
                start = b
            stop = max(stop, e)
        periods.add((k, start, stop))
    return periods, gaps


@pytest.mark.parametrize("tile", [1 << 16, 7, 1])
def test_periods_and_gaps(spark, tile):
    random.seed(tile)
    rows = [(random.choice(["a", "b", None]), b, b + random.randrange(0, 9)) for b in random.choices(range(-50, 400), k=150)]
    rows += [("a", 10, 400), ("a", 10, 400), ("t", 0, 5), ("t", 5, 9), ("t", 9, 9), ("n", None, 4), ("n", 4, None), ("one", 3, 4)]
    df = spark.createDataFrame(rows, "gap_start string, _b long, _e long").withColumn("_tile", F.lit("clash"))
    args = (df, ["gap_start"], F.col("_b"), F.col("_e"), tile)
    periods, gaps = brute(rows)
    got = intervals.periods(*args).collect()
    assert {tuple(r)[:3] for r in got} == periods and len(got) == len(periods)
    assert sum(r["intervals"] for r in got) == sum(1 for _, b, e in rows if b is not None and e is not None and b < e)
    found = [tuple(r) for r in intervals.gaps(*args).toDF("k", "s", "e").collect()]
    assert set(found) == gaps and len(found) == len(gaps)


def test_no_intervals(spark):
    df = spark.createDataFrame([], "k string, b long, e long")
    assert intervals.gaps(df, ["k"], F.col("b"), F.col("e")).count() == 0
    assert intervals.periods(df, ["k"], F.col("b"), F.col("e")).count() == 0


# heavy keys ---------------------------------------------------------------------


def test_join_aggregate_equals_the_join(spark):
    random.seed(5)
    left = spark.createDataFrame([(random.choice(["h"] * 8 + ["a", "b", None]), random.choice("xy"), random.randrange(9)) for _ in range(300)], "rows string, g string, v int")
    right = spark.createDataFrame([("h", 1), ("h", 2), ("a", 5), ("c", 7), (None, 9), ("a", None)], "rows string, w int")
    for how in ("inner", "left"):
        got = eager.join_aggregate(
            eager.Side(left, {"k": F.col("rows")}, {"g": F.col("g")}, sums={"v": F.col("v")}, extremes={"top": ("max", F.col("v"))}),
            eager.Side(right, {"k": F.col("rows")}, sums={"w": F.col("w")}),
            how, count="n",
        )
        plain = left.join(right, "rows", how).groupBy("g").agg(F.sum("v").alias("v"), F.max("v").alias("top"), F.sum("w").alias("w"), F.count("*").alias("n"))
        assert {tuple(r) for r in got.select("g", "n", "v", "w", "top").collect()} == {tuple(r) for r in plain.select("g", "n", "v", "w", "top").collect()}


def test_heavy_keys(spark):
    rows = [("f", "a")] * 5 + [("f", f"k{i}") for i in range(95)] + [("g", None)] * 9 + [("g", "z"), (None, "z")]
    got = eager.heavy_keys(spark.createDataFrame(rows, "f string, k string"), "f", "k", 0.05)
    assert {tuple(r) for r in got.collect()} == {("f", "a", 5, 100), ("g", "z", 1, 1)}
    assert eager.heavy_keys(spark.createDataFrame([], "f string, k string"), "f", "k", 0.05).count() == 0


def test_eager_side_has_no_row_shuffle(spark):
    """The counts are made before the exchange: what is shuffled are states."""
    df = spark.range(1000).select((F.col("id") % 3).cast("string").alias("f"), F.lit("x").alias("k"))
    plan = eager.heavy_keys(df, "f", "k", 0.05)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan


# order ------------------------------------------------------------------------


@pytest.mark.parametrize("chunk", [3, 1 << 16])
def test_ordered(spark, chunk):
    random.seed(2)
    rows = [(f, o, random.choice(["a", "b", None])) for f in "xy" for o in random.sample(range(100), 30)]
    df = spark.createDataFrame(rows, "f string, o long, v string").repartition(5)
    expected = {}
    for f in "xy":
        mine = sorted((o, v) for g, o, v in rows if g == f)
        for i, (o, v) in enumerate(mine):
            expected[f, o] = (mine[i - 1][1] if i else None, i + 1, v)
    previous = ordered.with_previous(df, {"p": F.col("v")}, ["f"], ["o"], chunk)
    numbered = ordered.with_row_number(previous, "n", ["f"], ["o"], chunk)
    assert {(r["f"], r["o"]): (r["p"], r["n"], r["v"]) for r in numbered.collect()} == expected
    runs = ordered.run_lengths(df, F.col("v"), ["f"], ["o"], chunk).orderBy("f", "run").collect()
    for f in "xy":
        assert [v for r in runs if r["f"] == f for v in [r["value"]] * r["n"]] == [v for _, v in sorted(((o, v) for g, o, v in rows if g == f), key=lambda x: x[0])]
    index = ordered.first_seen_index(df, "v", ["f"], ["o"]).collect()
    for f in "xy":
        seen = list(dict.fromkeys(v for _, v in sorted(((o, v) for g, o, v in rows if g == f), key=lambda x: x[0]) if v))
        assert [r["v"] for r in sorted(index, key=lambda r: r["index"]) if r["f"] == f] == seen
    kept = ordered.reservoir(df, 20, 5, ["f"], ["o"]).collect()
    assert sorted(r["o"] for r in kept if r["f"] == "x") == sorted(o for f, o, _ in rows if f == "x")[15:20]


def test_blocks_and_schemes(spark):
    chunks = spark.createDataFrame([("f", i, b) for i, b in enumerate([4, 4, 4, 9, 1, 1])], "f string, chunk long, bases long")
    assert [r["block"] for r in ordered.block_cuts(chunks, ["f"], most=10).orderBy("chunk").collect()] == [0, 0, 0, 1, 1, 1]
    scores = spark.createDataFrame([("f", 0, 40, 70), ("f", 1, 64, 104), ("f", 2, None, None), ("f", 3, 35, 60)], "f string, chunk long, low int, high int")
    assert [r["base"] for r in ordered.scheme_changes(scores, ["f"]).orderBy("chunk").collect()] == [33, 64, 64, 35]


# k-mers and models ---------------------------------------------------------------


def test_kmer_counts(spark):
    seqs = ["ACGTACGTAC", "gtacgtacgt", "ACGNACGT", "", None, "AC"]
    df = spark.createDataFrame([(s,) for s in seqs], "seq string")
    expected = {}
    for s in seqs:
        s = (s or "").upper()
        for i in range(len(s) - 3):
            w = s[i : i + 4]
            if set(w) <= set("ACGT"):
                expected[min(w, turned(w))] = expected.get(min(w, turned(w)), 0) + 1
    assert {r["kmer"]: r["n"] for r in kmers.count_kmers(df, F.col("seq"), 4).collect()} == expected
    assert kmers.count_kmers(df, F.col("seq"), 4, cap=2).agg(F.max("n")).first()[0] == 2
    wanted = kmers.count_kmers(df, F.col("seq"), 4).select("kmer")
    looked = kmers.approximate_lookup(kmers.approximate_counts(df, F.col("seq"), 4), wanted)
    assert all(r["n"] >= expected[r["kmer"]] for r in looked.collect())


def test_adaptive_bits(spark):
    text = "ACGTTGCAACGTTTGACA" * 3
    df = spark.createDataFrame([(text,)], "seq string")
    counts = models.context_counts(models.nucleotide_contexts(df, F.col("seq"), 1), ["context"], "symbol")
    expected, state = {}, {}
    for c, s in zip(text, text[1:], strict=False):
        t = state.setdefault(c, dict.fromkeys("ACGT", 1))
        expected[c] = expected.get(c, 0) - math.log2(t[s] / sum(t.values()))
        t[s] += 1
    got = {r["context"]: r["bits"] for r in models.adaptive_bits(counts, ["context"], "symbol", 4).collect()}
    assert got.keys() == expected.keys() and all(abs(got[c] - expected[c]) < 1e-6 for c in got)


def test_quality_contexts_agree(spark):
    """Counting by batch gives what the row expression gives."""
    from strandloom.functions.quality import contexts

    random.seed(10)
    rows = [("".join(chr(33 + random.choice([2, 20, 35, 36, 38, 41, 60])) for _ in range(random.randrange(0, 90))),) for _ in range(60)] + [(None,), ("",), ("I" * 3,)]
    df = spark.createDataFrame(rows, "code string").repartition(3)
    by_row = df.select(F.inline(contexts("code"))).groupBy("pos4", "delta", "q34", "q2", "q1", "q").agg(F.count("*").alias("n"))
    got = models.quality_context_counts(df, F.col("code"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in by_row.collect()}
    assert models.quality_context_counts(df.where("false"), F.col("code")).count() == 0


def test_graph_parts(spark):
    chain = [(i, i // 2) for i in range(200)] + [(i, 1000 + (i + 1) // 2) for i in range(200)] + [(900, 77777)]
    got = {r["i"]: r["part"] for r in graph.connected(spark.createDataFrame(chain, "i long, l long"), "i", "l").collect()}
    assert {got[i] for i in range(200)} == {0} and got[900] == 900


# references -------------------------------------------------------------------------


def make_reads(spark):
    random.seed(11)
    ref = "".join(random.choices("ACGT", k=900))
    rows = []
    for i in range(40):
        pos = random.randrange(0, 700)
        ops = random.choice([[("M", 50)], [("S", 4), ("M", 30), ("I", 3), ("M", 13)], [("M", 20), ("D", 7), ("M", 30)], [("H", 9), ("M", 20), ("N", 60), ("M", 30)]])
        text, at = "", pos
        for op, n in ops:
            if op == "M":
                text += "".join(c if random.random() > 0.1 else random.choice("ACGTN") for c in ref[at : at + n])
            if op in "SI":
                text += "".join(random.choices("ACGT", k=n))
            at += n if op in "MDN" else 0
        strand = random.random() < 0.5
        rows.append((i, 16 if strand else 0, "ref", strand, pos, [dict(op=o, len=n) for o, n in ops], turned_n(text) if strand else text))
    rows.append((99, 4, None, False, None, None, "ACGT"))
    reads = spark.createDataFrame(rows, "n long, flags int, seqname string, strand boolean, pos long, cigar array<struct<op:string,len:int>>, seq string")
    return reads, spark.createDataFrame([("ref", ref.lower())], "seqname string, seq string"), {r[0]: r[6] for r in rows}


def turned_n(s):
    return s[::-1].translate(str.maketrans("ACGTN", "TGCAN"))


def test_reference_coding_is_lossless(spark):
    reads, names, texts = make_reads(spark)
    fetched = reference.fetch(reference.alignable(reads, "n"), names, "n", tile=64)
    encoded = reference.diff_encode(fetched, "n")
    back = reference.diff_decode(fetched.select("n", "strand", "cigar", "under").join(encoded.select("n", "diff"), "n"), "n")
    got = {r["n"]: r["seq"] for r in back.collect()}
    assert got == {n: t for n, t in texts.items() if n != 99}


def test_reference_checks(spark):
    a = spark.createDataFrame([("x", "ACGT"), ("y", "AC"), ("z", "AA"), ("z", "AA"), ("w", "AG")], "seqname string, seq string")
    b = spark.createDataFrame([("x", "acgt"), ("y", "ACG"), ("v", "T"), ("z", "AA"), ("w", "AC")], "seqname string, seq string")
    assert {tuple(r) for r in reference.dictionary_check(a, b).collect()} == {("y", "length"), ("z", "repeated"), ("v", "only right"), ("w", "content")}
    reads = spark.createDataFrame([("q",), ("x",), (None,)], "seqname string")
    assert [tuple(r) for r in reference.missing_names(reads, a).collect()] == [("q", 1)]
    with pytest.raises(Exception, match="no reference named q"):
        reference.with_reference(reads, b, strict=True).collect()


def test_dictionary_checksum(spark):
    from strandloom.functions.hashing import crc64

    names = spark.createDataFrame([("b", "acgt"), ("a", "GG")], "seqname string, seq string")
    row = reference.dictionary_checksum(names).first()
    assert tuple(row) == (2, 6, f"{crc64(b'aGGbACGT'):016x}")


def test_entropy(spark):
    counts = spark.createDataFrame([("x", "A", 2), ("x", "C", 2), ("y", "A", 5)], "context string, symbol string, n long")
    assert tuple(models.entropy(counts, ["context"], "symbol").first()) == (9, 4.0, 4 / 9)
    assert models.entropy(counts.drop("context"), [], "symbol").first()["symbols"] == 9


def test_alignment_finds_planted_reads(spark):
    random.seed(3)
    contigs = {f"c{i}": "".join(random.choices("ACGT", k=500)) for i in range(3)}
    rows, truth = [], {}
    for n in range(30):
        c = random.choice(list(contigs))
        at = random.randrange(0, 430)
        text = list(contigs[c][at : at + 60])
        for i in random.sample(range(13, 60), 5):
            text[i] = random.choice("ACGT")
        flip = random.random() < 0.5
        text = "".join(text)
        rows.append((n, turned(text) if flip else text))
        truth[n] = (c, at, flip, sum(x != y for x, y in zip(text, contigs[c][at : at + 60], strict=True)))
    rows += [(100, "ACGT"), (101, None), (102, "".join(random.choices("ACGT", k=12)))]
    reads = spark.createDataFrame(rows, "n long, seq string")
    named = spark.createDataFrame(list(contigs.items()), "name string, text string")
    found = align.align(reads, named, "n", "seq", "name", "text")
    got = {r["n"]: (r["contig"], r["begin"], r["reverse"], r["mismatches"]) for r in found.collect()}
    assert all(got[n] == t for n, t in truth.items() if n in got) and len(set(truth) & set(got)) >= 25
    assert align.unaligned(reads, found, "n").count() == len(rows) - len(got)


@pytest.mark.parametrize("cap", [3, None])
def test_alignment_of_batches_equals_joins(spark, monkeypatch, cap):
    """Both plans place odd reads alike; the one for a reference that fits shuffles no candidate."""
    random.seed(14)
    letters = lambda n: "".join(random.choices("ACGT", k=n))
    repeat = letters(40)
    contigs = {"é": repeat + letters(60) + repeat, "b": "nn" + repeat.lower() + letters(5000) + turned(repeat), "a": repeat * 4, "B": "ACGT" * 30, "short": "ACGTACG", "none": None, "empty": ""}
    seqs = [None, "", repeat[:11], repeat[:12], repeat, turned(repeat).lower(), "ACGT" * 8, "N" + repeat[1:], repeat[:20] + "é" + repeat[21:], letters(60)]
    seqs += [contigs["b"][i : i + 90].upper() if i % 2 else turned(contigs["b"][i : i + 90].upper()) for i in range(0, 5000, 97)]
    reads = spark.createDataFrame(list(enumerate(seqs)), "n long, seq string")
    named = spark.createDataFrame(list(contigs.items()), "name string, text string")
    found = align.align(reads, named, "n", "seq", "name", "text", cap=cap)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr("strandloom.operators.seeding._HITS", 7)  # rows in many steps
    monkeypatch.setattr("strandloom.operators.seeding._STEP", 100)
    stepped = align.align(reads, named, "n", "seq", "name", "text", cap=cap)
    monkeypatch.setattr("strandloom.operators.seeding.LETTERS", 0)
    joined = align.align(reads, named, "n", "seq", "name", "text", cap=cap)
    want = sorted(map(tuple, joined.collect()))
    assert len(want) > 50 and found.schema.simpleString() == joined.schema.simpleString()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, stepped.collect())) == want


def test_unaligned_reads_shuffle_row_ids_only(spark, tmp_path):
    """Reads that are null, short or of other letters stay; nothing but the anti join of row ids moves rows."""
    from strandloom.plans.alignments import QUERIES

    random.seed(15)
    contig = "".join(random.choices("ACGT", k=9000))
    seqs = [None, "", contig[:11], "N" * 50, "R" + contig[10:60], contig[4050:4150], turned(contig[8000:8040]), contig[40:52].lower()]
    spark.createDataFrame(list(enumerate(seqs)), "read_no long, seq string").repartition(4).write.parquet(f"{tmp_path}/aligned_reads.parquet")
    spark.createDataFrame([("c", contig)], "seqname string, seq string").write.parquet(f"{tmp_path}/named_seqs.parquet")
    got = QUERIES["unaligned_reads"](spark, str(tmp_path))
    exchanges = [x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x]
    assert len(exchanges) <= 2, exchanges
    assert sorted(r["read_no"] for r in got.collect()) == [0, 1, 2, 3]


def test_contigs_cover_the_genome(spark):
    random.seed(4)
    genome = "".join(random.choices("ACGT", k=600))
    reads = spark.createDataFrame([(i, genome[s : s + 80]) for i, s in enumerate(range(0, 521, 5))] + [(999, None), (998, "ACGT")], "n long, seq string")
    longest = max((r["seq"] for r in assembly.assemble(reads, "n", F.col("seq"), k=25).collect()), key=len)
    assert len(longest) >= 500 and (longest in genome or turned(longest) in genome)



def test_contigs_of_all_seeds_equal_one_fold(spark):
    random.seed(6)
    letters = lambda n: "".join(random.choices("ACGT", k=n))
    g, h, alone = letters(400), letters(400), letters(230)
    # Rows come before the reads they need: an N inside, a first k-mer that is single, two genomes in one seed.
    seqs = [g[0:40] + "N" + g[41:90], letters(20) + g[100:160], g[200:240] + "N" + h[200:240], h[300:360] + letters(20), alone, "N" + g[:60], g[300:360] + "R"]
    seqs += [x[s : s + 60].lower() if s % 20 else turned(x[s : s + 60]) for x in (g, h) for s in range(0, 341, 10)] + [None, "ACGT"]
    k, counts = 25, Counter()
    for s in filter(None, seqs):
        counts.update(assembly._canon(w) for w in (s.upper()[i : i + k] for i in range(len(s) - k + 1)) if set(w) <= set("ACGT"))
    state, want = assembly.Counts({w: n for w, n in counts.items() if n >= 2}), {}
    for n, s in enumerate(seqs):
        if s and len(s) >= k and set(s.upper()[:k] + s.upper()[-k:]) <= set("ACGT"):
            contig = assembly.grow(state, s.upper(), k)
            if len(contig) >= 200:
                want[n] = contig
    reads = spark.createDataFrame(list(enumerate(seqs)), "n long, seq string")
    got = assembly.assemble(reads, "n", F.col("seq"), k=k).collect()
    assert {r["contig"]: r["seq"] for r in got} == want and len(got) == len(want)
    assert {0, 2, 4} <= set(want) and "N" in want[2] and not {5, 6} & set(want)


def test_contigs_need_no_ordered_task(spark, monkeypatch):
    """The first reads are found by counts; k-mers counted in slices and folds of other sizes give the same contigs."""
    random.seed(8)
    genome = "".join(random.choices("ACGT", k=900))
    reads = [((i - 40) * 1000003 if i % 3 else i, genome[s : s + 90]) for i, s in enumerate(random.choices(range(810), k=150))]
    df = spark.createDataFrame(reads, "n long, s string").repartition(3)
    asked, plain = [], assembly.assemble
    monkeypatch.setattr(assembly, "assemble", lambda rows, *a, **b: asked.append(rows) or plain(rows, *a, **b))
    contigs, _, _ = assembly.code_with_contigs(df, "n", "s", first=100)
    assert not any(x in asked[0]._jdf.queryExecution().executedPlan().toString() for x in ("TakeOrdered", "Limit", "Sort"))
    assert sorted(r["n"] for r in asked[0].collect()) == sorted(n for n, _ in reads)[:100]
    want = {r["contig"]: r["seq"] for r in contigs.collect()}
    monkeypatch.setattr(assembly, "LETTERS_AT_ONCE", 500)
    monkeypatch.setattr(assembly, "FOLDS", 1)
    again, _, _ = assembly.code_with_contigs(df, "n", "s", first=100)
    assert want and {r["contig"]: r["seq"] for r in again.collect()} == want


def test_contigs_code_reads(spark):
    """First reads, contigs, offsets, both strands, placements and motifs in one go."""
    import random

    from strandloom.operators import assembly

    random.seed(6)
    genome = "".join(random.choices("ACGT", k=700))
    turn = str.maketrans("ACGT", "TGCA")
    reads = []
    for i in range(160):
        at = random.randrange(0, 620)
        text = genome[at : at + 80]
        reads.append((i, text if i % 2 else text[::-1].translate(turn)))
    df = spark.createDataFrame(reads, "n long, s string")
    contigs, placed, motifs = assembly.code_with_contigs(df, "n", "s", first=100)
    rows = {r["contig"]: r for r in contigs.collect()}
    at = 0
    for name in sorted(rows):
        assert rows[name]["at"] == at
        at += len(rows[name]["seq"])
    found = placed.collect()
    assert len(found) > 120 and {r["reverse"] for r in found} == {True, False} and all(r["mismatches"] / r["length"] <= 0.22 for r in found)
    letters = {}
    for r in found:
        letters[r["contig"]] = letters.get(r["contig"], 0) + r["length"]
    for r in motifs.groupBy("contig").agg({"weight": "sum"}).collect():
        assert r[1] == 50 * len(rows[r[0]]["seq"]) + 4 * letters.get(r[0], 0)
