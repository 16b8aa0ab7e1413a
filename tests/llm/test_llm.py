"""Training-data operators against brute force, with the edge cases their docstrings state."""

import math
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandloom.llm import frequent, mixing, neardup, packing, pieces, queries, seen, spans, tokens, truncated

TURN = str.maketrans("ACGT", "TGCA")

# seen -------------------------------------------------------------------------


@given(st.lists(st.integers(0, 2**20 - 1), max_size=300), st.lists(st.integers(0, 2**20 - 1), max_size=50))
@settings(max_examples=60, deadline=None)
def test_quotient_filter_is_a_set(stored, asked):
    values = np.unique(np.array(stored, np.uint64))
    f = seen.QuotientFilter(values, 20)
    assert f.fingerprints().tolist() == values.tolist()
    probe = np.array(asked + stored, np.uint64)
    assert f.contains(probe).tolist() == [int(x) in set(stored) for x in probe]
    other = seen.QuotientFilter(np.unique(np.array(asked, np.uint64)), 20)
    assert f.merge(other).fingerprints().tolist() == sorted(set(stored) | set(asked))


@pytest.mark.parametrize("bits", [12, 56, 63])
def test_quotient_filter_widths(bits):
    values = np.unique(np.random.default_rng(bits).integers(0, 2**bits, 3000, dtype=np.uint64))
    f = seen.QuotientFilter(values, bits)
    assert (f.fingerprints() == values).all() and f.contains(values).all()
    assert f.stored_bytes() < 8 * len(values) + 8192


def test_quotient_filter_memory():
    """Building and merging stay under 12 bytes a key, whatever the size."""
    import tracemalloc

    n = 1_000_000
    values = np.sort(np.random.default_rng(3).integers(0, 2**56, 2 * n, dtype=np.uint64))
    parts = [values[::2], values[1::2]]
    tracemalloc.start()
    halves = [seen.QuotientFilter(p, 56) for p in parts]
    build = tracemalloc.get_traced_memory()[1] / len(values)
    tracemalloc.reset_peak()
    whole = halves[0].merge(halves[1])
    merge = tracemalloc.get_traced_memory()[1] / len(values)
    tracemalloc.stop()
    assert build < 12 and merge < 12, (build, merge)
    assert whole.size == len(np.unique(values)) and whole.contains(values[:1000]).all()
    again = seen.QuotientFilter.from_bytes(whole.to_bytes())
    assert all((a == b).all() for a, b in zip(again.slices(), whole.slices(), strict=True)) and again.contains(values[-1000:]).all()


@given(st.lists(st.integers(0, 30), max_size=200), st.integers(1, 9))
@settings(max_examples=40, deadline=None)
def test_cascade_answers_in_order(keys, step):
    cascade, got = seen.Cascade(16), []
    for i in range(0, len(keys), step):
        got += cascade.seen_then_add(np.array(keys[i : i + step], np.uint64)).tolist()
    assert got == [k in keys[:i] for i, k in enumerate(keys)]


def test_seen_before(spark):
    random.seed(1)
    rows = [(n, random.choice(["hot"] * 5 + [f"k{random.randrange(40)}"] * 5 + [None, ""]), random.choice([None, 1, 2, 3])) for n in range(400)]
    df = spark.createDataFrame(rows, "row_id long, seen string, t long").select("row_id", "seen", F.timestamp_seconds("t").alias("arrived"), F.lit(1).alias("fp"), F.lit(2).alias("shard"))
    order = sorted((t if t is not None else 99, n, k) for n, k, t in rows if k is not None)
    known, expected = set(), {}
    for _, n, k in order:
        expected[n] = k in known
        known.add(k)
    got = seen.seen_before(df.repartition(7), F.col("seen"), "row_id", "arrived")
    assert got.columns == ["row_id", "seen"] and {r[0]: r[1] for r in got.collect()} == expected
    assert seen.seen_before(df.where("false"), F.col("seen"), "row_id", "arrived").count() == 0


def test_seen_with_few_bits_errs_only_one_way(spark):
    df = spark.range(3000).select(F.col("id").alias("read_no"), F.timestamp_seconds("id").alias("loaded_at"), F.concat(F.lit("k"), F.col("id") % 2000).alias("k"))
    report = {r["bits"]: r for r in seen.error_report(df, F.col("k"), [14, 64]).collect()}
    assert report[14]["missed"] == report[64]["missed"] == 0 and report[64]["wrong"] == 0
    assert 0.5 < report[14]["measured_rate"] / report[14]["derived_rate"] < 1.6


def test_store_answers_later_batches(spark, tmp_path):
    random.seed(2)
    keys = [random.choice(["hot"] * 3 + [f"k{random.randrange(60)}" for _ in range(5)]) for _ in range(300)]
    batches = [[(i, keys[i], i) for i in range(low, low + 100)] for low in (0, 100, 200)]
    store, known = str(tmp_path / "store"), set()
    for batch in batches:
        df = spark.createDataFrame(batch, "n long, k string, t long").select("n", "k", F.timestamp_seconds("t").alias("at"))
        got = {r["n"]: r["seen"] for r in seen.ask_store(df, F.col("k"), store, "n", "at", shard_bits=3, most=16).collect()}
        for n, k, _ in batch:
            assert got[n] == (k in known), (n, k)
            known.add(k)
    none = spark.createDataFrame([], "n long, k string, at timestamp")
    assert seen.ask_store(none, F.col("k"), store, "n", "at").count() == 0
    again = spark.createDataFrame([(1, "hot", None), (2, "new", None), (3, None, None)], "n long, k string, at timestamp")
    assert {r["n"]: r["seen"] for r in seen.ask_store(again, F.col("k"), store, "n", "at").collect()} == {1: True, 2: False}


# frequent ------------------------------------------------------------------------


@given(st.lists(st.integers(0, 60), min_size=1, max_size=400), st.integers(1, 50))
@settings(max_examples=60, deadline=None)
def test_sketch_bounds_hold(values, step):
    keys = (np.array(values, np.int64) * 7919) << 20
    sketch = frequent.VoteSketch(3, 4)
    for i in range(0, len(keys), step):
        sketch.add(*np.unique(keys[i : i + step], return_counts=True))
    counts = Counter(keys.tolist())
    asked = np.array(list(counts), np.int64)
    low, high = sketch.bounds(asked)
    assert all(lo <= counts[int(k)] <= hi for k, lo, hi in zip(asked, low, high, strict=True))
    assert sketch.total.sum() == 3 * len(values)
    major = [k for k, n in counts.items() if 2 * n > len(values)]
    assert set(major) <= set(sketch.candidates().tolist())


def test_frequent_values(spark):
    random.seed(3)
    rows = [("big", "hot" if random.random() < 0.3 else f"v{random.randrange(4000)}") for _ in range(9000)]
    rows += [("small", v) for v in ("a", "a", "a", "a", "a", "b", None)] + [(None, "n")] * 5 + [("empty", "")] * 6 + [("nulls", None)] * 9
    df = spark.createDataFrame(rows, "value string, low string").repartition(6)
    got = {(r["grp"], r["value"]): r for r in frequent.frequent_values(df, F.col("low"), F.col("value"), 0.01, 5, depth=4, width=256).collect()}
    sizes, counts = Counter(g for g, _ in rows), Counter(rows)
    assert set(got) == {(g, v) for (g, v), n in counts.items() if v is not None and n >= 5 and n / sizes[g] >= 0.01}
    assert all(r["low"] <= r["rows"] == counts[k] <= r["high"] and r["group_rows"] == sizes[k[0]] for k, r in got.items())
    assert frequent.frequent_values(df.where("false"), F.col("low"), F.col("value"), 0.01).count() == 0
    other = frequent.frequent_values(df, F.col("low"), F.col("value"), 0.01, 5, depth=4, width=256, limit=0).collect()
    assert {(r["grp"], r["value"]): r["rows"] for r in other} == {k: r["rows"] for k, r in got.items()}


def test_cells_merge_by_cancelling(spark):
    """Cells of many partitions merge to bounds that hold for every value."""
    random.seed(5)
    values = [random.choice("ab" * 30 + "cdefghijkl") for _ in range(4000)]
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(9)
    got = frequent.frequent_bounds(df, F.col("v"), F.lit("g"), 0.001, depth=2, width=4).collect()
    counts = Counter(values)
    assert {"a", "b"} & {r["value"] for r in got}
    assert all(r["low"] <= counts[r["value"]] <= r["high"] and r["rows"] == counts[r["value"]] and r["group_rows"] == 4000 for r in got)


def test_sketch_memory_is_bounded(spark):
    """More groups than are kept in memory at once."""
    df = spark.range(2000).select((F.col("id") % 50).cast("string").alias("g"), (F.col("id") % 100).cast("string").alias("v"))
    got = frequent.frequent_values(df, F.col("v"), F.col("g"), 0.5, 1, depth=2, width=16, groups_in_memory=3)
    assert got.count() == 100


# near-duplicates ---------------------------------------------------------------------


def jaccard(a, b, k):
    x, y = ({s[i : i + k] for i in range(len(s) - k + 1)} for s in (a, b))
    return len(x & y) / len(x | y)


def near_rows():
    random.seed(7)
    rows, n = [], 0
    for _ in range(25):
        seq = "".join(random.choices("ACGT", k=random.randrange(60, 140)))
        qual = "".join(chr(35 + random.randrange(40)) for _ in seq)
        for _ in range(random.randrange(1, 5)):
            s, q = list(seq), list(qual)
            for _ in range(random.randrange(0, 4)):
                i = random.randrange(len(s))
                s[i], q[i] = random.choice("ACGT"), "#"
            rows.append((n, "".join(s), "".join(q)))
            n += 1
    rows += [(n, rows[0][1], rows[0][2]), (n + 1, rows[0][1], rows[0][2]), (n + 2, None, "IIII"), (n + 3, "ACGTACGT", None), (n + 4, "", ""), (n + 5, "ACG", "III"), (n + 6, "A" * 5000, "I" * 5000), (n + 7, "A" * 300, "I" * 300)]
    return rows


def test_similar_pairs_and_groups(spark):
    rows = near_rows()
    df = spark.createDataFrame(rows, "id long, one string, two string").repartition(3)
    good = [(n, s, q) for n, s, q in rows if s and q and len(s) >= 8 and len(q) >= 4]
    expected = {(a[0], b[0]) for i, a in enumerate(good) for b in good[i + 1 :] if jaccard(a[1], b[1], 8) >= 0.5 and jaccard(a[2], b[2], 4) >= 0.5}
    got = [tuple(r) for r in neardup.similar_pairs(df, F.col("one"), F.col("two"), "id").collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    parent = {n: n for n, _, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in sorted(expected):
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    groups = neardup.similar_groups(df, F.col("one"), F.col("two"), "id").collect()
    assert {r["id"]: r["group_id"] for r in groups} == {n: root(n) for n in parent} and len(groups) == len(rows)
    assert neardup.similar_pairs(df.where("false"), F.col("one"), F.col("two"), "id").count() == 0


def test_buckets_are_paired_whole():
    """Small buckets pair directly, large ones in blocks; ranges may cross batches."""
    import pyarrow as pa

    from strandloom.llm import blobs

    n = 700
    bands, ids = np.array([3, 3, 4] + [5] * n + [6], np.uint64), np.array([7, 9, 1] + list(range(n)) + [1], np.uint64)
    rows = [(0, len(k), blobs.sorted_planes(k), blobs.planes(i)) for k, i in ((bands[:300], ids[:300]), (bands[300:], ids[300:]))]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("range", "n", "keys", "ids"), r, strict=True))]) for r in rows]
    small = [tuple(r.values()) for out in neardup._small_buckets(iter(batches)) for r in out.to_pylist()]
    assert small == [(7, 9)]
    got = set()
    for out in neardup._large_buckets(iter(batches)):
        for left, right in zip(*(c.to_pylist() for c in out.columns), strict=True):
            got |= {(x, y) for x in left for y in right if x < y}
    assert got == {(i, j) for i in range(n) for j in range(i + 1, n)}


@given(st.lists(st.integers(0, 2**64 - 1), max_size=60))
@settings(max_examples=40, deadline=None)
def test_planes_round_trip(values):
    from strandloom.llm import blobs

    v = np.array(values, np.uint64)
    assert (blobs.unplanes(blobs.planes(v), len(v)) == v).all()
    v.sort()
    assert (blobs.unsorted_planes(blobs.sorted_planes(v), len(v)) == v).all()


def test_classes_of_one_short_id_are_compared(spark, monkeypatch):
    """With ids of 2 bits almost all classes share theirs; no link is lost and none is made up."""
    rows = near_rows()
    df = spark.createDataFrame(rows, "id long, one string, two string")
    want = {tuple(r) for r in neardup.similar_pairs(df, F.col("one"), F.col("two"), "id").collect()}
    monkeypatch.setattr(neardup, "SPARE_BITS", -4)
    got = [tuple(r) for r in neardup.similar_pairs(df, F.col("one"), F.col("two"), "id").collect()]
    assert want <= set(got) and len(got) == len(set(got))
    assert all(jaccard(rows[a][1], rows[b][1], 8) >= 0.5 and jaccard(rows[a][2], rows[b][2], 4) >= 0.5 for a, b in got)


def test_signature_estimate_is_unbiased(spark):
    """Lane counts corrected for chance agreement estimate the similarity."""
    plan = neardup.Plan(bands=128)
    random.seed(9)
    base = "".join(random.choices("ACGT", k=400))
    edited = "".join(c if random.random() > 0.03 else random.choice("ACGT") for c in base)
    import pyarrow as pa

    m = neardup.minima(pa.array([base, edited]), 8, plan.multipliers[:128], plan.offsets[:128])
    equal = ((m[0] & 15) == (m[1] & 15)).mean()
    estimate = (equal - 1 / 16) / (15 / 16)
    assert abs(estimate - jaccard(base, edited, 8)) < 4 * math.sqrt(0.25 / 128)


# spans ---------------------------------------------------------------------------------


def span_rows():
    random.seed(8)
    letters = lambda n: "".join(random.choices("ACGT", k=n))
    common, rows = letters(130), []
    for n in range(40):
        at = random.randrange(0, 60)
        rows.append((n, letters(random.randrange(0, 50)) + common[at : at + random.randrange(20, 70)] + letters(random.randrange(0, 50))))
    rows += [(n, rows[3][1]) for n in (100, 101)] + [(102, None), (103, ""), (104, "ACGT"), (105, "N" * 80), (106, common[:60] + "N" + common[60:]), (107, common.lower()), (108, "A" * 200), (109, "A" * 90)]
    return rows


def brute_spans(rows, k):
    where = {}
    for _, s in rows:
        s = (s or "").upper()
        for i in range(len(s) - k + 1):
            if set(s[i : i + k]) <= set("ACGT"):
                where.setdefault(s[i : i + k], set()).add(s)
    out = set()
    for n, s in rows:
        s = (s or "").upper()
        covered = set()
        for i in range(len(s) - k + 1):
            if len(where.get(s[i : i + k], ())) > 1:
                covered |= set(range(i, i + k))
        for c in sorted(covered):
            if c - 1 not in covered:
                stop = c
                while stop in covered:
                    stop += 1
                out.add((n, c, stop))
    return out


@pytest.mark.parametrize("k", [24, 30, 48])
def test_shared_spans(spark, k):
    rows = span_rows()
    df = spark.createDataFrame(rows, "id long, at string").repartition(3)
    got = [tuple(r) for r in spans.shared_spans(df, F.col("at"), "id", k).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_spans(rows, k)
    report = {r["id"]: r["shared"] for r in spans.shared_report(df, F.col("at"), "id", k).collect()}
    assert report == {n: sum(e - b for m, b, e in brute_spans(rows, k) if m == n) for n, _ in rows}


def test_spans_do_not_depend_on_routes(spark, monkeypatch):
    """Every anchor hot, chunks of a few records, and hashes that collide: the same spans."""
    rows = span_rows()
    df = spark.createDataFrame(rows, "id long, s string").repartition(3)
    want, removed = brute_spans(rows, 30), sorted(map(tuple, spans.removable_spans(df, F.col("s"), "id", 30).collect()))
    every = spans._rows(df, F.col("s"), "id", 30).select("text").mapInArrow(spans._emit_anchors(30), "anchor long").distinct().collect()
    monkeypatch.setattr(spans, "hot_anchors", lambda *_: np.array(sorted(r[0] for r in every), np.int64))
    assert {tuple(r) for r in spans.shared_spans(df, F.col("s"), "id", 30).collect()} == want
    assert sorted(map(tuple, spans.removable_spans(df, F.col("s"), "id", 30).collect())) == removed


def test_ranks_are_exact(monkeypatch):
    columns = [np.array(c, np.uint64) for c in ([1, 2, 1, 2, 1], [5, 5, 5, 6, 7])]
    for mixer in (spans._avalanche, lambda x: x & np.uint64(1)):  # the second makes hashes collide
        monkeypatch.setattr(spans, "_avalanche", mixer)
        got = spans._ranks(columns)
        assert (got[0] == got[2]) and len(set(got.tolist())) == 4
    assert len(spans._ranks([np.zeros(0, np.uint64)])) == 0


def test_span_offsets_count_letters(spark):
    common = "ACGTTGCAAGCTTAGCATCGATCGGATTCA"
    rows = [(0, "äöü€" + common), (1, common + "ß"), (2, "日本" + common + "é")]
    df = spark.createDataFrame(rows, "id long, s string")
    got = {tuple(r) for r in spans.shared_spans(df, F.col("s"), "id", 30).collect()}
    assert got == {(0, 4, 34), (1, 0, 30), (2, 2, 32)}


def test_long_texts_have_the_same_spans(spark):
    random.seed(5)
    common = "".join(random.choices("ACGT", k=3000))
    rows = [(0, "".join(random.choices("ACGT", k=(1 << 20) - 1000)) + common), (1, common + "".join(random.choices("ACGT", k=50)))]
    got = {tuple(r) for r in spans.shared_spans(spark.createDataFrame(rows, "id long, s string"), F.col("s"), "id", 48).collect()}
    n = len(rows[0][1])
    assert got == {(0, n - 3000, n), (1, 0, 3000)} or got == {(0, n - 3000, n), (1, 0, 3000)}


def test_removal_keeps_one_occurrence(spark):
    rows = span_rows()
    df = spark.createDataFrame(rows, "id long, s string")
    removed = {}
    for n, b, e in spans.removable_spans(df, F.col("s"), "id", 30).collect():
        removed.setdefault(n, set()).update(range(b, e))
    shared = {n for n, _, _ in brute_spans(rows, 30)}
    assert set(removed) <= shared
    kept = {}
    for n, s in rows:
        for i in range(len(s or "") - 29):
            w = s[i : i + 30].upper()
            if set(w) <= set("ACGT") and not (set(range(i, i + 30)) <= removed.get(n, set())):
                kept.setdefault(w, []).append((n, i))
    every = {s[i : i + 30].upper() for _, s in rows for i in range(len(s or "") - 29) if set(s[i : i + 30].upper()) <= set("ACGT")}
    assert set(kept) == every  # each window survives somewhere


# pieces -----------------------------------------------------------------------------------


def test_segments_need_every_piece(spark):
    """A piece that is missing shows in the segments that are put together from the pieces."""
    df = spark.createDataFrame([("k", "A" * 250 + "N" * 12 + "C" * 30)], "key string, text string")
    parts = pieces.stretches(df, F.col("key"), F.col("text"))
    cuts = pieces.pieces(parts, 100, 10)
    whole = {tuple(r) for r in pieces.stretches_of_pieces(parts, cuts).collect()}
    assert whole == {("k", 0, 250), ("k", 262, 292)}
    for n in range(cuts.count()):
        assert {tuple(r) for r in pieces.stretches_of_pieces(parts, cuts.where(F.col("piece") != n)).collect()} != whole


def test_pieces(spark):
    random.seed(6)
    rows = []
    for n in range(30):
        text = ""
        for _ in range(random.randrange(1, 9)):
            text += "".join(random.choices("ACGTn", k=random.randrange(0, 260))) + random.choice(["", "N" * 5, "N" * 10, "n" * 23])
        rows.append((f"k{n}", text))
    rows += [("empty", ""), ("null", None), ("only", "N" * 500), ("long", "ACGT" * 1000), ("exact", "A" * 100)]
    df = spark.createDataFrame(rows, "key string, piece string")
    parts = pieces.stretches(df, F.col("key"), F.col("piece"))
    expected = {}
    for k, t in rows:
        at = 0
        for m in re.finditer("[Nn]{10,}|$", t or ""):
            if m.start() > at:
                expected.setdefault(k, []).append((at, m.start()))
            at = m.end()
    got = {}
    for r in parts.collect():
        got.setdefault(r["key"], []).append((r["stretch_start"], r["stretch_end"]))
    assert {k: sorted(v) for k, v in got.items()} == expected
    for limit, overlap in ((100, 20), (100, 0), (7, 3)):
        cuts = pieces.pieces(parts, limit, overlap).collect()
        mine = {}
        for r in sorted(cuts, key=lambda r: (r["key"], r["piece"])):
            mine.setdefault(r["key"], []).append((r["piece_start"], r["piece_end"], r["natural"]))
        for k, stretches in expected.items():  # the greedy walk, one piece after the other
            walk, start = [], stretches[0][0]
            while True:
                reach = [i for i, (_, e) in enumerate(stretches) if start < e <= start + limit]
                if reach:
                    stop, follow = stretches[reach[-1]][1], reach[-1] + 1
                    walk.append((start, stop, True))
                    if follow == len(stretches):
                        break
                    start = stretches[follow][0]
                else:
                    walk.append((start, start + limit, False))
                    start += limit - overlap
            assert mine[k] == walk
        assert set(mine) == set(expected)
        back = pieces.stretches_of_pieces(parts, spark.createDataFrame(cuts)).collect()
        assert {(r[0], r[1], r[2]) for r in back} == {(k, b, e) for k, v in expected.items() for b, e in v}
    assert pieces.split_texts(df.where("false"), F.col("key"), F.col("piece")).count() == 0


# packing and mixing ---------------------------------------------------------------------------

needs_vocabulary = pytest.mark.skipif(not Path(queries.VOCABULARY[1]).exists(), reason="no vocabulary here")


@needs_vocabulary
def test_token_counts(spark):
    texts = ["hello world", "", None, "a  b\n\nc", "naïve 123", "word " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "n_tokens long, text string")
    coder = tokens.encoder(queries.VOCABULARY[1])
    expected = {i: len(coder.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    for portion in (1 << 20, 50):
        got = tokens.token_counts(df, F.col("text"), [F.col("n_tokens").alias("id")], queries.VOCABULARY[1], portion=portion).collect()
        assert {r["id"]: r["n_tokens"] for r in got} == expected


def test_price_finds_the_best_pack():
    rng = np.random.default_rng(0)
    for _ in range(20):
        sizes = np.unique(rng.integers(1, 12, 4))[::-1].astype(np.int64)
        weights = rng.integers(1, 1000, len(sizes))
        counts = packing.price(weights, sizes, 15)
        best = np.zeros(16)
        for room in range(1, 16):
            best[room] = max([best[room - 1], *(best[room - s] + w for s, w in zip(sizes, weights, strict=True) if s <= room)])
        assert counts @ sizes <= 15 and counts @ weights == best[15]


def test_program_beats_best_fit():
    """Where the largest item that fits is the wrong one, weights find the packs that best-fit misses."""
    histogram = {51: 2000, 27: 2000, 26: 2000, 23: 4000}
    packs, figures = packing.plan_packs(histogram, 100)
    plain = sum(n for _, n in packing._best_fit(histogram, 100))
    assert figures["bound"] == 3000 and figures["packs"] <= 3030 and plain > 3600 and figures["by_program"] > 0.9 * figures["packs"]


def test_program_is_quick_and_near_its_bound():
    import time

    rng = np.random.default_rng(4)
    sizes, n = np.unique(np.minimum(1024, np.maximum(1, rng.lognormal(4.5, 1.0, 300_000))).astype(int), return_counts=True)
    began = time.process_time()
    packs, figures = packing.plan_packs({int(s): int(k) * 1000 for s, k in zip(sizes, n, strict=True)}, 1024)
    assert time.process_time() - began < 10
    assert figures["bound"] <= figures["packs"] <= 1.0005 * figures["bound"] and figures["by_program"] > 0.2 * figures["packs"]


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), min_size=1, max_size=25))
@settings(max_examples=25, deadline=None)
def test_plan_places_every_item_once(histogram):
    packs, _ = packing.plan_packs(histogram, 64, rounds=60)
    placed = Counter()
    for counts, times in packs:
        assert sum(s * c for s, c in counts.items()) <= 64 and times > 0
        for s, c in counts.items():
            placed[s] += c * times
    assert placed == Counter(histogram)
    assert sum(n for _, n in packs) <= math.ceil(sum(s * n for s, n in histogram.items()) / 64 * 1.8) + 1


def test_packs(spark):
    random.seed(2)
    sizes = {n: random.choice([0, 1, 7, 30, 64, 65, 200]) for n in range(300)}
    df = spark.createDataFrame(list(sizes.items()) + [(900, None)], "doc_id long, n_tokens long")
    rows = packing.pack(df, {1: 64, 2: 100}, rounds=60, buckets=8).collect()
    for pack_id, capacity in ((1, 64), (2, 100)):
        mine = [r for r in rows if r["pack_id"] == pack_id]
        filled, parts = Counter(), Counter()
        for r in mine:
            filled[r["pack_no"]] += r["tok_end"] - r["tok_start"]
            parts[r["doc_id"]] += r["tok_end"] - r["tok_start"]
            assert sizes[r["doc_id"]] > capacity or (r["tok_start"], r["tok_end"]) == (0, sizes[r["doc_id"]])
        assert parts == Counter({n: s for n, s in sizes.items() if s})
        assert max(filled.values()) <= capacity and set(filled) == set(range(len(filled)))
        histogram = Counter(r["tok_end"] - r["tok_start"] for r in mine)
        assert len(filled) <= sum(n for _, n in packing._best_fit(dict(histogram), capacity)) + 1
    assert packing.pack(df.where("false"), {1: 64}).count() == 0


def test_schedules_are_shares_at_every_time():
    shares, knots = np.array([0.6, 0.3, 0.1]), np.array([0.0, 0.3, 0.7, 1.0])
    table = mixing.fit_schedules(shares, np.array([[1, 1, 1, 1], [1, 1, 1, 4], [0, 0, 0, 0]], float), knots)
    assert np.allclose(table.sum(0), 1) and np.allclose(((table[:, 1:] + table[:, :-1]) / 2 * np.diff(knots)).sum(1), shares)
    assert table[1, 3] > 2 * table[1, 0]


def test_due_time_inverts_the_schedule(spark):
    knots, w = [0.0, 0.25, 0.5, 1.0], [0.4, 0.0, 0.3, 0.9]
    upto = [0.0, 0.05, 0.0875, 0.3875]
    times = [t / 40 for t in range(41)]
    integral = lambda t: next(upto[k] + w[k] * (t - knots[k]) + (w[k + 1] - w[k]) * (t - knots[k]) ** 2 / 2 / (knots[k + 1] - knots[k]) for k in range(3) if t <= knots[k + 1])
    df = spark.createDataFrame([(t, integral(t)) for t in times], "t double, done double")
    got = df.select("t", mixing.due_time(F.col("done"), knots, list(map(F.lit, w)), list(map(F.lit, upto)))).collect()
    assert all(abs(r[0] - r[1]) < 1e-6 for r in got)


def test_mix(spark):
    random.seed(4)
    docs = [(n, random.choice(["a"] * 6 + ["b"] * 2 + ["c"]), random.randrange(1, 50)) for n in range(2000)]
    docs += [(5000, None, 9), (5001, "a", 0), (5002, "a", None), (5003, "unasked", 7)]
    df = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3)], "source string, target_share double, max_repeats int")
    schedules = spark.createDataFrame([("a", 0.0, 3.0), ("a", 0.5, 2.0), ("a", 1.0, 1.0), ("c", 0.0, 1.0), ("c", 1.0, 3.0)], "source string, at double, weight double")
    draws = mixing.mix(df, targets, schedules, buckets=4).cache()
    rows = draws.collect()
    repeats = Counter((r["doc_id"], r["repeat_no"]) for r in rows)
    assert max(repeats.values()) == 1 and all(r["repeat_no"] <= {"a": 1, "b": 2, "c": 3}[r["source"]] for r in rows)
    for r in mixing.shares(draws, targets).collect():
        assert abs(r["share"] - r["target_share"]) < 0.005
    have = Counter()
    for _, s, n in docs:
        have[s] += n or 0
    total = min(have["a"] / 0.5, 2 * have["b"] / 0.3, 3 * have["c"] / 0.2)
    assert abs(sum(r["n_tokens"] for r in rows) / total - 1) < 0.01
    early = [r for r in rows if r["due"] < 0.5]
    assert sum(r["n_tokens"] for r in early if r["source"] == "a") > sum(r["n_tokens"] for r in rows if r["source"] == "a") * 0.58
    order = [r["due"] for r in mixing.in_training_order(draws).collect()]
    assert order == sorted(order) and 0 <= order[0] and order[-1] <= 1
    at = 0
    for r in sorted(rows, key=lambda r: (r["due"], r["doc_id"], r["repeat_no"])):
        assert r["token_start"] == at
        at += r["n_tokens"]
    parts = mixing.slices(draws, df, targets, schedules, 5).collect()
    assert len(parts) == 15 and all(abs(r["share"] - r["scheduled"]) < 0.02 for r in parts), parts
    small = mixing.mix(df, targets, budget=1000).agg(F.sum("n_tokens")).first()[0]
    assert abs(small - 1000) < 80
    assert mixing.mix(df.where("false"), targets).count() == 0


def test_mix_with_absent_and_tiny_sources(spark):
    docs = [(n, s, 10) for n, s in enumerate(["a"] * 600 + ["b"] * 900 + ["tiny"] * 2)]
    df = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    rows = [("a", 0.5, 1), ("b", 0.35, 1), ("tiny", 0.05, 3), ("absent", 0.1, 4)]
    targets = spark.createDataFrame(rows, "source string, target_share double, max_repeats int")
    got = {r["source"]: r for r in mixing.shares(mixing.mix(df, targets), targets).collect()}
    assert {s: r["tokens"] for s, r in got.items()} == {"a": 6000, "b": 4200, "tiny": 60, "absent": 0}
    assert got["tiny"]["most_repeats"] == 3 and got["absent"]["shortfall"] == 0.1 and got["a"]["shortfall"] == 0
    assert abs(got["tiny"]["shortfall"] - (0.05 - 60 / 10260)) < 1e-9
    small = {r["source"]: r["tokens"] for r in mixing.shares(mixing.mix(df, targets, budget=5160), targets).collect()}
    assert small == {"a": 3000, "b": 2100, "tiny": 60, "absent": 0}
    held = mixing.mix(df, targets, short_share=0).groupBy("source").agg(F.sum("n_tokens")).collect()
    assert {r[0]: r[1] for r in held} == {"a": 600, "b": 420, "tiny": 60}


# truncation ----------------------------------------------------------------------------------


def test_cut_texts_are_found(spark):
    random.seed(12)
    nouns, verbs = ["river", "tower", "market", "garden", "harbour", "valley"], ["was built", "was sold", "lies", "remains", "was moved"]
    sentence = lambda: f"The {random.choice(nouns)} of {random.choice('XYZ')}{random.choice('abc')}or {random.choice(verbs)} in the {random.choice(nouns)} {random.randrange(1000, 2000)}."
    rows, cut = [], set()
    for n in range(600):
        text = " ".join(sentence() for _ in range(random.randrange(4, 12)))
        if n % 20 == 0:
            text = text[: len(text) - random.randrange(8, 25)] + random.choice(["", " ", "…", " ..."])
            cut.add(n)
        rows.append((n, text, "s" if n % 2 else None))
    rows += [(1000, None, "s"), (1001, "", "s"), (1002, "  \n ", None), (1003, rows[1][1] + " " * 900, "s"), (1004, "x" * 100_000, "s"), (1005, "'", "s")]
    df = spark.createDataFrame(rows, "row_id long, tokens string, source string")
    got = {r["row_id"]: r["truncated"] for r in truncated.truncated_texts(df, "row_id", "tokens").collect()}
    assert len(got) == len(rows) and not any(got[n] for n in (1000, 1001, 1002, 1003))
    found = {n for n, t in got.items() if t and n < 1000}
    assert len(found & cut) >= 0.9 * len(cut) and len(found - cut) <= 6
    rates = {r["source"]: r for r in truncated.truncation_rates(df, "source", "row_id", "tokens").collect()}
    assert sum(r["texts"] for r in rates.values()) == len(rows) and rates[None]["truncated"] >= 0.9 * sum(n % 2 == 0 for n in cut) - 1
    assert truncated.truncated_texts(df.where("false"), "row_id", "tokens").count() == 0


def test_only_blanks_and_marks_are_trimmed(spark):
    texts = {"barn": "barn", "next \n\n": "next", "or\t\r": "or", "cut…\n": "cut", "cut...": "cut", "cut [...] ": "cut", "half��": "half", "end.": "end.", "a\\": "a\\", " \n": ""}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r[0]: r[1] for r in df.selectExpr("t", truncated._trimmed("t")).collect()} == texts


def test_registered():
    from strandloom.llm import queries

    assert {f"p{n}_found" for n in (1, 2, 3, 5, 6, 10)} <= set(queries.QUERIES) and set(queries.ORACLES) <= set(queries.QUERIES)
