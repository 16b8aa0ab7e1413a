"""Near-duplicate records over two fields with b-bit MinHash.

For each field the distinct letter windows are min-hashed.  A band joins one
minimum of the first field with two of the second; records that agree on a band
become a candidate pair.  Of every minimum only the low ``b`` bits are kept and
packed into longs: counting equal lanes of two packed signatures and correcting
for chance agreement estimates the similarity, and pairs whose estimate lies
more than ``margin`` standard deviations under the threshold are dropped.  An
exact comparison of the windows decides about the rest.

Records of equal content are one class from the start, known by 128 bits of
hash: the search runs over classes, and copies are expanded only where a result
of row pairs is asked for.  Bands travel packed (see :mod:`blobs`) with as many
bits of a class's hash as the number of rows asks for, so a short id may stand
for several classes: texts that are met by short id bring their whole class, and
classes that share a short id are candidates of each other.  Signatures and
texts are shuffled once each, by short id; nothing is broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.blobs import by_range, chunks, planes, range_bits, sorted_planes, unplanes, unsorted_planes
from strandloom.operators.graph import components
from strandloom.session import cut

_ROWS = 1024  # records hashed at once, so that the work stays in the cache


@dataclass(frozen=True)
class Plan:
    """Parameters of the search.  At similarity s in the first and t in the
    second field a pair is found with probability 1 - (1 - s t^2)^bands."""

    sizes: tuple[int, int] = (8, 4)
    threshold: float = 0.5
    bands: int = 32
    lane_bits: int = 4
    margin: float = 4.0
    key_bits: int = 36
    seed: int = 7
    multipliers: np.ndarray = field(init=False, repr=False, compare=False)
    offsets: np.ndarray = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        random = np.random.default_rng(self.seed)
        n = 3 * self.bands
        object.__setattr__(self, "multipliers", random.integers(1 << 16, 1 << 32, n, dtype=np.uint32) | np.uint32(1))
        object.__setattr__(self, "offsets", random.integers(0, 1 << 32, n, dtype=np.uint32))

    @property
    def counts(self) -> tuple[int, int]:
        return self.bands, 2 * self.bands

    def least_equal(self, part: int) -> int:
        """Equal lanes below which a signature is too far under the threshold."""
        n, chance = self.counts[part], 2.0**-self.lane_bits
        p = chance + (1 - chance) * self.threshold
        return max(0, math.floor(n * p - self.margin * math.sqrt(n * p * (1 - p))))


def _strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without nulls."""
    if column.type != pa.string():
        column = column.cast(pa.string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit avalanche, upper half."""
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


def minima(column: pa.Array, size: int, multipliers: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(records, hashes) uint32: minima over the windows of ``size`` bytes.

    Every record has at least ``size`` bytes; ``size`` is 8 or 4, so that a
    window is one machine word.
    """
    out = np.empty((len(column), len(multipliers)), np.uint32)
    for low in range(0, len(column), _ROWS):
        raw, at = _strings(column.slice(low, _ROWS))
        raw = np.ascontiguousarray(raw)
        word = np.ndarray((len(raw) - size + 1,), f"<u{size}", raw, 0, (1,)).astype(np.uint64)
        base = _mix(word)
        starts, stops = at[:-1], at[1:] - size + 1
        # Windows across two records repeat the first window of the record they begin in.
        n = len(base)
        outside = np.zeros(n + 1, np.int32)
        np.add.at(outside, np.minimum(stops, n), 1)
        np.add.at(outside, np.minimum(at[1:], n), -1)
        cross = np.flatnonzero(np.cumsum(outside[:-1]) > 0)
        base[cross] = base[starts[np.searchsorted(starts, cross, side="right") - 1]]
        for i, (a, b) in enumerate(zip(multipliers, offsets, strict=True)):
            out[low : low + len(starts), i] = np.minimum.reduceat((base ^ b) * a, starts)
    return out


def _lanes(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """The low ``bits`` bits of each column, packed into longs."""
    per = 64 // bits
    low = values.astype(np.uint64) & np.uint64((1 << bits) - 1)
    out = []
    for start in range(0, values.shape[1], per):
        word = np.zeros(len(values), np.uint64)
        for j, lane in enumerate(low[:, start : start + per].T):
            word |= lane << np.uint64(j * bits)
        out.append(word.view(np.int64))
    return out


#: Bits of a short id beyond those that the number of rows has: one class in 2**SPARE_BITS shares its id.
SPARE_BITS = 13


def id_bits(rows: int) -> int:
    return min(62, max(1, math.ceil(math.log2(max(2, rows))) + SPARE_BITS))


class Fresh:
    """Drops rows whose class, the first two columns, was met in this task before."""

    def __init__(self):
        self.met: set[bytes] = set()

    def __call__(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        both = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
        names = both.view("V16").ravel().tolist()
        keep = np.empty(len(names), bool)
        for i, name in enumerate(names):
            keep[i] = name not in self.met
            self.met.add(name)
        return batch if keep.all() else batch.filter(pa.array(keep))


def _emit_bands(plan: Plan, bits: int, short: int, least: int = 16 << 20):
    """A row for each range of band keys and chunk of records: keys by their differences, and short ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, fresh = plan.bands, Fresh()
        whole = plan.key_bits + (n - 1).bit_length()  # bits of a key with its band
        for batch in chunks(map(fresh, batches), least):
            one = minima(batch.column(2), plan.sizes[0], plan.multipliers[:n], plan.offsets[:n]).astype(np.uint64)
            two = minima(batch.column(3), plan.sizes[1], plan.multipliers[n:], plan.offsets[n:]).astype(np.uint64)
            key = one << np.uint64(32) | two[:, 0::2]
            key = (key ^ (key >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            key ^= two[:, 1::2] * np.uint64(0xC2B2AE3D27D4EB4F) + np.arange(n, dtype=np.uint64)
            key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            # The hash is on top, so that ranges are of equal size; the band below it.
            key = (key >> np.uint64(64 - plan.key_bits)) << np.uint64(whole - plan.key_bits) | np.arange(n, dtype=np.uint64)
            ids = np.repeat(batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - short), n)
            key = key.ravel()
            order = np.argsort(key)
            key, ids = key[order], ids[order]
            cuts = np.searchsorted(key, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(whole - bits))
            bounds = list(zip(np.append(0, cuts).tolist(), np.append(cuts, len(key)).tolist(), strict=True))
            used = [(r, a, b) for r, (a, b) in enumerate(bounds) if a < b]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r for r, _, _ in used], pa.int32()),
                    pa.array([b - a for _, a, b in used], pa.int32()),
                    pa.array([sorted_planes(key[a:b]) for _, a, b in used], pa.binary()),
                    pa.array([planes(ids[a:b]) for _, a, b in used], pa.binary()),
                ],
                ["range", "n", "keys", "ids"],
            )

    return run


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, starts, sizes) of the bands of each range that several short ids share."""
    for _, rows in by_range(batches):
        band = np.concatenate([unsorted_planes(keys, n) for n, keys, _ in rows])
        ids = np.concatenate([unplanes(ids, n) for n, _, ids in rows]).view(np.int64)
        order = np.lexsort((ids, band))
        band, ids = band[order], ids[order]
        fresh = np.append(True, (band[1:] != band[:-1]) | (ids[1:] != ids[:-1]))
        band, ids = band[fresh], ids[fresh]
        starts = np.append(0, np.flatnonzero(band[1:] != band[:-1]) + 1)
        sizes = np.diff(np.append(starts, len(band)))
        yield ids, starts[sizes > 1], sizes[sizes > 1]


#: Ids of a bucket from which on its pairs are made in blocks, by all tasks.
BLOCK = 256


def _small_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (``a``, ``b``) of buckets of up to BLOCK ids."""
    for ids, starts, sizes in _buckets(batches):
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        starts, sizes = starts[sizes <= BLOCK], sizes[sizes <= BLOCK]
        for step in range(1, int(sizes.max(initial=0))):
            starts, sizes = starts[sizes > step], sizes[sizes > step]
            n = sizes - step
            at = np.repeat(starts - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
            left.append(ids[at])
            right.append(ids[at + step])
        pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], axis=1), axis=0) if len(left) > 1 else np.zeros((0, 2), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _large_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of two blocks of ids, ``left`` and ``right``, of buckets of more than BLOCK ids."""
    kind = pa.list_(pa.int64())
    for ids, starts, sizes in _buckets(batches):
        for s, n in zip(starts[sizes > BLOCK], sizes[sizes > BLOCK], strict=True):
            cuts = [ids[i : i + BLOCK] for i in range(s, s + n, BLOCK)]
            cuts[-1] = cuts[-1][: s + n - (s + (len(cuts) - 1) * BLOCK)]
            for i, x in enumerate(cuts):
                yield pa.RecordBatch.from_arrays([pa.array(cuts[: i + 1], kind), pa.array([x] * (i + 1), kind)], ["left", "right"])


def _emit_signatures(plan: Plan):
    """Class and packed signature, each class once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, fresh = plan.bands, Fresh()
        for batch in map(fresh, batches):
            if batch.num_rows:
                lanes = [
                    lane
                    for f, s in ((0, slice(0, n)), (1, slice(n, None)))
                    for lane in _lanes(minima(batch.column(2 + f), plan.sizes[f], plan.multipliers[s], plan.offsets[s]), plan.lane_bits)
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, lanes)], ["h", *_lane_names(plan)])

    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each class once a task."""
    yield from map(Fresh(), batches)


def _lane_names(plan: Plan) -> list[str]:
    return [f"s{f}_{i}" for f in (0, 1) for i in range(-(-plan.counts[f] * plan.lane_bits // 64))]


def _equal_lanes(plan: Plan, part: int, a: str, b: str) -> Column:
    """Lanes of one field in which two packed signatures agree."""
    mask = sum(1 << i for i in range(0, 64, plan.lane_bits))
    mask -= (mask >> 63) << 64
    names = [n for n in _lane_names(plan) if n.startswith(f"s{part}_")]
    total = F.lit(plan.counts[part])  # lanes that fill up the last long are equal in both
    for name in names:
        x = F.col(a + name).bitwiseXOR(F.col(b + name))
        step = 1
        while step < plan.lane_bits:
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
            step *= 2
        total = total - F.bit_count(x.bitwiseAND(F.lit(mask)))
    return total


def _windows(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, window) of the distinct windows of each string, sorted; a window is one machine word."""
    raw, at = _strings(column)
    raw = np.ascontiguousarray(raw)
    word = np.ndarray((len(raw) - size + 1,), f"<u{size}", raw, 0, (1,)).astype(np.uint64)
    n = np.diff(at) - size + 1
    row = np.repeat(np.arange(len(n)), n)
    word = word[np.repeat(at[:-1] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())]
    order = np.lexsort((word, row))
    row, word = row[order], word[order]
    fresh = np.append(True, (row[1:] != row[:-1]) | (word[1:] != word[:-1]))
    return row[fresh], word[fresh]


def jaccard(one: pa.Array, two: pa.Array, size: int) -> np.ndarray:
    """Shared among all distinct windows of ``size`` bytes, row by row; every string has at least one."""
    x, y = _windows(one, size), _windows(two, size)
    row, word = np.concatenate((x[0], y[0])), np.concatenate((x[1], y[1]))
    order = np.lexsort((word, row))
    row, word = row[order], word[order]
    twice = row[1:][(row[1:] == row[:-1]) & (word[1:] == word[:-1])]
    both = np.bincount(twice, minlength=len(one))
    return both / (np.bincount(row, minlength=len(one)) - both)


def _verify(plan: Plan):
    """Candidates that are similar, with their exact similarities in place of their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, _ROWS):
                part = batch.slice(low, _ROWS)
                one, two = (jaccard(part.column(i), part.column(i + 2), plan.sizes[i]) for i in (0, 1))
                done = pa.RecordBatch.from_arrays([*part.columns[4:], pa.array(one), pa.array(two)], [*part.schema.names[4:], "one", "two"])
                yield done.filter(pa.array((one >= plan.threshold) & (two >= plan.threshold)))

    return run


def _classes(df: DataFrame, one: Column, two: Column, row_id: str, plan: Plan) -> DataFrame:
    """Rows that can take part: class (h, g), the two fields, their row id."""
    rows = df.select(F.col(row_id).cast("long").alias("row_id"), one.cast("string").alias("one"), two.cast("string").alias("two"))
    rows = rows.where(
        (F.length("one") >= plan.sizes[0]) & (F.length("two") >= plan.sizes[1]) & F.col("row_id").isNotNull()
    )
    return rows.select(F.xxhash64("one", "two").alias("h"), F.xxhash64(F.lit(1), "two", "one").alias("g"), "one", "two", "row_id")


def class_links(df: DataFrame, one: Column, two: Column, row_id: str = "read_no", plan: Plan | None = None) -> DataFrame:
    """(h_a, g_a, h_b, g_b, est_one, est_two, one, two): classes that resemble each other in both fields.

    A link is listed once.  ``est_*`` are the similarities that the signatures
    estimate, ``one`` and ``two`` the exact ones.
    """
    plan = plan or Plan()
    rows = df.count()
    bits, short = range_bits(df, rows * plan.bands), id_bits(rows)
    texts = _classes(df, one, two, row_id, plan).select("h", "g", "one", "two")
    bands = texts.mapInArrow(_emit_bands(plan, bits, short), "range int, n int, keys binary, ids binary")
    ranges = bands.repartition("range").sortWithinPartitions("range")
    small = ranges.mapInArrow(_small_buckets, "a long, b long")
    blocks = ranges.mapInArrow(_large_buckets, "left array<long>, right array<long>")
    blocks = blocks.repartition(F.xxhash64(F.col("left")[0], F.col("right")[0]))
    large = blocks.select(F.explode("left").alias("a"), "right").select("a", F.explode("right").alias("b")).where("a < b")
    met = small.unionByName(large).repartition("a").dropDuplicates(["a", "b"])

    lanes = _lane_names(plan)
    of = F.shiftrightunsigned("h", 64 - short)
    signed = texts.mapInArrow(_emit_signatures(plan), ", ".join(["h long", *(f"{n} long" for n in lanes)]))
    signed = signed.select(of.alias("id"), *lanes).repartition("id").distinct()
    side = lambda x: signed.select(F.col("id").alias(x), *(F.col(n).alias(f"{x}_{n}") for n in lanes))
    known = met.join(side("a"), "a").join(side("b"), "b")
    equal = [_equal_lanes(plan, f, "a_", "b_") for f in (0, 1)]
    chance = 2.0**-plan.lane_bits
    estimate = [((e / plan.counts[f] - chance) / (1 - chance)).alias(n) for f, e, n in zip((0, 1), equal, ("est_one", "est_two"), strict=True)]
    near = known.where((equal[0] >= plan.least_equal(0)) & (equal[1] >= plan.least_equal(1))).select("a", "b", *estimate)
    near = near.groupBy("a", "b").agg(F.max("est_one").alias("est_one"), F.max("est_two").alias("est_two"))  # classes may share short ids
    hashes = _classes(df, one, two, row_id, plan).select(of.alias("id"), "h", "g").distinct()
    alike = hashes.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("a"), F.col("id").alias("b"))
    near = near.unionByName(alike.select("a", "b", F.lit(None).cast("double").alias("est_one"), F.lit(None).cast("double").alias("est_two")))

    placed = texts.mapInArrow(_once, "h long, g long, one string, two string").withColumn("id", of).repartition("id").dropDuplicates(["id", "h", "g"])
    end = lambda x: placed.select(F.col("id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("h", "g", "one", "two")))
    both = near.join(end("a"), "a").join(end("b"), "b")
    both = both.where((F.col("a") != F.col("b")) | (F.struct("h_a", "g_a") < F.struct("h_b", "g_b")))
    both = both.select("one_a", "two_a", "one_b", "two_b", "h_a", "g_a", "h_b", "g_b", "est_one", "est_two")
    return both.mapInArrow(_verify(plan), "h_a long, g_a long, h_b long, g_b long, est_one double, est_two double, one double, two double")


def similar_pairs(df: DataFrame, one: Column, two: Column, row_id: str = "read_no", plan: Plan | None = None) -> DataFrame:
    """(``row_id``_a, ``row_id``_b): all pairs of rows similar in both fields, copies included.

    Rows with a null field, or a field shorter than its window, are in no pair.
    A pair is listed once, smaller row id first; two rows of equal content are
    similar.  An empty table gives an empty result; repeated row ids make no
    pair with themselves.  Windows are of bytes: where letters take several, so
    do windows.  Only use this where pairs of copies are wanted: their number is
    quadratic in the size of a class; :func:`similar_groups` is not.
    """
    plan = plan or Plan()
    links = class_links(df, one, two, row_id, plan).select("h_a", "g_a", "h_b", "g_b")
    rows = _classes(df, one, two, row_id, plan).select("h", "g", "row_id")
    many = rows.groupBy("h", "g").agg(F.count("*").alias("n")).where("n > 1")
    wanted = links.unionByName(many.select(F.col("h").alias("h_a"), F.col("g").alias("g_a"), F.col("h").alias("h_b"), F.col("g").alias("g_b")))
    end = lambda x: rows.select(F.col("h").alias(f"h_{x}"), F.col("g").alias(f"g_{x}"), F.col("row_id").alias(x))
    pairs = wanted.join(end("a"), ["h_a", "g_a"]).join(end("b"), ["h_b", "g_b"])
    same = (F.col("h_a") == F.col("h_b")) & (F.col("g_a") == F.col("g_b"))
    ordered = pairs.where(~same | (F.col("a") < F.col("b"))).where("a != b")
    return ordered.select(F.least("a", "b").alias(f"{row_id}_a"), F.greatest("a", "b").alias(f"{row_id}_b"))


def similar_groups(df: DataFrame, one: Column, two: Column, row_id: str = "read_no", plan: Plan | None = None) -> DataFrame:
    """One row per record: (``row_id``, ``group_id``, ``copies``, ``links``).

    ``group_id`` is the smallest row id reachable over links between similar
    records; ``copies`` counts the records of equal content, ``links`` the
    different contents that this one is similar to.  Records that cannot take
    part (a null or too short field) are groups of their own without links.
    Row ids must be unique.
    """
    plan = plan or Plan()
    rows = _classes(df, one, two, row_id, plan).select("h", "g", "row_id")
    classes = cut(rows.groupBy("h", "g").agg(F.count("*").alias("copies"), F.min("row_id").alias("first")))
    end = lambda x: classes.select(F.col("h").alias(f"h_{x}"), F.col("g").alias(f"g_{x}"), F.col("first").alias(x))
    links = class_links(df, one, two, row_id, plan).select("h_a", "g_a", "h_b", "g_b")
    links = cut(links.join(end("a"), ["h_a", "g_a"]).join(end("b"), ["h_b", "g_b"]).select("a", "b"))
    label = components(links, "a", "b")
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
    known = label.join(degree, "id").withColumnRenamed("id", "first")  # linked classes only; the smallest row is the label
    known = classes.join(known, "first", "left").select("h", "g", F.coalesce("part", "first").alias("group_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
    able = (F.length("one") >= plan.sizes[0]) & (F.length("two") >= plan.sizes[1])
    everyone = df.select(F.col(row_id).cast("long").alias("row_id"), one.cast("string").alias("one"), two.cast("string").alias("two")).select(
        "row_id", F.when(able, F.xxhash64("one", "two")).alias("h"), F.when(able, F.xxhash64(F.lit(1), "two", "one")).alias("g")
    )
    return everyone.join(known, ["h", "g"], "left").select(
        F.col("row_id").alias(row_id),
        F.coalesce("group_id", "row_id").alias("group_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("copies"),
        F.coalesce("links", F.lit(0)).cast("long").alias("links"),
    )


def estimate_report(df: DataFrame, one: Column, two: Column, row_id: str = "read_no", plan: Plan | None = None) -> DataFrame:
    """(field, links, mean_similarity, mean_estimate, mean_error, worst_error) of the signatures, over all links."""
    links = class_links(df, one, two, row_id, plan)
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("s"), F.col(f"est_{f}").alias("e")) for f in ("one", "two")))
    rows = links.select(F.inline(each))
    error = F.abs(F.col("s") - F.col("e"))
    return rows.groupBy("field").agg(
        F.count("*").alias("links"), F.avg("s").alias("mean_similarity"), F.avg("e").alias("mean_estimate"), F.avg(error).alias("mean_error"), F.max(error).alias("worst_error")
    )
