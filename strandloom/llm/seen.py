"""Has this key been seen before?  A sharded quotient filter.

A key is reduced to a fingerprint of ``bits`` bits.  Its high bits choose a
shard; inside a shard the fingerprint is split into a quotient, which is not
stored, and a remainder, which is.  A :class:`QuotientFilter` holds the sorted
remainders bit-packed next to two bit vectors of run metadata: ``occupied`` has
a bit for each quotient that owns a run, ``run_end`` a bit for each slot that
closes one.  Filters are sorted, so two of them merge in one linear pass; a
shard keeps a few filters of doubling size and never the keys.

Cost and skew.  Repeats inside one Arrow batch are answered before the shuffle,
so a hot key sends one row per batch, not one per occurrence.  The shuffle
carries (fingerprint, arrival, id) only and is sorted outside memory by Spark.
A task holds one shard's filters at a time: about ``distinct keys / shards *
(remainder bits + 2) / 8`` bytes, and while two of them merge the same again.
The number of shards follows from the number of rows.  :func:`ask_store` keeps
the filters in a table, to ask them again with a later batch.

Errors.  Equal keys always collide, so a repeat is never missed.  A new key is
wrongly called seen with probability ``1 - (1 - 2**-bits)**n`` after ``n``
distinct keys; :func:`error_report` states that next to the measured rate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.session import cut

_ONE = np.uint64(1)


_SLICE = 1 << 14  # values packed or unpacked at once


class BitVector:
    """A packed bit vector with a rank directory of 4 bytes for each 64 bits."""

    def __init__(self, words: np.ndarray, size: int):
        self.words, self.size = words, size
        self.before = np.zeros(len(words) + 1, np.uint32)
        np.cumsum(np.bitwise_count(words), out=self.before[1:], dtype=np.uint32)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & _ONE

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        word = self.words[at >> 6] & ((_ONE << (at & 63).astype(np.uint64)) - _ONE)
        return self.before[at >> 6].astype(np.int64) + np.bitwise_count(word)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th set bit, counted from 0; by slices of ``k``."""
        out = np.empty(len(k), np.int64)
        step = _SLICE // 8
        for low in range(0, len(k), step):
            ask = k[low : low + step]
            word = np.searchsorted(self.before, ask, side="right") - 1
            inside = (ask - self.before[word]).astype(np.int64)
            bits = np.unpackbits(self.words[word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            out[low : low + step] = word * 64 + (np.cumsum(bits, axis=1, dtype=np.uint8) == (inside + 1)[:, None]).argmax(1)
        return out


def _pack_block(values: np.ndarray, width: int) -> np.ndarray:
    """64 values of ``width`` bits fill ``width`` words; ``len(values)`` is a multiple of 64."""
    table = values.reshape(-1, 64)
    out = np.zeros((len(table), width), np.uint64)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        out[:, word] |= table[:, j] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= table[:, j] >> np.uint64(64 - shift)
    return out.ravel()


def _unpack(packed: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The values at slots ``at`` of words that end with one word of padding."""
    bit = at.astype(np.int64) * width
    word, shift = bit >> 6, (bit & 63).astype(np.uint64)
    value = packed[word] >> shift
    value |= np.where(shift > 0, packed[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
    return value if width == 64 else value & ((_ONE << np.uint64(width)) - _ONE)


class QuotientFilter:
    """A sorted, immutable set of fingerprints below ``2**bits``.

    It is written from slices of a sorted stream, so that building or merging
    needs no more than the packed words and a few slices.
    """

    def __init__(self, fingerprints: np.ndarray, bits: int):
        """``fingerprints``: sorted, distinct, uint64."""
        self._write((fingerprints[i : i + _SLICE] for i in range(0, len(fingerprints), _SLICE)), len(fingerprints), bits)

    @classmethod
    def of_stream(cls, slices: Iterator[np.ndarray], most: int, bits: int) -> QuotientFilter:
        """From sorted slices that hold at most ``most`` fingerprints."""
        out = cls.__new__(cls)
        out._write(slices, most, bits)
        return out

    def _write(self, slices: Iterator[np.ndarray], most: int, bits: int) -> None:
        self.bits = bits
        self.q = min(bits - 1, max(1, int(most).bit_length()), 30)
        self.r = bits - self.q
        rest = np.uint64(self.r)
        mask = (_ONE << rest) - _ONE
        words = np.zeros((most + 63) // 64 * self.r + 1, np.uint64)
        ends = np.zeros((most + 63) // 64, np.uint64)
        occupied = np.zeros(((1 << self.q) + 63) // 64, np.uint64)
        done, held = 0, np.zeros(0, np.uint64)

        def put(values: np.ndarray, closes: np.ndarray) -> None:
            """Values from slot ``done`` on, which is a multiple of 64."""
            room = -len(values) % 64
            packed = _pack_block(np.append(values & mask, np.zeros(room, np.uint64)), self.r)
            words[done // 64 * self.r :][: len(packed)] = packed
            bits_of = np.packbits(np.append(closes, np.zeros(room, bool)), bitorder="little").view(np.uint64)
            ends[done // 64 :][: len(bits_of)] = bits_of
            quotient = (values[closes] >> rest).astype(np.int64)  # one for each run
            if len(quotient):
                word = quotient >> 6
                first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
                occupied[word[first]] |= np.bitwise_or.reduceat(_ONE << (quotient & 63).astype(np.uint64), first)

        for part in slices:
            held = np.concatenate((held, part)) if len(held) else part
            whole = (len(held) - 1) // 64 * 64  # the last value waits: its run may go on
            if whole > 0:
                quotient = held[: whole + 1] >> rest
                put(held[:whole], quotient[1:] != quotient[:-1])
                done += whole
                held = held[whole:]
        self.size = done + len(held)
        if len(held):
            quotient = held >> rest
            put(held, np.append(quotient[1:] != quotient[:-1], True))
        self.remainders = words[: (self.size + 63) // 64 * self.r + 1]
        self.occupied = BitVector(occupied, 1 << self.q)
        self.run_end = BitVector(ends[: (self.size + 63) // 64], self.size)

    def contains(self, fingerprints: np.ndarray) -> np.ndarray:
        found = np.zeros(len(fingerprints), bool)
        if not self.size:
            return found
        quotient = (fingerprints >> np.uint64(self.r)).astype(np.int64)
        rest = fingerprints & ((_ONE << np.uint64(self.r)) - _ONE)
        live = np.flatnonzero(self.occupied.get(quotient))
        if not len(live):
            return found
        run = self.occupied.rank(quotient[live])
        end = self.run_end.select(run)
        slot = np.where(run > 0, self.run_end.select(np.maximum(run - 1, 0)) + 1, 0)
        while len(live):  # remainders of a run are sorted: stop at the first that is not smaller
            value = _unpack(self.remainders, slot, self.r)
            found[live[value == rest[live]]] = True
            on = (value < rest[live]) & (slot < end)
            live, slot, end = live[on], slot[on] + 1, end[on]
        return found

    def slices(self, step: int = _SLICE) -> Iterator[np.ndarray]:
        """All fingerprints in order, ``step`` at a time, rebuilt from runs and remainders."""
        for low in range(0, self.size, step):
            slot = np.arange(low, min(low + step, self.size))
            quotient = self.occupied.select(self.run_end.rank(slot)).astype(np.uint64)
            yield (quotient << np.uint64(self.r)) | _unpack(self.remainders, slot, self.r)

    def fingerprints(self) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint64), *self.slices()])

    def merge(self, other: QuotientFilter) -> QuotientFilter:
        """Both sets in one filter: two sorted runs, merged slice by slice."""
        return QuotientFilter.of_stream(_merge_sorted(self.slices(), other.slices()), self.size + other.size, self.bits)

    def stored_bytes(self) -> int:
        return (self.size * self.r + 7) // 8 + ((1 << self.q) + self.size + 7) // 8

    def held_bytes(self) -> int:
        """Memory of the arrays, rank directories included."""
        return sum(x.nbytes for x in (self.remainders, self.occupied.words, self.occupied.before, self.run_end.words, self.run_end.before))

    def to_bytes(self) -> bytes:
        head = np.array([self.bits, self.q, self.size], np.int64)
        return b"".join(x.tobytes() for x in (head, self.remainders, self.occupied.words, self.run_end.words))

    @classmethod
    def from_bytes(cls, data: bytes) -> QuotientFilter:
        out = cls.__new__(cls)
        out.bits, out.q, out.size = (int(x) for x in np.frombuffer(data, np.int64, 3))
        out.r = out.bits - out.q
        words = np.frombuffer(data, np.uint64, offset=24)
        n, m = (out.size + 63) // 64 * out.r + 1, ((1 << out.q) + 63) // 64
        out.remainders = words[:n]
        out.occupied = BitVector(words[n : n + m], 1 << out.q)
        out.run_end = BitVector(words[n + m :], out.size)
        return out


def _merge_sorted(a: Iterator[np.ndarray], b: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """Two sorted streams as one, without repeats."""
    none = np.zeros(0, np.uint64)
    x, y = next(a, none), next(b, none)
    last = None
    while len(x) or len(y):
        if not len(x) or not len(y):
            out, x, y = (y, none, next(b, none)) if len(y) else (x, next(a, none), none)
        else:
            limit = min(x[-1], y[-1])
            i, j = np.searchsorted(x, limit, side="right"), np.searchsorted(y, limit, side="right")
            out = np.sort(np.concatenate((x[:i], y[:j])), kind="stable")
            x = x[i:] if i < len(x) else next(a, none)
            y = y[j:] if j < len(y) else next(b, none)
        out = out[np.append(last is None or out[0] != last, out[1:] != out[:-1])]
        if len(out):
            last = out[-1]
            yield out


class Cascade:
    """Quotient filters of at least doubling size; adding merges small ones.

    No merge makes a filter of more than ``most`` keys: beyond it there are more
    filters, so that a stored one stays small enough for a cell of a table.
    """

    def __init__(self, bits: int, most: int = 1 << 26):
        self.bits, self.most, self.levels = bits, most, []

    def seen_then_add(self, fingerprints: np.ndarray) -> np.ndarray:
        """For each fingerprint in order: was it here, or earlier in this array?"""
        distinct, first = np.unique(fingerprints, return_index=True)
        known = np.zeros(len(distinct), bool)
        for level in self.levels:
            ask = np.flatnonzero(~known)
            known[ask] = level.contains(distinct[ask])
        seen = np.ones(len(fingerprints), bool)
        seen[first[~known]] = False
        if not known.all():
            self.levels.append(QuotientFilter(distinct[~known], self.bits))
            while len(self.levels) > 1 and self.levels[-2].size < 2 * self.levels[-1].size and self.levels[-2].size + self.levels[-1].size <= self.most:
                last = self.levels.pop()
                self.levels[-1] = self.levels[-1].merge(last)
        return seen


def _answer_inside_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mark rows that repeat an earlier arrival of their own batch."""
    for batch in batches:
        fp, t, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
        order = np.lexsort((n, t, fp))
        same = np.append(False, fp[order][1:] == fp[order][:-1]) if len(fp) else np.zeros(0, bool)
        seen = np.empty(len(fp), bool)
        seen[order] = same
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(3)), pa.array(seen)], ["fp", "arrived", "row_id", "seen"]
        )


def _shards(shard: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """``rows``, which are sorted by shard, cut where the shard changes."""
    return np.split(rows, np.flatnonzero(np.diff(shard[rows])) + 1) if len(rows) else []


def _answer_in_shards(sizes: list[int], shard_bits: int):
    """One answer column for each fingerprint size: a size is a prefix of the 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, states = -1, []
        for batch in batches:
            s, fp, n, done = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            seen = [done.astype(bool) for _ in sizes]
            for part in _shards(s, np.flatnonzero(~done.astype(bool))):
                if s[part[0]] != shard:
                    shard, states = s[part[0]], [Cascade(b - shard_bits) for b in sizes]
                inside = (fp[part].view(np.uint64) << np.uint64(shard_bits)) >> np.uint64(shard_bits)
                for answer, state, b in zip(seen, states, sizes, strict=True):
                    answer[part] = state.seen_then_add(inside >> np.uint64(64 - b))
            yield pa.RecordBatch.from_arrays([pa.array(n), *map(pa.array, seen)], ["row_id", *(f"seen_{b}" for b in sizes)])

    return run


#: Distinct keys that one shard's filters are meant for: about 30 MB at 64 bits.
SHARD_KEYS = 1 << 22


def shard_bits_for(df: DataFrame) -> int:
    """Enough shards that none has to hold more than SHARD_KEYS keys, and several for each shuffle partition."""
    spark = df.sparkSession
    least = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, math.ceil(math.log2(max(least, df.count() / SHARD_KEYS))))


def _rows(df: DataFrame, key: Column, row_id: str, arrived: str) -> DataFrame:
    return df.select(
        F.xxhash64(key).alias("fp"),
        F.coalesce(F.unix_micros(F.col(arrived).cast("timestamp")), F.lit((1 << 63) - 1)).alias("arrived"),
        F.col(row_id).cast("long").alias("row_id"),
        key.isNotNull().alias("has_key"),
    ).where("has_key and row_id is not null").drop("has_key")


def _sharded(rows: DataFrame, shard_bits: int) -> DataFrame:
    """(shard, arrived, fp, row_id, seen): answered inside batches, each with its shard."""
    local = rows.mapInArrow(_answer_inside_batches, "fp long, arrived long, row_id long, seen boolean")
    # Rows already answered need no shard: they spread over all of them.
    place = F.when(F.col("seen"), F.pmod(F.xxhash64("row_id"), F.lit(1 << shard_bits))).otherwise(F.shiftrightunsigned("fp", 64 - shard_bits))
    return local.withColumn("shard", place)


def seen_before(
    df: DataFrame,
    key: Column,
    row_id: str = "read_no",
    arrived: str = "loaded_at",
    bits: int | list[int] = 64,
    shard_bits: int | None = None,
) -> DataFrame:
    """(``row_id``, ``seen``) for every row that has a key.

    ``seen`` says whether the key occurred in an earlier row; rows are ordered
    by ``arrived``, nulls last, then ``row_id``.  Rows whose key is null have no
    answer and are left out, as are rows without ``row_id``; an empty table
    gives an empty result.  Rows that share an arrival and a row_id are ordered
    arbitrarily, the first of them being new.  Other columns of ``df`` are
    ignored, whatever their names.  ``bits`` is the size of a fingerprint; a
    list of sizes gives a column ``seen_<bits>`` for each, all from one pass.
    There are 2**``shard_bits`` shards, by default as many as the number of rows
    asks for.
    """
    sizes = [bits] if isinstance(bits, int) else list(bits)
    if shard_bits is None:
        shard_bits = min(shard_bits_for(df), min(sizes) - 1)
    if not 0 < shard_bits < min(sizes) or max(sizes) > 64:
        raise ValueError("bits must exceed shard_bits and be at most 64")
    sharded = (
        _sharded(_rows(df, key, row_id, arrived), shard_bits)
        .repartition("shard")
        .sortWithinPartitions("shard", "seen", "arrived", "row_id")
        .select("shard", "fp", "row_id", "seen")
    )
    out = sharded.mapInArrow(_answer_in_shards(sizes, shard_bits), ", ".join(["row_id long", *(f"seen_{b} boolean" for b in sizes)]))
    return out.withColumnsRenamed({"row_id": row_id} | ({f"seen_{bits}": "seen"} if isinstance(bits, int) else {}))


def _answer_with_store(bits: int, shard_bits: int, most: int):
    low = bits - shard_bits
    schema = pa.schema([("row_id", pa.int64()), ("seen", pa.bool_()), ("shard", pa.int64()), ("filter", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, state = None, Cascade(low, most)

        def stored():
            n = len(state.levels)
            columns = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), pa.array([shard] * n, pa.int64()), pa.array([f.to_bytes() for f in state.levels], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            s, fp, n = (batch.column(i).fill_null(0).to_numpy(zero_copy_only=False) for i in range(3))
            seen, old = batch.column(3).to_numpy(zero_copy_only=False).astype(bool), batch.column(4)
            is_filter = old.is_valid().to_numpy(zero_copy_only=False)
            for part in _shards(s, np.flatnonzero(~seen)):
                if s[part[0]] != shard:
                    if state.levels:
                        yield stored()
                    shard, state = int(s[part[0]]), Cascade(low, most)
                for i in part[is_filter[part]]:
                    state.levels.append(QuotientFilter.from_bytes(old[int(i)].as_py()))
                state.levels.sort(key=lambda f: -f.size)
                ask = part[~is_filter[part]]
                inside = (fp[ask].view(np.uint64) << np.uint64(shard_bits)) >> np.uint64(shard_bits)
                seen[ask] = state.seen_then_add(inside >> np.uint64(64 - bits))
            rows = np.flatnonzero(~is_filter)
            none = pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(n[rows]), pa.array(seen[rows]), *none], schema=schema)
        if state.levels:
            yield stored()

    return run


def ask_store(
    df: DataFrame,
    key: Column,
    store: str,
    row_id: str = "read_no",
    arrived: str = "loaded_at",
    bits: int = 64,
    shard_bits: int | None = None,
    most: int = 1 << 26,
) -> DataFrame:
    """As seen_before(), against all batches asked before: (``row_id``, ``seen``).

    ``store`` is a folder that all executors share.  It holds a table of filters
    for each batch, ``batch=0`` onwards; the latest is read, asked, extended and
    written as the next one, so a batch that failed leaves the store as it was.
    Fingerprint size and number of shards are those of the first batch.  A
    filter has at most ``most`` keys; a shard with more has several.
    """
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    last = -1
    if files.exists(path):
        done = [p.getPath() for p in files.listStatus(path) if p.getPath().getName().startswith("batch=")]
        whole = [p for p in done if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        last = max([int(p.getName().removeprefix("batch=")) for p in whole], default=-1)
    if last >= 0:
        old = spark.read.parquet(f"{store}/batch={last}")
        bits, shard_bits = old.select("bits", "shard_bits").first() or (bits, shard_bits)
    if shard_bits is None:
        shard_bits = min(shard_bits_for(df), bits - 1)
    rows = _sharded(_rows(df, key, row_id, arrived), shard_bits).withColumn("filter", F.lit(None).cast("binary"))
    if last >= 0:
        empty = {c: F.lit(None).cast("long") for c in ("fp", "arrived", "row_id")}
        rows = rows.unionByName(old.select("shard", "filter").withColumns({**empty, "seen": F.lit(False)}))
    # A shard's filters come before its rows: both are unanswered, and filters have no arrival.
    ordered = rows.repartition("shard").sortWithinPartitions("shard", "seen", F.col("arrived").asc_nulls_first(), "row_id")
    answered = cut(
        ordered.select("shard", "fp", "row_id", "seen", "filter").mapInArrow(
            _answer_with_store(bits, shard_bits, most), "row_id long, seen boolean, shard long, filter binary"
        )
    )
    kept = answered.where("filter is not null").select("shard", "filter", F.lit(bits).alias("bits"), F.lit(shard_bits).alias("shard_bits"))
    kept.write.mode("overwrite").parquet(f"{store}/batch={last + 1}")
    return answered.where("filter is null").select(F.col("row_id").alias(row_id), "seen")


def error_report(
    df: DataFrame, key: Column, bits: list[int], row_id: str = "read_no", arrived: str = "loaded_at", shard_bits: int | None = None
) -> DataFrame:
    """Rate of wrong answers for each fingerprint size: derived and measured.

    One row per entry of ``bits``: ``bits``, ``new_keys`` (rows whose key is
    new), ``wrong`` (of these, answered "seen"), ``missed`` (repeats answered
    "new", always 0), ``measured_rate`` and ``derived_rate`` of wrong answers
    among new keys.  All sizes are answered in one pass; the truth is an exact
    grouping of the whole keys.
    """
    rows = df.select(key.alias("k"), F.col(row_id).cast("long").alias(row_id), F.col(arrived).alias(arrived)).where(F.col("k").isNotNull())
    at = F.coalesce(F.unix_micros(F.col(arrived).cast("timestamp")), F.lit((1 << 63) - 1))
    first = rows.groupBy("k").agg(F.min(F.struct(at.alias("t"), F.col(row_id).alias("n"))).alias("f")).select(F.col("f.n").alias(row_id), F.lit(True).alias("is_new"))
    answers = seen_before(rows, F.col("k"), row_id, arrived, list(bits), shard_bits or min(shard_bits_for(df), min(bits) - 1))
    joined = answers.join(first, row_id, "left").withColumn("is_new", F.coalesce("is_new", F.lit(False)))
    flags = joined.agg(
        F.count_if("is_new").alias("new_keys"),
        *(F.count_if(F.col("is_new") & F.col(f"seen_{b}")).alias(f"wrong_{b}") for b in bits),
        *(F.count_if(~F.col("is_new") & ~F.col(f"seen_{b}")).alias(f"missed_{b}") for b in bits),
    )
    each = F.array(*(F.struct(F.lit(b).alias("bits"), F.col("new_keys"), F.col(f"wrong_{b}").alias("wrong"), F.col(f"missed_{b}").alias("missed")) for b in bits))
    counts = flags.select(F.inline(each))
    n, m = F.col("new_keys").cast("double"), F.pow(F.lit(2.0), F.col("bits").cast("double"))
    filled = -F.expm1(n * F.log1p(-1 / m))  # expected share of fingerprints in use
    return counts.select(
        "bits",
        "new_keys",
        "wrong",
        "missed",
        (F.col("wrong") / F.greatest(n, F.lit(1.0))).alias("measured_rate"),
        F.when(n > 0, F.greatest(F.lit(0.0), 1 - m * filled / n)).otherwise(0.0).alias("derived_rate"),
    )
