"""Long exact spans shared between records.

Records are letters without lines, so the unit whose digests are grouped is a
window of ``length`` letters in upper case; its digest is the window itself, two
bits a letter, so equal digests are equal letters.  Sending every window would
shuffle the text about ``length`` times over.  Windows are therefore sent
together: an anchor, the smallest hash among the short words inside a window,
names the range of the shuffle that it goes to; neighbouring windows mostly
share one and travel as one stretch of letters.  In its range every window is
grouped: found in two different contents it is shared, its earliest occurrence
by (row, offset) is kept, all others are repeats with their original offsets.

Skew.  A stretch that a chunk of records holds in three or more contents is sent
for the earliest and one other of them; for the rest its windows are known to be
repeats.  Anchors that more than one in HOT_SHARE windows' stretches of a bounded
sample have (at most HOT_SHARE of them) do not name a range: their windows
are sent one by one, each to the range that its own letters name.  The sample
decides only about routes, never about results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from strandloom.llm.blobs import by_range, chunks, planes, range_bits, unplanes
from strandloom.llm.neardup import _strings

_CODE = np.full(256, 4, np.uint8)
_CODE[np.frombuffer(b"ACGT", np.uint8)] = range(4)
_WORD = 24  # letters of an anchor
_POSITION_BITS = 20


def _chain(first: np.ndarray, length: int, join) -> np.ndarray:
    """Combine ``length`` neighbours of each element by doubling; the ends are padding."""
    have, out, done = 1, first, None
    taken = 0
    while length:
        if length & have:
            shifted = out if not taken else np.append(out[taken:], out[-1:].repeat(min(taken, len(out))))
            done = shifted if done is None else join(done, shifted, have)
            taken += have
            length -= have
        out = join(out, np.append(out[have:], out[-1:].repeat(min(have, len(out)))), have)
        have *= 2
    return done


def _codes(code: np.ndarray, letters: int) -> np.ndarray:
    """2-bit code of the ``letters`` letters from each position, first letter on top."""
    return _chain(code, letters, lambda x, y, n: (x << np.uint64(2 * n)) | y)


def _runs_of_anchors(raw: np.ndarray, at: np.ndarray, length: int):
    """For a block of texts: anchor code, text number, first window, number of windows."""
    code = _CODE[raw]
    bad = np.concatenate(([0], np.cumsum(code == 4)))
    n = len(raw)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    start = np.arange(n - length + 1)
    if not len(start):
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 3
    good = (bad[start + length] == bad[start]) & (text[start + length - 1] == text[start])
    words = _codes((code & 3).astype(np.uint64), _WORD)
    rank = words * np.uint64(0x9E3779B97F4A7C15)
    rank ^= rank >> np.uint64(31)
    rank *= np.uint64(0xBF58476D1CE4E5B9)
    low = np.uint64((1 << _POSITION_BITS) - 1)
    rank = (rank & ~low) | np.arange(n, dtype=np.uint64)
    least = _chain(rank, length - _WORD + 1, lambda x, y, _: np.minimum(x, y))[: len(start)]
    fresh = good & np.append(True, (least[1:] != least[:-1]) | ~good[:-1] | (text[start[1:]] != text[start[:-1]]))
    begin = np.flatnonzero(fresh)
    run = np.cumsum(fresh)[good] - 1
    size = np.bincount(run, minlength=len(begin)) if len(begin) else np.zeros(0, np.int64)
    return words[(least[begin] & low).astype(np.int64)], text[begin], begin - at[text[begin]], size


def _blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slices of texts of at most 2**20 letters together; a longer text comes alone in pieces' place."""
    lengths = np.diff(_strings(column)[1])
    low, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > (1 << _POSITION_BITS) - 1:
            yield (low, *_strings(column.slice(low, i - low)))
            low, total = i, 0
        total += n
    if low < len(lengths):
        yield (low, *_strings(column.slice(low)))


def _anchor_runs(raw: np.ndarray, at: np.ndarray, length: int):
    """As _runs_of_anchors, for texts of any length: long ones in overlapping pieces."""
    most = (1 << _POSITION_BITS) - 1
    if len(raw) <= most:
        yield _runs_of_anchors(raw, at, length)
        return
    step = most - length + 1
    for low in range(0, max(1, len(raw) - length + 1), step):
        piece = raw[low : low + most]
        code, text, first, size = _runs_of_anchors(piece, np.array([0, len(piece)]), length)
        yield code, text, first + low, size


#: Contents looked at for hot anchors, and the share of stretches, as one in so many, that makes one hot.
HOT_SAMPLE, HOT_SHARE = 200_000, 20_000


def _emit_anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, raw, at in _blocks(batch.column(0)) if batch.num_rows else []:
                for code, _, _, _ in _anchor_runs(raw, at, length):
                    yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64))], ["anchor"])

    return run


def hot_anchors(rows: DataFrame, texts: int, length: int) -> np.ndarray:
    """Anchors of many stretches in a sample of about HOT_SAMPLE of the texts; at most HOT_SHARE of them."""
    step = max(1, -(-texts // HOT_SAMPLE))
    found = rows.where(F.pmod("h", F.lit(step)) == 0).select("text").mapInArrow(_emit_anchors(length), "anchor long")
    counts = found.groupBy("anchor").agg(F.count("*").alias("n"))
    hot = counts.where((F.col("n") >= 64) & (F.col("n") * HOT_SHARE > counts.agg(F.sum("n")).scalar()))
    return np.array(sorted(r["anchor"] for r in hot.select("anchor").collect()), np.int64)


def _avalanche(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _ranks(columns: list[np.ndarray]) -> np.ndarray:
    """A number for each row of unsigned 64-bit columns: equal rows, and only these, have equal numbers."""
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = _avalanche(h ^ c)
    order = np.argsort(h)
    new = h[order[1:]] != h[order[:-1]]
    differ = np.zeros(len(new), bool)
    for c in columns:
        differ |= c[order[1:]] != c[order[:-1]]
    if (differ & ~new).any():  # hashes collide: sort by the columns themselves
        order = np.lexsort(columns)
        differ = np.zeros(len(new), bool)
        for c in columns:
            differ |= c[order[1:]] != c[order[:-1]]
    out = np.empty(len(h), np.int64)
    out[order] = np.append(0, np.cumsum(differ)) if len(h) else 0
    return out


def _inside(size: np.ndarray) -> np.ndarray:
    """0, 1, .. for each of the given sizes."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


class Stretches:
    """Runs of windows: content, row, first offset, number of windows, and their letters packed by four."""

    def __init__(self, length, content, row, first, size, packed):
        self.length, self.content, self.row, self.first, self.size, self.packed = length, content, row, first, size, packed

    def nbytes(self) -> np.ndarray:
        return (self.size + self.length + 2) // 4

    def take(self, at: np.ndarray) -> Stretches:
        n = self.nbytes()
        begin = np.cumsum(n) - n
        where = np.repeat(begin[at], n[at]) + _inside(n[at])
        return Stretches(self.length, self.content[:, at], self.row[at], self.first[at], self.size[at], self.packed[where])

    def columns(self) -> list[bytes]:
        """As binary cells of a row."""
        return [*(planes(c) for c in self.content), planes(self.row), planes(self.first), planes(self.size), self.packed.tobytes()]

    @classmethod
    def of_rows(cls, length: int, rows: list[tuple]) -> Stretches:
        cells = list(zip(*rows, strict=True))
        n = cells[0]
        back = [np.concatenate([unplanes(x, k) for x, k in zip(c, n, strict=True)]) for c in cells[1:6]]
        return cls(length, np.stack(back[:2]), back[2], back[3].astype(np.int64), back[4].astype(np.int64), np.frombuffer(b"".join(cells[6]), np.uint8))

    def words(self) -> list[np.ndarray]:
        """Size and letters of each stretch as columns, for comparison; letters behind the end are zero."""
        n = self.nbytes()
        width = -(-int(n.max(initial=1)) // 8) * 8
        table = np.zeros((len(n), width), np.uint8)
        table[np.repeat(np.arange(len(n)), n), _inside(n)] = self.packed
        return [self.size.astype(np.uint64), *np.ascontiguousarray(table.view(np.uint64).T)]

    def windows(self) -> list[np.ndarray]:
        """Columns that hold the letters of every window exactly, 32 a word, the last word aligned to the end."""
        code = np.stack([self.packed >> 6, self.packed >> 4 & 3, self.packed >> 2 & 3, self.packed & 3], axis=1).ravel().astype(np.uint64)
        n = self.nbytes()
        where = np.repeat(4 * (np.cumsum(n) - n), self.size) + _inside(self.size)
        step = min(32, self.length)
        words = _codes(code, step)
        return [words[where + at] for at in sorted({*range(0, self.length - step + 1, step), self.length - step})]


def _dense(content: np.ndarray) -> np.ndarray:
    """A number for each content, as _ranks()."""
    return _ranks(list(content))


def _spans_of(s: Stretches, hit: np.ndarray, kept: np.ndarray) -> pa.RecordBatch:
    """Rows of (h, g, row, at, end, kept): runs of hit windows of one kind within a stretch."""
    piece = np.repeat(np.arange(len(s.size)), s.size)
    inside = _inside(s.size)
    on = np.flatnonzero(hit)
    new = np.append(True, (np.diff(on) != 1) | (np.diff(piece[on]) != 0) | (kept[on][1:] != kept[on][:-1])) if len(on) else np.zeros(0, bool)
    first, last = on[new], on[np.append(new[1:], True)] if len(on) else on
    p = piece[first]
    columns = [*(c[p].view(np.int64) for c in s.content), s.row[p].view(np.int64), s.first[p] + inside[first], s.first[p] + inside[last] + s.length, kept[first]]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "g", "row", "at", "end", "kept"])


def _cut_up(s: Stretches, at: np.ndarray) -> Stretches:
    """The windows of some stretches, each a stretch of its own."""
    code = np.stack([s.packed >> 6, s.packed >> 4 & 3, s.packed >> 2 & 3, s.packed & 3], axis=1).ravel()
    n = s.nbytes()
    size = s.size[at]
    begin = np.repeat(4 * (np.cumsum(n) - n)[at], size) + _inside(size)
    k = -(-s.length // 4) * 4
    letters = np.append(code, np.zeros(4, np.uint8))[begin[:, None] + np.arange(k)]
    letters[:, s.length :] = 0
    four = letters.reshape(len(letters), -1, 4)
    packed = (four[:, :, 0] << 6 | four[:, :, 1] << 4 | four[:, :, 2] << 2 | four[:, :, 3]).ravel()
    which = np.repeat(at, size)
    return Stretches(s.length, s.content[:, which], s.row[which], s.first[which] + _inside(size), np.ones(len(which), np.int64), packed)


def _joined(a: Stretches, b: Stretches) -> Stretches:
    pair = lambda x, y: np.concatenate((x, y), axis=-1)
    return Stretches(a.length, pair(a.content, b.content), pair(a.row, b.row), pair(a.first, b.first), pair(a.size, b.size), pair(a.packed, b.packed))


def _stretches(batch: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, Stretches]]:
    """Anchors and stretches of a batch of (h, g, row, text)."""
    content = np.stack([batch.column(i).to_numpy().view(np.uint64) for i in (0, 1)])
    row = batch.column(2).to_numpy().view(np.uint64)
    for low, raw, at in _blocks(batch.column(3)):
        letter = np.cumsum((raw & 0xC0) != 0x80) - 1  # offsets count letters, not bytes
        four = np.append(_CODE[raw] & 3, np.zeros(8, np.uint8)).astype(np.uint8)
        four = four[:-3] << 6 | four[1:-2] << 4 | four[2:-1] << 2 | four[3:]
        for code, text, first, size in _anchor_runs(raw, at, length):
            begin = at[text] + first
            n = (size + length + 2) // 4
            packed = four[np.minimum(np.repeat(begin, n) + 4 * _inside(n), len(four) - 1)]
            over = 4 * n - (size + length - 1)  # letters that the last byte holds beyond the end
            last = np.cumsum(n) - 1
            packed[last] &= (0xFF << (2 * over) & 0xFF).astype(np.uint8)
            yield code.view(np.int64), Stretches(length, content[:, low + text], row[low + text], letter[begin] - letter[at[text]], size.astype(np.int64), packed)


_SPAN = "h long, g long, row long, at long, end long, kept boolean"
_CELLS = ["h", "g", "row", "first", "size", "letters"]


def _route(length: int, bits: int, hot: np.ndarray, least: int = 8 << 20):
    """A row for each range and chunk; spans that are decided already come along as a row without letters."""
    shift = np.uint64(64 - bits)

    def ranged(s: Stretches, key: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(key, kind="stable")
        key, s = key[order], s.take(order)
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(key))
        columns = list(zip(*_cells(s, starts, ends), strict=True)) or [()] * len(_CELLS)
        return pa.RecordBatch.from_arrays(
            [pa.array(key[starts].astype(np.int32)), pa.array((ends - starts).astype(np.int32)), *(pa.array(list(c), pa.binary()) for c in columns)], ["range", "n", *_CELLS]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, least):
            order = np.lexsort((batch.column(2).to_numpy(), batch.column(1).to_numpy(), batch.column(0).to_numpy()))
            h, g = (batch.column(i).to_numpy()[order] for i in (0, 1))
            batch = batch.take(pa.array(order[np.append(True, (h[1:] != h[:-1]) | (g[1:] != g[:-1]))]))  # the first row of each content
            for anchor, s in _stretches(batch, length):
                if not len(anchor):
                    continue
                key = _avalanche(anchor.view(np.uint64)) >> shift
                if len(hot):
                    is_hot = hot[np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)] == anchor
                    if is_hot.any():
                        single = _cut_up(s, np.flatnonzero(is_hot))
                        own = np.zeros(len(single.size), np.uint64)
                        for c in single.windows():
                            own = _avalanche(own ^ c)
                        rest = np.flatnonzero(~is_hot)
                        s, key = _joined(s.take(rest), single), np.concatenate((key[rest], own >> shift))
                yield from deduped(s, key)

    def deduped(s: Stretches, key: np.ndarray) -> Iterator[pa.RecordBatch]:
        same, content = _ranks(s.words()), _dense(s.content)
        order = np.lexsort((s.first, s.row.view(np.int64), same))
        head = np.append(True, same[order[1:]] != same[order[:-1]])
        group = np.cumsum(head) - 1
        earliest = content[order[head]][group]
        other = content[order] != earliest
        # the first occurrence of another content is sent too, and with the earliest it decides for all
        where = np.where(other, np.arange(len(order)), len(order))
        second = np.minimum.reduceat(where, np.flatnonzero(head)) if len(order) else where
        send = head | (np.arange(len(order)) == second[group])
        decided = ~send & (second[group] < len(order))
        send = ~decided  # repeats inside one content go with it
        yield ranged(s.take(order[send]), key[order[send]])
        if decided.any():
            at = order[decided]
            done = s.take(at)
            windows = int(done.size.sum())
            spans = _spans_of(done, np.ones(windows, bool), np.zeros(windows, bool))
            names = list(range(len(_CELLS)))
            cells = [pa.array([planes(spans.column(i).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))], pa.binary()) for i in names]
            where = int(key[at[0]])
            yield pa.RecordBatch.from_arrays([pa.array([where], pa.int32()), pa.array([-spans.num_rows], pa.int32()), *cells], ["range", "n", *_CELLS])

    return run


def _cells(s: Stretches, starts: np.ndarray, ends: np.ndarray) -> Iterator[list[bytes]]:
    """As Stretches.columns() of every range of sorted stretches, without copying what lies between."""
    n = np.append(0, np.cumsum(s.nbytes()))
    for a, b in zip(starts, ends, strict=True):
        yield Stretches(s.length, s.content[:, a:b], s.row[a:b], s.first[a:b], s.size[a:b], s.packed[n[a] : n[b]]).columns()


def _decide(length: int):
    """Windows of a range grouped by their letters: spans of shared ones, kept or repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_range(batches):
            for n, *cells in (r for r in rows if r[0] < 0):
                back = [unplanes(c, -n).view(np.int64) for c in cells]
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in back[:5]), pa.array(back[5].astype(bool))], ["h", "g", "row", "at", "end", "kept"])
            rows = [r for r in rows if r[0] > 0]
            if not rows:
                continue
            s = Stretches.of_rows(length, rows)
            group, piece = _ranks(s.windows()), np.repeat(np.arange(len(s.size)), s.size)
            content = _dense(s.content)[piece]
            many = int(group.max()) + 1
            low, high = np.full(many, len(s.size)), np.full(many, -1)
            np.minimum.at(low, group, content)
            np.maximum.at(high, group, content)
            shared = low < high
            hit = shared[group]
            on = np.flatnonzero(hit)
            at = s.first[piece[on]] + _inside(s.size)[on]
            order = np.lexsort((at, s.row[piece[on]].view(np.int64), group[on]))
            best = order[np.append(True, group[on][order[1:]] != group[on][order[:-1]])] if len(on) else order
            kept = np.zeros(len(hit), bool)
            # the same occurrence may have come from several chunks that hold its content: rows decide
            kept[on[best]] = True
            yield _spans_of(s, hit, kept)

    return run


def _rows(df: DataFrame, text: Column, row_id: str, length: int) -> DataFrame:
    """(h, g, row_id, text) of rows that can share: 96 bits of hash name a content."""
    upper = F.upper(text.cast("string"))
    rows = df.select(F.col(row_id).cast("long").alias("row_id"), upper.alias("text"))
    rows = rows.where((F.length("text") >= length) & F.col("row_id").isNotNull())
    return rows.select(F.xxhash64("text").alias("h"), F.shiftrightunsigned(F.xxhash64(F.lit(1), "text"), 32).alias("g"), "row_id", "text")


def _occurrences(df: DataFrame, text: Column, row_id: str, length: int) -> DataFrame:
    """(h, g, row, at, end, kept): runs of shared windows of each content, as its first row of a chunk has them."""
    if length < _WORD:
        raise ValueError(f"length must be at least {_WORD}")
    rows = _rows(df, text, row_id, length)
    n, letters = rows.agg(F.count("*"), F.sum(F.length("text"))).first()
    hot = hot_anchors(rows, n, length)
    bits = range_bits(df, letters or 0)
    sent = rows.mapInArrow(_route(length, bits, hot), "range int, n int, " + ", ".join(f"{c} binary" for c in _CELLS))
    return sent.repartition("range").sortWithinPartitions("range").mapInArrow(_decide(length), _SPAN)


def _united(spans: DataFrame) -> DataFrame:
    """(h, g, span_start, span_end): overlapping and touching spans of each content as one."""
    order = Window.partitionBy("h", "g").orderBy("at", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    numbered = spans.withColumn("opens", F.coalesce((F.col("at") > reach).cast("int"), F.lit(1))).withColumn("run", F.sum("opens").over(order))
    return numbered.groupBy("h", "g", "run").agg(F.min("at").alias("span_start"), F.max("end").alias("span_end")).drop("run")


def shared_spans(df: DataFrame, text: Column, row_id: str = "read_no", length: int = 48) -> DataFrame:
    """(``row_id``, ``span_start``, ``span_end``): runs of letters shared with another content.

    A letter is shared if it lies in ``length`` consecutive letters, all of A, C,
    G and T in either case, that also occur in a row whose whole text differs.
    Offsets count letters from 0, ends exclusive.  Null, empty and short texts have no
    spans; rows of equal text have the same spans; texts may be of any length
    up to what one row can hold.  ``length`` is 24 or more.
    """
    spans = _united(_occurrences(df, text, row_id, length).select("h", "g", "at", "end").distinct())
    rows = _rows(df, text, row_id, length).select("h", "g", "row_id")
    return rows.join(spans, ["h", "g"]).select(F.col("row_id").alias(row_id), "span_start", "span_end")


def shared_report(df: DataFrame, text: Column, row_id: str = "read_no", length: int = 48) -> DataFrame:
    """One row per record: (``row_id``, ``letters``, ``shared``, ``spans``, ``share``).

    Records without text have 0 letters and share 0.
    """
    spans = shared_spans(df, text, row_id, length).groupBy(row_id).agg(
        F.sum(F.col("span_end") - F.col("span_start")).alias("shared"), F.count("*").alias("spans")
    )
    rows = df.select(F.col(row_id).cast("long").alias(row_id), F.coalesce(F.length(text.cast("string")), F.lit(0)).cast("long").alias("letters"))
    joined = rows.join(spans, row_id, "left").fillna(0, ["shared", "spans"])
    return joined.withColumn("share", F.when(F.col("letters") > 0, F.col("shared") / F.col("letters")).otherwise(0.0))


def removable_spans(df: DataFrame, text: Column, row_id: str = "read_no", length: int = 48) -> DataFrame:
    """(``row_id``, ``span_start``, ``span_end``): repeats to remove, by original offsets.

    Of each window that several contents have, the occurrence with the smallest
    row id and then offset is kept; letters that a shared window covers and no
    kept one does are listed.  A row that is not the first of its content keeps
    nothing: all its shared spans are listed.  Row ids must be unique.  What
    only whole copies of one text share is no span: an exact-duplicate filter
    drops those.
    """
    found = _occurrences(df, text, row_id, length).distinct()
    rows = _rows(df, text, row_id, length).select("h", "g", "row_id")
    first = rows.groupBy("h", "g").agg(F.min("row_id").alias("first_row"))
    edges = None
    # A chunk's first row of a content keeps a window only if it is the first row of all.
    known = found.join(first, ["h", "g"]).withColumn("kept", F.col("kept") & (F.col("row") == F.col("first_row")))
    for flag, repeats, keeps in ((False, 1, 0), (True, 0, 1)):
        runs = _united(known.where(F.col("kept") == flag).select("h", "g", "at", "end"))
        ends = F.array(*(F.struct(F.col(c).alias("p"), F.lit(sign * repeats).alias("r"), F.lit(sign * keeps).alias("k")) for c, sign in (("span_start", 1), ("span_end", -1))))
        side = runs.select("h", "g", F.inline(ends))
        edges = side if edges is None else edges.unionByName(side)
    order = Window.partitionBy("h", "g").orderBy("p")
    steps = edges.groupBy("h", "g", "p").agg(F.sum("r").alias("r"), F.sum("k").alias("k"))
    steps = steps.select("h", "g", F.col("p").alias("at"), F.lead("p").over(order).alias("end"), F.sum("r").over(order).alias("r"), F.sum("k").over(order).alias("k"))
    spans = _united(steps.where("r > 0 and k = 0").select("h", "g", "at", "end")).withColumn("later", F.lit(False))
    whole = _united(found.select("h", "g", "at", "end")).withColumn("later", F.lit(True))
    tagged = rows.join(first, ["h", "g"]).withColumn("later", F.col("row_id") > F.col("first_row"))
    return tagged.join(spans.unionByName(whole), ["h", "g", "later"]).select(F.col("row_id").alias(row_id), "span_start", "span_end")
