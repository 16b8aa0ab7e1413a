"""Seed-and-extend in whole Arrow batches, against a reference that every task holds.

The letters of all contigs are broadcast once, a byte each; a Python worker
sorts their seeds once and keeps them, 8 bytes a position.  Reads are placed
where they are read, so neither candidates nor letters are ever shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters of a reference up to which it is broadcast: a worker then holds at most 9 bytes for each, 300 MB.
LETTERS = 1 << 25
#: Letters compared at a time, and hits tried.
_STEP, _HITS = 1 << 20, 1 << 18

_CODE = np.full(256, 4, np.uint8)
_CODE[np.frombuffer(b"ACGT", np.uint8)] = range(4)
_TURN = np.arange(256, dtype=np.uint8)
_TURN[np.frombuffer(b"ACGT", np.uint8)] = np.frombuffer(b"TGCA", np.uint8)


def points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Letters of a string column end to end, and where each row begins; bytes, or code points if a letter is of several bytes."""
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    at = np.append(0, np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False))).astype(np.int64)
    whole = "".join(texts.to_pylist())
    return (np.frombuffer(whole.encode(), np.uint8) if whole.isascii() else np.frombuffer(whole.encode("utf-32-le"), np.uint32)), at


def codes(letters: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows of k letters that begin at ``first``: code, code of the reverse complement, whether all are ACGT."""
    forward, back, known = np.zeros(len(first), np.uint64), np.zeros(len(first), np.uint64), np.ones(len(first), bool)
    for i in range(k):
        code = _CODE[np.minimum(letters[first + i], 255)]
        known &= code < 4
        code = (code & 3).astype(np.uint64)
        forward = (forward << np.uint64(2)) | code
        back |= (np.uint64(3) - code) << np.uint64(2 * i)
    return forward, back, known


def turned(letters: np.ndarray) -> np.ndarray:
    """The complement of upper-case letters, in the same order."""
    return _TURN[letters] if letters.dtype == np.uint8 else np.where(letters < 256, _TURN[np.minimum(letters, 255)], letters)


class Index:
    """Contigs end to end in the order of their names, a zero behind each, with their seeds by canonical code and position."""

    def __init__(self, names: pa.Array, letters: np.ndarray, begins: np.ndarray, k: int):
        self.names, self.letters, self.begins, self.k = names, letters, begins, k
        parts = []
        for at in range(0, len(letters) - k + 1, _STEP):
            first = np.arange(at, min(at + _STEP, len(letters) - k + 1))
            forward, back, known = codes(letters, first, k)
            seed = (np.minimum(forward, back) << np.uint64(32)) | (first.astype(np.uint64) << np.uint64(1)) | (back < forward)
            parts.append(seed[known])
        self.seeds = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        self.seeds.sort()

    def place(self, texts: pa.Array, offsets: tuple[int, ...], cap: int | None, most: float) -> tuple[np.ndarray, ...]:
        """(row, contig, begin, reverse, mismatches, length) of the best placement of each row that has one."""
        letters, at = points(texts)
        long = np.flatnonzero(np.diff(at) >= self.k)
        own, n, seeds = at[long], np.diff(at)[long], len(offsets)
        inside = np.minimum(np.array(offsets, np.int64), (n - self.k)[:, None])
        forward, back, known = codes(letters, (own[:, None] + inside).ravel(), self.k)
        kmer = np.minimum(forward, back) << np.uint64(32)
        low = np.searchsorted(self.seeds, kmer)
        hits = np.where(known, np.searchsorted(self.seeds, kmer + np.uint64(1 << 32)) - low, 0)
        hits = hits if cap is None else np.minimum(hits, cap)
        upto = np.append(0, np.cumsum(hits.reshape(-1, seeds).sum(1)))
        found, row = [], 0
        while row < len(long):  # rows of at most _HITS hits, one row at least
            end = max(row + 1, int(np.searchsorted(upto, upto[row] + _HITS, "right")) - 1)
            some = np.repeat(np.arange(row * seeds, end * seeds), hits[row * seeds : end * seeds])
            first = np.cumsum(hits[row * seeds : end * seeds]) - hits[row * seeds : end * seeds]
            hit = self.seeds[low[some] + np.arange(len(some)) - first[some - row * seeds]]
            read, position = some // seeds, ((hit >> np.uint64(1)) & np.uint64((1 << 31) - 1)).astype(np.int64)
            turn = (back[some] < forward[some]) != (hit & np.uint64(1)).astype(bool)
            before = inside.ravel()[some]
            begin = position - np.where(turn, n[read] - self.k - before, before)
            contig = np.searchsorted(self.begins, position, "right") - 1
            fits = (begin >= self.begins[contig]) & (begin + n[read] < self.begins[contig + 1])
            read, seed, turn, begin, contig = read[fits], (some % seeds)[fits], turn[fits], begin[fits], contig[fits]
            order = np.lexsort((seed, turn, begin, read))  # the earliest seed of equal placements
            same = np.zeros(len(order), bool)
            same[1:] = np.all([x[order][1:] == x[order][:-1] for x in (read, begin, turn)], axis=0)
            read, seed, turn, begin, contig = (x[order][~same] for x in (read, seed, turn, begin, contig))
            wrong = self._mismatches(letters, own[read], n[read], begin, turn)
            order = np.lexsort((turn, begin, seed, wrong, read))
            order = order[wrong[order] / n[read][order] <= most]
            order = order[np.append(True, read[order][1:] != read[order][:-1])] if len(order) else order
            found.append((long[read[order]], contig[order], (begin - self.begins[contig])[order], turn[order], wrong[order], n[read][order]))
            row = end
        return tuple(map(np.concatenate, zip(*found, strict=True))) if found else (np.zeros(0, np.int64),) * 6

    def _mismatches(self, letters: np.ndarray, own: np.ndarray, n: np.ndarray, begin: np.ndarray, turn: np.ndarray) -> np.ndarray:
        out, upto, i = np.zeros(len(n), np.int64), np.append(0, np.cumsum(n)), 0
        other = turned(letters)
        while i < len(n):
            end = max(i + 1, int(np.searchsorted(upto, upto[i] + _STEP, "right")) - 1)
            some = slice(i, end)
            first = upto[i:end] - upto[i]
            step = np.arange(upto[end] - upto[i]) - np.repeat(first, n[some])
            back = np.repeat(turn[some], n[some])
            under = self.letters[np.repeat(begin[some], n[some]) + step]
            at = np.repeat(np.where(turn[some], own[some] + n[some] - 1, own[some]), n[some]) + np.where(back, -step, step)
            out[some] = np.add.reduceat(np.where(back, other[at], letters[at]) != under, first, dtype=np.int64)
            i = end
        return out


_KEPT: dict = {}  # the one index of this worker


def packed(contigs: DataFrame, name: str, text: str, k: int) -> Broadcast | None:
    """A broadcast of (names, letters, begins) of the contigs, or None where they are too long, or names are not unique."""
    rows = contigs.select(F.col(name).alias("name"), F.upper(text).alias("text")).where("name is not null and text is not null")
    n, names, size = rows.agg(F.count("*"), F.count_distinct("name"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    if n != names or n + size > LETTERS or k > 15:
        return None
    table = rows.toArrow().combine_chunks().sort_by("name")
    letters, at = points(pc.binary_join_element_wise(table["text"].combine_chunks(), "", "\0"))
    return contigs.sparkSession.sparkContext.broadcast((table["name"].combine_chunks(), letters, at))


def place(reads: DataFrame, row_id: str, seq: str, shared: Broadcast, kind: str, k: int, offsets: tuple[int, ...], cap: int | None, most: float) -> DataFrame:
    """(row_id, contig of this kind, begin, reverse, length, mismatches) of the reads, placed batch by batch."""
    rows = reads.select(row_id, F.upper(seq).alias("text")).where(F.length("text") >= k)
    mark = uuid.uuid4().hex

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if _KEPT.get("of") != mark:
                _KEPT.clear()
                _KEPT.update(of=mark, index=Index(*shared.value, k))
            index = _KEPT["index"]
            row, contig, begin, reverse, wrong, n = index.place(batch.column(1), offsets, cap, most)
            columns = [batch.column(0).take(pa.array(row)), index.names.take(pa.array(contig)), pa.array(begin, pa.int32()), pa.array(reverse.astype(bool)), pa.array(n, pa.int32()), pa.array(wrong, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, [row_id, "contig", "begin", "reverse", "length", "mismatches"])

    return rows.mapInArrow(placed, f"{row_id} {dict(rows.dtypes)[row_id]}, contig {kind}, begin int, reverse boolean, length int, mismatches int")
