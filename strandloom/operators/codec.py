"""Entropy coding: a range coder with adaptive models, and what it costs per column.

The coder itself is sequential, so it runs over one block at a time: a fixed
number of reads, wherever the block lies.  What a column costs under a model
needs no coding: the code length follows from counts of symbols by context.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions import ident
from strandloom.operators.models import adaptive_bits

#: Total at which counts are halved, letters of a nucleotide context, dinucleotides with tables of their own.
HALVE_AT, ORDER, OWN_TABLES = 1 << 15, 11, 4

_TOP, _MASK = 1 << 24, (1 << 32) - 1


class Encoder:
    """Range coder: intervals of a 32-bit range, carries passed on through held bytes."""

    def __init__(self):
        self.low, self.range, self.out = 0, _MASK, bytearray()

    def put(self, begin: int, size: int, total: int) -> None:
        step = self.range // total
        self.low += begin * step
        self.range = size * step
        if self.low > _MASK:  # carry into what was written
            self.low &= _MASK
            at = len(self.out) - 1
            while self.out[at] == 255:
                self.out[at] = 0
                at -= 1
            self.out[at] += 1
        while self.range < _TOP:
            self.out.append(self.low >> 24)
            self.low = self.low << 8 & _MASK
            self.range <<= 8

    def done(self) -> bytes:
        for _ in range(4):
            self.put(0, 1, 256)  # pushes out the bytes of low
        return bytes(self.out)


class Decoder:
    def __init__(self, data: bytes):
        self.data, self.at, self.range = data, 4, _MASK
        self.code = int.from_bytes(data[:4].ljust(4, b"\0"), "big")

    def slot(self, total: int) -> int:
        """Where in 0..total-1 the next symbol's interval lies."""
        self.step = self.range // total
        return min(total - 1, self.code // self.step)

    def take(self, begin: int, size: int) -> None:
        self.code -= begin * self.step
        self.range = size * self.step
        while self.range < _TOP:
            byte = self.data[self.at] if self.at < len(self.data) else 0
            self.code = (self.code << 8 | byte) & _MASK
            self.range <<= 8
            self.at += 1


class Model:
    """Adaptive counts of an alphabet: they start at 1, grow by ``rate`` and are halved, to at least 1, beyond HALVE_AT.

    The shares used for coding are those of the last refresh, every ``delay`` symbols.
    """

    def __init__(self, alphabet: int, rate: int = 8, delay: int = 1):
        self.counts, self.rate, self.delay = [1] * alphabet, rate, delay
        self.refresh()

    def refresh(self) -> None:
        if sum(self.counts) > HALVE_AT:
            self.counts = [max(1, c // 2) for c in self.counts]
        self.shares, self.total, self.wait = list(self.counts), sum(self.counts), self.delay

    def saw(self, symbol: int) -> None:
        self.counts[symbol] += self.rate
        self.wait -= 1
        if not self.wait:
            self.refresh()

    def encode(self, coder: Encoder, symbol: int) -> None:
        coder.put(sum(self.shares[:symbol]), self.shares[symbol], self.total)
        self.saw(symbol)

    def decode(self, coder: Decoder) -> int:
        slot, begin = coder.slot(self.total), 0
        for symbol, share in enumerate(self.shares):  # noqa: B007
            if begin + share > slot:
                break
            begin += share
        coder.take(begin, share)
        self.saw(symbol)
        return symbol


def encode_text(text: bytes, alphabet: int = 256, order: int = 1) -> bytes:
    """Bytes below ``alphabet`` coded after the byte before (``order`` 1) or alone (0)."""
    coder, models, before = Encoder(), {}, 0
    for symbol in text:
        model = models.get(before) or models.setdefault(before, Model(alphabet))
        model.encode(coder, symbol)
        before = symbol if order else 0
    return coder.done()


def decode_text(data: bytes, size: int, alphabet: int = 256, order: int = 1) -> bytes:
    coder, models, before, out = Decoder(data), {}, 0, bytearray()
    for _ in range(size):
        model = models.get(before) or models.setdefault(before, Model(alphabet))
        symbol = model.decode(coder)
        out.append(symbol)
        before = symbol if order else 0
    return bytes(out)


def code_blocks(df: DataFrame, texts: Column, keep: list[str], first: int = 33, alphabet: int = 94) -> DataFrame:
    """(keep.., symbols, coded, same): an array of texts of each row coded as one stream and decoded again.

    Characters lie in ``first`` .. ``first + alphabet - 1``; a row's texts are joined, nulls left out.
    """
    rows = df.select(*keep, F.array_join(texts, "").alias("text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("text").schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            raw = [bytes(c - first for c in t.encode("ascii")) for t in frame["text"]]
            coded = [encode_text(t, alphabet) for t in raw]
            same = [decode_text(c, len(t), alphabet) == t for c, t in zip(coded, raw, strict=True)]
            yield frame[keep].assign(symbols=[len(t) for t in raw], coded=coded, same=same)

    return rows.mapInPandas(run, f"{kinds}, symbols long, coded binary, same boolean")


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(own, context, symbol, n) of dinucleotides and, with ``own`` -1, of the N mask by position."""
    code = np.zeros(256, np.int64)
    for i, letters in enumerate(("Aa", "Cc", "Gg", "Tt")):
        code[[ord(c) for c in letters]] = i
    for batch in batches:
        column = batch.column(0).cast(pa.string()).drop_null()
        if not len(column):
            continue
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
        at = at - at[0]
        length = np.diff(at)
        text = code[raw]
        i = np.arange(len(raw)) - np.repeat(at[:-1], length)
        rest = np.repeat(length, length) - i
        before = np.zeros(len(raw), np.int64)
        for back in range(ORDER, 0, -1):
            earlier = np.concatenate((np.zeros(min(back, len(text)), np.int64), text[:-back])) if back < len(text) else np.zeros(len(text), np.int64)
            before = before * 4 + np.where(i >= back, earlier, 0)
        following = np.append(text[1:], 0) if len(text) else text
        starts = i % 2 == 0
        pair, last = starts & (rest > 1), starts & (rest == 1)
        own = np.where(pair & (i // 2 < OWN_TABLES), i // 2, OWN_TABLES)
        symbol = np.where(last, text, text * 4 + following)
        on = pair | last
        is_n = (raw == ord("N")) | (raw == ord("n"))
        columns = [np.concatenate(x) for x in ((own[on], np.full(len(raw), -1)), (before[on], i), (symbol[on], is_n.astype(np.int64)))]
        key = (columns[0] + 1) << 40 | columns[1] << 8 | columns[2]
        key, n = np.unique(key, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array((key >> 40) - 1), pa.array(key >> 8 & (1 << 32) - 1), pa.array(key & 255), pa.array(n)], ["own", "context", "symbol", "n"])


def dinucleotide_counts(df: DataFrame, seq: Column) -> DataFrame:
    """(own, context, symbol, n): two letters at a time after the 11 before them.

    The first four pairs of a read have tables of their own (``own`` 0..3), all
    others share one (4), as does the single letter at the end of an odd read.
    Letters other than A, C, G, T count as A.  ``own`` -1 is the mask of N, whose
    context is the position.
    """
    counted = df.select(seq.cast("string").alias("seq")).mapInArrow(_count_pairs, "own long, context long, symbol long, n long")
    return counted.groupBy("own", "context", "symbol").agg(F.sum("n").alias("n"))


def sequence_bits(df: DataFrame, seq: Column) -> DataFrame:
    """(part, symbols, bits) of ``pairs`` and ``n_mask`` under adaptive models."""
    counts = dinucleotide_counts(df, seq).withColumn("part", F.when(F.col("own") < 0, "n_mask").otherwise("pairs"))
    parts = []
    for part, alphabet in (("pairs", 16), ("n_mask", 2)):
        bits = adaptive_bits(counts.where(F.col("part") == part), ["own", "context"], "symbol", alphabet)
        parts.append(bits.agg(F.sum("symbols").alias("symbols"), F.sum("bits").alias("bits")).select(F.lit(part).alias("part"), "symbols", "bits"))
    return parts[0].unionByName(parts[1])


def quality_bits(counts: DataFrame, alphabet: int = 64) -> DataFrame:
    """(symbols, bits) of scores counted under their contexts (models.quality_context_counts)."""
    context = [c for c in counts.columns if c not in ("q", "n")]
    return adaptive_bits(counts, context, "q", alphabet).agg(F.sum("symbols").alias("symbols"), F.sum("bits").alias("bits"))


#: Token numbers with models of their own; later tokens share the last.
OWN_TOKENS = 20


def id_symbols(tokens: DataFrame) -> DataFrame:
    """(part, token_no, symbol): what is coded for each identifier token against the one before.

    ``tokens`` has token_no, token and previous.  Every token has a ``kind``;
    NUM_OFF adds an ``offset`` of 0..15, NUM the ``number`` in groups of seven
    bits, STR the length of the common ``prefix`` and the rest as ``text``, a
    letter at a time up to an end mark (0).
    """
    kind = ident.delta_kind("token", "previous")
    a, b = ident.number("token"), ident.number("previous")
    prefix = F.least(ident.common_prefix("token", "previous"), F.lit(ident.TOKEN_CAP))
    groups = F.greatest(F.lit(1), F.ceil(F.log2(a.cast("double") + 1) / 7)).cast("int")
    rest = F.substring(F.col("token"), prefix + 1, F.length("token"))
    letters = F.transform(F.filter(F.split(rest, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    one = lambda part, symbol: F.struct(F.lit(part).alias("part"), symbol.cast("long").alias("symbol"))
    number = F.array(*(F.lit(k) for k in ("MATCH", "NUM_OFF", "NUM", "STR")))
    parts = F.concat(
        F.array(one("kind", F.array_position(number, kind) - 1)),
        F.when(kind == "NUM_OFF", F.array(one("offset", a - b))).otherwise(F.array().cast("array<struct<part:string,symbol:bigint>>")),
        F.when(kind == "NUM", F.array(one("number", groups))).otherwise(F.array().cast("array<struct<part:string,symbol:bigint>>")),
        F.when(
            kind == "STR",
            F.concat(F.array(one("prefix", prefix)), F.transform(letters, lambda c: one("text", c)), F.array(one("text", F.lit(0)))),
        ).otherwise(F.array().cast("array<struct<part:string,symbol:bigint>>")),
    )
    return tokens.select(F.least("token_no", F.lit(OWN_TOKENS - 1)).alias("token_no"), F.inline(parts))


def id_bits(symbols: DataFrame) -> DataFrame:
    """(part, symbols, bits) of the parts of identifiers under adaptive models by token number.

    Numbers are written out, eight bits for seven of theirs.
    """
    counts = symbols.groupBy("part", "token_no", "symbol").agg(F.count("*").alias("n"))
    alphabets = {"kind": 4, "offset": 16, "prefix": ident.TOKEN_CAP + 1, "text": 256}
    out = counts.where("part = 'number'").groupBy("part").agg(F.sum("n").alias("symbols"), F.sum(F.col("n") * F.col("symbol") * 8.0).alias("bits"))
    for part, alphabet in alphabets.items():
        bits = adaptive_bits(counts.where(F.col("part") == part), ["token_no"], "symbol", alphabet)
        out = out.unionByName(bits.groupBy(F.lit(part).alias("part")).agg(F.sum("symbols").alias("symbols"), F.sum("bits").alias("bits")))
    return out
