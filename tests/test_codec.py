"""Range coder, packed forms and code lengths against direct computation."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandloom.functions import packing
from strandloom.operators import codec, models


@given(st.lists(st.integers(0, 6), max_size=400), st.integers(0, 1))
@settings(max_examples=60, deadline=None)
def test_coder_round_trip(symbols, order):
    text = bytes(symbols)
    assert codec.decode_text(codec.encode_text(text, 7, order), len(text), 7, order) == text


def test_coder_reaches_the_code_length():
    random.seed(1)
    text = bytes(random.choices(range(40), [1 / (i + 1) for i in range(40)], k=30_000))
    model, bits = codec.Model(40), 0.0
    for s in text:
        bits -= math.log2(model.shares[s] / model.total)
        model.saw(s)
    assert bits / 8 <= len(codec.encode_text(text, 40, 0)) <= bits / 8 * 1.001 + 8
    assert len(codec.encode_text(b"\0" * 100_000, 94)) < 200


def test_model_halves_and_waits():
    model = codec.Model(4, rate=8, delay=3)
    for _ in range(2):
        model.saw(0)
    assert model.shares == [1, 1, 1, 1]
    model.saw(0)
    assert model.shares == [25, 1, 1, 1] and model.total == 28
    for _ in range(5000):
        model.saw(1)
    assert model.total <= codec.HALVE_AT + 3 * 8 and min(model.counts) >= 1


def test_halving_bits_with_delay(spark):
    symbols = [random.Random(4).choice([0, 0, 0, 1, 2]) for _ in range(300)]
    df = spark.createDataFrame([("c", i, s) for i, s in enumerate(symbols)], "c string, i long, s int")
    (got,) = models.halving_bits(df, ["c"], ["i"], "s", 4, delay=5).collect()
    model, bits = codec.Model(4, delay=5), 0.0
    for s in symbols:
        bits -= math.log2(model.shares[s] / model.total)
        model.saw(s)
    assert abs(got["bits"] - bits) < 1e-9


def test_packed_sequences(spark):
    random.seed(2)
    seqs = ["", "A", "ACG", "acgt", "T" * 31, "G" * 32, "C" * 33, "ACNT", "".join(random.choices("ACGT", k=200)), None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "i long, s string")
    got = {r[0]: r[1:] for r in df.select("i", packing.unpack2(packing.pack2("s"), F.length("s")), F.octet_length(packing.pack2("s"))).collect()}
    for i, s in enumerate(seqs):
        want = None if s is None else "".join(c if c in "ACGT" else "A" for c in s.upper())
        assert got[i] == (want, None if s is None else -(-len(s) // 4)), s


def test_integers(spark):
    values = [0, 1, 127, 128, 16383, 16384, 2**31, 2**32 - 1, 2**56, 2**63 - 1, -1, None]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for r in df.select("v", packing.varint("v").alias("a"), packing.big_endian("v", 4).alias("b"), packing.big_endian("v", 8).alias("c"), packing.from_varint(packing.varint("v")).alias("d")).collect():
        v = r["v"]
        if v is None or v < 0:
            assert r["a"] is None and r["b"] is None and r["c"] is None
            continue
        out, rest = [], v
        while rest > 127:
            out.append(rest & 127 | 128)
            rest >>= 7
        assert bytes(r["a"]) == bytes([*out, rest]) and r["d"] == v and bytes(r["c"]) == v.to_bytes(8, "big")
        assert (r["b"] is None) == (v >= 2**32) and (r["b"] is None or bytes(r["b"]) == v.to_bytes(4, "big"))


@pytest.mark.parametrize("text", ["", "A", "AC", "ACG", "ACGTNACGTACGTNNAC", "acgtacgtacgtacg"])
def test_pairs_follow_the_letters(spark, text):
    got = {(r["own"], r["context"], r["symbol"]): r["n"] for r in codec.dinucleotide_counts(spark.createDataFrame([(text,)], "s string"), F.col("s")).collect()}
    code, want = ["ACGT".find(c) if c in "ACGT" else 0 for c in text.upper()], {}
    for i in range(0, len(code), 2):
        context = 0
        for c in code[max(0, i - 11) : i]:
            context = context * 4 + c
        pair = i + 1 < len(code)
        key = (i // 2 if pair and i < 8 else 4, context, code[i] * 4 + code[i + 1] if pair else code[i])
        want[key] = want.get(key, 0) + 1
    for i, c in enumerate(text):
        want[-1, i, int(c in "Nn")] = 1
    assert got == want
