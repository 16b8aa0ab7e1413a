"""Text sizes in tokens of a public byte-level tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the published splitting pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoder(vocabulary: str, pattern: str = PATTERN):
    """A tiktoken encoding of a file of base64 tokens and ranks."""
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _count(vocabulary: str, pattern: str, piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary, pattern)
        for batch in batches:
            counts = []
            for text in batch.column(0).to_pylist():
                counts.append(sum(len(coder.encode_ordinary(p)) for p in _portions(text or "", piece)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(counts, pa.int64())], [*batch.schema.names[1:], "n_tokens"])

    return run


def _portions(text: str, size: int) -> Iterator[str]:
    """Very long texts in portions, cut before a space so that no token is split."""
    at = 0
    while len(text) - at > size:
        stop = text.rfind(" ", at + 1, at + size)
        while stop > at and text[stop - 1].isspace():
            stop -= 1
        if stop <= at:
            stop = at + size
        yield text[at:stop]
        at = stop
    yield text[at:]


def token_counts(
    df: DataFrame, text: Column, keep: list[Column], vocabulary: str, pattern: str = PATTERN, portion: int = 1 << 20
) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` of every row.

    ``vocabulary`` is a file that every executor can read.

    A null or empty text has 0 tokens.  Texts beyond ``portion`` letters are
    counted in portions cut before a space.  Only ``keep`` travels on.
    """
    rows = df.select(text.cast("string").alias("__text"), *keep)
    kept = rows.drop("__text").schema
    return rows.mapInArrow(_count(vocabulary, pattern, portion), ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "n_tokens long"]))
