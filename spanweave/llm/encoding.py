"""Encoding of a corpus with a public tokenizer, and its inverse.

Null and empty texts have the empty list of ids; each input row gives one output row.
A narrow map: no shuffle, whole texts, memory of one Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import DEFAULT_VOCABULARY, encoder


def encode(df: DataFrame, key: str, text: str, vocabulary: str = DEFAULT_VOCABULARY, out: str = "ids") -> DataFrame:
    """``key`` and the list of token ids of ``text``, for every row of ``df``.

    Null or empty text: the empty list. Repeated keys: one row each. Null keys stay null.
    Other columns are ignored, whatever their names."""
    small = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            rows = batch.column(1)
            for at in range(0, len(rows), 2000):
                ends, flat = [0], []
                for t in rows.slice(at, 2000).to_pylist():
                    flat.extend(enc.encode(t))
                    ends.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(flat, np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 2000), ids], ["k", "i"])

    kind = small.schema["k"].dataType.simpleString()
    return small.mapInArrow(run, f"k {kind}, i array<int>").select(F.col("k").alias(key), F.col("i").alias(out))


def lengths(df: DataFrame, key: str, text: str, vocabulary: str = DEFAULT_VOCABULARY, out: str = "n_tokens") -> DataFrame:
    """``key`` and the number of tokens of ``text`` (0 for null or empty) for every row."""
    small = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            n = pa.array([enc.count(t) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n], ["k", "n"])

    kind = small.schema["k"].dataType.simpleString()
    return small.mapInArrow(run, f"k {kind}, n long").select(F.col("k").alias(key), F.col("n").alias(out))


def decode(df: DataFrame, key: str, ids: str, vocabulary: str = DEFAULT_VOCABULARY, out: str = "text") -> DataFrame:
    """``key`` and the text of the token ids, gathered through the vocabulary's offset
    table. A null or empty list gives the empty text; bytes that are no UTF-8 give U+FFFD."""
    small = df.select(F.col(key).alias("k"), F.col(ids).cast("array<int>").alias("i"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            texts = [enc.decode_bytes(np.asarray(x or [], np.int64)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["k", "t"])

    kind = small.schema["k"].dataType.simpleString()
    return small.mapInArrow(run, f"k {kind}, t string").select(F.col("k").alias(key), F.col("t").alias(out))
