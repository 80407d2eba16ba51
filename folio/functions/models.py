"""Seams for models: encoders and scorers that run over Arrow batches, with defaults that need no weights."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text


class Encoder(Protocol):
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashedTerms:
    """Signed hashed term counts, scaled to unit length: the default encoder."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % self.dim] += 1 if h >> 16 & 1 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def embedded(rows: DataFrame, encoder: Encoder, column: str = "text", out: str = "embedding", batch: int = 50) -> DataFrame:
    """Adds the vectors of a text column, ``batch`` texts at a time; null text has the vector of an empty one."""
    names = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [v or "" for v in b.column(column).to_pylist()]
            parts = [encoder.encode(values[i : i + batch]) for i in range(0, len(values), batch)]
            flat = np.concatenate(parts) if parts else np.zeros((0, encoder.dim), np.float32)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(list(flat), pa.list_(pa.float32()))], [*names, out])

    return rows.mapInArrow(run, schema)


def overlap_score(query: Column, passage: Column) -> Column:
    """The default scorer: the share of the query's terms that the passage has."""
    want = text.terms(query)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(want, text.terms(passage))).cast("double"), F.size(want)), F.lit(0.0))
