"""Score arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null where a vector is null or zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def rrf(rank: Column, weight: float = 1.0, k: int = 60) -> Column:
    return F.lit(weight) / (F.lit(k) + rank)


def bounded(score: Column) -> Column:
    """Clamped to 0..1, and 0 where null."""
    return F.coalesce(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def source_similarity(vector: Column, relevance: Column) -> Column:
    return bounded(F.coalesce(vector, relevance, F.lit(0.0)))


def mission_score(similarity: Column, tag_ratio: Column, semantic: float = 0.85, tags: float = 0.15) -> Column:
    return F.lit(semantic) * F.greatest(F.lit(0.0), similarity) + F.lit(tags) * F.coalesce(tag_ratio, F.lit(0.0))


def half_up(value: Column, digits: int = 1) -> Column:
    """Rounding as floor(x * 10^digits + 0.5) / 10^digits."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5).cast("double") / scale


def rate(part: Column, whole: Column) -> Column:
    """Percent with one decimal; 0 of nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(half_up(part.cast("double") * 100 / whole))
