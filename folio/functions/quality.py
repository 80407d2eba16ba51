"""Checks of drafted text, as column expressions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx

#: What counts as a factual value.
FACTUAL = [r"[0-9]+(?:[.,][0-9]+)? ?%", r"[0-9]{1,4}[/.-][0-9]{1,2}[/.-][0-9]{2,4}", r"[0-9]+ ?(?:EUR|€|K€|M€)", r"[A-Z]{2,}"]
#: Parts of warnings that are hard violations.
HARD = ["invented", "unknown source", "uncited", "leak", "duplicate claim", "missing section", "invalid table"]


def factual_values(text: Column) -> Column:
    """How many percentages, dates, amounts and acronyms a text has."""
    return reduce(lambda a, b: a + b, [F.regexp_count(text, F.lit(p)) for p in FACTUAL]).cast("bigint")


def boilerplate(text: Column, phrases: list[str]) -> Column:
    folded = tx.fold(text)
    return reduce(lambda a, b: a + b, [F.contains(folded, F.lit(p)).cast("bigint") for p in phrases])


def information_density(text: Column) -> Column:
    """Numbers and acronyms per 100 words."""
    return F.lit(100.0) * F.regexp_count(text, F.lit(r"[0-9]+(?:[.,][0-9]+)?|[A-Z]{2,}")) / F.greatest(F.lit(1), tx.word_count(text))


def plain_text(html: Column) -> Column:
    """Without comments and tags, common entities decoded, blanks collapsed."""
    out = F.regexp_replace(F.regexp_replace(html, "<!--[^>]*-->", " "), "<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[ \t\n\r]+", " "))


def contains_all(text: Column, fragments: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.contains(text, F.lit(f)) for f in fragments])


def contains_any(text: Column, fragments: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(f)) for f in fragments])


def strict_json(raw: Column) -> Column:
    """One JSON object and nothing around it."""
    return raw.rlike(r"(?s)^\{.*\}$") & F.try_parse_json(raw).isNotNull()


def low_information(sentence: Column) -> Column:
    """Fewer than three words, dotted leaders, or up to seven words without digit or punctuation."""
    n = tx.word_count(sentence)
    return (n < 3) | sentence.rlike(r"\.{4,}|_{4,}") | ((n <= 7) & ~sentence.rlike(r"[0-9.:;!?]"))


def is_hard(message: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(F.lower(message), F.lit(m)) for m in HARD])


def supported(sentence_terms: Column, quote_terms: Column) -> Column:
    """Enough terms in common: a third of the sentence's, one at least, two at most."""
    need = F.greatest(F.lit(1), F.least(F.lit(2), F.floor(F.size(sentence_terms) / 3)))
    return F.size(F.array_intersect(sentence_terms, quote_terms)) >= need


def truncated_sentences(text: Column, most: int = 25) -> Column:
    """Sentences cut to ``most`` words."""
    return F.array_join(F.transform(tx.sentences(text), lambda s: F.when(tx.word_count(s) <= most, s).otherwise(F.concat(F.array_join(F.slice(tx.words(s), 1, most), " "), F.lit("…")))), " ")


def repeated_gram_ratio(docs: DataFrame, key: str, size: int = 8) -> DataFrame:
    """Share of words in runs of ``size`` words that a document has twice; 0 for documents of fewer than twice the size.

    A document's runs are compared within its row, by hashes of its words: nothing is shuffled.
    """
    factors = np.random.default_rng(size).integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for words in batch.column("_words"):
                h = np.asarray(words.values, np.int64).view(np.uint64) if words.is_valid else np.empty(0, np.uint64)
                covered = np.zeros(len(h) + 1, np.int64)
                if len(h) >= 2 * size:
                    runs = sum(h[i : len(h) - size + 1 + i] * f for i, f in enumerate(factors))
                    _, own, times = np.unique(runs ^ (runs >> np.uint64(31)), return_inverse=True, return_counts=True)
                    twice = np.flatnonzero(times[own] > 1)
                    np.add.at(covered, twice, 1)
                    np.add.at(covered, twice + size, -1)
                out.append(round(float((np.cumsum(covered[:-1]) > 0).sum()) / max(1, len(h)), 6))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(out, pa.float64())], [key, "ratio"])

    hashed = F.transform(tx.words(F.lower("text")), lambda w: F.xxhash64(w)).alias("_words")
    rows = docs.select(key, hashed)
    return rows.mapInArrow(ratios, T.StructType([rows.schema[key], T.StructField("ratio", T.DoubleType())]))
