"""Language by nearest centroid over normalised TF-IDF vectors of letter n-grams.

Texts are lower-cased, runs of anything but letters become one space, and the trigrams of what is left are hashed into
``DIM`` counts. Document frequencies come from every learnable row. Centroids, several per language, come from
spherical k-means over a bounded sample per language (``PER_LANG``). A text gets the language of the nearest centroid
by cosine; beyond that centroid's own radius it is marked as rejected, as unlike all that was learned.

Cases: null text, and text without letters, is ``und`` with score 0; rows without lang are never learned from, nor rows
without doc_id; repeated rows are judged each; without anything to learn from all are ``und``; very long texts are read
whole; an empty table gives no rows; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

DIM = 4096
#: Documents that the centroids of one language are learned from, at most; chosen by the hash of doc_id.
PER_LANG = 300
CENTROIDS = 4

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def trigram_counts(text: str | None, dim: int = DIM) -> np.ndarray | None:
    """Hashed counts, or None if there is no letter."""
    points = np.frombuffer((" " + (text or "").lower() + " ").encode("utf-32-le"), "<u4")
    letter = _letters()[points]
    if not letter.any():
        return None
    a = np.where(letter, points, 32)
    a = a[np.concatenate([[True], letter[1:] | letter[:-1]])].astype(np.uint32)
    key = a[:-2] * np.uint32(0x9E3779B1) + a[1:-1] * np.uint32(0x85EBCA77) + a[2:] * np.uint32(0xC2B2AE3D)
    key ^= key >> np.uint32(15)
    return np.bincount((key * np.uint32(0x27D4EB2F)) >> np.uint32(32 - (dim.bit_length() - 1)), minlength=dim)


def vectors(texts: list, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows, and which texts have letters."""
    out = np.zeros((len(texts), len(idf)), np.float32)
    has = np.zeros(len(texts), bool)
    for i, text in enumerate(texts):
        counts = trigram_counts(text, len(idf))
        if counts is not None:
            at = np.flatnonzero(counts)
            v = (1 + np.log(counts[at])) * idf[at]
            norm = np.sqrt((v * v).sum())
            out[i, at] = v / norm if norm else 0
            has[i] = True
    return out, has


def held_out() -> Column:
    """True for a fifth of the documents, by doc_id alone; those without one are never learned from either."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def document_frequencies(docs: DataFrame, dim: int = DIM) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, and the texts: every task adds up its own, Spark the rest."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dim, np.int64), 0
        for batch in batches:
            for text in batch.column("text"):
                counts = trigram_counts(text.as_py(), dim)
                if counts is not None:
                    total += counts > 0
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim + 1)), pa.array(np.append(total, n))], ["bucket", "n"])

    sums = common.map_arrow(docs.select("text"), counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(dim + 1, np.int64)
    for row in sums.collect():  # dim + 1 rows
        out[row["bucket"]] = row["n"]
    return out[:dim], int(out[dim])


def sample(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """doc_id and lang of at most ``per_lang`` rows a language, taken first within salts of it, so that no task gets a
    whole language."""
    ids = docs.select("doc_id", "lang", F.xxhash64("doc_id").alias("by"))
    first = Window.partitionBy("lang", F.pmod("by", F.lit(64))).orderBy("by", "doc_id")
    ids = ids.withColumn("r", F.row_number().over(first)).where(F.col("r") <= per_lang)
    last = Window.partitionBy("lang").orderBy("by", "doc_id")
    return ids.withColumn("r", F.row_number().over(last)).where(F.col("r") <= per_lang).select("doc_id", F.col("lang").alias("_lang")).distinct()


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids, started far from one another, beginning with the row nearest to the mean."""
    start = [int((x @ x.mean(axis=0)).argmax())]
    near = x @ x[start[0]]
    while len(start) < min(k, len(x)):
        start.append(int(near.argmin()))
        near = np.maximum(near, x @ x[start[-1]])
    c = x[start].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        for j in range(len(c)):
            if (own == j).any():
                m = x[own == j].mean(axis=0)
                c[j] = m / max(np.linalg.norm(m), 1e-9)
    return c


class Centroids:
    def __init__(self, idf: np.ndarray, langs: list[str], centroids: np.ndarray, floor: np.ndarray):
        self.idf, self.langs, self.centroids, self.floor = idf, langs, centroids, floor

    def predict(self, texts: list) -> list[tuple[str, float, bool]]:
        x, has = vectors(texts, self.idf)
        if not self.langs:
            return [("und", 0.0, True)] * len(texts)
        cosines = x @ self.centroids.T
        best = cosines.argmax(axis=1)
        score = np.clip(cosines[np.arange(len(texts)), best], 0, 1).astype(float)
        return [(self.langs[b], s, bool(s < self.floor[b])) if h else ("und", 0.0, True) for b, s, h in zip(best.tolist(), score.tolist(), has.tolist())]


def train(docs: DataFrame, *, per_lang: int = PER_LANG, centroids: int = CENTROIDS, dim: int = DIM) -> Centroids:
    """Learn from the text and lang of documents that are not held out."""
    learnable = docs.where(F.col("lang").isNotNull() & ~held_out()).select("doc_id", "text", "lang")
    df, n = document_frequencies(learnable, dim)
    idf = np.log((1 + n) / (1 + df)) + 0.1
    chosen = learnable.drop("lang").join(F.broadcast(sample(learnable, per_lang)), "doc_id")
    chosen = chosen.groupBy("doc_id", "_lang").agg(F.min("text").alias("text"))  # a doc_id that repeats counts once

    def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, has = vectors(batch.column("text").to_pylist(), idf)
            rows = [r.tobytes() if h else None for r, h in zip(x, has)]
            yield pa.RecordBatch.from_arrays([batch.column("_lang"), pa.array(rows, pa.binary())], ["lang", "v"])

    got = common.map_arrow(chosen, compact, "lang string, v binary").where("v is not null")
    by_lang: dict[str, list[bytes]] = {}
    for row in got.toLocalIterator():  # per_lang rows a language
        by_lang.setdefault(row["lang"], []).append(bytes(row["v"]))
    names, found, floors = [], [], []
    for lang in sorted(by_lang):
        x = np.stack([np.frombuffer(v, np.float32) for v in sorted(by_lang[lang])])
        c = spherical_kmeans(x, centroids)
        cos = x @ c.T
        own = cos.argmax(axis=1)
        for j in range(len(c)):
            names.append(lang)
            found.append(c[j])
            mine = cos[own == j, j]
            floors.append(0.5 * float(np.quantile(mine, 0.01)) if len(mine) else 0.0)
    return Centroids(idf, names, np.stack(found) if found else np.zeros((0, dim), np.float32), np.array(floors))


def language_id(docs: DataFrame, model: Centroids | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score and rejected."""
    model = model or train(docs)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            out = [p for i in range(0, len(texts), 256) for p in model.predict(texts[i : i + 256])]
            lang, score, rejected = (list(c) for c in zip(*out)) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                ["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return common.map_arrow(rows, predicted, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
