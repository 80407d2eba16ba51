"""Quality rules: gradient-boosted trees over document statistics, behind two fixed base rules.

The trees are grown here with numpy on histograms of a bounded sample of labelled rows (``TRAIN_ROWS``), with monotonic
constraints on chosen features, and flattened into node arrays, so that a batch of documents is scored by a few array
steps per tree level.

Cases: null, empty and blank texts have no words and fail the base rules; very long texts are read whole; repeated rows
are judged each; labels that disagree about one doc_id count as their least quality, labels without a doc_id or quality
are left out; without both classes among the labels no tree is grown and the base rules decide alone; an empty table
gives no rows; other columns are kept by ``quality_filter`` and dropped by ``quality_statistics``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Labelled rows that the trees are grown on, at most; chosen by the hash of doc_id.
TRAIN_ROWS = 20_000
SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))
_UPPER, _DIGIT, _ALPHA = bytes(range(65, 91)), b"0123456789", bytes([*range(65, 91), *range(97, 123), *range(0xC0, 0x100)])
_MARKS = b"!\"'(),-./:;?@[]_{}~"

#: Features, with +1 where more of it may only raise the chance to be kept, -1 where it may only lower it.
FEATURES = {
    "n_words": 0, "word_length": 0, "symbol_ratio": -1, "dup_line_ratio": -1, "repeat_ratio": -1, "upper_ratio": -1,
    "digit_ratio": 0, "alpha_ratio": 0, "mark_ratio": 0, "distinct_ratio": 0, "line_words": 0, "symbol_words": -1,
}


def _points(b: bytes) -> int:
    return len(b.translate(None, _CONTINUATION))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which the text has at least twice."""
    if len(words) < 4:
        return 0
    known: dict[bytes, int] = {}
    a = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    key = a[:-1] * len(known) + a[1:]
    if len(known) >= 1 << 20:  # keep three words within 63 bits
        key = np.unique(key, return_inverse=True)[1]
    key = key[:-1] * len(known) + a[2:]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(words) + 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = twice[:-2].copy()
    covered[1:] |= twice[:-3]
    covered[2:] |= twice[:-4]
    return int(covered.sum())


def statistics(text: bytes) -> tuple[list[int], list[float]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the features."""
    words = text.split()  # of bytes: splits at \x20 and \x09-\x0D alone
    n, size = len(words), len(text)
    joined = b"".join(words)
    chars = _points(joined)
    symbols = size - len(text.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    lines = dup = 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            dup += line in seen
            seen.add(line)
    repeat = repeated_words(words)
    part = lambda drop: (len(joined) - len(joined.translate(None, drop))) / max(1, len(joined))
    features = [
        min(n, 5000), chars / max(1, n), symbols / max(1, chars), dup / max(1, lines), repeat / max(1, n), part(_UPPER), part(_DIGIT),
        part(_ALPHA), part(_MARKS), len(set(words)) / max(1, n), n / max(1, lines), symbols / max(1, n),
    ]
    return [n, chars, symbols, dup, repeat], features


@dataclass
class Trees:
    """Complete binary trees of one depth as flat arrays; node k's children are 2k+1 and 2k+2."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # go right above it
    value: np.ndarray  # trees x leaves
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """The chance of good quality, for each row of features."""
        total = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for f, t, v in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            while node.size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += v[node - inner]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, monotone: list[int], *, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, leaf: float = 5.0, ridge: float = 1.0) -> Trees:
    """Boosting on the logistic loss. Constraints: a split on a constrained feature is only taken if the two sides'
    values are in order, and the middle between them bounds what either side's descendants may say."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    rate0 = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    bias = float(np.log(rate0 / (1 - rate0)))
    raw = np.full(len(y), bias)
    inner, leaves = 2**depth - 1, 2**depth
    feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    for k in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        low, high = np.full(inner + leaves, -np.inf), np.full(inner + leaves, np.inf)
        said = np.zeros(inner + leaves)
        said[0] = np.clip(g.sum() / (h.sum() + ridge), low[0], high[0])
        for at in range(inner):
            rows = np.flatnonzero(node == at)
            best = (1e-9, None)
            gs, hs = g[rows].sum(), h[rows].sum()
            for j, e in enumerate(edges):
                if not len(e) or len(rows) < 2 * leaf:
                    continue
                b = binned[rows, j]
                gl = np.cumsum(np.bincount(b, g[rows], len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(b, h[rows], len(e) + 1))[:-1]
                nl = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
                vl = np.clip(gl / (hl + ridge), low[at], high[at])
                vr = np.clip((gs - gl) / (hs - hl + ridge), low[at], high[at])
                gain = vl * gl - vl**2 * (hl + ridge) / 2 + vr * (gs - gl) - vr**2 * (hs - hl + ridge) / 2
                gain = gain - (said[at] * gs - said[at] ** 2 * (hs + ridge) / 2)
                gain[(nl < leaf) | (len(rows) - nl < leaf) | ((vr - vl) * monotone[j] < 0)] = -1
                if gain.max() > best[0]:
                    i = int(gain.argmax())
                    best = (gain[i], (j, i, vl[i], vr[i]))
            left, right = 2 * at + 1, 2 * at + 2
            low[[left, right]], high[[left, right]] = low[at], high[at]
            said[[left, right]] = said[at]
            if best[1] is None:
                node[rows] = left  # and on to the left, as nothing is above infinity
                continue
            j, i, vl, vr = best[1]
            feature[k, at], threshold[k, at] = j, edges[j][i]
            said[left], said[right] = vl, vr
            if monotone[j]:
                middle = (vl + vr) / 2
                (high if monotone[j] > 0 else low)[left] = middle
                (low if monotone[j] > 0 else high)[right] = middle
            node[rows] = np.where(binned[rows, j] > i, right, left)
        value[k] = rate * said[inner:]
        raw += value[k][node - inner]
    return Trees(feature, threshold, value, bias)


STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _sample(labels: DataFrame, rows: int) -> DataFrame:
    one = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("_quality"))
    return one.withColumn("_by", F.xxhash64("doc_id")).orderBy("_by", "doc_id").limit(rows).select(F.col("doc_id").cast("long").alias("doc_id"), "_quality")


def train(docs: DataFrame, labels: DataFrame, *, rows: int = TRAIN_ROWS) -> Trees | None:
    """Trees from the labelled rows' statistics; None if they are not of both kinds. The sample is bounded by ``rows``,
    and so is what is broadcast and what comes to the driver."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.utf8().alias("text")).join(F.broadcast(_sample(labels, rows)), "doc_id")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = [statistics(t.as_py())[1] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_quality"), pa.array(f, pa.list_(pa.float64()))], ["doc_id", "quality", "f"])

    # A doc_id may repeat among the documents: the first by the hash order serve, rows at most.
    found = common.map_arrow(chosen, measured, "doc_id long, quality int, f array<double>").orderBy(F.xxhash64("doc_id"), "doc_id", "f").limit(rows).collect()
    x, y = np.array([r["f"] for r in found], float), np.array([float(r["quality"] > 0) for r in found])
    if len(found) < 20 or y.min() == y.max():
        return None
    return grow(x, y, list(FEATURES.values()))


def judged(docs: DataFrame, trees: Trees | None, threshold: float = 0.5) -> tuple[DataFrame, list[str]]:
    """All columns of docs with the statistics, base_failed, score and kept, and what these are called there."""
    utf8, *added = common.unused(docs, "utf8", *STATS, "base_failed", "score", "kept")
    types = [T.LongType()] * len(STATS) + [T.BooleanType(), T.DoubleType(), T.BooleanType()]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in zip(added, types))])
    width, names = len(docs.columns), [f.name for f in schema]

    def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [statistics(t.as_py()) for t in batch.column(width)]
            base = np.array([s for s, _ in both], np.int64).reshape(-1, len(STATS))
            failed = (base[:, 0] < 50) | (100 * base[:, 4] > 50 * base[:, 0])
            x = np.array([f for _, f in both], float).reshape(-1, len(FEATURES))
            score = trees.score(x) if trees else np.ones(len(both))
            columns = [*(batch.column(i) for i in range(width)), *(pa.array(c) for c in base.T), pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))]
            yield pa.RecordBatch.from_arrays(columns, names)

    return common.map_arrow(docs.withColumn(utf8, common.utf8()), verdicts, schema), added


def quality_statistics(docs: DataFrame, labels: DataFrame, *, rows: int = TRAIN_ROWS, threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, the base statistics, base_failed, score and kept."""
    seen, added = judged(docs.select("doc_id", "text"), train(docs, labels, rows=rows), threshold)
    return seen.select("doc_id", *added)


def quality_filter(docs: DataFrame, labels: DataFrame, *, rows: int = TRAIN_ROWS, threshold: float = 0.5) -> DataFrame:
    """The documents that are kept, with all their columns."""
    seen, added = judged(docs, train(docs, labels, rows=rows), threshold)
    return seen.where(F.col(added[-1])).select(*docs.columns)
