"""Toxicity by two Kneser-Ney models, one of the toxic and one of the ordinary texts, over the letters of words.

A word's probability is the product of its letters', each given all letters before it, up to ``DEPTH`` letters of a word
with its end mark (its stem: what is cut off says nothing). Within a class a letter has its discounted count after that
beginning, and the mass that the discount frees goes to counts which both classes share: the same beginning in either
class, below it the number of different beginnings that the letter continues. So a rare form is judged by what is known
of its beginning, and past the point where neither class knows any more the two models agree.

A stem's evidence is the log-likelihood ratio of the classes. A text's evidence is its mean over all words, the two
strongest stems, and how many words, in all and in proportion, go beyond each of ``LEVELS``; a logistic link, fitted on
learnable rows that gave no counts, turns these into a score.

Counts are taken from every learnable labelled text, each different text once, and in a text each stem once. Stems'
frequencies come from all documents: the ``HEAD`` most frequent ones, a bounded table, are looked up where the text is
read, all others are joined by a shuffle, in which no stem is hot.

Cases: null, empty and letterless texts have no evidence at all and get the score of none; rows without doc_id are never
learned from and are held out; a doc_id with several labels, and equal texts with several, are toxic if at least half of
them say so; labels without doc_id or toxic are left out; of rows with the same text those of
the least doc_id give counts, and a row repeated as a whole counts each time; without both classes among the counted texts, or among the
linked ones, every score is 0; very long texts are read whole; repeated rows are scored each; an empty table gives no
rows; other columns are not carried.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Letters of a word, with its end mark, that make its stem.
DEPTH = 8
END = " "
DISCOUNT = 0.75
#: Log-likelihood ratios beyond which words are counted.
LEVELS = (1.0, 2.0, 3.0, 4.0, 5.0)
#: The most frequent stems, broadcast with their evidence.
HEAD = 100_000
#: Stems that a task counts before it passes them on.
HELD = 200_000
#: Labelled texts that are broadcast, at most; more are joined by a shuffle.
BROADCAST_TEXTS = 1_000_000
#: Rows that the link is fitted on, at most; chosen by the hash of doc_id.
LINK_ROWS = 20_000
_LETTERS = re.compile(r"[^\W\d_]+")


def stems(text: str) -> Counter:
    """How often each stem occurs."""
    return Counter([(w + END)[:DEPTH] for w in _LETTERS.findall(text.lower())])


def _remainder(divisor: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


def held_out() -> Column:
    """True for a third of the documents, by doc_id alone, and for those without one."""
    return F.coalesce(_remainder(3) == 1, F.lit(True))


def linked() -> Column:
    """Of the learnable documents a quarter, which the link is fitted on and which give no counts."""
    return F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / 3) % 4 == 0


def counted_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text_hash and cls (0 or 1): one row for each different learnable labelled text that gives counts."""
    one = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("toxic").alias("toxic"))
    rows = docs.where(~held_out() & ~linked()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(common.utf8()).alias("text_hash"))
    rows = rows.join(one, "doc_id")
    return rows.groupBy("text_hash").agg(F.min("doc_id").alias("doc_id"), (F.avg("toxic") >= 0.5).cast("int").alias("cls"))


def stem_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """stem, n (texts of all documents that have it), c0 and c1 (counted texts of each class that have it)."""
    chosen = common.stored(counted_texts(docs, labels), "counted")
    few = chosen.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(common.utf8()).alias("text_hash"))
    rows = rows.join(F.broadcast(chosen) if few else chosen, ["doc_id", "text_hash"], "left").select("text", "cls")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}

        def passed_on() -> pa.RecordBatch:
            numbers = np.array(list(held.values()), np.int64).reshape(-1, 3)
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), *(pa.array(c) for c in numbers.T)], ["stem", "n", "c0", "c1"])

        for batch in batches:
            for text, cls in zip(batch.column("text"), batch.column("cls").to_pylist()):
                for stem in stems(text.as_py()):
                    row = held.get(stem)
                    if row is None:
                        row = held[stem] = [0, 0, 0]
                    row[0] += 1
                    if cls is not None:
                        row[1 + cls] += 1
                if len(held) > HELD:
                    yield passed_on()
                    held.clear()
        yield passed_on()

    parts = common.map_arrow(rows, counted, "stem string, n long, c0 long, c1 long")
    return common.stored(parts.groupBy("stem").agg(*[F.sum(c).alias(c) for c in ("n", "c0", "c1")]), "stems")


def beginnings(counts: DataFrame) -> DataFrame:
    """The models as one table: beginning, delta (the log-likelihood ratio of its last letter after the others) and tail
    (that of any letter which neither class has seen after it). The beginning of nothing is the empty string."""
    known = counts.where("c0 + c1 > 0")
    parts = known.select("c0", "c1", F.explode(F.sequence(F.lit(0), F.length("stem"))).alias("size"), "stem")
    parts = parts.select(F.substring("stem", F.lit(1), F.col("size")).alias("beginning"), "c0", "c1")
    nodes = common.stored(parts.groupBy("beginning").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")), "beginnings")
    parent = F.expr("left(beginning, length(beginning) - 1)")
    letters = nodes.where("beginning <> ''").groupBy(F.expr("right(beginning, 1)").alias("letter")).agg(F.count("*").alias("continued"))
    every = nodes.where("beginning <> ''").count()
    base = letters.select("letter", (F.col("continued") / F.lit(every)).alias("base"))  # a row for each different letter
    below = nodes.where("beginning <> ''").groupBy(parent.alias("before")).agg(
        F.count_if(F.col("c0") > 0).alias("k0"), F.count_if(F.col("c1") > 0).alias("k1"), F.count("*").alias("k")
    )
    after = nodes.join(below, F.col("beginning") == F.col("before"), "left").na.fill(0, ["k0", "k1", "k"])
    after = common.stored(after.select("beginning", "c0", "c1", "k0", "k1", "k"), "after")
    # The mass that a class's discount frees after a beginning; all of it where the class has not seen the beginning.
    freed = lambda i: F.when(F.col(f"b{i}") > 0, F.lit(DISCOUNT) * F.col(f"k{i}") / F.col(f"b{i}")).otherwise(F.lit(1.0))
    before = after.select(F.col("beginning").alias("before"), F.col("c0").alias("b0"), F.col("c1").alias("b1"), "k0", "k1", "k")
    rows = nodes.where("beginning <> ''").withColumns({"before": parent, "letter": F.expr("right(beginning, 1)")})
    rows = rows.join(F.broadcast(base), "letter").join(before, "before")
    seen = F.col("b0") + F.col("b1")
    shared = F.greatest(F.col("c0") + F.col("c1") - DISCOUNT, F.lit(0.0)) / seen + F.lit(DISCOUNT) * F.col("k") / seen * F.col("base")
    chance = lambda i: F.when(F.col(f"b{i}") > 0, F.greatest(F.col(f"c{i}") - DISCOUNT, F.lit(0.0)) / F.col(f"b{i}")).otherwise(F.lit(0.0)) + freed(i) * F.col("shared")
    deltas = rows.withColumn("shared", shared).select("beginning", (F.log(chance(1)) - F.log(chance(0))).alias("delta"))
    tails = before.withColumnRenamed("before", "beginning").select("beginning", F.when(F.col("k") > 0, F.log(freed(1)) - F.log(freed(0))).otherwise(F.lit(0.0)).alias("tail"))
    return tails.join(deltas, "beginning", "left").select("beginning", F.coalesce("delta", F.lit(0.0)).alias("delta"), "tail")


def evidence(counts: DataFrame) -> DataFrame:
    """stem, n and ratio: the sum of its known letters' log-likelihood ratios, and what its first unknown one adds."""
    model = common.stored(beginnings(counts), "model")
    parts = counts.select("stem", "n", F.explode(F.sequence(F.lit(0), F.length("stem"))).alias("size"))
    parts = parts.withColumn("beginning", F.substring("stem", F.lit(1), F.col("size")))
    # The empty beginning is every stem's: its tail is a single value, and not joined.
    root = F.lit(model.where("beginning = ''").first()["tail"])
    found = parts.where("size > 0").join(model.where("beginning <> ''"), "beginning", "left")
    sums = found.groupBy("stem").agg(
        F.first("n").alias("n"), F.sum("delta").alias("sum"), F.max_by("tail", F.when(F.col("tail").isNotNull(), F.col("size"))).alias("tail"),
        F.max(F.when(F.col("tail").isNotNull(), F.col("size"))).alias("known"),
    )
    last = F.when(F.coalesce("known", F.lit(0)) < F.length("stem"), F.coalesce("tail", root)).otherwise(F.lit(0.0))
    return common.stored(sums.select("stem", "n", F.round(F.coalesce("sum", F.lit(0.0)) + last, 9).alias("ratio")), "evidence")


def _sums(pairs: list[tuple[int, float]]) -> tuple[float, list[int], list[float]]:
    """Of (count, ratio): the sum, the words beyond each level, and the two greatest ratios."""
    total, beyond, top = 0.0, [0] * len(LEVELS), [0.0, 0.0]
    for n, r in pairs:
        total += n * r
        if r > LEVELS[0]:
            for i, level in enumerate(LEVELS):
                if r > level:
                    beyond[i] += n
        if r > top[1]:
            top = [r, top[0]] if r > top[0] else [top[0], r]
    return total, beyond, top


def features(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, held_out and x: the mean ratio, for each level the logarithm of the number of words beyond it and the
    square root of their share, and the mean of the two greatest ratios. ``found`` is the evidence of stems."""
    head = found.orderBy(F.desc("n"), "stem").limit(HEAD)
    table = {r["stem"]: r["ratio"] for r in head.collect()}
    shared = docs.sparkSession.sparkContext.broadcast(table)
    schema = "row long, doc_id long, held_out boolean, words long, total double, beyond array<long>, top array<double>, stem array<string>, times array<long>"

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for text in batch.column("text"):
                have, rest = [], {}
                for stem, n in stems(text.as_py()).items():
                    r = known.get(stem)
                    if r is None:
                        rest[stem] = n
                    else:
                        have.append((n, r))
                words = sum(n for n, _ in have) + sum(rest.values())
                for column, value in zip(out, (words, *_sums(have), list(rest), list(rest.values()))):
                    column.append(value)
            kinds = [pa.int64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.string()), pa.list_(pa.int64())]
            columns = [batch.column(c) for c in ("row", "doc_id", "held_out")] + [pa.array(v, k) for v, k in zip(out, kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "held_out", "words", "total", "beyond", "top", "stem", "times"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    rows = common.stored(common.map_arrow(rows, looked_up, schema), "looked_up")
    rare = rows.select("row", F.explode(F.arrays_zip("stem", "times")).alias("s")).select("row", F.col("s.stem").alias("stem"), F.col("s.times").alias("times"))
    rare = rare.join(found.select("stem", "ratio"), "stem")
    ratio = F.greatest("ratio", F.lit(0.0))
    # Stems of a text are told apart by themselves, so the two greatest come from the greatest and the next in order.
    most = F.slice(F.reverse(F.array_sort(F.collect_list(F.when(ratio > 0, ratio)))), 1, 2)
    sums = rare.groupBy("row").agg(
        F.sum(F.col("times") * F.col("ratio")).alias("more"), most.alias("most"),
        F.array(*[F.sum(F.when(F.col("ratio") > level, F.col("times")).otherwise(F.lit(0))) for level in LEVELS]).alias("others"),
    )
    both = rows.drop("stem", "times").join(sums, "row", "left")
    words = F.greatest("words", F.lit(1))
    beyond = [F.col("beyond")[i] + F.coalesce(F.col("others")[i], F.lit(0)) for i in range(len(LEVELS))]
    top = F.slice(F.reverse(F.array_sort(F.concat("top", F.coalesce("most", F.array().cast("array<double>"))))), 1, 2)
    x = [(F.col("total") + F.coalesce("more", F.lit(0.0))) / words, *[F.log1p(b) for b in beyond], *[F.sqrt(b / words) for b in beyond], (top[0] + top[1]) / 2]
    return common.stored(both.select("doc_id", "held_out", F.array(*[c.cast("double") for c in x]).alias("x")), "features")


def link(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float] | None:
    """Weights and bias of a logistic regression on the features as they are; None without both classes."""
    if not len(y) or y.min() == y.max():
        return None
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * w)
    weights = w[1:] / scale
    return weights, float(w[0] - weights @ mean)


def fitted(seen: DataFrame, labels: DataFrame, rows: int = LINK_ROWS) -> tuple[np.ndarray, float] | None:
    """The link, from at most so many learnable rows that gave no counts."""
    one = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    got = seen.where(~F.col("held_out") & linked()).join(one, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(rows).collect()
    return link(np.array([r["x"] for r in got], float).reshape(len(got), -1), np.array([float(r["toxic"]) for r in got]))


def toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, rows: int = LINK_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 from the threshold on) and ratio, the mean
    log-likelihood ratio of its words."""
    counts = stem_counts(docs, labels)
    classes = counts.agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).first()
    if not classes["c0"] or not classes["c1"]:
        nothing = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"))
        return nothing.select("*", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.lit(0.0).alias("ratio"))
    seen = features(docs, evidence(counts))
    model = fitted(seen, labels, rows)
    if model is None:
        score = F.lit(0.0)
    else:
        logit = F.lit(model[1])
        for i, w in enumerate(model[0]):
            logit = logit + F.lit(float(w)) * F.col("x")[i]
        score = F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))
    scored = seen.select("doc_id", "held_out", F.round(score, 9).alias("score"), F.col("x")[0].alias("ratio"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "ratio")
