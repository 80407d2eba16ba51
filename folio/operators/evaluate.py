"""Evaluation of retrieval and answers against golden cases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text


def first_ranks(ranked: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Per case and stage the rank of the first expected row; null where none came up. ranked: case_id, stage, rank and
    the keys; expected: case_id and the keys. Cases without any ranked row count in every stage."""
    stages = ranked.select("stage").distinct()
    cases = expected.select("case_id").distinct()
    hits = ranked.join(expected.select("case_id", *keys).distinct(), ["case_id", *keys]).groupBy("case_id", "stage").agg(F.min("rank").alias("first"))
    # Stages are a handful of names: one literal array instead of a join of all with all.
    names = sorted(r["stage"] for r in stages.collect())
    every = cases.select("case_id", F.explode(F.array(*[F.lit(n) for n in names])).alias("stage"))
    return every.join(hits, ["case_id", "stage"], "left")


def labelled_hits(ranked: DataFrame, chunks: DataFrame, labels: list[str]) -> DataFrame:
    """The ranked rows (case_id, stage, chunk_id, rank) whose chunk is another with the labels of the case's own. Only
    ranked rows are looked at, never the pairs of a label's members."""
    own = chunks.select(F.col("chunk_id").alias("case_id"), *[F.col(c).alias(f"_{c}") for c in labels])
    same = [F.col(c) == F.col(f"_{c}") for c in labels]
    rows = ranked.join(own, "case_id").join(chunks.select("chunk_id", *labels), "chunk_id")
    return rows.where(reduce(lambda a, b: a & b, same, F.col("case_id") != F.col("chunk_id"))).select("case_id", "stage", "chunk_id", "rank")


def labelled_cases(cases: DataFrame, chunks: DataFrame, labels: list[str]) -> DataFrame:
    """case_id and how many other chunks have the case's labels, for cases with one at least."""
    sizes = chunks.groupBy(*labels).agg((F.count("*") - 1).alias("expected"))
    return cases.join(sizes, labels).where("expected > 0").select("case_id", "expected")


def labelled_first_ranks(ranked: DataFrame, cases: DataFrame, chunks: DataFrame, labels: list[str]) -> DataFrame:
    """Per case and stage the rank of the first hit; null where none came up. cases: case_id and the labels."""
    hits = labelled_hits(ranked, chunks, labels).groupBy("case_id", "stage").agg(F.min("rank").alias("first"))
    names = sorted(r["stage"] for r in ranked.select("stage").distinct().collect())  # a handful of names
    every = labelled_cases(cases, chunks, labels).select("case_id", F.explode(F.array(*[F.lit(n) for n in names])).alias("stage"))
    return every.join(hits, ["case_id", "stage"], "left")


def labelled_recall(ranked: DataFrame, cases: DataFrame, chunks: DataFrame, labels: list[str], ks: list[int]) -> DataFrame:
    """Share of each case's labelled chunks within rank k of one stage."""
    first = labelled_hits(ranked, chunks, labels).groupBy("case_id", "chunk_id").agg(F.min("rank").alias("rank"))
    found = first.groupBy("case_id").agg(*[F.count_if(F.col("rank") <= k).alias(f"_{k}") for k in ks])
    rows = labelled_cases(cases, chunks, labels).join(found, "case_id", "left")
    return rows.select("case_id", *[F.round(F.coalesce(F.col(f"_{k}"), F.lit(0)) / F.col("expected"), 6).alias(f"recall_at_{k}") for k in ks])


def stage_summary(firsts: DataFrame) -> DataFrame:
    """Recall at 5 and 10, mean reciprocal rank and cases, over all cases."""
    within = lambda k: F.round(F.avg(F.coalesce(F.col("first") <= k, F.lit(False)).cast("int")), 6)
    mrr = F.round(F.avg(F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0))), 6)
    return firsts.groupBy("stage").agg(within(5).alias("recall_at_5"), within(10).alias("recall_at_10"), mrr.alias("mrr"), F.count("first").alias("found"), F.count("*").alias("cases"))


def recall_at(ranked: DataFrame, expected: DataFrame, keys: list[str], ks: list[int]) -> DataFrame:
    """Share of each case's expected rows within rank k."""
    want = expected.select("case_id", *keys).distinct()
    seen = ranked.groupBy("case_id", *keys).agg(F.min("rank").alias("rank"))
    rows = want.join(seen, ["case_id", *keys], "left")
    return rows.groupBy("case_id").agg(*[F.round(F.avg(F.coalesce(F.col("rank") <= k, F.lit(False)).cast("int")), 6).alias(f"recall_at_{k}") for k in ks])


def containment(docs: DataFrame, quotes: DataFrame, run: int = 4) -> DataFrame:
    """Pairs (item_id, doc_id) where the text contains the quote.

    A contained quote's inner words are words of the text, so a text that holds it has the quote's second to fifth word
    in a row: those are looked up by hash, and only then are texts compared. Quotes too short for that are joined to
    texts by their longest inner word or, without one, compared with all texts, as there is nothing to look up.
    """
    q = quotes.select("item_id", "quote", text.words(F.col("quote")).alias("w"))
    long = q.where(F.size("w") >= run + 2).select("item_id", "quote", F.xxhash64(*[F.get("w", F.lit(i)) for i in range(1, run + 1)]).alias("h"))
    d = docs.select("doc_id", "text", text.words(F.col("text")).alias("w")).where(F.size("w") >= run)
    spots = d.select("doc_id", "text", "w", F.explode(F.sequence(F.lit(0), F.size("w") - run)).alias("i"))
    near = spots.select("doc_id", "text", F.xxhash64(*[F.get("w", F.col("i") + k) for k in range(run)]).alias("h")).join(long, "h")
    found = near.where(F.contains("text", F.col("quote"))).select("item_id", "doc_id").distinct()
    short = q.where((F.size("w") < run + 2) & (F.length("quote") > 0)).select("item_id", "quote")
    if short.limit(1).count():
        found = found.unionByName(docs.join(short, F.contains(docs["text"], short["quote"])).select("item_id", "doc_id")).distinct()
    return found


def answer_scores(rows: DataFrame) -> DataFrame:
    """Factual scoring of answers against expected ones: rows with expected and answer. Correct means 85 % of the expected
    terms and no missing number."""
    rows = rows.withColumns({"want": text.terms(F.col("expected")), "have": text.terms(F.col("answer")), "facts": text.numeric_facts(F.col("expected"))})
    recall = F.try_divide(F.size(F.array_intersect("want", "have")).cast("double"), F.size("want"))
    missing = F.array_except("facts", text.numeric_facts(F.col("answer")))
    return rows.withColumns({"term_recall": F.round(F.coalesce(recall, F.lit(0.0)), 6), "missing_numbers": F.size(missing).cast("bigint")}).withColumn("correct", (F.col("term_recall") >= 0.85) & (F.col("missing_numbers") == 0))


def golden_violations(golden: DataFrame, chunks: DataFrame) -> DataFrame:
    """Golden rows (case_id, chunk_id, document, quote) against the live chunks: what is wrong with each."""
    rows = golden.join(chunks.select("chunk_id", F.col("document").alias("live_document"), "content"), "chunk_id", "left")
    missing = F.col("content").isNull()
    found = F.array_compact(
        F.array(F.when(missing, "missing chunk"), F.when(~missing & ~F.equal_null("document", "live_document"), "wrong document"), F.when(~missing & ~F.contains("content", F.col("quote")), "quote not contained"))
    )
    return rows.select("case_id", "chunk_id", F.array_join(found, "; ").alias("violations"))
