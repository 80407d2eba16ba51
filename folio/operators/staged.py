"""Hybrid retrieval as a staged trace: for every chunk that any stage saw, where it stood there and why it went no further.

The steps of ``retrieval.hybrid_retrieve`` are taken on one wide table, a row for each query and chunk with its rank at
every stage, so that both lists are searched once and nothing is computed again for an account of it. The trace is
written once; what judges retrieval (``evaluate.stage_summary``) reads it, and so does whoever wants the final rows.

Stages, in order: vector and lexical, the two ranked lists (named documents' chunks at the head of the second); fused,
the candidates; pool, what is scored; selected, after the cut; companion, from the same and the following page; backfill,
from the section pages that a query's words call for; final. ``dropped`` says why a row went no further: out of scope,
below fusion, not pooled, below the cut, replaced, already there, other document. It is null where the row goes on.

Cases: chunks that are not among the given ones, or that ``allowed`` does not hold for, are out of scope; a query in
neither list has no rows unless it has backfill; ties are broken by chunk_id; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from ..sources import tables
from . import retrieval, windows
from .retrieval import HybridConfig

STAGES = ("vector", "lexical", "fused", "pool", "selected", "companion", "backfill", "final")
_KEYS = ["query_id", "chunk_id"]


def ranks(vector: DataFrame, lexical_list: DataFrame, chunks: DataFrame, named: DataFrame | None = None, cfg: HybridConfig = HybridConfig(), relevance: Column | None = None, allowed: Column | None = None) -> DataFrame:
    """The wide table: query_id and chunk_id with document_id, page and chunk_index, in_scope, vector_rank, lexical_rank,
    fused_rank, pool_rank and place (null where the chunk is not of that stage), vector_score, text_score, rrf_score,
    relevance and score. All windows go over a query's rows, so they share one shuffle."""
    if named is not None:
        lexical_list = retrieval.prepended(retrieval.exact_family(named, chunks, cfg.candidates), lexical_list)
    none = F.lit(None)
    one = vector.select(*_KEYS, F.col("rank").alias("vector_rank"), F.col("score").alias("vector_score"), none.cast("bigint").alias("lexical_rank"), none.cast("double").alias("text_score"), scores.rrf(F.col("rank"), cfg.vector_weight, cfg.rrf_k).alias("part"))
    two = lexical_list.select(*_KEYS, none.cast("bigint").alias("vector_rank"), none.cast("double").alias("vector_score"), F.col("rank").alias("lexical_rank"), F.col("score").alias("text_score"), scores.rrf(F.col("rank"), cfg.text_weight, cfg.rrf_k).alias("part"))
    both = one.unionByName(two).groupBy(*_KEYS)
    both = both.agg(*[F.max(c).alias(c) for c in ("vector_rank", "vector_score", "lexical_rank", "text_score")], F.round(F.sum("part"), 9).alias("rrf_score"))
    ok = F.lit(True) if allowed is None else F.coalesce(allowed, F.lit(False))
    rows = both.join(chunks.select("chunk_id", "document_id", "page", "chunk_index", ok.alias("_allowed")), "chunk_id", "left")
    rows = rows.withColumn("in_scope", F.coalesce("_allowed", F.lit(False))).drop("_allowed")

    def numbered(rows: DataFrame, name: str, of: str, *order: Column | str) -> DataFrame:
        """``name``, the place among the query's rows for which ``of`` holds."""
        at = Window.partitionBy("query_id", of).orderBy(*order)
        return rows.withColumn(name, F.when(F.col(of), F.row_number().over(at).cast("bigint")))

    rows = numbered(rows, "fused_rank", "in_scope", F.desc("rrf_score"), "chunk_id")
    rows = rows.withColumn("_candidate", F.coalesce(F.col("fused_rank") <= cfg.candidates, F.lit(False)))
    by_page = Window.partitionBy("query_id", "_candidate", "document_id", "page").orderBy(F.desc_nulls_last("text_score"), "chunk_id")
    rows = rows.withColumn("_best", F.row_number().over(by_page) == 1)
    among = lambda *order: F.row_number().over(Window.partitionBy("query_id", "_candidate").orderBy(*order))
    rows = rows.withColumn("_reserved", F.col("_best") & (F.coalesce("text_score", F.lit(0.0)) > 0) & (among(F.desc(F.col("_best").cast("int")), F.desc_nulls_last("text_score"), "chunk_id") <= cfg.reserve))
    near = F.col("vector_score").isNotNull() & (among(F.desc_nulls_last("vector_score"), "chunk_id") <= cfg.safeguard)
    rows = rows.withColumn("_protected", F.col("_reserved") | (among(F.desc("rrf_score"), "chunk_id") <= cfg.safeguard) | near)
    first = lambda c: F.desc(F.col(c).cast("int"))
    rows = numbered(rows, "pool_rank", "_candidate", first("_protected"), F.desc("rrf_score"), "chunk_id")
    rows = rows.withColumn("_pooled", F.coalesce(F.col("pool_rank") <= cfg.pool, F.lit(False)))
    rows = rows.withColumn("relevance", F.when(F.col("_pooled"), scores.bounded(F.col("vector_score")) if relevance is None else relevance))
    rows = rows.withColumn("score", F.round(F.col("relevance") + F.lit(cfg.lexical_bonus) * F.coalesce("text_score", F.lit(0.0)), 6))
    rows = numbered(rows, "_safe", "_pooled", first("_protected"), F.desc("score"), "chunk_id")
    rows = numbered(rows, "place", "_pooled", first("_reserved"), "_safe", "chunk_id")
    return rows.select(
        *_KEYS, "document_id", "page", "chunk_index", "in_scope", "vector_rank", "lexical_rank", "fused_rank", F.when(F.col("_candidate"), F.col("pool_rank")).alias("pool_rank"),
        F.when(F.col("place") <= retrieval.final_count(cfg.top_k), F.col("place")).alias("place"), F.col("_candidate").alias("candidate"), F.col("_pooled").alias("pooled"),
        "vector_score", "text_score", "rrf_score", "relevance", "score",
    )


def finished(wide: DataFrame, chunks: DataFrame, named: DataFrame | None = None, backfill: DataFrame | None = None, cfg: HybridConfig = HybridConfig()) -> DataFrame:
    """From the selected rows to the final ones: query_id, chunk_id, beside (the place once companions have come in),
    filled (a backfilled row's place in its own list), there (the row was there already when backfill came) and
    final_rank, null where rows of a named document remain alone. backfill: query_id, chunk_id and place."""
    selected = wide.where("place is not null")
    candidates = wide.where("candidate").withColumn("rank", F.col("fused_rank"))
    rows = windows.with_companions(selected.withColumn("rank", F.col("place")), retrieval.companions(selected, candidates, chunks, cfg), chunks)
    rows = rows.select(*_KEYS, "document_id", F.col("place").alias("beside"))
    if backfill is None:
        rows = rows.withColumns({"filled": F.lit(None).cast("bigint"), "there": F.lit(False)})
    else:
        more = backfill.select(*_KEYS, F.col("place").cast("bigint").alias("filled")).join(chunks.select("chunk_id", F.col("document_id").alias("_document")), "chunk_id")
        rows = rows.join(more, _KEYS, "full_outer").withColumn("document_id", F.coalesce("document_id", "_document")).drop("_document")
        rows = rows.withColumn("there", F.col("beside").isNotNull() & F.col("filled").isNotNull())
    rows = rows.withColumn("_stays", F.lit(True))
    if named is not None:
        told = named.select("query_id", "document_id").distinct().withColumn("_named", F.lit(True))
        rows = rows.join(told, ["query_id", "document_id"], "left").withColumn("_named", F.coalesce("_named", F.lit(False)))
        rows = rows.withColumn("_stays", F.col("_named") | ~F.max("_named").over(Window.partitionBy("query_id"))).drop("_named")
    at = Window.partitionBy("query_id", "_stays").orderBy(F.asc_nulls_last("beside"), "filled", "chunk_id")
    return rows.withColumn("final_rank", F.when(F.col("_stays"), F.row_number().over(at).cast("bigint"))).drop("_stays", "document_id")


def account(wide: DataFrame, ended: DataFrame) -> DataFrame:
    """query_id, chunk_id, stage, rank, score and dropped, from the wide table and the final rows."""
    rows = wide.join(ended, _KEYS, "full_outer")
    reason = lambda *cases: F.coalesce(*[F.when(c, F.lit(r)) for c, r in cases])
    went = F.col("final_rank").isNotNull()
    listed = reason((~F.col("in_scope"), "out of scope"), (~F.col("candidate"), "below fusion"))
    stages = {
        "vector": (F.col("vector_rank"), F.col("vector_score"), listed),
        "lexical": (F.col("lexical_rank"), F.col("text_score"), listed),
        "fused": (F.when(F.col("candidate"), F.col("fused_rank")), F.col("rrf_score"), reason((~F.col("pooled"), "not pooled"))),
        "pool": (F.when(F.col("pooled"), F.col("pool_rank")), F.col("score"), reason((F.col("place").isNull(), "below the cut"))),
        "selected": (F.col("place"), F.col("score"), reason((F.col("beside").isNull() & F.col("filled").isNull(), "replaced"), (~went, "other document"))),
        "companion": (F.when(F.col("place").isNull(), F.col("beside")), F.lit(None).cast("double"), reason((~went, "other document"))),
        "backfill": (F.col("filled"), F.lit(None).cast("double"), reason((F.col("there"), "already there"), (~went, "other document"))),
        "final": (F.col("final_rank"), F.col("score"), F.lit(None).cast("string")),
    }
    steps = [F.struct(F.lit(n).alias("stage"), r.alias("rank"), s.alias("score"), d.alias("dropped")) for n, (r, s, d) in stages.items()]
    return rows.select(*_KEYS, F.explode(F.array(*steps)).alias("s")).select(*_KEYS, "s.*").where("rank is not null")


def trace(vector: DataFrame, lexical_list: DataFrame, chunks: DataFrame, named: DataFrame | None = None, cfg: HybridConfig = HybridConfig(), *, path: str, relevance: Column | None = None, allowed: Column | None = None, backfill: DataFrame | None = None) -> DataFrame:
    """Run all stages, write the trace to ``path``, by stage, and read it from there. The wide table goes to the shared
    scratch folder, as the last stages read it several times."""
    spark = vector.sparkSession
    wide = tables.stored(ranks(vector, lexical_list, chunks, named, cfg, relevance, allowed))
    within = chunks if allowed is None else chunks.where(allowed)
    if backfill is not None:
        backfill = backfill.join(within.select("chunk_id"), "chunk_id", "left_semi")
    account(wide, finished(wide, within, named, backfill, cfg)).write.partitionBy("stage").parquet(path)
    return spark.read.schema("query_id long, chunk_id long, rank long, score double, dropped string, stage string").parquet(path)
