"""Ranked retrieval for tables of queries: vector candidates, fusion with lexical ones, selection by page."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from ..session import sound
from . import windows

#: Queries in one block, and vectors in one pack that is compared with it.
BLOCK, PACK = 2048, 4096
#: So many blocks are broadcast at a time; for more, the packs are gone through again.
WAVE = 16
#: Sampled vectors that the others are grouped around, and bytes of vectors that a task groups at a time.
PIVOTS, HELD_BYTES = 256, 64 << 20


def _ranked(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    at = Window.partitionBy("query_id").orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(at).cast("bigint")).where(F.col("rank") <= k)


def nearest(queries: DataFrame, chunks: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """The k most similar chunks per query by cosine: query_id, chunk_id, score and rank; ties by chunk_id.

    queries has query_id and embedding, chunks chunk_id and embedding. Queries are packed into blocks of about ``BLOCK``.
    Vectors are packed where they are read, around the nearest of ``PIVOTS`` sampled ones, each pack with its centre and
    the angle to its farthest member, so that no member can be nearer to a query than their difference from the query's
    angle to the centre. A task visits its packs in the order of these bounds, keeps the k best of each query, and leaves
    out the queries whose k-th best a pack cannot beat. Spark ranks what the tasks kept: k rows a query and task.
    """
    spark = sound(chunks.sparkSession)
    asked = queries.where(F.col("embedding").isNotNull()).select("query_id", "embedding")
    n = max(1, -(-asked.count() // BLOCK))
    numbered = asked.select(F.pmod(F.xxhash64("query_id"), F.lit(n)).cast("int").alias("block"), F.struct("query_id", "embedding").alias("q"))
    blocks = numbered.groupBy("block").agg(F.collect_list("q").alias("qs")).select("block", F.col("qs.query_id").alias("query_id"), F.flatten("qs.embedding").alias("q"))
    there = chunks.where(F.col("embedding").isNotNull()).select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    sample = there.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(PIVOTS).collect()
    held = spark.sparkContext.broadcast(np.array([r["embedding"] for r in sample], np.float64))
    packs = there.mapInArrow(lambda b: _packed(b, held.value), "chunk_id array<long>, x array<double>, center array<double>, spread double")
    found = None
    for wave in range(-(-n // WAVE)):
        first, last = wave * WAVE, min(n, (wave + 1) * WAVE) - 1
        mine = blocks.where(F.col("block").between(first, last))
        both = packs.withColumn("block", F.explode(F.sequence(F.lit(first), F.lit(last)))).join(F.broadcast(mine), "block")
        part = both.select("block", "query_id", "q", "chunk_id", "x", "center", "spread").mapInArrow(lambda b: _block_top(b, k, digits), "query_id long, chunk_id long, score double")
        found = part if found is None else found.unionByName(part)
    return _ranked(found, k, F.desc("score"), "chunk_id")


def _packed(batches: Iterator[pa.RecordBatch], pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Vectors as rows of up to ``PACK`` that are near one pivot: their ids, their components one after another, the
    direction of their centre, and the angle between it and the farthest of them."""
    units = pivots / np.maximum(np.linalg.norm(pivots, axis=1, keepdims=True), 1e-30) if len(pivots) else pivots
    ids, vectors, size = [], [], 0

    def grouped() -> Iterator[pa.RecordBatch]:
        own, x = np.concatenate(ids), np.concatenate(vectors)
        u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
        near = (u @ units.T).argmax(axis=1)
        order = np.argsort(near, kind="stable")
        cuts = np.flatnonzero(np.diff(near[order])) + 1
        for group in np.split(order, cuts):
            for at in range(0, len(group), PACK):
                rows = group[at : at + PACK]
                center = u[rows].mean(axis=0)
                center /= max(np.linalg.norm(center), 1e-30)
                spread = float(np.arccos(np.clip(u[rows] @ center, -1, 1)).max())
                lists = [pa.array([own[rows]], pa.list_(pa.int64())), *(pa.array([v], pa.list_(pa.float64())) for v in (x[rows].ravel(), center))]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([spread])], ["chunk_id", "x", "center", "spread"])

    for batch in batches:
        if batch.num_rows:
            ids.append(batch.column("chunk_id").to_numpy(zero_copy_only=False))
            vectors.append(batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
            size += vectors[-1].nbytes
        if size > HELD_BYTES:
            yield from grouped()
            ids, vectors, size = [], [], 0
    if ids:
        yield from grouped()


def _unit(rows: pa.ListScalar, n: int) -> np.ndarray:
    x = np.asarray(rows.values, np.float64).reshape(n, -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


class Nearest:
    """The k best chunks of each query of a block so far; counts the comparisons of a query with a pack, and those that
    the bounds spared."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, digits: int):
        self.ids, self.q, self.k, self.digits = ids, q, k, digits
        self.score, self.chunk = np.full((len(ids), 0), 0.0), np.zeros((len(ids), 0), np.int64)
        self.compared = self.spared = 0

    def meet(self, packs: list[tuple[np.ndarray, np.ndarray, np.ndarray, float]]) -> None:
        """packs: chunk ids, unit vectors, centre and spread."""
        centers, spreads = np.stack([c for _, _, c, _ in packs]), np.array([s for *_, s in packs])
        angle = np.arccos(np.clip(self.q @ centers.T, -1, 1))
        bound = np.cos(np.maximum(angle - spreads - 1e-9, 0)) + 2 * 10.0**-self.digits
        for p in np.argsort(-bound.mean(axis=0), kind="stable").tolist():
            own, x, _, _ = packs[p]
            asks = np.ones(len(self.ids), bool) if self.score.shape[1] < self.k else bound[:, p] >= self.score[:, -1]
            self.compared += int(asks.sum())
            self.spared += int((~asks).sum())
            if not asks.any():
                continue
            s = np.round(self.q[asks] @ x.T, self.digits) + 0.0
            s, c = np.concatenate([self.score[asks], s], axis=1), np.concatenate([self.chunk[asks], np.broadcast_to(own, s.shape)], axis=1)
            if s.shape[1] >= self.k:  # put in order, the k-th last
                best = _best(s, c, self.k)
                s, c = np.take_along_axis(s, best, 1), np.take_along_axis(c, best, 1)
            if asks.all():
                self.score, self.chunk = s, c
            else:
                self.score[asks], self.chunk[asks] = s, c


def _block_top(batches: Iterator[pa.RecordBatch], k: int, digits: int) -> Iterator[pa.RecordBatch]:
    held: dict[int, Nearest] = {}
    for batch in batches:
        packs: dict[int, list[tuple]] = {}
        for i in range(batch.num_rows):
            block = batch.column("block")[i].as_py()
            if block not in held:
                ids = np.asarray(batch.column("query_id")[i].values)
                held[block] = Nearest(ids, _unit(batch.column("q")[i], len(ids)), k, digits)
            own = np.asarray(batch.column("chunk_id")[i].values)
            packs.setdefault(block, []).append((own, _unit(batch.column("x")[i], len(own)), np.asarray(batch.column("center")[i].values), batch.column("spread")[i].as_py()))
        for block, mine in packs.items():
            held[block].meet(mine)
    for best in held.values():
        s, c = best.score, best.chunk
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(best.ids, s.shape[1])), pa.array(c.ravel()), pa.array(s.ravel())], ["query_id", "chunk_id", "score"])


def _best(s: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's k best: only those at or above its k-th score are put in order."""
    row, col = np.nonzero(s >= -np.partition(-s, k - 1, axis=1)[:, k - 1 : k])
    order = np.lexsort((c[row, col], -s[row, col], row))
    row, col = row[order], col[order]
    return col[np.arange(len(row)) - np.searchsorted(row, row) < k].reshape(len(s), k)


def fuse(lists: list[tuple[DataFrame, float]], k: int, rrf_k: int = 60, keep: list[str] | None = None) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_id, chunk_id, rank) with their weights.

    With ``keep``, a name for each list, its score comes along under that name, null where the list has not the chunk:
    all in the one aggregation, so no list is made twice.
    """
    sound(lists[0][0].sparkSession)
    names = keep or []
    both = None
    for i, (x, w) in enumerate(lists):
        own = [(F.col("score") if i == j else F.lit(None).cast("double")).alias(n) for j, n in enumerate(names)]
        part = x.select("query_id", "chunk_id", scores.rrf(F.col("rank"), w, rrf_k).alias("part"), *own)
        both = part if both is None else both.unionByName(part)
    total = both.groupBy("query_id", "chunk_id").agg(F.round(F.sum("part"), 9).alias("rrf_score"), *[F.max(n).alias(n) for n in names])
    return _ranked(total, k, F.desc("rrf_score"), "chunk_id")


def protected(rows: DataFrame, reserve: int, rrf_top: int, vector_top: int) -> DataFrame:
    """Mark rows that must survive reranking: the best lexical chunk of each of the first ``reserve`` pages, the top by
    fusion, and the top by vector score. rows: query_id, chunk_id, document_id, page, text_score, vector_score, rrf_score."""
    by_page = Window.partitionBy("query_id", "document_id", "page").orderBy(F.desc_nulls_last("text_score"), "chunk_id")
    rows = rows.withColumn("_best", F.row_number().over(by_page) == 1)
    lead = Window.partitionBy("query_id", "_best").orderBy(F.desc_nulls_last("text_score"), "chunk_id")
    rows = rows.withColumn("_reserve", F.col("_best") & (F.coalesce("text_score", F.lit(0.0)) > 0) & (F.row_number().over(lead) <= reserve))
    top = lambda c: Window.partitionBy("query_id").orderBy(F.desc_nulls_last(c), "chunk_id")
    keep = F.col("_reserve") | (F.row_number().over(top("rrf_score")) <= rrf_top) | (F.col("vector_score").isNotNull() & (F.row_number().over(top("vector_score")) <= vector_top))
    return rows.withColumn("protected", keep).withColumnRenamed("_reserve", "reserved").drop("_best")


def rerank_pool(rows: DataFrame, limit: int) -> DataFrame:
    """Protected rows first, then by fused rank, cut at the limit."""
    at = Window.partitionBy("query_id").orderBy(F.desc(F.col("protected").cast("int")), F.desc("rrf_score"), "chunk_id")
    return rows.withColumn("pool_rank", F.row_number().over(at).cast("bigint")).where(F.col("pool_rank") <= limit)


def final_count(top_k: int, least: int = 10, most: int = 15) -> int:
    return min(max(top_k, least), most)


def page_siblings(selected: DataFrame, chunks: DataFrame, size: int = 3) -> DataFrame:
    """Up to ``size`` chunks of each selected page from its first selected position on; pages without another chunk are
    left out. selected: query_id, chunk_id; chunks: chunk_id, document_id, page, chunk_index."""
    anchors = selected.join(chunks, "chunk_id").groupBy("query_id", "document_id", "page").agg(F.min("chunk_index").alias("first"))
    around = anchors.join(chunks, ["document_id", "page"]).where(F.col("chunk_index") >= F.col("first"))
    page = Window.partitionBy("query_id", "document_id", "page")
    rows = around.withColumn("place", F.row_number().over(page.orderBy("chunk_index", "chunk_id")).cast("bigint")).withColumn("many", F.count("*").over(page) > 1)
    return rows.where((F.col("place") <= size) & F.col("many")).select("query_id", "chunk_id", "document_id", "page", "place")


def next_pages(selected: DataFrame, chunks: DataFrame) -> DataFrame:
    """The first chunk of the page after each selected page, unless it is selected itself; it inherits the best score
    there, less 0.0001. selected: query_id, chunk_id, score."""
    anchors = selected.join(chunks.select("chunk_id", "document_id", "page"), "chunk_id")
    anchors = anchors.groupBy("query_id", "document_id", (F.col("page") + 1).alias("page")).agg(F.max("score").alias("score"))
    following = anchors.join(chunks.select("chunk_id", "document_id", "page", "chunk_index"), ["document_id", "page"])
    first = Window.partitionBy("query_id", "document_id", "page").orderBy("chunk_index", "chunk_id")
    following = following.withColumn("n", F.row_number().over(first)).where("n = 1")
    following = following.join(selected.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    return following.select("query_id", "chunk_id", "document_id", "page", F.round(F.col("score") - 0.0001, 6).alias("score"))


def per_document_cap(rows: DataFrame, per_document: int, k: int) -> DataFrame:
    """At most so many rows per document and k in all, in rank order."""
    own = Window.partitionBy("query_id", "document_id").orderBy("rank")
    kept = rows.withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= per_document).drop("_n")
    return kept.withColumn("kept_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).cast("bigint")).where(F.col("kept_rank") <= k)


def restrict_if_any(rows: DataFrame, flag: Column, by: str = "query_id") -> DataFrame:
    """The flagged rows of each query if it has any, else all of its rows."""
    rows = rows.withColumn("_flag", F.coalesce(flag, F.lit(False)))
    return rows.withColumn("_any", F.max("_flag").over(Window.partitionBy(by))).where("_flag or not _any").drop("_flag", "_any")


def first_tier(rows: DataFrame, tiers: list[Column], by: str = "query_id") -> DataFrame:
    """The rows of the first tier that any row of the query meets; all of them where none does."""
    tier = F.lit(len(tiers))
    for i in range(len(tiers) - 1, -1, -1):
        tier = F.when(tiers[i], F.lit(i)).otherwise(tier)
    rows = rows.withColumn("tier", tier)
    return rows.withColumn("_least", F.min("tier").over(Window.partitionBy(by))).where("tier = _least").drop("_least")


def keep_first(rows: DataFrame, keys: list[str | Column], order: list[Column | str]) -> DataFrame:
    """One row per key, the first in order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def similar_missions(needs: DataFrame, missions: DataFrame, similarity: DataFrame, k: int) -> DataFrame:
    """The k best missions per need: 0.85 of the best chunk similarity and 0.15 of the share of the mission's tags that
    the need's text names. needs: query_id, need; missions: mission_id, tags; similarity: query_id, mission_id, score."""
    best = similarity.groupBy("query_id", "mission_id").agg(F.max("score").alias("similarity"))
    rows = best.join(missions, "mission_id").join(needs, "query_id")
    named = F.filter("tags", lambda x: F.contains(F.lower("need"), F.lower(x)))
    ratio = F.try_divide(F.size(named).cast("double"), F.size("tags"))
    rows = rows.select("query_id", "mission_id", F.round(scores.mission_score(F.col("similarity"), ratio), 6).alias("score"))
    return _ranked(rows, k, F.desc("score"), "mission_id")


def coverage_aware(rows: DataFrame, target: int) -> DataFrame:
    """Reserved rows first, then by rank, up to the target; rows: query_id, chunk_id, rank, reserved."""
    at = Window.partitionBy("query_id").orderBy(F.desc(F.col("reserved").cast("int")), "rank", "chunk_id")
    return rows.withColumn("place", F.row_number().over(at).cast("bigint")).where(F.col("place") <= target)


def safeguarded(rows: DataFrame) -> DataFrame:
    """Protected rows before the others, by score and id: adds ``place``."""
    at = Window.partitionBy("query_id").orderBy(F.desc(F.col("protected").cast("int")), F.desc("score"), "chunk_id")
    return rows.withColumn("place", F.row_number().over(at).cast("bigint"))


def best_scored(rows: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    """The row with the highest score of each key; keyword hits have to be above zero."""
    return keep_first(rows.where(F.col(score) > 0), keys, [F.desc(score), tie])


@dataclass(frozen=True)
class HybridConfig:
    """How many rows each step of ``hybrid_retrieve`` keeps, and how it scores them."""

    candidates: int = 50
    rrf_k: int = 60
    vector_weight: float = 1.0
    text_weight: float = 1.0
    reserve: int = 5
    safeguard: int = 10
    pool: int = 30
    lexical_bonus: float = 0.0
    top_k: int = 10
    anchors: int = 3
    siblings: int = 3


def exact_family(named: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    """The first chunks of the documents that each query names, as a ranked list with score 0. named: query_id and
    document_id. A document's chunks are cut before the join, as many queries may name the same long document."""
    heads = Window.partitionBy("document_id").orderBy("page", "chunk_index", "chunk_id")
    heads = chunks.select("document_id", "page", "chunk_index", "chunk_id").withColumn("_n", F.row_number().over(heads)).where(F.col("_n") <= limit)
    rows = named.select("query_id", "document_id").distinct().join(heads, "document_id").withColumn("score", F.lit(0.0))
    return _ranked(rows, limit, F.col("document_id"), F.col("_n")).select("query_id", "chunk_id", "score", "rank")


def prepended(exact: DataFrame, ranked: DataFrame) -> DataFrame:
    """The exact list first, then the rest of the other one, ranked anew."""
    rest = ranked.join(exact.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    part = lambda rows, p: rows.select("query_id", "chunk_id", "score", F.col("rank").alias("_own"), F.lit(p).alias("_p"))
    at = Window.partitionBy("query_id").orderBy("_p", "_own", "chunk_id")
    rows = part(exact, 0).unionByName(part(rest, 1))
    return rows.select("query_id", "chunk_id", "score", F.row_number().over(at).cast("bigint").alias("rank"))


def hybrid_candidates(vector: DataFrame, lexical_list: DataFrame, chunks: DataFrame, named: DataFrame | None = None, cfg: HybridConfig = HybridConfig()) -> DataFrame:
    """Both ranked lists fused, with the chunks of named documents at the head of the lexical one.

    chunks: chunk_id, document_id, page and chunk_index. Gives these with query_id, vector_score, text_score, rrf_score and
    rank. Chunks that are not in ``chunks`` are left out: filters on scope or metadata act by what is passed there.
    """
    if named is not None:
        lexical_list = prepended(exact_family(named, chunks, cfg.candidates), lexical_list)
    lists = [(vector, cfg.vector_weight), (lexical_list, cfg.text_weight)]
    rows = fuse(lists, cfg.candidates, cfg.rrf_k, keep=["vector_score", "text_score"])
    return rows.join(chunks.select("chunk_id", "document_id", "page", "chunk_index"), "chunk_id")


def hybrid_select(candidates: DataFrame, cfg: HybridConfig = HybridConfig(), relevance: Column | None = None) -> DataFrame:
    """Protected rows and the best others into a bounded pool, scored, the protected kept ahead and the lexical reserve
    first: adds relevance, score and place. ``relevance`` is a reranker's column; without one, the clamped vector score."""
    rows = rerank_pool(protected(candidates, cfg.reserve, cfg.safeguard, cfg.safeguard), cfg.pool)
    rows = rows.withColumn("relevance", scores.bounded(F.col("vector_score")) if relevance is None else relevance)
    rows = rows.withColumn("score", F.round(F.col("relevance") + F.lit(cfg.lexical_bonus) * F.coalesce("text_score", F.lit(0.0)), 6))
    ordered = safeguarded(rows).withColumn("rank", F.col("place")).drop("place")
    return coverage_aware(ordered, final_count(cfg.top_k))


def companions(selected: DataFrame, candidates: DataFrame, chunks: DataFrame, cfg: HybridConfig = HybridConfig()) -> DataFrame:
    """What stands beside the first selected rows: query_id, chunk_id and place, the order in which they are to be added.

    First candidates of the same page from the first selected position on, if the page has more than one of them; then
    one chunk of the following page, the best candidate there or, without any, the page's first chunk.
    """
    page = ["query_id", "document_id", "page"]
    anchors = selected.where(F.col("place") <= cfg.anchors).groupBy(*page).agg(F.min("chunk_index").alias("first"), F.min("place").alias("at"))
    there = candidates.select(*page, "chunk_id", "chunk_index", "rank")
    on_page = Window.partitionBy(*page)
    same = anchors.join(there, page).where(F.col("chunk_index") >= F.col("first")).withColumn("many", F.count("*").over(on_page) > 1)
    same = same.withColumn("n", F.row_number().over(on_page.orderBy("chunk_index", "chunk_id"))).where(F.col("many") & (F.col("n") <= cfg.siblings))
    following = anchors.select("query_id", "document_id", (F.col("page") + 1).alias("page"), "at")
    found = keep_first(following.join(there, page), page, ["rank", "chunk_id"])
    missing = following.join(found.select(*page), page, "left_anti")
    heads = keep_first(chunks.select("document_id", "page", "chunk_id", "chunk_index"), ["document_id", "page"], ["chunk_index", "chunk_id"])
    fetched = missing.join(heads, ["document_id", "page"])
    far = cfg.anchors * (cfg.siblings + 1)
    rows = same.select("query_id", "chunk_id", (F.col("at") * (cfg.siblings + 1) + F.col("n")).alias("place"))
    for later, more in ((1, found), (2, fetched)):
        rows = rows.unionByName(more.select("query_id", "chunk_id", (F.lit(far * later + cfg.siblings + 1) + F.col("at")).alias("place")))
    return rows


def hybrid_retrieve(vector: DataFrame, lexical_list: DataFrame, chunks: DataFrame, named: DataFrame | None = None, cfg: HybridConfig = HybridConfig(), relevance: Column | None = None) -> DataFrame:
    """From two ranked lists for a table of queries to the rows to answer from, in order.

    Named documents' chunks are put first, both lists fused, the pool scored and cut, companions of the best rows take the
    place of weak ones, and rows of named documents remain alone where a query has any. Gives query_id, chunk_id,
    document_id, page, chunk_index and place, with vector_score, text_score, rrf_score, relevance and score where the
    chunk was selected itself; a companion has none of the last two, and one fetched from a following page no other.
    """
    # Short lists, each read several times.
    candidates = hybrid_candidates(vector, lexical_list, chunks, named, cfg).persist()
    selected = hybrid_select(candidates, cfg, relevance).persist()
    rows = windows.with_companions(selected.withColumn("rank", F.col("place")), companions(selected, candidates, chunks, cfg), chunks)
    if named is not None:
        rows = only_named(rows, named)
    keys = ["query_id", "chunk_id"]
    rows = rows.join(candidates.select(*keys, "vector_score", "text_score", "rrf_score"), keys, "left")
    return rows.join(selected.select(*keys, "relevance", "score"), keys, "left")


def only_named(rows: DataFrame, named: DataFrame) -> DataFrame:
    """Each query's rows of the documents that it names, if it has any, else all of its rows."""
    told = named.select("query_id", "document_id").distinct().withColumn("_named", F.lit(True))
    return restrict_if_any(rows.join(told, ["query_id", "document_id"], "left"), F.col("_named")).drop("_named")
