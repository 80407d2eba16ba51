"""Retrieval queries: every document and vector whose id is divisible by 50 is a query against all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores, text
from ..operators import lexical as words
from ..operators import retrieval
from ..registry import Tables, query

K, VECTOR_K = 10, 20
TR = f"translate(text, '{text.ACCENTED}', '{text.PLAIN}')"
#: All terms of five letters or digits and more, with repeats, are postings; the distinct ones of a query are looked up.
def _lists_sql(k: int) -> tuple[str, str]:
    """Both ranked lists, of k chunks a query."""
    vector = f"""v AS (SELECT vec_id AS chunk_id, label, embedding::DOUBLE[] AS e FROM embeddings),
vs AS (SELECT q.chunk_id AS query_id, c.chunk_id, c.label, round(list_cosine_similarity(q.e, c.e), 6) AS score FROM v q, v c WHERE q.chunk_id % 50 = 0),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM vs QUALIFY rank <= {k})"""
    lexical = f"""tk AS (SELECT doc_id, regexp_extract_all(lower({TR}), '[a-z0-9]{{5,}}') AS ts FROM documents),
po AS (SELECT doc_id AS chunk_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM tk) GROUP BY ALL),
qt AS (SELECT chunk_id AS query_id, term FROM po WHERE chunk_id % 50 = 0),
lm AS (SELECT query_id, chunk_id, round(sum(tf) * 0.1::DOUBLE, 6) AS score FROM po JOIN qt USING (term) GROUP BY ALL),
lr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM lm QUALIFY rank <= {k})"""
    return vector, lexical


VECTOR_SQL, LEX_SQL = _lists_sql(VECTOR_K)
_FUSE_TAIL = f"""pr AS (SELECT query_id, chunk_id, 1.0::DOUBLE / (60 + rank) AS part FROM vr UNION ALL SELECT query_id, chunk_id, 1.0::DOUBLE / (60 + rank) FROM lr),
fs AS (SELECT query_id, chunk_id, round(sum(part), 9) AS rrf_score FROM pr GROUP BY ALL),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, chunk_id) AS rank FROM fs QUALIFY rank <= {VECTOR_K})"""
FUSE_SQL = f"{VECTOR_SQL}, {LEX_SQL},\n{_FUSE_TAIL}"


def vectors(t: Tables, k: int = VECTOR_K) -> DataFrame:
    chunks = t.embeddings.select(F.col("vec_id").alias("chunk_id"), "embedding", "label")
    queries = chunks.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    return retrieval.nearest(queries, chunks, k)


def chunk_terms():
    return F.regexp_extract_all(text.fold(F.col("text")), F.lit("[a-z0-9]{5,}"), F.lit(0))


def query_terms(t: Tables) -> DataFrame:
    """All distinct terms of each query's text."""
    return t.documents.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.explode(F.array_distinct(chunk_terms())).alias("term"))


def word_index(t: Tables) -> DataFrame:
    return words.index_texts(t.documents.withColumnRenamed("doc_id", "chunk_id"), text.fold(F.col("text")), 5)


def lexical(t: Tables, k: int = VECTOR_K) -> DataFrame:
    return words.search(query_terms(t), word_index(t), k)


def fused(t: Tables) -> DataFrame:
    return retrieval.fuse([(vectors(t), 1.0), (lexical(t), 1.0)], VECTOR_K)


@query("k1_vector_top_k", f"WITH {VECTOR_SQL} SELECT query_id, chunk_id, score, rank FROM vr")
def k1(t):
    return vectors(t).select("query_id", "chunk_id", "score", "rank")


@query("k2_lexical_top_k", f"WITH {LEX_SQL} SELECT query_id, chunk_id, score, rank FROM lr")
def k2(t):
    return lexical(t).select("query_id", "chunk_id", "score", "rank")


@query("j10_rank_fusion", f"WITH {FUSE_SQL} SELECT query_id, chunk_id, rrf_score, rank FROM fr")
def j10(t):
    return fused(t).select("query_id", "chunk_id", "rrf_score", "rank")


_SCORED_TAIL = """sc AS (SELECT f.query_id, f.chunk_id, d.source AS document_id, d.n_chars AS page, vr.score AS vector_score, lr.score AS text_score, f.rrf_score, f.rank FROM fr f LEFT JOIN vr USING (query_id, chunk_id) LEFT JOIN lr USING (query_id, chunk_id) JOIN documents d ON d.doc_id = f.chunk_id)"""
SCORED_SQL = f"{FUSE_SQL},\n{_SCORED_TAIL}"


def scored(t: Tables) -> DataFrame:
    rows = retrieval.fuse([(vectors(t), 1.0), (lexical(t), 1.0)], VECTOR_K, keep=["vector_score", "text_score"])
    docs = t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), F.col("n_chars").alias("page"))
    return rows.join(docs, "chunk_id")


RANK_SQL = """least(1.0, greatest(0.0, coalesce(vector_score, 0)))"""


_C1_TAIL = f"""rr AS (SELECT *, {RANK_SQL} AS relevance, round({RANK_SQL} + 0.02::DOUBLE * coalesce(text_score, 0), 6) AS score FROM sc),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS final_rank FROM rr)
SELECT query_id, chunk_id, document_id, vector_score, text_score, rrf_score, relevance, score, final_rank FROM o WHERE final_rank <= 10"""


def _c1(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("relevance", scores.bounded(F.col("vector_score")))
    rows = rows.withColumn("score", F.round(F.col("relevance") + F.lit(0.02) * F.coalesce("text_score", F.lit(0.0)), 6))
    at = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    rows = rows.withColumn("final_rank", F.row_number().over(at).cast("bigint")).where(F.col("final_rank") <= retrieval.final_count(K))
    return rows.select("query_id", "chunk_id", "document_id", "vector_score", "text_score", "rrf_score", "relevance", "score", "final_rank")


CFG = retrieval.HybridConfig(lexical_bonus=0.02)
#: A query names its own source: chunks are documents, their source is the document they are part of, and their length a page.
HYBRID_SQL = f"""{", ".join(_lists_sql(CFG.candidates))},
hd AS (SELECT doc_id AS chunk_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS n FROM documents QUALIFY n <= {CFG.candidates}),
na AS (SELECT doc_id AS query_id, source FROM documents WHERE doc_id % 50 = 0),
ex AS (SELECT query_id, chunk_id, 0.0::DOUBLE AS score, n AS rank, 0 AS p FROM na JOIN hd USING (source)),
lu AS (SELECT * FROM ex UNION ALL SELECT query_id, chunk_id, score, rank, 1 FROM lr ANTI JOIN ex USING (query_id, chunk_id)),
lx AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY p, rank) AS rank FROM lu),
pr AS (SELECT query_id, chunk_id, 1.0::DOUBLE / ({CFG.rrf_k} + rank) AS part, score AS v, NULL::DOUBLE AS x FROM vr UNION ALL SELECT query_id, chunk_id, 1.0::DOUBLE / ({CFG.rrf_k} + rank), NULL, score FROM lx),
fs AS (SELECT query_id, chunk_id, round(sum(part), 9) AS rrf_score, max(v) AS vector_score, max(x) AS text_score FROM pr GROUP BY ALL),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, chunk_id) AS rank FROM fs QUALIFY rank <= {CFG.candidates}),
ca AS (SELECT f.*, d.source AS document_id, d.n_chars AS page FROM fr f JOIN documents d ON d.doc_id = f.chunk_id),
pb AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id, page ORDER BY text_score DESC NULLS LAST, chunk_id) = 1 AS best FROM ca),
pl AS (SELECT *, row_number() OVER (PARTITION BY query_id, best ORDER BY text_score DESC NULLS LAST, chunk_id) AS l, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC NULLS LAST, chunk_id) AS f, row_number() OVER (PARTITION BY query_id ORDER BY vector_score DESC NULLS LAST, chunk_id) AS v FROM pb),
pq AS (SELECT *, best AND coalesce(text_score, 0) > 0 AND l <= {CFG.reserve} AS reserved FROM pl),
pp AS (SELECT *, reserved OR f <= {CFG.safeguard} OR (vector_score IS NOT NULL AND v <= {CFG.safeguard}) AS protected FROM pq),
pw AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY protected::INT DESC, rrf_score DESC, chunk_id) AS pool_rank FROM pp QUALIFY pool_rank <= {CFG.pool}),
rr AS (SELECT *, {RANK_SQL} AS relevance, round({RANK_SQL} + {CFG.lexical_bonus}::DOUBLE * coalesce(text_score, 0), 6) AS score FROM pw),
sg AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY protected::INT DESC, score DESC, chunk_id) AS safe_rank FROM rr),
se AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY reserved::INT DESC, safe_rank, chunk_id) AS final_rank FROM sg QUALIFY final_rank <= {retrieval.final_count(CFG.top_k)}),
mk AS (SELECT se.*, coalesce(document_id = source, false) AS m FROM se LEFT JOIN na USING (query_id)),
c1 AS (SELECT * FROM mk QUALIFY m OR NOT bool_or(m) OVER (PARTITION BY query_id))"""


def hybrid_inputs(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Both ranked lists, the chunks, and which document each query names."""
    chunks = t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), F.col("n_chars").alias("page"), F.col("doc_id").alias("chunk_index"))
    named = chunks.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "document_id")
    return vectors(t, CFG.candidates), lexical(t, CFG.candidates), chunks, named


def hybrid(t: Tables) -> DataFrame:
    """The selected rows, before companions are added."""
    vector, lexical_list, chunks, named = hybrid_inputs(t)
    selected = retrieval.hybrid_select(retrieval.hybrid_candidates(vector, lexical_list, chunks, named, CFG), CFG)
    return retrieval.only_named(selected.withColumnRenamed("place", "final_rank"), named)


_C1_COLUMNS = ["query_id", "chunk_id", "document_id", "vector_score", "text_score", "rrf_score", "relevance", "score", "final_rank"]


@query("c1_hybrid_retrieve", f"WITH {HYBRID_SQL} SELECT {', '.join(_C1_COLUMNS)} FROM c1")
def c1(t):
    """The flagship: named documents first, fusion of fifty candidates a list, protected rows, a scored pool, the lexical
    reserve, the final cut, and named documents alone where there are any."""
    return hybrid(t).select(*_C1_COLUMNS)


@query("c1_hybrid_retrieve_whole", f"WITH {FUSE_SQL},\n{_SCORED_TAIL},\n{_C1_TAIL}")
def c1_whole(t):
    """Fusion of twenty candidates a list, bounded relevance, lexical bonus and the final cut, without the other steps."""
    return _c1(scored(t))


@query("k2_lexical_top_k_whole", f"WITH {LEX_SQL} SELECT query_id, chunk_id, score, rank FROM lr")
def k2_whole(t):
    return lexical(t).select("query_id", "chunk_id", "score", "rank")


PROTECTED_SQL = f"""{SCORED_SQL},
pb AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id, page ORDER BY text_score DESC NULLS LAST, chunk_id) = 1 AS best FROM sc),
pl AS (SELECT *, row_number() OVER (PARTITION BY query_id, best ORDER BY text_score DESC NULLS LAST, chunk_id) AS l, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC NULLS LAST, chunk_id) AS f, row_number() OVER (PARTITION BY query_id ORDER BY vector_score DESC NULLS LAST, chunk_id) AS v FROM pb),
pp AS (SELECT *, (best AND coalesce(text_score, 0) > 0 AND l <= 3) OR f <= 2 OR (vector_score IS NOT NULL AND v <= 2) AS protected FROM pl)"""


@query("w4_protected_set", f"WITH {PROTECTED_SQL} SELECT query_id, chunk_id, protected FROM pp")
def w4(t):
    return retrieval.protected(scored(t), 3, 2, 2).select("query_id", "chunk_id", "protected")


@query("w7_rerank_pool", f"WITH {PROTECTED_SQL}, x AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY protected::INT DESC, rrf_score DESC, chunk_id) AS pool_rank FROM pp) SELECT query_id, chunk_id, protected, pool_rank FROM x WHERE pool_rank <= 12")
def w7(t):
    return retrieval.rerank_pool(retrieval.protected(scored(t), 3, 2, 2), 12).select("query_id", "chunk_id", "protected", "pool_rank")


@query("w14_document_cap", f"WITH {SCORED_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY rank) AS n FROM sc QUALIFY n <= 3), b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS kept_rank FROM a QUALIFY kept_rank <= 8) SELECT query_id, chunk_id, document_id, kept_rank FROM b")
def w14(t):
    return retrieval.per_document_cap(scored(t), 3, 8).select("query_id", "chunk_id", "document_id", "kept_rank")


@query("a10_best_chunk_per_mission", f"WITH {VECTOR_SQL} SELECT query_id, label AS mission_id, max(score) AS similarity FROM vr GROUP BY ALL")
def a10(t):
    labels = t.embeddings.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("mission_id"))
    return vectors(t).join(labels, "chunk_id").groupBy("query_id", "mission_id").agg(F.max("score").alias("similarity"))


@query("c2_similar_missions", f"""WITH {VECTOR_SQL}, b AS (SELECT query_id, label::BIGINT AS mission_id, max(score) AS similarity FROM vr GROUP BY ALL),
m AS (SELECT p_partkey AS mission_id, string_split(p_name, ' ') AS tags FROM part), n AS (SELECT doc_id AS query_id, lower(text) AS need FROM documents),
s AS (SELECT query_id, mission_id, round(0.85::DOUBLE * greatest(0.0, similarity) + 0.15::DOUBLE * coalesce(len(list_filter(tags, lambda x: contains(need, lower(x))))::DOUBLE / nullif(len(tags), 0), 0), 6) AS score FROM b JOIN m USING (mission_id) JOIN n USING (query_id))
SELECT query_id, mission_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, mission_id) AS rank FROM s QUALIFY rank <= 5""")
def c2(t):
    labels = t.embeddings.select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("bigint").alias("mission_id"))
    missions = t.part.select(F.col("p_partkey").alias("mission_id"), F.split("p_name", " ").alias("tags"))
    needs = t.documents.select(F.col("doc_id").alias("query_id"), F.col("text").alias("need"))
    return retrieval.similar_missions(needs, missions, vectors(t).join(labels, "chunk_id"), 5).select("query_id", "mission_id", "score", "rank")


@query("p10_restrict_if_any", f"WITH {SCORED_SQL}, x AS (SELECT *, document_id IN ('src0', 'src8') AS m, max((document_id IN ('src0', 'src8'))::INT) OVER (PARTITION BY query_id) = 1 AS any_m FROM sc) SELECT query_id, chunk_id, document_id FROM x WHERE m OR NOT any_m")
def p10(t):
    return retrieval.restrict_if_any(scored(t), F.col("document_id").isin("src0", "src8")).select("query_id", "chunk_id", "document_id")


@query("p11_scope_cascade", f"WITH {SCORED_SQL}, x AS (SELECT *, CASE WHEN document_id = 'src0' THEN 0 WHEN document_id LIKE 'src1%' THEN 1 WHEN text_score > 1 THEN 2 ELSE 3 END AS tier FROM sc) SELECT query_id, chunk_id, tier::BIGINT AS tier FROM x QUALIFY tier = min(tier) OVER (PARTITION BY query_id)")
def p11(t):
    tiers = [F.col("document_id") == "src0", F.col("document_id").startswith("src1"), F.col("text_score") > 1]
    return retrieval.first_tier(scored(t), tiers).select("query_id", "chunk_id", F.col("tier").cast("bigint").alias("tier"))


@query("p16_admission", f"WITH {SCORED_SQL} SELECT query_id, chunk_id FROM sc WHERE rrf_score > 0.025 OR vector_score >= 0.55 OR text_score >= 1.0")
def p16(t):
    return scored(t).where("rrf_score > 0.025D or vector_score >= 0.55D or text_score >= 1.0D").select("query_id", "chunk_id")


@query("u1_prepend_exact", f"WITH {LEX_SQL}, ex AS (SELECT query_id, query_id AS chunk_id, 0.0::DOUBLE AS score, 0 AS p, 1::BIGINT AS rank FROM (SELECT DISTINCT query_id FROM qt)), un AS (SELECT * FROM ex UNION ALL SELECT query_id, chunk_id, score, 1, rank FROM lr ANTI JOIN ex USING (query_id, chunk_id)) SELECT query_id, chunk_id, score AS text_score, row_number() OVER (PARTITION BY query_id ORDER BY p, rank) AS rank FROM un")
def u1(t):
    """A query's own document goes first, with text score 0, and out of the rest of its list."""
    own = query_terms(t).select("query_id").distinct().select("query_id", F.col("query_id").alias("chunk_id"), F.lit(0.0).alias("score"), F.lit(0).alias("p"), F.lit(1).cast("bigint").alias("rank"))
    rest = lexical(t).join(own.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").select("query_id", "chunk_id", "score", F.lit(1).alias("p"), "rank")
    at = Window.partitionBy("query_id").orderBy("p", "rank")
    return own.unionByName(rest).select("query_id", "chunk_id", F.col("score").alias("text_score"), F.row_number().over(at).cast("bigint").alias("rank"))


@query("u6_union_of_protected", f"WITH {FUSE_SQL} SELECT query_id, chunk_id FROM vr WHERE rank <= 3 UNION SELECT query_id, chunk_id FROM lr WHERE rank <= 3")
def u6(t):
    top = lambda d: d.where("rank <= 3").select("query_id", "chunk_id")
    return top(vectors(t)).unionByName(top(lexical(t))).distinct()


CONV_SQL = "cc AS (SELECT conv_id * 1000 + turn AS chunk_id, conv_id AS document_id, turn // 3 AS page, turn AS chunk_index, role, text FROM conversations)"


def pages_of_turns(t: Tables) -> DataFrame:
    """Conversations as documents: three turns a page."""
    return t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"), F.col("conv_id").alias("document_id"), F.floor(F.col("turn") / 3).alias("page"), F.col("turn").alias("chunk_index"), "role", "text")


@query("w1_page_window", f"WITH {CONV_SQL} SELECT chunk_id, document_id, page, row_number() OVER (PARTITION BY document_id, page ORDER BY chunk_index, chunk_id) AS n FROM cc QUALIFY n <= 2")
def w1(t):
    at = Window.partitionBy("document_id", "page").orderBy("chunk_index", "chunk_id")
    return pages_of_turns(t).select("chunk_id", "document_id", "page", F.row_number().over(at).cast("bigint").alias("n")).where("n <= 2")


SEL_SQL = f"{CONV_SQL}, se AS (SELECT document_id AS query_id, chunk_id, round(length(text) / 2000.0::DOUBLE, 6) AS score FROM cc WHERE role = 'user' AND chunk_index % 4 = 0)"


def selected_turns(t: Tables) -> DataFrame:
    rows = pages_of_turns(t).where("role = 'user' and chunk_index % 4 = 0")
    return rows.select(F.col("document_id").alias("query_id"), "chunk_id", F.round(F.length("text") / F.lit(2000.0), 6).alias("score"))


@query("w8_page_siblings", f"WITH {SEL_SQL}, an AS (SELECT query_id, document_id, page, min(chunk_index) AS f FROM se JOIN cc USING (chunk_id) GROUP BY ALL), r AS (SELECT query_id, cc.chunk_id, document_id, page, row_number() OVER w AS place, count(*) OVER (PARTITION BY query_id, document_id, page) > 1 AS many FROM an JOIN cc USING (document_id, page) WHERE chunk_index >= f WINDOW w AS (PARTITION BY query_id, document_id, page ORDER BY chunk_index, cc.chunk_id)) SELECT query_id, chunk_id, document_id, page, place FROM r WHERE place <= 3 AND many")
def w8(t):
    return retrieval.page_siblings(selected_turns(t), pages_of_turns(t).select("chunk_id", "document_id", "page", "chunk_index"))


@query("j9_next_page", f"WITH {SEL_SQL}, an AS (SELECT query_id, document_id, page + 1 AS page, max(score) AS score FROM se JOIN cc USING (chunk_id) GROUP BY ALL), f AS (SELECT query_id, cc.chunk_id, document_id, page, score, row_number() OVER (PARTITION BY query_id, document_id, page ORDER BY chunk_index, cc.chunk_id) AS n FROM an JOIN cc USING (document_id, page)) SELECT query_id, chunk_id, document_id, page, round(score - 0.0001::DOUBLE, 6) AS score FROM f ANTI JOIN se USING (query_id, chunk_id) WHERE n = 1")
def j9(t):
    return retrieval.next_pages(selected_turns(t), pages_of_turns(t))


@query("w16_keep_first", "SELECT min(doc_id) AS doc_id, source, lang FROM documents GROUP BY source, lang, lower(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')))")
def w16(t):
    same = F.lower(F.trim(F.regexp_replace("text", r"[ \t\n\r]+", " ")))
    return retrieval.keep_first(t.documents.withColumn("h", F.sha2(same, 256)), ["source", "lang", "h"], ["doc_id"]).select("doc_id", "source", "lang")


@query("w12_chunk_index", "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS chunk_index FROM conversations")
def w12(t):
    at = Window.partitionBy("conv_id", "role").orderBy("turn")
    return t.conversations.select("conv_id", "turn", "role", (F.row_number().over(at) - 1).cast("bigint").alias("chunk_index"))


@query("w15_evidence_ids", f"WITH {FUSE_SQL}, fa AS (SELECT chunk_id, min(query_id * 1000 + rank) AS seen FROM fr GROUP BY 1), nu AS (SELECT chunk_id, dense_rank() OVER (ORDER BY seen) AS n FROM fa) SELECT query_id, chunk_id, rank, 'pdf-' || lpad(n::VARCHAR, 6, '0') AS evidence_id FROM fr JOIN nu USING (chunk_id) WHERE rank <= 3")
def w15(t):
    """Evidence ids by first appearance over all queries; the numbering goes over the distinct chunks that any query got."""
    rows = fused(t)
    seen = rows.groupBy("chunk_id").agg(F.min(F.col("query_id") * 1000 + F.col("rank")).alias("seen"))
    bucket = seen.withColumn("b", F.floor(F.col("seen") / 1000))
    before = bucket.groupBy("b").agg(F.count("*").alias("n")).select("b", F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    own = Window.partitionBy("b").orderBy("seen")
    numbered = bucket.join(before, "b").select("chunk_id", (F.col("base") + F.row_number().over(own)).alias("n"))
    return rows.where("rank <= 3").join(numbered, "chunk_id").select("query_id", "chunk_id", "rank", F.concat(F.lit("pdf-"), F.lpad(F.col("n").cast("string"), 6, "0")).alias("evidence_id"))
