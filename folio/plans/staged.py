"""Hybrid retrieval with all its stages accounted for, and retrieval judged from that account."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate, judging, retrieval, staged
from ..registry import Tables, query
from ..sources import tables
from . import retrieval as r

CFG = r.CFG
_FAR, _STEP = CFG.anchors * (CFG.siblings + 1), CFG.siblings + 1


def companions_sql(selected: str, candidates: str, chunks: str) -> str:
    """``folded``: query_id, chunk_id, document_id and place, from relations with the columns of the operators' tables."""
    at = "PARTITION BY query_id, document_id, page"
    return f"""an AS (SELECT query_id, document_id, page, min(chunk_index) AS first, min(place) AS spot FROM {selected} WHERE place <= {CFG.anchors} GROUP BY ALL),
same AS (SELECT query_id, c.chunk_id, document_id, page, c.chunk_index, spot * {_STEP} + row_number() OVER ({at} ORDER BY c.chunk_index, c.chunk_id) AS place
    FROM an JOIN {candidates} c USING (query_id, document_id, page) WHERE c.chunk_index >= first
    QUALIFY count(*) OVER ({at}) > 1 AND row_number() OVER ({at} ORDER BY c.chunk_index, c.chunk_id) <= {CFG.siblings}),
nx AS (SELECT query_id, document_id, page + 1 AS page, spot FROM an),
found AS (SELECT query_id, c.chunk_id, document_id, page, c.chunk_index, {_FAR + _STEP} + spot AS place FROM nx JOIN {candidates} c USING (query_id, document_id, page)
    QUALIFY row_number() OVER ({at} ORDER BY c.rank, c.chunk_id) = 1),
fetched AS (SELECT query_id, c.chunk_id, document_id, page, c.chunk_index, {2 * _FAR + _STEP} + spot AS place
    FROM (SELECT * FROM nx ANTI JOIN found USING (query_id, document_id, page)) JOIN {chunks} c USING (document_id, page)
    QUALIFY row_number() OVER ({at} ORDER BY c.chunk_index, c.chunk_id) = 1),
extra AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place, document_id, page, chunk_index, chunk_id) AS n
    FROM (FROM same UNION ALL FROM found UNION ALL FROM fetched)),
fold AS (SELECT query_id, 0::BIGINT AS n, list({{c: chunk_id, d: document_id, p: page, i: chunk_index}} ORDER BY place) AS kept FROM {selected} GROUP BY query_id
  UNION ALL SELECT query_id, n, CASE WHEN known OR spare IS NULL THEN kept ELSE list_concat(kept[:spare - 1], [row_], kept[spare + 1:]) END
    FROM (SELECT f.query_id, e.n, kept, {{c: chunk_id, d: document_id, p: page, i: chunk_index}} AS row_, list_contains(list_transform(kept, lambda x: x.c), chunk_id) AS known,
        list_max(list_filter(range(1, len(kept) + 1), lambda k: kept[k].d IS DISTINCT FROM document_id OR kept[k].p IS DISTINCT FROM page)) AS spare
      FROM fold f JOIN extra e ON e.query_id = f.query_id AND e.n = f.n + 1)),
spread AS (SELECT query_id, unnest(kept) AS k, unnest(range(1, len(kept) + 1)) AS spot FROM (SELECT * FROM fold QUALIFY n = max(n) OVER (PARTITION BY query_id))),
folded AS (SELECT query_id, k.c AS chunk_id, k.d AS document_id, k.p AS page, k.i AS chunk_index,
    list_sort(list(spot) OVER (PARTITION BY query_id, k.d, k.p))[row_number() OVER (PARTITION BY query_id, k.d, k.p ORDER BY k.i, k.c)] AS place FROM spread)"""


_CHUNKS = "ch AS (SELECT doc_id AS chunk_id, source AS document_id, n_chars AS page, doc_id AS chunk_index FROM documents)"
_SELECTED = "sl AS (SELECT query_id, chunk_id, document_id, page, chunk_id AS chunk_index, final_rank AS place FROM se)"
_CANDIDATES = "cd AS (SELECT query_id, chunk_id, document_id, page, chunk_id AS chunk_index, rank FROM ca)"


@query(
    "c1_hybrid_with_companions",
    f"""WITH RECURSIVE {r.HYBRID_SQL}, {_CHUNKS}, {_SELECTED}, {_CANDIDATES},
{companions_sql("sl", "cd", "ch")},
told AS (SELECT f.*, coalesce(document_id = source, false) AS m FROM folded f LEFT JOIN na USING (query_id))
SELECT t.query_id, t.chunk_id, t.document_id, t.page, t.chunk_index, t.place, ca.vector_score, ca.text_score, ca.rrf_score, se.relevance, se.score
FROM (SELECT * FROM told QUALIFY m OR NOT bool_or(m) OVER (PARTITION BY query_id)) t LEFT JOIN ca USING (query_id, chunk_id) LEFT JOIN se USING (query_id, chunk_id)""",
)
def c1_companions(t):
    """The flagship with companions of the best rows in place of weak ones."""
    return retrieval.hybrid_retrieve(*r.hybrid_inputs(t), CFG)


#: A document's chunks lie on 23 pages here; one source is out of scope; these words of a query call for these pages of
#: the document that it names.
PAGES, OUT = 23, "src3"
SECTIONS = [(["heiten", "thtion"], [0, 3]), (["mente", "erre"], [1]), (["on"], [2, 4, 5])]


def traced(t: Tables) -> DataFrame:
    vector, lexical_list, chunks, named = r.hybrid_inputs(t)
    chunks = chunks.withColumn("page", F.col("page") % PAGES)
    asked = t.documents.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"), F.col("source").alias("document_id"))
    backfill = judging.intent_pages(asked, chunks, SECTIONS)
    scope = F.col("document_id") != OUT
    return staged.trace(vector, lexical_list, chunks, named, CFG, path=tables.scratch(t.spark) + "/trace", allowed=scope, backfill=backfill)


_RULES = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(f, {w!r})' for w in words)} THEN {pages}" for words, pages in SECTIONS) + " END"
_LEAD = r.HYBRID_SQL[: r.HYBRID_SQL.index("pr AS (")].replace("ORDER BY n_chars, doc_id", f"ORDER BY n_chars % {PAGES}, doc_id")
_AMONG = "OVER (PARTITION BY query_id, cand ORDER BY"
TRACE_SQL = f"""{_LEAD}ch AS (SELECT doc_id AS chunk_id, source AS document_id, n_chars % {PAGES} AS page, doc_id AS chunk_index FROM documents),
ok AS (SELECT * FROM ch WHERE document_id <> '{OUT}'),
pr AS (SELECT query_id, chunk_id, 1.0::DOUBLE / ({CFG.rrf_k} + rank) AS part, score AS v, NULL::DOUBLE AS x, rank AS vr, NULL::BIGINT AS xr FROM vr
    UNION ALL SELECT query_id, chunk_id, 1.0::DOUBLE / ({CFG.rrf_k} + rank), NULL, score, NULL, rank FROM lx),
fs AS (SELECT query_id, chunk_id, round(sum(part), 9) AS rrf, max(v) AS vector_score, max(x) AS text_score, max(vr) AS vector_rank, max(xr) AS lexical_rank FROM pr GROUP BY ALL),
w1 AS (SELECT fs.*, document_id, page, chunk_index, document_id IS NOT NULL AS scope FROM fs LEFT JOIN ok USING (chunk_id)),
w2 AS (SELECT *, CASE WHEN scope THEN row_number() OVER (PARTITION BY query_id, scope ORDER BY rrf DESC, chunk_id) END AS fused_rank FROM w1),
w3 AS (SELECT *, coalesce(fused_rank <= {CFG.candidates}, false) AS cand FROM w2),
w4 AS (SELECT *, row_number() OVER (PARTITION BY query_id, cand, document_id, page ORDER BY text_score DESC NULLS LAST, chunk_id) = 1 AS best FROM w3),
w5 AS (SELECT *, best AND coalesce(text_score, 0) > 0 AND row_number() OVER (PARTITION BY query_id, cand, best ORDER BY text_score DESC NULLS LAST, chunk_id) <= {CFG.reserve} AS reserved FROM w4),
w6 AS (SELECT *, reserved OR row_number() {_AMONG} rrf DESC, chunk_id) <= {CFG.safeguard}
    OR (vector_score IS NOT NULL AND row_number() {_AMONG} vector_score DESC NULLS LAST, chunk_id) <= {CFG.safeguard}) AS safe FROM w5),
w7 AS (SELECT *, CASE WHEN cand THEN row_number() {_AMONG} safe::INT DESC, rrf DESC, chunk_id) END AS pool_rank FROM w6),
w8 AS (SELECT *, coalesce(pool_rank <= {CFG.pool}, false) AS pooled, round({r.RANK_SQL} + {CFG.lexical_bonus}::DOUBLE * coalesce(text_score, 0), 6) AS own FROM w7),
w9 AS (SELECT *, row_number() OVER (PARTITION BY query_id, pooled ORDER BY safe::INT DESC, own DESC, chunk_id) AS safe_rank FROM w8),
wx AS (SELECT *, row_number() OVER (PARTITION BY query_id, pooled ORDER BY reserved::INT DESC, safe_rank, chunk_id) AS spot FROM w9),
wide AS (SELECT *, CASE WHEN pooled THEN own END AS score, CASE WHEN pooled AND spot <= {retrieval.final_count(CFG.top_k)} THEN spot END AS place FROM wx),
sl AS (SELECT query_id, chunk_id, document_id, page, chunk_index, place FROM wide WHERE place IS NOT NULL),
cd AS (SELECT query_id, chunk_id, document_id, page, chunk_index, fused_rank AS rank FROM wide WHERE cand),
{companions_sql("sl", "cd", "ok")},
ask AS (SELECT doc_id AS query_id, source AS document_id, {_RULES} AS pages FROM (SELECT *, lower({r.TR}) AS f FROM documents WHERE doc_id % 50 = 0)),
bf AS (SELECT query_id, c.chunk_id, c.document_id, row_number() OVER (PARTITION BY query_id ORDER BY page, c.chunk_id) AS filled
    FROM (SELECT query_id, document_id, greatest(8, 4 * len(pages)) AS most, unnest(pages) AS page FROM ask WHERE pages IS NOT NULL) JOIN ch c USING (document_id, page)
    QUALIFY filled <= most),
fb AS (SELECT * FROM bf WHERE chunk_id IN (SELECT chunk_id FROM ok)),
e1 AS (SELECT query_id, chunk_id, coalesce(f.document_id, b.document_id) AS document_id, f.place AS beside, b.filled FROM folded f FULL JOIN fb b USING (query_id, chunk_id)),
e2 AS (SELECT e1.*, coalesce(document_id = source, false) AS m FROM e1 LEFT JOIN na USING (query_id)),
e3 AS (SELECT *, m OR NOT bool_or(m) OVER (PARTITION BY query_id) AS stays FROM e2),
e4 AS (SELECT *, CASE WHEN stays THEN row_number() OVER (PARTITION BY query_id, stays ORDER BY beside NULLS LAST, filled, chunk_id) END AS final_rank FROM e3),
al AS (SELECT query_id, chunk_id, w.*EXCLUDE (query_id, chunk_id), e.beside, e.filled, e.final_rank FROM wide w FULL JOIN e4 e USING (query_id, chunk_id)),
tr AS (SELECT query_id, chunk_id, 'vector' AS stage, vector_rank AS rank, vector_score AS score, CASE WHEN NOT scope THEN 'out of scope' WHEN NOT cand THEN 'below fusion' END AS dropped FROM al
  UNION ALL SELECT query_id, chunk_id, 'lexical', lexical_rank, text_score, CASE WHEN NOT scope THEN 'out of scope' WHEN NOT cand THEN 'below fusion' END FROM al
  UNION ALL SELECT query_id, chunk_id, 'fused', CASE WHEN cand THEN fused_rank END, rrf, CASE WHEN NOT pooled THEN 'not pooled' END FROM al
  UNION ALL SELECT query_id, chunk_id, 'pool', CASE WHEN pooled THEN pool_rank END, score, CASE WHEN place IS NULL THEN 'below the cut' END FROM al
  UNION ALL SELECT query_id, chunk_id, 'selected', place, score, CASE WHEN beside IS NULL AND filled IS NULL THEN 'replaced' WHEN final_rank IS NULL THEN 'other document' END FROM al
  UNION ALL SELECT query_id, chunk_id, 'companion', CASE WHEN place IS NULL THEN beside END, NULL, CASE WHEN final_rank IS NULL THEN 'other document' END FROM al
  UNION ALL SELECT query_id, chunk_id, 'backfill', filled, NULL, CASE WHEN beside IS NOT NULL THEN 'already there' WHEN final_rank IS NULL THEN 'other document' END FROM al
  UNION ALL SELECT query_id, chunk_id, 'final', final_rank, score, NULL FROM al),
trace AS (SELECT * FROM tr WHERE rank IS NOT NULL)"""


@query("c1_staged_trace", f"WITH RECURSIVE {TRACE_SQL} SELECT query_id, chunk_id, stage, rank, score, dropped FROM trace")
def c1_trace(t):
    """Every chunk that a stage saw, with scope, companions and backfill of section pages."""
    return traced(t)


@query("s17_dropped_by_stage", f"WITH RECURSIVE {TRACE_SQL} SELECT stage, coalesce(dropped, 'goes on') AS outcome, count(*) AS n, count(DISTINCT query_id) AS queries FROM trace GROUP BY ALL")
def s17(t):
    """What becomes of the frozen lists' rows at each stage."""
    return traced(t).groupBy("stage", F.coalesce("dropped", F.lit("goes on")).alias("outcome")).agg(F.count("*").alias("n"), F.count_distinct("query_id").alias("queries"))


@query(
    "c8_evaluate_trace",
    f"""WITH RECURSIVE {TRACE_SQL},
want AS (SELECT q.doc_id AS query_id, d.doc_id AS chunk_id FROM documents q JOIN documents d ON d.source = q.source AND d.lang = q.lang AND d.doc_id <> q.doc_id WHERE q.doc_id % 50 = 0),
cs AS (SELECT DISTINCT query_id FROM want), ev AS (SELECT query_id, stage FROM cs, (SELECT DISTINCT stage FROM trace)),
ht AS (SELECT query_id, stage, min(rank) AS f FROM trace JOIN want USING (query_id, chunk_id) GROUP BY ALL)
SELECT stage, round(avg(coalesce(f <= 5, false)::INT), 6) AS recall_at_5, round(avg(coalesce(f <= 10, false)::INT), 6) AS recall_at_10,
    round(avg(coalesce(1.0::DOUBLE / f, 0)), 6) AS mrr, count(f) AS found, count(*) AS cases FROM ev LEFT JOIN ht USING (query_id, stage) GROUP BY 1""",
)
def c8(t):
    """Recall and reciprocal rank of every stage, from the trace alone."""
    cases = t.documents.where("doc_id % 50 = 0").select(F.col("doc_id").alias("case_id"), "source", "lang")
    chunks = t.documents.select(F.col("doc_id").alias("chunk_id"), "source", "lang")
    ranked = traced(t).select(F.col("query_id").alias("case_id"), "stage", "chunk_id", "rank")
    return evaluate.stage_summary(evaluate.labelled_first_ranks(ranked, cases, chunks, ["source", "lang"]))
