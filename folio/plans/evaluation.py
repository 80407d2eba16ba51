"""Evaluation queries: ranked lists of the retrieval queries against what should have been found."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import evaluate, jobs
from ..registry import query
from . import retrieval as r

#: Expected for a query: the chunks with its own label or, for lexical lists, its own source and language.
RANKED_SQL = f"""WITH {r.FUSE_SQL}, rk AS (SELECT query_id AS case_id, 'vector' AS stage, chunk_id, rank FROM vr UNION ALL SELECT query_id, 'lexical', chunk_id, rank FROM lr UNION ALL SELECT query_id, 'fused', chunk_id, rank FROM fr),
ex AS (SELECT q.doc_id AS case_id, d.doc_id AS chunk_id FROM documents q JOIN documents d ON d.source = q.source AND d.lang = q.lang AND d.doc_id <> q.doc_id WHERE q.doc_id % 50 = 0)"""


def ranked(t):
    part = lambda d, s: d.select(F.col("query_id").alias("case_id"), F.lit(s).alias("stage"), "chunk_id", "rank")
    v, x = r.vectors(t).persist(), r.lexical(t).persist()  # short lists, each read twice
    return part(v, "vector").unionByName(part(x, "lexical")).unionByName(part(r.retrieval.fuse([(v, 1.0), (x, 1.0)], r.VECTOR_K), "fused"))


LABELS = ["source", "lang"]


def chunks(t):
    return t.documents.select(F.col("doc_id").alias("chunk_id"), *LABELS)


def cases(t):
    return t.documents.where("doc_id % 50 = 0").select(F.col("doc_id").alias("case_id"), *LABELS)


@query("a14_stage_summary", f"""{RANKED_SQL}, c AS (SELECT DISTINCT case_id FROM ex), e AS (SELECT case_id, stage FROM c, (SELECT DISTINCT stage FROM rk)), h AS (SELECT case_id, stage, min(rank) AS f FROM rk JOIN ex USING (case_id, chunk_id) GROUP BY ALL)
SELECT stage, round(avg(coalesce(f <= 5, false)::INT), 6) AS recall_at_5, round(avg(coalesce(f <= 10, false)::INT), 6) AS recall_at_10, round(avg(coalesce(1.0::DOUBLE / f, 0)), 6) AS mrr, count(f) AS found, count(*) AS cases FROM e LEFT JOIN h USING (case_id, stage) GROUP BY 1""")
def a14(t):
    return evaluate.stage_summary(evaluate.labelled_first_ranks(ranked(t), cases(t), chunks(t), LABELS))


@query("a15_recall_at_k", f"{RANKED_SQL}, s AS (SELECT case_id, chunk_id, min(rank) AS rank FROM rk WHERE stage = 'fused' GROUP BY ALL) SELECT case_id, round(avg(coalesce(rank <= 5, false)::INT), 6) AS recall_at_5, round(avg(coalesce(rank <= 20, false)::INT), 6) AS recall_at_20 FROM ex LEFT JOIN s USING (case_id, chunk_id) GROUP BY 1")
def a15(t):
    return evaluate.labelled_recall(ranked(t).where("stage = 'fused'"), cases(t), chunks(t), LABELS, [5, 20])


@query("a16_reciprocal_rank", f"{RANKED_SQL} SELECT case_id, stage, round(1.0::DOUBLE / min(rank), 6) AS rr FROM rk JOIN ex USING (case_id, chunk_id) GROUP BY ALL")
def a16(t):
    firsts = evaluate.labelled_first_ranks(ranked(t), cases(t), chunks(t), LABELS).where(F.col("first").isNotNull())
    return firsts.select("case_id", "stage", F.round(F.lit(1.0) / F.col("first"), 6).alias("rr"))


FOLD = r.TR
TERMS = f"list_filter(regexp_extract_all(lower({FOLD}), '[a-z0-9]{{{{3,}}}}'), lambda x: NOT list_contains([{', '.join(chr(39) + w + chr(39) for w in text.STOP_WORDS)}], x))".replace("{{", "{").replace("}}", "}")
FACTS = r"list_transform(regexp_extract_all(lower(text), '[0-9]+(?:[.,][0-9]+)? ?(?:%|eur|euros|ms|jours|mois|heures|minutes)?'), lambda x: replace(trim(x), ' ', ''))"
ANSWERS_SQL = f"""WITH k AS (SELECT conv_id, turn, role, list_distinct({TERMS}) AS ts, list_distinct({FACTS}) AS fs FROM conversations),
s AS (SELECT q.conv_id, q.turn, round(coalesce(len(list_intersect(q.ts, a.ts))::DOUBLE / nullif(len(q.ts), 0), 0), 6) AS term_recall, len(list_filter(q.fs, lambda x: NOT list_contains(a.fs, x)))::BIGINT AS missing_numbers FROM k q JOIN k a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant')"""


def answers(t):
    a = t.conversations.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    rows = t.conversations.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("expected")).join(a, ["conv_id", "turn"])
    return evaluate.answer_scores(rows)


@query("x56_answer_scores", f"{ANSWERS_SQL} SELECT *, term_recall >= 0.85 AND missing_numbers = 0 AS correct FROM s")
def x56(t):
    return answers(t).select("conv_id", "turn", "term_recall", "missing_numbers", "correct")


@query("a21_mission_summary", f"{ANSWERS_SQL} SELECT conv_id, count(*) AS questions, round(avg(term_recall), 6) AS completeness, max(missing_numbers) AS worst FROM s GROUP BY 1")
def a21(t):
    return answers(t).groupBy("conv_id").agg(F.count("*").alias("questions"), F.round(F.avg("term_recall"), 6).alias("completeness"), F.max("missing_numbers").alias("worst"))


@query("j13_golden_validation", "SELECT l.doc_id * 10 + l.toxic AS case_id, l.doc_id + l.toxic * 1000000 AS chunk_id, CASE WHEN d.doc_id IS NULL THEN 'missing chunk' ELSE concat_ws('; ', CASE WHEN d.source IS DISTINCT FROM CASE WHEN l.quality = 1 THEN d0.source ELSE 'src0' END THEN 'wrong document' END, CASE WHEN NOT contains(d.text, substr(d0.text, 5, 30)) THEN 'quote not contained' END) END AS violations FROM labels l JOIN documents d0 ON d0.doc_id = l.doc_id LEFT JOIN documents d ON d.doc_id = l.doc_id + l.toxic * 1000000")
def j13(t):
    g = t.labels.join(t.documents, "doc_id").select((F.col("doc_id") * 10 + F.col("toxic")).alias("case_id"), (F.col("doc_id") + F.col("toxic") * 1000000).alias("chunk_id"), F.when(F.col("quality") == 1, F.col("source")).otherwise("src0").alias("document"), F.substring("text", 5, 30).alias("quote"))
    chunks = t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document"), F.col("text").alias("content"))
    return evaluate.golden_violations(g, chunks)


@query("st3_exchange_protocol", "SELECT conv_id AS request_id, count(*) AS n_events, list_contains(list(role), 'assistant') AND list_contains(list(role), 'user') AND last(role ORDER BY turn) = 'assistant' AS ok FROM conversations GROUP BY 1")
def st3(t):
    kind = F.when(F.col("role") == "assistant", "done").when(F.col("role") == "user", "validation").otherwise("token")
    return jobs.protocol(t.conversations.select(F.col("conv_id").alias("request_id"), F.col("turn").alias("seq"), kind.alias("type")))


_LIFECYCLE_SQL = """WITH ev AS (SELECT user_id AS job_id, CASE event_type WHEN 'signup' THEN 'submit' WHEN 'view' THEN 'start' WHEN 'purchase' THEN 'succeed' WHEN 'error' THEN 'fail' ELSE 'cancel' END AS e, ts, event_id FROM events),
li AS (SELECT job_id, list_prepend({'e': '', 's': 'none', 'n': 0, 'a': false}, list({'e': e, 's': 'none', 'n': 0, 'a': false} ORDER BY ts, event_id)) AS l FROM ev GROUP BY 1),
fo AS (SELECT job_id, list_reduce(l, lambda y, x: {'e': x.e,
 's': CASE WHEN y.s IN ('completed', 'failed', 'cancelled') THEN y.s WHEN x.e = 'submit' THEN 'queued' WHEN x.e = 'cancel' AND y.s <> 'running' THEN 'cancelled' WHEN x.e = 'start' AND y.s = 'queued' THEN 'running' WHEN y.s = 'running' AND x.e IN ('succeed', 'fail') AND y.a THEN 'cancelled' WHEN y.s = 'running' AND x.e = 'succeed' THEN 'completed' WHEN y.s = 'running' AND x.e = 'fail' THEN CASE WHEN y.n < 3 THEN 'queued' ELSE 'failed' END ELSE y.s END,
 'n': y.n + (x.e = 'start' AND y.s = 'queued')::INT, 'a': y.a OR x.e = 'cancel'}) AS z FROM li)
SELECT job_id, z.s AS status, z.n AS attempts FROM fo"""


@query("st5_job_lifecycle", _LIFECYCLE_SQL)
def st5(t):
    kinds = F.when(F.col("event_type") == "signup", "submit").when(F.col("event_type") == "view", "start").when(F.col("event_type") == "purchase", "succeed").when(F.col("event_type") == "error", "fail").otherwise("cancel")
    return jobs.lifecycle(t.events.select(F.col("user_id").alias("job_id"), kinds.alias("event"), F.col("ts").cast("timestamp").alias("event_ts"), "event_id"))
