"""Queries of the judging operators, over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import extraction, grounding, judging, proposal
from ..registry import query
from .evaluation import ANSWERS_SQL, answers
from .retrieval import TR

FOLD = f"lower({TR})"
SENTENCES = r"list_filter(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')"


def any_sql(value: str, words: list[str]) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(value, w.replace("'", "''")) for w in words) + ")"


@query("p8_all_terms", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'large') AND contains(lower(p_name), 'bolt') ORDER BY p_partkey LIMIT 20")
def p8(t):
    return judging.all_terms(t.part.select("p_partkey", "p_name"), "p_name", ["Large", "bolt"], "p_partkey")


PAGE_SQL = r"SELECT page_id AS chunk_id, regexp_extract(url, '([a-z]+\.[a-z]+)/', 1) AS document_id, page_id % 7 AS page, html AS content FROM pages"


def page_chunks(t):
    return t.pages.select(F.col("page_id").alias("chunk_id"), F.regexp_extract("url", r"([a-z]+\.[a-z]+)/", 1).alias("document_id"), (F.col("page_id") % 7).alias("page"), F.col("html").alias("content"))


@query("p13_section_patterns", f"WITH c AS ({PAGE_SQL}), f AS (SELECT *, CASE WHEN contains(lower(content), 'cookie') AND contains(lower(content), 'menu') THEN 0 WHEN contains(lower(content), 'copyright') THEN 1 ELSE 2 END AS priority FROM c WHERE {any_sql('lower(content)', ['cookie', 'copyright', 'privacy', 'menu'])}), r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY priority, page, chunk_id) AS place FROM f) SELECT document_id, chunk_id, priority, place FROM r WHERE place <= 12")
def p13(t):
    return judging.section_backfill(page_chunks(t), ["cookie", "copyright", "privacy", "menu"], [["cookie", "menu"], ["copyright"]]).select("document_id", "chunk_id", "priority", "place")


INTENT_RULES = [(["thtion", "heiten"], [0, 3]), (["erre"], [1]), (["on", "ei"], [2, 4, 5])]


@query("p14_intent_pages", f"""WITH q AS (SELECT conv_id * 100 + turn AS query_id, 'src' || (conv_id % 9) AS document_id, {FOLD} AS f FROM conversations WHERE role = 'user'),
p AS (SELECT *, CASE WHEN contains(f, 'thtion') OR contains(f, 'heiten') THEN [0, 3] WHEN contains(f, 'erre') THEN [1] WHEN contains(f, 'on') OR contains(f, 'ei') THEN [2, 4, 5] END AS pages FROM q),
x AS (SELECT query_id, document_id, greatest(8, 4 * len(pages)) AS most, unnest(pages)::BIGINT AS page FROM p WHERE pages IS NOT NULL),
r AS (SELECT x.query_id, d.doc_id AS chunk_id, x.page, most, row_number() OVER (PARTITION BY query_id ORDER BY x.page, d.doc_id) AS place FROM x JOIN documents d ON d.source = x.document_id AND d.n_chars % 23 = x.page) SELECT query_id, chunk_id, page, place FROM r WHERE place <= most""")
def p14(t):
    queries = t.conversations.where("role = 'user'").select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), F.col("text").alias("query"), F.concat(F.lit("src"), F.col("conv_id") % 9).alias("document_id"))
    chunks = t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), (F.col("n_chars") % 23).cast("long").alias("page"))
    return judging.intent_pages(queries, chunks, INTENT_RULES)


def asked_and_answered(t):
    a = t.conversations.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return t.conversations.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question")).join(a, ["conv_id", "turn"])


STOPS = "[" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "]"
PAIR_TEXT_SQL = "SELECT q.conv_id, q.turn, q.text AS question, a.text AS answer FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant'"


@query("x24_specificity", f"WITH p AS ({PAIR_TEXT_SQL}), k AS (SELECT *, list_distinct(list_filter(regexp_extract_all({FOLD.replace('(text', '(question')}, '[a-z0-9]{{3,}}'), lambda x: NOT list_contains({STOPS}, x))) AS ks, {FOLD.replace('(text', '(answer')} AS f FROM p) SELECT conv_id, turn, len(list_filter(ks, lambda x: contains(f, x)))::BIGINT AS keyword_hits, (turn % 3)::DOUBLE AS text_score, 0.0::DOUBLE AS similarity, -length(answer)::BIGINT AS shortness FROM k")
def x24(t):
    rows = asked_and_answered(t)
    s = judging.specificity(text.terms(F.col("question")), F.col("answer"), (F.col("turn") % 3).cast("double"), F.lit(None).cast("double"))
    return rows.select("conv_id", "turn", s.alias("s")).select("conv_id", "turn", "s.*")


TOPIC_WORDS = judging.TOPICS | {"business_problem": ["tion", "heit", "obj"], "scale": ["regi", "ent", "ette"]}


@query("x41_topic_buckets", f"WITH s AS (SELECT doc_id, {SENTENCES} AS ss FROM documents) SELECT doc_id, " + ", ".join(f"len(list_filter(ss, lambda x: {any_sql(FOLD.replace('(text', '(x'), [w for w in words if '’' not in w])}))::BIGINT AS {name}" for name, words in TOPIC_WORDS.items()) + " FROM s")
def x41(t):
    found = t.documents.select("doc_id", judging.topic_sentences(F.col("text"), TOPIC_WORDS).alias("b"))
    return found.select("doc_id", *[F.size(f"b.{name}").cast("bigint").alias(name) for name in TOPIC_WORDS])


@query("x58_grounded_flag", f"WITH p AS ({PAIR_TEXT_SQL}), a AS (SELECT conv_id, turn, CASE WHEN conv_id % 4 = 0 THEN 'insufficient' ELSE answer END AS answer, CASE WHEN turn % 3 = 0 THEN 0 ELSE length(question) % 3 END AS n, conv_id % 4 < 2 AS abstain FROM p) SELECT conv_id, turn, CASE WHEN abstain THEN answer = 'insufficient' AND n = 0 ELSE answer <> 'insufficient' AND n > 0 END AS grounded FROM a")
def x58(t):
    answer = F.when(F.col("conv_id") % 4 == 0, F.lit("insufficient")).otherwise(F.col("answer"))
    n = F.when(F.col("turn") % 3 == 0, 0).otherwise(F.length("question") % 3)
    return asked_and_answered(t).select("conv_id", "turn", judging.grounded(answer, n, F.col("conv_id") % 4 < 2, "insufficient").alias("grounded"))


LINES_SQL = "SELECT l_orderkey, list(l_linenumber::INT ORDER BY l_linenumber) AS cards, count(*) AS n FROM lineitem GROUP BY 1"


@query("u8_marker_card_sets", f"WITH l AS ({LINES_SQL}) SELECT o_orderkey, list_sort(list_distinct([1, (o_custkey % 3 + 1)::INT])) = cards AS same FROM orders JOIN l ON l_orderkey = o_orderkey")
def u8(t):
    cards = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(F.col("l_linenumber").cast("int"))).alias("cards"))
    rows = t.orders.select("o_orderkey", F.concat(F.lit("so [1] and ["), F.col("o_custkey") % 3 + 1, F.lit("]")).alias("answer")).join(cards, "o_orderkey")
    return rows.select("o_orderkey", judging.cards_match(F.col("answer"), F.col("cards")).alias("same"))


@query("a27_confidence", """WITH c AS (SELECT o_orderkey, unnest(list_distinct([o_orderkey % 3 + 1, o_custkey % 5 + 1])) AS i FROM orders), s AS (SELECT l_orderkey, l_linenumber AS i, greatest(0, least(1, coalesce(CASE WHEN l_tax > 0.02 THEN l_discount * 12 END, l_tax * 5, 0))) AS s FROM lineitem), m AS (SELECT o_orderkey, CASE WHEN count(s) < count(*) THEN 0 ELSE round(avg(s), 6) END AS confidence FROM c LEFT JOIN s ON l_orderkey = o_orderkey AND s.i = c.i GROUP BY 1) SELECT o_orderkey AS query_id, confidence::DOUBLE AS confidence FROM m""")
def a27(t):
    given = t.orders.select(F.col("o_orderkey").alias("query_id"), F.concat(F.lit("see ["), F.col("o_orderkey") % 3 + 1, F.lit("] and ["), F.col("o_custkey") % 5 + 1, F.lit("]")).alias("answer"))
    sources = t.lineitem.select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("source_index"), F.when(F.col("l_tax") > 0.02, F.col("l_discount") * 12).alias("vector_score"), (F.col("l_tax") * 5).alias("relevance_score"))
    return judging.confidence(given, sources)


@query("a30_draft_score", "WITH c AS (SELECT l_orderkey, count_if(l_returnflag = 'R') AS hard, count_if(l_returnflag = 'A') AS soft FROM lineitem GROUP BY 1) SELECT l_orderkey, hard, soft, round(greatest(0, CASE WHEN hard > 0 THEN greatest(0, 0.5::DOUBLE - 0.1::DOUBLE * hard) ELSE 1 END - 0.05::DOUBLE * soft), 2) AS score, hard = 0 AS passed FROM c")
def a30(t):
    w = F.when(F.col("l_returnflag") == "R", F.lit("Section 2: uncited claim")).when(F.col("l_returnflag") == "A", F.lit("Section 4: too long"))
    return judging.draft_scores(t.lineitem.select("l_orderkey", w.alias("warning")), "l_orderkey")


@query("a31_stability", "SELECT o_custkey, o_orderpriority, count(*) AS runs, round(avg((o_orderstatus = 'F')::INT), 6) AS success_rate, count(DISTINCT o_orderstatus) AS distinct_answers, array_to_string(list_sort(list_distinct(list(o_orderstatus))), ',') AS answers FROM orders GROUP BY ALL")
def a31(t):
    return judging.stability(t.orders.withColumns({"success": F.col("o_orderstatus") == "F", "answer": F.col("o_orderstatus")}), ["o_custkey", "o_orderpriority"])


@query("a33_brief_rubric", """WITH b AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 422 WHEN 1 THEN 500 ELSE 200 END AS status, p_partkey % 5 = 0 AS refuse, p_size / 50.0::DOUBLE AS cov, p_partkey % 20 AS ns, p_type IN ('ECONOMY', 'PROMO') AS ev, p_partkey % 3 AS src, p_partkey % 2 AS ma, p_partkey % 4 < 2 AS passed, CASE WHEN p_partkey % 6 < 3 THEN 'NO_RELEVANT_PDF_EVIDENCE' END AS diag FROM part),
s AS (SELECT *, round(cov * 40, 1) + CASE WHEN ns = 19 THEN 30 ELSE round(ns / 19.0::DOUBLE * 30, 1) END + CASE WHEN ev THEN CASE WHEN ma > 0 AND passed AND diag IS NULL THEN 30 WHEN src > 0 THEN 15 ELSE 0 END WHEN src = 0 AND NOT passed AND diag IS NOT NULL THEN 30 ELSE -50 END AS pts FROM b)
SELECT p_partkey, CASE WHEN refuse THEN CASE WHEN status IN (400, 422) THEN 100 ELSE 0 END WHEN status = 200 THEN greatest(0, least(100, floor(pts + 1e-9)::INT)) ELSE 0 END AS score FROM s""")
def a33(t):
    key = F.col("p_partkey")
    rows = t.part.select(
        "p_partkey", F.when(key % 7 == 0, 422).when(key % 7 == 1, 500).otherwise(200).alias("status"), (key % 5 == 0).alias("to_refuse"), (F.col("p_size") / F.lit(50.0)).alias("coverage"), (key % 20).alias("n_sections"),
        F.col("p_type").isin("ECONOMY", "PROMO").alias("expects_evidence"), (key % 3).alias("n_sources"), (key % 2).alias("n_matching"), (key % 4 < 2).alias("evidence_passed"), F.when(key % 6 < 3, F.lit("NO_RELEVANT_PDF_EVIDENCE")).alias("diagnostic"),
    )
    return rows.select("p_partkey", judging.brief_score(rows).alias("score"))


@query("a34_failure_causes", f"{ANSWERS_SQL}, p AS (SELECT conv_id, arg_max(role, turn) = 'assistant' AS ok FROM conversations GROUP BY 1) SELECT CASE WHEN s.conv_id % 11 = 0 THEN 'request' WHEN NOT ok THEN 'protocol' WHEN turn % 8 = 4 THEN 'provenance' WHEN term_recall < 0.05 THEN 'citation' WHEN missing_numbers > 0 THEN 'answer' ELSE 'style' END AS cause, count(*) AS n FROM s JOIN p USING (conv_id) GROUP BY 1")
def a34(t):
    ended = t.conversations.groupBy("conv_id").agg((F.max_by("role", "turn") == "assistant").alias("protocol_ok"))
    rows = answers(t).join(ended, "conv_id").select(
        F.when(F.col("conv_id") % 11 == 0, F.lit("timeout")).alias("request_error"), "protocol_ok", (F.col("turn") % 8 != 4).alias("provenance_ok"), (F.col("term_recall") >= 0.05).alias("citation_correct"), (F.col("missing_numbers") == 0).alias("answer_correct")
    )
    return rows.groupBy(judging.failure_cause(rows).alias("cause")).agg(F.count("*").alias("n"))


@query("a22_golden_accuracy", f"{ANSWERS_SQL}, r AS (SELECT conv_id % 5 = 0 AS ab, CASE WHEN conv_id % 5 = 0 THEN term_recall < 0.05 ELSE term_recall >= 0.05 END AS ok, missing_numbers = 0 AS ci, turn % 4 = 0 AS gr FROM s) SELECT count(*) AS cases, round(avg(ok::INT), 4) AS answer_accuracy, round(avg(ci::INT), 4) AS citation_accuracy, round(avg(gr::INT), 4) AS grounded_accuracy, round(avg(CASE WHEN NOT ab THEN ok::INT END), 4) AS positive_answer_accuracy, round(avg(CASE WHEN ab THEN ok::INT END), 4) AS abstention_accuracy FROM r")
def a22(t):
    abstain, found = F.col("conv_id") % 5 == 0, F.col("term_recall") >= 0.05
    rows = answers(t).select(abstain.alias("should_abstain"), F.when(abstain, ~found).otherwise(found).alias("answer_correct"), (F.col("missing_numbers") == 0).alias("citation_correct"), (F.col("turn") % 4 == 0).alias("grounded_correct"))
    return judging.golden_accuracy(rows)


@query("a26_diagnostics", f"{ANSWERS_SQL} SELECT CASE WHEN term_recall < 0.02 THEN 'no_evidence' WHEN missing_numbers > 0 THEN 'missing_numbers' END AS diagnostic, count(*) AS n FROM s WHERE term_recall < 0.02 OR missing_numbers > 0 GROUP BY 1")
def a26(t):
    return grounding.diagnostics(answers(t).select(F.when(F.col("term_recall") < 0.02, "no_evidence").when(F.col("missing_numbers") > 0, "missing_numbers").alias("diagnostic")))


@query("j24_identity_sentence", rf"""WITH i AS (SELECT conv_id * 100 + turn AS query_id, conv_id, turn, regexp_extract({FOLD}, '[a-z0-9]+') AS anchor FROM conversations WHERE role = 'user'),
c AS (SELECT conv_id, turn, {FOLD} AS f, text FROM conversations), r AS (SELECT i.query_id, i.turn AS own_chunk, c.turn AS chunk_id, anchor, text FROM i JOIN c ON c.conv_id = i.conv_id AND c.turn <> i.turn WHERE anchor <> '' AND regexp_matches(f, '(^|[^a-z0-9])' || anchor || '($|[^a-z0-9])')),
x AS (SELECT query_id, own_chunk, chunk_id, anchor, string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)) AS ss FROM r), y AS (SELECT * EXCLUDE (ss), unnest(ss) AS sentence, unnest(range(len(ss))) AS pos FROM x),
z AS (SELECT *, CASE WHEN contains({FOLD.replace('(text', '(sentence')}, 'the ') THEN 10 ELSE 0 END - CASE WHEN contains({FOLD.replace('(text', '(sentence')}, 'tion of') THEN 20 ELSE 0 END AS score FROM y WHERE contains({FOLD.replace('(text', '(sentence')}, anchor) AND len(regexp_extract_all(sentence, '[^ \t\n\r]+')) >= 6)
SELECT query_id, own_chunk, chunk_id, trim(sentence) AS sentence, score::BIGINT AS score FROM z QUALIFY row_number() OVER (PARTITION BY query_id, own_chunk ORDER BY score DESC, chunk_id, pos) = 1""")
def j24(t):
    rows = t.conversations.select("conv_id", F.col("turn").alias("chunk_id"), F.col("conv_id").alias("document_id"), F.col("text").alias("content"), "role")
    own = rows.where("role = 'user'").select((F.col("conv_id") * 100 + F.col("chunk_id")).alias("query_id"), "chunk_id", "document_id", F.regexp_extract(text.fold(F.col("content")), "[a-z0-9]+", 0).alias("anchor"))
    return judging.identity_sentence(own, rows.select("chunk_id", "document_id", "content"), mark="the ", unwanted=["tion of"])


@query("x5_named_terms", "SELECT p_partkey, list_sort(regexp_extract_all(lower(p_name), '[a-z0-9]{3,}')) = list_sort(list_filter(regexp_extract_all(lower(p_name), '[a-z0-9]{3,}'), lambda w: contains(lower(p_type) || ' ' || replace(lower(p_name), CASE WHEN p_partkey % 3 = 0 THEN 'widget' ELSE '~' END, 'gadget'), w))) AS named FROM part")
def x5(t):
    asked = F.concat(F.lit('Quel est le budget de "'), "p_name", F.lit('" ?'))
    shown = F.when(F.col("p_partkey") % 3 == 0, F.replace("p_name", F.lit("widget"), F.lit("gadget"))).otherwise(F.col("p_name"))
    return t.part.select("p_partkey", extraction.names_project(asked, F.col("p_type"), shown).alias("named"))


@query("p7_named_project", r"SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN true WHEN p_partkey % 4 = 1 THEN true WHEN p_partkey % 4 = 2 THEN true ELSE false END AS named FROM part")
def p7(t):
    """Names in file names as they are, in another order, in the text alone, and within longer words."""
    key = F.col("p_partkey") % 4
    asked = F.concat(F.lit("Résumé du projet «"), F.initcap("p_name"), F.lit("» ?"))
    turned = F.array_join(F.reverse(F.split("p_name", " ")), "_")
    name = F.when(key == 0, F.concat(F.lit("2024_"), "p_name", F.lit(".pdf"))).when(key == 1, F.concat(turned, F.lit("_report.pdf"))).otherwise("other.pdf")
    body = F.when(key == 2, F.concat(F.lit("About the "), "p_name", F.lit("."))).otherwise(F.concat(F.lit("x"), "p_name", F.lit("s")))
    return t.part.select("p_partkey", judging.names_project(asked, name, F.lit(None).cast("string"), body).alias("named"))


@query("x15_lexical_bonus", "SELECT l_orderkey, l_linenumber, round(l_discount + 0.02::DOUBLE * coalesce(CASE WHEN l_tax > 0.02 THEN l_quantity END, 0), 6) AS score FROM lineitem")
def x15(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(F.col("l_discount") + F.lit(0.02) * F.coalesce(F.when(F.col("l_tax") > 0.02, F.col("l_quantity")), F.lit(0.0)), 6).alias("score"))


ROLES = {"problem": ["thtion", "heit"], "solution": ["erre", "ung"], "result": ["ouen", "ette"]}


@query("k11_role_sentences", f"""WITH s AS (SELECT doc_id, {SENTENCES} AS ss FROM documents), y AS (SELECT doc_id AS query_id, unnest(ss) AS sentence, unnest(range(len(ss))) AS place FROM s), z AS (SELECT query_id, sentence, min(place)::BIGINT AS place, (length(sentence) % 10)::BIGINT AS score FROM y GROUP BY query_id, sentence),
f AS (SELECT *, {any_sql(FOLD.replace('(text', '(sentence'), ROLES['problem'])} AS a, {any_sql(FOLD.replace('(text', '(sentence'), ROLES['solution'])} AS b, {any_sql(FOLD.replace('(text', '(sentence'), ROLES['result'])} AS c FROM z),
r1 AS (SELECT *, 'problem' AS role FROM f WHERE a QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place) = 1), l1 AS (SELECT * FROM f ANTI JOIN r1 USING (query_id, sentence)),
r2 AS (SELECT *, 'solution' AS role FROM l1 WHERE b QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place) = 1), l2 AS (SELECT * FROM l1 ANTI JOIN r2 USING (query_id, sentence)),
r3 AS (SELECT *, 'result' AS role FROM l2 WHERE c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place) = 1),
ch AS (SELECT * FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3) QUALIFY count(*) OVER (PARTITION BY query_id) >= 2)
SELECT query_id, role, place, score FROM ch UNION ALL SELECT query_id, NULL, place, score FROM (SELECT * FROM z ANTI JOIN ch USING (query_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place) <= 4)""")
def k11(t):
    rows = t.documents.select(F.col("doc_id").alias("query_id"), F.posexplode(text.sentences(F.col("text"))).alias("place", "sentence"))
    rows = rows.groupBy("query_id", "sentence").agg(F.min("place").cast("bigint").alias("place")).withColumn("score", (F.length("sentence") % 10).cast("bigint"))
    return judging.best_per_role(rows, ROLES).select("query_id", "role", "place", "score")


@query("p21_mission_violations", """WITH m AS (SELECT c_custkey, c_mktsegment AS sector, CASE WHEN c_nationkey % 9 = 0 THEN NULL ELSE c_nationkey % 5 END AS n, c_acctbal > 0 AS syn FROM customer)
SELECT c_custkey, array_to_string(list_filter([CASE WHEN n IS NULL THEN 'missing documents' END, CASE WHEN sector NOT IN ('BUILDING', 'MACHINERY') THEN 'unknown sector' END, CASE WHEN NOT syn THEN 'not synthetic' END, CASE WHEN coalesce(n, 0) NOT BETWEEN 2 AND 4 THEN 'needs 2 to 4 documents' END, CASE WHEN sector = 'FURNITURE' THEN 'forbidden name' END], lambda x: x IS NOT NULL), '; ') AS violations FROM m""")
def p21(t):
    n = F.when(F.col("c_nationkey") % 9 != 0, (F.col("c_nationkey") % 5).cast("int"))
    body = F.struct(F.lit("note").alias("kind"), F.lit("text").alias("content"))
    missions = t.customer.select(
        "c_custkey", F.col("c_custkey").alias("id"), F.lit("t").alias("title"), F.col("c_mktsegment").alias("sector"), F.lit("audit").alias("mission_type"), F.array(F.lit("spark")).alias("technologies"), (F.col("c_acctbal") > 0).alias("synthetic"), F.when(n.isNotNull(), F.array_repeat(body, n)).alias("documents")
    )
    checked = judging.mission_violations(missions, ["BUILDING", "MACHINERY"], ["audit"], ["furniture"])
    return checked.select("c_custkey", F.array_join("violations", "; ").alias("violations"))
