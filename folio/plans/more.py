"""More of the retrieval, evaluation and text operators over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import models, scores, text
from ..operators import proposal, retrieval
from ..registry import query
from . import retrieval as r
from .drafts import FOLD, STOP

ENDS = "|".join(dict.fromkeys(text.ENDINGS))


@query("s5_parameters", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '2-HIGH' AND o_totalprice >= 100000")
def s5(t):
    t.orders.createOrReplaceTempView("folio_orders")
    return t.spark.sql("SELECT o_orderkey, o_totalprice FROM folio_orders WHERE o_orderpriority = :priority AND o_totalprice >= :least", args={"priority": "2-HIGH", "least": 100000})


LEX = f"list_transform(list_filter(regexp_extract_all({FOLD}, '[a-z0-9]{{3,}}'), lambda x: NOT list_contains({STOP}, x)), lambda x: regexp_replace(x, '^(.{{4,}}?)(?:{ENDS})$', '\\1'))"


@query("x8_lexemes", f"SELECT doc_id, array_to_string({LEX}, ' ') AS lexemes FROM documents")
def x8(t):
    return t.documents.select("doc_id", F.array_join(text.lexemes(F.col("text")), " ").alias("lexemes"))


@query("s10_lexeme_column", f"SELECT lang, sum(len({LEX}))::BIGINT AS n FROM documents GROUP BY 1")
def s10(t):
    """The lexeme column is made when a table is written, and read back."""
    from ..sources import tables

    path = tables.scratch(t.spark) + "/chunks"
    t.documents.select("doc_id", "lang", text.lexemes(F.col("text")).alias("lexemes")).write.parquet(path)
    return t.spark.read.parquet(path).groupBy("lang").agg(F.sum(F.size("lexemes")).alias("n"))


@query("p6_full_text_match", f"WITH {r.LEX_SQL} SELECT query_id, count(DISTINCT chunk_id) AS n FROM po JOIN qt USING (term) GROUP BY 1")
def p6(t):
    return r.words.matching(r.query_terms(t), r.word_index(t))


@query("p12_exact_family", f"WITH {r.SCORED_SQL}, x AS (SELECT query_id, chunk_id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY document_id, page, chunk_id) AS n FROM sc WHERE document_id IN ('src0', 'src1', 'src2')) SELECT query_id, chunk_id, n FROM x WHERE n <= 4")
def p12(t):
    rows = r.scored(t).where(F.col("document_id").isin("src0", "src1", "src2"))
    at = Window.partitionBy("query_id").orderBy("document_id", "page", "chunk_id")
    return rows.withColumn("n", F.row_number().over(at).cast("bigint")).where("n <= 4").select("query_id", "chunk_id", "n")


@query("p24_topical_evidence", f"WITH c AS (SELECT doc_id, source, {FOLD} AS f FROM documents), h AS (SELECT *, contains(f, 'reti')::INT + contains(f, 'heiten')::INT + contains(f, 'mentre')::INT AS hits FROM c) SELECT source, doc_id, hits::BIGINT AS hits FROM h WHERE hits > 0 QUALIFY row_number() OVER (PARTITION BY source ORDER BY hits DESC, doc_id) = 1")
def p24(t):
    folded = text.fold(F.col("text"))
    hits = sum((F.contains(folded, F.lit(w)).cast("int") for w in ("reti", "heiten", "mentre")), F.lit(0))
    return retrieval.best_scored(t.documents.select("doc_id", "source", hits.cast("bigint").alias("hits")), ["source"], "hits", "doc_id").select("source", "doc_id", "hits")


@query("p17_evidence_admission", "SELECT conv_id AS query_id, count(*) AS n FROM (SELECT DISTINCT conv_id, turn // 3 AS page, lower(trim(text)) AS c FROM conversations WHERE trim(text) <> '') GROUP BY 1")
def p17(t):
    from ..operators import grounding

    rows = r.pages_of_turns(t).select(F.col("document_id").alias("query_id"), "chunk_id", "document_id", F.lit("conversation").alias("document_name"), "page", F.col("text").alias("content"), F.col("chunk_index").alias("rank"))
    return grounding.evidence_catalogue(rows).groupBy("query_id").agg(F.count("*").alias("n"))


@query("j12_expected_match", "SELECT a.conv_id, a.turn FROM conversations a JOIN (SELECT conv_id, turn + 1 AS turn, role FROM conversations WHERE role = 'user') e ON e.conv_id = a.conv_id AND e.turn = a.turn WHERE a.role = 'assistant'")
def j12(t):
    wanted = t.conversations.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"))
    return t.conversations.where("role = 'assistant'").join(wanted, ["conv_id", "turn"], "left_semi").select("conv_id", "turn")


@query("j14_citation_correctness", "WITH c AS (SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_linenumber = 1), e AS (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R') SELECT l_orderkey, max((e.l_partkey IS NOT NULL)::INT) = 1 AS correct FROM c LEFT JOIN e USING (l_orderkey, l_partkey, l_suppkey) GROUP BY 1")
def j14(t):
    keys = ["l_orderkey", "l_partkey", "l_suppkey"]
    cited = t.lineitem.where("l_linenumber = 1").select(*keys)
    wanted = t.lineitem.where("l_returnflag = 'R'").select(*keys).distinct().withColumn("hit", F.lit(True))
    return cited.join(wanted, keys, "left").groupBy("l_orderkey").agg(F.bool_or(F.coalesce("hit", F.lit(False))).alias("correct"))


@query("j16_packets", "WITH p AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders QUALIFY n <= 2), h AS (SELECT o_custkey, min(CASE WHEN c_acctbal > 9000 THEN c_custkey ELSE 1073741824 END) AS pr FROM p LEFT JOIN customer ON c_custkey = o_custkey GROUP BY 1 ORDER BY pr, o_custkey LIMIT 12) SELECT o_custkey AS packet_id, o_orderkey AS evidence_id FROM p JOIN h USING (o_custkey)")
def j16(t):
    needs = t.customer.where("c_acctbal > 9000").select(F.col("c_custkey").alias("need_id"), F.col("c_custkey").cast("int").alias("priority"))
    packets = t.orders.select(F.col("o_custkey").alias("packet_id"), F.col("o_custkey").alias("need_id"), F.col("o_orderkey").alias("evidence_id"), F.struct("o_orderdate", "o_orderkey").alias("rank"))
    return proposal.evidence_packets(needs, packets).select("packet_id", "evidence_id")


@query("j20_citation_chunks", r"WITH c AS (SELECT page_id, unnest(regexp_extract_all(html, 'page=([0-9]+)', 1))::BIGINT AS ref FROM pages) SELECT c.page_id, ref, d.doc_id FROM (SELECT DISTINCT * FROM c) c JOIN documents d ON d.doc_id = c.ref")
def j20(t):
    cited = t.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit("page=([0-9]+)"), F.lit(1))).alias("ref")).select("page_id", F.col("ref").cast("bigint").alias("ref")).distinct()
    return cited.join(t.documents.select(F.col("doc_id").alias("ref"), "doc_id"), "ref").select("page_id", "ref", "doc_id")


@query("w2_branch_ranks", "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS rank FROM events")
def w2(t):
    at = Window.partitionBy("user_id", "event_type").orderBy(F.desc("value"), "event_id")
    return t.events.select("event_id", F.row_number().over(at).cast("bigint").alias("rank"))


@query("w5_safeguard_order", f"WITH {r.PROTECTED_SQL} SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY protected::INT DESC, coalesce(vector_score, 0) DESC, chunk_id) AS place FROM pp")
def w5(t):
    rows = retrieval.protected(r.scored(t), 3, 2, 2).withColumn("score", F.coalesce("vector_score", F.lit(0.0)))
    return retrieval.safeguarded(rows).select("query_id", "chunk_id", "place")


@query("w6_coverage_selection", f"WITH {r.PROTECTED_SQL}, o AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY protected::INT DESC, rank, chunk_id) AS place FROM pp) SELECT * FROM o WHERE place <= 10")
def w6(t):
    rows = retrieval.protected(r.scored(t), 3, 2, 2).withColumn("reserved", F.col("protected"))
    return retrieval.coverage_aware(rows, retrieval.final_count(8)).select("query_id", "chunk_id", "place")


@query("w13_evidence_numbers", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'assistant'")
def w13(t):
    at = Window.partitionBy("conv_id").orderBy("turn")
    return t.conversations.where("role = 'assistant'").select("conv_id", "turn", F.row_number().over(at).cast("bigint").alias("n"))


@query("a29_quality_score", "WITH s AS (SELECT o_custkey, count(*) AS n, sum((o_orderstatus = 'F')::INT) AS ev, max((o_orderpriority = '1-URGENT')::INT) AS risk FROM orders GROUP BY 1), q AS (SELECT *, least(1, greatest(0, (least(25, 15 + 2.5::DOUBLE * ev) + CASE WHEN n = 19 THEN 13 ELSE round(least(n, 19) / 19.0::DOUBLE * 15, 1) END + CASE WHEN risk = 1 THEN 10 ELSE 7 END + least(5, 1.5::DOUBLE * ev) + 32) / 100)) AS raw FROM s) SELECT o_custkey, round(CASE WHEN ev = 0 THEN least(raw, 0.70) ELSE raw END, 6) AS score FROM q")
def a29(t):
    s = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("ev"), F.max((F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("risk"))
    return s.select("o_custkey", F.round(proposal.composite_score(F.col("n"), F.col("ev"), F.col("risk") == 1), 6).alias("score"))


@query("a32_word_totals", r"SELECT conv_id, count(*) AS sections, sum(len(regexp_extract_all(text, '[^ \t\n\r]+')))::BIGINT AS words FROM conversations GROUP BY 1")
def a32(t):
    return t.conversations.groupBy("conv_id").agg(F.count("*").alias("sections"), F.sum(text.word_count(F.col("text"))).cast("bigint").alias("words"))


@query("k3_fusion_top_k", f"WITH {r.FUSE_SQL} SELECT query_id, chunk_id, rrf_score FROM fr WHERE rank <= 5")
def k3(t):
    return retrieval.fuse([(r.vectors(t), 1.0), (r.lexical(t), 1.0)], 5).select("query_id", "chunk_id", "rrf_score")


@query("k4_mission_top_k", "SELECT c_mktsegment, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) <= 5")
def k4(t):
    at = Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    return t.customer.withColumn("n", F.row_number().over(at)).where("n <= 5").select("c_mktsegment", "c_custkey", "c_acctbal")


@query("k5_final_count", "SELECT o_orderkey, least(greatest((o_orderkey % 30)::INT, 10), 15) AS k FROM orders")
def k5(t):
    return t.orders.select("o_orderkey", F.least(F.greatest((F.col("o_orderkey") % 30).cast("int"), F.lit(10)), F.lit(15)).alias("k"))


@query("x6_expanded_query", f"SELECT conv_id, turn, text || CASE WHEN contains({FOLD}, 'que') THEN ' question demande' ELSE '' END || CASE WHEN contains({FOLD}, 'the') THEN ' article text' ELSE '' END AS expanded FROM conversations WHERE role = 'user'")
def x6(t):
    from ..operators import extraction

    rows = t.conversations.where("role = 'user'")
    return rows.select("conv_id", "turn", extraction.expanded(F.col("text"), {"que": ["question", "demande"], "the": ["article", "text"]}).alias("expanded"))


@query("x22_answer_mode", f"WITH c AS (SELECT page_id, {FOLD.replace('text', 'html')} AS f FROM pages) SELECT page_id, CASE WHEN contains(f, 'fiche') AND (contains(f, 'identite') OR contains(f, 'complete')) THEN 'identity' WHEN contains(f, 'equipe') AND (contains(f, 'quelle') OR contains(f, 'composition') OR contains(f, 'projet')) THEN 'team' WHEN contains(f, 'budget') THEN 'budget' WHEN contains(f, 'perimetre') AND (contains(f, 'exclu') OR contains(f, 'hors') OR contains(f, 'non inclus')) THEN 'scope' WHEN contains(f, 'objectif') AND contains(f, 'technique') THEN 'objectives' WHEN contains(f, 'resultat mesure') OR contains(f, 'resultats mesures') OR contains(f, 'indicateur') THEN 'metrics' WHEN contains(f, 'probleme initial') AND contains(f, 'solution') AND (contains(f, 'resultat') OR contains(f, 'impact')) THEN 'summary' WHEN contains(f, 'architecture') OR contains(f, 'choix technique') OR contains(f, 'mesures de securite') OR contains(f, 'technologie') THEN 'architecture' ELSE 'default' END AS mode FROM c")
def x22(t):
    return t.pages.select("page_id", text.answer_mode(F.col("html")).alias("mode"))


@query("x28_significant_terms", f"SELECT doc_id, len(list_distinct(list_filter(regexp_extract_all({FOLD}, '[a-z0-9]{{4,}}'), lambda x: NOT list_contains({STOP}, x))))::BIGINT AS n FROM documents")
def x28(t):
    return t.documents.select("doc_id", F.size(text.terms(F.col("text"), 4)).cast("bigint").alias("n"))


@query("x53_renumbered", r"SELECT conv_id, turn, '[9] ' || replace(replace(text, '[', '('), ']', ')') || ' ' AS text FROM conversations")
def x53(t):
    """Marks [1] and [7] before and after each turn, of which only the first has a new number."""
    plain = F.replace(F.replace("text", F.lit("["), F.lit("(")), F.lit("]"), F.lit(")"))
    marked = F.concat(F.lit("[1] "), plain, F.lit(" [7]"))
    return t.conversations.select("conv_id", "turn", text.renumbered(marked, F.create_map(F.lit(1), F.lit(9))).alias("text"))


@query("x65_pages", r"SELECT o_orderkey, array_to_string(regexp_extract_all('p. ' || (o_orderkey % 50) || ', ' || (o_custkey % 9), '[0-9]+'), ',') AS pages FROM orders")
def x65(t):
    said = F.format_string("réponse — p. %d, %d", F.col("o_orderkey") % 50, F.col("o_custkey") % 9)
    return t.orders.select("o_orderkey", F.array_join(F.transform(text.pages_of(said), lambda x: x.cast("string")), ",").alias("pages"))


@query("x38_hard_warnings", "SELECT page_id, contains(lower(html), 'invented') OR contains(lower(html), 'unknown source') OR contains(lower(html), 'uncited') OR contains(lower(html), 'leak') OR contains(lower(html), 'duplicate claim') OR contains(lower(html), 'missing section') OR contains(lower(html), 'invalid table') AS hard FROM pages")
def x38(t):
    from ..functions import quality

    return t.pages.select("page_id", quality.is_hard(F.col("html")).alias("hard"))


@query("x13_source_similarity", "SELECT vec_id, round(least(greatest(coalesce(CASE WHEN label > 4 THEN embedding[1]::DOUBLE END, embedding[2]::DOUBLE, 0), 0), 1), 6) AS s FROM embeddings")
def x13(t):
    vector = F.when(F.col("label") > 4, F.col("embedding")[0].cast("double"))
    return t.embeddings.select("vec_id", F.round(scores.source_similarity(vector, F.col("embedding")[1].cast("double")), 6).alias("s"))


@query("f2_overlap_rerank", f"WITH k AS (SELECT conv_id, turn, role, list_distinct(list_filter(regexp_extract_all({FOLD}, '[a-z0-9]{{3,}}'), lambda x: NOT list_contains({STOP}, x))) AS ts FROM conversations) SELECT q.conv_id, q.turn, round(coalesce(len(list_intersect(q.ts, a.ts))::DOUBLE / nullif(len(q.ts), 0), 0), 6) AS score FROM k q JOIN k a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user'")
def f2(t):
    a = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("passage"))
    rows = t.conversations.where("role = 'user'").select("conv_id", "turn", "text").join(a, ["conv_id", "turn"])
    return rows.select("conv_id", "turn", F.round(models.overlap_score(F.col("text"), F.col("passage")), 6).alias("score"))


@query("f1_encoded_documents")
def f1(t):
    rows = models.embedded(t.documents.select("doc_id", "text"), models.HashedTerms(64))
    return rows.select("doc_id", F.size("embedding").alias("dim"), F.round(scores.dot(F.col("embedding"), F.col("embedding")), 3).alias("norm"))
