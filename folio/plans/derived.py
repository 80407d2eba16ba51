"""Queries whose texts Spark derives from the given tables: labelled rows, questions and drafts about their rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate, extraction, grounding, proposal, retrieval
from ..registry import query
from .evaluation import ANSWERS_SQL, answers
from .retrieval import SCORED_SQL, scored

NAME_SQL = "array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || x[2:]), ' ')"


@query("w3_lexical_reserve", f"""WITH {SCORED_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id, page ORDER BY text_score DESC NULLS LAST, chunk_id) AS n FROM sc),
l AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY text_score DESC NULLS LAST, chunk_id) AS m FROM b WHERE n = 1) SELECT query_id, chunk_id FROM l WHERE m <= 3 AND coalesce(text_score, 0) > 0""")
def w3(t):
    return retrieval.protected(scored(t), 3, 0, 0).where("protected").select("query_id", "chunk_id")


TURN_SQL = "c AS (SELECT conv_id * 1000 + turn AS chunk_id, conv_id AS document_id, turn AS page, length(text) AS n FROM conversations), s AS (SELECT document_id % 50 AS query_id, chunk_id, (n % 97) / 100.0::DOUBLE AS score, document_id, page FROM c WHERE n % 3 = 0)"


@query("w9_adjacent_pages", f"WITH {TURN_SQL}, a AS (SELECT query_id, document_id, page + 1 AS page, max(score) AS score FROM s GROUP BY ALL) SELECT a.query_id, c.chunk_id, c.document_id, c.page, round(a.score - 0.0001, 6) AS score FROM a JOIN c USING (document_id, page) ANTI JOIN s ON s.query_id = a.query_id AND s.chunk_id = c.chunk_id")
def w9(t):
    chunks = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"), F.col("conv_id").alias("document_id"), F.col("turn").alias("page"), F.lit(0).alias("chunk_index"), F.length("text").alias("n"))
    selected = chunks.where("n % 3 = 0").select((F.col("document_id") % 50).alias("query_id"), "chunk_id", (F.col("n") % 97 / F.lit(100.0)).alias("score"))
    return retrieval.next_pages(selected, chunks.drop("n"))


@query("p15_sector_preference", "WITH o AS (SELECT *, max(starts_with(o_orderpriority, '1')) OVER (PARTITION BY o_custkey) AS has FROM orders) SELECT o_custkey, o_orderkey FROM o WHERE starts_with(o_orderpriority, '1') OR NOT has")
def p15(t):
    return retrieval.restrict_if_any(t.orders.select("o_custkey", "o_orderkey", "o_orderpriority"), F.startswith("o_orderpriority", F.lit("1")), "o_custkey").select("o_custkey", "o_orderkey")


@query("p19_alternatives_absent", "SELECT p_partkey AS query_id, p_partkey % 2 = 1 AND p_partkey % 5 <> 0 AS absent FROM part")
def p19(t):
    """Names as they are, within longer words, and in lists that call themselves examples."""
    key = F.col("p_partkey")
    asked = F.concat(F.lit("Est-ce un lot ("), F.when(key % 5 == 0, F.lit("par exemple ")).otherwise(F.lit("")), "p_name", F.lit(" ou "), "p_brand", F.lit(") ?"))
    shown = F.when(key % 2 == 0, F.concat(F.lit("Lot : "), "p_name", F.lit("."))).otherwise(F.concat(F.lit("x"), "p_name", F.lit("s")))
    rows = t.part.select(key.alias("query_id"), asked.alias("query"), shown.alias("content"))
    return grounding.alternatives_absent(rows.select("query_id", "query"), rows.select("query_id", "content"))


def asked_projects(t):
    name = F.initcap("p_name")
    return t.part.select("p_partkey", F.concat(F.lit("Quels sont les "), F.lower("p_type"), F.lit(" du projet "), name, F.lit(" ?")).alias("query"))


@query("x2_project_title", f"SELECT p_partkey, {NAME_SQL} AS title FROM part")
def x2(t):
    return asked_projects(t).select("p_partkey", extraction.project_title(F.col("query")).alias("title"))


@query("x4_title_terms", "SELECT p_partkey, array_to_string(regexp_extract_all(lower(p_name), '[a-z0-9]{3,}'), ' ') AS terms FROM part")
def x4(t):
    return asked_projects(t).select("p_partkey", F.array_join(extraction.project_terms(F.col("query")), " ").alias("terms"))


@query("x23_keywords", "SELECT p_partkey, CASE WHEN list_contains(string_split(p_name, ' '), lower(p_type)) THEN 'sont' ELSE 'sont ' || lower(p_type) END AS keywords FROM part")
def x23(t):
    found = extraction.keywords(F.col("query"))
    return asked_projects(t).select("p_partkey", F.array_join(found, " ").alias("keywords"))


@query("x51_metric_rows", "SELECT p_partkey AS document_id, p_name AS indicator, p_size || ' j' AS before, (p_size // 2) || ' j' AS after, CASE WHEN p_partkey % 2 = 0 THEN '-50 %' ELSE '' END AS change FROM part")
def x51(t):
    content = F.concat(F.lit("Indicateur: "), "p_name", F.lit("; Avant: "), "p_size", F.lit(" j; Après: "), F.floor(F.col("p_size") / 2), F.lit(" j"), F.when(F.col("p_partkey") % 2 == 0, F.lit("; Évolution: -50 %")).otherwise(F.lit("")), F.lit("\nSuite."))
    docs = t.part.select(F.col("p_partkey").alias("document_id"), F.lit(1).alias("chunk_id"), content.alias("content"))
    return extraction.metric_rows(docs).select("document_id", "indicator", "before", "after", F.coalesce("change", F.lit("")).alias("change"))


@query("x51_architecture_rows", "SELECT p_partkey AS document_id, 0 AS row, 'données' AS layer, p_type AS technology FROM part UNION ALL SELECT p_partkey, 1, 'portail', p_name FROM part")
def x51_layers(t):
    content = F.concat(F.lit("Couche données: "), "p_type", F.lit("; Couche portail: "), "p_name")
    docs = t.part.select(F.col("p_partkey").alias("document_id"), F.lit(1).alias("chunk_id"), content.alias("content"))
    return extraction.architecture_rows(docs).select("document_id", "row", "layer", "technology")


@query("x54_intent_facts", "SELECT p_partkey AS query_id, CASE p_partkey % 3 WHEN 0 THEN 'member' WHEN 1 THEN 'period' ELSE 'metric' END AS label, CASE p_partkey % 3 WHEN 0 THEN 'Nom: ' || p_brand || '; Rôle: chef' WHEN 1 THEN p_size || ' mois' ELSE 'Indicateur: ' || p_name END AS value FROM part")
def x54(t):
    """Rules of other intents find nothing in a query's chunks, though the text for them is there."""
    key = F.col("p_partkey") % 3
    asked = F.when(key == 0, F.lit("Quelle équipe était là ?")).when(key == 1, F.lit("Quand était-ce ?")).otherwise(F.lit("Quel indicateur ?"))
    content = F.concat(F.lit("Nom: "), "p_brand", F.lit("; Rôle: chef\nPériode: "), "p_size", F.lit(" mois\nIndicateur: "), "p_name")
    rows = t.part.select(F.col("p_partkey").alias("query_id"), asked.alias("query"), F.lit(1).alias("chunk_id"), content.alias("content"))
    return extraction.facts(rows.select("query_id", "query"), rows.select("query_id", "chunk_id", "content")).select("query_id", "label", "value")


@query("x70_leaked_values", "SELECT o_orderkey AS section_id, (o_orderkey % 20 + 1)::VARCHAR AS value FROM orders WHERE o_orderkey % 20 + 1 NOT IN (7, 8, 9)")
def x70(t):
    body = F.concat(F.lit("Le lot coûte "), F.col("o_orderkey") % 20 + 1, F.lit(" euros. Par exemple 777 ailleurs. Encore 8 fois."))
    reference = F.concat(F.lit("réf "), F.col("o_orderkey") % 20 + 1, F.lit(" et 777 et 8"))
    sections = t.orders.select(F.col("o_orderkey").alias("section_id"), body.alias("body"), reference.alias("reference"))
    return proposal.leaked_values(sections, t.spark.createDataFrame([("Il faut 7, 8 ou 9 lots.",)], "brief string"))


@query("x71_structure", "SELECT l_orderkey AS proposal_id, list('S' || l_linenumber ORDER BY l_linenumber) = ['S1', 'S2', 'S3'] AS in_order, bool_and(l_suppkey % 2 = 1) AS rectangular FROM lineitem GROUP BY 1")
def x71(t):
    rows = F.array(F.array_repeat(F.lit("c"), (F.col("l_suppkey") % 2 + 1).cast("int")), F.array(F.lit("a"), F.lit("b")))
    sections = t.lineitem.select(F.col("l_orderkey").alias("proposal_id"), F.col("l_linenumber").alias("position"), F.concat(F.lit("S"), "l_linenumber").alias("title"), rows.alias("rows"))
    return proposal.structure_violations(sections, ["S1", "S2", "S3"])


@query("x45_supported_claims", "SELECT p_partkey AS query_id, 2 AS n_claims, p_partkey % 3 <> 0 AS supported FROM part")
def x45(t):
    """Every third answer says what its second source does not."""
    key = F.col("p_partkey")
    answer = F.concat(F.initcap("p_name"), F.lit(" [1] "), F.when(key % 3 == 0, F.lit("autre")).otherwise(F.col("p_type")), F.lit(" [2]"))
    sources = F.array(F.concat(F.lit("un "), "p_name", F.lit(" ici")), F.concat(F.lit("type "), "p_type"))
    return grounding.answer_supported(t.part.select(key.alias("query_id"), answer.alias("answer"), sources.alias("sources")))


@query("c9_evaluate_answers", f"{ANSWERS_SQL} SELECT count(*) AS cases, round(avg(term_recall), 4) AS mean_recall, count_if(missing_numbers > 0) AS with_missing_numbers, count_if(term_recall >= 0.85 AND missing_numbers = 0) AS correct FROM s")
def c9(t):
    return answers(t).agg(F.count("*").alias("cases"), F.round(F.avg("term_recall"), 4).alias("mean_recall"), F.count_if(F.col("missing_numbers") > 0).alias("with_missing_numbers"), F.count_if("correct").alias("correct"))


@query("c10_validate_golden", "SELECT CASE WHEN d.doc_id IS NULL THEN 'missing chunk' ELSE concat_ws('; ', CASE WHEN d.source IS DISTINCT FROM CASE WHEN l.quality = 1 THEN b.source ELSE 'src0' END THEN 'wrong document' END, CASE WHEN NOT contains(d.text, substr(b.text, 5, 30)) THEN 'quote not contained' END) END AS violations, count(*) AS n FROM labels l JOIN documents b ON b.doc_id = l.doc_id LEFT JOIN documents d ON d.doc_id = l.doc_id + l.toxic * 1000000 GROUP BY 1")
def c10(t):
    live = t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document"), F.col("text").alias("content"))
    golden = t.labels.join(t.documents, "doc_id").select("doc_id", (F.col("doc_id") + F.col("toxic") * 1000000).alias("chunk_id"), F.when(F.col("quality") == 1, F.col("source")).otherwise("src0").alias("document"), F.substring("text", 5, 30).alias("quote"))
    return evaluate.golden_violations(golden.withColumnRenamed("doc_id", "case_id"), live).groupBy("violations").agg(F.count("*").alias("n"))
