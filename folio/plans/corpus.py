"""Ingest, table changes and corpus profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest
from ..registry import ORACLE_SQL, query
from ..sources import buckets, tables


@query("x18_chunker")
def x18(t):
    return ingest.chunked(t.documents, most=200, overlap=30, target=160, least=60)


@query("f5_word_chunks", r"WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r]+') AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(0, len(w), 80)) AS s FROM w WHERE len(w) > 0) SELECT doc_id, s // 80 AS chunk_index, array_to_string(list_slice(w, s + 1, s + 100), ' ') AS content FROM s WHERE s = 0 OR s + 20 < len(w)")
def f5(t):
    return ingest.word_chunks(t.documents, 100, 20)


@query("a24_ingest_totals", r"WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r]+') AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(0, len(w), 80)) AS s FROM w WHERE len(w) > 0), c AS (SELECT doc_id, array_to_string(list_slice(w, s + 1, s + 100), ' ') AS content FROM s WHERE s = 0 OR s + 20 < len(w)) SELECT count(DISTINCT doc_id) AS documents, count(*) AS chunks, sum(length(content))::BIGINT AS characters FROM c")
def a24(t):
    return ingest.ingest_totals(ingest.word_chunks(t.documents, 100, 20))


@query("a25_document_stats", "SELECT conv_id AS doc_id, max(turn) + 1 AS pages, count(*) AS chunks, sum(length(text))::BIGINT AS characters FROM conversations GROUP BY 1")
def a25(t):
    return t.conversations.groupBy(F.col("conv_id").alias("doc_id")).agg((F.max("turn") + 1).alias("pages"), F.count("*").alias("chunks"), F.sum(F.length("text")).alias("characters"))


SCOPED_SQL = "SELECT d.doc_id, CASE WHEN e.vec_id IS NOT NULL THEN 'PDF' WHEN l.doc_id IS NOT NULL THEN 'MISSION' ELSE 'LEGACY' END AS corpus_scope, d.source AS sector, d.lang AS mission_type, CASE WHEN d.n_chars > 300 THEN 'INDEXED' ELSE 'STORED' END AS status FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id"


def scoped(t):
    e = t.embeddings.select(F.col("vec_id").alias("doc_id"), F.col("vec_id").alias("pdf"))
    m = t.labels.select("doc_id", F.col("doc_id").alias("mission"))
    rows = t.documents.join(e, "doc_id", "left").join(m, "doc_id", "left")
    return rows.select("doc_id", ingest.scope(F.col("pdf"), F.col("mission")).alias("corpus_scope"), F.col("source").alias("sector"), F.col("lang").alias("mission_type"), F.when(F.col("n_chars") > 300, "INDEXED").otherwise("STORED").alias("status"))


@query("p1_corpus_scope", f"SELECT doc_id, corpus_scope FROM ({SCOPED_SQL})")
def p1(t):
    return scoped(t).select("doc_id", "corpus_scope")


@query("p2_scope_filter", f"SELECT doc_id, corpus_scope FROM ({SCOPED_SQL}) WHERE corpus_scope = 'PDF' AND status = 'INDEXED' AND (sector IS NULL OR sector = 'src0')")
def p2(t):
    cols = [F.col(c) for c in ("corpus_scope", "sector", "mission_type", "status")]
    return scoped(t).where(ingest.scope_filter(*cols, "PDF", "src0", "ignored")).select("doc_id", "corpus_scope")


@query("p3_mixed_scope", f"SELECT doc_id, corpus_scope FROM ({SCOPED_SQL}) WHERE corpus_scope = 'MISSION' OR (corpus_scope = 'PDF' AND status = 'INDEXED')")
def p3(t):
    cols = [F.col(c) for c in ("corpus_scope", "sector", "mission_type", "status")]
    return scoped(t).where(ingest.scope_filter(*cols, "MISSION") | ingest.scope_filter(*cols, "PDF")).select("doc_id", "corpus_scope")


@query("p5_embedded_only", "SELECT d.doc_id FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id WHERE e.embedding IS NOT NULL")
def p5(t):
    e = t.embeddings.where(F.col("embedding").isNotNull()).select(F.col("vec_id").alias("doc_id"))
    return t.documents.join(e, "doc_id", "left_semi").select("doc_id")


@query("a11_scope_counts", f"SELECT corpus_scope, count(*) AS n FROM ({SCOPED_SQL}) GROUP BY 1")
def a11(t):
    return scoped(t).groupBy("corpus_scope").agg(F.count("*").alias("n"))


@query("a12_provenance_profile", f"SELECT count(*) AS chunks, count(CASE WHEN corpus_scope = 'PDF' THEN doc_id END) AS with_document, count(DISTINCT sector) AS sectors, count(DISTINCT mission_type) AS types FROM ({SCOPED_SQL})")
def a12(t):
    return scoped(t).agg(F.count("*").alias("chunks"), F.count(F.when(F.col("corpus_scope") == "PDF", F.col("doc_id"))).alias("with_document"), F.countDistinct("sector").alias("sectors"), F.countDistinct("mission_type").alias("types"))


@query("p22_expectations", "SELECT 'size_positive' AS rule, sum((n_chars IS NULL OR n_chars <= 0)::INT)::BIGINT AS violations FROM documents UNION ALL SELECT 'known_language', sum((lang IS NULL OR lang NOT IN ('en', 'fr'))::INT)::BIGINT FROM documents UNION ALL SELECT 'has_text', sum((text IS NULL OR length(text) < 100)::INT)::BIGINT FROM documents")
def p22(t):
    return tables.violations(t.documents, {"size_positive": F.col("n_chars") > 0, "known_language": F.col("lang").isin("en", "fr"), "has_text": F.length("text") >= 100})


@query("c14_unique_keys", "SELECT conv_id, turn, count(*) AS n FROM conversations GROUP BY 1, 2 HAVING count(*) > 1 UNION ALL SELECT source_n, NULL, n FROM (SELECT count(*) AS n, -1 AS source_n FROM documents) WHERE n > 0")
def c14(t):
    twice = t.conversations.groupBy("conv_id", "turn").agg(F.count("*").alias("n")).where("n > 1")
    total = t.documents.agg(F.count("*").alias("n")).select(F.lit(-1).cast("bigint").alias("conv_id"), F.lit(None).cast("bigint").alias("turn"), "n")
    return twice.unionByName(total)


@query("s6_batch_append", "SELECT lang, count(*) AS n, sum(length(text))::BIGINT AS characters FROM documents GROUP BY 1")
def s6(t):
    path = tables.scratch(t.spark) + "/chunks"
    tables.append(t.documents.select("doc_id", "text", "lang"), path, ["lang"])
    return t.spark.read.parquet(path).groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("characters"))


@query("s7_upsert", "WITH o AS (SELECT c_custkey AS id, c_name AS title, c_acctbal AS v FROM customer WHERE c_nationkey < 15), n AS (SELECT c_name AS title, -c_acctbal AS v FROM customer WHERE c_nationkey >= 10) SELECT o.id IS NOT NULL AS known, coalesce(n.title, o.title) AS title, CASE WHEN n.title IS NOT NULL THEN n.v ELSE o.v END AS v FROM o FULL JOIN n USING (title)")
def s7(t):
    rows = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_acctbal").alias("v"), "c_nationkey")
    old = rows.where("c_nationkey < 15").select("id", "title", "v")
    new = rows.where("c_nationkey >= 10").select("title", (-F.col("v")).alias("v"))
    out = tables.upsert(old, new, "title", "id")
    last = old.agg(F.max("id")).first()[0]
    return out.select((F.col("id") <= last).alias("known"), "title", "v")


@query("s8_replace_keys", "WITH n AS (SELECT o_custkey, o_orderkey, -o_totalprice AS o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT') SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM n) UNION ALL SELECT * FROM n")
def s8(t):
    old = t.orders.select("o_custkey", "o_orderkey", "o_totalprice")
    new = t.orders.where("o_orderpriority = '1-URGENT'").select("o_custkey", "o_orderkey", (-F.col("o_totalprice")).alias("o_totalprice"))
    return tables.replace_keys(old, new, "o_custkey")


#: Buckets of the small tables here.
_BUCKETS = 32


@query("s7_bucket_upsert", ORACLE_SQL["s7_upsert"])
def s7_buckets(t):
    """The upsert as a write: only the buckets of the keys that come in are rewritten."""
    path = tables.scratch(t.spark) + "/missions"
    rows = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_acctbal").alias("v"), "c_nationkey")
    old = rows.where("c_nationkey < 15").select("id", "title", "v")
    buckets.create(old, path, "title", _BUCKETS)
    buckets.upsert(t.spark, path, rows.where("c_nationkey >= 10").select("title", (-F.col("v")).alias("v")), "title", "id", _BUCKETS)
    last = old.agg(F.max("id")).first()[0]
    return buckets.read(t.spark, path).select((F.col("id") <= last).alias("known"), "title", "v")


@query("s8_bucket_replace", ORACLE_SQL["s8_replace_keys"])
def s8_buckets(t):
    path = tables.scratch(t.spark) + "/chunks"
    new = t.orders.where("o_orderpriority = '1-URGENT'").select("o_custkey", "o_orderkey", (-F.col("o_totalprice")).alias("o_totalprice"))
    buckets.create(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), path, "o_custkey", _BUCKETS)
    buckets.replace(t.spark, path, new, "o_custkey", _BUCKETS)
    return buckets.read(t.spark, path).select("o_custkey", "o_orderkey", "o_totalprice")


@query("s9_cascading_delete", "SELECT 'customer' AS side, count(*) AS n FROM customer WHERE c_acctbal >= 1000 UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 1000)")
def s9(t):
    gone = t.customer.where("c_acctbal < 1000")
    parents, children = tables.cascade_delete(t.customer, t.orders, gone, "c_custkey", "o_custkey")
    side = lambda d, n: d.agg(F.count("*").alias("n")).select(F.lit(n).alias("side"), "n")
    return side(parents, "customer").unionByName(side(children, "orders"))


@query("s9_bucket_cascade", ORACLE_SQL["s9_cascading_delete"])
def s9_buckets(t):
    """Parents and children lie in buckets of the same key: each table is rewritten where the parents that go are."""
    gone = t.customer.where("c_acctbal < 1000").select("c_custkey")
    sides = []
    for rows, key, name in ((t.customer, "c_custkey", "customer"), (t.orders, "o_custkey", "orders")):
        path = f"{tables.scratch(t.spark)}/{name}"
        buckets.create(rows, path, key, _BUCKETS)
        buckets.delete(t.spark, path, gone.select(F.col("c_custkey").alias(key)), key, _BUCKETS)
        sides.append(buckets.read(t.spark, path).agg(F.count("*").alias("n")).select(F.lit(name).alias("side"), "n"))
    return sides[0].unionByName(sides[1])


@query("s18_manifest", "SELECT count(*) AS files, sum(length(text))::BIGINT AS size, array_to_string(list_sort(list_distinct(list(lang))), ',') AS langs, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources FROM documents")
def s18(t):
    rows = t.documents.agg(F.count("*").alias("files"), F.sum(F.length("text")).alias("size"), F.sort_array(F.collect_set("lang")).alias("l"), F.sort_array(F.collect_set("source")).alias("s"))
    return rows.select("files", "size", F.array_join("l", ",").alias("langs"), F.array_join("s", ",").alias("sources"))


@query("u10_distinct_sets", "SELECT DISTINCT source, lang FROM documents")
def u10(t):
    return t.documents.select("source", "lang").distinct()


@query("x20_markdown_rows", """WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) + 1 AS line, p_name, p_type, p_size FROM part)
SELECT p_brand AS doc_id, line, CASE WHEN p_size % 7 = 0 THEN '| ' || p_name || ' | ' || p_type || ' |' ELSE 'Name: ' || p_name || '; Type: ' || p_type || '; Size: ' || p_size END AS evidence FROM r""")
def x20(t):
    """The parts of each brand as a Markdown table, some rows of which lack a cell, and back to labelled lines."""
    short = F.concat(F.lit("| "), "p_name", F.lit(" | "), "p_type", F.lit(" |"))
    row = F.when(F.col("p_size") % 7 == 0, short).otherwise(F.concat(short, F.lit(" "), F.col("p_size").cast("string"), F.lit(" |")))
    lines = t.part.groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", row.alias("row")))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda x: x["row"]), "\n")
    docs = lines.select(F.col("p_brand").alias("doc_id"), F.concat(F.lit("| Name | Type | Size |\n|---|:--|--:|\n"), body).alias("text"))
    return ingest.markdown_rows(docs)
