"""Joins, set operations and table windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..registry import query


@query("j1_enrichment", "SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0 LEFT JOIN nation ON n_nationkey = c_nationkey")
def j1(t):
    c = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name", F.col("c_nationkey").alias("n_nationkey"))
    return t.orders.select("o_orderkey", "o_custkey").join(c, "o_custkey", "left").join(t.nation.select("n_nationkey", "n_name"), "n_nationkey", "left").select("o_orderkey", "c_name", "n_name")


@query("j2_inner_join", "SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'")
def j2(t):
    o = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return t.lineitem.select("l_orderkey", "l_linenumber").join(o, "l_orderkey").select("l_orderkey", "l_linenumber", "o_custkey")


@query("j3_requested_pages", "WITH r(document_id, page) AS (SELECT DISTINCT conv_id, turn + 1 FROM conversations WHERE role = 'user') SELECT conv_id, turn, role FROM conversations JOIN r ON r.document_id = conv_id AND r.page = turn")
def j3(t):
    wanted = t.conversations.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn")).distinct()
    return t.conversations.join(wanted, ["conv_id", "turn"], "left_semi").select("conv_id", "turn", "role")


@query("j5_tag_ratio", "SELECT p_partkey, round(len(list_filter(string_split(p_name, ' '), lambda x: contains(lower(p_type || ' small blue ring'), lower(x))))::DOUBLE / nullif(len(string_split(p_name, ' ')), 0), 6) AS ratio FROM part")
def j5(t):
    tags, need = F.split("p_name", " "), F.lower(F.concat("p_type", F.lit(" small blue ring")))
    return t.part.select("p_partkey", F.round(F.try_divide(F.size(F.filter(tags, lambda x: F.contains(need, F.lower(x)))).cast("double"), F.size(tags)), 6).alias("ratio"))


@query("j6_aggregate_join_back", "WITH s AS (SELECT o_custkey, max(o_totalprice) AS best FROM orders GROUP BY 1) SELECT c_custkey, c_name, best FROM s JOIN customer ON c_custkey = o_custkey")
def j6(t):
    best = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("best"))
    return best.join(t.customer.select("c_custkey", "c_name"), "c_custkey").select("c_custkey", "c_name", "best")


@query("j7_best_per_key", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def j7(t):
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("o_orderkey"))


@query("j8_membership", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 10)")
def j8(t):
    p = t.part.where("p_size = 10").select(F.col("p_partkey").alias("l_partkey"))
    return t.lineitem.join(p, "l_partkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("j15_containment", "SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def j15(t):
    """Which documents contain which quotes: a shared run of five words first, then the exact test."""
    from ..operators import evaluate

    return evaluate.containment(t.documents.select("doc_id", "text"), t.benchmark.select("item_id", F.col("text").alias("quote")))


@query("j22_owner_name", "SELECT s_suppkey, s_name, n_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey")
def j22(t):
    return t.supplier.join(t.nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey", "left").select("s_suppkey", "s_name", "n_name")


@query("j23_run_parity", "WITH a AS (SELECT o_custkey AS run, list(o_orderstatus ORDER BY o_orderkey) AS x FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey AS run, list(o_orderstatus ORDER BY o_orderkey) AS y FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1) SELECT run, x IS NOT DISTINCT FROM y AS same FROM a JOIN b USING (run)")
def j23(t):
    side = lambda r, n: t.orders.where(F.col("o_orderkey") % 2 == r).groupBy(F.col("o_custkey").alias("run")).agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))), lambda s: s["o_orderstatus"]).alias(n))
    return side(0, "x").join(side(1, "y"), "run").select("run", F.equal_null("x", "y").alias("same"))


@query("p4_optional_filters", "SELECT c_custkey FROM customer WHERE (NULL IS NULL OR c_name = NULL) AND c_mktsegment = 'BUILDING'")
def p4(t):
    given = {"c_mktsegment": "BUILDING", "c_name": None}
    rows = t.customer
    for c, v in given.items():
        rows = rows if v is None else rows.where(F.col(c) == v)
    return rows.select("c_custkey")


@query("p9_exactly_one", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'P' GROUP BY 1 HAVING count(*) = 1")
def p9(t):
    rows = t.orders.where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("o_orderkey"))
    return rows.where("n = 1").select("o_custkey", "o_orderkey")


@query("p20_owner_or_admin", "SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < 0 OR c_nationkey = 3")
def p20(t):
    c = t.customer.where("c_acctbal < 0 or c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.join(c, "o_custkey", "left_semi").select("o_orderkey")


@query("k6_priority_sort", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY CASE WHEN o_orderpriority LIKE '1%' THEN 0 WHEN o_orderstatus = 'P' THEN 1 ELSE 2 END, o_orderdate, o_orderkey LIMIT 12")
def k6(t):
    first = F.when(F.col("o_orderpriority").startswith("1"), 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    return t.orders.orderBy(first, "o_orderdate", "o_orderkey").limit(12).select("o_orderkey", "o_orderpriority")


@query("k10_document_window", "SELECT conv_id, turn FROM conversations ORDER BY conv_id, turn LIMIT 40")
def k10(t):
    return t.conversations.orderBy("conv_id", "turn").limit(40).select("conv_id", "turn")


@query("u2_append_missing", "SELECT doc_id, 'list' AS part FROM labels UNION ALL SELECT doc_id, 'backfill' FROM documents WHERE n_chars > 3000 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def u2(t):
    more = t.documents.where("n_chars > 3000").select("doc_id").join(t.labels.select("doc_id"), "doc_id", "left_anti")
    return t.labels.select("doc_id", F.lit("list").alias("part")).unionByName(more.select("doc_id", F.lit("backfill").alias("part")))


@query("u3_merge_later_wins", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS value, min(o_orderkey) AS place FROM orders GROUP BY 1")
def u3(t):
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("value"), F.min("o_orderkey").alias("place"))


@query("u9_cited_only", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def u9(t):
    s = t.supplier.where("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey"))
    return t.nation.join(s, "n_nationkey", "left_semi").select("n_nationkey", "n_name")


PAIR_SQL = f"WITH k AS (SELECT conv_id, turn, role, regexp_extract_all(lower(translate(text, '{text.ACCENTED}', '{text.PLAIN}')), '[a-z0-9]{{5,}}') AS ts FROM conversations), p AS (SELECT q.conv_id, q.turn, q.ts AS qt, a.ts AS aa FROM k q JOIN k a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant')"


def answered(t):
    rows = t.conversations.select("conv_id", "turn", "role", F.regexp_extract_all(text.fold(F.col("text")), F.lit("[a-z0-9]{5,}"), F.lit(0)).alias("ts"))
    a = rows.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("ts").alias("at"))
    return rows.where("role = 'user'").select("conv_id", "turn", F.col("ts").alias("qt")).join(a, ["conv_id", "turn"])


@query("u4_missing_terms", f"{PAIR_SQL} SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(qt, lambda x: NOT list_contains(aa, x)))), ' ') AS missing FROM p")
def u4(t):
    return answered(t).select("conv_id", "turn", F.array_join(F.sort_array(F.array_except("qt", "at")), " ").alias("missing"))


@query("u5_matched_terms", f"{PAIR_SQL} SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_intersect(qt, aa))), ' ') AS matched FROM p")
def u5(t):
    return answered(t).select("conv_id", "turn", F.array_join(F.sort_array(F.array_intersect("qt", "at")), " ").alias("matched"))


@query("u7_subset", f"{PAIR_SQL} SELECT conv_id, turn, len(list_filter(qt, lambda x: NOT list_contains(aa, x))) = 0 AS covered, list_sort(list_distinct(qt)) = list_sort(list_distinct(aa)) AS same FROM p")
def u7(t):
    covered = F.size(F.array_except("qt", "at")) == 0
    return answered(t).select("conv_id", "turn", covered.alias("covered"), (F.sort_array(F.array_distinct("qt")) == F.sort_array(F.array_distinct("at"))).alias("same"))


@query("w17_unambiguous_best", "WITH r AS (SELECT l_partkey, l_suppkey, max(l_quantity) AS s FROM lineitem GROUP BY ALL), w AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY s DESC, l_suppkey) AS n, lead(s) OVER (PARTITION BY l_partkey ORDER BY s DESC, l_suppkey) AS second FROM r) SELECT l_partkey, l_suppkey, s FROM w WHERE n = 1 AND (second IS NULL OR s > second)")
def w17(t):
    best = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.max("l_quantity").alias("s"))
    at = Window.partitionBy("l_partkey").orderBy(F.desc("s"), "l_suppkey")
    rows = best.withColumns({"n": F.row_number().over(at), "second": F.lead("s").over(at)})
    return rows.where("n = 1 and (second is null or s > second)").select("l_partkey", "l_suppkey", "s")


@query("w19_first_rank", "WITH r AS (SELECT o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) SELECT o_custkey, min(CASE WHEN o_orderstatus = 'P' THEN k END) AS first_rank FROM r GROUP BY 1")
def w19(t):
    at = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = t.orders.select("o_custkey", "o_orderstatus", F.row_number().over(at).cast("bigint").alias("k"))
    return rows.groupBy("o_custkey").agg(F.min(F.when(F.col("o_orderstatus") == "P", F.col("k"))).alias("first_rank"))


@query("s16_pivot_summary", "SELECT o_orderpriority AS case_id, max(CASE WHEN o_orderstatus = 'F' THEN n END) AS f, max(CASE WHEN o_orderstatus = 'O' THEN n END) AS o, max(CASE WHEN o_orderstatus = 'P' THEN n END) AS p FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) GROUP BY 1")
def s16(t):
    rows = t.orders.groupBy(F.col("o_orderpriority").alias("case_id")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return rows.select("case_id", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))
