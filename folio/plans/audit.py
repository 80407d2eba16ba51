"""Queries over the audit log (events) and the project tables (customer, orders, part)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import half_up
from ..operators import audit, jobs
from ..registry import Tables, query

FIRST = "2024-01-01"
LOG_SQL = """SELECT event_id AS id, user_id, event_type AS action, CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'signup' THEN 'CANCELLED' ELSE 'SUCCESS' END AS status,
 value AS duration_ms, ts AS created_at, props FROM events"""


def log(t: Tables) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "CANCELLED").otherwise("SUCCESS")
    return t.events.select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("action"), status.alias("status"), F.col("value").alias("duration_ms"), F.col("ts").cast("timestamp").alias("created_at"), "props")


@query("a1_audit_summary", f"WITH l AS ({LOG_SQL}) SELECT count(*) AS total, sum((status = 'SUCCESS')::INT)::BIGINT AS successes, sum((status = 'ERROR')::INT)::BIGINT AS errors, round(avg(duration_ms), 6) AS avg_ms FROM l")
def a1(t):
    return audit.summary(log(t)).withColumn("avg_ms", F.round("avg_ms", 6))


@query("a2_action_counts", f"WITH l AS ({LOG_SQL}) SELECT action, count(*) AS n FROM l GROUP BY action")
def a2(t):
    return audit.by_action(log(t))


@query("a3_daily_activity", f"WITH l AS ({LOG_SQL}) SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS total, sum((status = 'ERROR')::INT)::BIGINT AS errors FROM l GROUP BY 1")
def a3(t):
    return audit.daily(log(t))


@query("a4_projects_by_sector", "SELECT c_mktsegment AS sector, count(*) AS n FROM customer GROUP BY 1")
def a4(t):
    return t.customer.groupBy(F.col("c_mktsegment").alias("sector")).agg(F.count("*").alias("n"))


@query("a5_projects_by_type", "SELECT p_type AS mission_type, count(*) AS n FROM part GROUP BY 1")
def a5(t):
    return t.part.groupBy(F.col("p_type").alias("mission_type")).agg(F.count("*").alias("n"))


@query("a6_projects_by_year", "SELECT year(o_orderdate)::INT AS year, count(*) AS n FROM orders GROUP BY 1")
def a6(t):
    return t.orders.groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))


@query("a7_users_by_role", "SELECT count(*) AS users, sum((c_acctbal < 0)::INT)::BIGINT AS admins, sum((c_acctbal >= 0)::INT)::BIGINT AS consultants FROM customer")
def a7(t):
    return t.customer.agg(F.count("*").alias("users"), F.count_if(F.col("c_acctbal") < 0).alias("admins"), F.count_if(F.col("c_acctbal") >= 0).alias("consultants"))


@query("a8_action_pivot", "SELECT sum((event_type = 'click')::INT)::BIGINT AS n_click, sum((event_type = 'view')::INT)::BIGINT AS n_view, sum((event_type = 'generate')::INT)::BIGINT AS n_generate FROM events")
def a8(t):
    return audit.action_pivot(log(t), ["click", "view", "generate"])


@query("a9_success_rate", f"WITH l AS ({LOG_SQL}) SELECT floor(sum((status = 'SUCCESS')::INT)::DOUBLE * 100 / count(*) * 10 + 0.5) / 10 AS success_rate, floor(avg(duration_ms) * 10 + 0.5) / 10 AS avg_ms FROM l")
def a9(t):
    return audit.success_rate(log(t))


@query("a13_status_breakdown", f"WITH l AS ({LOG_SQL}) SELECT sum((status = 'SUCCESS')::INT)::BIGINT AS success, sum((status = 'ERROR')::INT)::BIGINT AS error, sum((status = 'CANCELLED')::INT)::BIGINT AS cancelled, sum((status NOT IN ('SUCCESS', 'ERROR', 'CANCELLED'))::INT)::BIGINT AS other FROM l")
def a13(t):
    known = ["SUCCESS", "ERROR", "CANCELLED"]
    return log(t).agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in known], F.count_if(~F.col("status").isin(known)).alias("other"))


@query("a17_median_latency", "SELECT event_type AS stage, round(quantile_cont(value, 0.5), 6) AS median_ms FROM events GROUP BY 1")
def a17(t):
    return t.events.groupBy(F.col("event_type").alias("stage")).agg(F.round(F.median("value"), 6).alias("median_ms"))


@query("a18_nearest_rank_percentile", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type AS stage, max(CASE WHEN k = ceil(0.5 * n) THEN value END) AS p50, max(CASE WHEN k = ceil(0.95 * n) THEN value END) AS p95 FROM r GROUP BY 1")
def a18(t):
    # percentile_disc is the nearest rank; counts per value are combined before the shuffle.
    return t.events.groupBy(F.col("event_type").alias("stage")).agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"))


@query("a23_latency_stats", "SELECT round(avg(value), 6) AS mean_ms, round(quantile_cont(value, 0.5), 6) AS median_ms, quantile_disc(value, 0.95) AS p95_ms, max(value) AS max_ms FROM events")
def a23(t):
    return t.events.agg(F.round(F.avg("value"), 6).alias("mean_ms"), F.round(F.median("value"), 6).alias("median_ms"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95_ms"), F.max("value").alias("max_ms"))


@query("a36_top_categories", "SELECT c_mktsegment AS category, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, category LIMIT 5")
def a36(t):
    return t.customer.groupBy(F.col("c_mktsegment").alias("category")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(5)


@query("j19_daily_spine", f"WITH l AS ({LOG_SQL}), s AS (SELECT strftime(d, '%Y-%m-%d') AS day FROM generate_series(TIMESTAMP '{FIRST}', TIMESTAMP '{FIRST}' + INTERVAL 89 DAY, INTERVAL 1 DAY) g(d)), a AS (SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS total, sum((status = 'ERROR')::INT)::BIGINT AS errors FROM l GROUP BY 1) SELECT day, coalesce(total, 0) AS total, coalesce(errors, 0) AS errors FROM s LEFT JOIN a USING (day)")
def j19(t):
    return audit.daily_filled(log(t), FIRST, 120)  # clamped to 90 days


@query("k7_latest_events", "SELECT event_id AS id, event_type AS action, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events ORDER BY ts DESC, event_id DESC LIMIT 6")
def k7(t):
    return audit.latest(log(t)).select("id", "action", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("k8_paged_listing", "SELECT c_custkey, c_name, c_mktsegment, (SELECT count(*) FROM customer) AS total FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25 OFFSET 50")
def k8(t):
    page = t.customer.orderBy(F.desc("c_acctbal"), "c_custkey").offset(50).limit(25).select("c_custkey", "c_name", "c_mktsegment")
    return page.withColumn("total", F.lit(t.customer.count()))


@query("p25_since_filter", "SELECT event_id, event_type, value FROM events WHERE ts >= TIMESTAMP '2024-01-20 12:00:00'")
def p25(t):
    return audit.in_period(log(t), "2024-01-20 12:00:00").select(F.col("id").alias("event_id"), F.col("action").alias("event_type"), F.col("duration_ms").alias("value"))


@query("s11_audit_append", f"WITH l AS ({LOG_SQL}) SELECT id, user_id, action, status, round(duration_ms, 2) AS duration_ms FROM l")
def s11(t):
    """Write the log as appended files by day, and read it back."""
    from ..sources import tables

    path = tables.scratch(t.spark) + "/audit"
    rows = log(t).withColumn("day", F.date_format("created_at", "yyyy-MM-dd"))
    tables.append(rows.where("status = 'SUCCESS'"), path, ["day"])
    tables.append(rows.where("status <> 'SUCCESS'"), path, ["day"])
    return t.spark.read.parquet(path).select("id", "user_id", "action", "status", F.round("duration_ms", 2).alias("duration_ms"))


@query("st4_single_outcome", f"WITH l AS ({LOG_SQL}) SELECT user_id, first(status ORDER BY created_at, id) AS status FROM l GROUP BY 1")
def st4(t):
    return audit.first_outcome(log(t), "user_id").select("user_id", "status")


JOBS_SQL = """SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE CASE WHEN o_totalprice > 250000 THEN 'completed' ELSE 'failed' END END AS status,
 (o_orderkey % 4)::INT AS attempt_count, 3 AS max_attempts, o_orderdate AS created_at, o_orderdate + INTERVAL 30 DAY AS lease_expires_at, o_orderpriority = '1-URGENT' AS cancel_requested FROM orders"""


def job_table(t: Tables) -> DataFrame:
    done = F.when(F.col("o_totalprice") > 250000, "completed").otherwise("failed")
    return t.orders.select(
        F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise(done).alias("status"), (F.col("o_orderkey") % 4).cast("int").alias("attempt_count"), F.lit(3).alias("max_attempts"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"), (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 30 DAYS")).alias("lease_expires_at"), (F.col("o_orderpriority") == "1-URGENT").alias("cancel_requested"),
    )


@query("st6_claimable_jobs", f"WITH j AS ({JOBS_SQL}) SELECT job_id, status FROM j WHERE NOT cancel_requested AND attempt_count < max_attempts AND (status = 'queued' OR (status = 'running' AND lease_expires_at < TIMESTAMP '1999-01-01')) ORDER BY created_at, job_id LIMIT 100")
def st6(t):
    return jobs.claimable(job_table(t), "1999-01-01 00:00:00").orderBy("created_at", "job_id").limit(100).select("job_id", "status")


@query("st7_retention", f"WITH j AS ({JOBS_SQL}) SELECT status, count(*) AS n FROM j WHERE NOT (status IN ('completed', 'failed', 'cancelled') AND created_at < TIMESTAMP '2000-01-01' - INTERVAL 365 DAY) GROUP BY 1")
def st7(t):
    return jobs.retained(job_table(t), "2000-01-01 00:00:00", 365).groupBy("status").agg(F.count("*").alias("n"))


@query("x68_interval_arithmetic", "SELECT o_orderkey, strftime(o_orderdate + (l_days * INTERVAL 1 DAY), '%Y-%m-%d') AS due FROM (SELECT o_orderkey, o_orderdate, (o_orderkey % 90)::INT AS l_days FROM orders)")
def x68(t):
    days = (F.col("o_orderkey") % 90).cast("int")
    return t.orders.select("o_orderkey", F.date_format(F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(days=days), "yyyy-MM-dd").alias("due"))


@query("x67_period_clamp", "WITH d AS (SELECT o_orderkey, least(90, greatest(7, (o_orderkey % 200)::INT)) AS days, o_orderdate FROM orders) SELECT o_orderkey, days, strftime(date_trunc('day', o_orderdate) - (days - 1) * INTERVAL 1 DAY, '%Y-%m-%d') AS since FROM d")
def x67(t):
    days = F.least(F.lit(90), F.greatest(F.lit(7), (F.col("o_orderkey") % 200).cast("int")))
    rows = t.orders.select("o_orderkey", days.alias("days"), F.col("o_orderdate").cast("timestamp").alias("at"))
    return rows.select("o_orderkey", "days", F.date_format(F.date_trunc("day", "at") - F.make_dt_interval(days=F.col("days") - 1), "yyyy-MM-dd").alias("since"))


@query("x73_throughput", "SELECT l_orderkey, l_linenumber, round(l_quantity / nullif(l_tax, 0), 6) AS per_s, round(coalesce(l_quantity / nullif(l_tax, 0), l_quantity / 100), 6) AS tokens_s FROM lineitem")
def x73(t):
    fast = F.try_divide(F.col("l_quantity"), F.nullif(F.col("l_tax"), F.lit(0.0)))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(fast, 6).alias("per_s"), F.round(F.coalesce(fast, F.col("l_quantity") / 100), 6).alias("tokens_s"))


@query("x74_event_type", "SELECT event_id, CASE WHEN contains(props, '\"error\"') THEN 'error' WHEN contains(props, '\"done\"') THEN 'done' WHEN contains(props, '\"k\"') THEN 'token' ELSE 'message' END AS kind FROM events")
def x74(t):
    kind = F.when(F.contains("props", F.lit('"error"')), "error").when(F.contains("props", F.lit('"done"')), "done").when(F.contains("props", F.lit('"k"')), "token").otherwise("message")
    return t.events.select("event_id", kind.alias("kind"))


@query("c11_dashboard", f"""WITH l AS ({LOG_SQL}), p AS (SELECT * FROM l WHERE created_at >= TIMESTAMP '{FIRST}'), s AS (SELECT strftime(d, '%Y-%m-%d') AS day FROM generate_series(TIMESTAMP '{FIRST}', TIMESTAMP '{FIRST}' + INTERVAL 29 DAY, INTERVAL 1 DAY) g(d)),
 a AS (SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS total, sum((status = 'ERROR')::INT)::BIGINT AS errors FROM p GROUP BY 1),
 w AS (SELECT count(*) AS period_total, floor(sum((status = 'SUCCESS')::INT)::DOUBLE * 100 / count(*) * 10 + 0.5) / 10 AS success_rate, floor(avg(duration_ms) * 10 + 0.5) / 10 AS avg_ms FROM p)
 SELECT day, coalesce(total, 0) AS total, coalesce(errors, 0) AS errors, period_total, success_rate, avg_ms FROM s LEFT JOIN a USING (day), w""")
def c11(t):
    return audit.dashboard(log(t), FIRST, 30)


@query("a19_rates", "SELECT event_type, round(avg((value > 50)::INT), 4) AS rate, sum((value > 50)::INT)::BIGINT AS passed, count(value) AS total FROM events GROUP BY 1")
def a19(t):
    ok = F.col("value") > 50
    return t.events.groupBy("event_type").agg(F.round(F.avg(ok.cast("int")), 4).alias("rate"), F.count_if(ok).alias("passed"), F.count("value").alias("total"))


@query("a20_mode_summary", "SELECT event_type AS mode, count(*) AS cases, round(avg((value > 50)::INT), 4) AS pass_rate, floor(avg(value) * 100 + 0.5) / 100 AS mean_ms, round(quantile_cont(value, 0.5), 2) AS median_ms, sum((event_type = 'error')::INT)::BIGINT AS errors FROM events GROUP BY 1")
def a20(t):
    out = t.events.groupBy(F.col("event_type").alias("mode")).agg(F.count("*").alias("cases"), F.round(F.avg((F.col("value") > 50).cast("int")), 4).alias("pass_rate"), half_up(F.avg("value"), 2).alias("mean_ms"), F.round(F.median("value"), 2).alias("median_ms"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return out


@query("w20_batch_numbers", "SELECT o_orderkey, ((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1) // 3)::BIGINT AS batch FROM orders")
def w20(t):
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select("o_orderkey", F.floor((F.row_number().over(order) - 1) / 3).alias("batch"))


@query("s20_batch_totals", "WITH b AS (SELECT o_custkey, o_totalprice, ((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1) // 3)::BIGINT AS batch FROM orders) SELECT o_custkey, batch, count(*) AS missions, round(sum(o_totalprice), 2) AS total FROM b GROUP BY 1, 2")
def s20(t):
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = t.orders.select("o_custkey", "o_totalprice", F.floor((F.row_number().over(order) - 1) / 3).alias("batch"))
    return rows.groupBy("o_custkey", "batch").agg(F.count("*").alias("missions"), F.round(F.sum("o_totalprice"), 2).alias("total"))
