"""Streaming queries over the events and documents, run to the end of what there is."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from ..sources import tables
from ..streaming import activity
from .audit import LOG_SQL


def live_log(t):
    rows = activity.stream(t.spark, f"{t.folder}/events.parquet")
    status = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "CANCELLED").otherwise("SUCCESS")
    return rows.select(F.col("event_id").alias("id"), F.col("event_type").alias("action"), status.alias("status"), F.col("ts").cast("timestamp").alias("created_at"))


@query("st1_streaming_daily", f"WITH l AS ({LOG_SQL}) SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS total, sum((status = 'ERROR')::INT)::BIGINT AS errors FROM l GROUP BY 1")
def st1(t):
    return activity.drained(activity.daily(live_log(t)))


@query("st2_streaming_actions", f"WITH l AS ({LOG_SQL}) SELECT action, count(*) AS n FROM l GROUP BY action")
def st2(t):
    return activity.drained(activity.by_action(live_log(t)))


@query("st8_streaming_ingest", r"SELECT CASE WHEN trim(text) = '' THEN 'FAILED' ELSE 'INDEXED' END AS status, count(*) AS n FROM documents GROUP BY 1")
def st8(t):
    rows = activity.stream(t.spark, f"{t.folder}/documents.parquet").select("doc_id", "text")
    return activity.ingest_stream(rows, tables.scratch(t.spark) + "/ingest", most=200, overlap=30).groupBy("status").agg(F.count("*").alias("n"))
