"""State of background jobs from their table or their events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TERMINAL = ["completed", "failed", "cancelled"]


def claimable(jobs: DataFrame, now: str) -> DataFrame:
    """Queued, or running with an expired lease; not cancelled, with attempts left."""
    at = F.lit(now).cast("timestamp")
    free = (F.col("status") == "queued") | ((F.col("status") == "running") & (F.col("lease_expires_at") < at))
    return jobs.where(~F.col("cancel_requested") & (F.col("attempt_count") < F.col("max_attempts")) & free)


def retained(jobs: DataFrame, now: str, days: int) -> DataFrame:
    """All but the finished jobs that are older than ``days``."""
    old = F.col("created_at") < F.lit(now).cast("timestamp") - F.make_dt_interval(days=F.lit(days))
    return jobs.where(~(F.col("status").isin(TERMINAL) & old))


def lifecycle(events: DataFrame, max_attempts: int = 3) -> DataFrame:
    """Fold each job's events (job_id, event, event_ts, event_id), in order, into its status and attempts.

    A job's events are few; they are folded as one ordered array. Events: submit, start, succeed, fail, cancel.
    """
    ordered = F.array_sort(F.collect_list(F.struct("event_ts", "event_id", "event")))
    start = F.struct(F.lit("none").alias("status"), F.lit(0).alias("attempts"), F.lit(False).alias("asked"))

    def step(s, x):
        e, now, tries = x["event"], s["status"], s["attempts"]
        done = now.isin(TERMINAL)
        asked = s["asked"] | (e == "cancel")
        status = (
            F.when(done, now)
            .when(e == "submit", "queued")
            .when((e == "cancel") & now.isin("queued", "none"), "cancelled")
            .when((e == "start") & (now == "queued"), "running")
            .when((e == "succeed") & (now == "running"), F.when(asked, "cancelled").otherwise("completed"))
            .when((e == "fail") & (now == "running"), F.when(asked, "cancelled").when(tries < max_attempts, "queued").otherwise("failed"))
            .otherwise(now)
        )
        return F.struct(status.alias("status"), F.when((e == "start") & (now == "queued"), tries + 1).otherwise(tries).alias("attempts"), asked.alias("asked"))

    folded = events.groupBy("job_id").agg(F.aggregate(ordered, start, step).alias("s"))
    return folded.select("job_id", "s.status", F.col("s.attempts").alias("attempts"))


def protocol(events: DataFrame) -> DataFrame:
    """Per request whether its events, in order, hold validation and done, and end with done."""
    order = F.array_sort(F.collect_list(F.struct("seq", "type")))
    kinds = F.transform(order, lambda x: x["type"])
    rows = events.groupBy("request_id").agg(kinds.alias("kinds"))
    ok = F.array_contains("kinds", "done") & F.array_contains("kinds", "validation") & (F.element_at("kinds", -1) == "done")
    return rows.select("request_id", F.size("kinds").cast("long").alias("n_events"), ok.alias("ok"))
