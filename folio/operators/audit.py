"""Reports over an audit log: id, user_id, action, status, duration_ms, created_at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import half_up, rate


def clamp_days(days: int) -> int:
    return min(90, max(7, days))


def since_column(last: Column, days: int) -> Column:
    """The first instant of a period of ``days`` UTC days that ends with the day of ``last``."""
    return F.date_trunc("day", last) - F.make_dt_interval(days=F.lit(clamp_days(days) - 1))


def in_period(log: DataFrame, since) -> DataFrame:
    return log.where(F.col("created_at") >= F.lit(since).cast("timestamp"))


def summary(log: DataFrame) -> DataFrame:
    """Calls, successes, errors and the mean duration; other outcomes count in the calls alone."""
    return log.agg(
        F.count("*").alias("total"), F.coalesce(F.count_if(F.col("status") == "SUCCESS"), F.lit(0)).alias("successes"), F.coalesce(F.count_if(F.col("status") == "ERROR"), F.lit(0)).alias("errors"), F.coalesce(F.avg("duration_ms"), F.lit(0.0)).alias("avg_ms")
    )


def by_action(log: DataFrame) -> DataFrame:
    return log.groupBy("action").agg(F.count("*").alias("n"))


def daily(log: DataFrame) -> DataFrame:
    return log.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "ERROR").alias("errors"))


def daily_filled(log: DataFrame, first: str, days: int) -> DataFrame:
    """One row per day of the period, zeros where nothing happened."""
    spark = log.sparkSession
    spine = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.date_add(F.lit(first).cast("date"), clamp_days(days) - 1))).alias("d")).select(F.date_format("d", "yyyy-MM-dd").alias("day"))
    return spine.join(daily(log), "day", "left").na.fill(0, ["total", "errors"])


def action_pivot(log: DataFrame, actions: list[str]) -> DataFrame:
    """One row, a column of counts per action, 0 where it never occurs."""
    return log.agg(*[F.count_if(F.col("action") == a).alias(f"n_{a.lower()}") for a in actions])


def success_rate(log: DataFrame) -> DataFrame:
    total, good = F.count("*"), F.count_if(F.col("status") == "SUCCESS")
    return log.agg(rate(good, total).alias("success_rate"), half_up(F.coalesce(F.avg("duration_ms"), F.lit(0.0))).alias("avg_ms"))


def latest(log: DataFrame, n: int = 6) -> DataFrame:
    return log.orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def dashboard(log: DataFrame, first: str, days: int = 30) -> DataFrame:
    """A row for each day of the period, with the period's totals beside it: sums over 90 rows at most."""
    period = in_period(log, first)
    sums = period.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.count_if(F.col("status") == "SUCCESS").alias("good"), F.sum("duration_ms").alias("ms"))
    rows = daily_filled(period, first, days).join(sums, "day", "left")
    every = Window.partitionBy(F.lit(1))
    calls, good = F.sum("total").over(every), F.coalesce(F.sum("good").over(every), F.lit(0))
    mean = F.coalesce(F.try_divide(F.sum("ms").over(every), calls), F.lit(0.0))
    return rows.select("day", "total", "errors", calls.alias("period_total"), rate(good, calls).alias("success_rate"), half_up(mean).alias("avg_ms"))


def first_outcome(log: DataFrame, key: str) -> DataFrame:
    """One audit outcome per request: the earliest, by time and then id."""
    return log.groupBy(key).agg(F.min_by("status", F.struct("created_at", "id")).alias("status"), F.min("created_at").alias("created_at"))
