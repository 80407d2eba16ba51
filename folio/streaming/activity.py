"""The audit reports over a stream of files, and documents ingested as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import ingest
from ..sources import tables


def stream(spark: SparkSession, path: str) -> DataFrame:
    """New files of a table, as they come. The path is given as a pattern, so that it may be a single file as well."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def daily(log: DataFrame) -> DataFrame:
    """Calls and errors per UTC day, with a day's patience for late events."""
    days = log.withWatermark("created_at", "1 day").groupBy(F.window("created_at", "1 day"))
    return days.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "ERROR").alias("errors")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "total", "errors")


def by_action(log: DataFrame) -> DataFrame:
    return log.groupBy("action").agg(F.count("*").alias("n"))


def first_outcomes(log: DataFrame) -> DataFrame:
    """The first outcome of each request within the watermark."""
    return log.withWatermark("created_at", "1 day").dropDuplicatesWithinWatermark(["request_id"])


def drained(rows: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over what there is now; the last state (or, in other modes, every epoch's rows) is kept as a table in
    the shared folder."""
    spark = rows.sparkSession
    base = tables.scratch(spark)

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out" if mode == "complete" else f"{base}/out/epoch={epoch}")

    q = rows.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def ingest_stream(docs: DataFrame, target: str, **chunking) -> DataFrame:
    """Documents (doc_id, text) as they arrive: their chunks go to ``target/chunks``, and a status row to
    ``target/status``: INDEXED with its number of chunks, or FAILED with an error of up to 1000 characters."""

    def one(batch: DataFrame, epoch: int) -> None:
        clean = batch.select("doc_id", text.cleaned(F.coalesce("text", F.lit(""))).alias("text"))
        chunks = ingest.chunked(clean, **chunking).withColumn("epoch", F.lit(epoch))
        chunks.write.mode("overwrite").parquet(f"{target}/chunks/epoch={epoch}")
        n = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
        empty = F.col("n_chunks").isNull()
        status = clean.join(n, "doc_id", "left").select("doc_id", F.when(empty, "FAILED").otherwise("INDEXED").alias("status"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.when(empty, F.substring(F.lit("no text"), 1, 1000)).alias("error"))
        status.write.mode("overwrite").parquet(f"{target}/status/epoch={epoch}")

    q = docs.writeStream.foreachBatch(one).option("checkpointLocation", f"{target}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    # An epoch's folder is written over when it is run again, so nothing counts twice.
    return docs.sparkSession.read.parquet(f"{target}/status")


def job_states(events: DataFrame, max_attempts: int = 3) -> DataFrame:
    """Each job's status after every micro-batch, from a stream of job_id, event, event_ts and event_id: the state per
    job is its status, attempts and whether it is to be cancelled."""
    import pandas as pd

    done = {"completed", "failed", "cancelled"}

    def fold(key, frames, state):
        status, tries, asked = state.get if state.exists else ("none", 0, False)
        rows = pd.concat(list(frames)).sort_values(["event_ts", "event_id"])
        for e in rows["event"]:
            if status in done:
                break
            if e == "submit":
                status = "queued"
            elif e == "cancel":
                asked = True
                status = "cancelled" if status in ("queued", "none") else status
            elif e == "start" and status == "queued":
                status, tries = "running", tries + 1
            elif e == "succeed" and status == "running":
                status = "cancelled" if asked else "completed"
            elif e == "fail" and status == "running":
                status = "cancelled" if asked else "queued" if tries < max_attempts else "failed"
        state.update((status, tries, asked))
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "attempts": [tries]})

    return events.groupBy("job_id").applyInPandasWithState(fold, "job_id long, status string, attempts int", "status string, attempts int, asked boolean", "update", "NoTimeout")
