"""Session settings that results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes in one Arrow batch.
ARROW_BYTES = 16 << 20


def sound(spark: SparkSession) -> SparkSession:
    """Keep a union from claiming its children's partitioning.

    Spark 4.1 does so by default; where adaptive execution then coalesces the children differently, rows of one key
    end up in several partitions, and an aggregation after the union gives wrong groups.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    # Long texts and packed vectors: a batch for a Python worker is bounded by its bytes as well as by its rows.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark
