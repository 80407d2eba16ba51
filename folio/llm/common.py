"""What the training-data operators share: table access, scratch tables, Arrow mapping."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import sound

#: Rows in one Arrow batch. Documents may be long, so batches stay short.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return sound(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder in the shared one that ``spark.checkpoint.dir`` names.

    Where that is unset, as in tests, the warehouse folder serves if driver and executors are one process; on a cluster
    it may be local to the driver, so there the setting is asked for.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{base.rstrip('/')}/folio-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a table to the shared scratch folder and read it back: this cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` with short batches, so that long texts do not pile up in a worker: ``sound`` bounds their bytes, this
    their rows. Spark reads the setting when the plan runs, so it stays set for the session."""
    conf = sound(df.sparkSession).conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(fn, schema)


def salted(rows: DataFrame, groups: DataFrame, keys: list[str], by: Column, salts: int = 16) -> DataFrame:
    """Rows joined with what is known of their group. A group may be a third of all rows, so its rows are dealt over
    ``salts`` tasks by the hash ``by``, and the group's own row goes to each of them."""
    (salt,) = unused(rows, "salt")
    every = groups.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return rows.withColumn(salt, F.pmod(by, F.lit(salts).cast("long"))).join(every, [*keys, salt]).drop(salt)


def utf8(col: str = "text"):
    """A text column as its UTF-8 bytes, empty where null."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def lower_ascii(col):
    """A-Z in lower case, all else as it is."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column is called so."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out
