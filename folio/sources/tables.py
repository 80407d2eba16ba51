"""Writing and changing tables of files: append, upsert by key, replacement of keys, cascading deletes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new folder in the one that all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{base.rstrip('/')}/folio-{uuid.uuid4().hex}"


def stored(rows: DataFrame, **options) -> DataFrame:
    """Write a table to a new scratch folder and read it back: computed once, and safe from lost executors."""
    path = scratch(rows.sparkSession) + "/table"
    rows.write.options(**options).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def clean(spark: SparkSession, frame: DataFrame) -> None:
    """Delete the scratch folder that a stored table was written to, once nothing reads it any more."""
    for file in frame.inputFiles()[:1]:
        at = file.find("/folio-")
        if at < 0:
            raise ValueError("not a stored table")
        folder = spark._jvm.org.apache.hadoop.fs.Path(file[: file.index("/", at + 1)])
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def append(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    out = rows.write.mode("append")
    (out.partitionBy(*by) if by else out).parquet(path)


def upsert(old: DataFrame, new: DataFrame, key: str, row_id: str, last: int | None = None) -> DataFrame:
    """Rows of ``new`` replace the other columns of those with their key and keep the id; new keys get ids after the
    largest, or after ``last``. Ids are dealt by ranges: every partition counts its own rows, so no task sees them all."""
    cols = [c for c in old.columns if c not in (key, row_id)]
    both = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    merged = both.select(
        F.col(f"o.{row_id}").alias(row_id), F.coalesce(f"n.{key}", f"o.{key}").alias(key), *[F.when(F.col(f"n.{key}").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in cols]
    )
    fresh = merged.where(F.col(row_id).isNull()).withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(256)))
    if last is None:
        last = old.agg(F.coalesce(F.max(row_id), F.lit(0)).alias("m")).first()["m"]
    sizes = fresh.groupBy("_salt").agg(F.count("*").alias("n"))
    base = sizes.select("_salt", F.coalesce(F.sum("n").over(Window.orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))  # 256 rows
    numbered = fresh.join(F.broadcast(base), "_salt").withColumn(row_id, F.lit(last) + F.col("_base") + F.row_number().over(Window.partitionBy("_salt").orderBy(key)))
    return merged.where(F.col(row_id).isNotNull()).unionByName(numbered.select(*merged.columns))


def replace_keys(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Delete the rows of the keys that ``new`` has, then add its rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new)


def cascade_delete(parents: DataFrame, children: DataFrame, gone: DataFrame, parent_key: str, child_key: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the given parents and without their children."""
    ids = gone.select(parent_key)
    return parents.join(ids, parent_key, "left_anti"), children.join(ids, children[child_key] == ids[parent_key], "left_anti")


def violations(rows: DataFrame, rules: dict) -> DataFrame:
    """How many rows break each rule; a rule is a condition that holds for good rows. One pass."""
    counts = rows.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()])
    return counts.select(F.explode(F.create_map(*[x for n in rules for x in (F.lit(n), F.col(n))])).alias("rule", "violations"))
