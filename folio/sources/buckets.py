"""Tables of files in hash buckets of a key, changed bucket by bucket: what a change does not touch keeps its files.

A table is partitioned by ``bucket``, the hash of its key. An upsert, a replacement or a deletion reads the buckets of the
keys that it is about and overwrites those alone, with Spark's dynamic partition overwrite: task attempts write apart from
each other and the new files change places with the old ones when the job commits, so a lost executor or a retried task
leaves neither duplicates nor gaps, and a change that is run again changes nothing more. What reaches the driver is a list
of buckets.

Cases: rows that come in without a key are left out of an upsert and kept by a replacement; of rows that come in with
one key an upsert takes the greatest, a replacement takes all; a bucket that loses all rows loses its files; a change
without rows touches nothing; deleting keys that are not there rewrites their buckets as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import sound
from . import tables

BUCKETS = 256
_AT = "bucket"


def bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str, mode: str) -> None:
    rows.repartition(F.col(_AT)).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(_AT).parquet(path)


def create(rows: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """Write a new table, with one file for each bucket that has rows."""
    _write(rows.withColumn(_AT, bucket(key, buckets)), path, "errorifexists")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table, without the column that says in which bucket a row is."""
    return sound(spark).read.parquet(path).drop(_AT)


def _touched(keys: DataFrame, key: str, buckets: int) -> list[int]:
    """The buckets of the keys: ``buckets`` numbers at most."""
    return sorted(r[_AT] for r in keys.select(bucket(key, buckets).alias(_AT)).distinct().collect())


def _old(spark: SparkSession, path: str, touched: list[int]) -> DataFrame:
    return sound(spark).read.parquet(path).where(F.col(_AT).isin(touched)).drop(_AT)


def _exchange(rows: DataFrame, path: str, key: str, buckets: int, touched: list[int]) -> None:
    """Put the rows in the place of all that the touched buckets have."""
    spark = rows.sparkSession
    rows = tables.stored(rows.withColumn(_AT, bucket(key, buckets)))
    left = {r[_AT] for r in rows.select(_AT).distinct().collect()}
    _write(rows, path, "overwrite")
    for gone in set(touched) - left:  # no row has replaced these
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{_AT}={gone}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    tables.clean(spark, rows)


def upsert(spark: SparkSession, path: str, new: DataFrame, key: str, row_id: str, buckets: int = BUCKETS) -> None:
    """Rows of ``new``, with the table's columns but the id, replace those with their key and keep the id; new keys get
    ids after the largest."""
    others = [c for c in new.columns if c != key]
    one = Window.partitionBy(key).orderBy(*[F.desc(c) for c in others], key)
    new = tables.stored(new.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n"))
    touched = _touched(new, key, buckets)
    if touched:
        last = read(spark, path).agg(F.coalesce(F.max(row_id), F.lit(0)).alias("m")).first()["m"]
        _exchange(tables.upsert(_old(spark, path, touched), new, key, row_id, last=last), path, key, buckets, touched)


def replace(spark: SparkSession, path: str, new: DataFrame, key: str, buckets: int = BUCKETS) -> None:
    """Delete the rows of the keys that ``new`` has, then add its rows."""
    new = tables.stored(new)
    touched = _touched(new, key, buckets)
    if touched:
        old = _old(spark, path, touched)
        _exchange(tables.replace_keys(old, new.select(*old.columns), key), path, key, buckets, touched)


def delete(spark: SparkSession, path: str, gone: DataFrame, key: str, buckets: int = BUCKETS) -> None:
    """Delete the rows of these keys; with a table of children in buckets of the same key, the cascade is two calls."""
    gone = tables.stored(gone.select(key).where(F.col(key).isNotNull()).distinct())
    touched = _touched(gone, key, buckets)
    if touched:
        _exchange(_old(spark, path, touched).join(gone, key, "left_anti"), path, key, buckets, touched)
