"""Changes by bucket: the rows they leave, the files they leave alone, and that running them again changes nothing."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from folio.registry import Tables
from folio.sources import buckets, tables

N = 16


@pytest.fixture
def table(spark):
    path = tables.scratch(spark) + "/parts"
    rows = spark.createDataFrame([(i, f"k{i}", f"v{i}") for i in range(60)] + [(60, None, "no key")], "id long, name string, value string")
    buckets.create(rows, path, "name", N)
    return path


def files(path):
    local = path.removeprefix("file:")
    return {os.path.relpath(f, local) for f in glob.glob(f"{local}/bucket=*/*.parquet")}


def rows(spark, path):
    return {r["name"]: (r["id"], r["value"]) for r in buckets.read(spark, path).collect()}


def untouched(spark, names, before):
    hit = {r["b"] for r in spark.createDataFrame([(n,) for n in names], "name string").select(buckets.bucket("name", N).alias("b")).collect()}
    return {f for f in before if int(f.split("/")[0].split("=")[1]) not in hit}


def test_upsert_touches_its_buckets_alone(spark, table):
    before = files(table)
    new = spark.createDataFrame([("k3", "new"), ("fresh", "a"), ("fresh", "b"), (None, "lost")], "name string, value string")
    buckets.upsert(spark, table, new, "name", "id", N)
    got, after = rows(spark, table), files(table)
    assert got["k3"] == (3, "new") and got["fresh"] == (61, "b") and len(got) == 62 and got[None] == (60, "no key")
    kept = untouched(spark, ["k3", "fresh"], before)
    assert kept and kept <= after and not (before - kept) & after
    buckets.upsert(spark, table, new, "name", "id", N)
    assert rows(spark, table) == got and buckets.read(spark, table).count() == 62


def test_replace_and_delete(spark, table):
    before = files(table)
    new = spark.createDataFrame([(100, "k5", "x"), (101, "k5", "y"), (102, "other", "z")], "id long, name string, value string")
    for _ in range(2):
        buckets.replace(spark, table, new, "name", N)
        got = sorted((r["id"], r["value"]) for r in buckets.read(spark, table).where("name in ('k5', 'other')").collect())
        assert got == [(100, "x"), (101, "y"), (102, "z")] and buckets.read(spark, table).count() == 63
    assert untouched(spark, ["k5", "other"], before) <= files(table)
    one = buckets.read(spark, table).withColumn("b", buckets.bucket("name", N)).where("name is not null")
    whole = one.where(F.col("b") == one.agg(F.min("b")).first()[0])
    n = whole.count()
    buckets.delete(spark, table, whole.select("name").union(spark.createDataFrame([("nowhere",), (None,)], "name string")), "name", N)
    assert buckets.read(spark, table).count() == 63 - n and None in rows(spark, table)
    buckets.delete(spark, table, whole.select("name").limit(0), "name", N)
    assert buckets.read(spark, table).count() == 63 - n


def test_cascade_over_parents_and_children(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    parents, children = tables.scratch(spark) + "/orders", tables.scratch(spark) + "/lineitem"
    buckets.create(t.orders, parents, "o_orderkey", N)
    buckets.create(t.lineitem, children, "l_orderkey", N)
    gone = t.orders.where("o_orderkey % 7 = 0").select("o_orderkey")
    buckets.delete(spark, parents, gone, "o_orderkey", N)
    buckets.delete(spark, children, gone.withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey", N)
    a, b = tables.cascade_delete(t.orders, t.lineitem, gone, "o_orderkey", "l_orderkey")
    for path, want in ((parents, a), (children, b)):
        got = buckets.read(spark, path).select(*want.columns)
        assert got.count() == want.count() and got.exceptAll(want).count() == 0
