"""The staged trace: it ends where retrieval ends, and every row that goes on is there at the next stage."""

import pytest
from pyspark.sql import functions as F

from folio.operators import retrieval, staged
from folio.plans import retrieval as plans
from folio.plans import staged as queries
from folio.registry import Tables
from folio.sources import tables

from .compare import connect, difference

CHUNKS = "chunk_id long, document_id string, page long, chunk_index long"
LIST = "query_id long, chunk_id long, score double, rank long"


def test_final_rows_are_those_of_retrieval(spark):
    t = Tables(spark, "/root/testdata/sf0.01")
    inputs = [tables.stored(x) for x in plans.hybrid_inputs(t)]
    trace = staged.trace(*inputs, plans.CFG, path=tables.scratch(spark) + "/trace")
    got = {(r["query_id"], r["chunk_id"]): r["rank"] for r in trace.where("stage = 'final'").collect()}
    want = {(r["query_id"], r["chunk_id"]): r["place"] for r in retrieval.hybrid_retrieve(*inputs, plans.CFG).collect()}
    assert got.keys() == want.keys()
    order = lambda d: sorted(d, key=lambda k: (k[0], d[k]))
    assert order(got) == order(want)  # numbered anew once other documents' rows are gone
    for frame in inputs:
        tables.clean(spark, frame)
    with pytest.raises(ValueError):
        tables.clean(spark, t.region)


def test_what_goes_on_is_at_the_next_stage(spark):
    t = Tables(spark, "/root/testdata/sf0.01")
    rows = queries.traced(t).collect()
    at = {s: {(r["query_id"], r["chunk_id"]) for r in rows if r["stage"] == s} for s in staged.STAGES}
    on = {s: {(r["query_id"], r["chunk_id"]) for r in rows if r["stage"] == s and r["dropped"] is None} for s in staged.STAGES}
    assert on["vector"] | on["lexical"] == at["fused"] and on["fused"] == at["pool"] and on["pool"] == at["selected"]
    assert on["selected"] | on["companion"] | on["backfill"] == at["final"]
    out = {r["doc_id"] for r in t.documents.where(F.col("source") == queries.OUT).collect()}
    assert not out & {c for s in ("fused", "pool", "selected", "companion", "backfill", "final") for _, c in at[s]}
    assert out & {c for _, c in at["lexical"]}


@pytest.mark.parametrize("name", ["c1_hybrid_with_companions", "c1_staged_trace"])
def test_larger_tables_equal_sql(spark, name):
    from folio.queries import ORACLE_SQL, QUERIES

    folder = "/root/testdata/sf0.01"
    assert difference(spark, connect(folder), QUERIES[name], ORACLE_SQL[name], folder) is None


def test_reasons(spark):
    chunks = spark.createDataFrame([(i, "a" if i < 3 else "b", i, 0) for i in range(80)], CHUNKS)
    vector = spark.createDataFrame([(1, 10 + i, 0.9 - i / 100, 1 + i) for i in range(60)] + [(1, 500, 0.95, 99)], LIST)
    words = spark.createDataFrame([(1, 70, 1.0, 1)], LIST)
    extra = spark.createDataFrame([(1, 10, 1), (1, 2, 2), (2, 1, 1)], "query_id long, chunk_id long, place long")
    rows = staged.trace(vector, words, chunks, backfill=extra, path=tables.scratch(spark) + "/trace").collect()
    of = {(r["query_id"], r["chunk_id"], r["stage"]): r["dropped"] for r in rows}
    assert of[1, 500, "vector"] == "out of scope" and of[1, 69, "vector"] == "below fusion"
    assert of[1, 50, "fused"] == "not pooled" and of[1, 30, "pool"] == "below the cut"
    assert of[1, 10, "backfill"] == "already there" and of[1, 2, "backfill"] is None and (1, 2, "final") in of
    assert (2, 1, "final") in of  # in neither list, found by its section
    empty = staged.trace(vector.limit(0), words.limit(0), chunks, path=tables.scratch(spark) + "/trace")
    assert empty.count() == 0
