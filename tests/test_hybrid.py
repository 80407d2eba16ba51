"""Hybrid retrieval with companions, against plain Python over the rows that SQL gives, and on a small fixture."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from folio.operators import retrieval
from folio.plans import retrieval as plans
from folio.queries import QUERIES

from .compare import connect

CFG = plans.CFG


def beside(selected, candidates, chunks):
    """Chunk ids that stand beside the first selected rows, in the order in which they are added."""
    anchors = {}
    for row in sorted((r for r in selected if r["place"] <= CFG.anchors), key=lambda r: r["place"]):
        spot = (row["document_id"], row["page"])
        anchors[spot] = min(anchors.get(spot, row["chunk_index"]), row["chunk_index"])
    same, found, fetched = [], [], []
    for (doc, page), first in anchors.items():
        there = sorted((c for c in candidates if (c["document_id"], c["page"]) == (doc, page) and c["chunk_index"] >= first), key=lambda c: c["chunk_index"])
        same += there[: CFG.siblings] if len(there) > 1 else []
        after = sorted((c for c in candidates if (c["document_id"], c["page"]) == (doc, page + 1)), key=lambda c: c["rank"])
        if after:
            found.append(after[0])
        elif chunks[doc, page + 1]:
            fetched.append(min(chunks[doc, page + 1], key=lambda c: c["chunk_index"]))
    return same + found + fetched


def folded(selected, extra):
    out = sorted(selected, key=lambda r: r["place"])
    for new in extra:
        spare = [i for i, r in enumerate(out) if (r["document_id"], r["page"]) != (new["document_id"], new["page"])]
        if spare and all(r["chunk_id"] != new["chunk_id"] for r in out):
            out[spare[-1]] = new
    spots = defaultdict(list)
    for i, r in enumerate(out):
        spots[r["document_id"], r["page"]].append(i)
    for places in spots.values():
        for i, r in zip(places, sorted((out[j] for j in places), key=lambda r: r["chunk_index"])):
            out[i] = r
    return out


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_companions_on_the_tables(spark, folder):
    con = connect(folder)

    def rows(sql):
        cur = con.execute(f"WITH {plans.HYBRID_SQL} {sql}")
        names = [d[0] for d in cur.description]
        return [dict(zip(names, r)) for r in cur.fetchall()]

    selected, candidates, chunks = defaultdict(list), defaultdict(list), defaultdict(list)
    for r in rows("SELECT query_id, chunk_id, document_id, page, chunk_id AS chunk_index, final_rank AS place FROM se"):
        selected[r["query_id"]].append(r)
    for r in rows("SELECT query_id, chunk_id, document_id, page, chunk_id AS chunk_index, rank FROM ca"):
        candidates[r["query_id"]].append(r)
    for r in rows("SELECT doc_id AS chunk_id, source AS document_id, n_chars AS page, doc_id AS chunk_index FROM documents"):
        chunks[r["document_id"], r["page"]].append(r)
    named = {r["query_id"]: r["source"] for r in rows("SELECT * FROM na")}
    want = set()
    for q, mine in selected.items():
        out = list(enumerate(folded(mine, beside(mine, candidates[q], chunks)), 1))
        own = [(i, r) for i, r in out if r["document_id"] == named.get(q)]
        want |= {(q, r["chunk_id"], i) for i, r in own or out}
    got = QUERIES["c1_hybrid_with_companions"](spark, folder)
    assert {(r["query_id"], r["chunk_id"], r["place"]) for r in got.collect()} == want


CHUNKS = "chunk_id long, document_id string, page long, chunk_index long"
LIST = "query_id long, chunk_id long, score double, rank long"


def test_a_page_and_the_next_come_along(spark):
    chunks = spark.createDataFrame([(i, "a", 1 + i // 4, i % 4) for i in range(8)] + [(i, "b", i, 0) for i in range(20, 40)], CHUNKS)
    vector = spark.createDataFrame([(1, 0, 0.9, 1), (1, 2, 0.8, 2)] + [(1, 20 + 2 * i, 0.5 - i / 100, 3 + i) for i in range(10)], LIST)
    words = spark.createDataFrame([(1, 0, 1.0, 1)], LIST)
    cfg = retrieval.HybridConfig(anchors=1)
    got = [r["chunk_id"] for r in retrieval.hybrid_retrieve(vector, words, chunks, cfg=cfg).orderBy("place").collect()]
    # Chunk 2 is on the page and selected itself; chunk 4, the first of the next page, takes the last place.
    assert len(got) == 10 and got[:2] == [0, 2] and got[-1] == 4


def test_named_documents_go_first_and_stay_alone(spark):
    chunks = spark.createDataFrame([(i, "a" if i < 3 else "b", i, 0) for i in range(30)], CHUNKS)
    vector = spark.createDataFrame([(q, 10 + i, 0.9 - i / 100, 1 + i) for q in (1, 2) for i in range(15)], LIST)
    words = spark.createDataFrame([(2, 20, 1.0, 1)], LIST)
    named = spark.createDataFrame([(1, "a"), (2, "missing")], "query_id long, document_id string")
    got = defaultdict(set)
    reranker = F.when(F.col("document_id") == "a", 0.95).otherwise(F.coalesce("vector_score", F.lit(0.5)))
    for r in retrieval.hybrid_retrieve(vector, words, chunks, named, relevance=reranker).collect():
        got[r["query_id"]].add(r["chunk_id"])
    assert got[1] == {0, 1, 2}  # silent in both lists, found by name
    assert len(got[2]) == 10 and 20 in got[2]  # the name fits nothing: all rows stay


def test_empty_lists(spark):
    none, chunks = spark.createDataFrame([], LIST), spark.createDataFrame([], CHUNKS)
    assert retrieval.hybrid_retrieve(none, none, chunks).count() == 0
