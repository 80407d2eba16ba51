"""Block index and pruned vector search against all pairs, what they spare, and what they shuffle."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folio.operators import lexical, retrieval
from folio.plans import retrieval as plans
from folio.registry import Tables


def plain_lexical(chunks, queries, k):
    out = set()
    for q, asked in queries.items():
        scores = [(-sum(t in asked for t in terms), i) for i, terms in chunks]
        for rank, (s, i) in enumerate(sorted(x for x in scores if x[0] < 0)[:k], 1):
            out.add((q, i, round(-s * 0.1, 6), rank))
    return out


@pytest.mark.parametrize("size, wave", [(4096, 1_000_000), (7, 20)])
def test_lexical_equals_all_pairs(spark, monkeypatch, size, wave):
    monkeypatch.setattr(lexical, "CHUNKS", size)
    monkeypatch.setattr(lexical, "WAVE_TERMS", wave)
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(40)]
    chunks = [(i, rng.choices(vocabulary, range(40, 0, -1), k=rng.randint(0, 30))) for i in range(200)] + [(200, None), (3, ["w1", "w1"])]
    queries = {q: set(rng.sample(vocabulary, rng.randint(1, 12))) for q in range(20)} | {99: {"nowhere"}}
    rows = spark.createDataFrame(chunks, "chunk_id long, terms array<string>").repartition(3)
    asked = spark.createDataFrame([(q, t) for q, ts in queries.items() for t in [*ts, *ts]] + [(98, None)], "query_id long, term string")
    blocks = lexical.index(rows, F.col("terms"))
    got = {tuple(r) for r in lexical.search(asked, blocks, 5).collect()}
    assert got == plain_lexical([(i, t or []) for i, t in chunks], queries, 5)
    counts = {r["query_id"]: r["n"] for r in lexical.matching(asked, blocks).collect()}
    assert counts == {q: n for q, ts in queries.items() if (n := sum(bool(ts & set(t or [])) for _, t in chunks))}
    nothing = spark.createDataFrame([], "query_id long, term string")
    assert lexical.search(nothing, blocks, 5).count() == 0
    assert lexical.search(asked, lexical.index(rows.limit(0), F.col("terms")), 5).count() == 0


def blocks_of(chunks, size):
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in chunks]), pa.array([t for _, t in chunks], pa.list_(pa.string()))], ["chunk_id", "terms"])
    return [lexical.Block(x, 0) for i in range(0, len(chunks), size) for x in lexical._indexed(iter([batch.slice(i, size)]))]


def test_bounds_spare_postings_and_blocks():
    rng = random.Random(2)
    chunks = [(i, ["common"] * rng.randint(1, 2) + (["rare"] * 9 if i % 50 == 3 else []) + rng.choices("abcdefgh", k=5)) for i in range(2000)]
    best = lexical.Best(10)
    for block in blocks_of(chunks, 100):
        best.meet(block, ["common", "rare", "a"])
    want = sorted((-sum(t in ("common", "rare", "a") for t in ts), i) for i, ts in chunks)[:10]
    assert list(zip((-best.total).tolist(), best.ids.tolist())) == want
    assert best.read < best.all / 4
    # Where no bound can help, as all chunks are alike, the first by id are still the ones found.
    best = lexical.Best(3)
    for block in blocks_of([(i, ["x", "y"]) for i in range(60, 0, -1)], 7):
        best.meet(block, ["y", "x"])
    assert best.ids.tolist() == [1, 2, 3] and best.total.tolist() == [2, 2, 2]


def test_large_blocks_spare_short_chunks_and_overflow_nothing():
    """Blocks go over batches, their longest chunks are first, and terms times chunks may be over 2**31."""
    assert lexical.CHUNKS > 4096
    n = 12000
    chunks = [(i, ["common"] * (i % 3) + [f"t{i}x{j}" for j in range(20)] + (["zz"] * (i % 400) + ["y"] * 3 if i % 40 == 7 else [])) for i in range(n)]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in chunks]), pa.array([t for _, t in chunks], pa.list_(pa.string()))], ["chunk_id", "terms"])
    made = list(lexical._indexed(iter([batch.slice(i, 1000) for i in range(0, n, 1000)])))
    assert len(made) == 1
    block = lexical.Block(made[0], 0)
    assert len(block.terms) * n > 2**31
    wave = lexical.Wave(pa.table({"query_id": [1, 2], "terms": [["common", "zz", "y", "t11999x3"], ["nowhere"]]}))
    best = lexical.Best(10)
    for _ in range(2):  # the second time with a threshold: each chunk is there twice
        ((q, own),) = wave.met(block)
        before = best.read
        best.meet_codes(block, own)
    score = lambda ts: sum(t in ("common", "zz", "y", "t11999x3") for t in ts)
    want = sorted((-score(ts), i) for i, ts in chunks)
    want = sorted([x for x in want[:10] for _ in range(2)])[:10]
    assert q == 0 and list(zip((-best.total).tolist(), best.ids.tolist())) == want
    assert best.read - before < before / 10  # chunks with fewer terms than the threshold are left out


def test_tasks_keep_k_rows_a_query(spark):
    t = Tables(spark, "/root/testdata/sf0.01")
    blocks = plans.word_index(t)
    kept = lexical.kept(plans.query_terms(t), blocks, 20)
    tasks, queries = blocks.rdd.getNumPartitions(), 20
    rows = [(r["query_id"], r["count"]) for r in kept.groupBy("query_id").count().collect()]
    assert len(rows) == queries and max(n for _, n in rows) <= 20 * tasks
    assert kept.count() < lexical.matching(plans.query_terms(t), blocks).agg(F.sum("n")).first()[0] / 10


def plain_nearest(ids, x, queries, q, k):
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)
    s = np.round(unit(q) @ unit(x).T, 6) + 0.0
    return {(a, ids[j], s[i, j], r) for i, a in enumerate(queries) for r, j in enumerate(np.lexsort((ids, -s[i]))[:k].tolist(), 1)}


@pytest.mark.parametrize("kind", ["clusters", "equidistant", "equal", "zero"])
def test_nearest_equals_all_pairs(spark, monkeypatch, kind):
    monkeypatch.setattr(retrieval, "BLOCK", 10)
    monkeypatch.setattr(retrieval, "WAVE", 2)
    monkeypatch.setattr(retrieval, "PACK", 16)
    monkeypatch.setattr(retrieval, "PIVOTS", 6)
    rng = np.random.default_rng(3)
    n, d = 300, 32
    x = {
        "clusters": np.eye(d)[rng.integers(0, 5, n)] * 4 + rng.normal(0, 0.1, (n, d)),
        "equidistant": np.vstack([np.eye(d)] * 10)[:n],
        "equal": np.ones((n, d)),
        "zero": np.where(rng.random((n, 1)) < 0.3, 0.0, rng.normal(0, 1, (n, d))),
    }[kind]
    ids = rng.permutation(n).tolist()
    chunks = spark.createDataFrame([(i, v) for i, v in zip(ids, x.tolist())] + [(5000, None)], "chunk_id long, embedding array<double>").repartition(3)
    queries = [i for i in ids if i % 6 == 0]
    got = retrieval.nearest(chunks.where("chunk_id % 6 = 0").withColumnRenamed("chunk_id", "query_id"), chunks, 7)
    place = {i: k for k, i in enumerate(ids)}
    want = plain_nearest(np.array(ids), x, queries, x[[place[i] for i in queries]], 7)
    assert {(r["query_id"], r["chunk_id"], r["rank"]) for r in got.collect()} == {(a, b, r) for a, b, _, r in want}


def packs_of(x, pivots, pack=64):
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(x))), pa.array(x.tolist(), pa.list_(pa.float64()))], ["chunk_id", "embedding"])
    retrieval.PACK, before = pack, retrieval.PACK
    try:
        made = list(retrieval._packed(iter([batch]), pivots))
    finally:
        retrieval.PACK = before
    unit = lambda v, n: np.asarray(v).reshape(n, -1) / np.maximum(np.linalg.norm(np.asarray(v).reshape(n, -1), axis=1, keepdims=True), 1e-30)
    return [(np.array(b.column("chunk_id")[0].as_py()), unit(b.column("x")[0].as_py(), len(b.column("chunk_id")[0])), np.array(b.column("center")[0].as_py()), b.column("spread")[0].as_py()) for b in made]


def test_bounds_spare_packs_that_cannot_win():
    rng = np.random.default_rng(5)
    x = np.eye(16)[rng.integers(0, 16, 4000)] + rng.normal(0, 0.02, (4000, 16))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    best = retrieval.Nearest(np.arange(50), unit[:50], 5, 6)
    best.meet(packs_of(x, x[:64]))
    want = [np.lexsort((np.arange(4000), -row))[:5].tolist() for row in np.round(unit[:50] @ unit.T, 6)]
    assert best.chunk.tolist() == want
    assert best.spared > 2 * best.compared
    # All as far from each other as they can be: nothing is spared, nothing is lost.
    x = np.eye(64)
    best = retrieval.Nearest(np.arange(64), x, 3, 6)
    best.meet(packs_of(x, x[:4], 8))
    assert best.chunk.tolist() == [[i, *[j for j in (0, 1, 2) if j != i][:2]] for i in range(64)]
    assert Counter(best.score.ravel().tolist()) == {1.0: 64, 0.0: 128}
