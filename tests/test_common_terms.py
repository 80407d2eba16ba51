"""Common terms are read only for the chunks that can still get among the best."""

import random

import pyarrow as pa

from folio.operators import lexical


def test_common_terms_are_read_for_few_chunks():
    rng = random.Random(4)
    common = [f"c{j}" for j in range(20)]
    chunks = []
    for i in range(6000):
        terms = [t for t in common if rng.random() < 1 / 3 for _ in range(rng.randint(1, 3))]
        chunks.append((i, terms + [f"p{i}x{j}" for j in range(60)] + (["zz"] * 10 if i % 100 == 7 else [])))
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in chunks]), pa.array([t for _, t in chunks], pa.list_(pa.string()))], ["chunk_id", "terms"])
    (made,) = lexical._indexed(iter([batch]))
    block, best, asked = lexical.Block(made, 0), lexical.Best(10), [*common, "zz"]
    best.meet(block, asked)
    before, postings = best.read, best.all
    best.meet(block, asked)  # the second time with a threshold: each chunk is there twice
    want = sorted((-sum(t in asked for t in ts), i) for i, ts in chunks)[:5]
    assert list(zip((-best.total).tolist(), best.ids.tolist())) == [x for x in want for _ in range(2)]
    assert best.read - before < postings / 10


def test_counts_beyond_sixteen_bits():
    chunks = [(i, ["often"] * (70_000 if i == 5 else 1) + ["too"] * 900) for i in range(90)]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in chunks]), pa.array([t for _, t in chunks], pa.list_(pa.string()))], ["chunk_id", "terms"])
    (made,) = lexical._indexed(iter([batch]))
    best = lexical.Best(3)
    best.meet(lexical.Block(made, 0), ["often", "too"])
    assert best.total.tolist() == [70_900, 901, 901] and best.ids.tolist() == [5, 0, 1]
