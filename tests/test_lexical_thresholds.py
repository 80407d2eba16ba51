"""First thresholds of the lexical search, and terms cut where the index is made."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from folio.functions import text
from folio.operators import lexical
from folio.plans import retrieval as plans
from folio.registry import Tables


def test_tasks_keep_few_rows_beyond_the_best_of_all(spark):
    """k rows a query and task at most are not enough: with many tasks they are many times k rows a query."""
    t, k = Tables(spark, "/root/testdata/sf0.1"), 10
    blocks = lexical.index_texts(t.documents.withColumnRenamed("doc_id", "chunk_id").repartition(16), text.fold(F.col("text")))
    assert blocks.rdd.getNumPartitions() == 16
    asked = plans.query_terms(t).persist()
    queries = asked.select("query_id").distinct().count()
    rows = lexical.kept(asked, blocks, k).count()
    assert k * queries * 0.9 < rows < 4 * k * queries  # without first thresholds nearly 16 * k * queries
    want = {tuple(r) for r in lexical.search(asked, lexical.index(t.documents.withColumnRenamed("doc_id", "chunk_id").coalesce(1), plans.chunk_terms()), k).collect()}
    assert {tuple(r) for r in lexical.search(asked, blocks, k).collect()} == want


def test_thresholds_are_never_above_the_kth(spark):
    rng = random.Random(6)
    chunks = [(i, rng.choices([f"w{j}" for j in range(60)], k=rng.choice([3, 9, 80]))) for i in range(900)]
    queries = {q: rng.sample([f"w{j}" for j in range(60)], rng.randint(1, 9)) for q in range(30)} | {77: ["nowhere"]}
    blocks = lexical.index(spark.createDataFrame(chunks, "chunk_id long, terms array<string>").repartition(5), F.col("terms"))
    wave = lexical.Wave(pa.table({"query_id": list(queries), "terms": list(queries.values())}))
    least = lexical._thresholds(wave, blocks, 7)
    kth = [sorted((sum(t in queries[q] for t in ts) for _, ts in chunks), reverse=True)[6] for q in wave.ids.tolist()]
    assert (least <= np.maximum(kth, 1)).all() and (least[:30] > 1).sum() > 20 and least[30] == 1


def test_terms_of_texts_are_those_of_the_pattern(spark):
    texts = ["", None, "abcd", "abcde", "abcde12 fghij-klmno", "  éclair ÉCLAIRS Kelvin İstanbul straße maßstab", "x" * 3000, "日本語abcdef日本語", "a1b2c3\nd4e5f6\t\x00ghijk", "abcde_fghij.klmno"]
    rows = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string").coalesce(1)
    terms = lambda blocks: {(i, t, n) for b in blocks.toArrow().to_batches() for r in range(b.num_rows) for i, t, n in postings(b, r)}
    want = terms(lexical.index(rows, plans.chunk_terms()))
    assert want and terms(lexical.index_texts(rows, text.fold(F.col("text")))) == want


def postings(batch, r):
    ids, starts, _, places = lexical._opened(batch, r)
    for t, (a, b) in zip(batch.column("terms")[r].as_py(), zip(starts, starts[1:])):
        for place, n in zip(*np.unique(places[a:b], return_counts=True)):
            yield int(ids[place]), t, int(n)
