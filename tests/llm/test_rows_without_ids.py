"""The pipeline's stages on rows that have no doc_id."""

import random

import corpus_pipeline

from .helpers import DOCS, words


def test_copies_and_leaks_without_ids_go(spark, tmp_path):
    rng = random.Random(2)
    a, b, c, item = (" ".join(words(rng, n)) for n in (80, 90, 70, 30))
    rows = [(1, a, "en", "s", 1), *[(None, a, "en", "s", 1)] * 2, *[(None, b, "fr", "s", 2)] * 3, (2, c, "en", "s", 3)]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, DOCS).repartition(3), str(tmp_path))
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got.collect()) == sorted([(1, a), (0, b), (2, c)])
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, f"{a} {item}", "en", "s", 1), (None, f"{b} {item} {c}", "en", "s", 1), (None, b, "en", "s", 1), (None, None, "en", "s", 1), (2, c, "en", "s", 1)]
    got = corpus_pipeline.decontaminate(spark, spark.createDataFrame(rows, DOCS), str(tmp_path))
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got.collect()) == sorted([(0, b), (0, ""), (2, c)])
