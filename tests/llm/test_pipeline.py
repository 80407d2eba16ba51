"""The corpus pipeline against plain Python, stage by stage and as a whole."""

import random

import corpus_pipeline
from folio.llm import common, quality_rules

from .helpers import DOCS, documents, texts, words
from .test_corpus_ops import plain_base, plain_contaminated
from .test_documents_ops import check_packing, plain_statistics
from .test_similar_documents import plain_similar


def tables(spark, folder):
    rng = random.Random(5)
    items = [(i, " ".join(words(rng, 30))) for i in range(4)] + [(9, None)]
    rows = texts(9, 60)
    rows += [" ".join(words(rng, 60)) + " " + items[i % 4][1] + " " + " ".join(words(rng, 40)) for i in range(8)]
    rows += [" ".join(words(rng, 70)) + f' token = "{rng.getrandbits(160):040x}" ' + " ".join(words(rng, 5)) for _ in range(6)]
    rows += ["### ".join(words(rng, 80)) for _ in range(40)]
    docs = documents(spark, rows)
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int("#" not in (t or "")), 0) for i, t in enumerate(rows)] + [(None, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return items


def test_pipeline_against_plain_python(spark, tmp_path):
    folder = str(tmp_path)
    items = tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "simhash near-dedup", "benchmark decontamination", "secret scans", "best-fit packing"]
    trees = quality_rules.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    kept = []
    for r in docs.collect():
        s = plain_statistics(r["text"])
        _, f = quality_rules.statistics((r["text"] or "").encode())
        if s[0] >= 50 and 100 * s[4] <= 50 * s[0] and trees.score(quality_rules.np.array([f]))[0] >= 0.5:
            kept.append(r)
    stage = docs
    outs = []
    for name, fn in corpus_pipeline.STAGES:
        stage = common.stored(fn(spark, stage, folder), name.replace(" ", "_"))
        outs.append(stage)
    assert sorted(map(str, outs[0].collect())) == sorted(map(str, kept))
    assert not any("###" in (r["text"] or "") for r in kept)
    least = set(plain_similar([(r["doc_id"], r["text"]) for r in kept]))
    first = {r["doc_id"]: r for r in kept if r["doc_id"] in least}
    assert sorted(r["doc_id"] for r in outs[1].collect()) == sorted(first)
    bad = {d for d, _ in plain_contaminated([(d, r["text"]) for d, r in first.items()], items)}
    assert len(bad) >= 4
    clean = sorted(set(first) - bad)
    assert sorted(r["doc_id"] for r in outs[2].collect()) == clean
    assert all(o.schema == DOCS for o in outs[:4])
    for r in outs[3].collect():
        old = first[r["doc_id"]]["text"]
        spans, _ = plain_base(old)
        assert r["text"].count("[SECRET]") == len({s for s, k, e in spans if k != 2 or not any(a <= s < b for a, j, b in spans if j != 2)})
        assert not plain_base(r["text"])[1] and r["n_chars"] == (len(r["text"]) if spans else len(old))
    check_packing(outs[4].collect(), outs[3], 4096)
    assert corpus_pipeline.run(spark, folder).count() == outs[4].count()


def test_pipeline_on_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_stages_with_nulls_in_every_column(spark, tmp_path):
    folder = str(tmp_path)
    tables(spark, folder)
    rows = [(None, None, None, None, None), (1, None, None, None, None), (None, " ".join(words(random.Random(1), 90)), None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    for _, fn in corpus_pipeline.STAGES:
        assert fn(spark, docs, folder).count() in (0, 1, 2, 3)
    extra = documents(spark, extra=True)
    for _, fn in corpus_pipeline.STAGES[:4]:
        assert fn(spark, extra, folder).columns == extra.columns
