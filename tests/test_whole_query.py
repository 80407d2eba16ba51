"""Searches by whole query texts, against brute force."""

import random
from collections import Counter

from folio.plans import retrieval as plans
from folio.queries import QUERIES
from folio.registry import Tables

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_terms_after_the_eighth_are_looked_up(spark, tmp_path):
    rng = random.Random(3)
    names = [f"common{i}" for i in range(8)] + [f"later{i}" for i in range(40)]
    rows = [(i, " ".join(names[:8] + rng.sample(names, 20)) if i % 50 == 0 else " ".join(rng.choices(names, k=30)), "en", "s", 1) for i in range(150)]
    rows[7] = (7, "later0 " * 90, "en", "s", 1)
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    t = Tables(spark, str(tmp_path))
    want = set()
    for q, text, *_ in rows[::50]:
        terms = set(text.split())
        score = {d: round(sum(n for w, n in Counter(x.split()).items() if w in terms) * 0.1, 6) for d, x, *_ in rows}
        best = sorted((-s, d) for d, s in score.items() if s > 0)[:20]
        want |= {(q, d, -s, i) for i, (s, d) in enumerate(best, 1)}
    got = {tuple(r) for r in QUERIES["k2_lexical_top_k_whole"](spark, str(tmp_path)).select("query_id", "chunk_id", "score", "rank").collect()}
    assert got == want
    assert got == {tuple(r) for r in plans.lexical(t).select("query_id", "chunk_id", "score", "rank").collect()}
