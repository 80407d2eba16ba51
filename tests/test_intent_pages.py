"""Chunks on the pages that a query's words call for."""

from folio.operators import judging

RULES = [(["alpha"], [0, 3]), (["beta"], [1]), (["gamma", "delta"], [2, 4, 5])]
ASKED, CHUNKS = "query_id long, query string, document_id int", "chunk_id long, document_id long, page long, content string"


def by_hand(queries, chunks):
    """One query after another; those of one id share their places."""
    met = {}
    for query_id, query, document_id in queries:
        pages = next((p for words, p in RULES if any(w in query.lower() for w in words)), [])
        met.setdefault(query_id, []).extend((page, c, max(8, 4 * len(pages))) for c, d, page, _ in chunks if document_id is not None and d == document_id and page in pages)
    return sorted((q, c, page, place) for q, rows in met.items() for place, (page, c, most) in enumerate(sorted(rows), 1) if place <= most)


def joined(plan) -> int:
    """The most rows that a join of the plan that ran has made."""
    name = plan.nodeName()
    below = [plan.executedPlan()] if name == "AdaptiveSparkPlan" else [plan.plan()] if name.endswith("QueryStage") else [plan.children().apply(i) for i in range(plan.children().size())]
    own = plan.metrics().get("numOutputRows").get().value() if "Join" in name else 0
    return max([own, *map(joined, below)])


def test_queries_of_a_long_document(spark):
    """Two thousand chunks and three hundred queries of one document: queries meet its first chunks, not all on the page."""
    chunks = [(i, 7, i % 6, "x") for i in range(2000)]
    queries = [(i, ("an Alpha", "some beta", "a delta", "none")[i % 4], 7) for i in range(300)]
    rows = judging.intent_pages(spark.createDataFrame(queries, ASKED), spark.createDataFrame(chunks, CHUNKS), RULES)
    assert sorted(map(tuple, rows.collect())) == by_hand(queries, chunks)
    assert 0 < joined(rows._jdf.queryExecution().executedPlan()) <= 300 * 12


def test_queries_of_one_id_share_their_places(spark):
    """Rules with other limits and other documents under one id, copies, pages of few chunks, and what is missing."""
    chunks = [(i, i % 3, i % 7, "x") for i in range(400)] + [(i, 5, i % 6, "x") for i in range(400, 409)] + [(409, None, 0, "x"), (410, 1, None, "x")]
    asked = ("alpha beta", "beta", "gamma", "Délta", "none")
    queries = [(i % 23, asked[i % 5], i % 3) for i in range(60)] + [(100, "alpha", 0)] * 9 + [(101, "alpha", 5), (102, "delta", 5), (102, "beta", 1), (103, "beta", None), (104, "beta", 9)]
    rows = judging.intent_pages(spark.createDataFrame(queries, ASKED), spark.createDataFrame(chunks, CHUNKS), RULES)
    want = by_hand([(q, text.replace("é", "e"), d) for q, text, d in queries], chunks)
    assert sorted(map(tuple, rows.collect())) == want
    assert rows.columns == ["query_id", "chunk_id", "page", "place"]
