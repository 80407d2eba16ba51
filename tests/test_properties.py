"""Properties that hold for any input."""

from hypothesis import given, settings
from hypothesis import strategies as st

from folio.operators import grounding, ingest, retrieval

WORDS = st.lists(st.text("abcdé", min_size=1, max_size=6), min_size=1, max_size=60)


@settings(max_examples=80, deadline=None)
@given(WORDS, st.integers(3, 12), st.integers(0, 4))
def test_chunks_hold_all_words_within_the_budget(words, most, overlap):
    text = " ".join(w + ("." if i % 4 == 3 else "") for i, w in enumerate(words))
    out = ingest.chunks_of(text, most, overlap)
    assert all(ingest.count_tokens(c) <= most for c in out)
    at = 0
    for c in out:  # every word comes up, in order, though a sentence may be there twice
        for w in c.split():
            if at < len(text.split()) and w == text.split()[at]:
                at += 1
    assert at == len(text.split())


@settings(max_examples=80, deadline=None)
@given(WORDS, st.data())
def test_quotes_lead_back_to_their_place(words, data):
    body = " ".join(words)
    a = data.draw(st.integers(0, len(words) - 1))
    b = data.draw(st.integers(a + 1, len(words)))
    quote = " ".join(words[a:b])
    start, end = grounding.quote_range(body, quote)
    assert body[start:end].casefold() == quote.casefold()


def test_fusion_does_not_depend_on_order_or_partitions(spark):
    rows = [(q, c, r) for q in range(3) for r, c in enumerate([(q * 7 + k * 5) % 13 for k in range(8)], 1)]
    a = spark.createDataFrame(rows, "query_id long, chunk_id long, rank long")
    b = spark.createDataFrame(rows[::-1], "query_id long, chunk_id long, rank long").repartition(7)
    want = retrieval.fuse([(a, 1.0), (a, 2.0)], 5).collect()
    assert sorted(want) == sorted(retrieval.fuse([(b, 2.0), (b, 1.0)], 5).collect())
    assert all(0 < r["rrf_score"] <= 3 / 61 + 1e-9 for r in want)
