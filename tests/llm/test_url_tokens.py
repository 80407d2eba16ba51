"""Url filters on tokens that stand late in a url."""

from folio.llm import url_filters


def test_tokens_after_the_twelfth_make_rules(spark):
    front = "/".join(f"t{k}" for k in range(20))
    # Every other bad url has its telling token early, so counting early ones alone would halve its support.
    late = lambda i: f"http://host.org/{front}/{['fine', 'evil'][i % 2]}/n{i}" if i % 4 else f"http://host.org/fine/{front}/n{i}"
    rows = [(i, late(i)) for i in range(40)] + [(100, f"http://new.net/{front}/x?q=evil"), (101, "http://new.net/fine"), (102, "http://t3.net/evil")]
    marks = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r for r in url_filters.url_filter(spark.createDataFrame(rows, "page_id long, url string"), marks).collect()}
    assert {i: r["verdict"] for i, r in got.items()} == {i: ["allow", "block"][i % 2] for i in range(40)} | {100: "block", 101: "allow", 102: "block"}
    assert all(r["rule_confidence"] == 1 and "evil" in r["rule_words"].split() for r in got.values() if r["verdict"] == "block")


def test_tokens_of_the_same_rows_stand_for_each_other(spark):
    rows = [(i, f"http://a.b/{['x', 'one/two'][i % 2]}") for i in range(40)] + [(50, "http://q/two"), (51, "http://q/one")]
    marks = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r["rule_words"] for r in url_filters.url_filter(spark.createDataFrame(rows, "page_id long, url string"), marks).collect()}
    assert (got[50], got[51], got[0]) == ("two", "one", None)
