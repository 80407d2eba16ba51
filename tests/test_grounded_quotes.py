"""c6_ground_answers on texts that its SQL and a near match judge differently."""

from folio.queries import ORACLE_SQL, QUERIES

from .compare import connect, difference

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_only_the_quote_itself_counts(spark, tmp_path):
    head = "Opening words stand here then. "
    part = "several plain people walked along the narrow river bank toda"
    close = f"{head}{part}y. Later zz{part}qq 9 9 came, and zz{part}Qqq 99, no more. Then zz{part[:-1]}qq 99."
    cut = "0123456789several plain people walk along the narrow river side-\nbank of it today. And so on it went."
    odd = "0123456789 two words " + " " * 60 + "x"
    rows = [(3, close, "en", "s", 1), (1, cut.replace("side-\nbank", "bank side-\nmen"), "en", "s", 1), (2, None, "en", "s", 1), (6, None, "en", "s", 1), (4, odd, "en", "s", 1), (5, "", "en", "s", 1), (7, "ab\ncd" * 30, "en", "s", 1), (8, cut, "en", "s", 1), (10, "0123456789　one two ", "en", "s", 1)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings", "pages", "benchmark", "labels", "conversations"):
        (tmp_path / f"{name}.parquet").symlink_to(f"/root/testdata/sf0.001/{name}.parquet")
    assert difference(spark, connect(tmp_path), QUERIES["c6_ground_answers"], ORACLE_SQL["c6_ground_answers"], str(tmp_path)) is None
