"""Golden suites in, reports out, and a corpus of generated missions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CASES = "cases array<struct<case_id: string, query: string, should_abstain: boolean, expected_evidence: array<struct<document_id: bigint, page: int, chunk_id: bigint, evidence_quote: string>>, accepted_answer_fragments: array<string>, forbidden_answer_fragments: array<string>>>"


def golden_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CASES).option("multiLine", True).json(path).select(F.inline("cases"))


def golden_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Numbered ``**FAMILY** — query > expected — p. N`` items under ``## n.`` headings: section, number, family, query,
    expected and pages."""
    whole = spark.read.text(path, wholetext=True)
    parts = whole.select(F.posexplode(F.split("value", r"(?m)^## (?=[0-9]+\.)")).alias("_p", "body")).where("_p > 0")
    lines = parts.select(F.regexp_extract("body", r"^([0-9]+)\.", 1).cast("int").alias("section"), F.explode(F.split("body", "\n")).alias("line"))
    item = r"^([0-9]+)\. \*\*([^*]+)\*\* — (.+?) > (.+?)(?: — p\. (.+))?$"
    pick = lambda i: F.regexp_extract("line", item, i)
    rows = lines.where(F.col("line").rlike(item))
    pages = F.transform(F.regexp_extract_all(pick(5), F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("int"))
    return rows.select("section", pick(1).cast("int").alias("number"), pick(2).alias("family"), pick(3).alias("query"), pick(4).alias("expected"), pages.alias("pages"))


def json_report(rows: DataFrame, path: str) -> None:
    """One file: for reports of a few rows."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def csv_summary(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def markdown_summary(rows: DataFrame, case: str, mode: str, value: str, modes: list[str]) -> DataFrame:
    """A line of a Markdown table per case, the modes side by side."""
    wide = rows.groupBy(case).pivot(mode, modes).agg(F.first(value))
    cells = [F.coalesce(F.col(f"`{m}`").cast("string"), F.lit("-")) for m in modes]
    return wide.select(case, F.concat(F.lit("| "), F.concat_ws(" | ", F.col(case).cast("string"), *cells), F.lit(" |")).alias("line"))


def freeze_pool(candidates: DataFrame, path: str, pool_id: str) -> None:
    """Candidate lists after fusion, kept for later comparison."""
    candidates.withColumn("pool_id", F.lit(pool_id)).write.mode("append").partitionBy("pool_id").parquet(path)


#: What generated missions cycle through.
GENERATED = {
    "sector": ["Banque", "Assurance", "Santé", "Industrie", "Télécom", "Public"],
    "mission_type": ["Audit", "Migration", "Intégration", "Conseil"],
    "stack": ["Java", "Python", "Kafka", "PostgreSQL", "Spark", "Kubernetes"],
}


def generated_missions(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """n missions with two to four documents; the technologies are in an order by hash of mission and seed."""
    pick = lambda k: F.element_at(F.array(*[F.lit(v) for v in GENERATED[k]]), (F.col("id") % len(GENERATED[k]) + 1).cast("int"))
    stack = F.array(*[F.lit(v) for v in GENERATED["stack"]])
    order = F.array_sort(F.transform(stack, lambda s: F.struct(F.xxhash64(F.col("id"), s, F.lit(seed)).alias("h"), s.alias("s"))))
    docs = F.transform(F.sequence(F.lit(0), (F.lit(1) + F.col("id") % 3).cast("int")), lambda i: F.struct(i.alias("chunk_index"), F.lit("note").alias("kind"), F.concat(F.lit("Document "), i.cast("string"), F.lit(" de la mission "), F.col("id").cast("string")).alias("content")))
    rows = spark.range(n)
    return rows.select(
        F.concat(F.lit("mission-"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("id"), pick("sector").alias("sector"), pick("mission_type").alias("mission_type"), F.transform(F.slice(order, 1, 3), lambda x: x["s"]).alias("technologies"), (2018 + F.col("id") % 7).cast("int").alias("year"), docs.alias("documents")
    )
