"""The registered queries of this subpackage: each applies its operator to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, language_id, merkle, packing, quality_rules, secret_scan, simhash_dedup, spelling, suffix_dedup, token_output, toxicity, url_filters, warc
from .common import table


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.url_filter(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_spans(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_statistics(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_components(table(spark, sf_dir, "documents"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tamper_check(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filters, op2_language_id, op3_secret_scan, op4_warc, op5_quality_rules, op6_suffix_dedup, op7_decontamination,
        op8_simhash_dedup, op9_token_output, op10_best_fit_packing, op11_toxicity, op12_spelling_variants, op13_merkle,
    )
}
#: CRC-32 in SQL: the table of its 256 steps, and what it makes of the UTF-8 bytes of a string. The polynomial
#: and the starting value.
CRC_STEPS = """steps AS MATERIALIZED (SELECT list(list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY i) AS step FROM range(256) r(i))"""


def crc_sql(hexed: str) -> str:
    """The checksum of bytes given in hex, in a query that has ``steps``."""
    octets = f"list_transform(range(1, length({hexed}), 2), lambda i: ('0x' || {hexed}[i:i + 1])::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: xor(c >> 8, step[xor(c, b) % 256 + 1])), 4294967295)"


def _leaf_sql(text: str) -> str:
    field = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"
    return "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


def _grown_sql(name: str, base: str) -> str:
    return f"""{name} AS ({base}
  UNION ALL SELECT tree, level + 1, place // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY place))
    FROM {name} WHERE n > 1 GROUP BY tree, level, n, place // 3),
{name}_runs AS (SELECT tree, level, place // 3 AS run, list(digest ORDER BY place) AS members FROM {name} WHERE n > 1 GROUP BY ALL)"""


def _climbed_sql(name: str, base: str, runs: str) -> str:
    before = "array_to_string(members[1:(place % 3)::INT], '')"
    after = "array_to_string(members[(place % 3 + 2)::INT:], '')"
    return f"""{name} AS ({base}
  UNION ALL SELECT id, p.tree, p.level + 1, place // 3, (n + 2) // 3, proof || {before} || {after}, sha256({before} || folded || {after})
    FROM {name} p JOIN {runs} r ON r.tree = p.tree AND r.level = p.level AND r.run = p.place // 3 WHERE n > 1)"""


MERKLE_SQL = f"""WITH RECURSIVE {CRC_STEPS},
hashed AS (SELECT *, {crc_sql("h")} AS crc FROM (SELECT *, hex(encode(doc_id::VARCHAR)) AS h FROM documents), steps),
d AS (SELECT doc_id, coalesce('=' || source, '') AS tree, {_leaf_sql("text")} AS leaf,
    {_leaf_sql("CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")} AS other FROM hashed),
leaves AS (SELECT *, row_number() OVER (ORDER BY tree, doc_id NULLS FIRST, leaf) AS id,
    row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM d),
{_grown_sql("nodes", "SELECT tree, 0 AS level, place, n, leaf AS digest FROM leaves")},
subroots AS (SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS rank, count(*) OVER () AS n FROM nodes WHERE n = 1),
{_grown_sql("top", "SELECT '' AS tree, 0 AS level, rank AS place, n, digest FROM subroots")},
{_climbed_sql("low", "SELECT id, tree, 0 AS level, place, n, '' AS proof, other AS folded FROM leaves", "nodes_runs")},
{_climbed_sql("high", "SELECT id, '' AS tree, 0 AS level, s.rank AS place, s.n, proof, folded FROM low JOIN subroots s USING (tree) WHERE low.n = 1", "top_runs")}
SELECT doc_id, leaf, s.digest AS subroot, t.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = t.digest AS verified
FROM leaves l JOIN high h USING (id) JOIN subroots s ON s.tree = l.tree, (SELECT digest FROM top WHERE n = 1) t WHERE h.n = 1"""

#: Two words of one length are one edit apart if they are equal without the letter at one place, two others if the longer
#: without a letter is the shorter.
SPELLING_SQL = f"""WITH RECURSIVE {CRC_STEPS},
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM documents),
counted AS (SELECT run, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h, count(*) AS k FROM runs WHERE length(run) >= 7 GROUP BY ALL),
drawn AS (SELECT run, k, {crc_sql("h")} AS crc FROM counted, steps),
spelt AS (SELECT CASE WHEN crc % 31 = 0 THEN left(run, (crc % length(run))::INT) || substr(run, (crc % length(run))::INT + 2) ELSE run END AS word, k FROM drawn),
words AS (SELECT word, sum(k)::BIGINT AS n FROM spelt WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
less AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM words)),
near AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, min_by(near, (-near_n, encode(near))) AS near, max(near_n) AS near_n FROM near GROUP BY word),
formed AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * n THEN near END AS form, CASE WHEN near_n >= 10 * n THEN near_n END AS form_n
    FROM words w LEFT JOIN best USING (word)),
led AS (SELECT word, word AS at FROM words UNION ALL SELECT l.word, f.form FROM led l JOIN formed f ON f.word = l.at WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, l.at AS root FROM formed f JOIN led l ON l.word = f.word JOIN formed e ON e.word = l.at WHERE e.form IS NULL"""

#: The archive's SQL says what each page's record has to hold, whatever went through the files. The trees, rules, centroids,
#: language models, fingerprints by XXH64, tokens and suffixes of the others have none.
ORACLE_SQL: dict[str, str] = {
    "op12_spelling_variants": SPELLING_SQL,
    "op13_merkle": MERKLE_SQL,
    "op4_warc": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d),
r AS (SELECT *, payload_bytes >= {warc.LEAST_BYTES} AND page_id > first_id AS again FROM f)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first_id END AS refers_to FROM r""",
}
