"""Scalar functions over whole texts, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import quality, scores, text
from ..registry import query

FOLD = f"lower(translate(text, '{text.ACCENTED}', '{text.PLAIN}'))"
STOP = "[" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "]"
#: DuckDB's list_distinct keeps no order: positions of first appearance do.
DISTINCT = "list_transform(list_filter(list_zip({0}, range(1, len({0}) + 1)), lambda x: list_position({0}, x[1]) = x[2]), lambda x: x[1])"


@query("x1_fold", f"SELECT doc_id, {FOLD} AS folded FROM documents")
def x1(t):
    return t.documents.select("doc_id", text.fold(F.col("text")).alias("folded"))


@query("x3_reference_code", r"SELECT page_id, nullif(upper(replace(regexp_extract(html, '[A-Za-z]{2,5} ?- ?[0-9]{1,6}', 0), ' ', '')), '') AS code FROM pages")
def x3(t):
    return t.pages.select("page_id", text.reference_code(F.col("html")).alias("code"))


@query("x7_terms", f"WITH k AS (SELECT doc_id, list_filter(regexp_extract_all({FOLD}, '[a-z0-9]{{3,}}'), lambda x: NOT list_contains({STOP}, x)) AS ts FROM documents) SELECT doc_id, array_to_string({DISTINCT.format('ts')}, ' ') AS terms FROM k")
def x7(t):
    return t.documents.select("doc_id", F.array_join(text.terms(F.col("text")), " ").alias("terms"))


@query("x9_lexical_rank", f"SELECT doc_id, round(0.1::DOUBLE * len(list_filter(regexp_extract_all({FOLD}, '[a-z0-9]{{3,}}'), lambda x: list_contains(['tion', 'able', 'ent', 'que', 'thea', 'ung'], x))), 6) AS rank FROM documents")
def x9(t):
    wanted = F.array(*[F.lit(w) for w in ("tion", "able", "ent", "que", "thea", "ung")])
    found = F.filter(F.regexp_extract_all(text.fold(F.col("text")), F.lit("[a-z0-9]{3,}"), F.lit(0)), lambda x: F.array_contains(wanted, x))
    return t.documents.select("doc_id", F.round(F.lit(0.1) * F.size(found), 6).alias("rank"))


@query("x10_cosine", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def x10(t):
    other = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return t.embeddings.join(other, "vec_id").select("vec_id", F.round(scores.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@query("x11_rrf_term", "SELECT o_orderkey, round(2.0::DOUBLE / (60 + o_orderkey), 9) AS term FROM orders")
def x11(t):
    return t.orders.select("o_orderkey", F.round(scores.rrf(F.col("o_orderkey"), 2.0), 9).alias("term"))


@query("x12_bounded_relevance", "SELECT c_custkey, coalesce(least(greatest(c_acctbal / 5000, 0), 1), 0) AS relevance, coalesce(least(greatest(coalesce(CASE WHEN c_nationkey > 12 THEN c_acctbal / 9000 END, c_acctbal / 5000, 0), 0), 1), 0) AS similarity FROM customer")
def x12(t):
    vector, relevance = F.when(F.col("c_nationkey") > 12, F.col("c_acctbal") / 9000), F.col("c_acctbal") / 5000
    return t.customer.select("c_custkey", scores.bounded(relevance).alias("relevance"), scores.source_similarity(vector, relevance).alias("similarity"))


@query("x14_mission_blend", "SELECT p_partkey, round(0.85::DOUBLE * greatest(0.0, (p_size - 10) / 50.0::DOUBLE) + 0.15::DOUBLE * coalesce(p_retailprice / 2000, 0), 9) AS score, round((p_size / 50.0::DOUBLE) + 0.02::DOUBLE * p_retailprice, 9) AS reranked FROM part")
def x14(t):
    return t.part.select("p_partkey", F.round(scores.mission_score((F.col("p_size") - 10) / F.lit(50.0), F.col("p_retailprice") / 2000), 9).alias("score"), F.round(F.col("p_size") / F.lit(50.0) + F.lit(0.02) * F.col("p_retailprice"), 9).alias("reranked"))


CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"


@query("x16_cleaned", f"SELECT page_id, {CLEAN.format('html')} AS cleaned FROM pages")
def x16(t):
    return t.pages.select("page_id", text.cleaned(F.col("html")).alias("cleaned"))


@query("x19_token_budget", "SELECT doc_id, greatest(1, floor(length(text) / 3.2::DOUBLE))::BIGINT AS budget FROM documents")
def x19(t):
    return t.documents.select("doc_id", text.token_budget(F.length("text")).alias("budget"))


@query("x25_sentences", r"SELECT doc_id, len(list_filter(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> ''))::BIGINT AS n, string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))[1] AS first FROM documents")
def x25(t):
    s = text.sentences(F.col("text"))
    return t.documents.select("doc_id", F.size(s).cast("bigint").alias("n"), F.get(s, F.lit(0)).alias("first"))


FACTS = "[0-9]+(?:[.,][0-9]+)? ?(?:%|eur|euros|ms|jours|mois|heures|minutes)?"


@query("x26_numeric_facts", f"WITH k AS (SELECT doc_id, list_transform(regexp_extract_all(lower(text), '{FACTS}'), lambda x: replace(trim(x), ' ', '')) AS f FROM documents) SELECT doc_id, array_to_string({DISTINCT.format('f')}, ' ') AS facts FROM k")
def x26(t):
    return t.documents.select("doc_id", F.array_join(text.numeric_facts(F.col("text")), " ").alias("facts"))


@query("x27_factual_values", r"SELECT doc_id, len(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)? ?%')) + len(regexp_extract_all(text, '[0-9]{1,4}[/.-][0-9]{1,2}[/.-][0-9]{2,4}')) + len(regexp_extract_all(text, '[0-9]+ ?(?:EUR|€|K€|M€)')) + len(regexp_extract_all(text, '[A-Z]{2,}')) AS n FROM documents")
def x27(t):
    return t.documents.select("doc_id", quality.factual_values(F.col("text")).alias("n"))


@query("x30_word_count", r"SELECT doc_id, len(regexp_extract_all(text, '[^ \t\n\r]+'))::BIGINT AS n FROM documents")
def x30(t):
    return t.documents.select("doc_id", text.word_count(F.col("text")).cast("bigint").alias("n"))


REPEATED_SQL = r"""w AS (SELECT doc_id, regexp_extract_all(lower(text), '[^ \t\n\r]+') AS w FROM documents), g AS (SELECT doc_id, len(w) AS n, unnest(range(1, len(w) - 6)) AS i, w FROM w WHERE len(w) >= 16),
s AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + 7), ' ') AS g FROM g), d AS (SELECT doc_id, n, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM s),
p AS (SELECT DISTINCT doc_id, n, unnest(range(i, i + 8)) AS pos FROM d WHERE c > 1), r AS (SELECT doc_id, round(count(*)::DOUBLE / n, 6) AS ratio FROM p GROUP BY doc_id, n)"""


@query("x31_repeated_8grams", f"WITH {REPEATED_SQL} SELECT doc_id, coalesce(ratio, 0) AS ratio FROM documents LEFT JOIN r USING (doc_id)")
def x31(t):
    return quality.repeated_gram_ratio(t.documents, "doc_id", 8)


@query("x32_boilerplate", f"SELECT doc_id, len(list_filter(['all rights reserved', 'license', 'copyright', 'ci-dessous', 'dans le cadre de'], lambda p: contains({FOLD}, p)))::BIGINT AS n FROM documents")
def x32(t):
    return t.documents.select("doc_id", quality.boilerplate(F.col("text"), ["all rights reserved", "license", "copyright", "ci-dessous", "dans le cadre de"]).alias("n"))


@query("x33_information_density", r"SELECT doc_id, round(100.0::DOUBLE * len(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)?|[A-Z]{2,}')) / greatest(1, len(regexp_extract_all(text, '[^ \t\n\r]+'))), 6) AS density FROM documents")
def x33(t):
    return t.documents.select("doc_id", F.round(quality.information_density(F.col("text")), 6).alias("density"))


@query("x42_needs", r"WITH s AS (SELECT doc_id, list_slice(list_filter(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: length(x) >= 24), 1, 6) AS n FROM documents) SELECT doc_id, unnest(range(1, len(n) + 1))::BIGINT AS need, unnest(n) AS text FROM s")
def x42(t):
    needs = F.slice(F.filter(text.sentences(F.col("text")), lambda s: F.length(s) >= 24), 1, 6)
    return t.documents.select("doc_id", F.posexplode(needs).alias("p", "need_text")).select("doc_id", (F.col("p") + 1).cast("bigint").alias("need"), F.col("need_text").alias("text"))


@query("x43_quote_range", "SELECT d.doc_id, (CASE WHEN instr(lower(d.text), lower(substr(d.text, 11, 40))) > 0 THEN instr(lower(d.text), lower(substr(d.text, 11, 40))) - 1 END)::BIGINT AS start FROM documents d")
def x43(t):
    at = F.locate
    place = F.expr("locate(lower(substring(text, 11, 40)), lower(text))")
    del at
    return t.documents.select("doc_id", F.when(place > 0, place - 1).cast("bigint").alias("start"))


@query("x49_citations", r"WITH c AS (SELECT page_id, list_transform(regexp_extract_all(html, '\[([0-9]{1,4})\]', 1), lambda x: x::INT) AS c FROM pages) SELECT page_id, array_to_string(" + DISTINCT.format("c") + ", ',') AS cited, len(list_filter(c, lambda x: x < 1 OR x > 10)) > 0 AS invalid FROM c")
def x49(t):
    cited = text.citation_indexes(F.col("html"))
    return t.pages.select("page_id", F.array_join(F.transform(cited, lambda x: x.cast("string")), ",").alias("cited"), F.exists(cited, lambda x: (x < 1) | (x > 10)).alias("invalid"))


@query("x52_plain_text", r"SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '<!--[^>]*-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '" + '"' + r"'), '&nbsp;', ' '), '&amp;', '&'), '[ \t\n\r]+', ' ', 'g')) AS plain FROM pages")
def x52(t):
    return t.pages.select("page_id", quality.plain_text(F.col("html")).alias("plain"))


@query("x57_fragments", "SELECT doc_id, contains(text, 'the') AND contains(text, 'on') AS all_present, contains(text, '###') OR contains(text, '@') AS forbidden FROM documents")
def x57(t):
    return t.documents.select("doc_id", quality.contains_all(F.col("text"), ["the", "on"]).alias("all_present"), quality.contains_any(F.col("text"), ["###", "@"]).alias("forbidden"))


@query("x59_preview", r"WITH f AS (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')) AS f FROM documents) SELECT doc_id, CASE WHEN length(f) > 140 THEN substr(f, 1, 140) || '…' ELSE f END AS preview FROM f")
def x59(t):
    return t.documents.select("doc_id", text.preview(F.col("text")).alias("preview"))


@query("x60_bounded", r"SELECT doc_id, CASE WHEN length(text) <= 600 THEN text ELSE regexp_replace(substr(text, 1, 600), ' [^ ]*$', '') END AS bounded, array_to_string(list_slice(regexp_extract_all(text, '[^ \t\n\r]+'), 1, 100), ' ') AS prefix FROM documents")
def x60(t):
    return t.documents.select("doc_id", text.bounded(F.col("text"), 600).alias("bounded"), text.prefix_words(F.col("text")).alias("prefix"))


@query("x61_embedding_inputs", "SELECT doc_id, CASE WHEN max((n_chars > 5000)::INT) OVER (PARTITION BY source, lang) = 1 THEN text ELSE lang || chr(10) || chr(10) || text END AS input FROM documents")
def x61(t):
    from ..operators import ingest

    rows = t.documents.select("doc_id", "text", F.concat_ws("/", "source", "lang").alias("document"), F.when(F.col("n_chars") <= 5000, F.col("lang")).alias("prefix"))
    return ingest.embedding_inputs(rows, "document", "prefix", "text").select("doc_id", "input")


@query("x62_content_hash", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def x62(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("sha256"))


@query("x63_safe_filename", r"SELECT page_id, right(regexp_extract(url, '([^/\\]*)$', 1), 255) AS name, lower(regexp_extract(url, '\.([A-Za-z0-9]+)$', 1)) AS ext FROM pages")
def x63(t):
    return t.pages.select("page_id", text.safe_filename(F.col("url")).alias("name"), text.extension(F.col("url")).alias("ext"))


@query("x64_slug", f"SELECT conv_id, turn, regexp_replace(regexp_replace({FOLD}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM conversations")
def x64(t):
    return t.conversations.select("conv_id", "turn", text.slug(F.col("text")).alias("slug"))


@query("x66_context_block", "WITH c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, role, text FROM conversations WHERE role <> 'system') SELECT conv_id, string_agg('[' || i || '] ' || role || chr(10) || text, chr(10) || chr(10) ORDER BY i) AS block FROM c GROUP BY 1")
def x66(t):
    rows = t.conversations.where("role <> 'system'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("c"))
    lines = F.transform("c", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["role"], F.lit("\n"), x["text"]))
    return rows.select("conv_id", F.array_join(lines, "\n\n").alias("block"))


@query("x69_role_overlap", f"WITH k AS (SELECT conv_id, turn, list_filter(regexp_extract_all({FOLD}, '[a-z0-9]{{4,}}'), lambda x: NOT list_contains({STOP}, x)) AS ts FROM conversations) SELECT a.conv_id, a.turn, len(list_distinct(list_intersect(a.ts, b.ts)))::BIGINT AS shared FROM k a JOIN k b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def x69(t):
    rows = t.conversations.select("conv_id", "turn", text.terms(F.col("text"), 4).alias("ts"))
    after = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("ts").alias("other"))
    return rows.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.size(F.array_intersect("ts", "other")).cast("bigint").alias("shared"))


@query("x72_strict_json", "SELECT event_id, json_valid(props) AND props LIKE '{%' AND props LIKE '%}' AS ok FROM events")
def x72(t):
    return t.events.select("event_id", quality.strict_json(F.col("props")).alias("ok"))


@query("p18_low_information", r"WITH w AS (SELECT doc_id, s, len(regexp_extract_all(s, '[^ \t\n\r]+')) AS n FROM (SELECT doc_id, unnest(list_filter(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')) AS s FROM documents)) SELECT doc_id, count(*) AS sentences, sum((n < 3 OR regexp_matches(s, '\.{4,}|_{4,}') OR (n <= 7 AND NOT regexp_matches(s, '[0-9.:;!?]')))::INT)::BIGINT AS low FROM w GROUP BY 1")
def p18(t):
    rows = t.documents.select("doc_id", F.explode(text.sentences(F.col("text"))).alias("s"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.count_if(quality.low_information(F.col("s"))).alias("low"))
