"""Judgements of rows against rules that come as parameters: selection, scores, causes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quality, scores, text
from . import extraction, retrieval

#: Patterns of a section on money, the most telling first (all words of an entry have to occur).
BUDGET_ORDER = [["synthèse budgétaire"], ["budget consommé", "budget engagé"], ["reste disponible"], ["montant ht"]]
BUDGET_ANY = ["budget", "montant ht", "reste disponible", "synthèse budgétaire", "suivi financier"]
#: By topic, parts of words that a sentence on it has.
TOPICS = {
    "business_problem": ["objectif", "besoin", "portail", "modernis", "interoper", "dossier", "patient", "client", "kpi", "attrition", "continuite", "reprise", "consolider", "gouvernance"],
    "project_type": ["portail", "migration", "plateforme", "cloud", "api", "integration", "cyber", "segmentation", "siem", "gouvernance", "socle"],
    "technologies_and_constraints": ["api", "java", "spring", "postgres", "databricks", "siem", "reseau", "mfa", "base"],
    "security_and_compliance": ["hds", "secur", "conform", "identite", "rgpd", "authent", "nis2", "journal", "astreinte"],
    "expected_deliverables": ["livrable", "portail", "rapport", "formation", "deploiement", "recette", "plan", "feuille"],
    "scale": ["utilisateur", "volume", "regional", "patient", "site", "base"],
    "timeline_and_urgency": ["echeance", "urgent", "deadline", "jalon", "delai", "lundi", "fin d'annee", "fin d’annee"],
}
#: What a sentence is better for, and what it is not to hold.
IDENTITY_MARK, IDENTITY_NOT = "objet du document", ["contact", "note de test", "@"]


def _words_in(value: Column, words: Column) -> Column:
    """All of the words stand in the folded value as whole words."""
    return F.forall(words, lambda w: F.regexp_like(value, F.concat(F.lit("(?<![a-z0-9])"), w, F.lit("(?![a-z0-9])"))))


def names_project(query: Column, document_name: Column, mission_title: Column, content: Column) -> Column:
    """Whether a row is of the project that a query names: the project's key, what stands before the first dash, is a
    whole word of the file's name; or all its terms of four characters are; or all title terms are words of the row."""
    title, terms = extraction.project_title(query), extraction.project_terms(query)
    name = text.fold(F.coalesce(document_name, F.lit("")))
    key = text.fold(F.trim(F.split(F.split(F.coalesce(title, F.lit("")), "—")[0], "-")[0]))
    quoted = F.regexp_replace(key, r"([^a-z0-9\s])", r"\\$1")
    long_terms = F.regexp_extract_all(key, F.lit("[a-z0-9]{4,}"), F.lit(0))
    everywhere = text.fold(F.concat_ws(" ", document_name, mission_title, content))
    fits = ((key != "") & _words_in(name, F.array(quoted))) | ((F.size(long_terms) > 0) & _words_in(name, long_terms)) | _words_in(everywhere, terms)
    return F.coalesce(title.isNotNull() & (F.size(terms) > 0) & fits, F.lit(False))


def all_terms(rows: DataFrame, name: str, terms: list[str], *order: str, limit: int = 20) -> DataFrame:
    """The first rows whose name has all of the terms; none without terms."""
    if not terms:
        return rows.limit(0)
    return rows.where(quality.contains_all(F.lower(name), [t.lower() for t in terms])).orderBy(*order).limit(limit)


def section_backfill(chunks: DataFrame, any_of: list[str], priorities: list[list[str]], limit: int = 12) -> DataFrame:
    """Per document the chunks (document_id, page, chunk_id, content) that hold any pattern, by the first entry of
    ``priorities`` whose patterns all occur, then by page and id: with their place, up to the limit."""
    low = F.lower("content")
    first = reduce(lambda c, ip: c.when(quality.contains_all(low, ip[1]), F.lit(ip[0])), list(enumerate(priorities))[1:], F.when(quality.contains_all(low, priorities[0]), F.lit(0)))
    rows = chunks.where(quality.contains_any(low, any_of)).withColumn("priority", first.otherwise(len(priorities)))
    at = Window.partitionBy("document_id").orderBy("priority", "page", "chunk_id")
    return rows.withColumn("place", F.row_number().over(at).cast("bigint")).where(F.col("place") <= limit)


def intent_pages(queries: DataFrame, chunks: DataFrame, rules: list[tuple[list[str], list[int]]], least: int = 8, per_page: int = 4) -> DataFrame:
    """Chunks of each query's document on the pages of the first rule whose phrases the query has one of, in order of
    page and id, up to max(least, per_page * pages). queries: query_id, query, document_id. A document's list for a rule is
    cut before queries meet it, at the most that any rule gives: queries of one id share their places."""
    limits = [max(least, per_page * len(pages)) for _, pages in rules]
    folded = text.fold(F.col("query"))
    rule = reduce(lambda c, ir: c.when(quality.contains_any(folded, ir[1][0]), F.lit(ir[0])), list(enumerate(rules))[1:], F.when(quality.contains_any(folded, rules[0][0]), F.lit(0)))
    asked = queries.select("query_id", "document_id", rule.alias("rule")).where("rule is not null").withColumn("most", F.array(*map(F.lit, limits))[F.col("rule")])
    on = F.array(*[F.when(F.col("page") == page, F.lit(i)) for i, (_, pages) in enumerate(rules) for page in pages]).cast("array<int>")
    wanted = chunks.where(F.col("page").isin(sorted({page for _, pages in rules for page in pages})))
    listed = wanted.select("document_id", "chunk_id", "page", F.explode(F.array_compact(on)).alias("rule"))
    # dealt out by another key than the join's: both its sides are dealt anew, and Spark can split a document that many ask for
    at = Window.partitionBy(F.struct("document_id", "rule")).orderBy("page", "chunk_id")
    listed = listed.withColumn("place", F.row_number().over(at)).where(F.col("place") <= max(limits)).drop("place")
    rows = asked.join(listed, ["document_id", "rule"])
    at = Window.partitionBy("query_id").orderBy("page", "chunk_id")
    rows = rows.withColumn("place", F.row_number().over(at)).where((F.col("place") <= max(limits)) & (F.col("place") <= F.col("most")))
    return rows.select("query_id", "chunk_id", "page", F.col("place").cast("bigint").alias("place"))


def specificity(asked: Column, content: Column, text_score: Column, similarity: Column) -> Column:
    """What chunks are put in order by, the largest first: keywords found, text score, similarity, shortness."""
    folded = text.fold(content)
    hits = F.size(F.filter(asked, lambda w: F.contains(folded, w))).cast("bigint")
    return F.struct(hits.alias("keyword_hits"), F.coalesce(text_score, F.lit(0.0)).alias("text_score"), F.coalesce(similarity, F.lit(0.0)).alias("similarity"), (-F.length(content)).cast("bigint").alias("shortness"))


def topic_sentences(value: Column, topics: dict[str, list[str]]) -> Column:
    """A struct with the sentences of each topic; one may belong to several."""
    parts = text.sentences(value)
    on = lambda words: F.filter(parts, lambda s: quality.contains_any(text.fold(s), words))
    return F.struct(*[on(words).alias(name) for name, words in topics.items()])


def grounded(answer: Column, n_citations: Column, should_abstain: Column, insufficient: str) -> Column:
    """An answer that should abstain is the given text without citations; any other has some and is not that text."""
    return F.when(should_abstain, (answer == insufficient) & (n_citations == 0)).otherwise((answer != insufficient) & (n_citations > 0))


def cards_match(answer: Column, cards: Column) -> Column:
    """The marks of an answer are the cards', each card once, and there is one at least."""
    marks = F.sort_array(text.citation_indexes(answer))
    return (F.size(cards) > 0) & F.equal_null(marks, F.sort_array(cards))


def confidence(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Per answer (query_id, answer) the mean similarity of the sources that it cites, from 0 to 1; 0 if it cites none,
    or one that is not there. sources: query_id, source_index, vector_score, relevance_score."""
    cited = answers.select("query_id", F.explode(text.citation_indexes(F.col("answer"))).alias("source_index"))
    known = sources.select("query_id", F.col("source_index").cast("int").alias("source_index"), scores.source_similarity(F.col("vector_score"), F.col("relevance_score")).alias("s"))
    found = cited.join(known, ["query_id", "source_index"], "left").groupBy("query_id").agg(F.when(F.bool_or(F.col("s").isNull()), F.lit(0.0)).otherwise(F.avg("s")).alias("mean"))
    return answers.select("query_id").join(found, "query_id", "left").select("query_id", F.round(scores.bounded(F.col("mean")), 6).alias("confidence"))


def draft_scores(warnings: DataFrame, key: str) -> DataFrame:
    """Per draft 1, less 0.5 and 0.1 a hard warning where there is one, not below 0, then less 0.05 a soft one, not
    below 0. warnings: the key and warning, null for a draft without any."""
    hard = F.coalesce(quality.is_hard(F.col("warning")), F.lit(False))
    counts = warnings.groupBy(key).agg(F.count_if(hard).alias("hard"), F.count_if(~hard & F.col("warning").isNotNull()).alias("soft"))
    cut = F.when(F.col("hard") > 0, F.greatest(F.lit(0.0), F.lit(0.5) - 0.1 * F.col("hard"))).otherwise(F.lit(1.0))
    return counts.select(key, "hard", "soft", F.round(F.greatest(F.lit(0.0), cut - 0.05 * F.col("soft")), 2).alias("score"), (F.col("hard") == 0).alias("passed"))


def stability(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Per case and runner (keys) how many runs, the share that succeeded, and the distinct answers. runs: success, answer."""
    given = F.sort_array(F.collect_set("answer"))
    return runs.groupBy(*keys).agg(F.count("*").alias("runs"), F.round(F.avg(F.col("success").cast("int")), 6).alias("success_rate"), F.size(given).cast("bigint").alias("distinct_answers"), F.array_join(given, ",").alias("answers"))


def brief_score(row: DataFrame, sections: int = 19) -> Column:
    """0 to 100 for a brief: 40 for covered needs, 30 for its sections, 30 for citations, 50 less for evidence where
    none exists; a brief to be refused has all or nothing. Columns: status, to_refuse, coverage, n_sections,
    expects_evidence, n_sources, n_matching, evidence_passed, diagnostic."""
    c = row
    covered = F.round(c["coverage"] * 40, 1)
    complete = F.when(c["n_sections"] == sections, 30.0).otherwise(F.round(c["n_sections"] / F.lit(float(sections)) * 30, 1))
    matched = (c["n_matching"] > 0) & c["evidence_passed"] & c["diagnostic"].isNull()
    with_evidence = F.when(matched, 30).when(c["n_sources"] > 0, 15).otherwise(0)
    abstained = (c["n_sources"] == 0) & ~c["evidence_passed"] & F.equal_null(c["diagnostic"], F.lit("NO_RELEVANT_PDF_EVIDENCE"))
    points = covered + complete + F.when(c["expects_evidence"], with_evidence).otherwise(F.when(abstained, 30).otherwise(-50))
    full = F.greatest(F.lit(0), F.least(F.lit(100), F.floor(points + F.lit(1e-9)).cast("int")))
    return F.when(c["to_refuse"], F.when(c["status"].isin(400, 422), 100).otherwise(0)).when(c["status"] == 200, full).otherwise(0)


def failure_cause(row: DataFrame) -> Column:
    """Why an answer is not complete, the earliest cause of those that hold. Columns: request_error (null if none),
    protocol_ok, provenance_ok (null if not judged), citation_correct, answer_correct."""
    return (
        F.when(row["request_error"].isNotNull(), "request").when(~row["protocol_ok"], "protocol").when(row["provenance_ok"] == F.lit(False), "provenance")
        .when(~row["citation_correct"], "citation").when(~row["answer_correct"], "answer").otherwise("style")
    )


def golden_accuracy(results: DataFrame) -> DataFrame:
    """One row of rates with four decimals, null where there is no case. results: should_abstain, answer_correct,
    citation_correct, grounded_correct."""
    rate = lambda c: F.round(F.avg(c.cast("int")), 4)
    right = F.col("answer_correct")
    return results.agg(
        F.count("*").alias("cases"), rate(right).alias("answer_accuracy"), rate(F.col("citation_correct")).alias("citation_accuracy"), rate(F.col("grounded_correct")).alias("grounded_accuracy"),
        rate(F.when(~F.col("should_abstain"), right)).alias("positive_answer_accuracy"), rate(F.when(F.col("should_abstain"), right)).alias("abstention_accuracy"),
    )


def identity_sentence(identities: DataFrame, chunks: DataFrame, mark: str = IDENTITY_MARK, unwanted: list[str] = IDENTITY_NOT, least: int = 6) -> DataFrame:
    """For each identity chunk (query_id, chunk_id, document_id, anchor) the best sentence of another chunk of its document
    that has the anchor, in a chunk that has it as a whole word: ten points for the mark, twenty less for what is unwanted;
    of equals the first by chunk and place. chunks: chunk_id, document_id, content."""
    own = identities.select("query_id", F.col("chunk_id").alias("own_chunk"), "document_id", text.fold(F.trim("anchor")).alias("anchor")).where("anchor <> ''")
    quoted = F.regexp_replace("anchor", r"([^a-z0-9\s])", r"\\$1")
    # A document's chunks meet its anchors by their words, without the contents, which only those that meet are joined to;
    # there are many words a chunk, so neither side is to be broadcast by what the files are estimated at.
    words = lambda c: F.regexp_extract_all(c, F.lit("[a-z0-9]+"), F.lit(0))
    there = chunks.select("document_id", "chunk_id", F.explode(F.array_distinct(words(text.fold(F.col("content"))))).alias("word"))
    asked = own.select("document_id", "anchor", F.get(words(F.col("anchor")), F.lit(0)).alias("word")).distinct()
    met = asked.hint("merge").join(there, ["document_id", "word"]).select("document_id", "chunk_id", "anchor").distinct()
    rows = met.hint("merge").join(chunks.select("document_id", "chunk_id", "content"), ["document_id", "chunk_id"])
    rows = rows.where(_words_in(text.fold(F.col("content")), F.array(quoted)))
    parts = rows.select("document_id", "chunk_id", "anchor", F.posexplode(F.split("content", r"(?<=[.!?])\s+|\n+")).alias("pos", "sentence")).withColumn("folded", text.fold(F.col("sentence")))
    parts = parts.where(F.contains("folded", F.col("anchor")) & (text.word_count(F.col("sentence")) >= least))
    score = F.when(F.contains("folded", F.lit(mark)), 10).otherwise(0) - F.when(quality.contains_any(F.col("folded"), unwanted), 20).otherwise(0)
    scored = parts.select("document_id", "chunk_id", "anchor", "pos", "sentence", score.alias("score"))
    # The best chunk of an anchor, and the next best for the identity that is that chunk itself.
    heads = retrieval.keep_first(scored, ["document_id", "anchor", "chunk_id"], [F.desc("score"), "pos"])
    at = Window.partitionBy("document_id", "anchor").orderBy(F.desc("score"), "chunk_id")
    heads = heads.withColumn("_n", F.row_number().over(at)).where("_n <= 2").drop("_n")
    both = own.join(heads, ["document_id", "anchor"]).where(F.col("chunk_id") != F.col("own_chunk"))
    best = retrieval.keep_first(both, ["query_id", "own_chunk"], [F.desc("score"), "chunk_id", "pos"])
    return best.select("query_id", F.col("own_chunk"), "chunk_id", F.trim("sentence").alias("sentence"), F.col("score").cast("bigint").alias("score"))


def best_per_role(sentences: DataFrame, roles: dict[str, list[str]], most: int = 4) -> DataFrame:
    """Of each query's sentences (query_id, sentence, score, place) the best of each role, a sentence once, if two roles
    have one; else the best ``most``."""
    left, chosen = sentences, None
    for name, marks in roles.items():
        fits = left.where(quality.contains_any(text.fold(F.col("sentence")), marks))
        own = retrieval.keep_first(fits, ["query_id"], [F.desc("score"), "place"]).withColumn("role", F.lit(name))
        chosen = own if chosen is None else chosen.unionByName(own)
        left = left.join(own.select("query_id", "sentence"), ["query_id", "sentence"], "left_anti")
    both = Window.partitionBy("query_id")
    chosen = chosen.withColumn("_n", F.count("*").over(both)).where("_n >= 2").drop("_n")
    rest = sentences.join(chosen.select("query_id").distinct(), "query_id", "left_anti")
    rest = rest.withColumn("_r", F.row_number().over(both.orderBy(F.desc("score"), "place"))).where(F.col("_r") <= most).drop("_r")
    return chosen.unionByName(rest.withColumn("role", F.lit(None).cast("string"))).select("query_id", "role", "sentence", "score", "place")


def mission_violations(missions: DataFrame, sectors: list[str], types: list[str], forbidden: list[str]) -> DataFrame:
    """Missions with ``violations``, an array of what is wrong with each; those with any belong in quarantine. Columns:
    id, title, sector, mission_type, technologies (array), synthetic, documents (array of structs with kind and content)."""
    required = [c for c in ("id", "title", "sector", "mission_type", "technologies", "synthetic", "documents")]
    n = F.coalesce(F.size("documents"), F.lit(0))
    written = F.lower(F.to_json(F.struct(*missions.columns)))
    checks = [F.when(F.col(c).isNull(), f"missing {c}") for c in required]
    checks += [
        F.when(~F.col("sector").isin(sectors), "unknown sector"), F.when(~F.col("mission_type").isin(types), "unknown type"), F.when(~F.col("synthetic"), "not synthetic"), F.when(~n.between(2, 4), "needs 2 to 4 documents"),
        F.when((F.size("technologies") == 0) | F.exists("technologies", lambda x: x.isNull()), "invalid technologies"), F.when(quality.contains_any(written, [w.lower() for w in forbidden]), "forbidden name"),
        F.when(F.exists("documents", lambda d: F.coalesce(F.trim(d["content"]), F.lit("")) == ""), "empty document"),
    ]
    return missions.withColumn("violations", F.array_compact(F.array(*checks)))
