"""Requirements of briefs, and the checks of drafted proposals: coverage, claims, warnings, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quality, text
from . import retrieval

#: Kinds of need and the folded words that tell them, the first that fits counts.
CATEGORIES = {
    "security": ["securite", "conformite", "rgpd", "chiffrement"],
    "data": ["donnees", "migration", "qualite des donnees"],
    "integration": ["integration", "interface", "api"],
    "planning": ["delai", "planning", "calendrier", "jalon"],
    "budget": ["budget", "cout", "prix"],
}
#: Sectors and the folded words that tell them, in order of precedence.
SECTORS = {"Banque": ["banque", "bancaire", "credit"], "Assurance": ["assurance", "sinistre"], "Santé": ["sante", "hopital", "patient"], "Industrie": ["industrie", "usine"], "Télécom": ["telecom", "operateur"], "Public": ["ministere", "collectivite", "administration"]}


def first_of(value: Column, rules: dict[str, list[str]], default: str | None) -> Column:
    folded = text.fold(value)
    out = F.lit(default).cast("string")
    for name, words in reversed(list(rules.items())):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(folded, F.lit(w))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def sector(value: Column) -> Column:
    return first_of(value, SECTORS, "Autre")


def requirements(briefs: DataFrame, least: int = 24) -> DataFrame:
    """Sentences of a brief as needs with their exact offsets: brief_id, need, text, start_offset, end_offset, category.

    Each sentence is looked for after the end of the one before, so repeated sentences get places of their own.
    """
    parts = F.filter(F.split("description", r"(?<=[.!?;])\s+|\n+"), lambda s: F.length(F.trim(s)) >= least)
    start = F.struct(F.lit(1).alias("from"), F.array().cast("array<struct<text:string,start:int>>").alias("out"))

    def step(acc: Column, part: Column) -> Column:
        want = F.trim(part)
        at = F.call_function("locate", want, F.col("description"), acc["from"])
        return F.when(at > 0, F.struct((at + F.length(want)).alias("from"), F.concat(acc["out"], F.array(F.struct(want.alias("text"), (at - 1).alias("start")))).alias("out"))).otherwise(acc)

    rows = briefs.select("brief_id", F.posexplode(F.aggregate(parts, start, step, lambda a: a["out"])).alias("need", "x"))
    return rows.select("brief_id", (F.col("need") + 1).alias("need"), "x.text", F.col("x.start").alias("start_offset"), (F.col("x.start") + F.length("x.text")).alias("end_offset"), first_of(F.col("x.text"), CATEGORIES, "functional").alias("category"))


def coverage(needs: DataFrame, sections: DataFrame) -> DataFrame:
    """Per need the sections that cover it: they name it, or share enough of its significant terms. needs: need_id, text;
    sections: section_id, body. Terms meet in an equi-join, so no need is compared with every section."""
    terms = needs.select("need_id", text.terms(F.col("text"), 4).alias("t")).withColumn("enough", F.greatest(F.lit(1), F.least(F.lit(3), F.floor(F.size("t") / 4))))
    have = sections.select("section_id", F.explode(text.terms(F.col("body"), 4)).alias("term"))
    hits = terms.select("need_id", "enough", F.explode("t").alias("term")).join(have, "term").groupBy("need_id", "section_id", "enough").agg(F.count("*").alias("n")).where("n >= enough").select("need_id", "section_id")
    named = sections.select("section_id", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"\b(N-[0-9]+)\b"), F.lit(1)))).alias("need_id")).join(needs.select("need_id"), "need_id", "left_semi").select("need_id", "section_id")
    by = hits.unionByName(named).distinct().groupBy("need_id").agg(F.sort_array(F.collect_set("section_id")).alias("sections"))
    return needs.select("need_id").join(by, "need_id", "left").select("need_id", F.coalesce("sections", F.array().cast(by.schema["sections"].dataType)).alias("sections"), F.col("sections").isNotNull().alias("covered"))


def claim_support(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Claims (claim_id, source_id, text) against sources (source_id, quote): long numbers have to be there, and a third of
    the keywords; unknown sources support nothing."""
    rows = claims.join(sources, "source_id", "left").withColumns({"have": text.terms(F.coalesce("quote", F.lit(""))), "want": text.terms(F.col("text"))})
    long = lambda c: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[0-9]{2,}"), F.lit(0))
    lost = F.array_except(long(F.col("text")), long(F.col("quote")))
    enough = F.size(F.array_intersect("want", "have")) >= F.greatest(F.lit(1), F.floor(F.size("want") / 3))
    return rows.select("claim_id", "source_id", F.col("quote").isNotNull().alias("known_source"), F.array_join(lost, ",").alias("missing_numbers"), (F.col("quote").isNotNull() & (F.size(lost) == 0) & enough).alias("supported"))


def section_warnings(sections: DataFrame, known: DataFrame) -> DataFrame:
    """Warnings per section (section_id, body, evidence_ids): boilerplate, repeated runs, thin content, unknown and missing
    sources. known: evidence_id."""
    phrases = ["il est crucial de", "il est essentiel de", "leader sur son marche", "incontournable", "il va sans dire"]
    ids = sections.select("section_id", F.explode("evidence_ids").alias("evidence_id"))
    unknown = ids.join(known.select("evidence_id"), "evidence_id", "left_anti").groupBy("section_id").agg(F.count("*").alias("n_unknown"))
    ratio = quality.repeated_gram_ratio(sections.select("section_id", F.col("body").alias("text")), "section_id", 8)
    rows = sections.join(unknown, "section_id", "left").join(ratio, "section_id", "left")
    found = F.array_compact(
        F.array(
            F.when(F.coalesce("n_unknown", F.lit(0)) > 0, F.concat(F.lit("unknown source: "), F.col("n_unknown").cast("string"))),
            F.when(F.size("evidence_ids") == 0, "uncited section"),
            F.when(quality.boilerplate(F.col("body"), phrases) > 0, "boilerplate"),
            F.when(F.col("ratio") > 0.05, "repeated text"),
            F.when(quality.information_density(F.col("body")) < 1, "thin content"),
        )
    )
    return rows.select("section_id", found.alias("warnings"), F.size(F.filter(found, quality.is_hard)).alias("hard"), F.size(F.filter(found, lambda w: ~quality.is_hard(w))).alias("soft"))


def draft_score(warnings: DataFrame, failed: Column | None = None) -> DataFrame:
    """1 less 0.5 if a check failed outright, 0.1 a hard and 0.05 a soft warning, 0 at least."""
    hard, soft = F.sum("hard"), F.sum("soft")
    stop = F.when(hard > 0, 0.5).otherwise(0.0) if failed is None else F.when(failed, 0.5).otherwise(0.0)
    return warnings.agg(F.round(F.greatest(F.lit(0.0), 1.0 - stop - 0.1 * hard - 0.05 * soft), 6).alias("score"), hard.alias("hard"), soft.alias("soft"))


def evidence_packets(needs: DataFrame, packets: DataFrame, per_need: int = 2, most: int = 12) -> DataFrame:
    """Packets to generate from, those of needs first and the rest after, with so many pieces of evidence each.
    needs: need_id, priority; packets: packet_id, need_id, evidence_id, rank."""
    own = Window.partitionBy("packet_id").orderBy("rank", "evidence_id")
    rows = packets.withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= per_need).drop("_n")
    rows = rows.join(needs.select("need_id", "priority"), "need_id", "left")
    heads = rows.groupBy("packet_id").agg(F.min(F.coalesce("priority", F.lit(1 << 30))).alias("p")).orderBy("p", "packet_id").limit(most)
    return rows.join(F.broadcast(heads), "packet_id").drop("p")


def anonymised(packets: DataFrame, most: int = 900) -> DataFrame:
    """Reference excerpts without dates, amounts and names: pieces of 24 characters and more, two at most."""
    unsafe = r"[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]+ ?(?:€|EUR|K€|M€)|(?:client|société) [A-Z]"
    pieces = F.filter(F.split("excerpt", r"(?<=[.!?])\s+|\n+"), lambda s: (F.length(s) >= 24) & ~s.rlike(unsafe))
    joined = F.substring(F.array_join(F.slice(pieces, 1, 2), " "), 1, most)
    return packets.withColumn("excerpt", joined).withColumn("status", F.when(joined == "", "EMPTY").otherwise("READY"))


def hydrated(markers: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Citation markers with their canonical evidence, whatever their case, and those that name none."""
    e = evidence.withColumn("_k", F.lower("evidence_id"))
    m = markers.withColumn("_k", F.lower("marker"))
    return m.join(e, "_k").drop("_k"), m.join(e.select("_k"), "_k", "left_anti").drop("_k")


def requirement_evidence(needs: DataFrame, rows: DataFrame, per_need: int = 3, most: int = 36) -> DataFrame:
    """Evidence ids by first appearance over ordered needs, one per chunk, so many per need and in all. needs: need_id,
    place; rows: need_id, chunk_id, rank."""
    r = retrieval.keep_first(rows.join(needs, "need_id").withColumn("_o", F.struct("place", "rank")), ["chunk_id"], ["_o"])
    own = Window.partitionBy("need_id").orderBy("rank")
    r = r.withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= per_need)
    r = r.orderBy("place", "rank").limit(most)
    n = F.row_number().over(Window.orderBy("place", "rank"))  # ``most`` rows
    return r.select("need_id", "chunk_id", F.concat(F.lit("pdf-"), F.lpad(n.cast("string"), 3, "0")).alias("evidence_id"))


def structure_violations(sections: DataFrame, expected: list[str]) -> DataFrame:
    """Whether a proposal (proposal_id, position, title, rows) has the sections in order, and tables with equal rows."""
    titles = F.transform(F.array_sort(F.collect_list(F.struct("position", "title"))), lambda x: x["title"])
    even = F.bool_and(F.coalesce(F.forall("rows", lambda r: F.size(r) == F.size(F.col("rows")[0])), F.lit(True)))
    by = sections.groupBy("proposal_id").agg(titles.alias("titles"), even.alias("even"))
    return by.select("proposal_id", (F.col("titles") == F.array(*[F.lit(t) for t in expected])).alias("in_order"), F.col("even").alias("rectangular"))


def composite_score(sections: Column, evidence: Column, governed: Column) -> Column:
    """A share of 100 points for provenance, delivery, governance, sources and a fixed part; without any evidence it is
    capped at 0.70."""
    raw = F.least(F.lit(25.0), F.lit(15.0) + 2.5 * evidence)
    raw = raw + F.when(sections == 19, 13.0).otherwise(F.round(F.least(sections, F.lit(19)) / F.lit(19.0) * 15, 1))
    raw = raw + F.when(governed, 10.0).otherwise(7.0) + F.least(F.lit(5.0), 1.5 * evidence) + 32.0
    raw = F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw / 100))
    return F.when(evidence == 0, F.least(raw, F.lit(0.70))).otherwise(raw)


#: How many items of each kind a section may keep.
BUDGET = {"bullets": 3, "assumptions": 2, "questions": 3, "evidence": 4}


def within_budget(sections: DataFrame, words: int) -> DataFrame:
    """Sections (body and the arrays of BUDGET) cut to their limits, and the body to whole sentences of so many words in
    all; sentences without a citation are the first to go."""
    s = F.transform(text.sentences(F.col("body")), lambda x, i: F.struct((~x.rlike(r"\[[^\]]+\]")).cast("int").alias("uncited"), i.alias("i"), x.alias("s"), text.word_count(x).alias("n")))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<struct<i:int,s:string>>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["n"] <= words
        return F.when(fits, F.struct((acc["used"] + x["n"]).alias("used"), F.concat(acc["kept"], F.array(F.struct(x["i"].alias("i"), x["s"].alias("s")))).alias("kept"))).otherwise(acc)

    body = F.aggregate(F.array_sort(s), start, step, lambda a: F.array_join(F.transform(F.array_sort(a["kept"]), lambda k: k["s"]), " "))
    return sections.withColumns({"body": body, **{k: F.slice(k, 1, n) for k, n in BUDGET.items() if k in sections.columns}})


def leaked_values(sections: DataFrame, briefs: DataFrame) -> DataFrame:
    """Numbers of a section (section_id, body, reference) that its reference has and the brief has not, in sentences that
    do not frame them as a reference: section_id and value. briefs: one row, brief."""
    values = sections.select("section_id", "reference", F.explode(text.sentences(F.col("body"))).alias("s")).where(~text.fold(F.col("s")).rlike("reference|exemple|projet similaire|a titre indicatif"))
    values = values.select("section_id", "reference", F.explode(F.array_distinct(F.regexp_extract_all("s", F.lit(r"[0-9]+(?:[.,][0-9]+)?"), F.lit(0)))).alias("value"))
    known = briefs.select(F.explode(F.array_distinct(F.regexp_extract_all("brief", F.lit(r"[0-9]+(?:[.,][0-9]+)?"), F.lit(0)))).alias("value"))
    return values.where(F.contains("reference", F.col("value"))).join(known, "value", "left_anti").select("section_id", "value").distinct()
