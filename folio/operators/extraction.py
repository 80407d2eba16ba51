"""Answers without a model: intents, keywords, context choice, labelled rows and extractive sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import retrieval

#: Fixed values, the first that fits counts: intent, groups of folded phrases of which one each has to occur, phrases of
#: which none may.
INTENTS: list[tuple[str, list[list[str]], list[str]]] = [
    ("identity", [["fiche"], ["identite"]], []),
    ("identity", [["identite complete", "fiche complete"]], []),
    ("scope", [["perimetre exclu", "hors perimetre", "ce qui etait exclu", "ce qui est exclu", "non inclus"]], []),
    ("budget", [["budget"]], []),
    ("team", [["quelle equipe", "composition de l'equipe", "equipe projet"]], []),
    ("identity", [["secteur"], ["type de mission"]], []),
    ("objectives", [["objectifs metier", "objectifs techniques", "indicateurs contractuels"]], []),
    ("person", [["qui ", "qui a", "quelle personne", "quel responsable", "pris en charge", "en charge"]], []),
    ("summary", [["probleme initial", "problematique", "resume executif"], ["solution"], ["resultat", "impact"]], []),
    ("context", [["contexte", "probleme metier", "situation de depart", "probleme initial"]], []),
    ("technologies", [["technolog", "architecture", "stack", "choix technique", "securite et conformite", "mesures de securite"]], []),
    ("time", [["quand", "date", "periode"]], []),
    ("location", [["lieu", "site", "localisation", "region", "ville", "pays"]], []),
    ("metrics", [["resultat mesurable", "resultats mesur", "situation initiale", "indicateur", "volume", "mesure traitee", "mesures traitees", "compteur", "latence"]], []),
    ("difficulty", [["difficulte", "obstacle", "risque rencontre", "fusionner par erreur", "meme nom", "homonyme"]], []),
    ("migration_strategy", [["migration"], ["strategie", "retenue", "choix", "arbitrage"]], []),
    ("solution", [["solution", "approche", "mise en oeuvre"]], []),
    ("context", [["probleme principal", "motive"]], []),
]
#: Folded phrases that a chunk or sentence for an intent is likely to hold.
CUES = {
    "person": ["nom", "role", "equipe", "responsable", "charge"],
    "time": ["date", "periode", "janv", "fevr", "mars", "avril", "mai", "juin", "juil", "aout", "sept", "oct", "nov", "dec"],
    "location": ["site", "lieu", "region", "pays", "ville"],
    "summary": ["resume executif", "probleme", "solution", "resultat", "a la cloture"],
    "objectives": ["objectifs", "indicateurs contractuels", "cible", "technique", "metier"],
    "technologies": ["architecture", "technolog", "plateforme", "integration", "securite", "donnees", "choix technique"],
    "identity": ["client", "secteur", "type de mission", "periode", "budget", "equipe", "reference", "statut"],
    "team": ["equipe", "composition", "nom", "role", "responsable", "charge"],
    "budget": ["budget", "montant ht", "rubrique", "part", "consomme"],
    "scope": ["perimetre", "exclu", "inclus", "sanctions", "marches"],
    "metrics": ["resultat", "mesurable", "a la cloture", "%"],
    "difficulty": ["difficulte"],
    "solution": ["solution", "approche", "mise en oeuvre"],
    "context": ["contexte", "problematique", "incident", "situation de depart"],
}
#: Words of a question that say nothing about its subject.
QUESTION_WORDS = "qui que quoi dans le la les de des du un une et en a au aux pour sur par avec quel quelle quelles quels est il elle pris charge partie projet programme".split()
#: Labels of a team row, whose charge and period may share one, and of a budget row. A row's last value
#: ends with its line, or where the next row or a heading follows on the same line.
TEAM_LABELS = [r"Nom:", r";\s*Rôle:", r";\s*Entité:", r";\s*Charge(?:\s*/\s*Période)?:", r"(?:;\s*Période:|[·;])"]
BUDGET_LABELS = [r"Poste:", r";\s*Responsable\s*/\s*équipe:", r";\s*Jours:", r";\s*TJM moyen:", r";\s*Montant HT:"]


def row_pattern(labels: list[str]) -> str:
    """Labels, each with a value behind it that holds no separator."""
    value = r"\s*([^;·\n]*)"
    end = rf"\s*([^;\n]+?)(?=\s+{labels[0]}|\s+##|\s*[;\n]|\s*$)"
    return "(?i)" + "".join(x + value for x in labels[:-1]) + labels[-1] + end


TEAM, BUDGET = row_pattern(TEAM_LABELS), row_pattern(BUDGET_LABELS)
#: What ends a project's name in a question.
_ENDS = r"(?:,|\s+[?.!]|\s+(?:qui|que|quel|quelle|quels|quelles|comment|pourquoi|combien|où|quand|est|a|a-t-il|a-t-elle|ont|faut-il|peut-on|doit-on|devait|pouvait)\b)"


def _any(folded: Column, phrases: list[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(folded, F.lit(p))
    return out


def intent(query: Column) -> Column:
    """The first rule of INTENTS whose groups all occur; null if none does."""
    folded = text.fold(query)
    out = F.lit(None).cast("string")
    for name, groups, never in reversed(INTENTS):
        fits = ~_any(folded, never)
        for g in groups:
            fits = fits & _any(folded, g)
        out = F.when(fits, F.lit(name)).otherwise(out)
    return out


def project_title(query: Column) -> Column:
    """The project that a question names: in quotes, after one of four phrases, or its reference code."""
    quoted = F.trim(F.regexp_extract(query, r"[«\"]([^»\"]+)[»\"]", 1))
    out = F.when(quoted != "", quoted)
    rest = []
    for lead in (r"dans\s+le\s+projet", r"(?:du|de|au\s+sein\s+du|sur\s+le|concernant\s+le)\s+projet", r"le\s+projet", r"(?:pour|sur|avec|concernant)"):
        name = F.trim(F.regexp_replace(F.regexp_extract(query, rf"(?i)\b{lead}\s+(.+?)(?:{_ENDS}|$)", 1), r"[ ,?.!]+$", ""))
        rest.append(F.when(name.rlike(r"[\p{Lu}0-9]") & ~F.lower(name).isin("projet", "mission", "programme"), name))
    code = F.regexp_extract(query, r"(?i)\b([A-Z]{2,10})[-_\s]?(\d{2,6})\b", 1)
    number = F.regexp_extract(query, r"(?i)\b([A-Z]{2,10})[-_\s]?(\d{2,6})\b", 2)
    return F.coalesce(out, *rest, F.when(code != "", F.concat(F.upper(code), F.lit("-"), number)))


def project_terms(query: Column) -> Column:
    """Folded terms of the named project, without what its name has in brackets."""
    title = F.split(F.coalesce(project_title(query), F.lit("")), r"\(")[0]
    found = F.regexp_extract_all(text.fold(title), F.lit("[a-z0-9]{3,}"), F.lit(0))
    return F.filter(found, lambda w: ~w.isin("projet", "programme", "mission"))


def names_project(query: Column, *values: Column) -> Column:
    terms = project_terms(query)
    where = text.fold(F.concat_ws(" ", *values))
    return (F.size(terms) > 0) & F.forall(terms, lambda w: F.contains(where, w))


def keywords(query: Column) -> Column:
    """Distinct words of a question that say something, without those of the project's name."""
    found = F.regexp_extract_all(text.fold(query), F.lit("[a-z0-9]{3,}"), F.lit(0))
    named = F.regexp_extract_all(text.fold(F.coalesce(project_title(query), F.lit(""))), F.lit("[a-z0-9]{3,}"), F.lit(0))
    return F.array_except(F.array_except(found, F.array(*[F.lit(w) for w in QUESTION_WORDS])), named)


def cue_hits(folded: Column, of: Column) -> Column:
    """How many cues of an intent occur."""
    out = F.lit(0)
    for name, cues in CUES.items():
        hits = sum((F.contains(folded, F.lit(c)).cast("int") for c in cues), F.lit(0))
        out = F.when(of == name, hits).otherwise(out)
    return out


def select_context(queries: DataFrame, rows: DataFrame, limit: int = 8) -> DataFrame:
    """Per query the rows to answer from: the first of equal ones, those of the named project if any, and the most
    specific up to the limit where the intent has cues; else as they are. rows: query_id, chunk_id, document_id, page,
    document_name, content, rank, text_score, vector_score."""
    both = rows.join(queries.select("query_id", "query"), "query_id")
    both = retrieval.keep_first(both, ["query_id", "document_id", "page", F.lower(F.trim("content"))], ["rank", "chunk_id"])
    both = retrieval.restrict_if_any(both, names_project(F.col("query"), F.col("document_name"), F.col("content")))
    folded = text.fold(F.col("content"))
    asked = keywords(F.col("query"))
    both = both.withColumns({"intent": intent(F.col("query")), "n": F.count("*").over(Window.partitionBy("query_id")), "keyword_hits": F.size(F.filter(asked, lambda w: F.contains(folded, w)))}).withColumn("cue_hits", cue_hits(folded, F.col("intent")))
    order = [F.desc("cue_hits"), F.desc("keyword_hits"), F.desc(F.coalesce("text_score", F.lit(0.0))), F.desc(F.coalesce("vector_score", F.lit(0.0))), F.length("content"), "rank", "chunk_id"]
    ranked = both.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    plain = F.col("intent").isNull() | ~F.col("intent").isin(*CUES)
    return ranked.where((F.col("n") <= limit) | plain | (F.col("place") <= limit)).select("query_id", "chunk_id", "intent", "cue_hits", "keyword_hits", F.when((F.col("n") <= limit) | plain, F.col("rank")).otherwise(F.col("place")).alias("place"))


def sentences_for(queries: DataFrame, chunks: DataFrame, most: int = 4) -> DataFrame:
    """Up to ``most`` source sentences per query: four points a cue, one a keyword, three where results are named."""
    s = chunks.select("query_id", "chunk_id", F.posexplode(F.split("content", r"(?<=[.!?])\s+|\n+")).alias("pos", "sentence"))
    s = s.withColumn("sentence", F.trim("sentence")).where(text.word_count(F.col("sentence")) >= 7)
    s = s.join(queries.select("query_id", "query"), "query_id").withColumn("folded", text.fold(F.col("sentence")))
    s = s.where(~F.col("folded").rlike("sommaire|table des matieres|contact|objet du document")).withColumn("intent", intent(F.col("query"))).where(F.coalesce(F.col("intent") != "person", F.lit(True)))
    s = s.withColumns({"k": F.size(F.filter(keywords(F.col("query")), lambda w: F.contains(F.col("folded"), w))), "c": cue_hits(F.col("folded"), F.col("intent"))}).where("c > 0 or k >= 2")
    s = s.withColumn("score", 4 * F.col("c") + F.col("k") + F.when(F.col("folded").rlike("a la cloture|resultats obtenus"), 3).otherwise(0))
    s = retrieval.keep_first(s, ["query_id", "folded"], ["chunk_id", "pos"])
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id", "pos")
    return s.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("query_id", "chunk_id", "place", "score", "sentence")


def labelled_rows(docs: DataFrame, pattern: str, names: list[str]) -> DataFrame:
    """One row per labelled line, a column for each label."""
    found = F.arrays_zip(*[F.regexp_extract_all("content", F.lit(pattern), F.lit(i + 1)).alias(n) for i, n in enumerate(names)])
    rows = docs.select("document_id", "chunk_id", F.posexplode(found).alias("row", "x"))
    return rows.select("document_id", "chunk_id", "row", *[F.trim(F.col(f"x.{n}")).alias(n) for n in names])


def team_rows(docs: DataFrame) -> DataFrame:
    return labelled_rows(docs, TEAM, ["name", "role", "entity", "charge", "period"])


def budget_rows(docs: DataFrame) -> DataFrame:
    return labelled_rows(docs, BUDGET, ["post", "responsible", "days", "rate", "amount"])


def amount(value: Column) -> Column:
    """Digits of an amount as a number; null without any."""
    return F.regexp_replace(F.regexp_extract(value, r"([0-9][0-9  ]*)", 1), "[^0-9]", "").try_cast("long")


def person_budget(docs: DataFrame) -> DataFrame:
    """Team rows and budget rows of one document and one person, from different chunks, that share two role terms."""
    role = lambda c: text.terms(F.col(c), 4)
    team = team_rows(docs).select("document_id", F.col("chunk_id").alias("team_chunk"), F.lower("name").alias("who"), "name", "role", role("role").alias("role_terms"))
    budget = budget_rows(docs).select("document_id", F.col("chunk_id").alias("budget_chunk"), F.lower("responsible").alias("who"), "post", "days", "amount", role("post").alias("post_terms"))
    both = team.join(budget, ["document_id", "who"]).where("team_chunk <> budget_chunk").withColumn("shared", F.size(F.array_intersect("role_terms", "post_terms"))).where("shared >= 2")
    return retrieval.keep_first(both, ["document_id", "who", "role"], [F.desc("shared"), "budget_chunk"]).select("document_id", "name", "role", "post", "days", "amount", "shared")


def budget_totals(docs: DataFrame) -> DataFrame:
    """Per document engaged and consumed amounts, what remains or the overrun, from ``label: amount`` lines."""
    folded = text.fold(F.col("content"))
    pick = lambda word: amount(F.regexp_extract(folded, rf"{word}[^0-9\n]*([0-9][0-9  ]*)", 0))
    rows = docs.groupBy("document_id").agg(F.max(pick("engage")).alias("engaged"), F.max(pick("consomme")).alias("consumed"))
    return rows.where("engaged is not null and consumed is not null").select("document_id", "engaged", "consumed", (F.col("engaged") - F.col("consumed")).alias("remaining"))


def expanded(query: Column, vocabulary: dict[str, list[str]]) -> Column:
    """The query with the words of every vocabulary whose intent word it has."""
    folded = text.fold(query)
    more = [F.when(F.contains(folded, F.lit(k)), F.lit(" ".join(v))) for k, v in vocabulary.items()]
    return F.concat_ws(" ", query, *more)


#: Labels of a metric row, an architecture row and an objective row.
METRIC = r"Indicateur:\s*([^;\n]+);\s*Avant:\s*([^;\n]+);\s*Après:\s*([^;\n]+)(?:;\s*Évolution:\s*([^;\n]+))?"
LAYER = r"Couche\s+([^:\n]+):\s*([^;\n]+)"
OBJECTIVE = r"Objectif:\s*([^;\n]+);\s*Cible:\s*([^;\n]+)"
#: Intent, label, pattern whose first group is the value.
FACT_RULES = [
    ("identity", "client", r"Client:\s*([^;\n]+)"),
    ("identity", "sector", r"Secteur:?\s+([^;\n]+?)(?:\s+Type de mission|[;\n]|$)"),
    ("identity", "mission_type", r"Type de mission:?\s+([^;\n]+?)(?:\s+Période|[;\n]|$)"),
    ("identity", "status", r"Statut:\s*([^;\n]+)"),
    ("technologies", "layer", r"(Couche\s+[^:\n]+:\s*[^;\n]+)"),
    ("metrics", "metric", r"(Indicateur:\s*[^\n]+)"),
    ("budget", "line", r"(Poste:\s*[^\n]+)"),
    ("team", "member", r"(Nom:\s*[^\n]+)"),
    ("scope", "excluded", r"(?:Exclu|Hors périmètre):\s*([^;\n]+)"),
    ("time", "period", r"Période:\s*([^;\n]+)"),
    ("objectives", "objective", r"(Objectif:\s*[^\n]+)"),
]


def metric_rows(docs: DataFrame) -> DataFrame:
    return labelled_rows(docs, METRIC, ["indicator", "before", "after", "change"])


def architecture_rows(docs: DataFrame) -> DataFrame:
    return labelled_rows(docs, LAYER, ["layer", "technology"])


def objective_rows(docs: DataFrame) -> DataFrame:
    return labelled_rows(docs, OBJECTIVE, ["objective", "target"])


def _labelled(label: str):
    return lambda v: F.struct(F.lit(label).alias("label"), F.trim(v).alias("value"))


def facts(queries: DataFrame, chunks: DataFrame, rules=FACT_RULES) -> DataFrame:
    """What the rules of a query's intent find in its chunks: query_id, label, value and the chunk where it comes first.
    A chunk meets the rules of its own query's intent only."""
    asked = queries.select("query_id", intent(F.col("query")).alias("intent")).where("intent is not null")
    rows = chunks.join(asked, "query_id")
    found = F.lit(None).cast("array<struct<label:string,value:string>>")
    for name in dict.fromkeys(r[0] for r in rules):
        own = [F.transform(F.regexp_extract_all("content", F.lit(p), F.lit(1)), _labelled(label)) for i, label, p in rules if i == name]
        found = F.when(F.col("intent") == name, F.concat(*own)).otherwise(found)
    hits = rows.select("query_id", "chunk_id", F.posexplode(found).alias("pos", "x")).where("x.value <> ''").select("query_id", "chunk_id", "pos", "x.*")
    return retrieval.keep_first(hits, ["query_id", "label", "value"], ["chunk_id", "pos"]).drop("pos")
