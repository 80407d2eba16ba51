"""Marks and facts of prose over whole documents: license lines, secrets, and what follows common words."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grounding, prose
from ..operators.prose import Phrase, Rule
from ..registry import query
from . import retrieval as r

#: Phrases that the given texts have; some overlap, some are parts of words.
VOCABULARY = [
    Phrase("license", "licensed under the"), Phrase("secret", "token", whole=False), Phrase("secret", "password", whole=False),
    Phrase("and", "and"), Phrase("and", "und"), Phrase("article", "the"), Phrase("article", "der"), Phrase("article", "the and"),
    Phrase("comma", ",", whole=False), Phrase("stop", ".", whole=False), Phrase("line", "\n", whole=False),
]
RULES = [
    Rule("identity", "license", "license", ("comma", "line", prose.END), 60),
    Rule("identity", "secret", "secret", ("line", "stop", prose.END), 60),
    Rule("context", "joined", "and", ("comma", "stop"), 40),
    Rule("person", "pair", "and", ("article", "stop"), 30, said=True),
]


def _rows(t):
    return t.documents.select(F.col("doc_id").alias("row_id"), F.col("text").alias("content"))


def _spots(p: Phrase) -> str:
    """All places of one phrase in SQL, from what lies between them: no phrase here overlaps itself."""
    n = len(p.phrase)
    quoted = "chr(10)" if p.phrase == "\n" else f"'{p.phrase}'"
    touched = "regexp_matches({}, '[\\p{{L}}\\p{{N}}]')"
    before = touched.format(f"CASE WHEN part = '' THEN CASE WHEN i = 1 THEN ' ' ELSE right({quoted}, 1) END ELSE right(part, 1) END")
    after = touched.format(f"CASE WHEN later = '' THEN CASE WHEN i + 1 = many THEN ' ' ELSE left({quoted}, 1) END ELSE left(later, 1) END")
    whole = f" AND NOT {before} AND NOT {after}" if p.whole else ""
    return f"""SELECT doc_id, '{p.name}' AS name, (seen + (i - 1) * {n})::INT AS start, (seen + i * {n})::INT AS end_
FROM (SELECT doc_id, i, part, many, lead(part) OVER w AS later, sum(length(part)) OVER (w ROWS UNBOUNDED PRECEDING) AS seen
    FROM (SELECT doc_id, unnest(parts) AS part, unnest(range(1, len(parts) + 1)) AS i, len(parts) AS many FROM (SELECT doc_id, string_split(f, {quoted}) AS parts FROM fd))
    WINDOW w AS (PARTITION BY doc_id ORDER BY i))
WHERE i < many{whole}"""


MARKS_SQL = f"""fd AS MATERIALIZED (SELECT doc_id, text, lower({r.TR}) AS f FROM documents WHERE text <> ''),
mk AS ({' UNION ALL '.join(_spots(p) for p in VOCABULARY)} UNION ALL SELECT doc_id, '{prose.END}', length(f), length(f) FROM fd)"""


def _rule_sql(rule: Rule) -> str:
    stops = ", ".join(f"'{s}'" for s in rule.stops)
    cut = "regexp_replace(text[h.end_ + 1:s.start], '^[\\s:;,.\\-=]+|[\\s:;,.\\-=]+$', '', 'g')"
    return f"""SELECT h.doc_id AS row_id, '{rule.intent}' AS intent, '{rule.label}' AS label, h.start, {'s.name' if rule.said else cut} AS value, s.name AS stop
FROM (SELECT * FROM mk WHERE name = '{rule.head}') h ASOF JOIN (SELECT doc_id, start, min(name) AS name FROM mk WHERE name IN ({stops}) GROUP BY ALL) s
  ON s.doc_id = h.doc_id AND s.start >= h.end_ JOIN fd ON fd.doc_id = h.doc_id WHERE s.start - h.end_ <= {rule.most}"""


@query("x54_marks", f"WITH {MARKS_SQL} SELECT doc_id AS row_id, name, count(*) AS n, sum(start)::BIGINT AS places, max(end_)::BIGINT AS last FROM mk GROUP BY ALL")
def x54_marks(t):
    """How often and where each phrase is marked, in whole texts."""
    found = prose.marks(_rows(t), VOCABULARY)
    return found.groupBy("row_id", "name").agg(F.count("*").alias("n"), F.sum("start").alias("places"), F.max("end_").cast("long").alias("last"))


@query("x54_prose_facts", f"WITH {MARKS_SQL}, fa AS ({' UNION ALL '.join(_rule_sql(x) for x in RULES)}) SELECT row_id, intent, label, start::INT AS start, value, stop FROM fa WHERE value <> ''")
def x54_facts(t):
    """Values between a head and its nearest stop, by the rule table."""
    return prose.facts(_rows(t), VOCABULARY, RULES)


#: Word families of the given texts, beside the shipped ones: a part of one language's words each.
FAMILIES = grounding.FAMILIES | {"state": ["heit", "keit"], "action": ["tion ", "cion"], "manner": ["mente", "lich"]}
_T = r.TR.replace("text", "{}")


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _family_sql(words: list[str]) -> str:
    has = lambda c: f"len(list_filter({_list(words)}, lambda w: contains({c}, w))) > 0"
    return f"(NOT {has('f')} OR {has('g')})"


@query(
    "x46_criteria",
    f"""WITH q AS (SELECT a.conv_id * 100 + a.turn AS query_id, substr(a.text, 1, 40) AS criterion, lower({_T.format("substr(a.text, 1, 40)")}) AS f, lower({_T.format("b.text")}) AS g
    FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant' WHERE a.role = 'user'),
k AS (SELECT *, list_filter(regexp_extract_all(f, '[a-z0-9]{{3,}}'), lambda w: NOT list_contains({_list(grounding.CRITERION_STOPS)}, w)) AS ts,
    regexp_extract_all(f, '[0-9]+(?:[,.][0-9]+)?\\s*%?') AS ns, regexp_extract_all(g, '[\\p{{L}}\\p{{N}}_]+') AS ws FROM q)
SELECT query_id, criterion, CASE WHEN f = 'legacy' THEN true WHEN contains(f, '?') OR list_contains({_list(grounding.VAGUE)}, f) OR len(ts) = 0 OR (len(ts) < 2 AND len(ns) = 0) THEN false
    WHEN len(ts) = 1 AND list_contains({_list(grounding.FIELDS)}, ts[1]) AND len(regexp_extract_all(g, '[^ \t\n\r]+')) >= 3 THEN true
    ELSE len(list_filter(ns, lambda n: NOT contains(g, n))) = 0 AND len(list_intersect(list_distinct(ts), ws)) >= least(2, len(list_distinct(ts)))
        AND {" AND ".join(_family_sql(w) for w in FAMILIES.values())} END AS supported FROM k""",
)
def x46(t):
    """Whether an answer speaks of what the first words of its question ask for."""
    a = t.conversations.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.array("text").alias("quotes"))
    asked = t.conversations.where("role = 'user'").select("conv_id", "turn", F.substring("text", 1, 40).alias("criterion"))
    rows = asked.join(a, ["conv_id", "turn"]).select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), "criterion", "quotes")
    return grounding.criteria_supported(rows, FAMILIES)
