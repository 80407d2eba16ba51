"""Facts from free prose: one automaton marks phrases with their places, and a rule table joins marks into facts.

A vocabulary names phrases and says what they are: heads, after which a value begins, and stops, where it ends; roles,
titles, units, whatever rules speak of. All phrases are found in one pass over a text, folded letter by letter so that
places hold in the text as it is; the automaton is built once a task. What rules need of the text comes along with a
mark, up to the longest value that any rule allows, so that no text is shuffled: a rule joins each head with the nearest
stop behind it by one window over the marks of a text.

Cases: null and empty texts have no marks; phrases that overlap are all marked; of two stops at one place the first by
name counts; the end of a text is a stop named ``end``; a head without a stop in reach gives no fact, nor does a value of
white space and marks alone; repeated rows are marked each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..session import sound
from . import extraction, retrieval

_FOLDED = str.maketrans({c: p.lower() for c, p in zip(text.ACCENTED, text.PLAIN)} | {chr(c): chr(c + 32) for c in range(65, 91)})
END = "end"


@dataclass(frozen=True)
class Phrase:
    """A folded phrase and the name of what it marks; ``whole`` if no letter or digit may touch it."""

    name: str
    phrase: str
    whole: bool = True


@dataclass(frozen=True)
class Rule:
    """For questions of an intent: from a head's end to the nearest of the stops, at most so many characters on, lies a
    value. ``said`` reports the stop's own name as the value, for marks that belong together, as a name and a role."""

    intent: str
    label: str
    head: str
    stops: tuple[str, ...]
    most: int = 200
    said: bool = False


def folded(value: str) -> str:
    """As ``text.fold``, letter by letter."""
    out = value.translate(_FOLDED)
    return out if out.isascii() else "".join(c.lower() if len(c.lower()) == 1 else c for c in out)


def _automaton(vocabulary: list[Phrase]) -> ahocorasick.Automaton:
    by: dict[str, list[Phrase]] = {}
    for p in vocabulary:
        by.setdefault(p.phrase, []).append(p)
    found = ahocorasick.Automaton()
    for phrase, own in by.items():
        found.add_word(phrase, own)
    found.make_automaton()
    return found


def marked(value: str, automaton: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(name, start, end) of every phrase in the text."""
    low = folded(value)
    word = lambda i: 0 <= i < len(low) and low[i].isalnum()
    out = []
    for last, phrases in automaton.iter(low):
        end = last + 1
        for p in phrases:
            start = end - len(p.phrase)
            if not p.whole or not (word(start - 1) and word(start) or word(end) and word(last)):
                out.append((p.name, start, end))
    return out


def marks(docs: DataFrame, vocabulary: list[Phrase], heads: set[str] | None = None, most: int = 0) -> DataFrame:
    """row_id, name, start, end_ and after: the ``most`` characters behind a mark that is one of ``heads``, null else.
    docs: row_id and content. The vocabulary is a parameter of bounded size."""
    heads = heads or set()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(vocabulary)
        for batch in batches:
            rows = []
            for i, content in zip(batch.column("row_id").to_pylist(), batch.column("content")):
                value = content.as_py()
                if value:
                    rows += [(i, n, s, e, value[e : e + most] if n in heads else None) for n, s, e in marked(value, automaton)]
                    rows.append((i, END, len(value), len(value), None))
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["row_id", "name", "start", "end_", "after"])

    sound(docs.sparkSession)
    rows = docs.select(F.col("row_id").cast("long").alias("row_id"), "content")
    return rows.mapInArrow(found, "row_id long, name string, start int, end_ int, after string")


def facts(docs: DataFrame, vocabulary: list[Phrase], rules: list[Rule]) -> DataFrame:
    """row_id, intent, label, start (of the head), value and stop (its name): every value that a rule finds."""
    spark = docs.sparkSession
    found = marks(docs, vocabulary, {r.head for r in rules}, max(r.most for r in rules) + 1)
    use = [(i, r.intent, r.label, n, n == r.head and k == 0, r.most, r.said) for i, r in enumerate(rules) for k, n in [(0, r.head), *((1, s) for s in r.stops)]]
    table = spark.createDataFrame(use, "rule int, intent string, label string, name string, is_head boolean, most int, said boolean")
    rows = found.join(F.broadcast(table), "name")  # a row for each name in a rule
    rows = rows.withColumn("at", F.when(F.col("is_head"), F.col("end_")).otherwise(F.col("start")))
    behind = Window.partitionBy("row_id", "rule").orderBy("at", F.desc("is_head"), "start", "name").rowsBetween(1, Window.unboundedFollowing)
    stop = F.first(F.when(~F.col("is_head"), F.struct("at", "name")), ignorenulls=True).over(behind)
    rows = rows.withColumn("stop", stop).where("is_head").withColumn("size", F.col("stop.at") - F.col("at")).where("size <= most")
    value = F.regexp_replace(F.expr("substring(after, 1, size)"), r"^[\s:;,.\-=]+|[\s:;,.\-=]+$", "")
    rows = rows.withColumn("value", F.when(F.col("said"), F.col("stop.name")).otherwise(value)).where("value <> ''")
    return rows.select("row_id", "intent", "label", "start", "value", F.col("stop.name").alias("stop"))


def answers(queries: DataFrame, chunks: DataFrame, vocabulary: list[Phrase], rules: list[Rule]) -> DataFrame:
    """Per query what the rules of its intent find in its chunks, each value where it comes first: query_id, label,
    value, chunk_id and start. queries: query_id, query; chunks: query_id, chunk_id, content. A chunk that many queries
    have is marked once."""
    asked = queries.select("query_id", extraction.intent(F.col("query")).alias("intent")).where("intent is not null")
    wanted = chunks.join(asked, "query_id").select("query_id", "chunk_id", "intent")
    texts = chunks.groupBy("chunk_id").agg(F.first("content").alias("content"))
    found = facts(texts.select(F.col("chunk_id").alias("row_id"), "content"), vocabulary, rules).withColumnRenamed("row_id", "chunk_id")
    rows = wanted.join(found, ["chunk_id", "intent"])
    return retrieval.keep_first(rows, ["query_id", "label", "value"], ["chunk_id", "start"]).select("query_id", "label", "value", "chunk_id", "start")


def _names(name: str, *phrases: str, whole: bool = True) -> list[Phrase]:
    return [Phrase(name, p, whole) for p in phrases]


#: The phrases that head a value, or end one, in reports of the kind that questions are asked of.
VOCABULARY = [
    *_names("excluded", "perimetre exclu", "hors perimetre", "sont exclus", "est exclu", "non inclus"),
    *_names("client", "client:"), *_names("sector", "secteur:", "secteur"), *_names("mission_type", "type de mission:", "type de mission"),
    *_names("period", "periode:", "periode"), *_names("status", "statut:"), *_names("budget", "budget consomme:", "budget consomme", "budget engage:", "budget engage"),
    *_names("team", "equipe:", "equipe;"), *_names("reference", "reference:", "reference;"),
    *_names("problem", "probleme initial", "situation de depart", "contexte"), *_names("solution", "solution retenue", "approche retenue"),
    *_names("difficulty", "difficulte rencontree", "difficulte principale"),
    *_names("before", "situation initiale:", "avant:"), *_names("after", "a la cloture:", "apres:"),
    *_names("heading", "##", whole=False), *_names("line", "\n", whole=False), *_names("semicolon", ";", whole=False), *_names("sentence", ". ", ".\n", whole=False),
]
_FIELDS = ("client", "sector", "mission_type", "period", "status", "budget", "team", "reference", "heading", "line", "semicolon", END)
_PROSE = ("sentence", "heading", END)
#: What is looked for, by intent: fields of a cover end at the next field, prose at the end of its sentence.
RULES = [
    *[Rule("identity", f, f, _FIELDS) for f in ("client", "sector", "mission_type", "period", "status", "budget", "team", "reference")],
    Rule("scope", "excluded", "excluded", _PROSE, 400),
    Rule("context", "problem", "problem", _PROSE, 400), Rule("summary", "problem", "problem", _PROSE, 400),
    Rule("summary", "solution", "solution", _PROSE, 400), Rule("solution", "solution", "solution", _PROSE, 400),
    Rule("difficulty", "difficulty", "difficulty", _PROSE, 400),
    Rule("metrics", "before", "before", ("semicolon", "sentence", "after", "line", END)), Rule("metrics", "after", "after", ("semicolon", "sentence", "before", "line", END)),
    Rule("time", "period", "period", _FIELDS), Rule("team", "team", "team", _FIELDS),
]
