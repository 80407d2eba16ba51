"""Text functions as column expressions: folding, terms, sentences, counts, patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks, and the same without.
ACCENTED = "ÀÁÂÃÄÅàáâãäåÈÉÊËèéêëÌÍÎÏìíîïÒÓÔÕÖòóôõöÙÚÛÜùúûüÇçÑñÝýÿ"
PLAIN = "AAAAAAaaaaaaEEEEeeeeIIIIiiiiOOOOOoooooUUUUuuuuCcNnYyy"
#: Words without weight in French questions.
STOP_WORDS = ["les", "des", "une", "que", "qui", "dans", "pour", "par", "sur", "avec", "est", "sont", "aux", "ces", "son", "ses", "leur", "leurs", "the", "and", "for", "with", "that", "this"]


def fold(text: Column) -> Column:
    """Lower case without accents."""
    return F.lower(F.translate(text, ACCENTED, PLAIN))


def terms(text: Column, least: int = 3, stop: list[str] | None = None) -> Column:
    """Distinct folded terms of ``least`` characters or more, in order of appearance, without stop words."""
    found = F.regexp_extract_all(fold(text), F.lit(f"[a-z0-9]{{{least},}}"), F.lit(0))
    words = F.array(*[F.lit(w) for w in (STOP_WORDS if stop is None else stop)])
    return F.array_except(found, words) if stop != [] else F.array_distinct(found)


def sentences(text: Column) -> Column:
    """Parts that end in a full stop, a question or an exclamation mark."""
    return F.filter(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda s: s != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^ \t\n\r]+"))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[^ \t\n\r]+"), F.lit(0))


def cleaned(text: Column) -> Column:
    """One form of white space: no NUL, LF line ends, single blanks, trimmed lines, one blank line at most."""
    text = F.replace(text, F.lit("\0"), F.lit(""))
    text = F.regexp_replace(text, r"\r\n?", "\n")
    text = F.regexp_replace(text, r"[ \t]+", " ")
    text = F.regexp_replace(text, r" ?\n ?", "\n")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return F.regexp_replace(text, r"^[ \n]+|[ \n]+$", "")


def preview(text: Column, limit: int = 140) -> Column:
    """White space collapsed, cut to the limit with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"[ \t\n\r]+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("…"))).otherwise(flat)


def bounded(text: Column, limit: int = 6000) -> Column:
    """At most ``limit`` characters, cut before a word."""
    cut = F.substring(text, 1, limit)
    return F.when(F.length(text) <= limit, text).otherwise(F.regexp_replace(cut, r" [^ ]*$", ""))


def prefix_words(text: Column, limit: int = 100) -> Column:
    return F.array_join(F.slice(words(text), 1, limit), " ")


def token_budget(chars: Column) -> Column:
    """About how many tokens a number of characters takes."""
    return F.greatest(F.lit(1), F.floor(chars / F.lit(3.2))).cast("long")


def numeric_facts(text: Column) -> Column:
    """Distinct numbers with the unit that follows, in order of appearance, without the blank between them."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[0-9]+(?:[.,][0-9]+)? ?(?:%|eur|euros|ms|jours|mois|heures|minutes)?"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.replace(F.trim(x), F.lit(" "), F.lit(""))))


def citation_indexes(text: Column) -> Column:
    """Distinct numbers in square brackets, in order of appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[([0-9]{1,4})\]"), F.lit(1)), lambda x: x.cast("int")))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def safe_filename(name: Column) -> Column:
    """What follows the last slash of either kind, its last 255 characters."""
    base = F.regexp_extract(name, r"([^/\\]*)$", 1)
    return F.right(base, F.lit(255))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))


def reference_code(text: Column) -> Column:
    """The first code of two to five letters, a dash and digits, in upper case."""
    code = F.regexp_extract(text, r"[A-Za-z]{2,5} ?- ?[0-9]{1,6}", 0)
    return F.when(code != "", F.upper(F.replace(code, F.lit(" "), F.lit(""))))

#: French endings that a light stemmer drops, the first of each step that fits.
ENDINGS = ["issements", "issement", "ements", "ations", "ateurs", "ement", "ation", "ateur", "ances", "ités", "ance", "ives", "ives", "euses", "eux", "ité", "ifs", "ive", "if", "ées", "és", "ée", "er", "es", "e", "s"]


def stem(word: Column) -> Column:
    """A word without its first ending that fits, if four characters are left. Not the Snowball stemmer."""
    return F.regexp_replace(word, "^(.{4,}?)(?:" + "|".join(dict.fromkeys(ENDINGS)) + ")$", "$1")


def lexemes(value: Column) -> Column:
    """Folded words of three letters and more without stop words, stemmed, with repeats."""
    words_ = F.filter(F.regexp_extract_all(fold(value), F.lit("[a-z0-9]{3,}"), F.lit(0)), lambda w: ~F.array_contains(F.array(*[F.lit(s) for s in STOP_WORDS]), w))
    return F.transform(words_, stem)


def pages_of(expected: Column) -> Column:
    """Page numbers after the last ``p.``."""
    return F.transform(F.regexp_extract_all(F.regexp_extract(expected, r"p\. ([0-9, et]+)$", 1), F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("int"))


def answer_mode(query: Column) -> Column:
    """Which layout suits the answer to a question."""
    f = fold(query)
    has = lambda *ws: _any_of(f, ws)
    return (
        F.when(has("fiche") & has("identite", "complete"), "identity")
        .when(has("equipe") & has("quelle", "composition", "projet"), "team")
        .when(has("budget"), "budget")
        .when(has("perimetre") & has("exclu", "hors", "non inclus"), "scope")
        .when(has("objectif") & has("technique"), "objectives")
        .when(has("resultat mesure", "resultats mesures", "indicateur"), "metrics")
        .when(has("probleme initial") & has("solution") & has("resultat", "impact"), "summary")
        .when(has("architecture", "choix technique", "mesures de securite", "technologie"), "architecture")
        .otherwise("default")
    )


def _any_of(folded: Column, phrases) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(folded, F.lit(p))
    return out


def blocks(value: Column) -> Column:
    """Paragraphs of an answer, headings on lines of their own, comments dropped."""
    clean = F.regexp_replace(F.regexp_replace(value, r"(?s)<!--.*?-->", ""), r"\s+(?=##\s)", "\n\n")
    return F.filter(F.transform(F.split(clean, r"\n{2,}"), lambda b: F.trim(b)), lambda b: b != "")


def renumbered(value: Column, numbers: Column) -> Column:
    """[n] marks by the map ``numbers``; marks that it does not have go."""
    parts = F.split(value, r"\[[0-9]+\]", -1)
    marks = F.transform(F.regexp_extract_all(value, F.lit(r"\[([0-9]+)\]"), F.lit(1)), lambda m: m.cast("int"))
    new = F.transform(marks, lambda m: F.coalesce(F.concat(F.lit("["), F.try_element_at(numbers, m).cast("string"), F.lit("]")), F.lit("")))
    return F.array_join(F.zip_with(parts, F.concat(new, F.array(F.lit(""))), lambda p, n: F.concat(p, F.coalesce(n, F.lit("")))), "")


def segmented(value: Column, most: int = 25) -> Column:
    """Sentences of more than ``most`` words, cut at their first comma or linking word after the start."""
    cut = lambda s: F.when(word_count(s) > most, F.regexp_replace(s, r"^((?:\S+\s+){5,}?\S*?)(?:,\s+|\s+(?=(?:et|qui|que|dont)\s))", "$1.\n")).otherwise(s)
    return F.split(F.array_join(F.transform(sentences(value), cut), "\n"), "\n")
