"""Marks and facts of prose against a plain search, and criteria by the rules' own cases."""

import random

import pytest

from folio.functions import text
from folio.operators import grounding, prose
from folio.operators.prose import Phrase, Rule


def plain_marks(value, vocabulary):
    low = prose.folded(value)
    out = []
    for p in vocabulary:
        for s in range(len(low) - len(p.phrase) + 1):
            e = s + len(p.phrase)
            if low[s:e] == p.phrase:
                inside = lambda i: 0 <= i < len(low) and low[i].isalnum()
                if not p.whole or not (inside(s - 1) and inside(s) or inside(e) and inside(e - 1)):
                    out.append((p.name, s, e))
    return out


def plain_facts(value, vocabulary, rules):
    found = [*plain_marks(value, vocabulary), (prose.END, len(value), len(value))] if value else []
    out = []
    for r in rules:
        for name, s, e in found:
            if name == r.head:
                stops = sorted((a, n) for n, a, _ in found if n in r.stops and a >= e)
                if stops and stops[0][0] - e <= r.most:
                    cut = value[e : stops[0][0]].strip(" \t\n\r:;,.-=")
                    v = stops[0][1] if r.said else cut
                    if v:
                        out.append((r.intent, r.label, s, v, stops[0][1]))
    return out


def test_marks_and_facts_equal_a_plain_search(spark):
    rng = random.Random(3)
    vocabulary = [Phrase("a", "ab"), Phrase("a", "aba", False), Phrase("b", "ba", False), Phrase("c", "e e"), Phrase("d", ".", False), Phrase("e", "ab")]
    rules = [Rule("x", "one", "a", ("b", "d"), 6), Rule("x", "two", "c", ("a", prose.END), 20), Rule("y", "said", "b", ("a", "d"), 9, said=True), Rule("y", "self", "b", ("b",), 30)]
    values = [None, "", "ab", "É e. Àb", "x" * 5000 + " ab ." + "y" * 5000] + ["".join(rng.choice("aábBéE .-") for _ in range(rng.randint(1, 60))) for _ in range(120)]
    rows = [(i, v) for i, v in enumerate(values)] + [(7, values[7])]
    docs = spark.createDataFrame(rows, "row_id long, content string").repartition(3)
    got = sorted((r["row_id"], r["name"], r["start"], r["end_"]) for r in prose.marks(docs, vocabulary).where("name <> 'end'").collect())
    assert got == sorted((i, *m) for i, v in rows for m in plain_marks(v or "", vocabulary))
    # A text that is there twice has its facts from marks that are there twice: once each in what follows.
    single = spark.createDataFrame(rows[:-1], "row_id long, content string")
    got = sorted(tuple(r) for r in prose.facts(single, vocabulary, rules).collect())
    assert got == sorted((i, *f) for i, v in rows[:-1] for f in plain_facts(v or "", vocabulary, rules))
    assert prose.facts(docs.limit(0), vocabulary, rules).count() == 0


def test_answers_from_prose(spark):
    cover = "Client: Banque Ébène Secteur: banque Type de mission: audit Période: mars 2021 Statut: clos\n## Objet du document\nContexte : les saisies étaient doubles. Suite."
    scope = "Le lot 2 est traité. Périmètre exclu : les sanctions et les marchés. Autre chose."
    queries = spark.createDataFrame([(1, "fiche d'identité du projet Ébène"), (2, "quel est le périmètre exclu ?"), (3, "rien de tout cela"), (4, "le contexte du projet")], "query_id long, query string")
    chunks = spark.createDataFrame([(q, c, x) for q in (1, 2, 3, 4) for c, x in ((10, cover), (11, scope), (12, cover))], "query_id long, chunk_id long, content string")
    got = {(r["query_id"], r["label"], r["value"], r["chunk_id"]) for r in prose.answers(queries, chunks, prose.VOCABULARY, prose.RULES).collect()}
    assert {g for g in got if g[0] == 1} == {(1, "client", "Banque Ébène", 10), (1, "sector", "banque", 10), (1, "mission_type", "audit", 10), (1, "period", "mars 2021", 10), (1, "status", "clos", 10)}
    assert {g for g in got if g[0] == 2} == {(2, "excluded", "les sanctions et les marchés", 11)}
    assert {g for g in got if g[0] == 4} == {(4, "problem", "les saisies étaient doubles", 10)} and not any(g[0] == 3 for g in got)


def test_folding_keeps_places():
    assert prose.folded("ÉÀ İx ß") == "ea İx ß" and len(prose.folded(text.ACCENTED)) == len(text.ACCENTED)


CASES = [
    ("legacy", ["anything"], True),
    ("Quel délai ?", ["Le délai est de 4 jours."], False),
    ("critère", ["critere"], False),
    ("projet", ["le projet"], False),
    ("part de marché du client", ["Le client compte 4 millions d'abonnés."], False),
    ("part de marché du client", ["Le client a une part de marché de 12 %."], True),
    ("budget engagé 470 000", ["Le budget engagé atteint 470 000 euros."], True),
    ("budget engagé 470 000", ["Le montant atteint 470 000 euros, budget prévu."], False),
    ("secteur 2", ["secteur de la banque, lot 2"], True),
    ("tarif annuel du support", ["Le support annuel est assuré par le fournisseur."], False),
    (None, None, False),
]


@pytest.mark.parametrize("criterion, quotes, want", CASES)
def test_criteria(spark, criterion, quotes, want):
    rows = spark.createDataFrame([(1, criterion, quotes)], "query_id long, criterion string, quotes array<string>")
    assert grounding.criteria_supported(rows).first()["supported"] == want


def test_negated_attributes_do_not_count(spark):
    rows = [(1, "tarif du support", ["Il n'y a pas de tarif pour le support."]), (2, "tarif du support", ["Pas de report. Le tarif du support est fixe."])]
    frame = spark.createDataFrame(rows, "query_id long, criterion string, quotes array<string>")
    assert {r["query_id"]: r["supported"] for r in grounding.criteria_supported(frame, negations=["pas de", "aucun"]).collect()} == {1: False, 2: True}
    assert {r["query_id"]: r["supported"] for r in grounding.criteria_supported(frame).collect()} == {1: True, 2: True}
