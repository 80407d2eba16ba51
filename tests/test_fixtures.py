"""Small cases whose results are known, for operators that the given tables do not exercise."""

import json

import pytest
from pyspark.sql import functions as F

from folio.functions import quality, text
from folio.operators import audit, evaluate, extraction, grounding, ingest, jobs, proposal, retrieval, windows
from folio.sources import reports, tables
from folio.streaming import activity


def one(spark, sql):
    return spark.sql(f"SELECT {sql}").first()[0]


def value(spark, column, **given):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in given.items()]).select(column).first()[0]


# ---- fusion and selection


def ranked(spark, ids):
    return spark.createDataFrame([(1, c, i + 1) for i, c in enumerate(ids)], "query_id long, chunk_id long, rank long")


@pytest.mark.parametrize(("a", "b", "weights", "k", "want"), [([1, 2], [2, 3], (1, 1), 3, [2, 1, 3]), ([1], [947], (1, 2), 2, [947, 1]), ([99], [1, 2], (1, 2), 2, [1, 2])])
def test_fusion(spark, a, b, weights, k, want):
    got = retrieval.fuse([(ranked(spark, a), weights[0]), (ranked(spark, b), weights[1])], k).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == want


def test_lexical_reserve(spark):
    rows = spark.createDataFrame([(1, 1, 7, 1, 1.0, None, 0.1), (1, 2, 7, 1, 0.9, None, 0.1), (1, 3, 7, 4, 0.8, None, 0.1)], "query_id long, chunk_id long, document_id long, page long, text_score double, vector_score double, rrf_score double")
    kept = retrieval.protected(rows, 2, 0, 0).where("protected").collect()
    assert {r["chunk_id"] for r in kept} == {1, 3}


def test_companions_replace_the_tail(spark):
    chunks = spark.createDataFrame([(1, 10, 9, 0), (4, 10, 9, 1), (2, 20, 1, 0), (3, 30, 1, 0)], "chunk_id long, document_id long, page long, chunk_index long")
    selected = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3)], "query_id long, chunk_id long, rank long")
    companions = spark.createDataFrame([(1, 4, 1)], "query_id long, chunk_id long, place long")
    got = windows.with_companions(selected, companions, chunks).orderBy("place").collect()
    assert len(got) == 3 and [r["chunk_id"] for r in got if r["document_id"] == 10] == [1, 4] and [r["chunk_id"] for r in got] == [1, 2, 4]


def test_next_page(spark):
    chunks = spark.createDataFrame([(1, 10, 13, 0), (99, 10, 14, 1), (98, 10, 14, 2)], "chunk_id long, document_id long, page long, chunk_index long")
    got = retrieval.next_pages(spark.createDataFrame([(1, 1, 0.5)], "query_id long, chunk_id long, score double"), chunks).collect()
    assert [(r["chunk_id"], r["score"]) for r in got] == [(99, 0.4999)]


def test_nearest_in_blocks_is_exact(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 2)
    rows = [(i, [float((i * 7 + j * 3) % 11) - 5 for j in range(6)]) for i in range(40)] + [(99, None)]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<float>").repartition(5)
    got = {(r["query_id"], r["rank"]): (r["chunk_id"], r["score"]) for r in retrieval.nearest(df.where("chunk_id < 5").withColumnRenamed("chunk_id", "query_id"), df, 3).collect()}
    for q, v in rows[:5]:
        cos = sorted(((-round(sum(a * b for a, b in zip(v, w)) / (sum(a * a for a in v) * sum(b * b for b in w)) ** 0.5, 6), c) for c, w in rows[:40]))
        assert [got[q, k + 1] for k in range(3)] == [(c, -s + 0.0) for s, c in cos[:3]]


# ---- ingest


def test_chunker():
    assert ingest.chunks_of("  alpha\n\n beta\t gamma  ", 20, 0) == ["alpha\n\nbeta gamma"]
    assert ingest.chunks_of("   ", 20, 0) == [] == ingest.chunks_of(None, 20, 0)
    out = ingest.chunks_of("One two three four. Five six seven. Eight nine ten eleven.", 8, 5)
    assert all(ingest.count_tokens(c) <= 8 for c in out) and out[0] == "One two three four."
    assert out[1].endswith("Five six seven.")
    long = "word " * 100
    assert " ".join(ingest.chunks_of(long, 10, 0)).split() == long.split()


def test_chunks_repeat_a_short_last_sentence(spark):
    docs = spark.createDataFrame([(1, "Alpha beta gamma delta. Court. Epsilon zeta eta theta iota.")], "doc_id long, text string")
    got = [r["content"] for r in ingest.chunked(docs, most=8, overlap=3).orderBy("chunk_index").collect()]
    assert got == ["Alpha beta gamma delta. Court.", "Court. Epsilon zeta eta theta iota."]


def test_decoding(spark, tmp_path):
    for name, data in {"a.txt": "﻿é ok".encode(), "b.TXT": "caf\xe9 \x80".encode("latin-1"), "c.pdf": b"x", "e.txt": b" \n "}.items():
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[1]: (r["text"], r["error_code"]) for r in ingest.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("é ok", None), "b.TXT": ("café €", None), "c.pdf": (None, "UNSUPPORTED"), "e.txt": (None, "NO_TEXT")}


def test_missions(spark, tmp_path):
    m = reports.generated_missions(spark, 10)
    rows = m.collect()
    assert len(rows) == 10 and {len(r["documents"]) for r in rows} == {2, 3, 4} and all(len(set(r["technologies"])) == 3 for r in rows)
    assert m.collect() == rows and reports.generated_missions(spark, 10, 7).collect() != rows
    for r in rows:
        (tmp_path / f"{r['id']}.json").write_text(json.dumps(r.asDict(recursive=True)))
    (tmp_path / "manifest.json").write_text("{}")
    back = ingest.read_missions(spark, str(tmp_path), m.schema)
    assert back.count() == 10 and ingest.exploded_documents(back).count() == sum(len(r["documents"]) for r in rows)


def test_upsert_keeps_ids(spark):
    old = spark.createDataFrame([(1, "a", 1), (5, "b", 2)], "id long, title string, v int")
    new = spark.createDataFrame([("b", None), ("c", 4), ("d", 5)], "title string, v int")
    got = {r["title"]: (r["id"], r["v"]) for r in tables.upsert(old, new, "title", "id").collect()}
    assert got["a"] == (1, 1) and got["b"] == (5, None) and {got["c"][0], got["d"][0]} == {6, 7}


def test_text_cleanup(spark):
    assert value(spark, text.cleaned(F.col("t")), t="Titre\r\n\r\n  Besoin   cloud  ") == "Titre\n\nBesoin cloud"
    assert value(spark, text.slug(F.col("t")), t=" Étude à l'échelle ") == "etude-a-l-echelle"
    assert value(spark, text.reference_code(F.col("t")), t="voir ava - 12") == "AVA-12"


# ---- grounding

SOFT, LIGATURE = "per­formance", "eﬃcace"


def test_quote_ranges():
    assert grounding.quote_range(f"un {LIGATURE} exem-\nple", "efficace exemple") == (3, len(f"un {LIGATURE} exem-\nple"))
    body = f"A {SOFT} mesurée"
    assert grounding.quote_range(body, "performance mesurée") == (2, len(body))
    typo = "Les données des années précédantes restent consultables pendant dix ans."
    a, b = grounding.quote_range(typo, "données des années précédentes restent consultables")
    assert "données des années précédantes restent consultables" in typo[a:b]
    assert grounding.quote_range("Il y a 12 agents ici et ailleurs.", "Il y a 13 agents ici et ailleurs.") is None
    assert grounding.quote_range("abc", "") is None is grounding.quote_range(None, "x")
    long = "Une phrase avant. " * 300 + "Le socle retenu combine un portail unique, une base partagée et des flux signés. " + "Une phrase après. " * 300
    a, b = grounding.quote_range(long, "le socle retenu combine un portail unique, une base commune et des flux signés")
    assert long[a:b].strip() == "Le socle retenu combine un portail unique, une base partagée et des flux signés."
    assert grounding.quote_range(long, "le socle retenu remplace douze outils par une base commune et des flux lents") is None
    assert grounding.quote_range(long, "portail unique retenu signés flux des base une combine socle") is None
    assert grounding.quote_range("La clause complète tient, sans fin", "la clause complète tient.") == (0, 24)


def test_ranges_in_spark(spark):
    rows = [(1, "Le Texte est là", "texte est"), (2, f"x {LIGATURE} y", "efficace"), (3, "rien", "absent"), (4, None, "x"), (5, "İx texte", "texte")]
    got = {r["i"]: (r["source_start"], r["source_end"]) for r in grounding.located(spark.createDataFrame(rows, "i int, content string, quote string")).collect()}
    assert got == {1: (3, 12), 2: (2, 2 + len(LIGATURE)), 3: (None, None), 4: (None, None), 5: (3, 8)}


def test_grounded_answers(spark):
    payload = lambda *e: json.dumps({"status": "answered", "answer": "ok", "coverage": [{"criterion": "c", "evidence": [{"source": s, "quote": q} for s, q in e]}]})
    answers = [(1, payload((1, "le budget est de 12 euros"))), (2, "free text"), (3, payload((2, "le budget est de 12 euros"))), (4, payload((1, "le budget est de 13 euros"))), (5, json.dumps({"status": "insufficient", "answer": "", "coverage": []}))]
    contexts = [(q, 1, 70 + q, "Ici le budget est de 12 euros.", 0.8, None) for q in range(1, 6)]
    got = {r["query_id"]: r for r in grounding.ground_answers(spark.createDataFrame(answers, "query_id long, payload_json string"), spark.createDataFrame(contexts, "query_id long, source_index int, chunk_id long, content string, vector_score double, relevance_score double")).collect()}
    assert got[1]["diagnostic"] is None and got[1]["confidence"] == 0.8 and (got[1]["spans"][0]["source_start"], got[1]["spans"][0]["source_end"]) == (4, 29)
    assert [got[q]["diagnostic"] for q in (2, 3, 4, 5)] == ["INVALID_CITATION_FORMAT", "UNSUPPORTED_ANSWER", "UNSUPPORTED_ANSWER", "NO_RELEVANT_EVIDENCE"]
    assert {r["diagnostic"]: r["n"] for r in grounding.diagnostics(spark.createDataFrame([(r["diagnostic"],) for r in got.values()], "diagnostic string")).collect()}["UNSUPPORTED_ANSWER"] == 2


def test_alternatives_and_catalogue(spark):
    q = spark.createDataFrame([(1, "Quel outil (Kafka ou Pulsar) ?"), (2, "Quel outil (Kafka, par exemple) ?"), (3, "Sans liste")], "query_id long, query string")
    e = spark.createDataFrame([(1, "on a choisi RabbitMQ"), (2, "rien"), (3, "rien")], "query_id long, content string")
    assert {r["query_id"]: r["absent"] for r in grounding.alternatives_absent(q, e).collect()} == {1: True, 2: False, 3: False}
    e = spark.createDataFrame([(1, "un cluster KAFKA.")], "query_id long, content string")
    assert not grounding.alternatives_absent(q, e).where("query_id = 1").first()["absent"]
    c = spark.createDataFrame([(1, 5, 1, "n", 2, "Texte", 1), (1, 6, 1, "n", 2, " texte ", 2), (1, 7, 1, None, 2, "autre", 3), (1, 8, None, None, None, "libre", 4), (1, 9, 1, "n", 3, " ", 5)], "query_id long, chunk_id long, document_id long, document_name string, page int, content string, rank int")
    assert [(r["source_index"], r["chunk_id"]) for r in grounding.evidence_catalogue(c).orderBy("source_index").collect()] == [(1, 5), (2, 8)]


def test_free_answers(spark):
    rows = [(1, "Le budget est fixe [1]", ["Ici le budget est fixe."]), (2, "Autre chose [1]", ["Ici"]), (3, "Sans marque", ["x"]), (4, "le budget [1] et plus", ["le budget"])]
    got = {r["query_id"]: r["supported"] for r in grounding.answer_supported(spark.createDataFrame(rows, "query_id long, answer string, sources array<string>")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}


# ---- extraction


@pytest.mark.parametrize(
    ("query", "want"),
    [('Quel est le budget du projet « Refonte Alpha » ?', "Refonte Alpha"), ("Dans le projet Nova Banque, quel est le délai ?", "Nova Banque"), ("Quel budget pour Atlas 2 ?", "Atlas 2"), ("Statut de ava-012", "AVA-012"), ("quel est le délai", None)],
)
def test_project_title(spark, query, want):
    assert value(spark, extraction.project_title(F.col("q")), q=query) == want


@pytest.mark.parametrize(("query", "want"), [("Donne la fiche d'identité", "identity"), ("Quel budget ?", "budget"), ("Qui est chargé du lot ?", "person"), ("Quelle architecture cible ?", "technologies"), ("Bonjour", None)])
def test_intent(spark, query, want):
    assert value(spark, extraction.intent(F.col("q")), q=query) == want


def test_extraction_tables(spark):
    doc = "Nom: Fatou Sy; Rôle: Responsable données; Entité: DSI; Charge: 50 %; Période: 2024\nNom: Al Bo; Rôle: Chef; Entité: X; Charge: 10 %; Période: 2023"
    cost = "Poste: Données, responsable; Responsable / équipe: Fatou Sy; Jours: 112; TJM moyen: 800; Montant HT: 89 600"
    docs = spark.createDataFrame([(1, 1, doc), (1, 2, cost), (2, 3, cost)], "document_id long, chunk_id long, content string")
    assert [(r["name"], r["charge"]) for r in extraction.team_rows(docs).orderBy("name").collect()] == [("Al Bo", "10 %"), ("Fatou Sy", "50 %")]
    assert [(r["name"], r["days"], r["amount"]) for r in extraction.person_budget(docs).collect()] == [("Fatou Sy", "112", "89 600")]
    money = spark.createDataFrame([(7, "Budget engagé : 4 865 000 €"), (7, "Consommé à date : 4 794 220 €"), (8, "rien")], "document_id long, content string")
    assert [tuple(r) for r in extraction.budget_totals(money).collect()] == [(7, 4865000, 4794220, 70780)]


def test_markdown_rows(spark):
    docs = spark.createDataFrame([(1, "| Nom | Rôle |\n|---|---|\n| A | b |\n| seul |\n\ntexte\n| X | Y |")], "doc_id long, text string")
    assert [r["evidence"] for r in ingest.markdown_rows(docs).orderBy("line").collect()] == ["Nom: A; Rôle: b", "| seul |", "Nom: X; Rôle: Y"]


# ---- proposals


def test_requirements_have_exact_places(spark):
    text_ = "Le portail doit garantir la sécurité des données.\nLe portail doit garantir la sécurité des données. Court. Le délai est de six mois fermes."
    rows = proposal.requirements(spark.createDataFrame([(1, text_)], "brief_id long, description string")).orderBy("need").collect()
    assert len(rows) == 3 and all(text_[r["start_offset"] : r["end_offset"]] == r["text"] for r in rows)
    assert rows[0]["start_offset"] < rows[1]["start_offset"] and [r["category"] for r in rows] == ["security", "security", "planning"]


def test_structure_and_score(spark):
    s = spark.createDataFrame([(1, 1, "A", [["x", "y"], ["z", "w"]]), (1, 2, "B", None), (2, 1, "B", [["x"], ["y", "z"]]), (2, 2, "A", None)], "proposal_id int, position int, title string, rows array<array<string>>")
    assert {r["proposal_id"]: (r["in_order"], r["rectangular"]) for r in proposal.structure_violations(s, ["A", "B"]).collect()} == {1: (True, True), 2: (False, False)}
    w = spark.createDataFrame([(1, 1), (0, 2)], "hard int, soft int")
    assert proposal.draft_score(w).first()["score"] == 0.25


# ---- evaluation, audit, jobs


def test_answer_scores(spark):
    rows = spark.createDataFrame([(1, "42 minutes contre 6 heures", "42 minutes"), (2, "le portail rapide", "un portail tres rapide")], "i int, expected string, answer string")
    got = {r["i"]: r for r in evaluate.answer_scores(rows).collect()}
    assert not got[1]["correct"] and got[1]["missing_numbers"] == 1 and got[2]["correct"]


def test_containment_of_short_and_long_quotes(spark):
    docs = spark.createDataFrame([(1, "xa b c d e f g hx"), (2, "tiny bits"), (3, None)], "doc_id long, text string")
    quotes = spark.createDataFrame([(1, "a b c d e f g h"), (2, "ny bi"), (3, "b c d e f g x"), (4, None), (5, "")], "item_id long, quote string")
    assert {tuple(r) for r in evaluate.containment(docs, quotes).collect()} == {(1, 1), (2, 2)}


def test_dashboard(spark):
    rows = [(1, 1, "SEARCH", "SUCCESS", 200.0, "2024-01-02 10:00:00"), (2, 1, "SEARCH", "SUCCESS", 300.0, "2024-01-02 11:00:00"), (3, 1, "X", "ERROR", 100.0, "2024-01-03 00:00:00"), (4, 1, "X", "SUCCESS", 382.2, "2024-01-05 00:00:00")]
    log = spark.createDataFrame(rows, "id long, user_id long, action string, status string, duration_ms double, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    got = audit.dashboard(log, "2024-01-01", 3).orderBy("day").collect()
    assert len(got) == 7 and got[0]["total"] == 0 and {(r["period_total"], r["success_rate"], r["avg_ms"]) for r in got} == {(4, 75.0, 245.6)}
    assert audit.summary(log.limit(0)).first().asDict() == {"total": 0, "successes": 0, "errors": 0, "avg_ms": 0.0}


def test_job_lifecycle(spark):
    def events(job, *kinds):
        return [(job, k, f"2024-01-01 00:00:{i:02d}", i) for i, k in enumerate(kinds)]

    rows = events(1, "submit", "cancel", "start") + events(2, "submit", "start", "succeed") + events(3, "submit", "start", "fail") + events(4, "submit", "start", "fail", "start", "fail", "start", "fail") + events(5, "submit", "start", "cancel", "succeed")
    df = spark.createDataFrame(rows, "job_id int, event string, event_ts string, event_id int").withColumn("event_ts", F.col("event_ts").cast("timestamp"))
    got = {r["job_id"]: (r["status"], r["attempts"]) for r in jobs.lifecycle(df).collect()}
    assert got == {1: ("cancelled", 0), 2: ("completed", 1), 3: ("queued", 1), 4: ("failed", 3), 5: ("cancelled", 1)}


def test_golden_sources(spark, tmp_path):
    (tmp_path / "g.md").write_text("# T\n\n## 1. Un\n1. **FAIT** — Quel délai ? > six mois — p. 3, 4 et 5\n2. **ABS** — Qui ? > inconnu\n\n## 2. Deux\n3. **FAIT** — Où ? > Dakar — p. 9\n")
    got = reports.golden_markdown(spark, str(tmp_path / "g.md")).orderBy("number").collect()
    assert [(r["section"], r["number"], r["family"], r["expected"], r["pages"]) for r in got] == [(1, 1, "FAIT", "six mois", [3, 4, 5]), (1, 2, "ABS", "inconnu", []), (2, 3, "FAIT", "Dakar", [9])]
    (tmp_path / "g.json").write_text(json.dumps({"cases": [{"case_id": "a", "query": "q", "should_abstain": False, "expected_evidence": []}]}))
    assert reports.golden_json(spark, str(tmp_path / "g.json")).first()["case_id"] == "a"
    rows = spark.createDataFrame([("a", "x", 0.5), ("a", "y", None), ("b", "x", 1.0)], "case_id string, mode string, v double")
    assert [r["line"] for r in reports.markdown_summary(rows, "case_id", "mode", "v", ["x", "y"]).orderBy("case_id").collect()] == ["| a | 0.5 | - |", "| b | 1.0 | - |"]
    reports.json_report(rows, str(tmp_path / "out"))
    reports.csv_summary(rows, str(tmp_path / "csv"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3 == spark.read.option("header", True).csv(str(tmp_path / "csv")).count()


def test_stream_equals_batch_over_files_that_arrive(spark, tmp_path):
    folder = str(tmp_path / "log")
    rows = spark.createDataFrame([(i, ["SUCCESS", "ERROR"][i % 2], f"2024-01-0{1 + i % 3} 05:00:00") for i in range(20)], "id int, status string, at string").withColumn("created_at", F.col("at").cast("timestamp"))
    rows.repartition(4).write.parquet(folder)
    live = activity.drained(activity.daily(activity.stream(spark, folder)))
    assert {tuple(r) for r in live.collect()} == {tuple(r) for r in audit.daily(rows).collect()}


def test_quality_functions(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h " * 3), (2, "x y z")], "i int, text string")
    assert {r["i"]: r["ratio"] for r in quality.repeated_gram_ratio(docs, "i", 8).collect()} == {1: 1.0, 2: 0.0}
    assert value(spark, quality.truncated_sentences(F.col("t"), 3), t="a b c d. e f.") == "a b c… e f."
    assert value(spark, quality.strict_json(F.col("t")), t='```{"a": 1}```') is False


def test_streamed_jobs_equal_the_batch(spark, tmp_path):
    kinds = ["submit", "start", "fail", "start", "succeed", "submit", "cancel", "start"]
    rows = [(i % 5, kinds[(i // 5 + i % 3) % 8], f"2024-01-01 00:{i:02d}:00", i) for i in range(40)]
    df = spark.createDataFrame(rows, "job_id long, event string, at string, event_id long").withColumn("event_ts", F.col("at").cast("timestamp")).drop("at")
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    live = activity.drained(activity.job_states(activity.stream(spark, str(tmp_path / "e"))), "update")
    assert {(r["job_id"], r["status"], r["attempts"]) for r in live.collect()} == {(r["job_id"], r["status"], r["attempts"]) for r in jobs.lifecycle(df).collect()}


def test_facts_and_rows_by_label(spark):
    doc = "Client: ACME; Statut: clos\nIndicateur: délai; Avant: 6 h; Après: 42 min; Évolution: -88 %\nCouche données: PostgreSQL; Objectif: SLA; Cible: 99 %"
    docs = spark.createDataFrame([(1, 1, doc)], "document_id long, chunk_id long, content string")
    assert [(r["indicator"], r["before"], r["after"], r["change"]) for r in extraction.metric_rows(docs).collect()] == [("délai", "6 h", "42 min", "-88 %")]
    assert [(r["layer"], r["technology"]) for r in extraction.architecture_rows(docs).collect()] == [("données", "PostgreSQL")]
    assert [(r["objective"], r["target"]) for r in extraction.objective_rows(docs).collect()] == [("SLA", "99 %")]
    q = spark.createDataFrame([(1, "Donne la fiche d'identité"), (2, "Bonjour")], "query_id long, query string")
    c = spark.createDataFrame([(1, 1, doc), (1, 2, "Client: ACME"), (2, 3, doc)], "query_id long, chunk_id long, content string")
    assert {(r["query_id"], r["label"], r["value"], r["chunk_id"]) for r in extraction.facts(q, c).collect()} == {(1, "client", "ACME", 1), (1, "status", "clos", 1)}


def test_lines_and_criteria(spark):
    src = ["Le délai du portail passe de 6 heures à 42 minutes.", "Rien"]
    rows = [(1, "Le délai du portail est de 42 minutes [1]", src), (2, "Le délai du portail est de 43 minutes [1]", src), (3, "Le délai du portail", src), (4, "", src)]
    got = {r["query_id"]: r["supported"] for r in grounding.lines_supported(spark.createDataFrame(rows, "query_id long, answer string, sources array<string>")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}
    crit = spark.createDataFrame([(1, "délai du portail", src), (2, "budget du portail", src), (3, "délai 7 heures", src)], "query_id long, criterion string, quotes array<string>")
    assert {r["query_id"]: r["supported"] for r in grounding.criteria_supported(crit, {"money": ["budget", "montant"]}).collect()} == {1: True, 2: False, 3: False}


def test_budget_and_leaks(spark):
    s = spark.createDataFrame([("Sans source du tout ici. Avec source [1] deux trois. Fin [2] là.", ["a", "b", "c", "d"])], "body string, bullets array<string>")
    got = proposal.within_budget(s, 8).first()
    assert got["bullets"] == ["a", "b", "c"] and got["body"] == "Avec source [1] deux trois. Fin [2] là."
    sec = spark.createDataFrame([(1, "Coût de 120 jours. En référence, 300 jours. Durée 7 mois.", "120 et 300 jours, 7 mois")], "section_id long, body string, reference string")
    assert [(r["section_id"], r["value"]) for r in proposal.leaked_values(sec, spark.createDataFrame([("durée 7",)], "brief string")).collect()] == [(1, "120")]


def test_chunk_text_in_sql_and_mission_ingest(spark, tmp_path):
    ingest.register_chunk_text(spark)
    rows = spark.sql("SELECT * FROM chunk_text('One two three four. Five six seven.', 5, 0, 5, 0)").collect()
    assert [(r["chunk_index"], r["content"]) for r in rows] == [(0, "One two three four."), (1, "Five six seven.")]
    m = reports.generated_missions(spark, 4)
    for r in m.collect():
        (tmp_path / f"{r['id']}.json").write_text(json.dumps(r.asDict(recursive=True)))
    total = ingest.ingest_missions(spark, str(tmp_path), m.schema, str(tmp_path / "out")).first()
    assert total["missions"] == 4 and total["chunks"] >= 4


def test_text_more(spark):
    assert value(spark, text.renumbered(F.col("t"), F.create_map(F.lit(3), F.lit(1))), t="a [3] b [4].") == "a [1] b ."
    assert value(spark, text.blocks(F.col("t")), t="A <!-- x --> b ## T\n\nc") == ["A  b", "## T", "c"]
    long = "un deux trois quatre cinq six sept huit neuf dix, " + "mot " * 20 + "fin."
    assert len(value(spark, text.segmented(F.col("t")), t=long)) == 2
    assert value(spark, text.answer_mode(F.col("t")), t="Quelle équipe projet ?") == "team"
