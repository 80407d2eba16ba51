"""Judging operators on known cases."""

from pyspark.sql import functions as F

from folio.operators import extraction, judging


def one(spark, **values):
    rows = [tuple(values.values())]
    return spark.createDataFrame(rows, ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))


def test_named_projects(spark):
    rows = [
        ("Quel est le budget du projet LEXFLOW ?", "2023_LEXFLOW_note.pdf", None, "", True),
        ("Quel est le budget du projet LEXFLOW ?", "LEXFLOWS.pdf", None, "autre", False),
        ("Quel est le budget du projet ORION WMS ?", "wms-orion.pdf", None, "", True),
        ("Résultats du projet «Orion — Clientt» ?", "orion_client.pdf", None, "", True),
        ("Quel est le budget du projet ORION WMS ?", "x.pdf", "Orion", "le WMS retenu", True),
        ("Combien de jours ?", "LEXFLOW.pdf", None, "", False),
        (None, None, None, None, False),
    ]
    df = spark.createDataFrame(rows, "q string, name string, title string, body string, want boolean")
    got = df.select("want", judging.names_project(F.col("q"), F.col("name"), F.col("title"), F.col("body")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_brief_scores(spark):
    base = {"status": 200, "to_refuse": False, "coverage": 1.0, "n_sections": 19, "expects_evidence": True, "n_sources": 2, "n_matching": 1, "evidence_passed": True, "diagnostic": None}
    none = {"expects_evidence": False, "n_sources": 0, "n_matching": 0, "evidence_passed": False, "diagnostic": "NO_RELEVANT_PDF_EVIDENCE"}
    cases = [({}, 100), ({"n_matching": 0}, 85), ({"n_sources": 0, "n_matching": 0}, 70), (none, 100), (none | {"n_sources": 1}, 20), ({"coverage": 0.5, "n_sections": 10}, 65), ({"status": 500}, 0), ({"to_refuse": True}, 0), ({"to_refuse": True, "status": 422}, 100)]
    for change, want in cases:
        row = one(spark, **(base | change))
        assert row.select(judging.brief_score(row)).first()[0] == want, change


def test_failure_causes_in_order(spark):
    good = {"request_error": None, "protocol_ok": True, "provenance_ok": True, "citation_correct": True, "answer_correct": True}
    steps = [("style", {}), ("answer", {"answer_correct": False}), ("citation", {"citation_correct": False}), ("provenance", {"provenance_ok": False}), ("protocol", {"protocol_ok": False}), ("request", {"request_error": "timeout"})]
    seen = {}
    for want, change in steps:
        seen |= change
        row = one(spark, **(good | seen))
        assert row.select(judging.failure_cause(row)).first()[0] == want


def test_draft_scores(spark):
    rows = [("a", None), ("b", "uncited claim"), ("b", "too long"), *[("c", "uncited claim")] * 6, *[("d", "too long")] * 3]
    got = {r["draft"]: (r["score"], r["passed"]) for r in judging.draft_scores(spark.createDataFrame(rows, "draft string, warning string"), "draft").collect()}
    assert got == {"a": (1.0, True), "b": (0.35, False), "c": (0.0, False), "d": (0.85, True)}


def test_confidence_of_citations(spark):
    answers = spark.createDataFrame([(1, "x [1] y [2]"), (2, "x [3]"), (3, "none"), (4, "a [1]")], "query_id int, answer string")
    sources = spark.createDataFrame([(1, 1, 0.8, 0.1), (1, 2, None, 0.4), (2, 1, 0.9, 0.9), (4, 1, 1.7, None)], "query_id int, source_index int, vector_score double, relevance_score double")
    assert {r[0]: r[1] for r in judging.confidence(answers, sources).collect()} == {1: 0.6, 2: 0.0, 3: 0.0, 4: 1.0}


def test_identity_sentence(spark):
    chunks = [(1, 7, "Fiche LEXFLOW."), (2, 7, "Le contact de LEXFLOW est ici pour vous. Objet du document : présenter LEXFLOW à tous."), (3, 7, "LEXFLOWS ne compte pas comme un mot entier."), (4, 8, "LEXFLOW dans un autre document que le premier.")]
    own = spark.createDataFrame([(1, 1, 7, "LEXFLOW"), (2, 1, 7, "ORION"), (3, 1, 7, "")], "query_id int, chunk_id int, document_id int, anchor string")
    got = judging.identity_sentence(own, spark.createDataFrame(chunks, "chunk_id int, document_id int, content string")).collect()
    assert [(r["query_id"], r["chunk_id"], r["sentence"], r["score"]) for r in got] == [(1, 2, "Objet du document : présenter LEXFLOW à tous.", 10)]


def test_grounded_and_cards(spark):
    rows = [("no", 0, True, True), ("no", 1, True, False), ("yes", 0, True, False), ("yes", 1, False, True), ("no", 1, False, False), ("yes", 0, False, False)]
    df = spark.createDataFrame(rows, "a string, n int, abstain boolean, want boolean")
    assert all(r[0] == r[1] for r in df.select("want", judging.grounded(F.col("a"), F.col("n"), F.col("abstain"), "no")).collect())
    cards = spark.createDataFrame([("[1] [2]", [2, 1], True), ("[1] [1]", [1], True), ("[1]", [1, 1], False), ("[1]", [1, 2], False), ("none", [], False)], "a string, c array<int>, want boolean")
    assert all(r[0] == r[1] for r in cards.select("want", judging.cards_match(F.col("a"), F.col("c"))).collect())


def test_team_rows_of_both_layouts(spark):
    text = "Nom: Ada Roy; Rôle: chef; Entité: A; Charge: 10 j; Période: 2022 Nom: Bo Li; Rôle: dev; Entité: B; Charge / Période: 5 j · mars à mai ## Suite\nPoste: chef; Responsable / équipe: Ada Roy; Jours: 3; TJM moyen: 500; Montant HT: 1 500 € Poste: dev; Responsable / équipe: Bo Li; Jours: 2; TJM moyen: 400; Montant HT: 800 €"
    docs = spark.createDataFrame([(1, 1, text)], "document_id int, chunk_id int, content string")
    got = sorted((r["name"], r["charge"], r["period"]) for r in extraction.team_rows(docs).collect())
    assert got == [("Ada Roy", "10 j", "2022"), ("Bo Li", "5 j", "mars à mai")]
    assert sorted((r["post"], r["amount"]) for r in extraction.budget_rows(docs).collect()) == [("chef", "1 500 €"), ("dev", "800 €")]


def test_identity_sentences_of_a_long_document(spark):
    """Two hundred chunks begin with one name: each gets the best other chunk's sentence, and what is broadcast or made on
    the way has no content a word."""
    chunks = [(i, 7, f"Nova {'is the very' if i in (3, 5) else 'has some very'} long line number {i} of it. " + " ".join(f"w{i}x{j}" for j in range(40))) for i in range(200)]
    ids = [(i, i, 7, "Nova") for i in range(0, 200, 2)] + [(3, 3, 7, "nova")]
    rows = judging.identity_sentence(
        spark.createDataFrame(ids, "query_id long, chunk_id long, document_id long, anchor string"), spark.createDataFrame(chunks, "chunk_id long, document_id long, content string"), mark="is the", unwanted=["@"]
    )
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=merge") == 2 and "[], false, [word" not in plan  # what the words are made of is left behind
    got = {(r["query_id"], r["chunk_id"], r["score"]) for r in rows.collect()}
    assert got == {(i, 5 if i == 3 else 3, 10) for i, *_ in ids}
