"""Secrets after name=, in mixed alphabets, and among very many words."""

import random

from folio.llm import secret_scan

from .helpers import documents

RNG = random.Random(23)
B62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def drawn(alphabet, n):
    return "".join(RNG.choice(alphabet) for _ in range(n))


def found(spark, rows):
    got = secret_scan.secret_spans(documents(spark, rows)).collect()
    return {r["doc_id"]: [rows[r["doc_id"]][int(s.split(":")[1]) : int(s.split(":")[2])] for s in r["spans"].split(",") if s.startswith("random")] for r in got if r["doc_id"] is not None}


def test_values_after_names(spark):
    values = [drawn(B62, n) for n in (40, 48, 56, 60)] + [drawn(B62 + "+/", 62) + "=="] + [drawn(B62 + "+/_-", 30) + "/_" + drawn(B62, 40)]
    names = ["aws_secret_access_key", "auth", "sig", "client_key", "x", "y"]
    rows = [f"see {n}={v} there" for n, v in zip(names, values)]
    assert found(spark, rows) == {i: [v] for i, v in enumerate(values)}
    masked = {r["doc_id"]: r["text"] for r in secret_scan.redact(documents(spark, rows)).collect()}
    assert masked == {i: f"see {n}=[SECRET] there" for i, n in enumerate(names)}


def test_secrets_among_very_many_words(spark):
    value = drawn(B62, 120)
    rows = [f"key {value} end"] + [" ".join(["internationalizationOfThings2" * 3] * 200)] * 300
    got = found(spark, rows)
    assert got[0] == [value] and not any(got[i] for i in got if i)
