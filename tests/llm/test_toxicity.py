"""Toxicity against a plain re-statement of its models, on all the defined cases, and by held-out accuracy."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import toxicity
from folio.llm.queries import QUERIES

from .helpers import documents, empty, texts, words


def plain_scores(rows, labels):
    """(doc_id, text) and (doc_id, toxic) to {place of the row: (score, mean ratio)}."""
    by = {}
    for i, y in labels:
        if i is not None and y is not None:
            by.setdefault(i, []).append(y)
    by = {i: sum(v) / len(v) for i, v in by.items()}
    crc = lambda i: zlib.crc32(str(i).encode())
    learn = lambda i: i is not None and crc(i) % 3 != 1
    link = lambda i: crc(i) // 3 % 4 == 0
    votes = {}
    for i, t in rows:
        if learn(i) and not link(i) and i in by:
            votes.setdefault(t or "", []).append((i, by[i]))
    c = [Counter(), Counter()]
    for t, pairs in votes.items():
        v = [y for _, y in pairs]
        y = int(sum(v) / len(v) >= 0.5)
        times = [i for i, _ in pairs].count(min(pairs)[0])
        for stem in toxicity.stems(t):
            for k in range(len(stem) + 1):
                c[y][stem[:k]] += times
    if not c[0] or not c[1]:
        return [(0.0, 0.0)] * len(rows)
    nodes = set(c[0]) | set(c[1])
    kids = [Counter(p[:-1] for p in nodes if p and c[y][p]) for y in (0, 1)]
    every = Counter(p[:-1] for p in nodes if p)
    letters = Counter(p[-1] for p in nodes if p)
    d = toxicity.DISCOUNT

    def freed(y, p):
        return d * kids[y][p] / c[y][p] if c[y][p] else 1.0

    def chance(y, p):
        q = p[:-1]
        n = c[0][q] + c[1][q]
        shared = max(c[0][p] + c[1][p] - d, 0) / n + d * every[q] / n * letters[p[-1]] / sum(letters.values())
        return (max(c[y][p] - d, 0) / c[y][q] if c[y][q] else 0) + freed(y, q) * shared

    def ratio(stem):
        out = 0.0
        for k in range(1, len(stem) + 1):
            if stem[:k] not in nodes:
                q = stem[: k - 1]
                return round(out + (math.log(freed(1, q) / freed(0, q)) if every[q] else 0), 9)
            out += math.log(chance(1, stem[:k]) / chance(0, stem[:k]))
        return round(out, 9)

    def features(text):
        s = toxicity.stems(text)
        n = max(1, sum(s.values()))
        r = {w: ratio(w) for w in s}
        beyond = [sum(k for w, k in s.items() if r[w] > level) for level in toxicity.LEVELS]
        top = sorted([max(v, 0) for v in r.values()] + [0, 0])[-2:]
        return [sum(k * r[w] for w, k in s.items()) / n, *map(math.log1p, beyond), *(math.sqrt(b / n) for b in beyond), sum(top) / 2]

    x = np.array([features(t or "") for _, t in rows])
    fit = [j for j, (i, _) in enumerate(rows) if learn(i) and link(i) and i in by]
    fit.sort(key=lambda j: rows[j][0])
    model = toxicity.link(x[fit], np.array([float(by[rows[j][0]] >= 0.5) for j in fit]))
    if model is None:
        return [(0.0, float(v)) for v in x[:, 0]]
    return [(1 / (1 + math.exp(-(v @ model[0] + model[1]))), float(v[0])) for v in x]


def labelled(n):
    out = []
    rows = texts()
    for i in range(n):
        t = rows[i % len(rows)] or ""
        out.append(f"{t} trash idiots idiot" if i % 3 == 0 else t)
    return out, [(i, int(i % 3 == 0)) for i in range(n)]


@pytest.mark.parametrize("head", [toxicity.HEAD, 5])
def test_equals_the_plain_models(spark, monkeypatch, head):
    monkeypatch.setattr(toxicity, "HEAD", head)
    monkeypatch.setattr(toxicity, "HELD", 300)
    given, y = labelled(150)
    docs = documents(spark, given, extra=True)
    labels = spark.createDataFrame([*y, (0, 1), (0, 0), (None, 1), (7, None)], "doc_id long, toxic long")
    got = toxicity.toxicity(docs, labels).collect()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = plain_scores(rows, [tuple(r) for r in labels.collect()])
    assert len(got) == len(rows)
    mine = sorted((r["doc_id"] is None, r["doc_id"] or 0, round(r["score"], 6), round(r["ratio"], 6)) for r in got)
    theirs = sorted((i is None, i or 0, round(s, 6), round(m, 6)) for (i, _), (s, m) in zip(rows, want))
    for a, b in zip(mine, theirs):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=2e-6) and a[3] == pytest.approx(b[3], abs=2e-6)
    assert {r["predicted"] for r in got} == {0, 1}
    assert all(r["held_out"] for r in got if r["doc_id"] is None)


def test_nothing_to_learn_and_nothing_to_score(spark):
    none = spark.createDataFrame([], "doc_id long, toxic long")
    got = toxicity.toxicity(documents(spark, ["a b", None, ""]), none)
    assert [(r["score"], r["predicted"]) for r in got.collect()] == [(0.0, 0)] * 3
    assert toxicity.toxicity(empty(spark), none).count() == 0


def test_rare_forms_are_judged_by_their_beginnings(spark):
    rng = random.Random(3)
    given = [" ".join(words(rng, 12) + ([f"zorkle{rng.choice('qwertyuiop')}s", f"zorkle{rng.choice('asdf')}"] if i % 2 else [])) for i in range(200)]
    given.append(" ".join([*words(rng, 12), "zorklexx", "zorklemm"]))  # forms that no row has
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic long")
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(documents(spark, given), labels).collect()}
    assert got[200] > 0.3 > max(got[i] for i in range(0, 200, 2))


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    got = QUERIES["op11_toxicity"](spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    n = {(r["toxic"], r["predicted"]): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] / (n[1, 1] + n[1, 0]) > 0.75 and n.get((0, 1), 0) / n[0, 0] < 0.01
    assert got.agg(F.count_distinct("doc_id")).first()[0] == got.count()
