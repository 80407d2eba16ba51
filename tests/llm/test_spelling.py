"""Spelling variants against a plain re-statement, on all the defined cases, with crowded buckets dealt out again."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import spelling

from .helpers import documents, empty


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    n = Counter()
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    out, forms = [], {}
    for w in n:
        others = [v for v in n if near(w, v)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        forms[w] = best if best and n[best] >= 10 * n[w] else None
        out.append([w, n[w], len(others), forms[w], n[forms[w]] if forms[w] else None])
    for row in out:
        at = row[0]
        while forms[at]:
            at = forms[at]
        row.append(at)
    return sorted(map(tuple, out))


def given():
    rng = random.Random(5)
    stems = ["".join(rng.choice("abcé") for _ in range(rng.randint(6, 9))) for _ in range(60)]
    rows = [None, "", "123 456", "ÀÉÖabcd àÉÖabcd", "Elephant elephant ELEPHANT " * 70, "elephan elephan elephantt elephantt", "elepha elepha elephants elephants"]
    for _ in range(60):
        words = []
        for _ in range(rng.randint(0, 60)):
            w = rng.choice(stems)
            k = rng.randrange(len(w))
            words.append([w, w, w, w[:k] + w[k + 1 :], w[:k] + rng.choice("abÿ") + w[k:], w[:k] + "b" + w[k + 1 :], w.upper()][rng.randrange(7)])
        rows.append(" ".join(words) + rng.choice(["", "×÷", "\n"]))
    return rows + [" ".join(stems * 400)]


@pytest.mark.parametrize("hot", [spelling.HOT, 2])
def test_equals_the_plain_search(spark, monkeypatch, hot):
    monkeypatch.setattr(spelling, "HELD", 50)
    docs = documents(spark, given()).withColumns({c: F.lit(1) for c in ("n", "m", "lo", "hi", "below", "word", "near")})
    got = spelling.variants(docs, hot=hot).select("word", "n", "n_near", "form", "form_n", "root")
    want = plain([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(map(tuple, got.collect())) == want
    assert any(r[3] for r in want) and any(r[2] > 3 for r in want)


def test_no_words(spark):
    assert spelling.variants(empty(spark)).count() == 0
    assert spelling.variants(documents(spark, [None, "", "short words here", "onlyonce"])).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_pairs_of_buckets(monkeypatch, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(spelling, "TOGETHER", rng.choice([3, 2048]))
    rows = sorted({(rng.randrange(3), "".join(rng.choice("abé") for _ in range(rng.randint(1, 6)))) for _ in range(rng.randint(2, 80))})
    a, b = spelling.near_pairs(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]))
    want = [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if rows[i][0] == rows[j][0] and near(rows[i][1], rows[j][1])]
    assert sorted(zip(a.tolist(), b.tolist())) == want


def test_each_pair_is_found_once(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(7, 9))) for _ in range(400)})
    rows = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    for hot in (5000, 3):
        got = [(r["word"], r["near"]) for r in spelling.pairs(rows, hot=hot).collect()]
        assert len(got) == len(set(got)) and sorted(got) == sorted((a, b) for a in words for b in words if near(a, b))
