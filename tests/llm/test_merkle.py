"""The manifest's trees and proofs against a plain re-statement, on all the defined cases."""

import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm import merkle

from .helpers import DOCS, documents, empty


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_leaf(r, text):
    return h(field(r["doc_id"]), field(r["source"]), field(r["lang"]), field(r["n_chars"]), field(text))


def climb(nodes):
    """The top, and for each node its siblings, before and after, level by level."""
    places, steps = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for i, p in enumerate(places):
            lo = p // 3 * 3
            steps[i].append(("".join(nodes[lo:p]), "".join(nodes[p + 1 : lo + 3])))
            places[i] = p // 3
        nodes = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], steps


def plain(rows):
    trees = {}
    for r in rows:
        text = r["text"]
        if r["doc_id"] is not None and text is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
            text = text.replace("\n", "")
        trees.setdefault(r["source"], []).append((r["doc_id"], plain_leaf(r, r["text"]), plain_leaf(r, text)))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    subroots = {}
    for s in order:
        trees[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        subroots[s] = climb([leaf for _, leaf, _ in trees[s]])
    root, above = climb([subroots[s][0] for s in order])
    out = []
    for s, top in zip(order, above):
        for (doc_id, leaf, other), own in zip(trees[s], subroots[s][1]):
            d = other
            for before, after in own + top:
                d = h(before, d, after)
            out.append((doc_id, leaf, subroots[s][0], root, h(*(b + a for b, a in own + top)), d, d == root))
    return out


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def mixed(spark):
    rows = [(i, f"line {i}\nand more\n" if i % 3 else None if i % 2 else "", ["en", None][i % 2], [None, "", "a", "b", "é", "hot"][min(i % 9, 5)], i) for i in range(90)]
    rows += [(3, "again", "en", "hot", 1), (3, "again", "en", "hot", 1), (None, "no\nid", None, None, None), (None, "none", None, "hot", None), (91, "alone", "en", "z", 5), (7, "x" * 100_000 + "\n", "fr", "a", 2)]
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("part, levels", [(20_000, 6), (7, 1), (1, 2)])
def test_equals_the_plain_tree(spark, monkeypatch, part, levels):
    monkeypatch.setattr(merkle, "PART", part)
    monkeypatch.setattr(merkle, "LEVELS", levels)
    docs = mixed(spark)
    got = merkle.tamper_check(docs.withColumns({"part": F.lit(1), "tree": F.lit("x"), "place": F.lit(2), "at": F.lit(3), "leaf": F.lit("y")}))
    same(got.collect(), plain(docs.collect()))
    assert {r["verified"] for r in got.collect()} == {True, False}


def test_many_sources_are_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BROADCAST_TREES", 2)
    monkeypatch.setattr(merkle, "BROADCAST_COORDINATES", 2)
    monkeypatch.setattr(merkle, "PART", 11)
    docs = mixed(spark)
    same(merkle.tamper_check(docs).collect(), plain(docs.collect()))


def test_one_row_and_none(spark):
    one = documents(spark, ["only\none"])
    ((doc_id, leaf, subroot, root, proof, folded, verified),) = merkle.tamper_check(one).collect()
    assert leaf == subroot == root and proof == h("") and verified == (folded == root)
    assert merkle.tamper_check(empty(spark)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28, 82])
def test_multiproof_is_the_least_union(n):
    rng = np.random.default_rng(n)
    for size in {1, (n + 1) // 2, n}:
        known = np.sort(rng.choice(n, size, replace=False))
        got = {(level, place) for level, places in merkle.missing(known, n) for place in places.tolist()}
        # What single proofs need, less what a leaf among the known lies under.
        want, below, places, count, level = set(), set(), set(known.tolist()), n, 0
        while count > 1:
            below |= {(level, p) for p in places}
            want |= {(level, m) for p in places for m in range(p // 3 * 3, min(count, p // 3 * 3 + 3))}
            places, count, level = {p // 3 for p in places}, -(-count // 3), level + 1
        assert got == want - below
        if size == n:
            assert not got


def test_chosen_documents_and_carried_proofs(spark, monkeypatch):
    monkeypatch.setattr(merkle, "PART", 13)
    docs = mixed(spark)
    made = merkle.manifest(docs, merkle.leaf({"text": merkle.tampered_text()}))
    chosen = spark.createDataFrame([(5,), (5,), (44,), (1000,)], "doc_id long")
    got = merkle.proofs(made, chosen=chosen, carried=True)
    want = [r for r in plain(docs.collect()) if r[0] in (5, 44)]
    same(got.drop("proof").collect(), want)
    for r in got.select("*", merkle.folded(F.col("leaf"), F.col("proof")).alias("led_to")).collect():
        assert r["led_to"] == r["root"] == made.root
    assert dict(got.dtypes)["proof"].startswith("array<struct") and isinstance(made.leaves.schema, T.StructType)
