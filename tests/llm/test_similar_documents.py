"""Near-dedup by the similarity of five-word shingles, against plain Python."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from folio.llm import simhash_dedup

from .helpers import documents, empty, words
from .test_documents_ops import WORD


def shingles(text, k):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def jaccard(a, b):
    a, b = shingles(a, 5), shingles(b, 5)
    return len(a & b) / len(a | b) if a | b else 1.0


def most(hashes):
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes))


def plain_sketch(text):
    full, step = 2**64 - 1, 0x9E3779B97F4A7C15

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & full
        x = (x ^ x >> 27) * 0x94D049BB133111EB & full
        return x ^ x >> 31

    def named(shingle):
        total = 0
        for word in shingle.split(" "):
            total = (total * step + xxhash.xxh64_intdigest(word.encode())) & full
        return mixed(total)

    five = [named(s) for s in shingles(text, 5)]
    return most([named(s) for s in shingles(text, 1)]), [most([mixed(x + k * step & full) for x in five]) for k in range(1, 9)]


def plain_similar(rows):
    """doc_id and text to the least doc_id of each row's group, in order."""
    known, sets = {}, {t: shingles(t, 5) for _, t in rows}
    prints = [(*(known.setdefault(t or "", None) or known.update({t or "": plain_sketch(t)}) or known[t or ""]), sets[t]) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (a, x, s) in enumerate(prints):
        for j in range(i):
            b, y, u = prints[j]
            similar = s == u or 5 * len(s & u) >= 4 * len(s | u)
            if similar and (a ^ b).bit_count() <= 8 and sum((p ^ q).bit_count() for p, q in zip(x, y)) <= 102:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [least.get(root(i)) for i in range(len(rows))]


def edited(rng, w, n):
    w = list(w)
    for k in rng.sample(range(len(w)), n):
        w[k] = "changed" + str(k)
    return " ".join(w)


def families():
    rng = random.Random(4)
    rows = []
    for _ in range(25):
        w = words(rng, rng.randint(120, 400))
        rows += [" ".join(w), edited(rng, w, 1), edited(rng, w, len(w) // 80), " ".join(w[: len(w) // 2] + words(rng, len(w)))]
    return rows


@pytest.mark.parametrize("hot", [4000, 60])
def test_similar_documents_go(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash_dedup, "HOT", hot)
    docs = documents(spark, extra=True).unionByName(documents(spark, families()).selectExpr("doc_id + 1000 doc_id", "text", "lang", "source", "n_chars"), allowMissingColumns=True)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    groups = plain_similar(rows)
    kept = simhash_dedup.keep_first_similar(docs)
    assert kept.columns == docs.columns
    got = Counter(r["doc_id"] for r in kept.select("doc_id").collect())
    assert got == Counter({g: 1 for g in groups if g is not None} | {None: 1})
    for i, (_, a) in enumerate(rows[-100:]):  # against the similarity itself, by a margin
        for (_, b), g in zip(rows[-100:][:i], groups[-100:]):
            similarity = jaccard(a, b)
            if similarity >= 0.8:
                assert groups[-100:][i] == g
            if similarity == 0:
                assert groups[-100:][i] != g
    assert simhash_dedup.keep_first_similar(empty(spark)).count() == 0


def spans(edges, n):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, y in edges:
        parent[root(x)] = root(y)
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("n", [40, 240])
def test_bucket_gives_a_forest_of_candidates_then_the_nearest(n):
    rng = np.random.default_rng(1)
    leads = rng.integers(0, 2**62, 12, dtype=np.uint64).repeat(n // 12 + 1)[:n] ^ (np.uint64(1) << rng.integers(0, 60, n, dtype=np.uint64))
    base = rng.integers(0, 2**62, (n, 8), dtype=np.uint64)  # three sketches to each lead
    kind = np.arange(n) // (n // 12 + 1) * 3 + np.arange(n) % 3
    wide = base[kind] ^ (np.uint64(1) << rng.integers(0, 60, (n, 8), dtype=np.uint64))
    names = rng.permutation(n).astype(np.uint64)
    alone = names.copy()
    a, b = simhash_dedup.candidates(names, leads, wide, alone, [[]] * n, 8, 110, None, [])
    of = dict(zip(names.tolist(), kind.tolist()))
    assert len(a) == n - len(set(kind.tolist())) and all(of[x] == of[y] for x, y in zip(a.tolist(), b.tolist()))
    root = spans(zip(a.tolist(), b.tolist()), n)
    assert len({root[x] for x in names.tolist()}) == len(set(kind.tolist()))
    # All pairs, once there is room for them; less those refused; none within a group.
    every = {frozenset((x, y)) for x in of for y in of if x < y and of[x] == of[y]}
    a, b = simhash_dedup.candidates(names, leads, wide, alone, [[]] * n, 8, 110, n, [])
    assert {frozenset(p) for p in zip(a.tolist(), b.tolist())} == every and len(a) == len(every)
    gone = {p for p in every if sum(p) % 3 == 0}
    refused = [[y for p in gone if x in p for y in p if y != x] for x in names.tolist()]
    a, b = simhash_dedup.candidates(names, leads, wide, alone, refused, 8, 110, n, [])
    assert {frozenset(p) for p in zip(a.tolist(), b.tolist())} == every - gone
    a, b = simhash_dedup.candidates(names, leads, wide, kind.astype(np.uint64), [[]] * n, 8, 110, n, [])
    assert not len(a)
    # Pairs that agree on the bits of an earlier mask are another bucket's.
    a, b = simhash_dedup.candidates(names, leads, wide, alone, [[]] * n, 8, 110, n, [255])
    low = dict(zip(names.tolist(), (leads & np.uint64(255)).tolist()))
    assert {frozenset(p) for p in zip(a.tolist(), b.tolist())} == {p for p in every if len({low[x] for x in p}) == 2}


def test_links_on_the_given_table_against_all_pairs(spark):
    """Of all pairs of different texts at 0.8 or more, at least nine in ten are in one group; and each group is held
    together by such pairs alone."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    rows, named = simhash_dedup._labelled(simhash_dedup.sketches(docs), lambda r, p: simhash_dedup._verified(docs, r, p, 8, 4000, 102, 5, 0.8))
    label = {r["doc_id"]: r["label"] for r in rows.join(named, "fp").select("doc_id", "label").collect()}
    texts = {}
    for r in docs.collect():
        texts.setdefault(r["text"] or "", []).append(r["doc_id"])
    of = {ids[0]: shingles(t, 5) for t, ids in texts.items()}
    posts = {}
    for i, s in of.items():
        for x in s:
            posts.setdefault(x, []).append(i)
    shared = Counter()
    for ids in posts.values():
        if len(ids) <= 400:
            shared.update((x, y) for k, x in enumerate(ids) for y in ids[k + 1 :])
    near = [(x, y) for (x, y), n in shared.items() if 5 * n >= 4 * (len(of[x]) + len(of[y]) - n)]
    assert len(near) > 30 and sum(label[x] == label[y] for x, y in near) >= 0.9 * len(near)
    ids = {i: k for k, i in enumerate(of)}
    root = spans([(ids[x], ids[y]) for x, y in near], len(ids))
    empty = {i for i, s in of.items() if not s}
    groups = {}
    for i in of:
        groups.setdefault(label[i], set()).add("" if i in empty else root[ids[i]])
    assert all(len(g) == 1 for g in groups.values())
