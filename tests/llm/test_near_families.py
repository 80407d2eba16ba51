"""Families of near copies in the pipeline's near-dedup: no row for each pair, and none of the pairs left out."""

import random
from collections import Counter

import numpy as np
import pytest

from folio.llm import simhash_dedup

from .helpers import documents, words
from .test_similar_documents import edited, plain_similar


def family(n, seed=7):
    """Copies of one text with one to eight words changed: some are not similar to it, but candidates all the same."""
    rng = random.Random(seed)
    w = words(rng, 150)
    return [edited(rng, w, 1 + k % 8) for k in range(n)]


def test_a_family_gives_no_row_for_each_pair(spark):
    rows = simhash_dedup.sketches(documents(spark, family(120)).select("doc_id", "text"))
    found = simhash_dedup.links(rows.select("fp", "lead", "wide").distinct(), 8, 4000, wide_radius=102)
    n = found.count()
    assert 100 < n < 120 * 9  # a forest in each of nine buckets; all pairs are 7 140


@pytest.mark.parametrize("tile", [200_000, 2_000])
def test_families_in_tiles(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash_dedup, "TILE", tile)
    docs = documents(spark, family(100) + family(9, 8) + ["", None, "a b"])
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    groups = Counter(plain_similar(rows))
    assert len(groups) > 10 and max(groups.values()) > 10
    got = Counter(r["doc_id"] for r in simhash_dedup.keep_first_similar(docs).select("doc_id").collect())
    assert got == Counter(dict.fromkeys(groups, 1))


@pytest.mark.parametrize("two", [False, True])
def test_joining_against_all_pairs(two):
    rng = np.random.default_rng(3)
    n = 60
    sets = []
    for i in range(n):
        own = np.arange(100) + 1000 * (i // 20)
        own[rng.choice(100, rng.integers(0, 20), replace=False)] = 10_000 * (i + 1) + np.arange(100)[: 1]
        sets.append(np.unique(own))
    sets[5] = sets[25] = sets[0][:0]
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])]) + 3  # a part of a longer array
    flat = np.concatenate([[1, 2, 3], *sets, [4]])
    leads = np.zeros(n, np.uint64) ^ (np.arange(n) % 2 * 15).astype(np.uint64)
    wide = np.zeros((n, 8), np.uint64)
    blocks = np.arange(n) % 3 % 2 if two else np.zeros(n, np.int64)
    groups = np.arange(n) // 2 + 500
    a, b = simhash_dedup.joining(leads, wide, groups, blocks, starts, flat, 3, 0, 0.8)
    parent = np.arange(n)
    simhash_dedup._union(parent, np.arange(0, n, 2), np.arange(1, n, 2))
    before, want = len(set(parent.tolist())), parent.copy()
    for i in range(n):
        for j in range(i):
            every = len(np.union1d(sets[i], sets[j]))
            if leads[i] == leads[j] and (not two or blocks[i] != blocks[j]) and 5 * (len(sets[i]) + len(sets[j]) - every) >= 4 * every:
                simhash_dedup._union(want, np.array([i]), np.array([j]))
    simhash_dedup._union(parent, a, b)
    assert (parent == want).all() and len(a) == before - len(set(want.tolist())) > 5
