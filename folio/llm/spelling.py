"""Spelling variants: words that are one edit apart, each led to the near word that is far more frequent.

A pair of words one edit apart agrees before or behind the edit, on half of what else the shorter has. So words are dealt
out by their first half and by their last one, and a crowded bucket again by the halves of what its key leaves open, until
that is a single letter; a pair is reported in one bucket only, the one where the agreeing beginning is no longer than the
bucket's way allows.

In a bucket what the key leaves open is sorted. Neighbours in the sorted list share prefixes (their LCPs), and a prefix
stands for the whole range of words that have it: a word's banded row of the edit matrix, three cells wide, is computed
once for a range and reused by all ranges inside it, and a range is skipped as soon as its shared prefix is more than one
edit away. All words of a bucket, and many buckets, go down the list together, a letter at a time.

Cases: a null or empty text has no words; a null doc_id counts as an empty one where a run's deletion is drawn; repeated
rows count each; very long texts are read whole; ties between near words go to the first in code-point order; words
without near words have no form, and are their own root; an empty table gives no rows; other columns are not carried.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: Of the runs, those whose checksum this divides lose a letter.
MISSPELT = 31
#: A bucket of more words is dealt out again, unless all but a letter is in its key.
HOT = 5000
#: Words that a task counts before it passes them on; words whose rows of the edit matrix are held together.
HELD, TOGETHER = 300_000, 2048


def _counted(batches: Iterator[pa.RecordBatch], least: int, misspelt: int | None) -> Iterator[pa.RecordBatch]:
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{least},}}")
    held: Counter = Counter()

    def passed_on() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            start = crc32(f"{'' if doc_id is None else doc_id}:".encode())
            found = Counter(runs.findall(text.as_py().lower().decode()))  # of bytes: A-Z alone
            if misspelt:
                for run, n in found.items():
                    h = crc32(run.encode(), start)
                    if h % misspelt == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < least:
                            continue
                    held[run] += n
            else:
                held.update(found)
            if len(held) > HELD:
                yield passed_on()
                held.clear()
    yield passed_on()


def vocabulary(docs: DataFrame, *, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, misspelt: int | None = MISSPELT) -> DataFrame:
    """word and n, of words with so many code points and occurrences at least."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.utf8().alias("text"))
    parts = common.map_arrow(rows, lambda b: _counted(b, least_length, misspelt), "word string, n long")
    return common.stored(parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count), "vocabulary")


def near_pairs(bucket: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of all pairs one edit apart; ``bucket`` numbers and ``rest``, a unicode array, are sorted by both and
    distinct, and pairs lie within a bucket."""
    n, width = len(rest), max(1, rest.dtype.itemsize // 4)
    points = rest.view(np.uint32).reshape(n, width)
    letters, code = np.unique(np.append(points.ravel(), 0), return_inverse=True)  # what is past the end has code 0
    code, base = code[:-1].reshape(n, width).astype(np.int64), len(letters)
    size = (code > 0).sum(axis=1)
    differ = code[1:] != code[:-1]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    lcp[bucket[1:] != bucket[:-1]] = -1
    # By depth: where the ranges of words with one prefix start, and, for those a letter longer, the range and the letter.
    starts = [np.concatenate([[0], np.flatnonzero(lcp < 0) + 1])]
    keys = []
    own = np.searchsorted(starts[0], np.arange(n), side="right") - 1
    first = own
    for d in range(width):
        s = np.concatenate([[0], np.flatnonzero(lcp <= d) + 1])
        keys.append(own[s] * base + code[s, d])
        starts.append(s)
        own = np.searchsorted(s, np.arange(n), side="right") - 1
    left, right = [], []
    for lo in range(0, n, TOGETHER):
        q = np.arange(lo, min(n, lo + TOGETHER))
        node = first[q]
        row = np.tile(np.array([2, 0, 1], np.int8), (len(q), 1))  # of lengths d - 1, d and d + 1; 2 is more than one edit
        for d in range(width + 1):
            if d < width:  # words that end here are the ranges of code 0
                at = np.minimum(np.searchsorted(keys[d], node * base), len(keys[d]) - 1)
                ends, word = keys[d][at] == node * base, starts[d + 1][at]
            else:
                ends, word = np.ones(len(q), bool), starts[d][node]
            gap = size[q] - d
            found = ends & (np.abs(gap) <= 1) & (word > q)
            found[found] = row[found, gap[found] + 1] == 1
            left.append(q[found])
            right.append(word[found])
            if d == width:
                break
            state, child = _longer(q, node, row, d, keys[d], base, code, size)
            q, row, letter, node = q[state], row[state], keys[d][child] % base, child
            new = np.full((len(q), 3), 2, np.int8)
            for t in range(3):
                j = d + t  # the length of the word's own prefix in this cell
                cell = row[:, t] + (letter != code[q, min(max(j - 1, 0), width - 1)]) if j else np.full(len(q), d + 1)
                if t < 2:
                    cell = np.minimum(cell, row[:, t + 1] + 1)
                if t:
                    cell = np.minimum(cell, new[:, t - 1] + 1)
                new[:, t] = np.where(j <= size[q], np.minimum(cell, 2), 2)
            last = np.append(starts[d + 1][1:], n)[node]
            keep = (new.min(axis=1) <= 1) & (last > q + 1)
            q, node, row = q[keep], node[keep], new[keep]
            if not len(q):
                break
    return np.concatenate(left), np.concatenate(right)


def _longer(q, node, row, d: int, key, base: int, code, size) -> tuple[np.ndarray, np.ndarray]:
    """States and ranges one letter longer that may be within one edit: all of them while the prefixes are equal; after
    an edit those that go on with the letter which a cell of the row waits for."""
    fresh = np.flatnonzero(row[:, 1] == 0)
    lo, hi = np.searchsorted(key, node[fresh] * base + 1), np.searchsorted(key, (node[fresh] + 1) * base)
    many = hi - lo
    states = [np.repeat(fresh, many)]
    children = [np.arange(many.sum()) + np.repeat(lo - np.cumsum(many) + many, many)]
    used = row[:, 1] != 0
    for t in range(3):
        j = d + t - 1
        if 0 <= j < code.shape[1]:
            s = np.flatnonzero(used & (row[:, t] == 1) & (j < size[q]))
            want = node[s] * base + code[q[s], j]
            at = np.minimum(np.searchsorted(key, want), len(key) - 1)
            hit = key[at] == want
            states.append(s[hit])
            children.append(at[hit])
    both = np.unique(np.concatenate(states) * len(key) + np.concatenate(children))
    return both // len(key), both % len(key)


def pairs(words: DataFrame, *, least_length: int = LEAST_LENGTH, hot: int = HOT) -> DataFrame:
    """word, near and near_n, both ways, for all words (word, n) one edit apart of at least so many code points."""
    length = F.length("word")
    # m is the length of a pair's shorter word; lo and hi letters are agreed on at either end; below is what the common
    # prefix has to be shorter than, as longer ones are met elsewhere.
    dealt = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("m")).where(F.col("m") >= least_length)
    dealt = dealt.select("word", "n", "m", F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(1 << 30).alias("below"))
    key = ["m", "lo", "hi", "below", "head", "tail"]

    def halves(rows: DataFrame) -> DataFrame:
        k = F.expr("(m - lo - hi) div 2").cast("int")
        ways = F.array(F.struct((F.col("lo") + k).alias("lo"), F.col("hi").alias("hi"), F.col("below").alias("below")), F.struct(F.col("lo").alias("lo"), (F.col("hi") + k).alias("hi"), (F.col("lo") + k).alias("below")))
        rows = rows.select("word", "n", "m", F.explode(ways).alias("way")).select("word", "n", "m", "way.*")
        return rows.withColumns({"head": F.expr("left(word, lo)"), "tail": F.expr("right(word, hi)")})

    dealt, done = common.stored(halves(dealt), "dealt"), []
    while True:
        sizes = dealt.groupBy(*key).agg(F.count("*").alias("many"))
        crowded = common.stored(sizes.where((F.col("many") > hot) & (F.expr("(m - lo - hi) div 2") > 0)).select(*key), "crowded")
        if not crowded.limit(1).count():
            done.append(dealt)
            break
        done.append(dealt.join(crowded, key, "left_anti"))
        dealt = common.stored(halves(dealt.join(crowded, key, "left_semi").drop("head", "tail")), "dealt")
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    grouped = every.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("word", "n"))).alias("words")).where(F.size("words") > 1)
    return grouped.select("m", "lo", "hi", "below", "words").mapInArrow(_searched, "word string, near string, near_n long")


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("words")
        offsets = lists.offsets.to_numpy()
        inner = lists.values
        words = np.array(inner.field("word").to_pylist(), object)[offsets[0] : offsets[-1]]
        n = inner.field("n").to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
        many = np.diff(offsets)
        bucket = np.repeat(np.arange(len(many)), many)
        m, lo, hi, below = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False), many) for c in ("m", "lo", "hi", "below"))
        rest = np.array([w[a : len(w) - b] for w, a, b in zip(words.tolist(), lo.tolist(), hi.tolist())], np.str_)
        order = np.lexsort((rest, bucket))
        a, b = near_pairs(bucket[order], rest[order])
        a, b = order[a], order[b]
        chosen = [
            (i, j)
            for i, j in zip(a.tolist(), b.tolist())
            if min(len(words[i]), len(words[j])) == m[i] and not (below[i] <= len(words[i]) and words[i][: below[i]] == words[j][: below[i]])
        ]
        i, j = np.array(chosen, np.int64).reshape(-1, 2).T
        i, j = np.concatenate([i, j]), np.concatenate([j, i])
        yield pa.RecordBatch.from_arrays([pa.array(words[i], pa.string()), pa.array(words[j], pa.string()), pa.array(n[j], pa.int64())], ["word", "near", "near_n"])


def variants(docs: DataFrame, *, ratio: int = RATIO, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, misspelt: int | None = MISSPELT, hot: int = HOT) -> DataFrame:
    """One row per word: word, n, n_near, form and form_n (the near word of largest n, where that is at least ``ratio``
    times the word's), and root, where the forms lead."""
    words = vocabulary(docs, least_length=least_length, least_count=least_count, misspelt=misspelt)
    near = pairs(words, least_length=least_length, hot=hot)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    rows = words.join(best, "word", "left")
    form = F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best.near"))
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), form.alias("form"), F.when(form.isNotNull(), -F.col("best.less")).alias("form_n"))
    rows = common.stored(rows, "formed")
    # A form is so many times as frequent as the word, so chains are short; each round doubles the steps taken.
    led = common.stored(rows.where("form is not null").select("word", F.col("form").alias("root")), "led")
    while True:
        further = led.select(F.col("word").alias("root"), F.col("root").alias("next"))
        both = common.stored(led.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "led")
        led = both.select("word", "root")
        if not both.where("moved").limit(1).count():
            break
    return rows.join(led, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
