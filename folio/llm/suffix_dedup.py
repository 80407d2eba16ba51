"""Exact removal of repeated byte strings by a distributed merge sort of sampled suffixes.

Every window of ``passage`` bytes has one anchor: the start of the k-gram in it with the least hash, the leftmost of
equals. Equal windows have their anchors at the same place, so it is enough to compare the surroundings of anchors
whose k-grams are the same; the others cannot be in a repeated window. Windows of ``length`` bytes, the longer ones,
hold such a window each and are told at the same anchors.

Anchors whose whole surroundings are the same, by hash, are settled without a look at the bytes, and one of them stands
for all. Suffixes at those that are left are sorted within each task, by the hash of their k-gram and then by their
bytes, and exchanged as front-coded runs: each entry says how many bytes it shares with the one before and holds the
rest. The receiving task merges the runs with a loser tree that keeps, for every contender, its common prefix with the
last winner: a longer one wins without a look at the bytes, and equal ones are compared from there on. The merge yields
the common prefix of neighbours. Groups of one k-gram grow together from the longest of those prefixes down, each part
kept in the order of the bytes before its anchors, where neighbours share most: pairs that become neighbours give, for
each anchor, the repeated windows around it, which are one interval.

A group of over ``hot`` anchors is not gathered. Two equal windows around an anchor agree on half of the bytes that
are still open before it or on half of those after it, so the group is split by either, again and again, until its
parts are small or the known bytes are a whole window. Documents whose whole texts are equal go in once, and are
repeated from end to end if they are long enough.

Beside what ``length`` removes, runs of repeated bytes with ``passage_words`` whole words or more are counted as
passages, from windows of ``passage`` bytes: fifty words of an average of 4.8 bytes with the space, or longer ones.

Cases: null text is empty; texts shorter than a window keep all; repeated rows and repeated doc_ids are documents of
their own; overlapping repeats within one document count; a null doc_id stays null; very long texts are used whole; an
empty table gives no rows; other columns are not carried.
"""

from __future__ import annotations

import hashlib
import struct
from bisect import bisect, insort
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LENGTH = 400
#: Windows of passages, and the words that a passage has at least.
PASSAGE = 240
PASSAGE_WORDS = 50
GRAM = 60
#: Groups of more anchors than this, of different surroundings, are split by further bytes. It bounds what a task holds
#: to some 150 MB; splitting costs a row for every window that the members of such a group share.
HOT = 100_000
#: Anchors that a merging task is to get, about.
BUCKET_ANCHORS = 10_000
#: Anchors that a sorting task sorts at once.
RUN_ANCHORS = 20_000

_MULTIPLIER = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(20240101).integers(0, 2**64, 256, dtype=np.uint64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 17)
        for name, base in (("up", _MULTIPLIER), ("down", pow(_MULTIPLIER, -1, 2**64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Hashes:
    """Hashes of any substrings of a text, each from its bytes alone."""

    def __init__(self, text: bytes):
        x = np.frombuffer(text, np.uint8)
        up, self.down = _powers(len(x) + 1)
        self.sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(_TABLE[x] * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[stop] - self.sums[start]) * self.down[start])

    def rolling(self, size: int) -> np.ndarray:
        return _mixed((self.sums[size:] - self.sums[:-size]) * self.down[: len(self.sums) - size])


def rolling(text: bytes, size: int) -> np.ndarray:
    """A hash of every ``size`` bytes; it depends on those bytes alone."""
    return Hashes(text).rolling(size)


def anchors(hashes: Hashes, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors of all windows of a text that has one at least, and the hashes of their k-grams."""
    h = hashes.rolling(gram)
    width = window - gram + 1
    key = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    padded = np.full(-(-len(key) // width) * width, ~np.uint64(0))
    padded[: len(key)] = key
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(h) - width + 1
    least = np.minimum(after[:n], before[width - 1 : width - 1 + n])
    at = np.unique(least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return at, h[at]


def common_prefix(a: bytes, b: bytes, skip: int = 0) -> int:
    """How many bytes a and b share from their start, of which ``skip`` are known."""
    n = min(len(a), len(b))
    x, y = a[skip:n], b[skip:n]
    if x == y:
        return n
    return n - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) // 8


def encode_run(entries: list[tuple]) -> bytes:
    """Sorted (key, left, references) as a front-coded run; a reference is (k1, rk, position)."""
    shared, tails, last = [], [], b""
    for key, _, _ in entries:
        k = common_prefix(last, key)
        shared.append(k)
        tails.append(key[k:])
        last = key
    lefts = [e[1] for e in entries]
    sizes = np.array([shared, [len(t) for t in tails], [len(x) for x in lefts], [len(e[2]) for e in entries]], "<u4")
    ints = np.array([r for e in entries for r in e[2]], "<i8")
    return struct.pack("<q", len(entries)) + sizes.tobytes() + ints.tobytes() + b"".join(tails) + b"".join(lefts)


def read_run(data: bytes) -> Iterator[tuple[int, bytes, tuple[bytes, np.ndarray]]]:
    """The entries of a run, one at a time: bytes shared with the key before, key, and (left, references)."""
    (n,) = struct.unpack_from("<q", data)
    sizes = np.frombuffer(data, "<u4", 4 * n, 8).reshape(4, n)
    total = int(sizes[3].sum())
    ints = np.frombuffer(data, "<i8", 3 * total, 8 + 16 * n).reshape(total, 3)
    at = 8 + 16 * n + 24 * total
    left_at, ref_at, last = at + int(sizes[1].sum()), 0, b""
    for shared, size, left, refs in sizes.T.tolist():
        last = last[:shared] + data[at : at + size]
        yield shared, last, (data[left_at : left_at + left], ints[ref_at : ref_at + refs])
        at, left_at, ref_at = at + size, left_at + left, ref_at + refs


class LoserTree:
    """Merges sorted runs of (shared, key, payload); yields (key, payload, bytes shared with the key before)."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs

    def __iter__(self) -> Iterator[tuple]:
        runs = self.runs
        size = 1
        while size < len(runs):
            size *= 2
        heads = [next(r, None) for r in runs] + [None] * (size - len(runs))
        current: list[bytes | None] = [h[1] if h else None for h in heads]
        known = [0] * size  # bytes shared with the last winner that each contender has met

        def beats(a: int, b: int) -> bool:
            """Whether a comes first; the loser's known prefix becomes the one with the winner."""
            x, y = current[a], current[b]
            if y is None:
                return True
            if x is None:
                return False
            if known[a] != known[b]:
                return known[a] > known[b]
            k = common_prefix(x, y, known[a])
            first = len(x) == k or (len(y) > k and x[k] < y[k])
            known[b if first else a] = k
            return first

        losers = [0] * size
        winners = [0] * size + list(range(size))
        for node in range(size - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], losers[node] = (a, b) if beats(a, b) else (b, a)
        top = winners[1] if size > 1 else 0
        while current[top] is not None:
            yield current[top], heads[top][2], known[top]
            heads[top] = head = next(runs[top], None)
            current[top], known[top] = (head[1], head[0]) if head else (None, 0)
            node, run = (top + size) // 2, top
            while node:
                other = losers[node]
                if not beats(run, other):
                    losers[node], run = run, other
                node //= 2
            top = run


def covered(keys: list[bytes], lefts: list[bytes], shared: list[int], windows: tuple[int, ...], head: int) -> list[list[tuple[int, int] | None]]:
    """For each length of window, per anchor, the bytes before and after it that repeated windows cover.

    ``shared[i]`` is the common prefix of keys i-1 and i, of which ``head`` bytes are no text. Neighbours are joined from
    the longest common prefix down. A part is kept as the ranks of its members in the order of the bytes before the
    anchor, read backwards; of all members of the other part, an anchor shares most of those bytes with a neighbour in
    that order, so new neighbours are the only pairs to compare.
    """
    m = len(keys)
    turned = [x[::-1] for x in lefts]
    order = sorted(range(m), key=turned.__getitem__)
    rank = [0] * m
    for r, i in enumerate(order):
        rank[i] = r
    out: list[list[tuple[int, int] | None]] = [[None] * m for _ in windows]
    first = {i: (i, [rank[i]]) for i in range(m)}  # by its first member: a part's last member and its ranks
    last = {i: i for i in range(m)}  # by its last member: its first
    for cut in sorted(range(1, m), key=lambda i: -shared[i]):
        after = shared[cut] - head
        start = last.pop(cut - 1)
        (_, big), (stop, small) = first.pop(start), first.pop(cut)
        if len(big) < len(small):
            big, small = small, big
        for x in small:
            p = bisect(big, x)
            for y in big[max(0, p - 1) : p + 1]:
                before = common_prefix(turned[order[x]], turned[order[y]])
                for w, least in enumerate(windows):
                    if before + after >= least:
                        for i in (order[x], order[y]):
                            was = out[w][i] or (0, 0)
                            out[w][i] = (max(was[0], before), max(was[1], after))
            insort(big, x)
        first[start], last[stop] = (stop, big), start
    return out


def _with_keys(docs: DataFrame) -> DataFrame:
    """text as bytes with k1 and rk, two hashes that name the row's text, and its text and doc_id."""
    text = common.utf8()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return rows.withColumns({"k1": F.xxhash64("text"), "rk": F.xxhash64(F.lit(1), "text", "doc_id")})


def _surveyed(docs: DataFrame, length: int, passage: int, gram: int) -> DataFrame:
    """Per row its size, hashes and anchors with the hashes of their k-grams and of their surroundings, without the text."""
    back = length - gram

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64)
        for batch in batches:
            ats, grams, around, sizes, words, sums = [], [], [], [], [], []
            for text in batch.column("text"):
                text = text.as_py()
                at, g, c = none, none, none
                if len(text) >= passage:
                    hashes = Hashes(text)
                    at, g = anchors(hashes, passage, gram)
                    start, stop = np.maximum(at - back, 0), np.minimum(at + length, len(text))
                    c = _mixed(hashes.of(start, stop) + (at - start).astype(np.uint64) * np.uint64(_MULTIPLIER)).view(np.int64)
                    g = g.view(np.int64)
                ats.append(at)
                grams.append(g)
                around.append(c)
                sizes.append(len(text))
                words.append(len(text.split()))
                sums.append(hashlib.sha256(text).hexdigest())
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("k1"), batch.column("rk"), pa.array(sizes, pa.int64()), pa.array(words, pa.int64()), pa.array(sums, pa.string()), pa.array(ats, longs), pa.array(grams, longs), pa.array(around, longs)],
                ["doc_id", "k1", "rk", "n_bytes", "n_words", "sha256", "at", "key", "around"],
            )

    schema = "doc_id long, k1 long, rk long, n_bytes long, n_words long, sha256 string, at array<long>, key array<long>, around array<long>"
    return common.map_arrow(_with_keys(docs), survey, schema)


def _runs(located: DataFrame, length: int, gram: int, buckets: int) -> DataFrame:
    """Texts with their ``spots``, to front-coded sorted runs by bucket of key."""
    back = length - gram

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries: list[tuple] = []

        def flushed() -> pa.RecordBatch:
            runs: dict[int, list] = {}
            for entry in sorted(entries, key=lambda e: e[0]):
                runs.setdefault(int.from_bytes(entry[0][:8], "big") * buckets >> 64, []).append(entry)
            return pa.RecordBatch.from_arrays([pa.array(list(runs), pa.int64()), pa.array([encode_run(r) for r in runs.values()], pa.binary())], ["bucket", "run"])

        for batch in batches:
            for text, k1, rk, spots in zip(*(batch.column(c).to_pylist() for c in ("text", "k1", "rk", "spots"))):
                for spot in spots:
                    at = spot["at"]
                    # The hashes of anchors are the least of many, so they are spread anew before they are dealt out.
                    key = (spot["key"] * _MULTIPLIER & (1 << 64) - 1).to_bytes(8, "big") + text[at : at + length]
                    entries.append((key, text[max(0, at - back) : at], [(k1, rk, at)]))
                    if len(entries) >= RUN_ANCHORS:
                        yield flushed()
                        entries.clear()
        if entries:
            yield flushed()

    return common.map_arrow(located, cut, "bucket long, run binary")


_INTERVAL = "k1 long, rk long, start long, stop long, removed boolean"


def _merged(runs: DataFrame, length: int, passage: int, gram: int, buckets: int) -> DataFrame:
    """Each bucket's runs, merged, to intervals of repeated bytes; ``removed`` is whether windows of ``length`` cover it."""
    head = 8

    def merge(table: pa.Table) -> pa.Table:
        out: list[tuple] = []
        keys: list[bytes] = []
        lefts: list[bytes] = []
        shared: list[int] = []
        names: list[list[int]] = []

        def close() -> None:
            if len(keys) < 2:
                return
            for removed, found in zip((True, False), covered(keys, lefts, shared, (length, passage), head)):
                for (k1, rk, at), f in zip(names, found):
                    if f:
                        out.append((k1, rk, at - f[0], at + f[1], removed))

        for key, (left, refs), prefix in LoserTree([read_run(r.as_py()) for r in table.column("run")]):
            if prefix < head + gram:
                close()
                keys, lefts, shared, names = [], [], [], []
            keys.append(key)
            lefts.append(left)
            shared.append(prefix)
            names.append(refs[0].tolist())
        close()
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, types)], ["k1", "rk", "start", "stop", "removed"])

    return runs.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(merge, _INTERVAL)


def _extended(located: DataFrame, length: int, passage: int) -> DataFrame:
    """Texts with spots of known bytes [at + lo, at + hi), each extended to either side by half of what a window lacks;
    what a text is too short for is left out. The key is of the bytes and their place."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, k1, rk, spots in zip(*(batch.column(c).to_pylist() for c in ("text", "k1", "rk", "spots"))):
                at, lo, hi = (np.array([s[c] for s in spots], np.int64) for c in ("at", "lo", "hi"))
                known = hi - lo
                more = (np.where(known < passage, passage, length) - known + 1) // 2
                at, lo, hi = np.concatenate([at, at]), np.concatenate([lo - more, lo]), np.concatenate([hi, hi + more])
                fits = (at + lo >= 0) & (at + hi <= len(text))
                at, lo, hi = at[fits], lo[fits], hi[fits]
                place = ((hi - lo) * 2 * length + hi).astype(np.uint64) * np.uint64(_MULTIPLIER)
                key = _mixed(Hashes(text).of(at + lo, at + hi) + place).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), v)) for v in (k1, rk)] + [pa.array(v) for v in (at, lo, hi, key)], ["k1", "rk", "at", "lo", "hi", "key"])

    return common.map_arrow(located, extend, "k1 long, rk long, at long, lo long, hi long, key long").distinct()


def _removed(texts: DataFrame, passage_words: int) -> DataFrame:
    """Texts with their intervals: what is removed, the hash of what is left, and the passages."""

    def joined(cuts) -> list[list[int]]:
        out: list[list[int]] = []
        for start, stop in sorted(cuts):
            if out and start <= out[-1][1]:
                out[-1][1] = max(out[-1][1], stop)
            else:
                out.append([start, stop])
        return out

    def whole_words(text: bytes, start: int, stop: int) -> int:
        n = len(text[start:stop].split())
        inside = lambda i: 0 < i < len(text) and not text[i - 1 : i].isspace() and not text[i : i + 1].isspace()
        return max(0, n - inside(start) - inside(stop))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, cuts in zip(batch.column("text").to_pylist(), batch.column("cuts").to_pylist()):
                kept, at, gone = hashlib.sha256(), 0, 0
                spans = joined((c["start"], c["stop"]) for c in cuts if c["removed"])
                for start, stop in spans:
                    kept.update(text[at:start])
                    gone += stop - start
                    at = stop
                kept.update(text[at:])
                words = [n for a, b in joined((c["start"], c["stop"]) for c in cuts) if (n := whole_words(text, a, b)) >= passage_words]
                rows.append((gone, len(spans), kept.hexdigest(), len(words), sum(words)))
            names = ["n_removed", "n_spans", "kept_sha256", "n_passages", "passage_words"]
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("rk"), *(pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, types))], ["k1", "rk", *names])

    return common.map_arrow(texts, remove, "k1 long, rk long, n_removed long, n_spans long, kept_sha256 string, n_passages long, passage_words long")


def _salted(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    return common.salted(rows, groups, keys, F.col("rk"))


def _with_spots(texts: DataFrame, spots: DataFrame, *fields: str) -> DataFrame:
    return texts.join(spots.groupBy("k1", "rk").agg(F.collect_list(F.struct(*fields)).alias("spots")), ["k1", "rk"])


def _split(texts: DataFrame, spots: DataFrame, length: int, passage: int, hot: int) -> tuple[DataFrame, list[DataFrame]]:
    """Spots (k1, rk, at, key, n) whose groups have up to ``hot`` members, from those of larger groups by further bytes;
    and the intervals of whole windows that are known by then."""
    ready, sure = [spots.where(F.col("n") <= hot).select("k1", "rk", "at", "key")], []
    large = spots.where(F.col("n") > hot)
    while large.limit(1).count():
        known = F.col("hi") - F.col("lo")
        sure.append(large.where(known.isin(passage, length)).select("k1", "rk", (F.col("at") + F.col("lo")).alias("start"), (F.col("at") + F.col("hi")).alias("stop"), (known == length).alias("removed")))
        parts = common.stored(_extended(_with_spots(texts, large.where(known < length), "at", "lo", "hi"), length, passage), "extended")
        sizes = parts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        parts = common.stored(_salted(parts, sizes, ["key"]), "parts")
        ready.append(parts.where(F.col("n") <= hot).select("k1", "rk", "at", "key"))
        large = parts.where(F.col("n") > hot)
    return reduce(DataFrame.unionByName, ready), sure


def repeated_spans(docs: DataFrame, *, length: int = LENGTH, passage: int = PASSAGE, gram: int = GRAM, hot: int = HOT) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows without their texts, those whose whole text occurs again, intervals of repeated bytes by k1 and rk, texts)."""
    passage = min(passage, length)
    gram = min(gram, max(1, passage // 2))
    rows = common.stored(_surveyed(docs, length, passage, gram), "survey")
    # Whole copies: all but the one with the least rk stay out of the sort; they are repeated from end to end.
    classes = rows.where(F.col("n_bytes") >= passage).groupBy("k1", "sha256").agg(F.count("*").alias("n"), F.min("rk").alias("lead")).where("n > 1")
    copies = _salted(rows.select("k1", "rk", "sha256"), classes, ["k1", "sha256"]).groupBy("k1", "rk").agg(F.min("lead").alias("lead"))
    copies = common.stored(copies, "copies")
    single = rows.where(F.size("at") > 0).join(copies.where("rk <> lead"), ["k1", "rk"], "left_anti")
    spots = single.select("k1", "rk", "n_bytes", F.explode(F.arrays_zip("at", "key", "around")).alias("s")).select("k1", "rk", "n_bytes", "s.*").distinct()
    sizes = spots.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    spots = common.stored(_salted(spots, sizes, ["key"]), "spots")

    # One anchor stands for all with its surroundings, which are repeated as a whole.
    around = common.stored(spots.groupBy("key", "around").agg(F.count("*").alias("n"), F.min(F.struct("k1", "rk", "at")).alias("one")), "around")
    again = _salted(spots, around.where("n > 1").select("key", "around"), ["key", "around"])
    start, stop = F.greatest(F.col("at") - (length - gram), F.lit(0)), F.least(F.col("at") + length, F.col("n_bytes"))
    found = [again.select("k1", "rk", start.alias("start"), stop.alias("stop"), (stop - start >= length).alias("removed"))]
    several = around.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    ones = common.stored(_salted(around.select("key", "one.*"), several, ["key"]).withColumns({"lo": F.lit(0).cast("long"), "hi": F.lit(gram).cast("long")}), "ones")

    texts = _with_keys(docs).select("k1", "rk", "text")
    ready, sure = _split(texts, ones, length, passage, hot)
    ready = common.stored(ready.groupBy("k1", "rk").agg(F.collect_list(F.struct("at", "key")).alias("spots"), F.count("*").alias("n")), "ready")
    total = ready.agg(F.sum("n").alias("n")).first()["n"] or 0
    buckets = max(common.shuffle_partitions(docs.sparkSession), -(-total // BUCKET_ANCHORS))
    found.append(_merged(_runs(texts.join(ready.drop("n"), ["k1", "rk"]), length, gram, buckets), length, passage, gram, buckets))
    return rows, copies, reduce(DataFrame.unionByName, [*found, *sure]), texts


def suffix_dedup(docs: DataFrame, *, length: int = LENGTH, passage: int = PASSAGE, passage_words: int = PASSAGE_WORDS, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans and kept_sha256, then n_passages and passage_words, the
    runs of repeated bytes with at least so many words, and their words."""
    rows, copies, found, texts = repeated_spans(docs, length=length, passage=passage, gram=gram, hot=hot)
    cuts = found.groupBy("k1", "rk").agg(F.collect_list(F.struct("start", "stop", "removed")).alias("cuts"))
    cut = _removed(texts.join(cuts, ["k1", "rk"]), passage_words).dropDuplicates(["k1", "rk"])
    out = rows.select("doc_id", "k1", "rk", "n_bytes", "n_words", "sha256").join(copies.select("k1", "rk", F.lit(True).alias("whole")), ["k1", "rk"], "left").join(cut, ["k1", "rk"], "left")
    copied = F.coalesce("whole", F.lit(False))
    whole = copied & (F.col("n_bytes") >= length)
    spoken = copied & (F.col("n_words") >= passage_words)
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(count("n_removed")).alias("n_removed"),
        F.when(whole, 1).otherwise(count("n_spans")).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256().hexdigest())).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
        F.when(spoken, 1).otherwise(count("n_passages")).cast("long").alias("n_passages"),
        F.when(spoken, F.col("n_words")).otherwise(count("passage_words")).alias("passage_words"),
    )
