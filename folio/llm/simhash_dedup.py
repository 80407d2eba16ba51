"""SimHash near-duplicates, linked exactly within a Hamming radius by Gray-ordered hierarchical indexes.

Fingerprints are dealt out by masked bit patterns: the 64 bits are cut into ``radius + 2`` blocks, and any two
fingerprints within the radius agree on at least two of them, so each goes to one bucket per pair of blocks. Buckets of
more than ``hot`` fingerprints are dealt out again by the bits that are left, cut into ``radius + 1`` blocks, of which
linked ones share at least one, and those of more than ``large`` up to twice more. Within a bucket the fingerprints are sorted by Gray rank; nodes over runs of them hold the bits
that their members share, and a search adds up differences node by node, drops a whole run once they exceed the
radius, and takes a whole run as linked once even its widest member lies within. A run whose members are all in the
query's group already is passed over, so a dense bucket costs no more pairs than it takes to join it. A bucket gives a
spanning forest of its links, never its pairs. Components follow from the forests by repeated minima in Spark, a giant
component's rows being dealt over many tasks.

``keep_first_similar`` asks for a similarity of shingles instead of a number of bits. At five words and similarity 0.8
two fingerprints of 64 bits differ in 9.7 bits on average, too many to search by. An edit changes five such shingles but
only one word, so documents are searched by the fingerprint of their different words; a sketch of 512 bits over
their five-word shingles sorts out what is far from similar; and what is left is verified by the shingles themselves. A
bucket gives a spanning forest of its candidates, and the components of all forests are families: every candidate is
between two members of one. Each member asks one other first, in the hope that all are similar. Families that are in
several groups still are compared whole, by tiles that hold a part of the members outside the largest group and a part
of all: a tile verifies its candidates of different groups where they are, and gives the pairs that join them. So groups
are joined by similar pairs alone, no candidate is left out, and none is a row. Both sketches take a shingle once.

Cases: null, empty or blank text has fingerprint zero and links like any other; fewer words than a shingle has are one
shingle; repeated rows and repeated doc_ids stand for themselves and share a component; null doc_ids keep their row and
get the component of their fingerprint (null where it has no other id); an empty table gives no rows; other columns are
not carried.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

BITS = 64
#: A bucket with more fingerprints than this is dealt out again.
HOT = 4000
#: A bucket with up to so many, 8 MB, is searched by one task.
LARGE = 1_000_000
#: Buckets are dealt out again so many times at most: more would not part fingerprints that are all alike.
ROUNDS = 3
FANOUT = 16
#: Nodes that a search looks at together, each with its children; pairs of a chunk that are held to be verified.
FRONTIER, HELD_PAIRS = 1 << 16, 1 << 19
#: Similar documents are searched by the fingerprint of shingles of so many words, within so many bits: of 338 sampled
#: pairs of similar documents 337 are.
LEAD_WORDS, LEAD_RADIUS = 1, 8
#: Sketches of so many fingerprints. At a similarity of 0.8 their 512 bits differ in 77.6 on average, with a deviation
#: of 8.1, at 0.7 in 98.6, at 0.6 in 118: three deviations above the first are allowed.
SKETCH, SKETCH_RADIUS = 8, 102
SIMILARITY = 0.8
#: Fingerprints with the most candidates, which all others ask first.
HUBS = 64
#: Shingles in one of the two parts of a tile, about, and as how many a document counts at least.
TILE, LEAST = 200_000, 200
_STEP = 0x9E3779B97F4A7C15
_SEEDS = np.array([k * _STEP % 2**64 for k in range(1, SKETCH + 1)], np.uint64)
#: Buckets of up to so many documents are one run, without nodes over it.
RUN = 64
#: Up to so many rows to drop are broadcast; more are joined by a shuffle of the documents.
BROADCAST_DROPPED = 500_000
_BIT = np.array([[(v >> b) & 1 for b in range(8)] for v in range(256)], np.int64)


def shingle_hashes(text: bytes, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle, repeats included; of all words where they are fewer."""
    split = text.lower().split()  # of bytes: ASCII letters and ASCII white space alone
    if not split:
        return np.empty(0, np.uint64)
    joined = b" ".join(split)
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    n = max(1, len(split) - words + 1)
    stops = ends[min(words, len(split)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """Bit b is set if it is in over half of the hashes."""
    octets = hashes.view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BIT for k in range(8)])
    return int(sum(1 << b for b in np.flatnonzero(2 * counts > len(hashes)).tolist()))


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """The majority bits of the shingles' hashes; zero without words."""
    return majority(shingle_hashes(text, words, seed))


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _shingle_set(hashes: np.ndarray, words: int) -> np.ndarray:
    """A hash of each different shingle, from the hashes of the words in order."""
    n = max(1, len(hashes) - words + 1)
    total = np.zeros(n, np.uint64)
    for k in range(min(words, len(hashes))):
        total = total * np.uint64(_STEP) + hashes[k : k + n]
    return np.unique(_mixed(total))


def _majority_bits(hashes: np.ndarray) -> bytes:
    """Of rows of hashes, the bits that are set in over half of the rows."""
    counts = np.zeros(BITS * hashes.shape[1], np.int64)
    for lo in range(0, len(hashes), 255):  # as many as a byte can count
        octets = hashes[lo : lo + 255].view(np.uint8)
        counts += np.add.reduce(np.unpackbits(octets, axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(hashes), bitorder="little").tobytes()


def sketch(text: bytes, words: int = 5) -> tuple[int, bytes]:
    """The fingerprint to search by, of short shingles, and the long one to verify by, each shingle taken once."""
    split = text.lower().split()
    if not split:
        return 0, bytes(8 * SKETCH)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, split), np.uint64, len(split))
    lead = _majority_bits(_shingle_set(hashes, LEAD_WORDS)[:, None])
    # Further hashes of the same shingles.
    return int.from_bytes(lead, "little"), _majority_bits(_mixed(_shingle_set(hashes, words)[:, None] + _SEEDS))


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, fp, the fingerprint as a signed long, and text_hash."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps), batch.column("text_hash")], ["doc_id", "fp", "text_hash"])

    text = common.utf8()
    return common.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash")), hashed, "doc_id long, fp long, text_hash long")


def sketches(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, lead and wide, the two parts of a sketch, fp, a hash that names the sketch, and text_hash."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead, wide = [], []
            for text in batch.column("text"):
                a, b = sketch(text.as_py(), words)
                lead.append(a)
                wide.append(b)
            name = np.array([xxhash.xxh64_intdigest(w, a) for a, w in zip(lead, wide)], np.uint64).view(np.int64)
            columns = [batch.column("doc_id"), pa.array(np.array(lead, np.uint64).view(np.int64)), pa.array(wide, pa.binary()), pa.array(name), batch.column("text_hash")]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lead", "wide", "fp", "text_hash"])

    text = common.utf8()
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    return common.map_arrow(chosen, hashed, "doc_id long, lead long, wide binary, fp long, text_hash long")


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """The place of each fingerprint in Gray order, where neighbours differ in one bit."""
    rank = fps.astype(np.uint64).copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Levels of runs over Gray-sorted fingerprints: ``pattern`` and ``mask`` of the bits a run's members share.

    With sketches in ``wide``, one in each row, pairs have to be within ``wide_radius`` of their bits as well.
    """

    def __init__(self, fps: np.ndarray, fanout: int = FANOUT, wide: np.ndarray | None = None, wide_radius: int = 0):
        self.order = np.argsort(gray_rank(fps), kind="stable")
        self.fps = fps[self.order]
        self.wide = None if wide is None else wide[self.order]
        self.wide_radius = wide_radius
        self.fanout = fanout
        self.levels = [(self.fps, np.full(len(fps), ~np.uint64(0)))]
        while len(self.levels[-1][0]) > 1:
            pattern, mask = self.levels[-1]
            cuts = np.arange(0, len(pattern), fanout)
            ones = np.bitwise_and.reduceat(np.where(True, pattern & mask, 0), cuts)
            all_known = np.bitwise_and.reduceat(mask, cuts)
            some = np.bitwise_or.reduceat(pattern & mask, cuts)
            shared = all_known & ~(some ^ ones)
            self.levels.append((ones & shared, shared))

    def forest(self, radius: int) -> np.ndarray:
        """For each position the first position of its group, groups being connected by links within the radius."""
        parent = np.arange(len(self.fps))
        for a, b in self._chunks(radius, parent):
            _union(parent, a, b)
        return parent

    def candidates(self, radius: int, groups: np.ndarray, barred: np.ndarray, most: int | None, earlier: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of positions within both radii and of different groups, less the ``barred`` ones (first * n + second) and
        those that agree on all bits of a mask in ``earlier``, which are met elsewhere: the ``most`` nearest of each
        position, or, without that, a forest that spans all of them."""
        nothing = np.empty(0, np.int64)
        parent, found = groups.copy(), [(nothing, nothing)]
        for a, b in self._chunks(radius, parent):
            a, b, here = _nearest(a, b, self.fps, self.wide, self.wide_radius, barred, most, parent, earlier)
            found.append((a[here], b[here]))
            if most is None:
                _union(parent, a, b)
        return tuple(np.concatenate([x[i] for x in found]) for i in (0, 1))

    def _chunks(self, radius: int, parent: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs within the radius by chunks of positions; the caller may join groups in ``parent`` in between."""
        n = len(self.fps)
        joined = [parent]  # by level, the group that all of a run is in, or -1
        for _ in self.levels[1:]:
            joined.append(np.full(-(-len(joined[-1]) // self.fanout), -1))
        self._summed(joined)
        lo, chunk = 0, 16
        while lo < n:
            hi = min(n, lo + chunk)
            parts = list(self._near(np.arange(lo, hi), radius, parent, joined)) if self.wide is not None else None
            pairs = 0
            if parts is None:
                for a, b in self._near(np.arange(lo, hi), radius, parent, joined):
                    pairs += len(a)
                    yield a, b
            elif parts:
                a, b = (np.concatenate([x[i] for x in parts]) for i in (0, 1))
                pairs = len(a)
                yield a, b
            self._summed(joined)
            room = max(16, min(4096, HELD_PAIRS // n)) if self.wide is not None else 4096  # all pairs of a chunk are held
            lo, chunk = hi, min(room, chunk * 2) if pairs < 64 * chunk else max(16, chunk // 2)

    def _summed(self, joined: list[np.ndarray]) -> None:
        for level in range(1, len(joined)):
            cuts = np.arange(0, len(joined[level - 1]), self.fanout)
            least, most = np.minimum.reduceat(joined[level - 1], cuts), np.maximum.reduceat(joined[level - 1], cuts)
            joined[level] = np.where(least == most, least, -1)

    def _near(self, queries: np.ndarray, radius: int, parent: np.ndarray, joined: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of positions that lead from each query to all within the radius that are not in its group: where a
        whole run is within, its members follow from its first by the run's own links."""
        n, top = len(self.fps), len(self.levels) - 1
        nothing = np.zeros(len(queries), np.int64)
        waiting = [(top, queries, nothing, nothing, np.zeros(len(queries), np.uint64))]
        while waiting:
            level, q, node, dist, counted = waiting.pop()
            if len(q) > FRONTIER:
                waiting += [(level, *(x[i : i + FRONTIER] for x in (q, node, dist, counted))) for i in range(0, len(q), FRONTIER)]
                continue
            pattern, mask = self.levels[level]
            known = mask[node]
            dist = dist + np.bitwise_count((self.fps[q] ^ pattern[node]) & known & ~counted)  # counted: the bits in dist
            width = BITS - np.bitwise_count(known).astype(np.int64)
            span = self.fanout**level
            # Runs wholly before the query are met from their own members.
            keep = (dist <= radius) & ((node + 1) * span - 1 >= q) & (joined[level][node] != parent[q])
            whole = keep & (dist + width <= radius)
            if level and self.wide is not None:
                whole[:] = False  # each member has a sketch of its own to verify
            if whole.any():
                yield q[whole], np.minimum(node[whole] * span, n - 1)
                if level:  # the run's members among themselves: each differs from its first in the free bits only
                    runs = np.unique(node[whole])
                    size = np.minimum((runs + 1) * span, n) - runs * span
                    firsts = np.repeat(runs * span, size)
                    yield firsts, firsts + np.arange(len(firsts)) - np.repeat(np.cumsum(size) - size, size)
            keep &= ~whole
            if level and keep.any():
                child = (node[keep][:, None] * self.fanout + np.arange(self.fanout)).ravel()
                valid = child < len(self.levels[level - 1][0])
                waiting.append((level - 1, *(np.repeat(x[keep], self.fanout)[valid] for x in (q,)), child[valid], *(np.repeat(x[keep], self.fanout)[valid] for x in (dist, known))))


def _differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of bits in which each row of a and b differ."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the groups of each pair, in place; the least position names a group."""
    while True:
        ra, rb = parent[a], parent[b]
        if (ra == rb).all():
            return
        np.minimum.at(parent, ra, rb)
        np.minimum.at(parent, rb, ra)
        while not (parent[parent] == parent).all():
            parent[:] = parent[parent]


def forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (first of a group, another of it) that span the groups of a bucket."""
    if len(fps) == 2:
        near = np.bitwise_count(fps[0] ^ fps[1]) <= radius
        return (fps[:1], fps[1:]) if near else (fps[:0], fps[:0])
    index = GrayIndex(fps)
    parent = index.forest(radius)
    tied = np.flatnonzero(parent != np.arange(len(fps)))
    return index.fps[parent[tied]], index.fps[tied]


def _nearest(
    a: np.ndarray, b: np.ndarray, leads: np.ndarray, wide: np.ndarray, wide_radius: int, barred: np.ndarray, most: int | None, parent: np.ndarray, earlier: list[int]
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs a < b, those within the wide radius, of different groups and not barred: a forest of the nearest, or the
    ``most`` nearest of each member of the smaller group; and which of them are this bucket's to report."""
    keep = (parent[a] != parent[b]) & ~np.isin(a * len(parent) + b, barred)
    a, b = a[keep], b[keep]
    far = _differences(wide[a], wide[b])
    near = far <= wide_radius
    a, b, far = a[near], b[near], far[near]
    here = np.ones(len(a), bool)
    for mask in earlier:
        here &= ((leads[a] ^ leads[b]) & np.uint64(mask)) != 0
    if most is not None:
        size = np.bincount(parent)
        asks = np.where(size[parent[a]] <= size[parent[b]], a, b)[here]
        a, b, far = a[here], b[here], far[here]
        order = np.lexsort((b, a, far, asks))
        asks = asks[order]
        chosen = order[np.arange(len(asks)) - np.searchsorted(asks, asks) < most]
        return a[chosen], b[chosen], np.ones(len(chosen), bool)
    order = np.lexsort((b, a, far))
    a, b, here = a[order], b[order], here[order]
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while x in root:
            x = root[x]
        return x

    chosen = []
    for i, (x, y) in enumerate(zip(parent[a].tolist(), parent[b].tolist())):
        x, y = top(x), top(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            chosen.append(i)
    return a[chosen], b[chosen], here[chosen]


def candidates(names: np.ndarray, leads: np.ndarray, wide: np.ndarray, groups: np.ndarray, refused: list, radius: int, wide_radius: int, most: int | None, earlier: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Names of a bucket's pairs to verify. ``groups`` names each one's group, ``refused`` the names that it is not similar
    to; ``most`` and ``earlier`` as for the index."""
    n = len(leads)
    index = GrayIndex(leads, wide=wide, wide_radius=wide_radius) if n > RUN else None
    order = index.order if index else np.arange(n)
    names = names[order]
    by_name = np.argsort(names)
    _, own = np.unique(groups[order], return_inverse=True)
    firsts = np.full(own.max() + 1, n)
    np.minimum.at(firsts, own, np.arange(n))
    barred = []
    for i, at in enumerate(order.tolist()):
        if refused[at]:
            other = np.array(refused[at], np.int64).view(np.uint64)
            places = by_name[np.minimum(np.searchsorted(names[by_name], other), n - 1)]
            barred += [min(i, j) * n + max(i, j) for j, x in zip(places.tolist(), other.tolist()) if names[j] == x]
    barred, parent = np.array(barred, np.int64), firsts[own]
    if index and most is None:
        # Copies of one text are nearer to it than to each other, and it is nearest to what most of them say.
        middle = np.frombuffer(_majority_bits(index.wide), np.uint64)
        pivot = int(_differences(index.wide, middle[None]).argmin())
        others = np.flatnonzero(np.bitwise_count(index.fps ^ index.fps[pivot]) <= radius)
        a, b, here = _nearest(np.minimum(others, pivot), np.maximum(others, pivot), index.fps, index.wide, wide_radius, barred, None, parent, earlier)
        _union(parent, a, b)
        x, y = index.candidates(radius, parent, barred, None, earlier)
        a, b = np.concatenate([a[here], x]), np.concatenate([b[here], y])
    elif index:
        a, b = index.candidates(radius, parent, barred, most, earlier)
    else:
        a, b = np.triu_indices(n, 1)
        near = np.bitwise_count(leads[a] ^ leads[b]) <= radius
        a, b, here = _nearest(a[near], b[near], leads, wide, wide_radius, barred, most, parent, earlier)
        a, b = a[here], b[here]
    return names[a], names[b]


def _apart(names: np.ndarray, wide: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The bits in which the sketches of a bucket's pairs of names differ."""
    order = np.argsort(names)
    i, j = (order[np.searchsorted(names[order], x)] for x in (a, b))
    return _differences(wide[i], wide[j])


def joining(
    leads: np.ndarray, wide: np.ndarray, groups: np.ndarray, blocks: np.ndarray, starts: np.ndarray, shingles: np.ndarray, radius: int, wide_radius: int, similarity: float
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a tile's positions that join its groups: candidates within both radii whose shingles are similar, a
    spanning forest of them. Of two blocks, members are compared with those of the other. Position i has the shingles
    from ``starts[i]`` to ``starts[i + 1]``."""
    n, sizes = len(leads), np.diff(starts)
    _, own = np.unique(groups, return_inverse=True)
    firsts = np.full(n, n)
    np.minimum.at(firsts, own, np.arange(n))
    parent = firsts[own]
    kinds, codes = np.unique(shingles[starts[0] : starts[-1]], return_inverse=True)
    starts, mine = starts - starts[0], np.zeros(len(kinds), np.int64)
    here = np.flatnonzero(blocks == blocks[0])
    across = np.flatnonzero(blocks != blocks[0])
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for x in here.tolist():
        y = across if len(across) else here[here > x]
        y = y[(parent[y] != parent[x]) & (np.bitwise_count(leads[y] ^ leads[x]) <= radius)]
        # Shared shingles are as many as the smaller one's at most, and all as many as the larger one's at least.
        y = y[np.minimum(sizes[y], sizes[x]) >= similarity * np.maximum(sizes[y], sizes[x]) - 1e-9]
        y = y[_differences(wide[y], wide[x][None]) <= wide_radius]
        if not len(y):
            continue
        k = sizes[y]
        at = np.arange(k.sum()) + np.repeat(starts[y] - np.cumsum(k) + k, k)
        mine[codes[starts[x] : starts[x + 1]]] = 1
        shared = np.bincount(np.repeat(np.arange(len(y)), k), mine[codes[at]], len(y))
        mine[codes[starts[x] : starts[x + 1]]] = 0
        every = sizes[x] + k - shared
        y = y[(every == 0) | (shared >= similarity * every - 1e-9)]
        y = y[np.unique(parent[y], return_index=True)[1]]
        if len(y):
            a.append(np.full(len(y), x))
            b.append(y)
            _union(parent, a[-1], y)
    return np.concatenate(a), np.concatenate(b)


def _masks(bits: list[int], blocks: int) -> list[list[int]]:
    return [list(map(int, part)) for part in np.array_split(np.array(bits), blocks)]


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _further(mask: int, radius: int) -> list[int]:
    """Masks that add to a mask each of radius + 1 blocks of the bits that it leaves."""
    left = [b for b in range(BITS) if not mask >> b & 1]
    return [_signed(mask % (1 << 64) | _mask(x) % (1 << 64)) for x in _masks(left, radius + 1) if x]


def _earlier(path: list[int], masks: list[int], radius: int) -> list[int]:
    """Of the masks that lead to a bucket one after another, those that come before each of them: a pair that agrees on
    one of these is met in another bucket."""
    ways = [masks, *(_further(m, radius) for m in path[:-1])]
    return [m % 2**64 for mask, way in zip(path, ways) for m in way[: way.index(mask)]]


def _sketched(items: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The names, leads and wide parts of sketches."""
    names, leads = (items.field(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("fp", "lead"))
    packed = items.field("wide")  # never null, and of one length
    ends = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
    return names, leads, np.frombuffer(packed.buffers()[2], np.uint8)[ends[0] : ends[-1]].copy().view(np.uint64).reshape(-1, SKETCH)


def links(prints: DataFrame, radius: int = 4, hot: int = HOT, large: int = LARGE, wide_radius: int | None = None) -> DataFrame:
    """Distinct fingerprints in column fp to a spanning set of links (a, b) within the radius.

    With ``wide_radius``, fp only names a sketch; its lead is what has to be within the radius, and its wide part within
    the other; and the links are candidates. A lead then goes to one bucket per block of ``radius + 1``, as a wide radius
    leaves too many pairs of blocks. ``far`` is the number of bits in which their sketches differ.
    """
    key, carried, agree = ("fp", ["fp"], 2) if wide_radius is None else ("lead", ["fp", "lead", "wide", "path"], 1)
    blocks = _masks(list(range(BITS)), radius + agree)
    masks = [_mask(sorted(sum(x, []))) for x in combinations(blocks, agree)]
    part = F.col(key).bitwiseAND(F.col("mask")).alias("part")
    held = [c for c in carried if c != "path"]
    dealt = prints.select(*held, F.explode(F.array(*map(F.lit, masks))).alias("mask")).withColumn("path", F.array("mask")).select(*carried, "mask", part)
    crowd, done = hot, []
    while True:
        sizes = dealt.groupBy("mask", "part").agg(F.count("*").alias("n")).where("n > 1")
        crowded = common.stored(sizes.where(F.col("n") > crowd), "crowded")
        ways = [r["mask"] for r in crowded.select("mask").distinct().collect()]  # as many as there are masks, at most
        ways = {m: _further(m, radius) for m in ways if m != -1}
        if not ways or len(done) == ROUNDS:
            done.append(dealt)
            break
        again = dealt.join(crowded.select("mask", "part"), ["mask", "part"], "left_semi")
        done.append(dealt.join(crowded.select("mask", "part"), ["mask", "part"], "left_anti"))
        table = F.create_map(*[x for m, further in ways.items() for x in (F.lit(m), F.array(*map(F.lit, further)))])
        dealt = again.select(*carried, F.explode(table[F.col("mask")]).alias("mask"))
        if wide_radius is not None:
            dealt = dealt.withColumn("path", F.concat("path", F.array("mask")))
        dealt = common.stored(dealt.select(*carried, "mask", part), "dealt")
        crowd = large
    item, keys = (F.col("fp"), ["mask", "part"]) if wide_radius is None else (F.struct(*held), ["mask", "part", "path"])
    grouped = reduce(DataFrame.unionByName, done).groupBy(*keys).agg(F.collect_list(item).alias("fps")).where(F.size("fps") > 1)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("fps")
            if wide_radius is None:
                values = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
            else:
                names, leads, wide = _sketched(column.values)
                paths = batch.column("path").to_pylist()
            a, b, far = [], [], []
            for at, (lo, hi) in enumerate(zip(column.offsets.to_pylist(), column.offsets.to_pylist()[1:])):
                if wide_radius is None:
                    x, y = forest(np.unique(values[lo:hi]), radius)
                else:
                    x, y = candidates(names[lo:hi], leads[lo:hi], wide[lo:hi], names[lo:hi], [()] * (hi - lo), radius, wide_radius, None, _earlier(paths[at], masks, radius))
                    far.append(_apart(names[lo:hi], wide[lo:hi], x, y))
                a.append(x)
                b.append(y)
            a, b = (np.concatenate(x).view(np.int64) if x else np.empty(0, np.int64) for x in (a, b))
            if wide_radius is None:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.concatenate(far) if far else far, pa.int64())], ["a", "b", "far"])

    if wide_radius is None:
        return grouped.select("fps").mapInArrow(search, "a long, b long").distinct()
    return grouped.select("fps", "path").mapInArrow(search, "a long, b long, far long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Nodes of the edges (a, b) and the least node of their component, by hash-to-min with pointer jumping.

    Each round writes its labels to the shared folder, so a lost executor costs that round at most.
    """
    both = common.stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = common.stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("label")), "labels")
    while True:
        seen = both.join(labels.select(F.col("a").alias("b"), F.col("label").alias("theirs")), "b")
        near = seen.groupBy("a").agg(F.min("theirs").alias("theirs"))
        least = labels.join(near, "a").select("a", F.col("label").alias("old"), F.least("label", "theirs").alias("label"))
        least = common.stored(least, "minima")
        # A label is a node of its component. Many nodes have the same, so it is looked up once for all of them.
        jump = least.select("label").distinct().join(labels.select(F.col("a").alias("label"), F.col("label").alias("root")), "label")
        least = common.salted(least, jump, ["label"], F.xxhash64("a")).select("a", "old", F.least("label", "root").alias("label"))
        least = common.stored(least, "labels")
        labels = least.select("a", "label")
        if not least.where("old <> label").limit(1).count():
            return labels


def shingle_sets(docs: DataFrame, needed: DataFrame, words: int) -> DataFrame:
    """fp and shingles, the hashes of its different shingles, for the fingerprints in ``needed`` (fp, and doc_id and
    text_hash of one row that has it)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for text in batch.column("text"):
                split = text.as_py().lower().split()
                sets.append(_shingle_set(np.fromiter(map(xxhash.xxh64_intdigest, split), np.uint64, len(split)), words).view(np.int64) if split else [])
            yield pa.RecordBatch.from_arrays([batch.column("fp"), pa.array(sets, pa.list_(pa.int64()))], ["fp", "shingles"])

    few = needed.limit(BROADCAST_DROPPED + 1).count() <= BROADCAST_DROPPED
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.utf8().alias("text"), F.xxhash64(common.utf8()).alias("text_hash")).alias("d")
    other = (F.broadcast(needed) if few else needed).alias("o")
    rows = rows.join(other, (F.col("d.text_hash") == F.col("o.text_hash")) & F.col("d.doc_id").eqNullSafe(F.col("o.doc_id")))
    # A row may be repeated as a whole.
    return common.map_arrow(rows.select("fp", "text"), hashed, "fp long, shingles array<long>").groupBy("fp").agg(F.first("shingles").alias("shingles"))


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) with ``good``, whether their shingles are as similar as that."""
    one = lambda c: sets.select(F.col("fp").alias(c), F.col("shingles").alias(f"of_{c}"))
    both = pairs.join(one("a"), "a").join(one("b"), "b")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    every = F.size("of_a") + F.size("of_b") - shared
    return both.select("a", "b", ((every == 0) | (shared >= F.lit(similarity) * every - 1e-9)).alias("good"))


def _asked(found: DataFrame) -> DataFrame:
    """Pairs (a, b) of the candidates to verify first. A member of a large group meets it in every bucket that it was dealt
    to, and each bucket links it anew; so each fingerprint asks one, one of the ``HUBS`` that most have in common if it can."""
    both = found.select("a", "b", "far").union(found.select(F.col("b").alias("a"), F.col("a").alias("b"), "far"))
    hubs = [r["a"] for r in both.groupBy("a").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "a").limit(HUBS).collect()]
    if not hubs:
        return found.select("a", "b")
    place = F.array_position(F.array(*map(F.lit, hubs)), F.col("b"))
    order = F.struct(F.when(place > 0, place).otherwise(HUBS + 1).alias("place"), "far", "b")
    one = both.groupBy("a").agg(F.min(order).alias("one")).select("a", F.col("one.b").alias("b"))
    return one.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _tiles(kin: DataFrame) -> DataFrame:
    """The members of families (fp, family, label of its group, n shingles) that are in several groups still, once for
    each tile: family, lo and hi name it by its two blocks, ``block`` is the member's own. The largest group has blocks
    of its own, which do not meet each other."""
    weight = F.sum(F.greatest(F.col("n"), F.lit(LEAST)).cast("long"))
    groups = kin.groupBy("family", "label").agg(weight.alias("w"))
    families = groups.groupBy("family").agg(F.max_by("label", F.struct("w", "label")).alias("main"), F.max("w").alias("most"), F.sum("w").alias("every"), F.count("*").alias("groups"))
    blocks = lambda w: F.ceil(w / F.lit(TILE)).cast("long")
    families = families.where("groups > 1").select("family", "main", blocks(F.col("every") - F.col("most")).alias("rest"), blocks(F.col("most")).alias("mains"))
    families = common.stored(families, "families")
    rows = common.salted(kin, families, ["family"], F.xxhash64("fp"))
    inside, dealt = F.col("label") == F.col("main"), F.xxhash64("fp", F.lit(1))
    rows = rows.withColumn("block", F.when(inside, F.col("rest") + F.pmod(dealt, "mains")).otherwise(F.pmod(dealt, "rest")))
    met = F.col("rest") + F.when(inside, 0).otherwise(F.col("mains"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), met - 1)))
    return rows.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("n", "main", "rest", "mains", "other")


def _compared(tiles: DataFrame, sets: DataFrame, radius: int, wide_radius: int, similarity: float) -> DataFrame:
    """Similar pairs (a, b) that join the groups of each tile."""
    held = F.struct("fp", "lead", "wide", "label", "block", "shingles")
    tiles = tiles.join(sets, "fp").groupBy("family", "lo", "hi").agg(F.collect_list(held).alias("members"), F.min("label").alias("least"), F.max("label").alias("most"))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("members")
            names, leads, wide = _sketched(column.values)
            groups, blocks = (column.values.field(c).to_numpy(zero_copy_only=False) for c in ("label", "block"))
            lists = column.values.field("shingles")
            starts, shingles = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy(zero_copy_only=False)
            a, b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
            for lo, hi in zip(column.offsets.to_pylist(), column.offsets.to_pylist()[1:]):
                x, y = joining(leads[lo:hi], wide[lo:hi], groups[lo:hi], blocks[lo:hi], starts[lo : hi + 1], shingles, radius, wide_radius, similarity)
                a.append(names[lo:hi][x])
                b.append(names[lo:hi][y])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])

    return common.map_arrow(tiles.where("least <> most").select("members"), compared, "a long, b long")


def _verified(docs: DataFrame, rows: DataFrame, prints: DataFrame, radius: int, hot: int, wide_radius: int, words: int, similarity: float) -> DataFrame:
    """Each fingerprint that is in a group (a) with the label of its group, by pairs whose shingles are similar."""
    found = common.stored(links(prints.select("fp", "lead", "wide"), radius, hot, wide_radius=wide_radius), "candidates")
    families = components(found).select(F.col("a").alias("fp"), F.col("label").alias("family"))  # whatever has a candidate
    own = rows.groupBy("fp").agg(F.max(F.struct("doc_id", "text_hash")).alias("o"))
    sets = common.stored(shingle_sets(docs, own.join(families, "fp", "left_semi").select("fp", "o.doc_id", "o.text_hash"), words), "shingles")
    good = common.stored(similar(_asked(found), sets, similarity), "judged_pairs").where("good").select("a", "b")
    labels = components(good)
    kin = prints.select("fp", "lead", "wide").join(families, "fp").join(sets.select("fp", F.size("shingles").alias("n")), "fp").join(labels.withColumnRenamed("a", "fp"), "fp", "left")
    kin = common.stored(kin.withColumn("label", F.coalesce("label", "fp")), "kin")
    more = common.stored(_compared(_tiles(kin), sets, radius, wide_radius, similarity), "joined_pairs")
    return components(good.union(more)) if more.limit(1).count() else labels


def _labelled(rows: DataFrame, linked: Callable[[DataFrame, DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The rows, stored, and each fingerprint (fp) with the label of its component and the least doc_id there; ``linked``
    gives the labels of those that have any link, from the rows and the different fingerprints."""
    rows = common.stored(rows, "fingerprints")
    parts = [F.first(c).alias(c) for c in ("lead", "wide") if c in rows.columns]
    prints = common.stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), *parts), "prints")
    named = prints.join(linked(rows, prints.drop("least")).withColumnRenamed("a", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    ids = named.groupBy("label").agg(F.min("least").alias("component_id"))
    return rows, common.salted(named, ids, ["label"], F.xxhash64("fp")).select("fp", "label", "component_id")


def simhash_components(docs: DataFrame, *, radius: int = 4, words: int = 4, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits) and component_id, the least doc_id that links lead to."""
    rows, named = _labelled(fingerprints(docs, words), lambda _, prints: components(links(prints, radius, hot)))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(named, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, *, radius: int = 4, words: int = 4) -> DataFrame:
    """The documents with the least id of each component. Of rows that share a doc_id, which has to be a key, the one
    with the least hash of its text stays; of a component without any doc_id, one row stays."""
    return _keep(docs, lambda d: fingerprints(d, words), lambda _, prints: components(links(prints, radius, HOT)))


def keep_first_similar(docs: DataFrame, *, words: int = 5, similarity: float = SIMILARITY, radius: int = LEAD_RADIUS, wide_radius: int = SKETCH_RADIUS) -> DataFrame:
    """As ``keep_first``, of documents whose shingles of so many words are linked by a similarity (Jaccard) of so much."""
    return _keep(docs, lambda d: sketches(d, words), lambda rows, prints: _verified(docs, rows, prints, radius, HOT, wide_radius, words, similarity))


def _keep(docs: DataFrame, prints: Callable[[DataFrame], DataFrame], linked: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    rows, named = _labelled(prints(docs), linked)
    own, text_hash, key = common.unused(docs, "own_id", "text_hash", "row_key")
    judged = rows.where("doc_id is not null").join(named, "fp").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"), F.first("component_id").alias("component_id"))
    judged = judged.withColumn("first", F.min("text_hash").over(Window.partitionBy("doc_id")))
    judged = common.stored(judged.withColumn("stays", F.expr("doc_id = component_id and text_hash = first")).select(F.col("doc_id").alias(own), F.col("text_hash").alias(text_hash), "n", "stays"), "judged")
    out = docs.where("doc_id is not null").withColumns({own: F.col("doc_id").cast("long"), text_hash: F.xxhash64(common.utf8())})

    def without(df: DataFrame, pairs: DataFrame) -> DataFrame:
        few = pairs.limit(BROADCAST_DROPPED + 1).count() <= BROADCAST_DROPPED
        return df.join(F.broadcast(pairs) if few else pairs, [own, text_hash], "left_anti")

    again = judged.where("stays and n > 1").select(own, text_hash)
    repeated = again.limit(1).count() > 0
    kept = without(out, judged.where("not stays or n > 1" if repeated else "not stays").select(own, text_hash))
    if repeated:
        kept = kept.unionByName(out.join(again, [own, text_hash], "left_semi").dropDuplicates([own, text_hash]))
    kept = kept.select(*docs.columns)
    loose = docs.where("doc_id is null")
    if not loose.limit(1).count():
        return kept
    loose = common.stored(loose.withColumn(key, F.monotonically_increasing_id()), "loose")
    mine = prints(loose.select(F.col(key).alias("doc_id"), "text")).join(named.where("component_id is null"), "fp")
    first = mine.groupBy("label").agg(F.min("doc_id").alias(key)).select(key)
    return kept.unionByName(loose.join(first, key, "left_semi").select(*docs.columns))
