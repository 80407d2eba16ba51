"""Lexical search by a block index: postings stay with their chunks, and each task keeps the best of every query.

Chunks are indexed where they are read, some thousands to a block, without a shuffle: a block has each of its terms once,
with the chunks that hold it, how often, and the greatest of these counts, which bounds what the term can add to a score
in the block. A task meets a wave of queries, bounded by their terms, block by block; a term of the wave is looked up once
a block, not once a query. Once a query has k chunks, the k-th is a threshold. A few common terms of a block have most of its postings, but are a small part of any chunk: so the postings of the
others are added up first, and the common ones only for the chunks that can still get there, by how many common terms they
have and by the greatest counts of those asked for. A block has its longest chunks first, and parts of it where no chunk has
as many terms as the threshold are not looked at. A block is passed over if all terms together stay below.

The index is written once and met twice: first only the longest chunks of each block, which most of the best are among. The
k-th of what all tasks found there is every task's first threshold for the query, so that the second time a task adds up
and keeps little that is not among the k best of all. What is shuffled is k rows a query and task at most, and near k rows a
query in all where the first thresholds are close.

Cases: a chunk without terms, or null ones, is in no list; a query without terms has no rows; a term that a query repeats
counts once; ties are broken by chunk_id; a chunk_id that repeats is a chunk each time; empty tables give no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import sound
from ..sources import tables

#: Chunks in a block of the index, 65 536 at most, and terms, with repeats, after which it is closed before.
CHUNKS, BLOCK_TERMS = 16384, 4_000_000
#: One of so many chunks of a block, the longest, give the first thresholds, and so many of a block at least.
HEADS, LEAST_HEADS = 256, 32
#: Terms of the queries in one wave, about: what comes to the driver and is broadcast at a time, four bytes each.
WAVE_TERMS = 16_000_000
#: Parts of a block that are looked at: so many 64ths of its chunks, the longest.
PARTS = (1, 2, 4, 8, 16, 24, 32, 48, 64)
#: A term is common in a block if it is there so often, and once for each so many of the chunks.
COMMON, SHARE = 64, 32
#: Chunks that can still get there are looked at one by one if they are one of so many in the parts looked at, else one of
#: so many of them is.
SPARSE, FEW = 8, 256
MOST, ROW, START, END = range(4)
_BLOCK = "ids binary, terms array<string>, starts binary, most binary, places binary"
_TYPES = {"ids": np.int64, "starts": np.int64, "most": np.int64, "places": np.uint16}


def index(chunks: DataFrame, terms: Column) -> DataFrame:
    """A row for each block of chunks: chunk ids, terms, where each term's places start, how often it is in a chunk at
    most, and the places of its chunks in ids, each as often as the term is there. ``terms`` is an array with repeats."""
    sound(chunks.sparkSession)
    return chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), terms.alias("terms")).mapInArrow(_indexed, _BLOCK)


def index_texts(chunks: DataFrame, folded: Column, least: int = 5) -> DataFrame:
    """As ``index``, of texts whose terms are the runs of ``least`` or more letters a to z and digits; they are cut where the
    index is made, so that Spark hands over one string a chunk and no lists."""
    sound(chunks.sparkSession)
    texts = chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), folded.alias("folded"))
    return texts.mapInArrow(lambda batches: _indexed(_cut(batches, least)), _BLOCK)


def _cut(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = pc.split_pattern_regex(pc.fill_null(batch.column("folded"), ""), "[^a-z0-9]+")
        words, ends = lists.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
        there = pc.greater_equal(pc.binary_length(words), least)
        ends = np.concatenate([[0], np.cumsum(there.to_numpy(zero_copy_only=False))])[ends].astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("chunk_id"), pa.ListArray.from_arrays(pa.array(ends), words.filter(there))], ["chunk_id", "terms"])


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, CHUNKS - sum(b.num_rows for b in held))
            held.append(part)
            at += part.num_rows
            if sum(b.num_rows for b in held) == CHUNKS or sum(len(b.column("terms").flatten()) for b in held) >= BLOCK_TERMS:
                made, held = _block(held), []
                yield made
    if held and sum(b.num_rows for b in held):
        yield _block(held)


def _block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One row of the index from the chunks of some batches."""
    ids = np.concatenate([b.column("chunk_id").to_numpy(zero_copy_only=False) for b in parts])
    sizes = np.concatenate([pc.fill_null(pc.list_value_length(b.column("terms")), 0).to_numpy(zero_copy_only=False) for b in parts])
    coded = pa.chunked_array([b.column("terms").flatten() for b in parts], pa.string()).combine_chunks().dictionary_encode()
    n, order = len(ids), np.argsort(-sizes, kind="stable")
    ids, places = ids[order], np.empty(n, np.int64)
    places[order] = np.arange(n)
    pairs = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) << 16 | np.repeat(places, sizes)
    pairs.sort()
    starts = np.searchsorted(pairs, np.arange(len(coded.dictionary) + 1) << 16)
    runs = np.flatnonzero(np.diff(pairs, prepend=-1))
    most = np.maximum.reduceat(np.diff(runs, append=len(pairs)), np.searchsorted(runs, starts[:-1])) if len(pairs) else pairs
    columns = {"ids": ids, "starts": starts, "most": most, "places": pairs & 0xFFFF}
    held = {c: pa.array([x.astype(_TYPES[c]).tobytes()], pa.binary()) for c, x in columns.items()} | {"terms": pa.array([coded.dictionary], pa.list_(pa.string()))}
    names = ["ids", "terms", "starts", "most", "places"]
    return pa.RecordBatch.from_arrays([held[c] for c in names], names)


def _opened(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, ...]:
    """ids, starts, most and places of a row of the index."""
    return tuple(np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in _TYPES.items())


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The longest chunks of each row of the index, as chunks."""
    for batch in batches:
        for i in range(batch.num_rows):
            ids, starts, _, places = _opened(batch, i)
            first = min(len(ids), max(LEAST_HEADS, -(-len(ids) // HEADS)))
            at = np.flatnonzero(places < first)
            at = at[np.argsort(places[at], kind="stable")]
            terms = batch.column("terms")[i].values.take(pa.array(np.searchsorted(starts, at, side="right") - 1))
            ends = np.searchsorted(places[at], np.arange(first + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(ids[:first]), pa.ListArray.from_arrays(pa.array(ends), terms)], ["chunk_id", "terms"])


class Block:
    """One row of the index, opened. Terms that are there often are common: their counts are also rows of a matrix."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        self.ids, starts, most, self.places = _opened(batch, i)
        self.terms = batch.column("terms")[i].values
        n, sizes = len(self.ids), np.diff(starts)
        self.shortness = -np.bincount(self.places, minlength=n)
        self.firsts = [-(-n * i // PARTS[-1]) for i in PARTS]
        common = np.flatnonzero((sizes >= max(COMMON, n // SHARE)) & (most < 1 << 16))
        #: What is known of a term is side by side: MOST is its greatest count in a chunk, ROW its row in the matrix, -1 for
        #: none, START where its places start, END, END + 1 and so on where those in each part end.
        self.known = np.empty((len(self.terms), END + len(PARTS)), np.int32)
        self.known[:, MOST], self.known[:, ROW] = most, -1
        self.known[common, ROW] = np.arange(len(common))
        self.known[:, START] = starts[:-1]
        for i, first in enumerate(self.firsts[:-1] if len(sizes) else []):
            self.known[:, END + i] = starts[:-1] + np.add.reduceat(self.places < first, starts[:-1], dtype=np.int32)
        self.known[:, -1] = starts[1:]
        self.counts = np.zeros((len(common), n), np.uint16)
        for row, (a, b) in enumerate(zip(starts[common].tolist(), starts[common + 1].tolist())):
            self.counts[row] = np.bincount(self.places[a:b], minlength=n)
        #: How many of its terms, with repeats, a chunk has among the common ones.
        self.commonness = self.counts.sum(axis=0, dtype=np.int64)
        self.commonest = int(self.commonness.max(initial=0))
        self.dtype = np.uint16 if self.commonest < 1 << 16 else np.int64

    def codes(self, terms: pa.Array) -> np.ndarray:
        """Where each of the terms is here, -1 for none."""
        return pc.fill_null(pc.index_in(terms, value_set=self.terms), -1).to_numpy(zero_copy_only=False)

    def of(self, terms: list[str]) -> np.ndarray:
        codes = self.codes(pa.array(terms, pa.string()))
        return codes[codes >= 0]

    def summed(self, known: np.ndarray, part: int = len(PARTS) - 1) -> np.ndarray:
        """What the terms of these rows of ``known`` add to the scores of the chunks in the first parts."""
        cuts = [self.places[a:b] for a, b in zip(known[:, START].tolist(), known[:, END + part].tolist())]
        return np.bincount(np.concatenate(cuts), minlength=self.firsts[part]) if cuts else np.zeros(self.firsts[part], np.int64)

    def common(self, rows: np.ndarray, first: int) -> np.ndarray:
        """What the common terms of these rows add to the scores of the first chunks."""
        total = np.zeros(first, self.dtype)
        for row in rows.tolist():
            np.add(total, self.counts[row, :first], out=total)
        return total


class Best:
    """The k best chunks of a query so far, of those with a score of ``least`` or more, and how many postings it took to
    find them."""

    def __init__(self, k: int, least: int = 1):
        self.k, self.least, self.total, self.ids = k, least, np.empty(0, np.int64), np.empty(0, np.int64)
        self.read = self.all = 0

    def meet(self, block: Block, terms: list[str]) -> None:
        self.meet_codes(block, block.of(terms))

    def meet_codes(self, block: Block, own: np.ndarray) -> None:
        if not len(own):
            return
        known = block.known[own]
        self.all += int((known[:, -1] - known[:, START]).sum())
        common = known[:, ROW] >= 0
        rare, rows, least = known[~common], known[common, ROW], self.least
        most = int(known[:, MOST].sum())
        reach = most - int(rare[:, MOST].sum())  # what the common terms can add
        if len(self.total) == self.k:
            least = max(least, int(self.total[-1]))
        first = int(np.searchsorted(block.shortness, -least, side="right"))  # so many chunks are long enough
        if not first or most < least:
            return
        found, score = self._found(block, rare, rows, reach, bisect_left(block.firsts, first), least)
        if len(found) > 4 * self.k:
            best = score >= np.partition(score, -self.k)[-self.k]
            found, score = found[best], score[best]
        if not len(found):
            return
        total, ids = np.concatenate([self.total, score]), np.concatenate([self.ids, block.ids[found]])
        order = np.lexsort((ids, -total))[: self.k]
        self.total, self.ids = total[order], ids[order]

    def _found(self, block: Block, rare: np.ndarray, rows: np.ndarray, reach: int, part: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The chunks in the first parts with a score of at least ``least``, and the scores."""
        score = block.summed(rare, part)
        self.read += int((rare[:, END + part] - rare[:, START]).sum())
        if not len(rows):
            found = np.flatnonzero(score >= least)
            return found, score[found]
        bound = block.commonness[: len(score)]
        found = np.flatnonzero(score + (bound if reach >= block.commonest else np.minimum(bound, reach)) >= least)
        if not len(found):
            return found, score[found]
        # Few of them are looked at one by one. Else nearly all are among the longest chunks, where the common terms are added
        # up for all, and the last few are one by one.
        last = 0 if len(found) * SPARSE < len(score) else len(found) - len(found) // FEW
        first = int(found[last - 1]) + 1 if last else 0
        found = found[last:]
        total = score[found] + block.counts[rows[:, None], found].sum(axis=0, dtype=np.int64)
        enough = total >= least
        self.read += len(rows) * (first + len(found))
        if not first:
            return found[enough], total[enough]
        score = score[:first] + block.common(rows, first)
        among = np.flatnonzero(score >= least)
        return np.concatenate([among, found[enough]]), np.concatenate([score[among], total[enough]])


class Wave:
    """Some of the queries: their ids, the terms that any of them has, once each, and where each query's are among these."""

    def __init__(self, rows: pa.Table):
        lists = rows.column("terms").combine_chunks()
        coded = lists.flatten().dictionary_encode()
        self.ids, self.terms = rows.column("query_id").to_numpy(), coded.dictionary
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        self.starts, self.own = np.concatenate([[0], np.cumsum(sizes)]), coded.indices.to_numpy(zero_copy_only=False)

    def met(self, block: Block) -> Iterator[tuple[int, np.ndarray]]:
        """Each query's number, and its terms that the block has."""
        own = block.codes(self.terms)[self.own]
        there = np.concatenate([[0], np.cumsum(own >= 0)])[self.starts].tolist()
        own = own[own >= 0]
        for q in range(len(self.ids)):
            if there[q] < there[q + 1]:
                yield q, own[there[q] : there[q + 1]]


def _waves(query_terms: DataFrame) -> Iterator[Wave]:
    """The queries with their distinct terms, some ``WAVE_TERMS`` terms at a time."""
    asked = query_terms.where("term is not null").groupBy(F.col("query_id").cast("long").alias("query_id")).agg(F.collect_set("term").alias("terms")).persist()
    n = max(1, -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // WAVE_TERMS))
    for wave in range(n):
        yield Wave(asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == wave).toArrow())
    asked.unpersist()


def _per_wave(query_terms: DataFrame, blocks: DataFrame, fn: Callable, schema: str, prepared: Callable = lambda wave: wave) -> DataFrame:
    """What ``fn`` makes of the blocks and of each wave, or of what ``prepared`` gives for the wave."""
    spark = blocks.sparkSession
    parts = []
    for wave in _waves(query_terms):
        held = spark.sparkContext.broadcast(prepared(wave))
        parts.append(blocks.mapInArrow(lambda batches, held=held: fn(batches, held.value), schema))
    return reduce(DataFrame.unionByName, parts)


def _met(batches: Iterator[pa.RecordBatch], wave: Wave, k: int, least: np.ndarray) -> list[Best]:
    """The best of each query of the wave in these rows of the index."""
    best = [Best(k, x) for x in least.tolist()]
    for batch in batches:
        for i in range(batch.num_rows):
            block = Block(batch, i)
            for q, own in wave.met(block):
                best[q].meet_codes(block, own)
    return best


def _thresholds(wave: Wave, blocks: DataFrame, k: int) -> np.ndarray:
    """A score for each query that its k-th best chunk has at least: the k-th of the best among the longest chunks of the
    blocks, of which each task gives some; 1 where these are fewer."""
    held = blocks.sparkSession.sparkContext.broadcast(wave)
    some = min(k, max(4, -(-4 * k // max(1, blocks.rdd.getNumPartitions()))))

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wave = held.value
        best = _met(_indexed(_heads(batches)), wave, some, np.ones(len(wave.ids), np.int64))
        there = [q for q, b in enumerate(best) if len(b.total)]
        yield pa.RecordBatch.from_arrays([pa.array(wave.ids[there]), pa.array([best[q].total for q in there], pa.list_(pa.int64()))], ["query_id", "totals"])

    found = blocks.mapInArrow(top, "query_id long, totals array<long>").groupBy("query_id").agg(F.sort_array(F.flatten(F.collect_list("totals")), asc=False).alias("totals"))
    rows = found.select("query_id", F.get("totals", F.lit(k - 1)).alias("least")).where("least is not null").toArrow()
    held.unpersist()
    known = dict(zip(rows.column("query_id").to_pylist(), rows.column("least").to_pylist()))
    return np.array([known.get(q, 1) for q in wave.ids.tolist()], np.int64)


def kept(query_terms: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """What the tasks keep, k rows a query and task at most: query_id, chunk_id and matches, the matching positions."""

    def top(batches: Iterator[pa.RecordBatch], held: tuple[Wave, np.ndarray]) -> Iterator[pa.RecordBatch]:
        wave, least = held
        best = _met(batches, wave, k, least)
        ids = np.repeat(wave.ids, np.array([len(b.ids) for b in best], np.int64))
        columns = [ids, *(np.concatenate([getattr(b, c) for b in best] or [np.empty(0, np.int64)]) for c in ("ids", "total"))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "chunk_id", "matches"])

    return _per_wave(query_terms, blocks, top, "query_id long, chunk_id long, matches long", lambda wave: (wave, _thresholds(wave, blocks, k)))


def search(query_terms: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """The k best chunks per query: query_id, chunk_id, score (0.1 for each matching position) and rank; ties by chunk_id.
    query_terms: query_id and term."""
    blocks = tables.stored(blocks, maxRecordsPerFile=1)  # read twice for each wave, a block at a time
    found = kept(query_terms, blocks, k).select("query_id", "chunk_id", F.round(F.col("matches") * F.lit(0.1), 6).alias("score"))
    at = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(at).cast("bigint")).where(F.col("rank") <= k)


def matching(query_terms: DataFrame, blocks: DataFrame) -> DataFrame:
    """How many chunks (n) hold any term of each query that has such chunks; counted by block, so no pair is written."""

    def counted(batches: Iterator[pa.RecordBatch], wave: Wave) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(wave.ids), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(batch, i)
                for q, own in wave.met(block):
                    n[q] += np.count_nonzero(block.summed(block.known[own]))
        yield pa.RecordBatch.from_arrays([pa.array(wave.ids), pa.array(n)], ["query_id", "n"])

    found = _per_wave(query_terms, blocks, counted, "query_id long, n long")
    return found.groupBy("query_id").agg(F.sum("n").alias("n")).where("n > 0")
