"""Best-fit packing of tokenised documents into sequences of fixed capacity, by large-item matching.

Only lengths matter for where a piece goes, and there are at most ``capacity`` of them, so the plan is made on the
histogram of lengths, which is bounded whatever the input: pieces above a third of the capacity are paired greedily,
the longest open one with the longest that still fits beside it (two at most in a sequence); smaller ones then go,
longest first, into the tightest gap that takes them. The plan says which ranks of each length go where; every piece
finds its rank from counts per shard, so no task or driver holds the pieces.

Cases: null and empty texts are one piece of the end id alone; repeated rows are packed each; a null doc_id stays null;
an empty table gives no rows; other columns are not carried.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens


class Plan:
    """Slots by length: ranks from ``first`` on go to sequence ``base + (rank - first) // each`` at
    ``offset + (rank - first) % each * length``."""

    def __init__(self) -> None:
        self.slots: dict[int, list[tuple[int, int, int, int]]] = {}
        self.used: dict[int, int] = {}
        self.sequences = 0

    def put(self, length: int, base: int, bins: int, each: int, offset: int, items: int) -> None:
        first = self.used.get(length, 0)
        self.slots.setdefault(length, []).append((first, base, each, offset))
        self.used[length] = first + items

    def place(self, length: int, rank: int) -> tuple[int, int]:
        slots = self.slots[length]
        first, base, each, offset = slots[bisect_right(slots, rank, key=lambda s: s[0]) - 1]
        return base + (rank - first) // each, offset + (rank - first) % each * length


def plan(histogram: dict[int, int], capacity: int) -> Plan:
    """The packing of as many pieces of each length as the histogram says. Its size depends on the capacity alone."""
    out, left = Plan(), {k: n for k, n in histogram.items() if n}
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by free room: (first sequence, how many)
    open_gaps = 0  # bit g: there are sequences with room g

    def leave(base: int, bins: int, room: int) -> None:
        nonlocal open_gaps
        if bins and room:
            gaps[room].append((base, bins))
            open_gaps |= 1 << room

    large = sorted((k for k in left if 3 * k > capacity), reverse=True)
    for a in large:
        while left.get(a):
            b = next((x for x in large if left.get(x) and x <= capacity - a and (x != a or left[a] > 1)), 0)
            bins = left[a] if not b else left[a] // 2 if b == a else min(left[a], left[b])
            base = out.sequences
            out.sequences += bins
            if b == a:
                out.put(a, base, bins, 2, 0, 2 * bins)
            else:
                out.put(a, base, bins, 1, 0, bins)
                if b:
                    out.put(b, base, bins, 1, a, bins)
            left[a] -= bins
            if b:
                left[b] -= bins
            leave(base, bins, capacity - a - b)
    for a in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[a]:
            fits = open_gaps >> a
            if fits:
                room = a + (fits & -fits).bit_length() - 1
                base, bins = gaps[room].pop()
                if not gaps[room]:
                    open_gaps &= ~(1 << room)
            else:
                room, base = capacity, out.sequences
                bins = -(-left[a] // (capacity // a))
                out.sequences += bins
            each = room // a
            full = min(bins, left[a] // each)
            if full:
                out.put(a, base, full, each, capacity - room, full * each)
                left[a] -= full * each
                leave(base, full, room - each * a)
            base, bins = base + full, bins - full
            if bins and left[a]:  # fewer are left than one sequence would take
                out.put(a, base, 1, left[a], capacity - room, left[a])
                leave(base, 1, room - left[a] * a)
                left[a], base, bins = 0, base + 1, bins - 1
            leave(base, bins, room)
    return out


def pieces(docs: DataFrame, *, capacity: int, tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    """Every document's ids, cut at multiples of the capacity: one row a piece, with its shard and its rank there among
    the pieces of its length."""
    path = tokenizer or tokens.default_path()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, shard int, rank long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, seen = TaskContext.get().partitionId(), {}
        end = np.array([end_id], np.uint32)
        for held, texts in tokens.chunks(batches):
            rows: list[tuple] = []
            for name, ids in zip(held["doc_id"], tokens.encoder(path).ids(texts)):
                ids = np.concatenate([ids, end]).astype("<u4")
                for k, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    n = len(part)
                    seen[n] = rank = seen.get(n, -1) + 1
                    rows.append((name, k, start, n, zlib.crc32(part.tobytes()), shard, rank))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "shard", "rank"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names)

    return common.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.utf8().alias("text")), cut, schema)


def best_fit_packing(docs: DataFrame, *, capacity: int = 4096, tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset."""
    rows = common.stored(pieces(docs, capacity=capacity, tokenizer=tokenizer, end_id=end_id), "pieces")
    counts = rows.groupBy("shard", "length").agg(F.count("*").alias("n"))
    # At most capacity rows come to the driver.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    made = plan(histogram, capacity)
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("shard", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = rows.join(base, ["shard", "length"]).withColumn("rank", F.col("base") + F.col("rank")).drop("base", "shard")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [made.place(n, r) for n, r in zip(batch.column("length").to_pylist(), batch.column("rank").to_pylist())]
            kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array([s for s, _ in at], pa.int64()), pa.array([o for _, o in at], pa.int64())], [*kept, "sequence_id", "offset"]
            )

    return ranked.mapInArrow(assign, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
