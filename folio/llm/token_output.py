"""Token ids in directly addressable codes.

Each file holds one block of documents. Its ids are split into 8-bit chunks: level 0 has the lowest chunk of every id,
and a bitmap says which ids go on; level 1 has the next chunk of those, with a bitmap of its own, and so on. A rank
directory (set bits before every 512th position) finds an id's place on the next level at once, so any token, or any
range of tokens, is read without decoding what stands before it.

Block: ``FDAC`` | header of 8 little-endian int64 (shard, block in shard, documents, tokens, tokens before it in the
shard, levels, 0, 0) | doc ids int64 | null flags uint8 | tokens per document int64 | per level: int64 number of
chunks, chunks uint8, bitmap uint64, ranks int64.

Cases: null and empty texts have the end id alone; rows that repeat a doc_id are written one after another (by the hash
of their text); a null doc_id sorts first and stays null; an empty table gives no files' worth of rows; other columns are
not carried.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens

MAGIC = b"FDAC"
RANK_BITS = 512
#: Tokens in one block, and so in one file, unless a single document has more.
BLOCK_TOKENS = 2_000_000


def _directory(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bitmap as 64-bit words, padded to whole rank steps, and the set bits before each step."""
    padded = np.zeros(-(-max(len(bits), 1) // RANK_BITS) * RANK_BITS, bool)
    padded[: len(bits)] = bits
    per_step = padded.reshape(-1, RANK_BITS).sum(axis=1)
    return np.packbits(padded, bitorder="little").view("<u8"), np.concatenate([[0], np.cumsum(per_step)[:-1]]).astype("<i8")


def encode_block(shard: int, block: int, before: int, doc_ids: list, counts: list[int], ids: np.ndarray) -> bytes:
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        words, ranks = _directory(more)
        levels.append(struct.pack("<q", len(rest)) + (rest & 0xFF).astype(np.uint8).tobytes() + words.tobytes() + ranks.tobytes())
        if not more.any():
            break
        rest = rest[more] >> 8
    head = struct.pack("<8q", shard, block, len(doc_ids), len(ids), before, len(levels), 0, 0)
    names = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], np.uint8).tobytes()
    return MAGIC + head + names + np.array(counts, "<i8").tobytes() + b"".join(levels)


class Block:
    """One block, read in place: ``block[i]`` and ``block.range(a, b)`` touch no other tokens."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token block")
        self.shard, self.number, n_docs, self.n_tokens, self.before, n_levels, _, _ = struct.unpack_from("<8q", data, 4)
        at = 68
        names = np.frombuffer(data, "<i8", n_docs, at)
        nulls = np.frombuffer(data, np.uint8, n_docs, at + 8 * n_docs)
        self.doc_ids = [None if null else d for d, null in zip(names.tolist(), nulls.tolist())]
        self.counts = np.frombuffer(data, "<i8", n_docs, at + 9 * n_docs)
        at += 17 * n_docs
        self.levels = []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<q", data, at)
            steps = -(-max(n, 1) // RANK_BITS)
            chunk = np.frombuffer(data, np.uint8, n, at + 8)
            bits = np.frombuffer(data, np.uint8, steps * RANK_BITS // 8, at + 8 + n)
            ranks = np.frombuffer(data, "<i8", steps, at + 8 + n + steps * RANK_BITS // 8)
            self.levels.append((chunk, bits, ranks))
            at += 8 + n + steps * (RANK_BITS // 8 + 8)

    def _rank(self, level: int, i: int) -> int:
        _, bits, ranks = self.levels[level]
        step = min(i // RANK_BITS, len(ranks) - 1)
        lo = step * RANK_BITS
        return int(ranks[step]) + int(np.unpackbits(bits[lo // 8 : -(-i // 8)], count=i - lo, bitorder="little").sum()) if i > lo else int(ranks[step])

    def __getitem__(self, i: int) -> int:
        return int(self.range(i, i + 1)[0])

    def range(self, start: int, stop: int) -> np.ndarray:
        out = np.zeros(stop - start, np.uint32)
        where = np.arange(stop - start)
        for level, (chunk, bits, _) in enumerate(self.levels):
            if stop <= start:
                break
            out[where] |= chunk[start:stop].astype(np.uint32) << (8 * level)
            byte = start // 8
            go = np.unpackbits(bits[byte : -(-stop // 8)], bitorder="little")[start - 8 * byte : stop - 8 * byte].astype(bool)
            where = where[go]
            if level + 1 < len(self.levels):
                start = self._rank(level, start)
                stop = start + len(where)
        return out


def write(docs: DataFrame, folder: str, *, tokenizer: str | None = None, end_id: int = 2, block_tokens: int = BLOCK_TOKENS) -> None:
    """Documents in ascending doc_id order, with ``end_id`` after each, as one file per block."""
    path = tokenizer or tokens.default_path()
    n = common.shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.utf8().alias("text"), F.xxhash64("text").alias("tie"))
    rows = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, before = TaskContext.get().partitionId(), 0, 0
        names, counts, parts, size = [], [], [], 0

        def block() -> pa.RecordBatch:
            data = encode_block(shard, number, before, names, counts, np.concatenate(parts))
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["value"])

        end = np.array([end_id], np.uint32)
        for held, texts in tokens.chunks(batches):
            for name, ids in zip(held["doc_id"], tokens.encoder(path).ids(texts)):
                names.append(name)
                parts += [ids, end]
                counts.append(len(ids) + 1)
                size += counts[-1]
                if size >= block_tokens:
                    yield block()
                    number, before = number + 1, before + size
                    names, counts, parts, size = [], [], [], 0
        if names:
            yield block()

    blocks = common.map_arrow(rows, encode, "value binary")
    # Spark's text writer puts any bytes down as they are; each block gets a file of its own, and ends in the separator.
    blocks.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1).option("lineSep", "\n--\n").text(folder)


def read(spark, folder: str) -> DataFrame:
    """Per document: shard, its start within the shard, n_tokens and the CRC-32 of its ids."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                block = Block(data.as_py())
                stops = np.cumsum(block.counts)
                starts = stops - block.counts
                ids = memoryview(block.range(0, block.n_tokens).astype("<u4").tobytes())
                sums = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), stops.tolist())]
                n = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.doc_ids, pa.int64()), pa.array([block.shard] * n, pa.int64()), pa.array(block.before + starts, pa.int64()), pa.array(block.counts, pa.int64()), pa.array(sums, pa.int64())],
                    ["doc_id", "shard", "shard_start", "n_tokens", "ids_crc32"],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).where("length > 8").select("content")
    return files.mapInArrow(decode, "doc_id long, shard long, shard_start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, *, tokenizer: str | None = None, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Write all documents, read the files back, and say of each where its ids are and what they sum to.

    Shards follow one another by doc_id. There are as many as shuffle partitions, so their totals, one row each, may
    be summed up in one task and broadcast.
    """
    spark = docs.sparkSession
    folder = folder or common.scratch_dir(spark) + "/tokens"
    write(docs, folder, tokenizer=tokenizer, end_id=end_id)
    rows = common.stored(read(spark, folder), "spans")
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("shard", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(base), "shard").select("doc_id", (F.col("base") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")
