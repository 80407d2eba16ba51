"""Ingest: decoding, chunking by a token budget, embedding inputs and tables of labelled rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text

#: What windows-1252 has at 0x80 to 0x9F, where ISO-8859-1 has control characters. Fixed values.
_C1 = "".join(map(chr, [0x80, *range(0x82, 0x8D), 0x8E, *range(0x91, 0x9D), 0x9E, 0x9F]))
_CP1252 = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"


def decoded(content: Column) -> Column:
    """UTF-8 without its mark, else windows-1252."""
    utf8 = F.regexp_replace(content.cast("string"), "^﻿", "")
    return F.when(F.is_valid_utf8(content.cast("string")), utf8).otherwise(F.translate(F.decode(content, "ISO-8859-1"), _C1, _CP1252))


def read_documents(spark: SparkSession, path: str, extensions=("txt", "md")) -> DataFrame:
    """Files as rows: path, text, and error_code where a file is refused (UNSUPPORTED, EMPTY or NO_TEXT).

    Spark's reader may pass over files without any byte.
    """
    files = spark.read.format("binaryFile").load(path)
    body = text.cleaned(decoded(F.col("content")))
    known = text.extension(F.col("path")).isin(*extensions)
    code = F.when(~known, "UNSUPPORTED").when(F.col("length") == 0, "EMPTY").when(body == "", "NO_TEXT")
    return files.select("path", code.alias("error_code"), F.when(code.isNull(), body).alias("text"))


def read_missions(spark: SparkSession, path: str, schema) -> DataFrame:
    """One JSON object per file ``mission-*.json``, with the file's name."""
    rows = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "mission-*.json").json(path)
    return rows.select("*", F.col("_metadata.file_name").alias("file_name"))


def exploded_documents(missions: DataFrame) -> DataFrame:
    """A row per nested document, numbered in order."""
    return missions.select("id", F.posexplode("documents").alias("pos", "d")).select("id", "pos", "d.*")


_TOKEN = re.compile(r"\w+|[^\w\s]")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def count_tokens(value: str) -> int:
    """Words and marks: the default counter."""
    return len(_TOKEN.findall(value))


def chunks_of(value: str | None, most: int, overlap: int, target: int | None = None, least: int = 0, count=count_tokens) -> list[str]:
    """Paragraphs, cut to sentences and those to words where they are too long, packed greedily up to ``target``
    tokens, beyond it only while a chunk has fewer than ``least``; a chunk starts with the last sentence of the one
    before, if that has at most ``overlap`` tokens and 140 characters.

    A counter of words and marks counts the same in parts as in the whole, so parts are counted once; another counter is
    asked about every text that might become a chunk.
    """
    target = min(target or most, most)
    adds = count is count_tokens
    units: list[tuple[str, str, int]] = []  # (separator before it, text, tokens)
    for p, paragraph in enumerate(re.split(r"\n\s*\n", (value or "").strip())):
        lead = "\n\n" if p else ""
        for sentence in _SENTENCE.split(" ".join(paragraph.split())):
            if not sentence:
                continue
            n = count(sentence)
            if n <= most:
                units.append((lead, sentence, n))
                lead = " "
                continue
            part, size = "", 0
            for word in sentence.split(" "):
                longer = f"{part} {word}" if part else word
                n = size + count(word) if adds else count(longer)
                if part and n > most:
                    units.append((lead, part, size))
                    longer, lead, n = word, " ", count(word)
                part, size = longer, n
            units.append((lead, part, size))
            lead = " "
    out: list[str] = []
    now, now_n, last, last_n = "", 0, "", 0
    for lead, unit, n in units:
        joined = f"{now}{lead or ' '}{unit}" if now else unit
        size = (now_n + n if adds else count(joined)) if now else n
        if now and (size > most or (size > target and now_n >= least)):
            out.append(now)
            again = last if last and last != now and len(last) <= 140 and last_n <= overlap else ""
            joined = f"{again} {unit}" if again else unit
            size = (last_n + n if adds else count(joined)) if again else n
            if size > most:
                joined, size = unit, n
        now, now_n, last, last_n = joined, size, unit, n
    if now:
        out.append(now)
    return out


def chunked(docs: DataFrame, most: int = 200, overlap: int = 30, target: int | None = None, least: int = 0) -> DataFrame:
    """doc_id, chunk_index, content and n_tokens; the packing goes on in order, so it runs on whole texts by Arrow."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, index, content, sizes = [], [], [], []
            for doc, value in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                for i, c in enumerate(chunks_of(value, most, overlap, target, least)):
                    ids.append(doc)
                    index.append(i)
                    content.append(c)
                    sizes.append(count_tokens(c))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(index, pa.int64()), pa.array(content, pa.string()), pa.array(sizes, pa.int64())], ["doc_id", "chunk_index", "content", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, chunk_index long, content string, n_tokens long")


def word_chunks(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """Chunks of ``size`` words that share ``overlap`` with the one before: native, for texts without sentences."""
    w = text.words(F.col("text"))
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(size - overlap)), lambda s: (s == 0) | (s + overlap < F.size("w")))
    rows = docs.select("doc_id", w.alias("w")).where(F.size("w") > 0).select("doc_id", "w", F.posexplode(starts).alias("chunk_index", "s"))
    return rows.select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.array_join(F.slice("w", F.col("s") + 1, size), " ").alias("content"))


def embedding_inputs(chunks: DataFrame, document: str, prefix: str, content: str) -> DataFrame:
    """``input``: the prefix, a blank line and the content; the bare content where any chunk of the document lacks a prefix."""
    lacking = F.max(F.col(prefix).isNull()).over(Window.partitionBy(document))
    return chunks.withColumn("input", F.when(lacking, F.col(content)).otherwise(F.concat_ws("\n\n", prefix, content)))


def scope(document_id: Column, mission_id: Column, given: Column | None = None) -> Column:
    """PDF with a document, MISSION with a mission, else LEGACY, unless one is given."""
    found = F.when(document_id.isNotNull(), "PDF").when(mission_id.isNotNull(), "MISSION").otherwise("LEGACY")
    return found if given is None else F.coalesce(given, found)


def scope_filter(kind: Column, sector: Column, mission_type: Column, status: Column, want: str, want_sector=None, want_type=None) -> Column:
    """Rows of a scope: PDF rows must be indexed and may lack a sector, and their type is not asked; others match in full."""
    same = lambda c, v: F.lit(True) if v is None else c == v
    if want == "PDF":
        return (kind == "PDF") & (status == "INDEXED") & (sector.isNull() | same(sector, want_sector))
    return (kind == want) & same(sector, want_sector) & same(mission_type, want_type)


def ingest_totals(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("chunks"), F.sum(F.length("content")).alias("characters"))


def markdown_rows(docs: DataFrame) -> DataFrame:
    """Rows of Markdown tables as ``Header: value; …``: doc_id, line and evidence. A header is a row that a line of
    dashes follows; rows with another number of cells are kept as they are."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("raw"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    rows = lines.where(F.trim("raw").rlike(r"^\|.*\|$")).withColumn("cells", cells).withColumn("rule", F.col("raw").rlike(r"^[\s|:-]+$"))
    order = Window.partitionBy("doc_id").orderBy("line")
    rows = rows.withColumn("next_rule", F.coalesce(F.lead("rule").over(order) & (F.lead("line").over(order) == F.col("line") + 1), F.lit(False)))
    rows = rows.withColumn("header", F.last(F.when(F.col("next_rule"), F.col("cells")), ignorenulls=True).over(order))
    body = rows.where("not rule and not next_rule and header is not null")
    pairs = F.array_join(F.zip_with("header", "cells", lambda h, c: F.concat_ws(": ", h, c)), "; ")
    return body.select("doc_id", F.col("line").cast("bigint").alias("line"), F.when(F.size("header") == F.size("cells"), pairs).otherwise(F.trim("raw")).alias("evidence"))


def register_chunk_text(spark: SparkSession, name: str = "chunk_text") -> None:
    """The chunker as a table function for SQL: ``SELECT * FROM chunk_text(text, most, overlap, target, least)``."""

    @F.udtf(returnType="chunk_index int, content string, n_tokens int")
    class ChunkText:
        def eval(self, value: str, most: int, overlap: int, target: int, least: int):
            for i, c in enumerate(chunks_of(value, most, overlap, target, least)):
                yield i, c, count_tokens(c)

    spark.udtf.register(name, ChunkText)


def ingest_missions(spark: SparkSession, path: str, schema, target: str, most: int = 200, overlap: int = 30) -> DataFrame:
    """Mission files to chunks under ``target``, numbered per mission over its documents, and the totals of the run."""
    docs = exploded_documents(read_missions(spark, path, schema))
    one = docs.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "pos", "content"))).alias("d"))  # two to four documents
    texts = one.select("id", F.array_join(F.transform("d", lambda x: x["content"]), "\n\n").alias("text")).withColumn("doc_id", F.xxhash64("id"))
    chunks = chunked(texts, most, overlap).join(texts.select("doc_id", F.col("id").alias("mission")), "doc_id").select("mission", "chunk_index", "content", "n_tokens")
    chunks.write.mode("append").parquet(target)
    done = spark.read.parquet(target)
    return done.agg(F.countDistinct("mission").alias("missions"), F.count("*").alias("chunks"), F.sum("n_tokens").alias("tokens"))
