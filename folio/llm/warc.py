"""Legacy ARC archives to WARC, and back to rows.

Archives are gzip files that Spark's text writer and reader handle on any file system: a record is one row, and the
separator that ends records in the format is the writer's line separator. The reader splits at that separator wherever
it stands, so the parsers put the parts together again and go by each record's declared length. They hold one record
at a time.

ARC headers come in two versions, ``URL IP date type length`` and ``URL IP date type result checksum location offset
filename length``; the version block that starts a file says which: a record whose url is ``filedesc://`` and whose
content is a version block. Urls of pages that begin so are escaped when they are written, and are pages when they are
read. The converter gives each record a WARC type, a UUID made from its file and its place there, the address it came
from, an ISO timestamp from the ARC date, and SHA-256 digests. Of records with equal payloads of ``least`` bytes or
more, the one with the smallest page_id stays a response; others become revisits, which keep their HTTP headers and
refer to it by id, url and date.

Cases: null html is an empty payload, a null url ``about:blank``; rows that repeat a page_id are records of their own,
with ids of their own, and those that share the smallest page_id of a payload are responses all; a null page_id stays
null and is a response; payloads may hold any bytes, separators and headers included; an empty table gives no rows;
other columns are not carried.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ARC_END, WARC_END = "\n", "\r\n\r\n"
#: Payloads of fewer bytes are never deduplicated.
LEAST_BYTES = 100
#: Up to so many revisits are broadcast; more are joined by a shuffle of the records.
BROADCAST_REVISITS = 100_000
ARC_FIELDS = {
    1: ["url", "ip", "date", "type", "length"],
    2: ["url", "ip", "date", "type", "result", "checksum", "location", "offset", "filename", "length"],
}
_RECORDS = "record_id string, page_id long, url string, ip string, date string, http binary, payload binary, payload_bytes long, payload_digest string"
_RECORD_TYPES = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.string()]
#: What a url must not hold in a header line, or begin with.
_ESCAPED = re.compile(r"[\x00-\x20\x7f]|^f(?=iledesc://)")
_VERSION_BLOCK = re.compile(rb"([12]) [^\n]*\nURL IP-address Archive-date Content-type [^\n]*Archive-length\s*")


def _values(name: str, values: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, pa.binary())], [name])


def _write_lines(rows: DataFrame, folder: str, end: str) -> None:
    rows.select(F.col("value").cast("string")).write.option("lineSep", end).option("compression", "gzip").text(folder)


def _read_lines(spark: SparkSession, folder: str, end: str) -> DataFrame:
    file = F.xxhash64("_metadata.file_path")
    return spark.read.option("lineSep", end).text(folder).select(F.col("value").cast("binary").alias("value"), file.alias("file"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    for batch in batches:
        yield from zip(batch.column("file").to_pylist(), batch.column("value").to_pylist())


class Parts:
    """Rows that were split at ``end``, read as the stream of bytes they come from."""

    def __init__(self, rows: Iterator[bytes], end: str):
        self.rows = rows
        self.end = end.encode()
        self.held = b""

    def line(self) -> bytes | None:
        """What stands before the next separator; None at the end of the stream."""
        while (at := self.held.find(self.end)) < 0:
            row = next(self.rows, None)
            if row is None:
                out, self.held = self.held or None, b""
                return out
            self.held += row + self.end
        out, self.held = self.held[:at], self.held[at + len(self.end) :]
        return out

    def take(self, size: int) -> bytes:
        parts, have = [self.held], len(self.held)
        while have < size:
            row = next(self.rows, None)
            if row is None:
                raise ValueError("the archive ends within a record")
            parts += [row, self.end]
            have += len(row) + len(self.end)
        data = b"".join(parts)
        self.held = data[size:]
        return data[:size]


def write_arc(pages: DataFrame, folder: str, *, date: str = "20240101000000") -> None:
    """Pages as ARC files, of version 1 and 2 in turn; the page's id travels in an HTTP header."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        version = 1 + shard % 2
        names = "URL IP-address Archive-date Content-type Archive-length" if version == 1 else "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
        about = f"{version} 0 folio\n{names}\n"
        rest = "" if version == 1 else f" 200 - - 0 part-{shard}.arc"
        yield _values("value", [f"filedesc://part-{shard}.arc 0.0.0.0 {date} text/plain{rest} {len(about)}\n{about}".encode()])
        for batch in batches:
            out = []
            for page, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                html = html or b""
                content = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'' if page is None else page}\r\nContent-Length: {len(html)}\r\n\r\n".encode() + html
                where = _ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
                more = "" if version == 1 else f" 200 {hashlib.md5(html).hexdigest()} - 0 part-{shard}.arc"
                out.append(f"{where} 0.0.0.0 {date} text/html{more} {len(content)}\n".encode() + content)
            yield _values("value", out)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", common.utf8("html").alias("html"))
    _write_lines(common.map_arrow(rows, records, "value binary"), folder, ARC_END)


def _http(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields, the header with its blank line, and the body."""
    head, sep, body = block.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.decode("latin-1").partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields, head + sep, body


def arc_records(parts: Parts) -> Iterator[dict]:
    """The records of an ARC file, but for its version block."""
    fields = ARC_FIELDS[1]
    while (line := parts.line()) is not None:
        if not line:  # the line break after a record
            continue
        values = line.decode("utf-8", "surrogateescape").split(" ")
        if len(values) not in map(len, ARC_FIELDS.values()) or not values[-1].isdigit():
            raise ValueError(f"not a header of an ARC record: {line[:80]!r}")
        content = parts.take(int(values[-1]))  # the length is last in both versions
        if values[0].startswith("filedesc://") and (block := _VERSION_BLOCK.fullmatch(content)):
            fields = ARC_FIELDS[int(block[1])]
            continue
        if len(values) != len(fields):
            raise ValueError(f"not a header of {len(fields)} fields: {line[:80]!r}")
        yield dict(zip(fields, values)) | {"content": content}


def read_arc(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """One row per record: record_id, page_id, url, ip, date, http (its header), payload, payload_bytes and payload_digest."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), _RECORD_TYPES)], [f.split(" ")[0] for f in _RECORDS.split(", ")])

        for file, own in groupby(_rows(batches), itemgetter(0)):
            for number, r in enumerate(arc_records(Parts(map(itemgetter(1), own), ARC_END))):
                fields, head, body = _http(r["content"])
                page = fields.get("x-page-id", "")
                name = record_id(f"{file}:{number}")
                rows.append((name, int(page) if page else None, r["url"], r["ip"], r["date"], head if payloads else None, body if payloads else None, len(body), hashlib.sha256(body).hexdigest()))
                size += len(body)
                if len(rows) >= common.BATCH_ROWS or size > 8_000_000:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()

    return common.map_arrow(_read_lines(spark, folder, ARC_END), parsed, _RECORDS)


def revisits(spark: SparkSession, arc: str, least: int = LEAST_BYTES) -> DataFrame:
    """The records whose payload another with a smaller page_id has: record_id, and what they refer to."""
    rows = common.stored(read_arc(spark, arc, payloads=False).where(F.col("payload_bytes") >= least).select("record_id", "page_id", "payload_digest", "url", "date"), "digests")
    one = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "record_id", "url", "date"))).alias("first")
    first = rows.groupBy("payload_digest").agg(one, F.count("*").alias("n")).where("n > 1")
    same = common.salted(rows.select("record_id", "page_id", "payload_digest"), first, ["payload_digest"], F.xxhash64("record_id"))
    refers = [F.col(f"first.{c}").alias(f"first_{c}") for c in ("page_id", "record_id", "url", "date")]
    return same.where("page_id > first.page_id").select("record_id", *refers)


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(name.encode()).digest(), version=3)}>"


def _iso(date: str) -> str:
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def _warc(name, page, url: str, ip: str, date: str, http: bytes, payload: bytes, digest: str, first_page, first_name, first_url, first_date) -> bytes:
    again = first_page is not None
    block = http if again else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if again else 'response'}", f"WARC-Record-ID: {name}", f"WARC-Date: {_iso(date)}", f"WARC-Target-URI: {url}", f"WARC-IP-Address: {ip}"]
    if page is not None:
        head.append(f"X-Page-Id: {page}")
    if again:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {first_name}", f"WARC-Refers-To-Target-URI: {first_url}", f"WARC-Refers-To-Date: {_iso(first_date)}", f"X-Refers-To-Page-Id: {first_page}"]
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogateescape") + b"\r\n\r\n" + block


def arc_to_warc(spark: SparkSession, arc: str, folder: str, *, least: int = LEAST_BYTES) -> None:
    """Convert all ARC files of a folder."""
    again = common.stored(revisits(spark, arc, least), "revisits")
    small = again.limit(BROADCAST_REVISITS + 1).count() <= BROADCAST_REVISITS
    rows = read_arc(spark, arc).join(F.broadcast(again) if small else again, "record_id", "left")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        about = b"software: folio\r\nformat: WARC File Format 1.1\r\n"
        name = record_id(f"warcinfo of part {TaskContext.get().partitionId()}")
        head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {name}\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(about)}\r\n\r\n"
        yield _values("value", [head.encode() + about])
        columns = ("record_id", "page_id", "url", "ip", "date", "http", "payload", "payload_digest", "first_page_id", "first_record_id", "first_url", "first_date")
        for batch in batches:
            yield _values("value", [_warc(*row) for row in zip(*(batch.column(c).to_pylist() for c in columns))])

    _write_lines(common.map_arrow(rows, records, "value binary"), folder, WARC_END)


def warc_records(parts: Parts) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record."""
    while (head := parts.line()) is not None:
        if not head:
            continue
        lines = head.decode("utf-8", "surrogateescape").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC header: {head[:80]!r}")
        fields = {n.strip().lower(): v.strip() for n, _, v in (line.partition(":") for line in lines[1:])}
        yield fields, parts.take(int(fields["content-length"]))


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """One row per response or revisit: page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to."""
    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    number = lambda text: int(text) if text else None

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], [f.split(" ")[0] for f in schema.split(", ")])

        for fields, block in warc_records(Parts(map(itemgetter(1), _rows(batches)), WARC_END)):
            if fields["warc-type"] not in ("response", "revisit"):
                continue
            if hashlib.sha256(block).hexdigest() != fields["warc-block-digest"][7:]:
                raise ValueError("a block does not have the digest that its header says")
            http, _, body = _http(block)
            full = fields["warc-type"] == "response"
            digest = hashlib.sha256(body).hexdigest() if full else fields["warc-payload-digest"][7:]
            n = len(body) if full else int(http["content-length"])
            rows.append((number(fields.get("x-page-id")), fields["warc-target-uri"], body if full else None, n, digest, fields["warc-type"], number(fields.get("x-refers-to-page-id"))))
            size += len(body)
            if len(rows) >= common.BATCH_ROWS or size > 8_000_000:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()

    return common.map_arrow(_read_lines(spark, folder, WARC_END), parsed, schema)


def archived(pages: DataFrame, *, least: int = LEAST_BYTES) -> DataFrame:
    """Pages through ARC and WARC archives and back: page_id, payload_bytes, payload_digest, record_type and refers_to."""
    spark = pages.sparkSession
    folder = common.scratch_dir(spark)
    write_arc(pages, f"{folder}/arc")
    arc_to_warc(spark, f"{folder}/arc", f"{folder}/warc", least=least)
    return read_warc(spark, f"{folder}/warc").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
