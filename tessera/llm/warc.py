"""Web captures assembled from WARC records.

Request, response and metadata records of one transaction name each other
in WARC-Concurrent-To. The naming may go either way and over records
between (a metadata record that names the request of a response). Links are
joined on identifiers alone; contents move once, when each response meets
the records found for it.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import _spark

RECORD = "record_id string, type string, concurrent_to array<string>, target_uri string, date string, content_type string, head string, body binary, skipped long"
_ARROW = pa.schema([
    ("record_id", pa.string()), ("type", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("target_uri", pa.string()), ("date", pa.string()),
    ("content_type", pa.string()), ("head", pa.string()), ("body", pa.binary()), ("skipped", pa.int64()),
])
CAPTURES = ("response", "revisit")
#: The type of a row that stands for bytes which are no record.
MALFORMED = "malformed"


def _record(kind: str, record_id: str, uri: str, content_type: str, content: bytes, concurrent: list[str], date: str) -> bytes:
    head = [b"WARC/1.1", f"WARC-Type: {kind}".encode(), f"WARC-Record-ID: <{record_id}>".encode(), f"WARC-Date: {date}".encode(), f"WARC-Target-URI: {uri}".encode()]
    head += [f"WARC-Concurrent-To: <{x}>".encode() for x in concurrent]
    head += [f"Content-Type: {content_type}".encode(), f"Content-Length: {len(content)}".encode()]
    return b"\r\n".join(head) + b"\r\n\r\n" + content + b"\r\n\r\n"


def transaction(page_id: int, url: str, html: str, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """The three records of a page. Who names whom, and their order, vary with page_id as they do between crawlers."""
    ids = [f"urn:uuid:{uuid.UUID(hashlib.md5(f'{page_id} {url} {k}'.encode()).hexdigest())}" for k in ("request", "response", "metadata")]
    request, response, metadata = ids
    host, _, path = url.partition("://")[2].partition("/")
    body = html.encode()
    way = page_id % 3
    records = [
        _record("request", request, url, "application/http;msgtype=request", f"GET /{path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode(), [] if way == 1 else [response], date),
        _record("response", response, url, "application/http;msgtype=response", b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + body, [request] if way == 1 else [], date),
        _record("metadata", metadata, url, "application/warc-fields", f"page_id: {page_id}\r\nbytes: {len(body)}\r\n".encode(), [request] if way == 2 else [response], date),
    ]
    return b"".join(records[way:] + records[:way])


def render(pages: DataFrame) -> DataFrame:
    """(warc): WARC data of the pages, a piece for each hundred of them; rows without page_id or url are left out, a null html is an empty body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 100):
                rows = zip(*(c.to_pylist() for c in batch.slice(i, 100).columns))
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(transaction(p, u, h or "") for p, u, h in rows)], pa.binary())], names=["warc"])

    pages = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    return pages.where("page_id IS NOT NULL AND url IS NOT NULL").mapInArrow(run, "warc binary")


def _malformed(size: int) -> tuple:
    return None, MALFORMED, [], None, None, None, None, None, size


def parse(stream: BinaryIO) -> Iterator[tuple]:
    """Records of an uncompressed WARC stream, as RECORD has them; ``body`` is the bytes as they are.

    What is no record is passed over up to the next line that begins with
    ``WARC/``, and told as a row of type ``malformed`` with the number of bytes
    in ``skipped`` (null for records): text between records, a head that is
    cut off or has no length that is a number, a record that is cut off, and
    one without identifier or type. Heads that are no UTF-8 get the
    replacement character.
    """
    line, skipped = b"", 0
    while line or (line := stream.readline()):
        if not line.startswith(b"WARC/"):
            skipped += len(line) if line.strip() else 0
            line = b""
            continue
        if skipped:
            yield _malformed(skipped)
        names: dict[str, str] = {}
        concurrent: list[str] = []
        skipped, line = len(line), b""
        while (field := stream.readline()) not in (b"\r\n", b"\n", b"") and not field.startswith(b"WARC/"):
            skipped += len(field)
            name, _, value = field.decode("utf-8", "replace").partition(":")
            name, value = name.strip().lower(), value.strip()
            if name == "warc-concurrent-to":
                concurrent.append(value.strip("<>"))
            else:
                names[name] = value
        size = names.get("content-length", "")
        if field.startswith(b"WARC/"):
            line = field
        if not field or line or not (size.isascii() and size.isdigit()):
            continue
        content = stream.read(int(size))
        if len(content) < int(size):  # too short, or the length was wrong: look for records inside
            at = content.find(b"\nWARC/") + 1
            skipped += at or len(content)
            stream = io.BytesIO(content[at:] if at else b"")
            continue
        if not (names.get("warc-record-id", "").strip("<>") and names.get("warc-type")):
            yield _malformed(skipped + len(content))
            skipped = 0
            continue
        skipped, head, body = 0, b"", content
        if names.get("content-type", "").startswith("application/http"):
            head, _, body = content.partition(b"\r\n\r\n")
        yield names["warc-record-id"].strip("<>"), names["warc-type"].lower(), concurrent, names.get("warc-target-uri"), names.get("warc-date"), names.get("content-type"), head.decode("utf-8", "replace"), body, None
    if skipped:
        yield _malformed(skipped)


class _Gunzip(io.RawIOBase):
    """Members of a gzip stream one after the other; after a broken one the next that begins."""

    def __init__(self, raw: BinaryIO):
        self.raw, self.held, self.out, self.member = raw, b"", b"", None

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.out:
            if not self.held and not (more := self.raw.read(1 << 20)):
                return 0
            self.held = self.held or more
            if self.member is None:
                at = self.held.find(b"\x1f\x8b\x08")
                if at < 0:
                    more = self.raw.read(1 << 20)
                    self.held = self.held[-2:] + more if more else b""
                    continue
                self.held, self.member = self.held[at:], zlib.decompressobj(31)
            try:
                self.out = self.member.decompress(self.held, 4 << 20)
            except zlib.error:
                self.held, self.out, self.member = self.held[1:], b"\r\n", None
                continue
            self.held = self.member.unconsumed_tail
            if self.member.eof:
                self.held, self.member = self.member.unused_data, None
        n = min(len(into), len(self.out))
        into[:n], self.out = self.out[:n], self.out[n:]
        return n


def _plain(stream: BinaryIO, zipped: bool) -> BinaryIO:
    return io.BufferedReader(_Gunzip(stream), 1 << 20) if zipped else stream


def _batches(rows: Iterator[tuple], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[7] or b"")
        if size > limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _ARROW)], schema=_ARROW)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _ARROW)], schema=_ARROW)


def records(warc: DataFrame, column: str = "warc") -> DataFrame:
    """Records of WARC data in a binary column, compressed (gzip, by record or whole) or not.

    Defined results: null and empty data have no rows; what is no record gives
    rows of type ``malformed``, as in ``parse``, and so does a broken or cut off gzip
    member, after which the next one is read; repeated rows give their records
    again; no rows give none; further columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for raw in batch.column(0):
                    raw = raw.as_py() or b""
                    yield from parse(_plain(io.BytesIO(raw), raw[:2] == b"\x1f\x8b"))

        yield from _batches(rows())

    return warc.select(F.col(f"`{column}`").cast("binary").alias("warc")).mapInArrow(run, RECORD)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of all WARC files under a path; each is streamed by the task that got its name, never read whole.

    Defined results: as ``records``; empty files and folders have no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for uri in batch.column(0).to_pylist():
                    system, at = fs.FileSystem.from_uri(uri)
                    with system.open_input_stream(at, compression=None) as f:
                        buffered = io.BufferedReader(f, 1 << 20)
                        yield from parse(_plain(buffered, buffered.peek(2)[:2] == b"\x1f\x8b"))

        yield from _batches(rows())

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path").mapInArrow(run, RECORD)


def members(ids: DataFrame) -> DataFrame:
    """(capture_id, record_id): the records that belong to each capture, found hop by hop over identifiers alone until no hop finds another."""
    heads = ids.select("record_id", F.explode("concurrent_to").alias("other")).where("record_id <> other")
    links = heads.select(F.col("record_id").alias("a"), F.col("other").alias("b")).union(heads.select("other", "record_id"))
    kind = ids.groupBy("record_id").agg(F.bool_or(F.col("type").isin(*CAPTURES)).alias("capture"))
    # links to records that are there and no captures; a says whether it is one itself
    links = links.join(kind.where("NOT capture").select(F.col("record_id").alias("b")), "b").join(kind.select(F.col("record_id").alias("a"), "capture"), "a").select("a", "b", "capture").distinct()
    links = _spark.cut(links)
    step = links.where("NOT capture").select(F.col("a").alias("record_id"), "b")
    new = found = links.where("capture").select(F.col("a").alias("capture_id"), F.col("b").alias("record_id"))
    while True:
        new = _spark.cut(new.join(step, "record_id").select("capture_id", F.col("b").alias("record_id")).distinct().join(found, ["capture_id", "record_id"], "left_anti"))
        if new.isEmpty():
            return found
        found = found.union(new)


def captures(found: DataFrame) -> DataFrame:
    """One nested row per capture: (capture_id, target_uri, date, request, response, metadata).

    ``request`` and ``metadata`` are arrays ordered by record_id, empty where
    there is none; bodies are bytes, fields of metadata are text. A record belongs to
    a response that it names or is named by, or that a record which belongs to it
    names or is named by, over any number of steps; another response ends a chain.

    Contents move once: those of responses by their own identifier, those of the
    others by theirs and then with their response. ``found`` is computed three times
    (identifiers, responses, others) rather than kept.

    Defined results: rows without identifier or type, malformed ones among them, are passed over;
    records that reach no response are in no row; a record
    linked to several responses is in the row of each; records that repeat an identifier
    count once (that of the least content), and have the links of all; links to absent records do nothing; no
    records give no rows; null contents stay null; further columns are not looked at.
    """
    spark = found.sparkSession
    found = found.select("record_id", "type", "concurrent_to", "target_uri", "date", "content_type", "head", "body").where("record_id IS NOT NULL AND type IS NOT NULL")
    ids = spark.read.parquet(_spark.written(found.select("record_id", "type", "concurrent_to")))
    member = members(ids)

    is_capture = F.col("type").isin(*CAPTURES)
    once = found.where(~is_capture & F.col("type").isin("request", "metadata")).select("record_id", F.struct("type", "head", "body", "date").alias("r")).groupBy("record_id").agg(F.min("r").alias("r"))
    request = F.struct("record_id", F.col("r.date").alias("date"), F.col("r.head").alias("head"), F.col("r.body").alias("body"))
    metadata = F.struct("record_id", F.col("r.date").alias("date"), F.expr("make_valid_utf8(cast(r.body AS string))").alias("fields"))
    joined = member.join(once, "record_id").groupBy("capture_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("r.type") == "request", request))).alias("request"),
        F.sort_array(F.collect_list(F.when(F.col("r.type") == "metadata", metadata))).alias("metadata"),
    )
    response = found.where(is_capture).select(F.col("record_id").alias("capture_id"), F.struct("body", "head", "target_uri", "date", "type", "content_type").alias("r"))
    joined = response.join(joined.hint("shuffle_hash"), "capture_id", "left")
    captured = ids.where(is_capture).groupBy("record_id").count()
    if not captured.where("count > 1").isEmpty():  # equal identifiers have met in the join already
        joined = joined.groupBy("capture_id").agg(F.min("r").alias("r"), F.first("request").alias("request"), F.first("metadata").alias("metadata"))
    kind = F.regexp_extract("r.head", r"(?im)^content-type:[ \t]*([^\r\n]*)", 1)
    status = F.expr("try_cast(regexp_extract(r.head, '^HTTP/[^ ]+ ([0-9]+)', 1) AS int)")
    return joined.select(
        "capture_id",
        F.col("r.target_uri").alias("target_uri"),
        F.col("r.date").alias("date"),
        F.coalesce("request", F.expr("array()").cast("array<struct<record_id:string,date:string,head:string,body:binary>>")).alias("request"),
        F.struct(F.col("r.type").alias("type"), status.alias("status"), kind.alias("content_type"), F.col("r.head").alias("head"), F.col("r.body").alias("body")).alias("response"),
        F.coalesce("metadata", F.expr("array()").cast("array<struct<record_id:string,date:string,fields:string>>")).alias("metadata"),
    )
