"""WARC archives by transaction assembly.

Writing: each page becomes three records, a request, a response (or, if its payload is already held by a page of a
smaller id, a revisit without a body) and a metadata record; request and metadata name the response in
WARC-Concurrent-To. Spark's text writer puts them into gzip files in the shared folder: records are UTF-8 throughout,
and the line separator is the blank line that ends a record.

Reading: files are parsed by Content-Length, never by searching for separators, so a payload may hold anything. Records
are joined through concurrent-to identifiers into one nested row per capture, and revisits are resolved through their
payload digest.

Only digests that occur more than once are joined to the pages, so the html moves at most once; the join may be split
where one payload holds many pages. Defined results: null html is an empty payload (which has a digest and is held once
like any other); a null url has no target line; rows that repeat the smallest page_id of their payload are responses
each; a null page_id sorts after all others; line breaks in urls are escaped; other columns are ignored; an empty
table gives an archive without records.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import scratch_path, written

#: Pages and bytes of payload in one archive file at most, so that a file is a bounded unit of work for its reader.
PAGES_A_FILE, BYTES_A_FILE = 2000, 256 << 20
#: Bytes of payload that a task writes at least, so that small inputs don't end in many tiny files.
BYTES_A_TASK = 16 << 20
DATE = "2024-01-01T00:00:00Z"
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_END = "\r\n\r\n"


def base32(digest: Column) -> Column:
    """A hexadecimal SHA-1 in bare upper-case base32: four groups of 40 bits, eight letters each."""
    letters = []
    for g in range(4):
        group = F.conv(F.substring(digest, 10 * g + 1, 10), 16, 10).cast("long")
        letters += [F.substring(F.lit(_ALPHABET), F.shiftright(group, 35 - 5 * k).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for k in range(8)]
    return F.concat(*letters)


def _lines(*pairs: tuple[str, Column | str]) -> Column:
    """A header block; a null value leaves its line out."""
    out = [F.lit("WARC/1.1\r\n")]
    for name, value in pairs:
        column = F.lit(value) if isinstance(value, str) else value.cast("string")
        out.append(F.coalesce(F.concat(F.lit(f"{name}: "), column, F.lit("\r\n")), F.lit("")))
    return F.concat(*out, F.lit("\r\n"))


def _uuid(kind: str) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), F.col("row").cast("string"), F.col("page_id").cast("string"), F.col("digest")))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def with_roles(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, digest (hexadecimal) and first (the page that holds the payload, where this is another)."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    large = rows.where(F.octet_length("payload") >= least_bytes)
    held = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    joined = rows.join(held, "digest", "left")
    other = (F.octet_length("payload") >= least_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.withColumn("first", F.when(other, F.col("first")))


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    rows = with_roles(pages, least_bytes).withColumn("row", F.monotonically_increasing_id())
    url = F.regexp_replace("url", "[\\r\\n]", "%0A")
    revisit = F.col("first").isNotNull()
    own = _uuid("response")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, head).otherwise(F.concat(head, F.col("payload")))
    response = F.concat(
        _lines(("WARC-Type", F.when(revisit, "revisit").otherwise("response")), ("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("digest")))), ("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", F.octet_length(block))),
        block,
    )
    asked = F.concat(F.lit("GET / HTTP/1.1\r\nX-Target: "), F.coalesce(url, F.lit("-")), F.lit("\r\n\r\n"))
    request = F.concat(_lines(("WARC-Type", "request"), ("WARC-Record-ID", _uuid("request")), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Concurrent-To", own), ("Content-Type", "application/http;msgtype=request"), ("Content-Length", F.octet_length(asked))), asked)
    facts = F.concat(F.lit("pageId: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n"))
    metadata = F.concat(_lines(("WARC-Type", "metadata"), ("WARC-Record-ID", _uuid("metadata")), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Concurrent-To", own), ("Content-Type", "application/warc-fields"), ("Content-Length", F.octet_length(facts))), facts)
    value = F.concat_ws(_END, request, response, metadata)
    # so many pages that even the largest ones don't fill a file; a page beyond that has a file of its own
    size = F.octet_length("html").cast("long")
    largest, total = pages.agg(F.coalesce(F.max(size), F.lit(0)), F.coalesce(F.sum(size), F.lit(0))).first()
    pages_a_file = max(1, min(PAGES_A_FILE, BYTES_A_FILE // max(largest, 1)))
    rows.select(value.alias("value")).coalesce(total // BYTES_A_TASK + 1).write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", pages_a_file).text(path)


class _Stream:
    """Bytes of a gzip file, inflated as they are asked for."""

    def __init__(self, data: bytes):
        self.data, self.at, self.inflate, self.held = memoryview(data), 0, zlib.decompressobj(31), bytearray()

    def _more(self) -> bool:
        while self.at < len(self.data):
            self.held += self.inflate.decompress(self.data[self.at : self.at + 262_144])
            self.at += 262_144
            while self.inflate.eof and self.inflate.unused_data:  # a file may have several members
                rest = self.inflate.unused_data
                self.inflate = zlib.decompressobj(31)
                self.held += self.inflate.decompress(rest)
            return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        start = 0
        while (i := self.held.find(mark, start)) < 0:
            start = max(0, len(self.held) - len(mark))
            if not self._more():
                return None
        out = bytes(self.held[:i])
        del self.held[: i + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self._more():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def parse_warc(data: bytes):
    """(headers by lower-case name, block) of each record."""
    stream = _Stream(data)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:60]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        block = stream.take(int(headers["content-length"]))
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError("a record isn't followed by a blank line")
        yield headers, block


_RECORD = "record_id string, record_type string, concurrent_to string, target_uri string, date string, stated_digest string, payload_digest string, payload_bytes long, page_id long, payload binary"
_FIELDS = [f.split(" ")[0] for f in _RECORD.split(", ")]


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row per record. Digest and size are those of the bytes read; without payload these alone are kept."""

    def parsed(batches):
        for batch in batches:
            for data in batch.column(0):
                rows: list[tuple] = []
                for h, block in parse_warc(data.as_buffer().to_pybytes()):
                    kind, body, page = h.get("warc-type"), None, None
                    if kind == "response":
                        body = block.partition(b"\r\n\r\n")[2]
                    elif kind == "metadata":
                        facts = dict(x.split(": ", 1) for x in block.decode().split("\r\n") if ": " in x)
                        page = int(facts["pageId"]) if facts.get("pageId", "").strip() else None
                    digest = base64.b32encode(hashlib.sha1(body).digest()).decode() if body is not None else None
                    rows.append((h.get("warc-record-id"), kind, h.get("warc-concurrent-to"), h.get("warc-target-uri"), h.get("warc-date"), (h.get("warc-payload-digest") or "").removeprefix("sha1:") or None, digest, len(body) if body is not None else None, page, body if payload else None))
                    if len(rows) == 500:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(parsed, _RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 7 + [pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], _FIELDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: page_id, record_id, record_type, target_uri, date, response, request, metadata."""
    part = lambda kind, name: records.where(F.col("record_type") == kind).select(F.col("concurrent_to").alias("record_id"), F.struct(F.col("record_id"), F.col("target_uri"), F.col("page_id")).alias(name))
    captures = records.where(F.col("record_type").isin("response", "revisit"))
    captures = captures.select("record_id", "record_type", "target_uri", "date", "stated_digest", F.struct("payload_digest", "payload_bytes", "payload").alias("response"))
    joined = captures.join(part("request", "request"), "record_id", "left").join(part("metadata", "metadata"), "record_id", "left")
    return joined.select(F.col("metadata.page_id").alias("page_id"), "record_id", "record_type", "target_uri", "date", "stated_digest", "response", "request", "metadata")


def resolved(captures: DataFrame) -> DataFrame:
    """captures with payload_bytes, payload_digest and refers_to; a revisit has those of the response that it repeats."""
    own = captures.where("record_type = 'response'").groupBy(F.col("response.payload_digest").alias("stated_digest")).agg(F.min("page_id").alias("held_by"), F.min("response.payload_bytes").alias("held_bytes"))
    revisits = captures.where("record_type = 'revisit'").join(own, "stated_digest", "left")
    first = captures.where("record_type = 'response'").select("*", F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"), F.lit(None).cast("long").alias("refers_to"))
    again = revisits.select(*captures.columns, F.col("held_bytes").alias("payload_bytes"), F.col("stated_digest").alias("payload_digest"), F.col("held_by").alias("refers_to"))
    return first.unionByName(again)


def archive_pages(pages: DataFrame, path: str | None = None, payload: bool = False) -> DataFrame:
    """Writes pages as WARC files, reads them back and returns one resolved capture per page."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_warc(pages, path)
    records = read_warc(spark, path, payload)
    # without payloads the records are small: parsed once, then joined
    return resolved(assemble(records if payload else written(records, "records")))
