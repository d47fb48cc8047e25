"""WARC archives: write captures as request, response (or revisit) and metadata records, read them back, and
assemble one nested row per capture through the records' concurrent-to identifiers.

Archives are written by Spark's own text writer: each row is a whole record and the line separator is the blank
lines that end a WARC record, so the output commits like any Spark job and goes to any file system. The reader
takes each archive as bytes and walks it record by record by Content-Length, so a payload may hold anything,
record separators included.

Cases: a null payload is empty (0 bytes); a null URL becomes an empty target and its capture has no request line
host; control characters in a URL are percent-encoded; rows that repeat an id and payload all become captures with
records of their own, and those with the largest id are all responses; a payload longer than an archive's bound is
alone in its file; a null id never wins a group over a number; an empty table gives an
empty archive and no rows; further columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, durable, new_path, salted_lookup, slices

VERSION = "WARC/1.1"
CRLF = "\r\n"
SEPARATOR = CRLF + CRLF
#: Bytes of one archive file at most before compression, and of a capture's records beside its payload.
ARCHIVE_BYTES, RECORD_BYTES = 1 << 28, 1 << 13
#: Largest payloads of the size classes; larger payloads are a class of their own.
SIZE_CLASSES = (1 << 16, 1 << 22)
#: The record's date when a capture has none.
NO_DATE = "1970-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: each 20 bits (5 hex digits) are 4 base32 digits."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind: str, headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record without its closing blank lines; headers whose value is null are left out."""
    lines = [F.concat(F.lit(f"{k}: "), v) for k, v in headers]
    head = F.concat_ws(CRLF, F.lit(VERSION), F.lit(f"WARC-Type: {kind}"), *lines, F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(head, F.lit(SEPARATOR), block)


def captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", dedup_from: int = 0) -> DataFrame:
    """id, row (a number of its own), url, payload, digest, bytes, ``first`` (the id that this payload is stored under;
    null: its own) and ``again`` (some id occurs twice with this payload).

    Of equal payloads of at least ``dedup_from`` bytes one with the largest id is stored. Only digests that occur twice
    are kept, in a table of their own; where it is counted small it is broadcast and no payload is shuffled, else the
    look-up is salted: one payload may be a third of all rows.
    """
    base = pages.select(
        F.col(id_col).alias("id"),
        F.monotonically_increasing_id().alias("row"),
        F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\x00-\x20\x7f]", "%20").alias("url"),
        F.coalesce(F.col(payload_col), F.lit("")).alias("payload"),
    )
    base = base.withColumns({"digest": base32_sha1(F.encode("payload", "UTF-8")), "bytes": F.octet_length("payload").cast("long")})
    twice = base.groupBy("digest").agg(F.max("id").alias("last"), F.max("bytes").alias("size"), F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids")).where("n > 1")
    repeated = durable(twice.select("digest", F.when(F.col("size") >= dedup_from, F.col("last")).alias("first"), (F.col("n") > F.col("ids")).alias("again")), "repeated")
    if repeated.count() <= BROADCAST_ROWS:
        return base.join(F.broadcast(repeated), "digest", "left")
    return salted_lookup(base, repeated, "digest", "id")


def records(caps: DataFrame) -> DataFrame:
    """Three records (a column ``value``) for each capture: response or revisit, its request, its metadata."""
    revisit = F.col("id") < F.col("first")
    # Where an id occurs twice with one payload its records are told apart by row, and revisits name the digest alone.
    row = F.when(F.col("again"), F.col("row"))
    rid, first_rid = _urn(F.lit("response"), F.col("id"), F.col("digest"), row), F.when(~F.col("again"), _urn(F.lit("response"), F.col("first"), F.col("digest"), row))
    host = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)", 1)
    http = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "), F.col("bytes").cast("string"), F.lit(SEPARATOR))
    date, uri, digest = F.lit(NO_DATE), F.col("url"), F.concat(F.lit("sha1:"), F.col("digest"))
    common = [("WARC-Target-URI", uri), ("WARC-Date", date)]
    full = _record("response", [("WARC-Record-ID", rid), *common, ("WARC-Payload-Digest", digest), ("Content-Type", F.lit("application/http; msgtype=response"))], F.concat(http, F.col("payload")))
    again = _record(
        "revisit",
        [("WARC-Record-ID", rid), *common, ("WARC-Payload-Digest", digest), ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("WARC-Refers-To", first_rid), ("Content-Type", F.lit("application/http; msgtype=response"))],
        http,
    )
    ask = F.concat(F.lit("GET "), F.when(path == "", F.lit("/")).otherwise(path), F.lit(" HTTP/1.1" + CRLF + "Host: "), host, F.lit(SEPARATOR))
    request = _record("request", [("WARC-Record-ID", _urn(F.lit("request"), F.col("id"), F.col("digest"), row)), *common, ("WARC-Concurrent-To", rid), ("Content-Type", F.lit("application/http; msgtype=request"))], ask)
    notes = F.concat_ws(CRLF, F.concat(F.lit("capture-id: "), F.col("id").cast("string")), F.concat(F.lit("payload-bytes: "), F.col("bytes").cast("string")))
    meta = _record("metadata", [("WARC-Record-ID", _urn(F.lit("metadata"), F.col("id"), F.col("digest"), row)), *common, ("WARC-Concurrent-To", rid), ("Content-Type", F.lit("application/warc-fields"))], notes)
    return caps.select(F.explode(F.array(request, F.when(revisit, again).otherwise(full), meta)).alias("value"))


def write_archives(caps: DataFrame, path: str, compression: str = "gzip") -> None:
    """Archives below ``path``, a folder for each class of payload sizes. A file of a class holds so many captures that
    it can't exceed ``ARCHIVE_BYTES`` (but for a single larger capture), however long or many the payloads are."""
    most = caps.agg(F.max("bytes")).first()[0] or 0
    low = -1
    for high in (*SIZE_CLASSES, most):
        if low < max(most, 0) and high > low:
            held = caps.where((F.col("bytes") > low) & (F.col("bytes") <= high))
            in_file = max(1, ARCHIVE_BYTES // (high + RECORD_BYTES))
            records(held).write.option("lineSep", SEPARATOR).option("compression", compression).option("maxRecordsPerFile", 3 * in_file).text(f"{path}/upto-{high}")
            low = high


RECORD_SCHEMA = "type string, record_id string, concurrent_to string, refers_to string, target_uri string, digest string, payload_bytes long, fields map<string,string>"


class _Stream:
    """Bytes of an archive, unpacked piece by piece when it is gzip (any number of members)."""

    def __init__(self, data: bytes):
        self.data, self.at, self.buf = memoryview(data), 0, bytearray()
        self.unzip = zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else None

    def more(self) -> bool:
        if self.at >= len(self.data):
            return False
        piece = self.data[self.at : self.at + (1 << 18)]
        self.at += len(piece)
        if self.unzip is None:
            self.buf += piece
            return True
        while piece:
            self.buf += self.unzip.decompress(piece)
            piece = self.unzip.unused_data
            if piece:
                self.unzip = zlib.decompressobj(31)
        return True

    def head(self) -> bytes | None:
        start = 0
        while (end := self.buf.find(b"\r\n\r\n", start)) < 0:
            start = max(0, len(self.buf) - 3)
            if not self.more():
                return None
        out = bytes(self.buf[:end])
        del self.buf[: end + 4]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buf) < n and self.more():
            pass
        out = bytes(self.buf[:n])
        del self.buf[:n]
        return out


def _fields(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        k, _, v = line.decode("utf-8", "replace").partition(":")
        out[k.strip().lower()] = v.strip()
    return out


def parse_archive(data: bytes) -> Iterator[dict]:
    """The records of one archive. For HTTP responses the payload is what follows the HTTP head."""
    s = _Stream(data)
    while (head := s.head()) is not None:
        lines = head.lstrip(b"\r\n").split(b"\r\n")
        h = _fields(lines[1:])
        block = s.take(int(h.get("content-length", 0)))
        kind, fields = h.get("warc-type"), {}
        payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else b""
        if kind == "metadata":
            fields = _fields(block.split(b"\r\n"))
        elif kind == "request":
            fields = {"request-line": block.split(b"\r\n", 1)[0].decode("utf-8", "replace")}
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if kind == "response" else h.get("warc-payload-digest", "").removeprefix("sha1:") or None
        yield {
            "type": kind, "record_id": h.get("warc-record-id"), "concurrent_to": h.get("warc-concurrent-to"), "refers_to": h.get("warc-refers-to"),
            "target_uri": h.get("warc-target-uri"), "digest": digest, "payload_bytes": len(payload) if kind == "response" else None, "fields": list(fields.items()),
        }
        if s.take(4) not in (SEPARATOR.encode(), b""):
            raise ValueError(f"a record doesn't end where its Content-Length says: {h}")


_ARROW = pa.schema([(n, pa.string()) for n in ("type", "record_id", "concurrent_to", "refers_to", "target_uri", "digest")] + [("payload_bytes", pa.int64()), ("fields", pa.map_(pa.string(), pa.string()))])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        for content in batch.column("content"):
            out = []
            for r in parse_archive(content.as_py()):
                out.append(r)
                if len(out) == 5000:
                    yield pa.RecordBatch.from_pylist(out, schema=_ARROW)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_ARROW)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives under ``path``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").option("recursiveFileLookup", True).load(path).select("content").mapInArrow(_parse, RECORD_SCHEMA)


def assemble(recs: DataFrame) -> DataFrame:
    """One nested row per capture: the response or revisit with its request and its metadata.

    The others name their capture by concurrent-to. A capture has one of each; where an archive repeats them the
    one with the smallest record id is nested and ``n_requests`` / ``n_metadata`` tell how many there were.
    """
    anchor = recs.where(F.col("type").isin("response", "revisit")).select("record_id", "type", "target_uri", "digest", "payload_bytes", "refers_to")

    def side(kind: str, name: str, count: str) -> DataFrame:
        nested = F.struct("record_id", "target_uri", "fields")
        return recs.where(F.col("type") == kind).where("concurrent_to is not null").groupBy(F.col("concurrent_to").alias("record_id")).agg(F.min_by(nested, "record_id").alias(name), F.count(F.lit(1)).alias(count))

    out = anchor.join(side("request", "request", "n_requests"), "record_id", "left").join(side("metadata", "metadata", "n_metadata"), "record_id", "left")
    return out.select(F.struct("record_id", "type", "target_uri", "digest", "payload_bytes", "refers_to").alias("response"), "request", "metadata", F.coalesce("n_requests", F.lit(0)).alias("n_requests"), F.coalesce("n_metadata", F.lit(0)).alias("n_metadata"))


def leftovers(recs: DataFrame) -> DataFrame:
    """Requests and metadata whose concurrent-to names no response or revisit."""
    anchors = recs.where(F.col("type").isin("response", "revisit")).select(F.col("record_id").alias("concurrent_to"))
    return recs.where(F.col("type").isin("request", "metadata")).join(anchors, "concurrent_to", "left_anti")


def write_and_assemble(pages: DataFrame, **columns) -> DataFrame:
    """Archive ``pages`` under the shared folder, read the archives back and assemble the captures.

    What is read back holds no payloads; it is written once, as the three sides of the join all read it.
    """
    path = new_path(pages.sparkSession, "warc")
    write_archives(captures(pages, **columns), path)
    return assemble(durable(read_archives(pages.sparkSession, path), "records"))


def capture_report(caps: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (the response's page_id for revisits)."""
    flat = durable(
        caps.select(
            F.col("metadata.fields")["capture-id"].cast("long").alias("page_id"),
            F.coalesce(F.col("response.payload_bytes"), F.col("metadata.fields")["payload-bytes"].cast("long")).alias("payload_bytes"),
            F.col("response.digest").alias("payload_digest"),
            F.col("response.type").alias("record_type"),
            F.col("response.record_id").alias("record_id"),
            F.when(F.col("response.type") == "revisit", F.coalesce(F.col("response.refers_to"), F.col("response.digest"))).alias("to_record"),
        ),
        "captures",
    )
    revisits = flat.where("record_type = 'revisit'")
    wanted = revisits.groupBy("to_record").agg(F.lit(1).alias("one")).drop("one")
    # A revisit names the record it refers to, or else only its payload's digest.
    named = flat.where("record_type = 'response'").select(F.explode(F.array("record_id", "payload_digest")).alias("to_record"), "page_id")
    stored = named.groupBy("to_record").agg(F.max("page_id").alias("refers_to"))
    found = salted_lookup(revisits, stored.join(wanted, "to_record", "left_semi"), "to_record", "page_id")
    rest = flat.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long"))
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return found.select(*names).unionByName(rest.select(*names))


#: The same report in DuckDB. Its sha1() gives hex; each 5 hex digits are 4 base32 digits.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, hex,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), 'string_agg', '') AS payload_digest
  FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = max(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = max(page_id) OVER w THEN NULL ELSE max(page_id) OVER w END AS refers_to
FROM d WINDOW w AS (PARTITION BY hex)
"""
