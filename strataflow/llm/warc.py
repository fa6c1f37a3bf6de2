"""Web archives whose repeated payloads are revisit records.

Headers (id, address, digest and size of the payload) are shuffled by payload digest; the least of each digest is the original,
the others become revisits of it. Only originals carry their payload into the archive. Every record is written with fresh headers:
type, a record id made from what it holds, date, address, digests of payload and block, and lengths.

Archives are written and read by Spark's text source with the empty line as separator, so they work wherever Spark has a file system, and a lost
task is written again by Spark's committer. A file is one gzip stream, so it is read in order by one task, record by record.
A digest that a third of the pages share is dealt over many tasks (`spread_join`).
"""

from __future__ import annotations

import base64
import hashlib
import re
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.llm._shared import bounded, materialize
from strataflow.llm._skew import spread_join

#: Between the parts of a record, and between records.
GAP = "\r\n\r\n"
#: The profile that the archive format's standard names for payloads equal by digest.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = "record_id string, record_type string, page_id long, uri string, date string, payload_digest string, payload_bytes long, refers_to string, intact boolean, payload binary"


def base32(hex_digest: Column) -> Column:
    """Base32 of 40 hexadecimal digits: five of them are four letters."""
    five = lambda k: F.conv(F.substring(hex_digest, 5 * k + 1, 5), 16, 32)
    digits = F.concat(*[F.lpad(five(k), 4, "0") for k in range(8)])
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _captures(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """(page_id, uri, payload, digest): the uri without what can't stand in a header line, the digest as hexadecimal SHA-1."""
    uri = F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"[\x00-\x20\x7F]", "%20")
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    return pages.select(F.col(id_col).cast("long").alias("page_id"), uri.alias("uri"), payload.alias("payload"), F.sha1(payload).alias("digest"))


def resolve_revisits(captures: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, uri, digest, bytes, n, head_id, head_uri) for captures (page_id, uri, digest, bytes): each digest's original.

    Rows equal in all four are one with their number n. The original is the least by id, then by uri, null ids last; captures of fewer
    than min_bytes have none (head_uri is null).
    """
    heads = materialize(captures.groupBy("page_id", "uri", "digest", "bytes").agg(F.count("*").alias("n")), "warc-headers", compact=True)
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "uri")).alias("head")
    firsts = heads.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(first).select("digest", F.col("head.page_id").alias("head_id"), F.col("head.uri").alias("head_uri"))
    return spread_join(heads, firsts, ["digest"], "left")


def _record_id(*of: Column) -> Column:
    """A record's name, made from what it holds."""
    h = F.md5(F.concat_ws("\n", *[F.coalesce(c.cast("string"), F.lit("-")) for c in of]))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _written(rows: DataFrame, date: str) -> DataFrame:
    """The bytes of each record of (kind, page_id, uri, digest, bytes, copy, head_id, head_uri, payload), but for the separator after it."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(GAP)).cast("binary")
    block = F.concat(http, F.coalesce("payload", F.lit(b"")))
    line = lambda name, value: F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"\r\n{name}: "), value)).otherwise("")
    revisit = F.col("kind") == "revisit"
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("kind"),
        line("WARC-Record-ID", _record_id(F.col("kind"), F.col("page_id"), F.col("uri"), F.col("digest"), F.col("copy"))),
        line("WARC-Date", F.lit(date)), line("WARC-Target-URI", F.col("uri")), line("Page-Id", F.col("page_id").cast("string")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("digest")))), line("WARC-Block-Digest", F.concat(F.lit("sha1:"), base32(F.sha1(block)))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _record_id(F.lit("response"), F.col("head_id"), F.col("head_uri"), F.col("digest"), F.lit(0))), line("WARC-Refers-To-Target-URI", F.col("head_uri")), line("WARC-Refers-To-Date", F.lit(date)))).otherwise(""),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(GAP),
    )
    return rows.select(F.concat(header.cast("binary"), block).cast("string").alias("value"))


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Writes one record for each row of pages to gzip files under `path`: originals as responses with their payload, the rest as revisits.

    The payload is the column's UTF-8 (or binary as it is). Payloads of fewer than min_bytes are all responses.

    Defined results: a null payload is empty; a null address gives a record without one; a null id is the last, and
    its record has no Page-Id; rows equal in id, address and payload are one original and revisits of it; of equal payloads under one id
    the least address is the original; other columns are ignored, whatever their names; an empty table writes no records.
    """
    captures = _captures(pages, id_col, url_col, payload_col)
    resolved = materialize(resolve_revisits(captures.select("page_id", "uri", "digest", F.octet_length("payload").cast("long").alias("bytes")), min_bytes), "warc-resolved", compact=True)
    alone, original = F.col("head_uri").isNull(), F.col("page_id").eqNullSafe(F.col("head_id")) & (F.col("uri") == F.col("head_uri"))
    # what stays a response with its payload, and how often; the payload of equal rows is fetched once
    key = lambda: [F.coalesce("page_id", F.lit(-1)).alias("k"), F.col("page_id").isNull().alias("none")]
    full = resolved.where(alone | original).select(*key(), "uri", "digest", "bytes", F.when(alone, F.col("n")).otherwise(1).alias("times"))
    payloads = captures.select(*key(), "uri", "digest", "payload").join(full, ["k", "none", "uri", "digest"])
    payloads = payloads.groupBy("k", "none", "uri", "digest").agg(F.first("payload").alias("payload"), F.first("bytes").alias("bytes"), F.first("times").alias("times"))
    empty = lambda kind: F.lit(None).cast(kind)
    responses = payloads.select(F.lit("response").alias("kind"), F.when(~F.col("none"), F.col("k")).alias("page_id"), "uri", "digest", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)).alias("copy"), empty("long").alias("head_id"), empty("string").alias("head_uri"), "payload")
    times = F.col("n") - original.cast("int")
    again = resolved.where(~alone & (times > 0)).select(F.lit("revisit").alias("kind"), "page_id", "uri", "digest", "bytes", F.explode(F.sequence(F.lit(1).cast("long"), times)).alias("copy"), "head_id", "head_uri", empty("binary").alias("payload"))
    _written(responses.unionByName(again), date).write.option("lineSep", GAP).option("compression", "gzip").text(path)


def _fields(header: bytes) -> dict[str, str]:
    """Names, in lower case, and values of header lines; the first line is not one."""
    found = {}
    for row in header.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = row.partition(":")
        if colon:
            found.setdefault(name.strip().lower(), value.strip())
    return found


class _Reader:
    """Takes an archive's bytes piece by piece and gives its records; holds one record at a time."""

    def __init__(self) -> None:
        self.pieces: list[bytes] = []
        self.size = 0
        self.header: dict[str, str] | None = None
        self.need = 0

    def add(self, piece: bytes) -> list[tuple[dict[str, str], bytes]]:
        gap, out = GAP.encode(), []
        self.pieces += (piece, gap)
        self.size += len(piece) + len(gap)
        while True:
            if self.header is None:
                held = b"".join(self.pieces)
                text = held.lstrip(b"\r\n")
                end = text.find(gap)
                if end < 0:
                    self.pieces, self.size = [text], len(text)
                    return out
                self.header = _fields(text[:end]) if text.startswith(b"WARC/") else {}
                length = self.header.get("content-length", "")
                rest = text[end + len(gap) :]
                if not re.fullmatch(r"\d+", length):
                    self.header = None  # not a record: what follows the empty line may be one
                self.need = int(length) if self.header else 0
                self.pieces, self.size = [rest], len(rest)
                if self.header is None:
                    continue
            if self.size < self.need + len(gap):
                return out
            held = b"".join(self.pieces)
            out.append((self.header, held[: self.need]))
            held = held[self.need + len(gap) :]
            self.header, self.pieces, self.size = None, [held], len(held)


def _sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(header: dict[str, str], block: bytes, payloads: bool) -> tuple:
    head, gap, payload = block.partition(GAP.encode())
    revisit = header.get("warc-type") == "revisit"
    own = None if revisit else payload if gap else block
    digest = header.get("warc-payload-digest", "").rpartition(":")[2] or None
    computed = None if own is None else _sha1(own)
    stated = header.get("warc-block-digest", "").rpartition(":")[2]
    page = header.get("page-id", "")
    return (
        header.get("warc-record-id"), header.get("warc-type"), int(page) if re.fullmatch(r"-?\d+", page) else None, header.get("warc-target-uri"), header.get("warc-date"),
        computed or digest, None if own is None else len(own), header.get("warc-refers-to"), (not stated or stated == _sha1(block)) and (computed is None or digest in (None, computed)), own if payloads else None,
    )


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of the gzip archives under path: record_id, record_type, page_id, uri, date, payload_digest, payload_bytes, refers_to, intact, payload.

    The digest and size of a response are those of the payload that was read; a revisit has the digest that it states, and neither size nor payload.
    intact: the digests that the record states agree with what was read. payloads False leaves payload null. Bytes that
    are no record are passed over; a record cut short at the end of a file is dropped.
    """
    lines = spark.read.option("lineSep", GAP).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))
    schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("uri", pa.string()), ("date", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.string()), ("intact", pa.bool_()), ("payload", pa.binary())])

    def of(batches):
        reader, file, held, size = _Reader(), None, [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)

        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name != file:
                    reader, file = _Reader(), name
                for header, block in reader.add(value):
                    held.append(_record(header, block, payloads))
                    size += 400 + (len(block) if payloads else 0)
                    if size > 2 << 20:
                        yield out()
                        held, size = [], 0
        if held:
            yield out()

    bounded(spark)
    return lines.mapInArrow(of, RECORD)


def originals(records: DataFrame) -> DataFrame:
    """Records with original_id, the page_id of the response that a revisit refers to, and payload_bytes of that response.

    Both are null for a revisit whose original is in none of the archives; the payload is left out.
    """
    records = materialize(records.drop("payload"), "warc-records", compact=True)
    own = records.columns
    held = records.where("record_type = 'response' and record_id is not null").groupBy("record_id").agg(F.min("page_id").alias("original_id"), F.min("payload_bytes").alias("original_bytes"))
    revisits = spread_join(records.where("record_type = 'revisit'").select(own), held.withColumnRenamed("record_id", "refers_to"), ["refers_to"], "left")
    found = records.where("record_type <> 'revisit'").select(*own, F.lit(None).cast("long").alias("original_id"), F.lit(None).cast("long").alias("original_bytes")).unionByName(revisits)
    return found.withColumn("payload_bytes", F.coalesce("payload_bytes", "original_bytes")).drop("original_bytes")


def deduplicate_archives(spark: SparkSession, source: str, target: str, date: str | None = None, min_bytes: int = 0) -> None:
    """Reads the responses of the archives under source and writes them to target with revisits in place of repeated payloads.

    Revisits of the source refer to a payload that one of its responses has; they are written as revisits again. A revisit
    whose original is missing has no payload to write and is left out.
    """
    records = read_archives(spark, source)
    named = records.withColumnRenamed("payload", "html").withColumnRenamed("uri", "url")
    responses = named.where("record_type = 'response'").select("page_id", "url", "html", "record_id")
    revisits = spread_join(named.where("record_type = 'revisit'").select("page_id", "url", F.col("refers_to").alias("record_id")), responses.groupBy("record_id").agg(F.first("html").alias("html")), ["record_id"])
    pages = responses.select("page_id", "url", "html").unionByName(revisits.select("page_id", "url", "html"))
    write_archives(pages, target, date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"), min_bytes)
