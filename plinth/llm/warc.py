"""WARC archives: writing captures and assembling them again.

A capture is three records: request, response (or revisit) and metadata.  Request and metadata
name the response in WARC-Concurrent-To; the reader parses records from the archive bytes and
joins the three into one nested row.  Of captures with equal payloads the one with the smallest
page id carries the payload, the others revisit it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm.common import shared_folder, staged

BASE16 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n\r\n"  # after every record; the line separator of the written files
DATE = "2024-01-01T00:00:00Z"
# Copies of one payload are dealt over so many keys when they look up the page they revisit.
SALTS = 32
RECORDS_PER_FILE = 1500

RECORD = ("id string, type string, concurrent_to string, refers_to string, uri string, date string, page_id long, "
          "payload_bytes long, payload_digest string, body binary")


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: four groups of five bytes, eight digits each."""
    digest = F.upper(F.sha1(payload))
    groups = [F.lpad(F.conv(F.substr(digest, F.lit(1 + 10 * k), F.lit(10)), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*groups), BASE16, BASE32)


def header(kind: str, identifier: Column, length: Column, mime: str, *more: Column) -> Column:
    """The header block of a record up to and with its empty line."""
    return F.concat(F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:"), identifier,
                    F.lit(f">\r\nWARC-Date: {DATE}\r\nContent-Type: {mime}\r\n"), *more,
                    F.lit("Content-Length: "), F.octet_length(length).cast("string"), F.lit("\r\n\r\n"))


def owners(pages: DataFrame) -> DataFrame:
    """(digest, owner) of payloads that more than one page has; counted before the shuffle."""
    return pages.groupBy("digest").agg(F.min("page").alias("owner"), F.count("*").alias("copies")).where("copies > 1").drop("copies")


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> str:
    """Write gzip WARC files to the shared folder; returns their path.

    A null payload is an empty one; payloads of fewer than ``least`` bytes never revisit; rows
    that repeat a page id with an equal payload are both responses; a page without an id is a
    response if no page with an id has its payload, else it revisits that page; a null url gives
    no target.  An empty table writes no record.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", base32_sha1(F.col("html"))).withColumn("size", F.octet_length("html").cast("long"))
    shared = staged(owners(rows.where(F.col("size") >= least).select("digest", "page")), "owners")
    dealt = shared.select("digest", "owner", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.when(F.col("size") >= least, F.pmod(F.xxhash64(F.col("page"), F.col("url")), F.lit(SALTS)).cast("int")))
    known = salted.join(dealt, ["digest", "salt"], "left")
    first = F.col("owner").isNull() | F.col("page").eqNullSafe(F.col("owner"))
    uri = F.when(F.col("url").isNull(), "").otherwise(F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", "[\r\n]", "%0A"), F.lit("\r\n")))
    capture = F.concat(F.lit("WARC-Concurrent-To: <urn:uuid:"), F.col("uuid"), F.lit(">\r\n"))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    full, bare = F.concat(http, F.col("html")), http
    ask = F.lit("GET / HTTP/1.1\r\n\r\n")
    facts = F.concat(F.when(F.col("page").isNull(), "").otherwise(F.concat(F.lit("page-id: "), F.col("page").cast("string"), F.lit("\r\n"))),
                     F.lit("payload-length: "), F.col("size").cast("string"), F.lit("\r\n"))
    refers = F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("owner").cast("string"),
                      F.lit(">\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"))
    main = F.when(first, F.concat(header("response", F.col("uuid"), full, "application/http;msgtype=response", uri, digest), full)).otherwise(
        F.concat(header("revisit", F.col("uuid"), bare, "application/http;msgtype=response", uri, digest, refers), bare))
    request = F.concat(header("request", F.uuid(), ask, "application/http;msgtype=request", uri, capture), ask)
    metadata = F.concat(header("metadata", F.uuid(), facts, "application/warc-fields", uri, capture), facts)
    records = known.withColumn("uuid", F.uuid()).withColumn("first", first).select(F.explode(F.array(main, request, metadata)).alias("value"))
    path = shared_folder(pages.sparkSession, "warc")
    records.write.option("lineSep", END).option("maxRecordsPerFile", RECORDS_PER_FILE).option("compression", "gzip").text(path)
    return path


def parse_records(data: bytes):
    """The records of an uncompressed archive, by their stated lengths."""
    at = 0
    while at < len(data):
        head_end = data.index(b"\r\n\r\n", at)
        lines = data[at:head_end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {name.lower(): value for name, value in (line.split(": ", 1) for line in lines[1:])}
        start = head_end + 4
        end = start + int(fields["content-length"])
        if data[end:end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end where it says")
        yield fields, data[start:end]
        at = end + 4


def record_row(fields: dict, block: bytes) -> tuple:
    """A record as a row of RECORD: ids without brackets, the payload's own length and digest."""
    def bare(name: str) -> str | None:
        return fields[name][1:-1].removeprefix("urn:uuid:") if name in fields else None

    kind, page, size, digest, body = fields["warc-type"], None, None, None, block
    if kind == "response":
        body = block[block.index(b"\r\n\r\n") + 4:]
        size, digest = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
        if fields["warc-payload-digest"] != f"sha1:{digest}":
            raise ValueError(f"payload of {fields['warc-record-id']} does not have its digest")
    elif kind == "revisit":
        digest, body = fields["warc-payload-digest"].removeprefix("sha1:"), b""
    elif kind == "metadata":
        facts = dict(line.split(": ", 1) for line in block.decode().split("\r\n") if line)
        page, size = int(facts["page-id"]) if "page-id" in facts else None, int(facts["payload-length"])
    return (bare("warc-record-id"), kind, bare("warc-concurrent-to"), bare("warc-refers-to"), fields.get("warc-target-uri"),
            fields["warc-date"], page, size, digest, body)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of all archives below a path; a file is one row of bounded size."""
    names = [part.split()[0] for part in RECORD.split(", ")]
    types = [pa.string()] * 6 + [pa.int64()] * 2 + [pa.string(), pa.binary()]

    def run(batches):
        for batch in batches:
            for cell in batch.column("content"):
                rows = []
                for fields, block in parse_records(gzip.decompress(cell.as_buffer())):
                    rows.append(record_row(fields, block))
                    if len(rows) == 256:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                        rows = []
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(run, RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: request, response or revisit, metadata.

    Requests and metadata find their capture by WARC-Concurrent-To.  A capture without one of
    them has null there; a request or metadata record of no capture is no capture.
    """
    part = F.struct("id", "uri", "date", "body")
    main = records.where("type IN ('response', 'revisit')").select(
        F.col("id").alias("capture"), F.col("type").alias("record_type"), "refers_to", "payload_digest", F.col("payload_bytes").alias("own_bytes"), part.alias("response"))
    request = records.where("type = 'request'").select(F.col("concurrent_to").alias("capture"), part.alias("request"))
    metadata = records.where("type = 'metadata'").select(
        F.col("concurrent_to").alias("capture"), F.struct("id", "uri", "date", "page_id", "payload_bytes").alias("metadata"))
    return main.join(request, "capture", "left").join(metadata, "capture", "left")


def page_digests(assembled: DataFrame) -> DataFrame:
    """The facts of each capture, those of the payload as the archive gives them back."""
    refers = F.when(F.col("record_type") == "revisit", F.regexp_replace("refers_to", "^urn:page:", "").cast("long"))
    return assembled.select(F.col("metadata.page_id").alias("page_id"), F.coalesce("own_bytes", "metadata.payload_bytes").alias("payload_bytes"),
                            "payload_digest", "record_type", refers.alias("refers_to"))
