"""WARC archives: written by Spark's text writer, read back by byte, and assembled into captures."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import itertools
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import scratch_path, table, written

END = "\r\n\r\n"
#: An archive file holds about so many bytes of payload, and no more records than this.
FILE_BYTES = 64 << 20
FILE_RECORDS = 60_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: each ten hex digits are eight digits in base 32."""
    sha = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(sha, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record(kind: str, rid: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record without the two line ends that follow it: the writer's line separator is those."""
    lines = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <"), rid, F.lit(f">\r\nWARC-Date: {DATE}")]
    for name, value in headers:
        lines.append(F.coalesce(F.concat(F.lit(f"\r\n{name}: "), value), F.lit("")))
    lines += [F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END), block]
    return F.concat(*lines)


def _clean(value: Column) -> Column:
    """A header value: white space and control characters become %20."""
    return F.regexp_replace(value, r"[\x00-\x20\x7F]+", "%20")


def plan_records(pages: DataFrame, least_revisit_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """pages (page_id, url, html) with payload, its digest and size, a record id, and refers_to: the record of the largest page_id of an equal payload, for the others.

    That record is an aggregate of small rows for each digest, so a payload that very many pages share gathers ids only: the html is dealt by page id and digest, into as many
    partitions as it has file_bytes. Payloads under least_revisit_bytes refer to none. Rows that share the largest id of their payload are all responses.
    """
    payload = F.coalesce("html", F.lit(""))
    keys = written(pages.select("page_id", payload_digest(payload.cast("binary")).alias("digest"), F.octet_length(payload).cast("long").alias("size")), "keys")
    first = keys.groupBy("digest").agg(F.max("page_id").alias("original"), F.count("*").alias("n"), F.max("size").alias("size"))
    rid = lambda page, number: F.concat(F.lit("urn:x-capture:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(":"), F.col("digest"), F.lit(":"), number.cast("string"))
    repeated = first.where((F.col("n") > 1) & (F.col("size") >= least_revisit_bytes)).select("digest", "original")
    others = keys.select("page_id", "digest").distinct().join(repeated, "digest").where(~F.col("page_id").eqNullSafe(F.col("original")))
    others = others.select(F.struct("page_id", "digest").alias("same"), rid(F.col("original"), F.lit(1)).alias("refers_to"))
    files = 1 + (keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] // file_bytes)
    p = pages.select("page_id", "url", payload.alias("payload")).withColumns({"digest": payload_digest(F.col("payload").cast("binary")), "size": F.octet_length("payload").cast("long")})
    p = p.withColumn("same", F.struct("page_id", "digest")).repartition(files, "same")
    p = p.withColumn("number", F.row_number().over(W.partitionBy("same").orderBy("url")))
    return p.join(others, "same", "left").withColumn("rid", rid(F.col("page_id"), F.col("number"))).drop("same", "number")


def write_archives(pages: DataFrame, path: str, least_revisit_bytes: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Write request, response or revisit, and metadata records of each page, in this order, as gzipped WARC files of about file_bytes of payload (and of FILE_RECORDS records at most) under path.

    A line of the text writer is a record, and its line separator the end of a record. The payload follows an
    HTTP head; a revisit has the head alone.
    """
    p = plan_records(pages, least_revisit_bytes, file_bytes)
    url = F.coalesce(_clean(F.col("url")), F.lit("urn:x-none"))
    host = F.coalesce(F.regexp_extract(url, r"^[a-z]+://([^/?#]*)", 1), F.lit(""))
    number = ("X-Page-ID", F.col("page_id").cast("string"))
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    head = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    http = ("Content-Type", F.lit("application/http; msgtype=response"))
    common = [("WARC-Target-URI", url), number, ("WARC-Payload-Digest", digest)]
    response = _record("response", F.col("rid"), [*common, http], F.concat(head, F.col("payload")))
    revisit = _record("revisit", F.col("rid"), [*common, ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", F.concat(F.lit("<"), F.col("refers_to"), F.lit(">"))), http], head)
    concurrent = ("WARC-Concurrent-To", F.concat(F.lit("<"), F.col("rid"), F.lit(">")))
    request = _record("request", F.concat(F.col("rid"), F.lit(":request")), [("WARC-Target-URI", url), concurrent, ("Content-Type", F.lit("application/http; msgtype=request"))], F.concat(F.lit("GET "), url, F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END)))
    metadata = _record("metadata", F.concat(F.col("rid"), F.lit(":metadata")), [("WARC-Target-URI", url), concurrent, ("Content-Type", F.lit("application/warc-fields"))], F.concat(F.lit("fetchTimeMs: 0\r\noctets: "), F.col("size").cast("string"), F.lit("\r\n")))
    records = p.select(F.explode(F.array(request, F.when(F.col("refers_to").isNull(), response).otherwise(revisit), metadata)).alias("value"))
    records.write.option("lineSep", END).option("maxRecordsPerFile", FILE_RECORDS).option("compression", "gzip").text(path)


def parse_archive(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a WARC file, one record in memory at a time."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        headers = {}
        while line := stream.readline().rstrip(b"\r\n"):
            name, _, value = line.decode("utf-8").partition(": ")
            headers[name.lower()] = value
        block = stream.read(size := int(headers["content-length"]))
        if len(block) < size:
            raise ValueError("a record is cut short")
        yield headers, block
        stream.read(len(END))


def _fields(h: dict[str, str], block: bytes) -> tuple:
    kind, size, digest, octets = h["warc-type"], None, None, None
    if kind == "response":
        payload = memoryview(block)[block.index(b"\r\n\r\n") + 4 :]
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    elif kind == "metadata":
        octets = dict(x.split(": ", 1) for x in block.decode().split("\r\n") if x)["octets"]
    return (h["warc-record-id"], kind, h.get("warc-concurrent-to"), int(h["x-page-id"]) if "x-page-id" in h else None, h.get("warc-target-uri"), h.get("warc-payload-digest", "").removeprefix("sha1:") or None, h.get("warc-refers-to"), size, digest, octets)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the WARC files under path; of a response, its payload's bytes and digest are computed from what was read. A task holds a file as it is, compressed, and unpacks record by record."""
    schema = "record_id string, kind string, concurrent_to string, page_id long, url string, declared string, refers_to string, payload_bytes long, payload_digest string, octets string"
    columns = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                records = parse_archive(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content))))
                while rows := [_fields(*record) for record in itertools.islice(records, 2000)]:
                    yield pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "payload_bytes": "Int64"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInPandas(run, schema)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: page_id, url, and nested main (response or revisit), request and metadata records.

    Requests and metadata name the main record they are concurrent to; equal identifiers meet in an
    aggregation, so a capture whose request or metadata is missing still gets a row, with null there.
    """
    key = F.coalesce("concurrent_to", "record_id").alias("capture")
    one = F.struct("record_id", "kind", "page_id", "url", "declared", "refers_to", "payload_bytes", "payload_digest")
    side = F.struct("record_id", "url", "octets")
    got = records.select(key, "kind", one.alias("one"), side.alias("side"))
    pick = lambda cond, what: F.first(F.when(cond, F.col(what)), ignorenulls=True)
    captures = got.groupBy("capture").agg(pick(F.col("kind").isin("response", "revisit"), "one").alias("main"), pick(F.col("kind") == "request", "side").alias("request"), pick(F.col("kind") == "metadata", "side").alias("metadata"))
    return captures.where("main is not null").select(F.col("main.page_id").alias("page_id"), F.col("main.url").alias("url"), "main", "request", "metadata")


def resolve(captures: DataFrame) -> DataFrame:
    """Payload size and digest of every capture: a revisit has those of the response it refers to, whose digest must be the one it declares. The target of its request and the octets of its metadata stand beside them."""
    m = captures.select("main.*", F.col("request.url").alias("request_url"), F.col("metadata.octets").cast("long").alias("metadata_octets"))
    there = m.where("kind = 'response'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("p"), F.col("payload_bytes").alias("b"), F.col("payload_digest").alias("d"))
    sides = ("url", "request_url", "metadata_octets")
    own = m.where("refers_to is null").select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), *sides)
    others = m.where("refers_to is not null").drop("payload_bytes", "payload_digest").join(there, "refers_to", "left")
    same = F.col("declared") == F.col("d")
    others = others.select("page_id", F.when(same, F.col("b")).alias("payload_bytes"), F.when(same, F.col("d")).alias("payload_digest"), F.col("kind").alias("record_type"), F.col("p").alias("refers_to"), *sides)
    return own.union(others)


def op3_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the pages as archives, read them back and assemble the captures.

    Null html is an empty payload; a null url becomes urn:x-none; equal rows are captures of their own; an
    empty table writes no record and gives no row.
    """
    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return resolve(assemble(read_archives(spark, path)))


_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, coalesce(regexp_replace(url, '[\\x00-\\x20\\x7F]+', '%20', 'g'), 'urn:x-none') AS url FROM pages),
d AS (SELECT *, sha1(payload) AS sha, max(page_id) OVER (PARTITION BY payload) AS original FROM p)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
array_to_string([substr('{_DIGITS}', CAST((CAST('0x' || substr(sha, 10 * (i // 8) + 1, 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31 AS INT) + 1, 1) FOR i IN range(32)], '') AS payload_digest,
CASE WHEN page_id IS NOT DISTINCT FROM original THEN 'response' ELSE 'revisit' END AS record_type,
CASE WHEN page_id IS DISTINCT FROM original THEN original END AS refers_to,
url, url AS request_url, CAST(strlen(payload) AS BIGINT) AS metadata_octets FROM d
"""
