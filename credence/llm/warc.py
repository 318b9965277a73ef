"""WARC archives of pages: each payload is stored once, later records of it are revisits.

Headers alone (page_id and payload digest) are shuffled to find the original of each digest; the payloads follow once,
dealt out by page_id. Spark's text writer lays the records down with WARC's own record end (two CRLFs) as the line
separator, gzip-compressed, with its commit protocol: a task that is run again leaves no second copy.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_dir, stored

#: RFC 4648 alphabet.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORD_END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADERS = "page_id long, record_type string, record_id string, payload_digest string, stored_bytes long, intact boolean"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: four characters from each five hexadecimal digits."""
    hexa = F.sha1(payload)
    bits = [F.conv(F.substring(hexa, 5 * k + 1, 5), 16, 10).cast("int") for k in range(8)]
    return F.concat(*(F.substring(F.lit(BASE32), F.shiftright(b, s).bitwiseAND(31) + 1, F.lit(1)) for b in bits for s in (15, 10, 5, 0)))


def _record_id(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("|", page_id.cast("string"), digest))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def originals(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(payload_digest, original, n, copies): the largest page_id of each payload of at least min_bytes, its bytes and records. Only digests are shuffled, pre-aggregated by task."""
    html = F.coalesce(pages["html"].cast("string"), F.lit(""))
    heads = pages.select(pages["page_id"].cast("long").alias("page_id"), base32_sha1(html).alias("payload_digest"), F.octet_length(html).alias("n"))
    return heads.filter(F.col("n") >= min_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("original"), F.max("n").alias("n"), F.count("*").alias("copies"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, date: datetime | None = None, file_bytes: int = 256 << 20) -> None:
    """Write one record per row of pages (page_id, url, html) under path, a folder that doesn't exist yet.

    Payload: html in UTF-8; null is empty. Of records with equal payloads of at least min_bytes, the largest page_id is the
    response, the others are revisits of it; rows that repeat that page_id and payload are responses too. A null page_id
    gets no header of its own and is a response unless another page has its payload. Null urls become urn:unknown;
    white space and control characters in urls are escaped. A file takes as many records as file_bytes hold on average, 20,000 at
    most; a very long payload is one record.
    """
    spark = pages.sparkSession
    known = stored(originals(pages, min_bytes), f"{path}.originals")
    mean = known.agg(F.sum(F.col("n") * F.col("copies")) / F.sum("copies")).first()[0] or 0
    records_per_file = max(1, min(20_000, int(file_bytes // (mean + 512))))
    known = known.select("payload_digest", "original")
    html = F.coalesce(pages["html"].cast("string"), F.lit(""))
    url = F.regexp_replace(F.coalesce(pages["url"].cast("string"), F.lit("urn:unknown")), "[\\x00-\\x20\\x7F]", "%20")
    heads = pages.select(pages["page_id"].cast("long").alias("page_id"), base32_sha1(html).alias("payload_digest")).distinct()
    # the headers are joined by digest (a payload of very many pages is split by AQE), the payloads by their own page
    heads = heads.join(known, "payload_digest", "left").select(F.col("page_id").alias("p"), F.col("payload_digest").alias("d"), "original")
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), url.alias("url"), html.alias("html"), base32_sha1(html).alias("digest"))
    rows = rows.join(heads, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left")
    revisit = F.coalesce(F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original")), F.lit(False))
    when = (date or datetime.now(timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit(RECORD_END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    lines = [
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), _record_id(F.col("page_id"), F.col("digest")),
        F.lit(f"\r\nWARC-Date: {when}\r\nWARC-Target-URI: "), F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(F.col("page_id").isNull(), "").otherwise(F.concat(F.lit("\r\nX-Page-ID: "), F.col("page_id").cast("string"))),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: "), _record_id(F.col("original"), F.col("digest")), F.lit(f"\r\nWARC-Profile: {PROFILE}"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length("block").cast("string"), F.lit(RECORD_END), F.col("block"),
    ]
    out = rows.withColumn("block", block).select(F.concat(*lines).alias("value"))
    out.write.option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def _records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of one archive, record by record."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            head[name.strip().lower()] = value.strip()
        block = stream.read(int(head["content-length"]))
        if len(block) != int(head["content-length"]):
            raise ValueError("an archive ends within a record")
        yield head, block


def _read_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in HEADERS.split(", ")]
    for batch in batches:
        for content in batch["content"]:
            rows: list[tuple] = []
            stream = io.BytesIO(content)
            for head, block in _records(gzip.GzipFile(fileobj=stream) if content[:2] == b"\x1f\x8b" else stream):
                digest, kind, page = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"], head.get("x-page-id")
                payload = block[block.index(b"\r\n\r\n") + 4 :]
                whole = kind == "revisit" or base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest
                rows.append((page and int(page), kind, head["warc-record-id"], digest, len(payload), whole))
                if len(rows) >= 5_000:
                    yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64"})
                    rows = []
            yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "stored_bytes": "int64", "intact": "bool"})


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The headers of all records under path (see HEADERS); stored_bytes and intact come from the payload itself."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInPandas(_read_files, HEADERS)


def resolved(records: DataFrame, path: str) -> DataFrame:
    """Each record with the length of its full payload and, for revisits, the page that holds it. The responses' headers are kept under path."""
    held = records.filter("record_type = 'response'").groupBy("payload_digest").agg(F.max("page_id").alias("at"), F.max("stored_bytes").alias("payload_bytes"))
    both = records.join(stored(held, path), "payload_digest", "left")
    return both.select("page_id", F.col("payload_bytes").cast("long"), "payload_digest", "record_type", F.when(F.col("record_type") == "revisit", F.col("at")).alias("refers_to"), "intact")


def deduplicated(pages: DataFrame, path: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write the archives, read them back and resolve the revisits: page_id, payload_bytes, payload_digest, record_type, refers_to, intact."""
    path = path or new_dir(pages.sparkSession, "warc")
    write_archives(pages, path, min_bytes)
    records = stored(read_archives(pages.sparkSession, path), f"{path}.headers")
    return resolved(records, f"{path}.responses")
