"""Operator 4, WARC archives without repeated payloads.

Only headers (id, digest, length) are dealt by payload digest: the least id of a digest is the original, others
become revisit records that refer to it. Then payloads move once, each to its archive: there are as many archives as
all payloads need at about FILE_BYTES each, and a record's id and digest say which is its own. Records are written
through Spark's text writer, whose line separator is the blank line that ends a record, as gzip files in a folder that
all executors share. They are read back piece by piece, cut by their lengths.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, stored, table

#: About so many payload bytes go to one archive, and so many are unpacked at a time.
FILE_BYTES = 16 << 20
PIECE_BYTES = 1 << 20
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: each 20 bits, 5 hex digits, are 4 letters."""
    sha = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(sha, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(page: Column) -> Column:
    """A record's name, from its page's id alone."""
    md5 = F.md5(F.concat(F.lit("page:"), F.coalesce(page.cast("string"), F.lit("null"))))
    cut = [F.substring(md5, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def payloads(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """id, url, payload, digest, size and key, which names a row's id and digest (null ids as well)."""
    d = pages.select(pages[id_col].cast("long").alias("id"), pages[url_col].cast("string").alias("url"), F.coalesce(pages[payload_col], F.lit("")).alias("payload"))
    d = d.withColumns({"digest": base32_sha1(F.encode("payload", "UTF-8")), "size": F.octet_length("payload").cast("long")})
    return d.withColumn("key", F.concat(F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(" "), "digest"))


def revisits(headers: DataFrame, least_bytes: int) -> DataFrame:
    """key and refers_to of the rows of headers (id, digest, size, key) that are revisits.

    The least ids of repeated digests are written before rows meet them, so that a digest of very many rows can be split.
    """
    headers = headers.where(F.col("size") >= least_bytes).select("id", "digest", "key")
    first = headers.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    first = stored(first.select("digest", "first"), "originals")
    found = headers.join(first, "digest").where("NOT (id <=> first)")
    return found.groupBy("key").agg(F.min("first").alias("refers_to"))


def resolved(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """id, url, payload, digest, size and refers_to (null for responses), dealt to archives of about file_bytes.

    Of records whose payloads are equal and have least_bytes bytes or more the one with the least id is the response
    (rows that repeat that id and payload as well), all others refer to it. Null payloads count as empty.
    Null ids never are originals; if none of a digest's rows has an id, all are responses. Other columns are not read.
    """
    d = payloads(pages, id_col, url_col, payload_col)
    headers = stored(d.select("id", "digest", "size", "key"), "headers")
    total = headers.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first().n
    archives = max(1, -(-total // file_bytes))
    found = revisits(headers, least_bytes).repartition(archives, "key")
    return d.repartition(archives, "key").join(found.hint("shuffle_hash"), "key", "left").drop("key")


def records(found: DataFrame) -> DataFrame:
    """The text of each record but for the blank line at its end: fresh headers, then the block."""
    revisit = F.col("refers_to").isNotNull()
    http = F.when(revisit, F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")).otherwise(
        F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"), F.col("payload"))
    )
    url = F.regexp_replace(F.coalesce("url", F.lit("")), "[\\r\\n]", "")
    lines = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), record_id(F.col("id"))),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("X-Page-Id: "), F.col("id").cast("string")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.concat(F.lit("X-Payload-Length: "), F.col("size").cast("string")),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), record_id(F.col("refers_to")))),
        F.when(revisit, F.concat(F.lit("X-Refers-To-Page-Id: "), F.col("refers_to").cast("string"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length("http").cast("string")),
    )
    return found.withColumn("http", http).select(F.concat(lines, F.lit(END), F.col("http")).alias("value"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Write a record for every row of pages, gzip archives of about file_bytes of payloads below path."""
    found = resolved(pages, id_col, url_col, payload_col, least_bytes, file_bytes)
    records(found).write.option("lineSep", END).option("compression", "gzip").text(path)


HEADER = re.compile(rb"([^:\r\n]+): *([^\r\n]*)\r\n")


def unpacked(raw: memoryview):
    """The bytes of a gzip file (of one member or of several), PIECE_BYTES at a time."""
    unpack, rest = zlib.decompressobj(31), bytes(raw[:PIECE_BYTES])
    at = len(rest)
    while rest or at < len(raw):
        if not rest:
            rest = bytes(raw[at : at + PIECE_BYTES])
            at += len(rest)
        yield unpack.decompress(rest, PIECE_BYTES)
        rest = unpack.unconsumed_tail
        if unpack.eof:
            rest, unpack = unpack.unused_data, zlib.decompressobj(31)
    yield unpack.flush()


def cut_records(pieces):
    """Head and block of each record of a stream of bytes; it holds no more than a record and a piece."""
    held, at = bytearray(), 0

    def fill(n: int) -> bool:
        while len(held) < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while fill(5):
        if not held.startswith(b"WARC/"):
            raise ValueError(f"no record at byte {at}")
        looked = 0
        while (end := held.find(b"\r\n\r\n", looked)) < 0:
            looked = max(0, len(held) - 3)
            if not fill(len(held) + 1):
                raise ValueError(f"a head without end at byte {at}")
        head = dict(HEADER.findall(bytes(held[: end + 2])))
        stop = end + 4 + int(head[b"Content-Length"])
        if not fill(stop):
            raise ValueError(f"a record cut short at byte {at}")
        yield head, bytes(held[end + 4 : stop])
        fill(stop + 4)
        del held[: stop + 4]
        at += stop + 4


def record_row(head: dict, block: bytes) -> dict:
    revisit = head[b"WARC-Type"] == b"revisit"
    payload = None if revisit else block[block.index(b"\r\n\r\n") + 4 :]
    digest = head[b"WARC-Payload-Digest"].removeprefix(b"sha1:").decode()
    if payload is not None and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"payload and digest {digest} differ")
    number = {k: int(head[k]) if head.get(k) else None for k in (b"X-Page-Id", b"X-Refers-To-Page-Id")}
    return {
        "page_id": number[b"X-Page-Id"],
        "url": head[b"WARC-Target-URI"].decode(),
        "payload_bytes": len(payload) if payload is not None else int(head[b"X-Payload-Length"]),
        "payload_digest": digest,
        "record_type": "revisit" if revisit else "response",
        "refers_to": number[b"X-Refers-To-Page-Id"],
        "payload": None if payload is None else payload.decode(),
    }


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Every record of the archives below path: page_id, url, payload_bytes, payload_digest, record_type, refers_to, and
    with payload the payload.

    Records are cut by their Content-Length, so blank lines and record heads inside a payload do no harm. A revisit's
    payload is null, its payload_bytes and payload_digest are those of the original's payload. A payload that
    differs from its digest, and a record cut short, is an error.
    """
    schema = RECORDS if payload else pa.schema(list(RECORDS)[:-1])

    def one(files):
        for batch in files:
            for content in batch.column("content"):
                rows, held = [], 0
                for head, block in cut_records(unpacked(memoryview(content.as_buffer()))):
                    row = record_row(head, block)
                    rows.append(row if payload else {k: v for k, v in row.items() if k != "payload"})
                    held += len(block) if payload else 256
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    kinds = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return files.mapInArrow(one, kinds + (", payload string" if payload else ""))


RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.string())])


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/archives"
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path, payload=False).drop("url")


OP4_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages
), d AS (
  SELECT page_id, payload_bytes, list_aggregate(list_transform(generate_series(0, 31), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((
      (CAST(('0x' || substr(sha, CAST(1 + 5 * (i // 4) AS BIGINT), 5)) AS BIGINT) >> CAST(5 * (3 - i % 4) AS BIGINT)) & 31) AS BIGINT), 1)), 'string_agg', '') AS payload_digest FROM p
), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM f
"""
