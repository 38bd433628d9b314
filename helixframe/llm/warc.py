"""WARC archives with revisit records for repeated payloads, written and read back."""

from __future__ import annotations

import datetime
import gzip
import hashlib
import io
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import written

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long"


def _uuid(page_id):
    """A record's urn, made from its page id alone."""
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit(""))).cast("binary"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def write_warc(pages: DataFrame, path: str, *, min_bytes: int = 100, date: str | None = None, records_per_file: int = 20_000) -> None:
    """Writes one WARC/1.1 record per row of ``pages(page_id, url, html)`` under ``path``.

    The payload is the html in UTF-8 (null: empty) behind a fresh HTTP header.
    Of rows with equal payloads of ``min_bytes`` or more, the one with the
    smallest page_id becomes ``response``, the others ``revisit`` records that
    refer to it and hold no payload; smaller payloads are always ``response``.
    Only headers (page_id, digest, length) are shuffled by digest, with a
    partial minimum first, so a payload that a third of the rows share costs a
    row a task; the html moves once, by page. Rows that repeat a response's
    page_id and payload are responses too; a row with null page_id is a
    response and is referred to by none. Files are gzip and end after ``records_per_file``.
    """
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("n"), F.sha2(payload.cast("binary"), 256).alias("digest"))
    heads = rows.where(F.col("n") >= min_bytes).select("page_id", "digest")
    first = heads.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("c")).where("c > 1").drop("c")
    again = heads.join(first, "digest").where("page_id > refers_to").distinct()
    rows = rows.join(again, ["page_id", "digest"], "left")
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))
    maybe = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _uuid(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        maybe("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]+", "%0D%0A")),
        maybe("WARC-Page-ID", F.col("page_id")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _uuid(F.col("refers_to"))), line("WARC-Refers-To-Page-ID", F.col("refers_to")))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block)),
        F.lit("\r\n"),
        block,
    )
    # A record ends with two line ends: that is what the text sink puts after each row.
    rows.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file).option("compression", "gzip").text(path)


def records(archive: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an open archive, one in memory at a time: header fields in lower case, and the block."""
    while first := archive.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record where {first[:40]!r} stands")
        head = {}
        while (line := archive.readline()) != b"\r\n":
            if not line:
                raise ValueError("an archive ends in a header")
            key, _, value = line.decode().removesuffix("\r\n").partition(": ")
            head[key.lower()] = value
        block = archive.read(n := int(head["content-length"]))
        if len(block) < n or archive.read(4) != b"\r\n\r\n":
            raise ValueError("an archive ends in a record")
        yield head, block


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = lambda x: None if x is None else int(x)
    for batch in batches:
        for data in batch.column(0):
            out = []
            for head, block in records(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data.as_py())), 1 << 18)):
                digest, n = head["warc-payload-digest"].removeprefix("sha256:"), None
                if head["warc-type"] == "response":
                    payload = block.partition(b"\r\n\r\n")[2]
                    n = len(payload)
                    if hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"payload of {head['warc-record-id']} differs from its digest")
                out.append((number(head.get("warc-page-id")), head.get("warc-target-uri"), head["warc-type"], digest, n, number(head.get("warc-refers-to-page-id"))))
            types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
            names = [x.split()[0] for x in READ.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, types, strict=True)], names=names)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records under ``path``: page_id, url, record_type, payload_digest, payload_bytes, refers_to.

    Each payload is held against its digest. Revisit records hold no payload:
    their length is that of the response with the same digest, found by a join
    of headers (:func:`resolved`); a revisit record without such a response has null there.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0")
    return written(files.select("content").mapInArrow(_parse, READ), "warc-heads")


def resolved(found: DataFrame) -> DataFrame:
    """``read_warc`` records with the payload length of revisits from their originals."""
    known = found.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("_n"))
    again = found.where("record_type = 'revisit'").join(known, "payload_digest", "left").withColumn("payload_bytes", F.col("_n")).drop("_n")
    return found.where("record_type = 'response'").unionByName(again)
