"""WARC archives of pages: written with revisit records for repeated payloads, read back by their chain of records.

Writing: payload digests are grouped (combined before they move) to find payloads that repeat; the record of the largest
page id holds the payload and the others refer to it. Records are lines of Spark's text writer whose separator is the
record end, so archives are plain WARC files on any file system that Spark writes to.

Reading: tasks look for the magic anywhere in an archive and emit each candidate record's offset with its successor's,
which its header's length tells; a candidate whose successor is neither a candidate nor the file's end is dropped. From
the first record, pointer jumping over each file's offsets (ranks doubled in each step) keeps what can be reached, so
a magic, or whole records, inside a payload are rejected. A file's candidates are bounded by its size, which the writer
bounds.

Defined results: null html is an empty payload; of repeated rows with the payload's largest id all are responses; a null
id is smaller than any other, and where a payload has null ids only, all are responses; a null url leaves its header
out, and line ends in a url become spaces; an empty table gives no records; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAGIC = b"WARC/1.0\r\n"
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
FILE_BYTES = 8 << 20
#: Repeated payloads up to which their table (about 60 bytes a row) is broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 100_000
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in base 32: 40 bits are ten digits by 16 and eight by 32."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _BASE32)


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """page_id, url, html, digest, bytes, refers_to (null for a response)."""
    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(html, F.lit("")).alias("html"))
    own = own.withColumn("digest", base32_sha1(F.col("html").cast("binary"))).withColumn("bytes", F.octet_length("html").cast("long"))
    same = own.groupBy("digest", "bytes").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    repeated = same.filter((F.col("n") > 1) & (F.col("bytes") >= min_bytes)).select("digest", "bytes", "last")
    repeated, _ = common.stored(repeated, "repeated")
    if repeated.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        repeated = F.broadcast(repeated)
    met = own.join(repeated, ["digest", "bytes"], "left")
    first = F.col("last").isNull() | F.col("page_id").eqNullSafe(F.col("last"))
    return met.select("page_id", "url", "html", "digest", "bytes", F.when(~first, F.col("last")).alias("refers_to"))


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def write(found: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Write the rows of records() as archives of about file_bytes each."""
    response = F.col("refers_to").isNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), _header("Content-Length", F.col("bytes").cast("string")), F.lit("\r\n"))
    block = F.concat(http, F.when(response, F.col("html")).otherwise(""))
    urn = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))
    refers = F.concat(
        _header("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        _header("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")),
    )
    record = F.concat(
        F.lit(MAGIC.decode()),
        _header("WARC-Type", F.when(response, "response").otherwise("revisit")),
        _header("WARC-Record-ID", urn),
        _header("WARC-Date", F.lit(DATE)),
        F.when(F.col("url").isNotNull(), _header("WARC-Target-URI", F.translate("url", "\r\n", "  "))).otherwise(""),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(~response, refers).otherwise(""),
        _header("Content-Type", F.lit("application/http; msgtype=response")),
        _header("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )
    mean = found.select(F.avg(F.col("bytes") + 600)).first()[0] or file_bytes
    found.select(record.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", max(1, int(file_bytes / mean))).text(path)


_ID = re.compile(rb"<urn:page:(-?\d+)>")


def _fields(head: bytes) -> dict[bytes, bytes]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:])}


def candidates(content: bytes) -> Iterator[tuple]:
    """(offset, successor, page id, payload bytes, digest, type, refers to) wherever the magic stands and the length in
    the header leads to the end or to another magic."""
    at = content.find(MAGIC)
    while at >= 0:
        cut = content.find(b"\r\n\r\n", at)
        fields = _fields(content[at:cut]) if cut >= 0 else {}
        length = fields.get(b"content-length", b"")
        if length.isdigit() and len(length) < 16:
            body = cut + 4
            after = body + int(length) + 4
            if after <= len(content) and content[after - 4 : after] == b"\r\n\r\n" and (after == len(content) or content.startswith(MAGIC, after)):
                kind = fields.get(b"warc-type", b"").decode("latin-1")
                own, other = _ID.match(fields.get(b"warc-record-id", b"")), _ID.match(fields.get(b"warc-refers-to", b""))
                split = content.find(b"\r\n\r\n", body, after - 4)
                http = _fields(content[body:split]) if split >= 0 else {}
                digest = fields.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode("latin-1")
                size = int(http.get(b"content-length", b"0") or 0)
                if kind == "response":
                    payload = memoryview(content)[split + 4 : after - 4]
                    size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                yield at, after, int(own[1]) if own else None, size, digest, kind, int(other[1]) if other else None
        at = content.find(MAGIC, at + 1)


_FOUND = "path string, size bigint, at bigint, after bigint, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
_KINDS = [pa.string() if "string" in c else pa.int64() for c in _FOUND.split(", ")]
_NAMES = [c.split()[0] for c in _FOUND.split(", ")]


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = content.as_py()
            rows = [(path, len(data), *c) for c in candidates(data)]
            if rows:
                yield pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*rows), _KINDS)], _NAMES)


def reachable(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Which of the offsets (sorted, different) the chain from offset 0 visits, in as many steps as its length has bits."""
    jump = np.searchsorted(at, after)
    jump[(jump >= len(at)) | (at[np.minimum(jump, len(at) - 1)] != after)] = len(at)
    jump = np.append(jump, len(at))
    on = np.zeros(len(at) + 1, bool)
    on[0] = len(at) > 0 and at[0] == 0
    for _ in range(len(at).bit_length() + 1):
        on[jump[np.flatnonzero(on)]] = True
        jump = jump[jump]
    return on[:-1]


def _chained(found: pa.Table) -> pa.Table:
    found = found.sort_by("at")
    return found.filter(pa.array(reachable(found["at"].to_numpy(), found["after"].to_numpy())))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives below path: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    chained = files.mapInArrow(_candidates, _FOUND).groupBy("path").applyInArrow(_chained, _FOUND)
    return chained.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_warc(spark, sf_dir: str) -> DataFrame:
    path = f"{common.shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(records(common.table(spark, sf_dir, "pages")), path)
    return read(spark, path)


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('{_BASE32}',
    (1 + ((('0x' || substr(hex, (1 + 10 * (k // 8))::INT, 10))::BIGINT >> (35 - 5 * (k % 8))::INT) & 31))::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM d
"""
