"""WARC archives: one gzip member per record, read in sequence with incremental zlib decompression.

Writer tasks roll archives of bounded size in a folder that executors share and return a manifest row per
archive; only archives in the manifest count, so a task that ran twice leaves no second copy of its records.
The reader takes archive paths (opened in the task) or contents, inflates piece by piece, frames each block
by its Content-Length and checks block and payload digests. Records that break off or fail a digest come
back with ok false; reading goes on with the next record that can be inflated. Null payloads are empty, null
urls and ids give empty headers, repeated rows give a record each, empty tables an empty manifest, other columns are
not read. A record is held whole, so the longest payload bounds a task's memory from below. Payloads are told
apart by SHA-256.
"""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import new_path, text_of, written

PIECE = 1 << 18
ARCHIVE_BYTES = 16 << 20
#: Payloads shorter than this are never written as revisits.
REVISIT_BYTES = 100

#: Fixed value: how a gzip member of deflated data begins.
_MEMBER = b"\x1f\x8b\x08"

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(value: object) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", str(value))


def record(key: object, url: str | None, payload: bytes, digest: str, refers_to: object = None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A response record with an HTTP block, or, given the key it repeats, a revisit with the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if key is None else key}>",
        f"WARC-Date: {date}", f"WARC-Target-URI: {_line(url or '')}", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines[3:3] = [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def inflate(source: io.RawIOBase, piece: int = PIECE) -> Iterator[tuple[bytes, bool]]:
    """(data, whole) of each gzip member, in order; a member that breaks off or is corrupt gives what it had, whole false.

    After a corrupt member reading goes on where the next record can be inflated: its first bytes are looked for, and
    what doesn't begin with a record's is passed over.
    """
    rest, lost = source.read(piece), False
    while rest:
        unpacker, parts, whole, broken = zlib.decompressobj(31), [], False, False
        started, first = rest, True  # the input in hand, and whether the member begins with it
        try:
            while rest:
                started = rest
                parts.append(unpacker.decompress(rest, 4 * piece))
                rest = unpacker.unconsumed_tail
                if unpacker.eof:
                    whole, rest = True, unpacker.unused_data
                    break
                first, rest = False, rest or source.read(piece)
        except zlib.error:
            broken, rest = True, started
        data = b"".join(parts)
        if not lost or data.startswith(b"WARC/"):
            yield data, whole
        lost = broken or lost and not whole
        if broken:
            rest = rest[1:] if first else rest
            while rest and (at := rest.find(_MEMBER)) < 0:
                more = source.read(piece)
                rest = rest[-len(_MEMBER) + 1 :] + more if more else b""
            rest = rest[at:] if rest else rest
        rest = rest or source.read(piece)


def parse(data: bytes, whole: bool = True) -> dict:
    """Headers, framed block, payload and the checks of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    length = fields.get("content-length", "")
    size = int(length) if length.isdigit() else -1
    block = rest[: max(size, 0)]
    ok = whole and lines[0].startswith("WARC/") and len(block) == size and rest[size:] == b"\r\n\r\n"
    said = fields.get("warc-block-digest", "").removeprefix("sha256:")
    ok = ok and (not said or hashlib.sha256(block).hexdigest() == said)
    http, _, payload = block.partition(b"\r\n\r\n")
    told = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    kind = fields.get("warc-type", "")
    if kind == "response":
        ok = ok and hashlib.sha256(payload).hexdigest() == digest
    key, refers = (re.fullmatch(r"<urn:page:(.*)>", fields.get(k, "")) for k in ("warc-record-id", "warc-refers-to"))
    return {
        "key": (key[1] or None) if key else None, "url": fields.get("warc-target-uri"), "record_type": kind, "refers_to": refers[1] if refers else None,
        "payload_bytes": int(told[1]) if told else len(payload), "payload_digest": digest, "payload": payload if kind == "response" else None, "ok": ok,
    }


RECORD = pa.schema([("key", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("ok", pa.bool_())])
RECORD_DDL = "key string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary, ok boolean"


def mark_revisits(pages: DataFrame, key: str = "page_id", payload: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """pages with payload_digest and refers_to: the smallest key with an equal payload of `least` bytes or more, else null.

    Digests are counted before the join, so it carries only those that occur more than once; a digest that many
    pages share is split by adaptive execution.
    """
    marked = pages.withColumn("payload_digest", F.sha2(text_of(payload).cast("binary"), 256))
    long = marked.where(F.octet_length(payload) >= least)
    first = long.groupBy("payload_digest").agg(F.min(key).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    joined = marked.join(first.drop("_n"), "payload_digest", "left")
    refers = F.when(F.col("_first") != F.col(key), F.col("_first"))
    return joined.withColumn("refers_to", refers).drop("_first")


def write_warc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", size: int = ARCHIVE_BYTES) -> DataFrame:
    """Write pages (with payload_digest and refers_to) as archives under path; the written manifest (archive, records, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = fs.FileSystem.from_uri(path)
        task = TaskContext.get()
        stem, done, out, name = f"{task.partitionId():06d}-{task.taskAttemptId()}", [], None, ""
        for batch in batches:
            for row in zip(*(batch.column(c) for c in (key, url, payload, "payload_digest", "refers_to")), strict=True):
                k, u, p, d, r = (x.as_py() for x in row)
                if out is None:
                    files.create_dir(folder, recursive=True)
                    name, count, total = f"{stem}-{len(done):04d}.warc.gz", 0, 0
                    out = files.open_output_stream(f"{folder}/{name}", compression=None)
                data = member(record(k, u, (p or "").encode(), d, r))
                out.write(data)
                count, total = count + 1, total + len(data)
                if total >= size:
                    out.close()
                    done, out = [*done, (f"{path}/{name}", count, total)], None
        if out is not None:
            out.close()
            done.append((f"{path}/{name}", count, total))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["archive", "records", "bytes"])

    rows = pages.select(key, url, payload, "payload_digest", "refers_to")
    return written(rows.mapInArrow(run, "archive string, records long, bytes long"), "manifest")


def read_warc(archives: DataFrame, column: str = "archive", slices: int | None = None) -> DataFrame:
    """Records of the archives whose paths (string) or contents (binary) are in column, read in sequence."""
    binary = archives.schema[column].dataType.simpleString() == "binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(column).to_pylist():
                if value is None:
                    continue
                if binary:
                    source = io.BytesIO(value)
                else:
                    files, place = fs.FileSystem.from_uri(value)
                    source = files.open_input_stream(place, compression=None)
                rows, held = [], 0
                with source:
                    for data, whole in inflate(source):
                        rows.append(parse(data, whole))
                        held += len(data)
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, RECORD)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, RECORD)

    rows = archives.select(column)
    rows = rows if binary else rows.repartition(slices or int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.mapInArrow(run, RECORD_DDL)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page, equal payloads as revisits, and read the archives back; a record that fails its check stops the query."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    manifest = write_warc(mark_revisits(pages.select("page_id", "url", "html")), new_path(spark, "warc"))
    found = read_warc(manifest)
    sound = F.when(F.col("ok"), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("unsound record "), F.col("key"))))
    return found.select(F.col("key").cast("long").alias("page_id"), "payload_bytes", sound.alias("payload_digest"), "record_type", F.col("refers_to").cast("long").alias("refers_to"))


OP5_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM f
"""
