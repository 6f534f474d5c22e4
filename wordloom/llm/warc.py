"""WARC payloads as a chunked record table.

A record becomes rows of (record id, chunk number, chunk), each with the digest of the payload up to and including that
chunk; the row marked last therefore carries the digest of the whole payload.  Only read_warc streams: it reads files through
a fixed buffer and never holds a whole record, so that a record of any size costs memory for one chunk.  chunk_records, which the
registered query runs, gets whole payloads from Spark, a batch of them at a time, and cuts them through views of the Arrow
buffer; its memory grows with the record and the batch.  Both give rows in batches of a few megabytes, and chunks of one
record can be worked on by different tasks.
"""

from __future__ import annotations

import gzip
import hashlib
import os
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.text import utf8

CHUNK_BYTES = 16384
BATCH_BYTES = 1 << 22
#: bytes that the first line of a record, 'WARC/1.1', must fit in
VERSION_BYTES = 64
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

CHUNK_DDL = "page_id bigint, record_id string, chunk_no int, n_bytes int, start bigint, chunk binary, digest string, last boolean"
CHUNK_SCHEMA = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("chunk_no", pa.int32()), ("n_bytes", pa.int32()), ("start", pa.int64()), ("chunk", pa.binary()), ("digest", pa.string()), ("last", pa.bool_())])
FILE_DDL = "path string, record_no bigint, record_id string, warc_type string, uri string, chunk_no int, n_bytes int, start bigint, chunk binary, digest string, last boolean, complete boolean"
FILE_SCHEMA = pa.schema([("path", pa.string()), ("record_no", pa.int64()), ("record_id", pa.string()), ("warc_type", pa.string()), ("uri", pa.string()), ("chunk_no", pa.int32()), ("n_bytes", pa.int32()), ("start", pa.int64()), ("chunk", pa.binary()), ("digest", pa.string()), ("last", pa.bool_()), ("complete", pa.bool_())])


class _Rows:
    """Collects rows and gives record batches of about BATCH_BYTES."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.held = schema, [], 0

    def add(self, row: tuple, size: int) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.held += size + 100
        if self.held > BATCH_BYTES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), self.schema, strict=True)], schema=self.schema)
            self.rows, self.held = [], 0


def _chunks(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    rows = _Rows(CHUNK_SCHEMA)
    for batch in batches:
        raw, off = utf8(batch.column("payload"))
        view = memoryview(raw)
        for i, (page, record) in enumerate(zip(batch.column("page_id").to_pylist(), batch.column("record_id").to_pylist(), strict=True)):
            a, b = int(off[i]), int(off[i + 1])
            digest = hashlib.sha256()
            for k, at in enumerate(range(a, max(b, a + 1), size)):
                chunk = view[at : min(at + size, b)]
                digest.update(chunk)
                yield from rows.add((page, record, k, len(chunk), at - a, bytes(chunk), digest.hexdigest(), at + size >= b), len(chunk))
    yield from rows.flush()


def chunk_records(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """pages(page_id, url, html) as chunk rows of at most chunk_bytes bytes of the UTF-8 payload.

    record_id is 'page-<page_id>'; a null page_id gives null ids.  A null or empty payload gives one empty chunk, so that
    no record is lost; a payload of any length is chunked whole.  Repeated rows give repeated chunk rows.  An empty table gives no rows.  A chunk may end inside a
    character; only the chunks together are text.  Other columns are ignored.
    """
    if chunk_bytes < 1:
        raise ValueError("chunk_bytes must be positive")
    ready = pages.select(pages["page_id"].cast("bigint").alias("page_id"), F.concat(F.lit("page-"), pages["page_id"].cast("string")).alias("record_id"), pages["html"].alias("payload"))
    return ready.mapInArrow(lambda it: _chunks(it, chunk_bytes), CHUNK_DDL)


def assemble(chunks: DataFrame) -> DataFrame:
    """Chunk rows back to (record_id, payload, digest, intact); intact: no chunk is missing and the digest holds."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk_no", "chunk", "digest", "last")))
    got = chunks.groupBy("record_id").agg(ordered.alias("_c"))
    payload = F.aggregate("_c", F.lit("").cast("binary"), lambda a, x: F.concat(a, x["chunk"]))
    tail = F.element_at("_c", -1)
    return got.select("record_id", payload.alias("payload"), tail["digest"].alias("digest"), (tail["last"] & (F.size("_c") == tail["chunk_no"] + 1) & (F.sha2(payload, 256) == tail["digest"])).alias("intact"))


def _headers(stream) -> tuple[bytes, dict[str, str]] | None:
    """Version and fields of the next record, None at the end.  A field of any length is read whole; of what doesn't begin as a record only the first bytes are."""
    line = stream.readline(VERSION_BYTES)
    while line in (b"\r\n", b"\n"):
        line = stream.readline(VERSION_BYTES)
    if not line:
        return None
    version, fields = line.strip(), {}
    if not version.startswith(b"WARC/") or not line.endswith(b"\n"):
        return b"", fields
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        name, sep, value = line.partition(b":")
        if sep:
            fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return version, fields


def read_file(path: str, chunk_bytes: int) -> Iterator[tuple]:
    """The chunk rows of one .warc or .warc.gz file (several gzip members are one stream).

    A file that ends inside a record gives what there is, the last row with complete = false.  Where no record header
    stands, the rest of the file can't be framed: one row with complete = false says so.
    """
    with (gzip.open if path.endswith(".gz") else open)(path, "rb") as stream:
        number = 0
        while True:
            try:
                head = _headers(stream)
            except (EOFError, gzip.BadGzipFile):
                return
            if head is None:
                return
            version, fields = head
            kind, uri, record = fields.get("warc-type"), fields.get("warc-target-uri"), fields.get("warc-record-id")
            length = fields.get("content-length", "")
            digest = hashlib.sha256()
            if not version.startswith(b"WARC/") or not length.isdigit():
                yield path, number, record, kind, uri, 0, 0, 0, b"", digest.hexdigest(), True, False
                return
            left, k, at = int(length), 0, 0
            while True:
                try:
                    chunk = stream.read(min(chunk_bytes, left))
                except EOFError:
                    chunk = b""
                digest.update(chunk)
                left -= len(chunk)
                cut = left > 0 and len(chunk) < min(chunk_bytes, left + len(chunk))
                yield path, number, record, kind, uri, k, len(chunk), at, chunk, digest.hexdigest(), left == 0 or cut, not cut
                if cut:
                    return
                if left == 0:
                    break
                at, k = at + len(chunk), k + 1
            number += 1


def _read(batches: Iterable[pa.RecordBatch], chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    rows = _Rows(FILE_SCHEMA)
    for batch in batches:
        for path in batch.column(0).to_pylist():
            for row in read_file(path, chunk_bytes):
                yield from rows.add(row, row[6])
    yield from rows.flush()


def read_warc(spark: SparkSession, paths: list[str], chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Files on a file system that all executors see, one task a file, as chunk rows."""
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    return files.repartition(max(1, len(paths)), "path").mapInArrow(lambda it: _read(it, chunk_bytes), FILE_DDL)


def _write(batches: Iterable[pa.RecordBatch], folder: str, compress: bool) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    context = TaskContext.get()
    name = f"{folder}/part-{context.partitionId():05d}.warc" + ".gz" * compress
    draft = f"{name}.{context.taskAttemptId()}.tmp"
    n = 0
    with open(draft, "wb") as out:
        for batch in batches:
            raw, off = utf8(batch.column("html"))
            for i, url in enumerate(batch.column("url").to_pylist()):
                body = memoryview(raw)[int(off[i]) : int(off[i + 1])]
                record = uuid.uuid5(NAMESPACE, f"{batch.column('page_id')[i].as_py()} {url}")
                head = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:{record}>\r\nWARC-Target-URI: {' '.join((url or '').split())}\r\nContent-Type: text/html\r\nWARC-Block-Digest: sha256:{hashlib.sha256(body).hexdigest()}\r\nContent-Length: {len(body)}\r\n\r\n".encode()
                if compress:
                    with gzip.GzipFile(fileobj=out, mode="wb", mtime=0) as member:
                        for part in (head, body, b"\r\n\r\n"):
                            member.write(part)
                else:
                    for part in (head, body, b"\r\n\r\n"):
                        out.write(part)
                n += 1
    os.replace(draft, name)
    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["path", "n_records"])


def write_warc(pages: DataFrame, folder: str, compress: bool = True) -> DataFrame:
    """pages(page_id, url, html) as one WARC file a partition; a file appears whole or not at all, a repeated task replaces it."""
    os.makedirs(folder, exist_ok=True)
    return pages.select("page_id", "url", "html").mapInArrow(lambda it: _write(it, folder, compress), "path string, n_records bigint")


def op10_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages in chunks; nulls, empty and long payloads, ties, repeats, empty tables and other columns as chunk_records() says."""
    return chunk_records(spark.read.parquet(f"{sf_dir}/pages.parquet"))


SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
c AS (SELECT page_id, b, n, unnest(range(greatest(1, CAST(ceil(n / {CHUNK_BYTES}.0) AS BIGINT)))) AS k FROM p)
SELECT page_id, 'page-' || page_id AS record_id, CAST(k AS INTEGER) AS chunk_no,
  CAST(least({CHUNK_BYTES}, n - k * {CHUNK_BYTES}) AS INTEGER) AS n_bytes, k * {CHUNK_BYTES} AS start,
  b[k * {CHUNK_BYTES} + 1 : least(n, (k + 1) * {CHUNK_BYTES})] AS chunk,
  sha256(b[1 : least(n, (k + 1) * {CHUNK_BYTES})]) AS digest, (k + 1) * {CHUNK_BYTES} >= n AS last
FROM c"""
