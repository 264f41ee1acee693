"""Writes pages to WARC archives with an index, and reads records back by the index.

Every record is a gzip member of its own. While an archive is written, the index
gets a row per record: file, offset, length, URL and payload digest. A reader
selects index rows, sorts them by file and offset, and reads neighbouring records
in one ranged read. Archives lie in a folder that all executors reach.

Of pages with equal payloads of at least ``min_bytes`` bytes the one with the
largest page_id is a response, the others revisit it without a payload.

Defined results: a null payload is an empty one. A null URL is left out of the
record and read back as null; control characters in a URL are percent-encoded. A
null page_id is smaller than any other. Rows that share the largest page_id of a
payload are all responses. In a group without ids all are responses. An empty
table gives an index without rows. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.session import fresh_path, materialise

MIN_BYTES = 1000
DATE = "2000-01-01T00:00:00Z"
# Records with at most GAP unread bytes between them share a read of READ bytes.
READ = 4 << 20
GAP = 64 << 10
# Reads per task, on average.
READS = 4

INDEX = pa.schema([
    ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
    ("url", pa.string()), ("digest", pa.string()), ("page_id", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()),
])
INDEX_DDL = (
    "file string, offset bigint, length bigint, url string, digest string, page_id string, "
    "record_type string, refers_to string, payload_bytes bigint"
)
RECORD = pa.schema([
    ("file", pa.string()), ("offset", pa.int64()), ("page_id", pa.string()),
    ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()),
    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()),
])
RECORD_DDL = (
    "file string, offset bigint, page_id string, url string, record_type string, "
    "refers_to string, payload_digest string, payload_bytes bigint, payload binary"
)


def address(path: str) -> str:
    """The path by the scheme that pyarrow knows; Spark has names of its own for S3."""
    return re.sub(r"^s3[an]://", "s3://", path)


def encoded_url(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda found: f"%{ord(found[0]):02X}", url)


def record_id(page_id: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def headers(first: str, fields: list[tuple[str, str | None]]) -> bytes:
    lines = [first, *[f"{name}: {value}" for name, value in fields if value is not None]]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def record(page_id, url, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One record, not compressed."""
    revisit = kind == "revisit"
    http = headers(
        "HTTP/1.1 200 OK",
        [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))],
    )
    block = http if revisit else http + payload
    profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    return headers(
        "WARC/1.1",
        [
            ("WARC-Type", kind),
            ("WARC-Record-ID", record_id(page_id, digest)),
            ("WARC-Date", DATE),
            ("WARC-Target-URI", None if url is None else encoded_url(url)),
            ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
            ("WARC-Profile", profile if revisit else None),
            ("WARC-Refers-To", record_id(refers_to, digest) if revisit else None),
            ("WARC-Refers-To-Page", refers_to if revisit else None),
            ("WARC-Page", page_id),
            ("Content-Type", "application/http; msgtype=response"),
            ("Content-Length", str(len(block))),
        ],
    ) + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """One gzip member without a time stamp."""
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def write_partition(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Writes one archive and yields its index rows. A task that runs again writes
    another file; the index names the file of the attempt that counted."""
    system, path = pyarrow.fs.FileSystem.from_uri(address(folder))
    name, sink, offset = f"{uuid.uuid4().hex}.warc.gz", None, 0
    try:
        for batch in batches:
            if sink is None:
                system.create_dir(path, recursive=True)
                sink = system.open_output_stream(f"{path}/{name}", compression=None)
            rows = []
            for row in zip(*(batch.column(c) for c in range(6))):
                page_id, url, payload, digest, kind, refers_to = (v.as_py() for v in row)
                data = member(record(page_id, url, payload, digest, kind, refers_to))
                sink.write(data)
                rows.append((
                    f"{folder}/{name}", offset, len(data), url, digest, page_id, kind, refers_to,
                    len(payload),
                ))
                offset += len(data)
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), INDEX)] if rows else [
                pa.array([], f.type) for f in INDEX
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=INDEX)
    finally:
        if sink is not None:
            sink.close()


def with_record_types(pages: DataFrame, min_bytes: int) -> DataFrame:
    """page_id (as text), url, payload, digest, record_type and refers_to."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn(
        "digest", F.sha1("payload")
    )
    narrow = rows.where(F.octet_length("payload") >= min_bytes)
    # Only payloads that repeat come back to the pages.
    held = (
        narrow.groupBy("digest")
        .agg(F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("copies"))
        .where(F.col("copies") > 1)
        .select("digest", "holder")
    )
    revisit = F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder"))
    return rows.join(held, "digest", "left").select(
        F.col("page_id").cast("string").alias("page_id"),
        "url",
        "payload",
        "digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("holder").cast("string")).alias("refers_to"),
    )


def write_archives(pages: DataFrame, min_bytes: int = MIN_BYTES, folder: str | None = None) -> DataFrame:
    """Writes the archives and returns their index."""
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    # Fails here, not in a task, where pyarrow has no file system for the folder.
    pyarrow.fs.FileSystem.from_uri(address(folder))
    typed = with_record_types(pages, min_bytes)
    return materialise(typed.mapInArrow(lambda b: write_partition(b, folder), INDEX_DDL), "warc-index")


def parsed(data: bytes) -> dict:
    """The fields of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    return {
        "page_id": fields.get("WARC-Page"),
        "url": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"],
        "refers_to": fields.get("WARC-Refers-To-Page"),
        "payload_digest": digest,
        "payload_bytes": size,
        "payload": None if revisit else payload,
    }


def ranges(rows: Iterator[tuple[str, int, int]]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Gathers sorted (file, offset, length) rows into reads of near records."""
    file, group = None, []
    for name, offset, length in rows:
        if group and (
            name != file
            or offset - sum(group[-1]) > GAP
            or offset + length - group[0][0] > READ
        ):
            yield file, group
            group = []
        file = name
        group.append((offset, length))
    if group:
        yield file, group


def read_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads the records of sorted index rows."""

    def rows():
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")))

    opened, source = None, None
    try:
        for file, group in ranges(rows()):
            if file != opened:
                if source is not None:
                    source.close()
                system, path = pyarrow.fs.FileSystem.from_uri(address(file))
                opened, source = file, system.open_input_file(path)
            start, stop = group[0][0], sum(group[-1])
            data = source.read_at(stop - start, start)
            found = []
            for offset, length in group:
                raw = zlib.decompress(data[offset - start : offset - start + length], 31)
                found.append({"file": file, "offset": offset, **parsed(raw)})
            yield pa.RecordBatch.from_pylist(found, schema=RECORD)
    finally:
        if source is not None:
            source.close()


def read_records(index: DataFrame) -> DataFrame:
    """The records of the selected index rows. Blocks of the archives are shared out,
    so that one large archive is read by many tasks. Their number follows the bytes to
    read; by the size of the index alone, Spark would merge them into a few."""
    block = F.expr(f"offset div {READ}")
    size = index.agg(F.sum("length")).first()[0] or 0
    placed = (
        index.select("file", "offset", "length")
        .repartition(max(1, -(-size // (READS * READ))), "file", block)
        .sortWithinPartitions("file", "offset")
    )
    return placed.mapInArrow(read_partition, RECORD_DDL)
