"""WARC archives: one gzip member per record, written and read by tasks.

Writing: payloads are compared by digest first (native, aggregated before the
shuffle), then every task streams its rows into archives of bounded size in the
shared folder. Only the archives that the manifest of successful tasks names are
ever read, so a repeated task does no harm.

Reading: an archive is read sequentially in blocks, each gzip member is
inflated incrementally, the record is framed by its content length, and block
and payload digests are verified.

Defined cases: a null payload is an empty one; a null id is written as an empty
field and read back as null; rows with equal id and equal payload are equal
records; no rows give no archives. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.session import bounded, settle_measured, shared_folder, ship

ARCHIVE_BYTES = 32 * 1024 * 1024
BLOCK_BYTES = 256 * 1024
REVISIT_BYTES = 100  # Smaller payloads are always stored.
BROADCAST_BYTES = 16 * 1024 * 1024
DATE = "2000-01-01T00:00:00Z"

MANIFEST = "path string, records bigint, bytes bigint"
RECORD = (
    "archive string, page_id bigint, url string, record_type string, refers_to bigint, "
    "payload_bytes bigint, payload_digest string, status string"
)


# --- writing ----------------------------------------------------------------


def with_decisions(pages: DataFrame, key: str, url: str, payload: str) -> DataFrame:
    """``key, url, payload (binary), digest, first``: ``first`` is the record that stores a repeated payload."""
    rows = pages.select(
        F.col(key).cast("bigint").alias("key"),
        F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("payload"),
    )
    digest = F.sha2(F.col("payload"), 256)
    seen = rows.filter(F.length("payload") >= REVISIT_BYTES).select(F.unhex(digest).alias("digest"), "key")
    counts = seen.groupBy("digest").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n"))
    repeated = counts.filter("n > 1").select("digest", "first")
    repeated = bounded(repeated, "payloads", F.lit(56), BROADCAST_BYTES)
    return rows.withColumn("digest", F.unhex(digest)).join(repeated, "digest", "left")


def _opened(path: str):
    """File system and path; a folder without a scheme is a mounted one."""
    uri = path.replace("s3a://", "s3://", 1) if "://" in path else path
    if uri.startswith("file:"):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def _id(key) -> str:
    return "" if key is None else str(int(key))


def record_bytes(key: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """One uncompressed record; a revisit keeps the HTTP head of the payload but not the payload."""
    revisit = first is not None and key is not None and first != key
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{_id(key)}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", "" if url is None else "".join(url.split())),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
    ]
    if revisit:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", f"<urn:page:{_id(first)}>"),
        ]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    named = "".join(f"{name}: {value}\r\n" for name, value in fields)
    return b"WARC/1.1\r\n" + named.encode() + b"\r\n" + block + b"\r\n\r\n"


def _member(record: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def _writer(folder: str, limit: int):
    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = _opened(folder)
        context = TaskContext.get()
        out, path, records, size, number = None, "", 0, 0, 0
        for frame in frames:
            for key, url, payload, digest, first in zip(
                frame["key"], frame["url"], frame["payload"], frame["digest"], frame["first"], strict=True
            ):
                key, first = (None if pd.isna(x) else int(x) for x in (key, first))
                member = _member(record_bytes(key, url, bytes(payload), bytes(digest).hex(), first))
                if out is None:
                    name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}-{number:04d}.warc.gz"
                    path, number = f"{root}/{name}", number + 1
                    out, records, size = system.open_output_stream(path, compression=None), 0, 0
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= limit:
                    out.close()
                    yield pd.DataFrame([(f"{folder}/{path.rsplit('/', 1)[1]}", records, size)], columns=["path", "records", "bytes"])
                    out = None
        if out is not None:
            out.close()
            yield pd.DataFrame([(f"{folder}/{path.rsplit('/', 1)[1]}", records, size)], columns=["path", "records", "bytes"])

    return write


def write_archives(
    pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", limit: int = ARCHIVE_BYTES
) -> DataFrame:
    """Write a record per row below the shared folder; the manifest ``path, records, bytes`` is settled."""
    spark = pages.sparkSession
    ship(spark)
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    system, root = _opened(folder)
    system.create_dir(root, recursive=True)
    rows = with_decisions(pages, key, url, payload)
    written = rows.select("key", "url", "payload", "digest", "first").mapInPandas(_writer(folder, limit), MANIFEST)
    return settle_measured(written, "manifest", archives=F.count(F.lit(1)))[0]


# --- reading ----------------------------------------------------------------


class Damaged(Exception):
    """What makes the rest of an archive unreadable."""


def members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, inflated block by block."""
    pending = stream.read(BLOCK_BYTES)
    while pending:
        inflater, parts = zlib.decompressobj(31), []
        while not inflater.eof:
            if not pending:
                raise Damaged("truncated")
            try:
                parts.append(inflater.decompress(pending))
            except zlib.error as error:
                raise Damaged("undecodable") from error
            pending = inflater.unused_data if inflater.eof else stream.read(BLOCK_BYTES)
        yield b"".join(parts)
        pending = pending or stream.read(BLOCK_BYTES)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}


def parse_record(member: bytes) -> dict:
    """Frame one record by its lengths and verify its digests."""
    head, found, rest = member.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"WARC/"):
        raise Damaged("malformed")
    fields = _fields(head)
    try:
        length = int(fields["content-length"])
    except (KeyError, ValueError) as error:
        raise Damaged("malformed") from error
    block = rest[:length]
    status = "ok" if rest[length:] == b"\r\n\r\n" and len(block) == length else "bad-length"
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields.get("warc-type") == "revisit"
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    size = _fields(http).get("content-length", "")
    size = int(size) if size.isdigit() else -1
    if status == "ok" and fields.get("warc-block-digest") != f"sha256:{hashlib.sha256(block).hexdigest()}":
        status = "bad-block-digest"
    if status == "ok" and not revisit:
        if hashlib.sha256(payload).hexdigest() != digest:
            status = "bad-payload-digest"
        elif size != len(payload):
            status = "bad-length"

    def page(name: str) -> int | None:
        text = fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text.lstrip("-").isdigit() else None

    return {
        "page_id": page("warc-record-id"), "url": fields.get("warc-target-uri", ""),
        "record_type": fields.get("warc-type", ""), "refers_to": page("warc-refers-to"),
        "payload_bytes": size, "payload_digest": digest, "status": status, "payload": None if revisit else payload,
    }


def read_stream(stream) -> Iterator[dict]:
    """Records of an open archive in order; damage that hides the rest ends it with a record of that status."""
    try:
        for member in members(stream):
            yield parse_record(member)
    except Damaged as damage:
        yield {
            "page_id": None, "url": None, "record_type": None, "refers_to": None,
            "payload_bytes": None, "payload_digest": None, "status": str(damage), "payload": None,
        }


def _frame(rows: list[dict], columns: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=columns)
    for name in ("page_id", "refers_to", "payload_bytes"):
        frame[name] = frame[name].astype("Int64")
    return frame


def read_archives(manifest: DataFrame, payloads: bool = False, batch: int = 500) -> DataFrame:
    """The records of the archives in ``manifest.path``, one task per archive at a time."""
    ship(manifest.sparkSession)
    schema = RECORD + (", payload binary" if payloads else "")
    columns = [field.split()[0] for field in schema.split(", ")]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame["path"]:
                system, inner = _opened(path)
                rows, size = [], 0
                with system.open_input_stream(inner, compression=None, buffer_size=BLOCK_BYTES) as stream:
                    for record in read_stream(stream):
                        rows.append({"archive": path} | record)
                        size += len(record["payload"] or b"") if payloads else 0
                        if len(rows) >= batch or size > 16 * BLOCK_BYTES:
                            yield _frame(rows, columns)
                            rows, size = [], 0
                if rows:
                    yield _frame(rows, columns)

    cores = manifest.sparkSession.sparkContext.defaultParallelism
    return manifest.select("path").repartition(4 * cores, "path").mapInPandas(read, schema)


def round_trip(spark: SparkSession, pages: DataFrame, **columns: str) -> DataFrame:
    """Write the archives, read them back."""
    return read_archives(write_archives(pages, **columns))


def records_in(data: bytes) -> list[dict]:
    return list(read_stream(io.BytesIO(data)))
