"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each of whole WARC records, followed
by a seek table in a skippable frame (the public seekable format). The manifest maps
every record to its bundle, frame and offset within the unpacked frame, so one record
is read by unpacking one frame.

Repeated payloads: of the records with equal payloads, that with the largest id holds
the payload (``response``) and the others refer to it (``revisit``).

Defined cases: a null payload is an empty one; a null id sorts lowest, so it is the
response only of payloads that no record with an id has; of rows that repeat id and payload one is the response and the
others revisit it; control characters in an address are percent-encoded; an empty table
gives an empty manifest and no bundle.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspan.llm.common import stored

# Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

MANIFEST = (
    "page_id bigint, bundle string, frame int, frame_start bigint, frame_bytes bigint,"
    " record_start bigint, record_bytes bigint"
)
RECORDS = (
    "page_id bigint, record_type string, url string, refers_to bigint,"
    " payload_bytes bigint, payload_digest string, payload binary"
)


def with_record_types(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, record_type, refers_to`` for each row of ``pages``.

    Payloads of less than ``min_bytes`` bytes are responses always. Equal payloads are
    found by SHA-256. Per payload only its largest id is kept on the way, summed up
    before the shuffle; what repeats is stored, and the rows are joined to it. A join
    splits a hot payload, and needs no shuffle of the pages where little repeats. Rows
    that repeat the largest id as well are numbered apart, if there are any.
    """
    rows = pages.select(
        "page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")
    ).withColumn(
        "_key",
        F.when(F.octet_length("payload") >= min_bytes, F.sha2("payload", 256)),
    )
    per_id = rows.filter("_key is not null").groupBy("_key", "page_id").agg(
        F.count("*").alias("n")
    )
    repeated = stored(
        per_id.groupBy("_key")
        .agg(F.max(F.struct("page_id", "n")).alias("top"), F.sum("n").alias("n"))
        .filter("n > 1")
        .select(
            F.col("_key").alias("_of"),
            F.col("top.page_id").alias("_first"),
            F.col("top.n").alias("_ties"),
        ),
        "payloads",
    )
    marked = rows.join(repeated, F.col("_key") == F.col("_of"), "left").withColumn(
        "_response", F.col("_of").isNull() | F.col("page_id").eqNullSafe(F.col("_first"))
    )
    if not repeated.filter("_ties > 1").isEmpty():
        tied = F.col("_response") & (F.coalesce("_ties", F.lit(1)) > 1)
        first = F.row_number().over(Window.partitionBy("_key").orderBy("url")) == 1
        marked = marked.filter(~tied).unionByName(
            marked.filter(tied).withColumn("_response", first)
        )
    return marked.select(
        "page_id",
        "url",
        "payload",
        F.when(F.col("_response"), "response").otherwise("revisit").alias("record_type"),
        F.when(~F.col("_response"), F.col("_first")).alias("refers_to"),
    )


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:larkspan:page:{'' if page_id is None else page_id}>"


def _page(name: str) -> int | None:
    number = name.rstrip(">").rpartition(":")[2]
    return int(number) if number else None


def warc_record(page_id, url, payload: bytes, record_type: str, refers_to) -> bytes:
    """One record. A revisit keeps the HTTP head, with the full length, and no payload."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http + payload if record_type == "response" else http
    lines = [
        "WARC/1.1",
        f"WARC-Type: {record_type}",
        f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        address = re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), url)
        lines.append(f"WARC-Target-URI: {address}")
    if record_type == "revisit":
        lines += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(block: bytes) -> dict[str, str]:
    lines = block.decode().split("\r\n")[1:]
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}


def parse_records(frame: bytes) -> Iterator[tuple]:
    """Rows of ``RECORDS`` in one unpacked frame. A damaged payload is an error."""
    at = 0
    while at < len(frame):
        body = frame.index(b"\r\n\r\n", at) + 4
        head = _headers(frame[at : body - 4])
        end = body + int(head["content-length"])
        block = frame[body:end]
        inner = block.index(b"\r\n\r\n") + 4
        length = int(_headers(block[: inner - 4])["content-length"])
        digest = head["warc-payload-digest"].removeprefix("sha1:")
        kind = head["warc-type"]
        payload = block[inner:] if kind == "response" else None
        if payload is not None and (len(payload) != length or base32_sha1(payload) != digest):
            raise ValueError(f"payload of {head['warc-record-id']} differs from its digest")
        refers = head.get("warc-refers-to")
        yield (
            _page(head["warc-record-id"]),
            kind,
            head.get("warc-target-uri"),
            _page(refers) if refers else None,
            length,
            digest,
            payload,
        )
        at = end + 4


# Schemes of Spark's paths, and of the file systems that open them in the tasks.
SCHEMES = {
    "file": "file", "hdfs": "hdfs", "viewfs": "viewfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs",
    "abfs": "abfs", "abfss": "abfss",
}


def bundle_address(folder: str) -> str:
    """The address of ``folder``, a path of Spark's, for the file systems of the tasks.

    Paths without a scheme are local. Another scheme than those of ``SCHEMES`` is an error,
    raised before anything is written.
    """
    scheme, separator, rest = folder.partition("://")
    if not separator:
        scheme, rest = "file", folder.removeprefix("file:")
    if scheme.lower() not in SCHEMES:
        known = ", ".join(SCHEMES)
        raise ValueError(f"bundles can't be written to {scheme}://; the schemes are {known}")
    return f"{SCHEMES[scheme.lower()]}://{rest}"


def _filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(bundle_address(folder))


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    entries = b"".join(struct.pack("<II", packed, unpacked) for packed, unpacked in frames)
    footer = struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + 9) + entries + footer


def read_seek_table(file) -> list[tuple[int, int, int]]:
    """(start, packed bytes, unpacked bytes) of each frame of an open bundle."""
    size = file.seek(0, io.SEEK_END)
    file.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table at the end of the bundle")
    width = 12 if flags & 0x80 else 8
    file.seek(size - 9 - width * count)
    table = file.read(width * count)
    frames, start = [], 0
    for i in range(count):
        packed, unpacked = struct.unpack_from("<II", table, i * width)
        frames.append((start, packed, unpacked))
        start += packed
    return frames


class _Bundle:
    """One open bundle; rows of the manifest wait until it is closed."""

    def __init__(self, filesystem, folder, level):
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.file = filesystem.open_output_stream(f"{folder}/{self.name}", compression=None)
        self.pack = zstandard.ZstdCompressor(level=level, write_content_size=True).compress
        self.frames, self.rows, self.waiting = [], [], []
        self.frame, self.written = bytearray(), 0

    def add(self, page_id, record):
        self.waiting.append((page_id, len(self.frame), len(record)))
        self.frame += record

    def end_frame(self):
        if not self.waiting:
            return
        packed = self.pack(bytes(self.frame))
        self.file.write(packed)
        self.rows += [
            (i, self.name, len(self.frames), self.written, len(packed), start, length)
            for i, start, length in self.waiting
        ]
        self.frames.append((len(packed), len(self.frame)))
        self.written += len(packed)
        self.waiting, self.frame = [], bytearray()

    def close(self):
        self.end_frame()
        self.file.write(seek_table(self.frames))
        self.file.close()
        return self.rows


def _batch(rows, schema):
    return pa.RecordBatch.from_arrays(
        [pa.array(column, t.type) for column, t in zip(zip(*rows, strict=True), schema, strict=True)],
        schema=schema,
    )


_MANIFEST_SCHEMA = pa.schema(
    [("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32())]
    + [(c, pa.int64()) for c in ("frame_start", "frame_bytes", "record_start", "record_bytes")]
)
_RECORD_SCHEMA = pa.schema(
    [
        ("page_id", pa.int64()),
        ("record_type", pa.string()),
        ("url", pa.string()),
        ("refers_to", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("payload", pa.binary()),
    ]
)


def write_bundles(
    records: DataFrame,
    folder: str,
    frame_bytes: int = 1 << 20,
    bundle_bytes: int = 256 << 20,
    level: int = 3,
) -> DataFrame:
    """Write ``records`` (as of ``with_record_types``) below ``folder``; the manifest.

    Each task writes bundles of its own under new names, in a folder that all machines
    share, opened where the task runs (see ``bundle_address``; ``s3a`` and ``s3n`` are opened as
    ``s3``, ``hdfs`` and ``viewfs`` by the machines' own client library). A task holds one
    frame at a time: ``frame_bytes`` or one longer record. The manifest is written as a
    table in ``folder`` when all tasks are done and names only files of tasks that
    succeeded; files of a lost or repeated task are never read.
    """
    bundle_address(folder)

    def write(batches):
        filesystem, base = _filesystem(f"{folder}/bundles")
        filesystem.create_dir(base, recursive=True)
        bundle = None
        for batch in batches:
            for values in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if bundle is None:
                    bundle = _Bundle(filesystem, base, level)
                bundle.add(values[0], warc_record(*values))
                if len(bundle.frame) >= frame_bytes:
                    bundle.end_frame()
                if bundle.written >= bundle_bytes:
                    yield _batch(bundle.close(), _MANIFEST_SCHEMA)
                    bundle = None
        if bundle is not None:
            yield _batch(bundle.close(), _MANIFEST_SCHEMA)

    chosen = records.select("page_id", "url", "payload", "record_type", "refers_to")
    chosen.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return records.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_bundles(manifest: DataFrame, folder: str) -> DataFrame:
    """All records of the bundles that ``manifest`` names, as ``RECORDS``.

    Bundles are dealt out to as many tasks as there are bundles (their names are short, so
    Spark would otherwise read all in one task); each is opened by its seek table and
    unpacked frame by frame.
    """
    bundles = manifest.select("bundle").distinct()

    def read(batches):
        filesystem, base = _filesystem(f"{folder}/bundles")
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with filesystem.open_input_file(f"{base}/{name}") as file:
                    for start, packed, unpacked in read_seek_table(file):
                        file.seek(start)
                        frame = unpack(file.read(packed), max_output_size=unpacked)
                        yield _batch(list(parse_records(frame)), _RECORD_SCHEMA)

    return bundles.repartition(max(1, bundles.count()), "bundle").mapInArrow(read, RECORDS)


def fetch_records(wanted: DataFrame, folder: str) -> DataFrame:
    """The records of some manifest rows; only the frames that hold them are unpacked."""

    def read(batches):
        filesystem, base = _filesystem(f"{folder}/bundles")
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for _, name, _, start, packed, at, length in zip(
                *(column.to_pylist() for column in batch.columns), strict=True
            ):
                with filesystem.open_input_file(f"{base}/{name}") as file:
                    file.seek(start)
                    frame = unpack(file.read(packed))
                yield _batch(list(parse_records(frame[at : at + length])), _RECORD_SCHEMA)

    return wanted.mapInArrow(read, RECORDS)
