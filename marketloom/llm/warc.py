"""WARC archives of pages, Zstandard-compressed record by record with an embedded dictionary (operator 8).

Each partition writes archives of its own.  A writer holds back its first records, at most
``SAMPLE_BYTES`` of payload and the record that goes beyond it, trains a dictionary on pieces of them, puts it in a skippable
frame at the head of the archive, and compresses each record as a frame of its own with that dictionary.  Pieces are short where there is
little to learn from, so that one record is enough; an archive of less than ``LEAST_BYTES`` has no dictionary.  Files go to a folder that driver and executors share; a
task writes under a name of its own and renames when done, and only the archives named in the
manifest are read, so lost or repeated tasks leave no trace in results.

Equal payloads are told by their digests, which travel without the payloads; a payload meets its type by its page_id, so many copies of one
page are no hot key for payloads.

Of pages with equal payloads of at least ``least`` bytes, the one with the largest page_id is the
response and the others are revisits of it.

Defined results: null html is an empty payload; null page_ids count as smallest, and a group of equal payloads
without any page_id is all response; rows equal in page_id and payload are the same
record and get the same type; null urls have no target header; an empty table gives no archives.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import cut_lineage, shared_dir

SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
SAMPLE_BYTES, DICTIONARY_BYTES = 2 << 20, 64 << 10
#: Bytes of records that a dictionary needs, and of one piece that it is trained on.
LEAST_BYTES, PIECE_BYTES = 1 << 10, 8 << 10
ARCHIVE_BYTES = 1 << 30
DATE = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, records long, bytes long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """A response record, or a revisit record if it refers to another page."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        *([] if url is None else [f"WARC-Target-URI: {' '.join(url.split())}"]),
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        *([] if refers_to is None else [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def train_dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from pieces spread evenly over the records, of about ``SAMPLE_BYTES`` together; None from less than ``LEAST_BYTES``."""
    total = sum(map(len, records))
    if total < LEAST_BYTES:
        return None
    piece = max(64, min(PIECE_BYTES, total // 64))
    step = piece * max(1, total // SAMPLE_BYTES)
    pieces = [r[i : i + piece] for r in records for i in range(0, len(r), step)]
    try:
        return zstandard.train_dictionary(max(1 << 10, min(DICTIONARY_BYTES, total // 8)), pieces, k=256, d=8, level=3)
    except zstandard.ZstdError:  # nothing in common to learn, as in runs of one byte
        return None


class ArchiveWriter:
    """Writes records to one archive in the shared folder."""

    def __init__(self, folder: str, name: str):
        self.fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        self.fs.create_dir(root, recursive=True)
        self.final = f"{root}/{name}.warc.zst"
        self.open = f"{root}/_{name}.{uuid.uuid4().hex}"
        self.path = f"{folder}/{name}.warc.zst"
        self.out = self.fs.open_output_stream(self.open, compression=None)
        self.held: list[bytes] = []
        self.held_bytes = self.records = self.bytes = 0
        self.compressor: zstandard.ZstdCompressor | None = None

    def write(self, data: bytes) -> None:
        self.records += 1
        if self.compressor is None:
            self.held.append(data)
            self.held_bytes += len(data)
            if self.held_bytes >= SAMPLE_BYTES:
                self._begin()
        else:
            self._put(self.compressor.compress(data))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def _begin(self) -> None:
        trained = train_dictionary(self.held)
        if trained is not None:
            data = trained.as_bytes()
            self._put(SKIPPABLE.to_bytes(4, "little") + len(data).to_bytes(4, "little") + data)
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True)
        held, self.held = self.held, []
        for data in held:
            self._put(self.compressor.compress(data))

    def close(self) -> tuple[str, int, int]:
        if self.compressor is None:
            self._begin()
        self.out.close()
        self.fs.move(self.open, self.final)
        return self.path, self.records, self.bytes


def classified(pages: DataFrame, *, least: int = 0) -> DataFrame:
    """page_id, url, payload and refers_to (null for responses) of each page."""
    slim = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    again = (
        slim.where(F.octet_length("payload") >= least)
        .groupBy("digest")
        .agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND first IS NOT NULL")
        .select(F.col("digest").alias("of"), "first")
    )
    other = ~F.col("page_id").eqNullSafe(F.col("first"))
    revisits = slim.select("page_id", "digest").join(again, F.col("digest") == F.col("of")).where(other).select(F.col("page_id").alias("id"), "of", "first").distinct()
    joined = slim.join(revisits, slim.page_id.eqNullSafe(revisits.id) & (slim.digest == revisits.of), "left")
    return joined.select("page_id", "url", "payload", F.col("first").alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, *, least: int = 0, date: str = DATE) -> DataFrame:
    """Archive all pages below ``folder``; returns the manifest (path, records, bytes)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        writer, done, part = None, [], 0
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if writer is None:
                    name = f"part-{task.partitionId():05d}-{part:03d}-{task.taskAttemptId()}"
                    writer, part = ArchiveWriter(folder, name), part + 1
                writer.write(record(page_id, url, payload, refers_to, date))
                if writer.bytes >= ARCHIVE_BYTES:
                    done.append(writer.close())
                    writer = None
        if writer is not None:
            done.append(writer.close())
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*done, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)],
                ["path", "records", "bytes"],
            )

    return cut_lineage(classified(pages, least=least).mapInArrow(write, MANIFEST))


def _records(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive, read as a stream."""
    fs, name = pyarrow.fs.FileSystem.from_uri(path)
    with fs.open_input_stream(name, compression=None) as raw:
        head = raw.read(4)
        trained = None
        if int.from_bytes(head, "little") == SKIPPABLE:
            size = int.from_bytes(raw.read(4), "little")
            trained = zstandard.ZstdCompressionDict(raw.read(size))
            head = b""
        reader = zstandard.ZstdDecompressor(dict_data=trained).stream_reader(_Rest(head, raw), read_across_frames=True)
        text = io.BufferedReader(reader, 1 << 18)
        while version := text.readline():
            if version != b"WARC/1.1\r\n":
                raise ValueError(f"{path}: no record starts with {version[:40]!r}")
            headers = {}
            while (line := text.readline()) != b"\r\n":
                key, _, value = line.decode("utf-8").rstrip("\r\n").partition(": ")
                headers[key] = value
            size = int(headers["Content-Length"])
            block = text.read(size)
            if len(block) != size or text.read(4) != b"\r\n\r\n":
                raise ValueError(f"{path}: a record is cut off")
            yield headers, block


class _Rest:
    """A source whose first bytes have been read already."""

    def __init__(self, head: bytes, raw: pa.NativeFile):
        self.head, self.raw = head, raw

    def read(self, size: int) -> bytes:
        if self.head:
            head, self.head = self.head, b""
            return head
        return self.raw.read(size)


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def parsed(headers: dict[str, str], block: bytes) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = headers["WARC-Type"]
    if kind == "response" and (len(payload) != size or digest_of(payload) != digest):
        raise ValueError(f"{headers['WARC-Record-ID']}: the payload doesn't match its digest")
    return (
        _page(headers["WARC-Record-ID"]),
        headers.get("WARC-Target-URI"),
        size,
        digest,
        kind,
        _page(headers.get("WARC-Refers-To")),
        payload if kind == "response" else None,
    )


def read_archives(manifest: DataFrame, *, payloads: bool = False) -> DataFrame:
    """A row per record of the archives that the manifest names; payloads of responses on request."""
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    wide = len(names) if payloads else len(names) - 1
    most = 200 if payloads else 5000

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for path in batch.column("path").to_pylist():
                for headers, block in _records(path):
                    rows.append(parsed(headers, block)[:wide])
                    if len(rows) >= most:
                        yield _batch(rows)
                        rows = []
        if rows:
            yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds[:wide], strict=True)], names[:wide]
        )

    schema = RECORD if payloads else RECORD.rpartition(",")[0]
    return manifest.select("path").mapInArrow(read, schema)


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives in the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
