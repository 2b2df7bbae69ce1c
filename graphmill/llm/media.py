"""Media columns: payloads as images in archives, read by a custom data source.

A payload of bytes is stored losslessly as an 8-bit grey image (PNG, WIDTH
samples a row). Each writing task streams its images into ZIP archives of its
own below a shared folder, with an index of offsets, sizes and checksums beside
each, and returns a manifest row for every range of about range_bytes: where it
starts and ends, and which part of the index is its own. Archives of failed
attempts are in no manifest.

The data source "media_archive" plans a partition for each of these byte ranges.
A reading task fetches its part of the index and reads each member on its own, by
its offset: a failed or corrupt read of a member is tried again without touching
the others. Rows leave in Arrow batches of at most BATCH bytes of payload or one
member. No shuffle; memory per task is bounded by one batch, the largest member
and, while writing, the directory of an archive of at most MEMBERS_MOST members.

Defined results: a null text is the empty payload, which is padded to one row;
a null doc_id comes back null, ids are cast to long (text that is no number is an
error); repeated rows are members of their own; equal
payloads have equal stored bytes; an empty table gives an empty result. Only
the named columns are read.
"""

from __future__ import annotations

import hashlib
import io
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import dataset
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from graphmill.llm.shared import file_system, scratch, small_batches, text_of

WIDTH = 576
PAD = b"\xff"
SIGNATURE = b"\x89PNG\r\n\x1a\n"
BATCH = 4 << 20
TRIES = 4
MEMBERS_MOST = 50_000
RANGE = 16 << 20
MANIFEST = "archive string, start long, end long, index_start long, n_members long"
#: What the index has of a member.
INDEX = np.dtype([("offset", "<i8"), ("size", "<i8"), ("crc", "<u4"), ("doc_id", "<i8"), ("null", "?")])
MEMBERS = "archive string, offset long, doc_id long, media binary"


def padded(data: bytes) -> bytes:
    """data with bytes 255 up to a positive multiple of WIDTH."""
    return data + PAD * (-len(data) % WIDTH if data else WIDTH)


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, level: int = 1) -> bytes:
    """payload as the samples of a grey image of 8 bits."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    filtered = np.zeros((len(rows), WIDTH + 1), np.uint8)
    filtered[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(filtered.tobytes(), level)) + chunk(b"IEND", b"")


def from_png(data: bytes) -> bytes:
    """The samples of an image by to_png(); checks its checksums."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG image")
    at, packed, head = 8, [], b""
    while at < len(data):
        (size,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError(f"checksum of {kind!r} differs")
        if kind == b"IHDR":
            head = body
        elif kind == b"IDAT":
            packed.append(body)
        at += size + 12
    width, height, *form = struct.unpack(">IIBBBBB", head)
    if form != [8, 0, 0, 0, 0]:
        raise ValueError("not a plain grey image of 8 bits")
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("rows are filtered")
    return rows[:, 1:].tobytes()


class ArchiveSink:
    """One archive while it is written, and its index."""

    def __init__(self, folder: str, range_bytes: int):
        system, inner = file_system(folder)
        name = f"{uuid.uuid4().hex}.zip"
        self.path, self.range_bytes = f"{folder}/{name}", range_bytes
        self.sink, self.index = system.open_output_stream(f"{inner}/{name}"), system.open_output_stream(f"{inner}/{name}.index")
        self.archive = zipfile.ZipFile(Appending(self.sink), "w", zipfile.ZIP_STORED, allowZip64=True)
        self.n, self.start, self.entries, self.rows = 0, 0, [], []

    def add(self, doc_id: int | None, image: bytes) -> None:
        member = zipfile.ZipInfo(f"{self.n:09d}-{'null' if doc_id is None else doc_id}.png")
        self.archive.writestr(member, image)
        self.entries.append((member.header_offset, member.compress_size, member.CRC, doc_id or 0, doc_id is None))
        self.n += 1
        if self.sink.tell() - self.start >= self.range_bytes:
            self.close_range()

    def close_range(self) -> None:
        end = self.sink.tell()
        self.rows.append({"archive": self.path, "start": self.start, "end": end, "index_start": self.index.tell(), "n_members": len(self.entries)})
        self.index.write(np.array(self.entries, INDEX).tobytes())
        self.start, self.entries = end, []

    def closed(self) -> pa.RecordBatch:
        if self.entries:
            self.close_range()
        self.archive.close()
        self.sink.close()
        self.index.close()
        schema = pa.schema([("archive", pa.string()), *((c, pa.int64()) for c in ("start", "end", "index_start", "n_members"))])
        return pa.RecordBatch.from_pylist(self.rows, schema)


def archive_writer(folder: str, max_bytes: int, range_bytes: int):
    """For mapInArrow: (doc_id, payload) -> manifest rows."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = file_system(folder)
        system.create_dir(inner, recursive=True)
        out = None
        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out = out or ArchiveSink(folder, range_bytes)
                out.add(doc_id, to_png(padded(data.as_py() or b"")))
                if out.sink.tell() >= max_bytes or out.n >= MEMBERS_MOST:
                    yield out.closed()
                    out = None
        if out is not None:
            yield out.closed()

    return write


class Appending(io.RawIOBase):
    """A stream that only appends, as object stores want it."""

    def __init__(self, sink):
        self.sink = sink

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.sink.write(bytes(data))
        return len(data)


class ByteRange(InputPartition):
    """The members of one archive from start up to end, by their part of the index."""

    def __init__(self, archive: str, start: int, end: int, index_start: int, n_members: int):
        super().__init__((archive, start, end, index_start, n_members))
        self.archive, self.index_start, self.n_members = archive, index_start, n_members


def member_at(source, offset: int, size: int, crc: int) -> bytes:
    """One stored member by its header's offset, checked."""
    head = source.read_at(30, offset)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("no member starts here")
    name, extra = struct.unpack_from("<HH", head, 26)
    data = source.read_at(size, offset + 30 + name + extra)
    if len(data) != size or zlib.crc32(data) != crc:
        raise ValueError("member is cut short or corrupt")
    return data


def with_retries(open_source, member: tuple[int, int, int], archive: str, pause: float = 0.2) -> bytes:
    """member_at(), tried again on a newly opened archive where it fails."""
    for attempt in range(TRIES):
        try:
            with open_source() as source:
                return member_at(source, *member)
        except (OSError, ValueError) as error:
            if attempt == TRIES - 1:
                raise OSError(f"{archive}, member at {member[0]}: {error}") from error
            time.sleep(pause * 2**attempt)
    raise AssertionError


class ArchiveReader(DataSourceReader):
    def __init__(self, manifest: str):
        self.manifest = manifest

    def partitions(self) -> list[ByteRange]:
        """One for each row of the manifest, as many as there are tasks."""
        system, inner = file_system(self.manifest)
        rows = dataset.dataset(inner, filesystem=system, format="parquet", schema=pa.schema([("archive", pa.string()), *((c, pa.int64()) for c in ("start", "end", "index_start", "n_members"))])).to_table()
        found = [ByteRange(**r) for r in rows.to_pylist()]
        return found or [ByteRange("", 0, 0, 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        system, inner = file_system(partition.archive)

        def opened():
            return system.open_input_file(inner)

        with system.open_input_file(f"{inner}.index") as index:
            entries = np.frombuffer(index.read_at(partition.n_members * INDEX.itemsize, partition.index_start), INDEX)
        with opened() as source:
            rows: list[tuple] = []
            held = 0
            for offset, size, crc, doc_id, null in entries.tolist():
                try:
                    media = member_at(source, offset, size, crc)
                except (OSError, ValueError):
                    media = with_retries(opened, (offset, size, crc), partition.archive)
                rows.append((partition.archive, offset, None if null else doc_id, media))
                held += len(media)
                if held >= BATCH:
                    yield as_batch(rows)
                    rows, held = [], 0
            if rows:
                yield as_batch(rows)


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["archive", "offset", "doc_id", "media"])


class MediaArchive(DataSource):
    """Option manifest: the folder of a manifest written by write_archives()."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["manifest"])


def write_archives(docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text", max_archive_bytes: int = 1 << 28, range_bytes: int = RANGE) -> str:
    """Store every text as an image; returns the folder of the manifest."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long"), text_of(text_col).cast("binary"))
    manifest = scratch(docs.sparkSession, "media-manifest")
    rows.mapInArrow(archive_writer(folder, max_archive_bytes, range_bytes), MANIFEST).write.parquet(manifest)
    return manifest


def read_archives(spark: SparkSession, manifest: str) -> DataFrame:
    """(archive, offset, doc_id, media) of the members of a manifest's archives."""
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").option("manifest", manifest).load()


def features(payload: bytes) -> str:
    """Mean and spread of the samples, and shares of 16 brightness bins, in
    thousandths: whole numbers only, so equal on any machine."""
    samples = np.frombuffer(payload, np.uint8).astype(np.int64)
    n, total, squares = len(samples), int(samples.sum()), int((samples * samples).sum())
    bins = np.bincount(samples >> 4, minlength=16)
    values = [1000 * total // n, 1000 * (n * squares - total * total) // (n * n), *(1000 * bins // n).tolist()]
    return ",".join(map(str, values))


def measured(media: DataFrame) -> DataFrame:
    """Read-back figures of each member: payload and stored bytes, digests, features."""
    kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, image in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                image = image.as_py()
                payload = from_png(image)
                rows.append((doc_id, len(payload.rstrip(PAD)), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(image), hashlib.sha256(image).hexdigest(), features(payload)))
            columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("doc_id", "media").mapInArrow(measure, schema)


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Write docs to archives in scratch, read them back and measure them."""
    spark = docs.sparkSession
    return measured(read_archives(spark, write_archives(docs, scratch(spark, "media"), **options)))
