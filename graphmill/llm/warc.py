"""WARC archives: one gzip member per record, written by partition, read sequentially.

Writing: every task streams its rows into archives of its own below a shared
folder and returns a manifest row per archive; archives of failed attempts are
in no manifest. Reading: one task per archive walks it front to back, inflating
one gzip member after another in small chunks, framing each block by its
Content-Length and verifying block and payload digests.

Records with equal payloads: that with the smallest page_id is the response,
the others are revisits that refer to it. Digests are aggregated with map-side
combining, without their pages. Hashes of the repeated digests make a bitmap of at
most MAX_BITS bits (32 MB), which is broadcast: a page whose bit is not set is the only
one of its payload and goes from the scan straight to the writer. Only pages
whose bit is set (those with repeats, and of the others about one in SPARE, more where
MAX_BITS is short) take part in a join. In it a digest held by over 1/HOT of all rows
(there are at most HOT of them) is joined by broadcast, every other one by a shuffle in
which no key then holds more than 1/HOT of the rows. So html is read three times
(digests, singles, repeats) and singles are never shuffled. Record ids are unique to
archive and place; a page's id, which may repeat, has a field of its own.

Defined results: null html is the empty payload; a null url becomes the
record's own URN; ids are cast to long (text that is no number is an error); rows tied on the smallest page_id of their payload are all
responses; a null page_id orders after all others; an empty table gives an empty
result. Only the named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.llm.shared import file_system, scratch, text_of, written

HOT = 1000
#: Bits of the bitmap of repeated digests: SPARE for each, MAX_BITS at most.
SPARE, MAX_BITS = 16, 1 << 28
CHUNK = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "archive string, n_records long, n_bytes long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def with_repeat_bit(keyed: DataFrame, shared: DataFrame) -> DataFrame:
    """keyed (digest, ...) with repeats: false only where shared (digest, ...) doesn't
    have the digest."""
    n_bits = min(MAX_BITS, 1 << (SPARE * shared.count()).bit_length())
    place = F.pmod(F.xxhash64("digest"), F.lit(n_bits)) + 1
    bits = shared.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("bucket"))
    bits = written(bits.agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")), "warc-bits")
    placed = keyed.withColumn("bucket", F.bitmap_bucket_number(place)).withColumn("at", F.bitmap_bit_position(place))
    out = placed.join(F.broadcast(bits), "bucket", "left")  # MAX_BITS / 32,768 rows of 4 KB at most
    byte = F.conv(F.hex(F.expr("substring(bits, cast(at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    bit = F.getbit(byte, (F.col("at") % 8).cast("int"))
    return out.withColumn("repeats", F.coalesce(bit == 1, F.lit(False))).select(*keyed.columns, "repeats")


def with_roles(pages: DataFrame, *, id_col: str, url_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """page_id, url, payload, refers_to (null for a response) of each row."""
    body = text_of(html_col)
    keyed = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        body.cast("binary").alias("payload"), F.unhex(F.sha1(body.cast("binary"))).alias("digest"),
    )
    shared = keyed.where(F.octet_length("payload") >= min_bytes).groupBy("digest")
    shared = shared.agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    shared = written(shared, "warc-digests")
    marked = with_repeat_bit(keyed, shared)
    singles = marked.where(~F.col("repeats")).select("page_id", "url", "payload", F.lit(None).cast("long").alias("refers_to"))
    return singles.unionByName(referring(marked.where("repeats"), shared, pages.count() // HOT))


def referring(keyed: DataFrame, shared: DataFrame, share: int) -> DataFrame:
    """keyed (page_id, url, payload, digest) with the first of shared (digest, first, n)
    as refers_to; digests of more than share rows are joined by broadcast."""
    hot = shared.where(F.col("n") > share).select("digest", F.col("first").alias("hot_first"))
    rest = shared.where(F.col("n") <= share).select(F.col("digest").alias("key"), "first")
    out = keyed.join(F.broadcast(hot), "digest", "left")
    spread = F.concat(F.lit("hot"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))).cast("binary")
    out = out.withColumn("key", F.when(F.col("hot_first").isNotNull(), spread).otherwise(F.col("digest")))
    out = out.join(rest, "key", "left").withColumn("first", F.coalesce("hot_first", "first"))
    refers = F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    return out.select("page_id", "url", "payload", refers.alias("refers_to"))


def sha1_32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str, place: str = "") -> bytes:
    """One WARC record, uncompressed; place, unique to it, makes its id unique."""
    urn = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, place)}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<{urn}>",
        "WARC-Date": date,
        "WARC-Target-URI": urn if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~"),
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha1:{sha1_32(payload)}",
        "WARC-Block-Digest": f"sha1:{sha1_32(block)}",
        "Page-Id": "null" if page_id is None else str(page_id),
    }
    if refers_to is not None:
        fields |= {"WARC-Profile": PROFILE, "Refers-To-Page-Id": str(refers_to)}
    fields["Content-Length"] = str(len(block))
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def archive_writer(folder: str, date: str, level: int, max_bytes: int):
    """For mapInArrow: rows of with_roles() -> manifest rows."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = file_system(folder)
        system.create_dir(inner, recursive=True)
        sink, name, n, size = None, "", 0, 0

        def closed() -> pa.RecordBatch:
            sink.close()
            return pa.RecordBatch.from_pylist([{"archive": f"{folder}/{name}", "n_records": n, "n_bytes": size}], pa.schema([("archive", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())]))

        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if sink is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    sink = system.open_output_stream(f"{inner}/{name}", compression=None)
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = packer.compress(record(page_id, url, payload, refers_to, date, f"{name}#{n}")) + packer.flush()
                sink.write(member)
                n, size = n + 1, size + len(member)
                if size >= max_bytes:
                    yield closed()
                    sink = None
        if sink is not None:
            yield closed()

    return write


class Members:
    """The bytes of one gzip member after another, inflated chunk by chunk."""

    def __init__(self, source):
        self.source, self.rest, self.held, self.inflater = source, b"", b"", None

    def next_member(self) -> bool:
        if not self.rest:
            self.rest = self.source.read(CHUNK)
        self.held, self.inflater = b"", zlib.decompressobj(31)
        return bool(self.rest)

    def more(self) -> bytes:
        """The next inflated bytes; empty at the member's end."""
        while not self.inflater.eof:
            data = self.rest or self.source.read(CHUNK)
            if not data:
                raise EOFError("archive ends inside a gzip member")
            out = self.inflater.decompress(data, CHUNK)
            self.rest = self.inflater.unconsumed_tail or self.inflater.unused_data
            if out:
                return out
        return b""

    def until(self, mark: bytes) -> bytes:
        while (at := self.held.find(mark)) < 0:
            if not (data := self.more()):
                raise EOFError("record header is cut short")
            self.held += data
        out, self.held = self.held[: at + len(mark)], self.held[at + len(mark) :]
        return out

    def exactly(self, n: int) -> Iterator[bytes]:
        while n:
            data = self.held or self.more()
            if not data:
                raise EOFError("block is shorter than its Content-Length")
            self.held, data = data[n:], data[:n]
            n -= len(data)
            yield data


def fields_of(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def page_id_of(value: str) -> int | None:
    return None if value == "null" else int(value)


def read_records(source) -> Iterator[dict]:
    """The records of one archive in order; raises ValueError or EOFError for
    wrong framing or digests."""
    members = Members(source)
    while members.next_member():
        head = fields_of(members.until(b"\r\n\r\n"))
        left, block, payload = int(head["content-length"]), hashlib.sha1(), hashlib.sha1()
        http, n = b"", 0
        inside = False
        for data in members.exactly(left):
            block.update(data)
            if not inside:
                http += data
                if (at := http.find(b"\r\n\r\n")) < 0:
                    continue
                http, data, inside = http[: at + 4], http[at + 4 :], True
            payload.update(data)
            n += len(data)
        if b"".join(members.exactly(4)) != b"\r\n\r\n" or members.held or members.more():
            raise ValueError("record is not framed by its Content-Length")
        revisit = head["warc-type"] == "revisit"
        digest = head["warc-payload-digest"].removeprefix("sha1:")
        if head["warc-block-digest"] != "sha1:" + base64.b32encode(block.digest()).decode():
            raise ValueError(f"block digest differs in {head['warc-record-id']}")
        if not revisit and digest != base64.b32encode(payload.digest()).decode():
            raise ValueError(f"payload digest differs in {head['warc-record-id']}")
        stated = int(fields_of(http)["content-length"])
        if not revisit and stated != n:
            raise ValueError(f"payload length differs in {head['warc-record-id']}")
        yield {
            "page_id": page_id_of(head["page-id"]), "url": head["warc-target-uri"], "payload_bytes": stated,
            "payload_digest": digest, "record_type": head["warc-type"],
            "refers_to": page_id_of(head["refers-to-page-id"]) if revisit else None,
        }


def read_archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: manifest rows -> record rows."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    for batch in batches:
        for archive in batch.column(0).to_pylist():
            system, inner = file_system(archive)
            with system.open_input_stream(inner, compression=None) as source:
                rows = []
                for row in read_records(source):
                    rows.append(row)
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)


def write_warc(
    pages: DataFrame,
    folder: str | None = None,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_bytes: int = 0,
    date: str = "2024-01-01T00:00:00Z",
    level: int = 6,
    max_archive_bytes: int = 1 << 28,
) -> DataFrame:
    """Write archives below folder (default: scratch) and return their manifest."""
    folder = folder or scratch(pages.sparkSession, "warc")
    rows = with_roles(pages, id_col=id_col, url_col=url_col, html_col=html_col, min_bytes=min_bytes)
    return written(rows.mapInArrow(archive_writer(folder, date, level, max_archive_bytes), MANIFEST), "warc-manifest")


def read_warc(manifest: DataFrame) -> DataFrame:
    """The records of the archives that a manifest lists, one task per archive."""
    n = max(1, manifest.count())
    return manifest.select("archive").repartition(n).mapInArrow(read_archives, RECORDS)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    return read_warc(write_warc(pages, **options))


