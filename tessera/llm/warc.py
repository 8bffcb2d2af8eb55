"""WARC records in ZIP-packaged archives, and a reader that takes records out of them by range reads.

An archive is a ZIP file with two stored members: the records, each a gzip member of its own, and an index with a line
(offset, length, page) for each record. The reader parses the end record, the ZIP64 records and the central directory, finds
where the stored members begin, reads the index and then the byte range of each record; nothing is extracted.

Of records with equal payloads of at least ``min_bytes`` bytes, the one with the smallest page id holds the payload, the others are
revisits. Which pages revisit is settled on digests alone, before anything is written; pages are then written where they are read.
Archives go to the shared folder under names that no other attempt of a task takes; the manifest names those of the attempt that counted.

Cases: a null html is an empty payload; null urls are left out of the record; a page without an id is always a response and its id is
read back as null; equal rows, with equal ids, are responses both; empty tables give empty archives and results; only the named columns are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, fresh_path, stored

ARCHIVE_BYTES = 64 << 20
#: Index lines that one task reads.
SLICE = 4096
RECORDS, INDEX = "archive/records.warc.gz", "indexes/index.cdxj"
BROADCAST_ROWS = 200_000


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---- records


def record_bytes(page_id: object, url: str | None, payload: bytes, refers_to: object) -> bytes:
    """One WARC record: a response with an HTTP head, or a revisit without the payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=chr(37) + '/:?#[]@!$&()*+,;=~-._' + chr(39))}")
    if page_id is not None:
        head.append(f"Page-Id: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"Refers-To-Page-Id: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed_record(data: bytes) -> dict:
    """Page, type, payload, its length and digest, and what a revisit refers to; a response's digest is checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x[15:]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or base32_sha1(payload) != digest):
        raise ValueError(f"the payload of page {fields.get('Page-Id')} is damaged")
    return {"page_id": fields.get("Page-Id"), "url": fields.get("WARC-Target-URI"), "record_type": kind, "payload": payload if kind == "response" else None, "payload_bytes": length, "payload_digest": digest, "refers_to": fields.get("Refers-To-Page-Id")}


# ---- archives


class ArchiveWriter:
    def __init__(self, folder: str):
        self.uri = f"{folder}/{uuid.uuid4().hex}.zip"
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        self.out = store.open_output_stream(f"{path}/{self.uri.rpartition('/')[2]}")
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(RECORDS, "w", force_zip64=True)
        self.index: list[str] = []
        self.size = 0

    def add(self, page_id: object, record: bytes) -> None:
        data = gzip.compress(record, 5, mtime=0)
        self.member.write(data)
        self.index.append(f"{self.size} {len(data)} {'-' if page_id is None else page_id}\n")
        self.size += len(data)

    def close(self) -> list[tuple[str, int, int]]:
        """Slices of the archive for its readers: (uri, first line, lines)."""
        self.member.close()
        self.zip.writestr(INDEX, "".join(self.index))
        self.zip.close()
        self.out.close()
        return [(self.uri, k, min(SLICE, len(self.index) - k)) for k in range(0, len(self.index), SLICE)]


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    start: int  # of its data


class ArchiveReader:
    """Members of a ZIP file by its directories; ``source`` has read_at(length, offset) and size()."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        tail_at = max(0, size - 65_557)
        tail = source.read_at(size - tail_at, tail_at)
        at = tail.rfind(b"PK\x05\x06")
        while at >= 0 and (len(tail) - at < 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(b"PK\x05\x06", 0, at)  # the mark stood inside the comment
        if at < 0:
            raise ValueError("no end of a central directory")
        count, length, offset = struct.unpack_from("<HII", tail, at + 10)
        if count == 0xFFFF or length == 0xFFFFFFFF or offset == 0xFFFFFFFF:
            locator = source.read_at(20, tail_at + at - 20)
            if locator[:4] != b"PK\x06\x07":
                raise ValueError("no ZIP64 locator")
            end64 = source.read_at(56, struct.unpack_from("<Q", locator, 8)[0])
            if end64[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of a central directory")
            count, length, offset = struct.unpack_from("<QQQ", end64, 32)
        self.members: dict[str, Member] = {}
        directory, p = source.read_at(length, offset), 0
        for _ in range(count):
            if directory[p : p + 4] != b"PK\x01\x02":
                raise ValueError("the central directory is damaged")
            flags, method = struct.unpack_from("<HH", directory, p + 8)
            packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, p + 20)
            header = struct.unpack_from("<I", directory, p + 42)[0]
            name = directory[p + 46 : p + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra, e = directory[p + 46 + n_name : p + 46 + n_name + n_extra], 0
            while e + 4 <= len(extra):
                kind, n = struct.unpack_from("<HH", extra, e)
                if kind == 1:  # ZIP64: the fields that did not fit, in this order
                    values = list(struct.unpack_from(f"<{n // 8}Q", extra, e + 4))
                    plain = values.pop(0) if plain == 0xFFFFFFFF else plain
                    packed = values.pop(0) if packed == 0xFFFFFFFF else packed
                    header = values.pop(0) if header == 0xFFFFFFFF else header
                e += 4 + n
            local = source.read_at(30, header)
            if local[:4] != b"PK\x03\x04":
                raise ValueError(f"no local header of {name!r}")
            self.members[name] = Member(name, method, packed, header + 30 + sum(struct.unpack_from("<HH", local, 26)))
            p += 46 + n_name + n_extra + n_comment

    def read(self, name: str, offset: int = 0, length: int | None = None) -> bytes:
        """A byte range of a stored member."""
        m = self.members[name]
        if m.method:
            raise ValueError(f"{name!r} is compressed; its ranges can't be read")
        length = m.size - offset if length is None else length
        if offset < 0 or offset + length > m.size:
            raise ValueError(f"{name!r} has {m.size} bytes")
        return self.source.read_at(length, m.start + offset) if length else b""

    def index(self) -> list[tuple[int, int]]:
        return [(int(a), int(b)) for a, b, _ in (x.split(" ", 2) for x in self.read(INDEX).decode().splitlines())]


def records(uri: str, first: int = 0, n: int | None = None) -> Iterator[dict]:
    """Records of an archive by its index lines ``first`` to ``first + n``; neighbours are read in ranges of up to 4 MB."""
    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        reader = ArchiveReader(f)
        lines = reader.index()[first : None if n is None else first + n]
        k = 0
        while k < len(lines):
            j = k + 1
            while j < len(lines) and lines[j][0] + lines[j][1] - lines[k][0] <= 4 << 20 and lines[j][0] == sum(lines[j - 1]):
                j += 1
            data = reader.read(RECORDS, lines[k][0], sum(lines[j - 1]) - lines[k][0])
            for a, b in lines[k:j]:
                yield parsed_record(gzip.decompress(data[a - lines[k][0] : a - lines[k][0] + b]))
            k = j


# ---- DataFrames


def revisits(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(id, digest, refers_to) of the pages that repeat a payload. Works on digests; a hot digest's rows join with one row."""
    digests = stored(pages.select("id", F.sha1(F.coalesce(F.col("html"), F.lit(""))).alias("digest"), F.octet_length(F.coalesce(F.col("html"), F.lit(""))).alias("n")).where(F.col("id").isNotNull() & (F.col("n") >= min_bytes)).drop("n"), "digests")
    firsts = stored(digests.groupBy("digest").agg(F.min("id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n"), "firsts")
    return stored(digests.join(firsts, "digest").where("id <> refers_to").select("id", "digest", "refers_to").distinct(), "revisits")


def write_archives(pages: DataFrame, folder: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the archives; their manifest, a row (uri, first, n) for each slice that a reader takes."""
    bound_batches(pages.sparkSession)
    rows = pages.select(F.col(page_id).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"))
    again = revisits(rows, min_bytes)
    small = again.count() <= BROADCAST_ROWS
    marked = rows.withColumn("digest", F.sha1(F.coalesce(F.col("html"), F.lit("")))).join(F.broadcast(again) if small else again, ["id", "digest"], "left").select("id", "url", "html", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done = None, []
        for b in batches:
            for i, u, h, r in zip(*(b.column(c).to_pylist() for c in ("id", "url", "html", "refers_to"))):
                writer = writer or ArchiveWriter(folder)
                writer.add(i, record_bytes(i, u, (h or "").encode(), r))
                if writer.size >= archive_bytes:
                    done += writer.close()
                    writer = None
        done += writer.close() if writer else []
        yield pa.RecordBatch.from_pylist([dict(zip(("uri", "first", "n"), x)) for x in done], pa.schema([("uri", pa.string()), ("first", pa.int64()), ("n", pa.int64())]))

    return stored(marked.mapInArrow(run, "uri string, first long, n long"), "manifest")


READ = "page_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string"


def read_archives(manifest: DataFrame, *, payloads: bool = False) -> DataFrame:
    """The records of the archives, with their payloads where asked for."""
    columns = [("page_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string())]
    schema = pa.schema([*columns, ("payload", pa.binary())] if payloads else columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, first, n in zip(*(b.column(c).to_pylist() for c in ("uri", "first", "n"))):
                out: list[dict] = []
                for r in records(uri, first, n):
                    out.append({f.name: r[f.name] for f in schema})
                    if len(out) >= 256:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out = []
                yield pa.RecordBatch.from_pylist(out, schema)

    slices = max(1, min(manifest.count(), 10_000))
    return manifest.repartition(slices, "uri", "first").mapInArrow(run, READ + ", payload binary" * payloads)


def round_trip(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, payloads: bool = False) -> DataFrame:
    """Writes the pages to archives in the shared folder and reads their records back, ids in their own type."""
    manifest = write_archives(pages, fresh_path(pages.sparkSession, "archives"), page_id=page_id, url=url, html=html, min_bytes=min_bytes, archive_bytes=archive_bytes)
    kind = pages.schema[page_id].dataType
    out = read_archives(manifest, payloads=payloads)
    return out.withColumns({"page_id": F.col("page_id").cast(kind), "refers_to": F.col("refers_to").cast(kind)}).withColumnRenamed("page_id", page_id)
