"""WARC records in ZIP-packaged archives: a writer, and a reader by byte ranges.

An archive is a ZIP file of stored (uncompressed) members: ``archive/data.warc.gz``, one gzip member for
each WARC record, and ``indexes/index.cdxj``, one JSON line for each record with its range in the data
member. The reader never extracts a member: it reads the end of the file, finds the central directory
(with ZIP64 records where sizes or offsets need them), takes the place of each stored member from its
local header, reads the index and then only the records' ranges.

Payloads of ``least`` bytes or more that are equal are stored once: the record of the smallest page_id
is the response, the others are revisits that name its digest and page. Only the narrow table of
repeated digests is shuffled to find them.

Archives go to the shared folder of intermediate tables. Each task rolls over to a new one at ``most``
bytes and names it by chance, so a repeated task can't meet another's file; the manifest, which is
written when all archives are, lists the ones that count.

Defined cases: a null html is an empty payload; a null page_id is written as an empty header and read
back as null, and is the largest when responses are chosen; rows of equal page_id and payload are all
responses when they come first; a null url becomes ``urn:none``; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, stored

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Fixed values of the ZIP format: signatures and sizes of the records read here.
END, END64, LOCATOR, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
END_SIZE, LOCATOR_SIZE, ENTRY_SIZE, LOCAL_SIZE = 22, 20, 46, 30
MAX16, MAX32 = 0xFFFF, 0xFFFFFFFF


class Member:
    """A stored member: its name, the place of its local header and its size."""

    def __init__(self, name: str, header: int, size: int, method: int):
        self.name, self.header, self.size, self.method = name, header, size, method


class ZipReader:
    """Members of a ZIP file behind ``read_at(offset, size)``."""

    def __init__(self, read_at, size: int):
        self._read = read_at
        self._starts: dict[str, int] = {}
        tail_size = min(size, END_SIZE + LOCATOR_SIZE + MAX16)
        tail = read_at(size - tail_size, tail_size)
        at = tail.rfind(END, 0, len(tail) - END_SIZE + len(END))
        while at >= 0 and at + END_SIZE + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
            at = tail.rfind(END, 0, at)  # the signature may stand in the comment
        if at < 0:
            raise ValueError("no end of central directory: not a ZIP file, or cut off")
        count, length, offset = struct.unpack_from("<HII", tail, at + 10)
        if MAX16 == count or MAX32 in (length, offset):
            if at < LOCATOR_SIZE or tail[at - LOCATOR_SIZE : at - LOCATOR_SIZE + 4] != LOCATOR:
                raise ValueError("ZIP64 sizes without a ZIP64 locator")
            place = struct.unpack_from("<Q", tail, at - LOCATOR_SIZE + 8)[0]
            record = read_at(place, 56)
            if record[:4] != END64:
                raise ValueError("no ZIP64 end of central directory where the locator points")
            count, length, offset = struct.unpack_from("<QQQ", record, 32)
        self.members = {m.name: m for m in self._entries(read_at(offset, length), count)}

    @staticmethod
    def _entries(raw: bytes, count: int) -> Iterator[Member]:
        at = 0
        for _ in range(count):
            if raw[at : at + 4] != ENTRY:
                raise ValueError("damaged central directory")
            flags, method = struct.unpack_from("<HH", raw, at + 8)
            packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", raw, at + 20)
            header = struct.unpack_from("<I", raw, at + 42)[0]
            name = raw[at + ENTRY_SIZE : at + ENTRY_SIZE + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra = raw[at + ENTRY_SIZE + n_name : at + ENTRY_SIZE + n_name + n_extra]
            e = 0
            while e + 4 <= len(extra):
                tag, n = struct.unpack_from("<HH", extra, e)
                if tag == 1:  # 64-bit values, only those that don't fit above, in this order
                    wide = list(struct.unpack_from(f"<{n // 8}Q", extra, e + 4))
                    plain = wide.pop(0) if plain == MAX32 else plain
                    packed = wide.pop(0) if packed == MAX32 else packed
                    header = wide.pop(0) if header == MAX32 else header
                e += 4 + n
            yield Member(name, header, packed, method)
            at += ENTRY_SIZE + n_name + n_extra + n_comment

    def read(self, name: str, offset: int = 0, size: int | None = None) -> bytes:
        """``size`` bytes of a stored member from ``offset`` on."""
        member = self.members[name]
        if member.method:
            raise ValueError(f"{name} is compressed: ranges need a stored member")
        if name not in self._starts:
            head = self._read(member.header, LOCAL_SIZE)
            if head[:4] != LOCAL:
                raise ValueError(f"no local header for {name}")
            self._starts[name] = member.header + LOCAL_SIZE + sum(struct.unpack_from("<HH", head, 26))
        size = member.size - offset if size is None else size
        if offset < 0 or offset + size > member.size:
            raise ValueError(f"range outside of {name}")
        return self._read(self._starts[name] + offset, size)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record. Ids and dates follow from the content, so a repeated write gives the same bytes."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}:{digest}")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{name}>",
        f"WARC-Date: {datetime(2020, 1, 1, tzinfo=UTC):%Y-%m-%dT%H:%M:%SZ}",
        f"WARC-Target-URI: {' '.join((url or 'urn:none').split())}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"X-Refers-To-Page: {refers_to}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Page, payload size and digest (of the stored payload, if there is one), type and what it refers to."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    size = int(fields["x-payload-length"])
    if fields["warc-type"] == "response":
        if hashlib.sha256(payload).hexdigest() != digest or len(payload) != size:
            raise ValueError(f"payload of page {fields['x-page-id']} doesn't match its digest")
    return {
        "page_id": int(fields["x-page-id"]) if fields["x-page-id"] else None,
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": fields["warc-type"],
        "refers_to": int(fields["x-refers-to-page"]) if "x-refers-to-page" in fields else None,
        "url": fields["warc-target-uri"],
    }


class ArchiveWriter:
    """Streams records into one archive; the index is kept until the end."""

    def __init__(self, sink, zip64: bool = True):
        self._zip = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED)
        self._data = self._zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=zip64)
        self._index: list[str] = []
        self.at = 0

    def add(self, page_id: int | None, raw: bytes) -> None:
        pack = zlib.compressobj(3, zlib.DEFLATED, 31)
        packed = pack.compress(raw) + pack.flush()
        self._data.write(packed)
        self._index.append(json.dumps({"page_id": page_id, "offset": self.at, "length": len(packed)}))
        self.at += len(packed)

    def close(self) -> int:
        self._data.close()
        self._zip.writestr(zipfile.ZipInfo(INDEX), "\n".join(self._index) + "\n" * bool(self._index))
        self._zip.close()
        return len(self._index)


def read_archive(archive: ZipReader, most: int = 4 << 20) -> Iterator[dict]:
    """All records by the index; successive ranges are fetched together, ``most`` bytes at a time."""
    lines = [json.loads(x) for x in archive.read(INDEX).decode().splitlines()]
    at = 0
    while at < len(lines):
        first, to, end = lines[at]["offset"], at, lines[at]["offset"]
        while to < len(lines) and lines[to]["offset"] == end and (to == at or end + lines[to]["length"] - first <= most):
            end += lines[to]["length"]
            to += 1
        raw = archive.read(DATA, first, end - first)
        for x in lines[at:to]:
            a = x["offset"] - first
            yield parse_record(zlib.decompress(raw[a : a + x["length"]], 31))
        at = to


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def write_archives(pages: DataFrame, folder: str, least: int = 100, most: int = 64 << 20) -> DataFrame:
    """Write ``pages(page_id, url, html)`` and return the manifest ``path, records``, already stored."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
    )
    digest = F.sha2(F.col("html").cast("binary"), 256)
    again = (
        rows.where(F.octet_length("html") >= least)
        .select(digest.alias("digest"), "page_id")
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("digest", "first")
    )
    ids = rows.where(F.octet_length("html") >= least).select("page_id", digest.alias("digest"))
    revisits = ids.join(again, "digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).distinct()
    revisits = revisits.select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), "first")
    both = rows.withColumn("digest", digest).join(
        revisits, F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left"
    )

    def work(batches):
        fs, base = _open(folder)
        writer = stream = path = None
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "r_digest", "first"))
            for page_id, url, html, known, revisit, first in zip(*columns, strict=True):
                if writer is None:
                    name = f"{uuid.uuid4().hex}.wacz"
                    path = f"{folder}/{name}"
                    stream = fs.open_output_stream(f"{base}/{name}")
                    writer = ArchiveWriter(_Sink(stream))
                writer.add(page_id, record(page_id, url, html.encode(), known, first, revisit is not None))
                if writer.at >= most:
                    yield _closed(writer, stream, path)
                    writer = None
        if writer is not None:
            yield _closed(writer, stream, path)

    made = both.select("page_id", "url", "html", "digest", "r_digest", "first").mapInArrow(work, "path string, records long")
    return stored(made, "manifest")


class _Sink(io.RawIOBase):
    """A stream that can't seek, as object stores offer."""

    def __init__(self, stream):
        self._stream = stream
        self._at = 0

    def writable(self) -> bool:
        return True

    def tell(self) -> int:
        return self._at

    def write(self, raw) -> int:
        self._stream.write(bytes(raw))
        self._at += len(raw)
        return len(raw)


def _closed(writer: ArchiveWriter, stream, path: str) -> pa.RecordBatch:
    n = writer.close()
    stream.close()
    return pa.record_batch({"path": pa.array([path]), "records": pa.array([n], pa.int64())})


SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
_ARROW = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "url": pa.string()}


def read_archives(manifest: DataFrame) -> DataFrame:
    """The records of all archives of ``manifest(path)``, each archive read by one task."""

    def work(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, local = _open(path)
                size = fs.get_file_info(local).size
                with fs.open_input_file(local) as f:

                    def read_at(offset: int, length: int, f=f) -> bytes:
                        f.seek(offset)
                        return f.read(length)

                    out: list[dict] = []
                    for x in read_archive(ZipReader(read_at, size)):
                        out.append(x)
                        if len(out) == 4096:
                            yield _batch(out)
                            out = []
                    yield _batch(out)

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(n, "path").mapInArrow(work, SCHEMA)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.record_batch({c: pa.array([r[c] for r in rows], kind) for c, kind in _ARROW.items()})


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives among the intermediate tables."""
    folder = f"{scratch(spark)}/warc-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    return folder
