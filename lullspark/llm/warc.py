"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames. A skippable frame at a bundle's end holds
the published seek table: compressed and plain size of each frame. An index maps every
record to its bundle, frame and offset within the plain frame, so one record costs one
seek and one frame. Equal payloads are stored once; others of the group revisit it.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lullspark.llm.common import scratch_path, stored

# Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
FOOTER, ENTRY, HEADER = "<IBI", "<II", "<II"

MIN_REVISIT_BYTES = 1000
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 256 << 20
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "record_id string, bundle string, frame long, offset long, length long"


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or absolute path, and the path within it."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def record_id(page_id: int | None) -> str:
    return f"urn:page:{'null' if page_id is None else page_id}"


def warc_record(page_id: int | None, url: str | None, html: str | None, refers_to: int | None) -> bytes:
    """One record; that of a revisit has the HTTP head only, with digest and length of the whole payload."""
    payload = (html or "").encode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{record_id(page_id)}>"),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{hashlib.sha1(payload).hexdigest()}"),
        ("WARC-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(c if c > " " else f"%{ord(c):02X}" for c in url)))
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<{record_id(refers_to)}>"), ("WARC-Profile", REVISIT_PROFILE)]
    top = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return top.encode() + block + b"\r\n\r\n"


def parse_records(plain: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """``offset, length, fields, block`` of the records in a plain frame."""
    at = 0
    while at < len(plain):
        top = plain.index(b"\r\n\r\n", at)
        lines = plain[at:top].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record at {at}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        end = top + 4 + int(fields["Content-Length"])
        if plain[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at {at} has a wrong length")
        yield at, end + 4 - at, fields, plain[top + 4 : end]
        at = end + 4


class BundleWriter:
    """Writes frames to one file; ``close`` appends the seek table."""

    def __init__(self, uri: str, frame_bytes: int) -> None:
        store, path = open_store(uri)
        self.uri, self.frame_bytes, self.out = uri, frame_bytes, store.open_output_stream(path, compression=None)
        self.frames: list[tuple[int, int]] = []
        self.frame, self.total = bytearray(), 0
        self.packer = zstandard.ZstdCompressor(level=3)

    def add(self, record: bytes) -> tuple[int, int]:
        """Append a record and return its frame and the offset within it."""
        if self.frame and len(self.frame) + len(record) > self.frame_bytes:
            self._flush()
        place = len(self.frames), len(self.frame)
        self.frame += record
        self.total += len(record)
        return place

    def _flush(self) -> None:
        packed = self.packer.compress(bytes(self.frame))
        self.out.write(packed)
        self.frames.append((len(packed), len(self.frame)))
        self.frame = bytearray()

    def close(self) -> None:
        if self.frame:
            self._flush()
        table = b"".join(struct.pack(ENTRY, *f) for f in self.frames) + struct.pack(FOOTER, len(self.frames), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack(HEADER, SKIPPABLE_MAGIC, len(table)) + table)
        self.out.close()


class BundleReader:
    """Random access to the frames of a bundle through its seek table."""

    def __init__(self, uri: str) -> None:
        store, path = open_store(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        foot, entry = struct.calcsize(FOOTER), struct.calcsize(ENTRY)
        count, _, magic = struct.unpack(FOOTER, self.file.read_at(foot, size - foot))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{uri} has no seek table")
        table = self.file.read_at(count * entry, size - foot - count * entry)
        self.frames, at = [], 0
        for packed, plain in struct.iter_unpack(ENTRY, table):
            self.frames.append((at, packed, plain))
            at += packed
        self.unpacker = zstandard.ZstdDecompressor()

    def frame(self, number: int) -> bytes:
        at, packed, plain = self.frames[number]
        return self.unpacker.decompress(self.file.read_at(packed, at), max_output_size=max(plain, 1))

    def close(self) -> None:
        self.file.close()


def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``page_id, url, html, refers_to``: the page that holds the payload, else null.

    Only digests and ids are grouped; a payload of any frequency is one row after the
    partial aggregation. The pages meet their decision by id and digest.
    """
    digest = F.sha2(F.coalesce("html", F.lit("")), 256)
    long_ones = pages.where(F.octet_length("html") >= min_bytes).select("page_id", digest.alias("_sha"))
    held = long_ones.groupBy("_sha").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("_n"))
    revisits = (
        long_ones.join(held.where("_n > 1 and refers_to is not null"), "_sha")
        .where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
        .select("page_id", "_sha", "refers_to")
        .distinct()
    )
    p, r = pages.select("page_id", "url", "html", digest.alias("_sha")).alias("p"), revisits.alias("r")
    same = F.col("p.page_id").eqNullSafe(F.col("r.page_id")) & (F.col("p._sha") == F.col("r._sha"))
    return p.join(r, same, "left").select("p.page_id", "p.url", "p.html", "r.refers_to")


def write_archives(
    pages: DataFrame, folder: str, min_bytes: int = MIN_REVISIT_BYTES,
    frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES,
) -> DataFrame:
    """Write ``pages`` (``page_id, url, html``) to bundles in ``folder`` and return the index.

    Every attempt of a task writes files with names of its own, and the index stores
    those of the attempts that count; a lost executor leaves at most files that no
    index row names.
    """
    store, path = open_store(folder)
    store.create_dir(path, recursive=True)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer, rows = TaskContext.get().partitionId(), None, []
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "refers_to")]
            for i in range(batch.num_rows):
                page, url, html, refers = (c[i].as_py() for c in columns)
                if writer is None or writer.total >= bundle_bytes:
                    if writer is not None:
                        writer.close()
                    writer = BundleWriter(f"{folder}/{part:06d}-{uuid.uuid4().hex}.warc.zst", frame_bytes)
                record = warc_record(page, url, html, refers)
                rows.append((record_id(page), writer.uri, *writer.add(record), len(record)))
            yield _index_batch(rows)
            rows = []
        if writer is not None:
            writer.close()

    return stored(with_revisits(pages, min_bytes).mapInArrow(write, INDEX), "warc-index")


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    names = ["record_id", "bundle", "frame", "offset", "length"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


RECORD = (
    "record_id string, page_id long, url string, record_type string, refers_to long, "
    "payload_bytes long, payload_digest string"
)


def _page(urn: str | None) -> int | None:
    value = (urn or "").strip("<>").removeprefix("urn:page:")
    return None if value in ("", "null") else int(value)


def _described(fields: dict[str, str], block: bytes) -> tuple:
    """The output row of a record; a stored payload is measured and must match its header."""
    size, digest = int(fields["WARC-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
    payload = block[block.index(b"\r\n\r\n") + 4 :]
    if fields["WARC-Type"] == "response" and (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest):
        raise ValueError(f"damaged payload in {fields['WARC-Record-ID']}")
    record = fields["WARC-Record-ID"].strip("<>")
    return (
        record, _page(record), fields.get("WARC-Target-URI"), fields["WARC-Type"],
        _page(fields.get("WARC-Refers-To")), size, digest,
    )


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    names = [f.split()[0] for f in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def read_archives(index: DataFrame) -> DataFrame:
    """Every record of the bundles that ``index`` names, read frame by frame."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("bundle").to_pylist():
                reader = BundleReader(uri)
                for number in range(len(reader.frames)):
                    yield _record_batch([_described(f, b) for _, _, f, b in parse_records(reader.frame(number))])
                reader.close()

    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return index.select("bundle").distinct().repartition(tasks, "bundle").mapInArrow(read, RECORD)


def fetch_records(wanted: DataFrame) -> DataFrame:
    """``record_id, record binary`` of index rows: one frame is read for each record,
    or for several in a row of the same frame."""

    def fetch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, reader, number, plain = None, None, None, b""
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["bundle"] != uri:
                    if reader is not None:
                        reader.close()
                    uri, reader, number = row["bundle"], BundleReader(row["bundle"]), None
                if row["frame"] != number:
                    number, plain = row["frame"], reader.frame(row["frame"])
                out.append((row["record_id"], plain[row["offset"] : row["offset"] + row["length"]]))
            ids, records = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(records, pa.binary())], names=["record_id", "record"])
        if reader is not None:
            reader.close()

    ordered = wanted.repartition("bundle").sortWithinPartitions("bundle", "frame", "offset")
    return ordered.mapInArrow(fetch, "record_id string, record binary")


def archive_pages(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write all pages to a new folder of the shared store and read the archives back.

    Returns ``page_id, payload_bytes, payload_digest, record_type, refers_to, url`` for
    every row. Of payloads equal and of ``min_bytes`` or more, the largest ``page_id``
    keeps the response (all rows that carry that id do); a group in which no row has an
    id is kept whole. A null page is an empty payload, a null URL leaves its field out,
    an empty table gives no bundle and an empty result. Other columns are not read.
    """
    index = write_archives(pages, scratch_path(pages.sparkSession, "warc"), min_bytes)
    return read_archives(index).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"
    )
