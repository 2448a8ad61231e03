"""WARC bundles as seekable Zstandard: independent frames, a footer seek table, and an index of records.

A bundle is a byte string: Zstandard frames, each with some whole WARC records, and last the seek
table of Zstandard's seekable format, a skippable frame with compressed and decompressed size of
every frame. Any zstd reader reads a bundle from the start; with the seek table and an index entry
(bundle, frame, offset in the frame, length) a single record takes the decompression of one frame.

Bundles live as rows of a Parquet table in the shared folder, since only Spark's writers reach
every store and commit a task's output once, however often the task runs; export() writes them as
files. Bundles and frames have bounded sizes, but a single record may be longer.

Record identifiers carry the page id and the row's number in its scan, so that repeated rows differ and
a revisit knows the identifier that it refers to. Reading goes through index and seek table.

Equal payloads: `response` is the record of the smallest page id, others are `revisit` records that
refer to it. Equality is that of the SHA-256 digest. Groups are reduced before they are shuffled
(min with map-side combine), and the way back is a plain join, whose skew AQE splits.

Defined cases: a null payload is empty; a null url leaves out its header; null page ids give a
record without a page id, a response that nobody refers to; a page id that occurs twice gives a
record each, of the same kind if their payloads are equal; payloads shorter than `least` bytes are
always responses.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
from collections.abc import Iterator
from itertools import groupby
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import table, written
from ._text import column

FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 32 << 20
LEVEL = 3
# Fixed values of the seekable format and of skippable frames.
SEEKABLE_MAGIC, SKIPPABLE_MAGIC = 0x8F92EAB1, 0x184D2A5E
DATE = "1970-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, row: int) -> str:
    """The identifier of one record: `row` is different for every row of the table, also for repeated ones."""
    return f"<urn:page:{'' if page_id is None else page_id}:{row}>"


def record(kind: str, ident: str, url: str | None, payload: bytes, extra: list[tuple[str, str]]) -> bytes:
    """A WARC/1.1 record; the block of a response is an HTTP message, that of a revisit its header."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if kind == "response" else head
    fields = [("WARC-Type", kind), ("WARC-Record-ID", ident), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~-._")))
    fields += [*extra, ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Header fields, block and end of the record that begins at `at`."""
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record at {at}")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    end = stop + 4 + int(fields["Content-Length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError(f"record at {at} is cut off")
    return fields, data[stop + 4 : end], end + 4


class Bundle:
    """Grows frame by frame; add() says where the record went."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        import zstandard

        self._zstd = zstandard.ZstdCompressor(level=level, write_content_size=True, write_checksum=True)
        self._frame_bytes, self._open, self._size = frame_bytes, [], 0
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.length = 0

    def add(self, data: bytes) -> tuple[int, int, int]:
        """Frame number, offset in the frame, and length of a record."""
        if self._open and self._size + len(data) > self._frame_bytes:
            self._close()
        at = (len(self.frames), self._size, len(data))
        self._open.append(data)
        self._size += len(data)
        return at

    def _close(self) -> None:
        if self._open:
            frame = self._zstd.compress(b"".join(self._open))
            self.frames.append(frame)
            self.sizes.append((len(frame), self._size))
            self.length += len(frame)
            self._open, self._size = [], 0

    def finish(self) -> bytes:
        self._close()
        table_ = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE_MAGIC, len(table_)) + table_


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """Offset, compressed and decompressed size of each frame, from the footer."""
    frames, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    entry = 12 if flags & 0x80 else 8
    at, out = len(bundle) - 9 - frames * entry, []
    offset = 0
    for k in range(frames):
        packed, plain = struct.unpack_from("<II", bundle, at + k * entry)
        out.append((offset, packed, plain))
        offset += packed
    return out


def read_frame(bundle: bytes, frame: tuple[int, int, int]) -> bytes:
    import zstandard

    offset, packed, plain = frame
    data = zstandard.ZstdDecompressor().decompress(bundle[offset : offset + packed])
    if len(data) != plain:
        raise ValueError("a frame's size differs from the seek table's")
    return data


def read_record(bundle: bytes, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """The record at an index entry, by decompression of its frame alone."""
    fields, block, _ = parse(read_frame(bundle, seek_table(bundle)[frame]), offset)
    return fields, block


_BUNDLES = "bundle_id string, bundle binary, entries array<struct<record_id:string,page_id:long,frame:int,offset:long,length:long>>"


def _bundled(batches: Iterator[pa.RecordBatch], frame_bytes: int, bundle_bytes: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("bundle_id", pa.string()), ("bundle", pa.binary()), ("entries", pa.list_(pa.struct([("record_id", pa.string()), ("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])))])

    def closed():
        data = bundle.finish()
        return pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(data).hexdigest()]), pa.array([data], pa.binary()), pa.array([entries], schema.field("entries").type)], schema=schema)

    bundle, entries = Bundle(frame_bytes), []
    for batch in batches:
        ids, rows, urls, pages, firsts, first_rows = (column(batch, c).to_pylist() for c in ("page_id", "row", "url", "html", "first", "first_row"))
        for page, row, url, html, first, first_row in zip(ids, rows, urls, pages, firsts, first_rows, strict=True):
            payload = (html or "").encode("utf-8", "surrogatepass")
            ident = record_id(page, row)
            extra = [("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("X-Payload-Length", str(len(payload)))]
            if page is not None:
                extra.append(("X-Page-ID", str(page)))
            if first is None:
                data = record("response", ident, url, payload, extra)
            else:
                extra += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(first, first_row))]
                data = record("revisit", ident, url, payload, extra)
            entries.append((ident, page, *bundle.add(data)))
            entries[-1] = dict(zip(("record_id", "page_id", "frame", "offset", "length"), entries[-1], strict=True))
            if bundle.length >= bundle_bytes:
                yield closed()
                bundle, entries = Bundle(frame_bytes), []
    if entries:
        yield closed()


def write_bundles(pages: DataFrame, ids: str = "page_id", url: str = "url", payload: str = "html", least: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """A table of bundles (bundle_id, bundle, entries) in the shared folder, one record for each row of `pages`."""
    rows = pages.select(F.col(ids).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(payload).alias("html"))
    body = F.coalesce("html", F.lit("")).cast("binary")
    # a scan numbers its rows by partition and place, so both sides of the join agree on them
    keyed = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("digest", F.sha2(body, 256))
    large = F.octet_length(body) >= least
    firsts = keyed.where(large & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min(F.struct("page_id", "row")).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    marked = keyed.join(firsts, "digest", "left")
    refers = large & (F.col("page_id") != F.col("first.page_id"))
    marked = marked.select("page_id", "row", "url", "html", *(F.when(refers, F.col(f"first.{c}")).alias(f"first{n}") for c, n in (("page_id", ""), ("row", "_row"))))
    return written(marked.mapInArrow(lambda it: _bundled(it, frame_bytes, bundle_bytes), _BUNDLES), "bundles")


def index(bundles: DataFrame) -> DataFrame:
    """record_id, page_id, bundle_id, frame, offset in the frame, and length."""
    return bundles.select("bundle_id", F.explode("entries").alias("e")).select("e.record_id", "e.page_id", "bundle_id", "e.frame", "e.offset", "e.length")


_RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary, bundle_id string, frame int, offset long"


def _read(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload", "bundle_id", "frame", "offset")
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int32(), pa.int64())
    schema = pa.schema(list(zip(names, types, strict=True)))
    page_of = lambda ident: int(ident.split(":")[2])
    for batch in batches:
        for ident, data, entries in zip(column(batch, "bundle_id").to_pylist(), column(batch, "bundle"), column(batch, "entries"), strict=True):
            bundle = data.as_py()
            frames = seek_table(bundle)
            for k, records in groupby(entries.as_py(), lambda e: e["frame"]):
                plain, out, done = read_frame(bundle, frames[k]), [], 0
                for e in records:
                    at = e["offset"]
                    fields, block, end = parse(plain, at)
                    if fields["WARC-Record-ID"] != e["record_id"] or end - at != e["length"] or at != done:
                        raise ValueError(f"the index differs from the bundle at {e['record_id']}")
                    done = end
                    body = block.split(b"\r\n\r\n", 1)[1]
                    said, length = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
                    if fields["WARC-Type"] == "response" and (digest(body) != said or len(body) != length):
                        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
                    page, refers = fields.get("X-Page-ID"), fields.get("WARC-Refers-To")
                    out.append((int(page) if page else None, length, said, fields["WARC-Type"], page_of(refers) if refers else None, fields.get("WARC-Target-URI"), body if payloads and fields["WARC-Type"] == "response" else None, ident, k, at))
                if done != len(plain):
                    raise ValueError(f"frame {k} of {ident} has records that the index lacks")
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], schema=schema)


def read_bundles(bundles: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the bundles, each at its place by index and seek table; a frame is decompressed once. Response payloads are
    checked against their digests, and the index against the records. A revisit's payload is null."""
    return bundles.select("bundle_id", "bundle", "entries").mapInArrow(lambda it: _read(it, payloads), _RECORDS)


def export(bundles: DataFrame, folder: str) -> None:
    """Writes each bundle as a file `<bundle_id>.warc.zst` to a folder that every executor mounts; files appear whole, by rename."""

    def save(batches):
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for ident, data in zip(column(batch, "bundle_id").to_pylist(), column(batch, "bundle"), strict=True):
                part = f"{folder}/.{ident}.{os.getpid()}"
                with open(part, "wb") as f:
                    f.write(data.as_py())
                os.replace(part, f"{folder}/{ident}.warc.zst")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    bundles.select("bundle_id", "bundle").mapInArrow(save, "n long").agg(F.sum("n")).collect()


def op7_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives say of every page, after all of them were written and read back."""
    bundles = write_bundles(table(spark, sf_dir, "pages"))
    return read_bundles(bundles, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(x, {5 * k + 1}, 5))::bigint >> {s} & 31)::int + 1, 1)" for k in range(8) for s in (15, 10, 5, 0))
OP7_SQL = f"""
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, octet_length(encode(h)) as payload_bytes, sha1(h) as x, min(page_id) over (partition by h) as f from p)
select page_id, payload_bytes, {_BASE32} as payload_digest, case when page_id <> f then 'revisit' else 'response' end as record_type, case when page_id <> f then f end as refers_to from d"""
