"""Web archive records in seekable Zstandard bundles.

A bundle is a run of independent frames, each holding whole records of about a frame's
size, and at its end a skippable frame with the sizes of all others (the seekable
format's seek table). A record is found by its frame and the offset in the frame's
contents: one ranged read and one small decompression. Every Zstandard reader reads a
bundle as the plain archive.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.sources.shared import arrow_folder, qualified

SKIPPABLE, FOOTER = 0x184D2A5E, 0x8F92EAB1
#: One fixed capture date, as pages carry none.
DATE = "2024-01-01T00:00:00Z"
SCHEMA = "bundle_id string, n_records long, n_frames long, data binary, records array<struct<page_id:{},record_id:string,frame:int,frame_start:long,frame_bytes:long,offset:long,bytes:long>>"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def record(page_id: int | None, url: str | None, html: str | None) -> tuple[str, bytes]:
    """Identifier and bytes of one record; the identifier follows from the contents."""
    body = (html or "").encode("utf-8", "surrogatepass")
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    digest = xxhash.xxh3_128_hexdigest(body)
    name = f"urn:uuid:{uuid.uuid5(_SPACE, f'{page_id} {target} {digest}')}"
    head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <{name}>\r\nWARC-Date: {DATE}\r\n"
    if target:
        head += f"WARC-Target-URI: {target}\r\n"
    head += f"WARC-Block-Digest: xxh3:{digest}\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n"
    return name, head.encode() + body + b"\r\n\r\n"


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The skippable frame that lists (compressed, decompressed) sizes."""
    body = b"".join(struct.pack("<II", c, d) for c, d in sizes) + struct.pack("<IBI", len(sizes), 0, FOOTER)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed, decompressed) of each frame, from the end of a bundle."""
    n, flags, magic = struct.unpack("<IBI", data[-9:])
    if magic != FOOTER:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    at, out = len(data) - 9 - n * width, []
    start = 0
    for i in range(n):
        c, d = struct.unpack_from("<II", data, at + i * width)
        out.append((start, c, d))
        start += c
    return out


def read_record(data: bytes, frame: int, offset: int, size: int) -> bytes:
    """One record of a whole bundle, decompressing its frame alone."""
    start, c, d = read_seek_table(data)[frame]
    return _unpack(data[start : start + c], d)[offset : offset + size]


def _unpack(frame: bytes, size: int = 0) -> bytes:
    return zstandard.ZstdDecompressor().decompress(frame, max_output_size=size)


def fetch(wanted: DataFrame, folder: str) -> DataFrame:
    """(record_id, record) of rows of the record index: a ranged read of one frame each.

    ``wanted`` has the index's columns bundle_id, record_id, frame_start, frame_bytes,
    offset and bytes. Rows are sorted by frame within their partition, so that one read
    answers all its records of a frame. A null in any of these columns gives a null
    record; repeated rows are answered each; other columns are not read; no rows give
    none. A bundle that isn't there is an error.
    """
    folder = qualified(wanted.sparkSession, folder)
    columns = ["bundle_id", "record_id", "frame_start", "frame_bytes", "offset", "bytes"]

    def work(batches) -> Iterator[pa.RecordBatch]:
        where, root = arrow_folder(folder)
        at, text = None, b""
        for batch in batches:
            out = []
            for bundle_id, _, start, size, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if None in (bundle_id, start, size, offset, length):
                    out.append(None)
                    continue
                if (bundle_id, start) != at:
                    with where.open_input_file(f"{root}/{bundle_id}.warc.zst") as f:
                        f.seek(start)
                        at, text = (bundle_id, start), _unpack(f.read(size))
                out.append(text[offset : offset + length])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.binary())], ["record_id", "record"])

    return wanted.select(*columns).sortWithinPartitions("bundle_id", "frame_start").mapInArrow(work, "record_id string, record binary")


def records(bundles: DataFrame) -> DataFrame:
    """(bundle_id, record_id, url, html): all records of bundles (columns bundle_id and data).

    Frames are decompressed one at a time. A null bundle has no records; an empty target
    line gives a null url; repeated rows give their records again.
    """

    def work(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1)):
                data = data.as_py() or b""
                for start, c, d in read_seek_table(data) if data else []:
                    text, at, rows = _unpack(data[start : start + c], d), 0, []
                    while at < len(text):
                        head, body = parse(text[at:])
                        at = text.index(b"\r\n\r\n", at) + 4 + len(body) + 4
                        rows.append((name.as_py(), head["WARC-Record-ID"][1:-1], head.get("WARC-Target-URI"), body.decode("utf-8", "replace")))
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows)], ["bundle_id", "record_id", "url", "html"])

    return bundles.select("bundle_id", "data").mapInArrow(work, "bundle_id string, record_id string, url string, html string")


def parse(rec: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of a record."""
    head, _, rest = rec.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    h = dict(x.split(": ", 1) for x in lines[1:])
    return h, rest[: int(h["Content-Length"])]


class _Bundle:
    def __init__(self, level: int):
        self.z = zstandard.ZstdCompressor(level=level)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.index: list[dict] = []
        self.open: list[bytes] = []
        self.filled = self.bytes = 0

    def add(self, page_id, url, html, frame_bytes: int) -> None:
        name, rec = record(page_id, url, html)
        if self.open and self.filled + len(rec) > frame_bytes:
            self.close_frame()
        self.index.append({"page_id": page_id, "record_id": name, "frame": len(self.frames), "offset": self.filled, "bytes": len(rec)})
        self.open.append(rec)
        self.filled += len(rec)

    def close_frame(self) -> None:
        if self.open:
            if self.filled >= 1 << 32:
                raise ValueError("a record of 4 GiB or more has no place in a seek table")
            c = self.z.compress(b"".join(self.open))
            self.frames.append(c)
            self.sizes.append((len(c), self.filled))
            self.bytes += len(c)
            self.open, self.filled = [], 0

    def row(self) -> dict:
        self.close_frame()
        data = b"".join(self.frames) + seek_table(self.sizes)
        starts = np.concatenate([[0], np.cumsum([c for c, _ in self.sizes])]).tolist()
        for r in self.index:
            r["frame_start"], r["frame_bytes"] = starts[r["frame"]], self.sizes[r["frame"]][0]
        return {"bundle_id": xxhash.xxh3_128_hexdigest(data), "n_records": len(self.index), "n_frames": len(self.sizes), "data": data, "records": self.index}


def bundle(pages: DataFrame, frame_bytes: int = 256 << 10, bundle_bytes: int = 16 << 20, level: int = 3) -> DataFrame:
    """A row for each bundle: name, counts, bytes, and where each record lies.

    Input partitions are bundled where they are, without a shuffle; a bundle ends once
    it holds ``bundle_bytes``, so that a task keeps one bundle in memory. A record
    larger than a frame has a frame of its own; one of 4 GiB or more, which the seek
    table can't describe, is an error. Null ids stay null, a null url leaves
    out the target line, a null page is an empty body; repeated rows are repeated
    records with one identifier; other columns are not read; an empty table gives no
    bundles. The name of a bundle is a hash of its bytes, so a retried task gives the
    same names.
    """
    pages = pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string"))
    kind = pa.struct([("page_id", to_arrow_type(pages.schema["page_id"].dataType)), ("record_id", pa.string()), ("frame", pa.int32()), ("frame_start", pa.int64()), ("frame_bytes", pa.int64()), ("offset", pa.int64()), ("bytes", pa.int64())])
    schema = pa.schema([("bundle_id", pa.string()), ("n_records", pa.int64()), ("n_frames", pa.int64()), ("data", pa.binary()), ("records", pa.list_(kind))])

    def work(batches) -> Iterator[pa.RecordBatch]:
        b = _Bundle(level)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                for row in zip(*(c.to_pylist() for c in part.columns)):
                    b.add(*row, frame_bytes)
                    if b.bytes >= bundle_bytes:
                        yield pa.RecordBatch.from_pylist([b.row()], schema)
                        b = _Bundle(level)
        if b.index:
            yield pa.RecordBatch.from_pylist([b.row()], schema)

    return pages.mapInArrow(work, SCHEMA.format(pages.schema["page_id"].dataType.simpleString()))


def save(bundles: DataFrame, folder: str) -> DataFrame:
    """Writes each bundle as ``<bundle_id>.warc.zst`` in a shared folder; returns the record index.

    Names follow from contents, so a repeated task writes the same file again, and equal
    bundles are one file. No bundles write nothing and give an empty index.
    """
    folder = qualified(bundles.sparkSession, folder)

    def work(batches) -> Iterator[pa.RecordBatch]:
        where, root = arrow_folder(folder)
        where.create_dir(root, recursive=True)
        for batch in batches:
            for name, data in zip(batch.column("bundle_id").to_pylist(), batch.column("data").to_pylist()):
                with where.open_output_stream(f"{root}/.{name}.tmp", compression=None) as f:
                    f.write(data)
                where.move(f"{root}/.{name}.tmp", f"{root}/{name}.warc.zst")
            yield pa.RecordBatch.from_arrays([batch.column("bundle_id"), batch.column("records")], ["bundle_id", "records"])

    kept = bundles.mapInArrow(work, f"bundle_id string, records {bundles.schema['records'].dataType.simpleString()}")
    return kept.select("bundle_id", F.inline("records"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundle(spark.read.parquet(f"{sf_dir}/pages.parquet"))
