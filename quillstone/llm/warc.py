"""WARC records in seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each holding whole WARC
records, then a skippable frame with a record index (page id, frame number,
offset in the frame's content), then a seek table in the format of the public
seekable-Zstandard layout (skippable magic 0x184D2A5E, one entry of compressed
and decompressed size a frame, footer magic 0x8F92EAB1). A reader takes the
footer from the end, finds a record's frame and offset, and decompresses that
frame alone.

Bundles are rows of a Parquet table in the shared folder: Spark's committer
then handles lost executors and stores that only Spark reaches; export() lays
them out as .warc.zst files on a mounted path.

Of records with equal payloads the one with the smallest page_id is the
response, the others are revisits. Payload hashing and the choice are
DataFrame operations with a pre-aggregated minimum, so a payload that a third
of all pages share is neither gathered nor repeated. Null html: empty payload;
null page_id sorts last; of rows equal in page_id and payload the first is the
response and the rest revisit it; no rows: no bundles.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import column, stage, table

#: Content bytes after which a frame is closed, and compressed bytes after which a bundle is.
FRAME_BYTES, BUNDLE_BYTES = 256_000, 8_000_000
SKIPPABLE, INDEX_SKIPPABLE, FOOTER = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
DATE = "2024-01-01T00:00:00Z"
BUNDLE_TYPE = "bundle string, n_records long, data binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url, payload: bytes, revisit: bool, refers_to) -> bytes:
    """A WARC/1.1 record; a revisit has no payload block but names the full payload's digest and length."""
    block = b"" if revisit else payload
    clean = "".join(c for c in url or "" if c >= " ")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Bundle:
    """Frames, their sizes and the record index of one archive."""

    def __init__(self, level: int = 3):
        self.zstd, self.frames, self.sizes, self.index, self.open, self.bytes = zstandard.ZstdCompressor(level=level), [], [], [], bytearray(), 0

    def add(self, page_id, data: bytes, frame_bytes: int = FRAME_BYTES) -> None:
        self.index.append((page_id, len(self.frames), len(self.open)))
        self.open += data
        if len(self.open) >= frame_bytes:
            self._close()

    def _close(self) -> None:
        if self.open:
            frame = self.zstd.compress(bytes(self.open))
            self.frames.append(frame)
            self.sizes.append((len(frame), len(self.open)))
            self.bytes += len(frame)
            self.open = bytearray()

    def finish(self) -> bytes:
        self._close()
        index = b"".join(struct.pack("<?qIQ", p is not None, p or 0, f, o) for p, f, o in self.index)
        seek = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, FOOTER)
        return b"".join([*self.frames, struct.pack("<II", INDEX_SKIPPABLE, len(index)), index, struct.pack("<II", SKIPPABLE, len(seek)), seek])


class Reader:
    """Random access to the records of a bundle."""

    def __init__(self, data: bytes):
        n, _, magic = struct.unpack("<IBI", data[-9:])
        if magic != FOOTER:
            raise ValueError("no seek table")
        table_at = len(data) - 9 - 8 * n
        if struct.unpack("<II", data[table_at - 8 : table_at]) != (SKIPPABLE, 8 * n + 9):
            raise ValueError("broken seek table")
        self.data, self.sizes, self.at = data, list(struct.iter_unpack("<II", data[table_at : table_at + 8 * n])), [0]
        for size, _ in self.sizes:
            self.at.append(self.at[-1] + size)
        magic, size = struct.unpack("<II", data[self.at[-1] : self.at[-1] + 8])
        raw = data[self.at[-1] + 8 : self.at[-1] + 8 + size]
        self.index = [(p if known else None, f, o) for known, p, f, o in struct.iter_unpack("<?qIQ", raw)]
        self.zstd, self.cached = zstandard.ZstdDecompressor(), (-1, b"")

    def frame(self, k: int) -> bytes:
        if self.cached[0] != k:
            self.cached = (k, self.zstd.decompress(self.data[self.at[k] : self.at[k + 1]], max_output_size=self.sizes[k][1]))
        return self.cached[1]

    def at_entry(self, entry) -> tuple[dict[str, str], bytes]:
        """(headers, block) of an index entry."""
        _, k, offset = entry
        content = self.frame(k)
        end = content.index(b"\r\n\r\n", offset)
        lines = content[offset:end].decode().split("\r\n")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        size = int(headers["Content-Length"])
        return headers, content[end + 4 : end + 4 + size]

    def find(self, page_id: int) -> tuple[dict[str, str], bytes]:
        """The record of page_id; only its frame is decompressed."""
        return self.at_entry(next(e for e in self.index if e[0] == page_id))

    def frame_of(self, offset: int) -> int:
        """The frame that holds a compressed offset."""
        return bisect.bisect_right(self.at, offset) - 1


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, made, bundle = TaskContext.get().partitionId(), 0, Bundle()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{made:04d}"]), pa.array([len(bundle.index)], pa.int64()), pa.array([bundle.finish()], pa.binary())], names=["bundle", "n_records", "data"])

    for b in batches:
        cols = [b.column(k) for k in ("page_id", "url", "html", "first_id", "copy")]
        for i in range(b.num_rows):
            page, url, html, first, copy = (c[i].as_py() for c in cols)
            revisit = page != first or copy > 1
            bundle.add(page, record(page, url, (html or "").encode(), revisit, first))
            if bundle.bytes + len(bundle.open) >= BUNDLE_BYTES:
                yield out()
                made, bundle = made + 1, Bundle()
    if bundle.index:
        yield out()


def write_bundles(pages: DataFrame) -> DataFrame:
    """bundle, n_records, data: archives of pages (page_id, url, html)."""
    p = pages.select(column(pages, "page_id", "long").alias("page_id"), column(pages, "url", "string").alias("url"), F.coalesce(column(pages, "html", "string"), F.lit("")).alias("html"))
    p = p.withColumn("payload_key", F.sha1(F.encode("html", "UTF-8")))
    firsts = p.groupBy("payload_key").agg(F.min("page_id").alias("first_id"))  # min skips nulls, so they come last
    # html is shuffled once, by page; the choice is made on ids and hashes alone
    p = p.withColumns({"no_id": F.col("page_id").isNull(), "id": F.coalesce("page_id", F.lit(0))})
    by = ["no_id", "id", "payload_key"]
    choice = p.select(*by).distinct().join(firsts, "payload_key")
    copy = F.row_number().over(Window.partitionBy(*by).orderBy("url"))
    chosen = p.join(choice.hint("merge"), by).withColumn("copy", copy)
    return stage(chosen.select("page_id", "url", "html", "first_id", "copy").mapInArrow(_write, BUNDLE_TYPE), "warc")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for cell in b.column("data"):
            reader, rows = Reader(cell.as_py()), []
            for entry in reader.index:
                h, block = reader.at_entry(entry)
                kind, named = h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and (digest(block) != named or len(block) != int(h["X-Payload-Length"])):
                    raise ValueError(f"record {entry[0]} does not hold what it names")
                to = h.get("WARC-Refers-To", "").removeprefix("<urn:page:").rstrip(">")
                rows.append((entry[0], len(block) if kind == "response" else int(h["X-Payload-Length"]), named, kind, int(to) if to else None))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read_bundles(bundles: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, each read through the seek table."""
    return bundles.select("data").mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def export(bundles: DataFrame, folder: str) -> DataFrame:
    """Write each bundle as folder/NAME.warc.zst, folder being a path that all executors mount; returns name and bytes."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import uuid

        for b in batches:
            names, sizes = [], []
            for name, data in zip(b.column("bundle").to_pylist(), b.column("data").to_pylist(), strict=True):
                path = f"{folder}/{name}.warc.zst"
                with open(temp := f"{path}.{uuid.uuid4().hex}", "wb") as f:
                    f.write(data)
                os.replace(temp, path)  # a task that runs twice leaves one whole file
                names.append(path)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=["path", "bytes"])

    return bundles.mapInArrow(put, "path string, bytes long")


def op8_warc(spark, sf_dir: str) -> DataFrame:
    return read_bundles(write_bundles(table(spark, sf_dir, "pages")))


_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((x{i} >> {s}) & 31 AS INTEGER) + 1, 1)" for i in range(8) for s in (15, 10, 5, 0))
_HEX = ", ".join("CAST(" + " + ".join(f"(instr('0123456789abcdef', substr(h, {5 * i + j + 1}, 1)) - 1) * {16 ** (4 - j)}" for j in range(5)) + f" AS BIGINT) AS x{i}" for i in range(8))
OP8_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
x AS (SELECT *, {_HEX}, min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM x
"""
