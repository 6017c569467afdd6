"""WARC archives as seekable Zstandard bundles.

A task writes its records to bundles of about BUNDLE bytes. A bundle is a run of independent Zstandard frames, each
holding records of about FRAME bytes, and ends in a skippable frame with the seek table of the seekable format: the
compressed and decompressed size of every frame. The index maps a record's id to its bundle, frame and offset within
the decompressed frame; a reader fetches the footer, then only the frames it needs.

Of records with equal payloads (by digest and length) the one of least id is a `response`, the others are `revisit`
records that refer to it and hold no payload; their HTTP header still has its length.

Bundles are written under a name of the attempt's own and renamed, and their final name follows from the contents of
the task, so that a task that is run again replaces its bundle by an equal one. Paths go through Arrow's filesystems:
the folder can be local, mounted, or in a store.

Rows are told apart by their place in the scan, so the input has to give the same rows when it is read again, as tables do.

Defined cases: a null payload is empty; a null url is written as `urn:page:<id>`; rows with a null id get records
without an id that are returned with null, and are responses only if no row with an id has their payload; of several
rows that share the least id and the payload, one is the response and the others revisit it; an empty table makes no
bundle and no rows; extra columns are never read.
"""

from __future__ import annotations

import base64
import contextlib
import functools
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .core import cut, shared_folder

FRAME, BUNDLE, SALTS = 1 << 18, 1 << 27, 8
#: Fixed values of the seekable format: the skippable frame's magic number and the footer's.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "2024-01-01T00:00:00Z"


def record_urn(key: int | None) -> str:
    return f"<urn:page:{'unknown' if key is None else key}>"


def record(key: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, again: bool | None = None) -> bytes:
    """A response, or a revisit of the page refers_to (again: also if that is unknown)."""
    again = refers_to is not None if again is None else again
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if again else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if again else 'response'}",
        f"WARC-Record-ID: {record_urn(key)}",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + ("".join(url.split()) if url and url.split() else f"urn:page:{key}"),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"Content-Type: application/http;msgtype=response\r\nContent-Length: {len(block)}",
    ]
    if again:
        head.insert(5, f"WARC-Refers-To: {record_urn(refers_to)}\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of each record in data."""
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        size = int(headers["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) < size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"broken WARC record at {at}")
        yield at, headers, block
        at = end + 8 + size


class Bundle:
    """Collects records into frames; `close` appends the seek table."""

    def __init__(self, frame: int = FRAME) -> None:
        self.frame, self.parts, self.table, self.open, self.size, self.at = frame, [], [], [], 0, 0
        self.zstd = zstandard.ZstdCompressor(level=3)

    def add(self, data: bytes) -> tuple[int, int, int]:
        """The record's frame, offset within it, and length."""
        if self.size and self.size + len(data) > self.frame:
            self._end()
        place = (len(self.table), self.size, len(data))
        self.open.append(data)
        self.size += len(data)
        return place

    def _end(self) -> None:
        packed = self.zstd.compress(b"".join(self.open))
        self.parts.append(packed)
        self.table.append((len(packed), self.size))
        self.at += len(packed)
        self.open, self.size = [], 0

    def close(self) -> bytes:
        if self.size:
            self._end()
        body = b"".join(struct.pack("<II", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        return b"".join(self.parts) + struct.pack("<II", SKIPPABLE, len(body)) + body


def seek_table(file: pa.NativeFile) -> list[tuple[int, int, int]]:
    """(offset, compressed, decompressed) of each frame of an open bundle, from its footer."""
    size = file.size()
    file.seek(size - 9)
    frames, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    entry = 12 if flags & 0x80 else 8
    file.seek(size - 9 - frames * entry)
    raw, out, at = file.read(frames * entry), [], 0
    for i in range(frames):
        packed, plain = struct.unpack_from("<II", raw, i * entry)
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(file: pa.NativeFile, entry: tuple[int, int, int]) -> bytes:
    file.seek(entry[0])
    return zstandard.ZstdDecompressor().decompress(file.read(entry[1]), max_output_size=entry[2])


def read_record(path: str, frame: int, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record, by what the index has of it."""
    system, name = fs.FileSystem.from_uri(path)
    with system.open_input_file(name) as f:
        data = read_frame(f, seek_table(f)[frame])[offset : offset + length]
    _, headers, block = next(parse(data))
    return headers, block


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """The index rows (_id, bundle, frame, offset, length) of the records (_id, url, payload, digest, refers_to, again) written."""
    system, base = fs.FileSystem.from_uri(folder)
    bundle, rows, name = Bundle(), [], hashlib.sha1()

    def close() -> Iterator[pa.RecordBatch]:
        nonlocal bundle, rows, name
        if not rows:
            return
        data = bundle.close()
        final = f"{hashlib.sha1(data).hexdigest()}-{name.hexdigest()[:8]}.warc.zst"
        temp = f"{base}/.{final}.{uuid.uuid4().hex}"
        with system.open_output_stream(temp) as f:
            f.write(data)
        system.move(temp, f"{base}/{final}")
        ids, at = zip(*rows, strict=True)
        frame, offset, length = zip(*at, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([f"{folder}/{final}"] * len(ids)), *[pa.array(x, pa.int64()) for x in (frame, offset, length)]], ["_id", "bundle", "frame", "offset", "length"])
        bundle, rows, name = Bundle(), [], hashlib.sha1()

    for b in batches:
        for i in range(b.num_rows):
            key, url, payload, digest, refers, again = (b.column(k)[i].as_py() for k in range(6))
            name.update(f"{key}|{digest}\n".encode())
            rows.append((key, bundle.add(record(key, url, (payload or "").encode(), base64.b32encode(bytes.fromhex(digest)).decode(), refers, again))))
            if bundle.at >= BUNDLE:
                yield from close()
    yield from close()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_id, payload_bytes, payload_digest, record_type, refers_to) of the records at rows (_id, bundle, frame, offset, length) sorted by place; responses' payloads are held against their digests. One bundle and one frame are open at a time."""
    urn = lambda x: None if x.endswith(":unknown>") else int(x[len("<urn:page:") : -1])
    with contextlib.ExitStack() as stack:
        path, at, table, data = None, None, [], b""
        for b in batches:
            out = []
            for key, bundle, frame, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bundle != path:
                    stack.close()
                    system, name = fs.FileSystem.from_uri(bundle)
                    file = stack.enter_context(system.open_input_file(name))
                    path, at, table = bundle, None, seek_table(file)
                if frame != at:
                    at, data = frame, read_frame(file, table[frame])
                _, head, block = next(parse(data[offset : offset + length]))
                http, _, payload = block.partition(b"\r\n\r\n")
                digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                size = int(http.rpartition(b"Content-Length: ")[2])
                if urn(head["WARC-Record-ID"]) != key:
                    raise ValueError(f"{path}: the record of {key} is not where the index has it")
                if head["WARC-Type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                    raise ValueError(f"{path}: payload of {head['WARC-Record-ID']} is not what was written")
                refers = head.get("WARC-Refers-To")
                out.append((key, size, digest, head["WARC-Type"], refers and urn(refers)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes a record per row to bundles in the folder (a URI or path); returns the index, already computed.

    What revisits what is found from narrow rows (place, id, digest); a digest that many rows share is dealt to SALTS
    tasks. The outcome comes back to the payloads by a join on the row's place, which shuffles them once and evenly.
    """
    system, base = fs.FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)
    text = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).alias("url"), F.col(payload_col).alias("payload"), F.sha1(text.cast("binary")).alias("digest"), F.octet_length(text).alias("size"), F.monotonically_increasing_id().alias("_t"))
    narrow = rows.select("_id", "digest", "size", "_t", F.pmod("_t", F.lit(SALTS)).alias("_salt")).where(F.col("size") >= least_bytes)
    first = narrow.groupBy("digest", "size").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_t")).alias("f"), F.count("*").alias("n")).where("n > 1")
    first = first.select("digest", "size", F.col("f._id").alias("refers_to"), F.col("f._t").alias("_first"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("_salt"))
    keyed = narrow.join(first, ["digest", "size", "_salt"]).where("_t <> _first").select(F.col("_t").alias("_k"), "refers_to")
    full = rows.join(keyed.hint("shuffle_hash"), F.col("_t") == F.col("_k"), "left")
    out = full.select("_id", "url", "payload", "digest", "refers_to", F.col("_k").isNotNull().alias("again"))
    return cut(out.mapInArrow(functools.partial(_write, folder=folder), "_id long, bundle string, frame long, offset long, length long"))


def read(index: DataFrame) -> DataFrame:
    """The records that an index names, a row each, read by their places: the footer, then the frames that hold them."""
    places = index.select("_id", "bundle", "frame", "offset", "length").repartition("bundle").sortWithinPartitions("bundle", "frame", "offset")
    return places.mapInArrow(_read, "_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_folder(spark: SparkSession) -> str:
    base = shared_folder(spark)
    return f"{base if '://' in base or base.startswith('file:') else 'file://' + base}/warc-{uuid.uuid4().hex}"


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), archive_folder(spark))
    return read(index).withColumnRenamed("_id", "page_id")


SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), b AS (
  SELECT *, array_to_string(list_transform(string_split(hex, ''),
    lambda x: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][instr('0123456789abcdef', x)]), '') AS bits,
    min(page_id) OVER (PARTITION BY hex, payload_bytes) AS first, row_number() OVER (PARTITION BY hex, payload_bytes ORDER BY page_id NULLS LAST) AS n FROM p
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + 16 * CAST(substr(bits, i * 5 + 1, 1) AS INT) + 8 * CAST(substr(bits, i * 5 + 2, 1) AS INT) + 4 * CAST(substr(bits, i * 5 + 3, 1) AS INT)
      + 2 * CAST(substr(bits, i * 5 + 4, 1) AS INT) + CAST(substr(bits, i * 5 + 5, 1) AS INT) AS INT), 1)), '') AS payload_digest,
  CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN n > 1 THEN first END AS refers_to
FROM b
"""
