"""WARC archives as seekable Zstandard bundles.

A bundle is a row of independent frames, each a group of whole records, and a seek table of the frames' sizes in a
skippable frame at its end. The index maps a record to its bundle, frame and offset inside the frame, so one
record is read by one seek and one frame."""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import common as c
from fleetlens.session import checkpoint_dir

FRAME_BYTES = 512 << 10
BUNDLE_BYTES = 64 << 20
LEAST_PAYLOAD = 100
# Fixed values of the seekable format: skippable frame, seek table footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = pa.schema([("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int32()), ("size", pa.int32())])
_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder as Spark names it."""
    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


def record(page_id, url, payload: bytes, size: int, digest: str, refers_to, kind: str) -> bytes:
    """One WARC record. A revisit has the HTTP headers only; their Content-Length is the payload's."""
    name = lambda i: f"<urn:page:{'null' if i is None else i}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z",
        "WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url or ""), f"WARC-Payload-Digest: sha256:{digest}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"] if kind == "revisit" else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def records(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """(headers, payload) of each record in a frame's bytes; the payload is None for a revisit."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")[1:]
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
        size = int(head["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        http, _, payload = block.partition(b"\r\n\r\n")
        head["http-length"] = int(http.rpartition(b": ")[2])
        yield head, payload if head["WARC-Type"] == "response" else None
        at = end + 4 + size + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(source) -> list[tuple[int, int, int]]:
    """(place, compressed size, size) of each frame of an open bundle, from its footer."""
    end = source.size()
    source.seek(end - 9)
    n, _, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    source.seek(end - 9 - 8 * n)
    sizes = struct.iter_unpack("<II", source.read(8 * n))
    out, at = [], 0
    for compressed, size in sizes:
        out.append((at, compressed, size))
        at += compressed
    return out


class _Bundle:
    """Writes one bundle; rows of its index collect meanwhile."""

    def __init__(self, folder: str, frame_bytes: int):
        self.frame_bytes = frame_bytes
        self.name = f"{folder}/bundle-{uuid.uuid4().hex}.warc.zst"
        store, path = _store(self.name)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = store.open_output_stream(path, compression=None)
        self.frames, self.index, self.buffer, self.held, self.bytes = [], [], [], 0, 0
        self.zstd = zstandard.ZstdCompressor(level=3, write_content_size=True)

    def add(self, page_id, data: bytes) -> None:
        self.index.append((page_id, self.name, len(self.frames), self.held, len(data)))
        self.buffer.append(data)
        self.held += len(data)
        if self.held >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if self.buffer:
            frame = self.zstd.compress(b"".join(self.buffer))
            self.out.write(frame)
            self.frames.append((len(frame), self.held))
            self.bytes += len(frame)
            self.buffer, self.held = [], 0

    def close(self) -> pa.RecordBatch:
        self.flush()
        self.out.write(seek_table(self.frames))
        self.out.close()
        return c.rows(_INDEX, *zip(*self.index))


def _write(folder: str, frame_bytes: int, bundle_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for batch in batches:
            for i in range(batch.num_rows):
                r = [batch.column(k)[i] for k in range(6)]
                page_id, url, _, digest, size, first = [None if k == 2 else r[k].as_py() for k in range(6)]
                payload = r[2].as_buffer().to_pybytes()
                kind = "response" if first is None or first == page_id else "revisit"
                bundle = bundle or _Bundle(folder, frame_bytes)
                bundle.add(page_id, record(page_id, url, payload, size, digest, first, kind))
                if bundle.bytes >= bundle_bytes:
                    yield bundle.close()
                    bundle = None
        if bundle:
            yield bundle.close()

    return run


def with_first(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, size and first: for payloads of at least LEAST_PAYLOAD bytes that several
    rows have, the smallest page_id of them, else null."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("size"))
    several = rows.where(F.col("size") >= LEAST_PAYLOAD).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1")
    return rows.join(several.select("digest", "first"), "digest", "left").select("page_id", "url", "payload", "digest", "size", "first")


def write(pages: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write the archives of all pages to bundles in `folder` and return the index, which is stored beside them.

    Of equal payloads the smallest page_id is a response and the others revisit it; below LEAST_PAYLOAD bytes
    all are responses. Null html: an empty payload; null page_id: named null, and never the smallest. Rows that
    repeat the smallest page_id are responses too. The index names the bundles that count: what a lost task
    left behind is in none of its rows."""
    c.bounded_batches(pages.sparkSession)
    index = with_first(pages).mapInArrow(_write(folder, frame_bytes, bundle_bytes), "page_id long, bundle string, frame int, offset int, size int")
    index.write.parquet(f"{folder}/index")
    return pages.sparkSession.read.parquet(f"{folder}/index")


def _page(name: str):
    return None if name == "<urn:page:null>" else int(name[10:-1])


def _read(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = zstandard.ZstdDecompressor()
        for batch in batches:
            for name in batch.column("bundle").to_pylist():
                store, path = _store(name)
                with store.open_input_file(path) as source:
                    for at, compressed, size in read_seek_table(source):
                        source.seek(at)
                        out = []
                        for head, payload in records(zstd.decompress(source.read(compressed), max_output_size=size)):
                            digest = hashlib.sha256(payload).hexdigest() if payload is not None else head["WARC-Payload-Digest"].removeprefix("sha256:")
                            n = len(payload) if payload is not None else head["http-length"]
                            refers = _page(head["WARC-Refers-To"]) if payload is None else None
                            out.append((_page(head["WARC-Record-ID"]), head["WARC-Target-URI"], n, digest, head["WARC-Type"], refers, payload if with_payload else None))
                        yield c.rows(_READ, *zip(*out))

    return run


def read(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record of the bundles in the index; digests and sizes of responses are taken from what is stored."""
    # A requested number of partitions, by the count of bundles: adaptive execution would merge a shuffle of
    # short names into one task.
    bundles = index.select("bundle").distinct()
    bundles = bundles.repartition(max(1, bundles.count()))
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    return bundles.mapInArrow(_read(with_payload), schema)


def fetch(bundle: str, frame: int, offset: int, size: int) -> tuple[dict, bytes]:
    """One record, by its row of the index."""
    store, path = _store(bundle)
    with store.open_input_file(path) as source:
        at, compressed, whole = read_seek_table(source)[frame]
        source.seek(at)
        data = zstandard.ZstdDecompressor().decompress(source.read(compressed), max_output_size=whole)
    return next(records(data[offset : offset + size]))


def new_folder(spark: SparkSession) -> str:
    """A folder of its own in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
