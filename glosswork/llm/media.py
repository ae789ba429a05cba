"""Media columns: content-addressed payloads in tar shards.

A text's UTF-8 bytes, padded with zero bytes to a multiple of 64, are the samples of an 8-bit grey picture 64 wide,
stored as PNG. A task appends each payload that it meets for the first time to its tar shard in shared storage,
under the payload's SHA-256, and emits (digest, shard, offset, length) for every row. Where several tasks stored the
same payload, the least (shard, offset) is its one address; the others are left for compaction. Each address is then
read back once: a range read of the header gives width, height and bit depth, a second range read gives the samples,
whose digest is checked against the address. Rows meet these columns by digest.

A shard's name is unique for each attempt at a task, and rows name only shards of attempts that ended, so a lost
executor leaves at most an unused file. Storage is reached through Arrow's file systems by the URI of the folder.

Digests that many rows share, such as that of empty texts, are dealt over several tasks when rows meet their columns.

Defined results: null text is empty text, whose payload is 64 zero bytes; equal texts and repeated rows have equal
columns, ``shard`` among them, whose names differ between runs; a very long text is one payload, held in memory alone
with its picture, and a shard larger than ``shard_bytes`` if need be; a null doc_id is kept; further columns, whatever
their names, are left out; an empty table writes no shard and gives no rows.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.llm.common import documents, shared_folder, spread_join, stored, table

WIDTH = 64
SHARD_BYTES = 32 << 20
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_HEADER = 33  # signature and IHDR chunk

_PLACES = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.string()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
_COLUMNS = pa.schema([("digest", pa.string()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("width", pa.int64()), ("height", pa.int64()), ("bit_depth", pa.int64()), ("payload_bytes", pa.int64()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def payload(text: str | None) -> tuple[int, bytes]:
    """Unpadded length, and the bytes padded to a positive multiple of the picture's width."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    size = max(WIDTH, -(-len(raw) // WIDTH) * WIDTH)
    return len(raw), raw.ljust(size, b"\0")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(samples: bytes) -> bytes:
    height = len(samples) // WIDTH
    lines = np.zeros((height, WIDTH + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(samples, np.uint8).reshape(height, WIDTH)
    return _SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int]:
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", head[16:25])


def from_png(data: bytes) -> bytes:
    width, height, _ = read_header(data[:_HEADER])
    at, packed = 8, b""
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        if kind == b"IDAT":
            packed += data[at + 8 : at + 8 + n]
        at += n + 12
    return np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def feature(samples: bytes, width: int, height: int) -> str:
    """Shape, mean, deviation and an 8-bin histogram of the samples, each as a rounded share or number."""
    x = np.frombuffer(samples, np.uint8)
    bins = np.bincount(x >> 5, minlength=8) / len(x)
    return f"{width}x{height};mean={x.mean(dtype=np.float64):.4f};std={x.std(dtype=np.float64):.4f};hist=" + "/".join(f"{b:.4f}" for b in bins)


def _fs(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def _writer(folder: str, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        known: dict[bytes, tuple[str, int, int]] = {}
        buffer, number = io.BytesIO(), 0
        tar = tarfile.open(fileobj=buffer, mode="w", format=tarfile.USTAR_FORMAT)
        name = f"{task}-{number:04d}.tar"

        def flush() -> None:
            tar.close()
            fs, path = _fs(f"{folder}/shards")
            fs.create_dir(path, recursive=True)
            with fs.open_output_stream(f"{path}/{name}") as out:
                out.write(buffer.getvalue())

        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, samples = payload(text)
                digest = hashlib.sha256(samples).digest()
                if digest not in known:
                    media = to_png(samples)
                    member = tarfile.TarInfo(digest.hex() + ".png")
                    member.size = len(media)
                    known[digest] = (name, tar.offset + tarfile.BLOCKSIZE, len(media))
                    tar.addfile(member, io.BytesIO(media))
                rows.append((doc_id, n, digest.hex(), *known[digest]))
                if buffer.tell() >= shard_bytes:
                    flush()
                    number += 1
                    buffer, name = io.BytesIO(), f"{task}-{number:04d}.tar"
                    tar = tarfile.open(fileobj=buffer, mode="w", format=tarfile.USTAR_FORMAT)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PLACES)], schema=_PLACES)
        if tar.offset:
            flush()

    return run


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _fs(f"{folder}/shards")
        open_name, source = None, None
        for batch in batches:
            out = []
            for digest, shard, offset, length in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if shard != open_name:
                    if source:
                        source.close()
                    open_name, source = shard, fs.open_input_file(f"{path}/{shard}")
                width, height, depth = read_header(source.read_at(_HEADER, offset))
                media = source.read_at(length, offset)
                samples = from_png(media)
                sha = hashlib.sha256(samples).hexdigest()
                if sha != digest:
                    raise ValueError(f"{shard} at {offset}: payload {sha} is not {digest}")
                out.append((digest, shard, offset, length, width, height, depth, len(samples), zlib.crc32(samples[-WIDTH:]), length, hashlib.sha256(media).hexdigest(), feature(samples, width, height)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _COLUMNS)], schema=_COLUMNS)
        if source:
            source.close()

    return run


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'string'}" for f in schema)


def store_media(docs: DataFrame, folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Rows of ``docs`` with the address of their payload and the columns read back from it."""
    folder = folder or shared_folder(docs.sparkSession)
    places = stored(documents(docs).mapInArrow(_writer(folder, shard_bytes), _ddl(_PLACES)), folder, "places")
    objects = places.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*")
    reads = objects.repartition("shard", F.expr("offset div 4194304")).sortWithinPartitions("shard", "offset")
    columns = stored(reads.mapInArrow(_reader(folder), _ddl(_COLUMNS)), folder, "columns")
    met = spread_join(places.select("doc_id", "n_bytes", "digest"), columns, "digest", F.monotonically_increasing_id())
    return met.withColumn("payload_sha256", F.col("digest"))  # the reader found that what it read back has it


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_media(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "digest", "shard", "offset", "length", "width", "height", "bit_depth")


NAME = "op8_media_columns"
