"""Media columns: payloads stored as 8-bit grey PNGs in ZIP archives, read back by a custom Spark data source.

The source plans byte ranges over the archives; each reading task takes the members whose local header begins in its range
from the archive's directory, streams them in Arrow batches, and retries every member alone by its offset, with the
directory's CRC as the check. Archives are written by tasks under names that follow from the partition, through a
temporary name and a rename, so a task that runs again leaves the same file.

Cases: a null or empty text gives one row of 576 bytes 255; a null doc_id has an empty member name; repeated rows are
members of their own; an empty table gives no rows; other columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
import struct
import time
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .common import scratch_path, text_bytes

ROW = 576
SIGNATURE = b"\x89PNG\r\n\x1a\n"
RESULT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
MEMBERS = "archive string, member string, offset long, media binary, error string"


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(payload: bytes) -> bytes:
    """A PNG of 8-bit grey samples, 576 to a row."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)
    lines[:, 1:] = rows
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 4)) + chunk(b"IEND", b"")


def decode(media: bytes) -> bytes:
    """The samples of a PNG that `encode` wrote; ValueError where the bytes are damaged."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, shape, data = 8, None, []
    while at < len(media):
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError(f"damaged chunk {kind!r}")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if shape is None or shape[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not 8-bit grey")
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[1], shape[0] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, variance and a 16-bin histogram of the samples, in whole numbers or rounded text."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    level, n = np.arange(256), len(payload)
    mean = int(counts @ level) / n
    return f"mean={mean:.4f};var={int(counts @ (level * level)) / n - mean * mean:.3f};hist=" + ",".join(map(str, counts.reshape(16, 16).sum(1).tolist()))


def open_fs(uri: str):
    """pyarrow's file system for a URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


def write_archives(payloads: DataFrame, path: str) -> int:
    """payloads (name, payload): one ZIP archive of stored PNG members for each partition; gives the number of members."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        fs, root = open_fs(path)
        final = f"{root}/part-{TaskContext.get().partitionId():06d}.zip"
        part, directory, at, n = f"{final}.{uuid.uuid4().hex}", [], 0, 0
        out = None
        for b in batches:
            for name, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(part)
                payload += b"\xff" * (-len(payload) % ROW or ROW * (not payload))
                media, label = encode(payload), (name or "").encode()
                common = struct.pack("<HHHHHIIIHH", 20, 0x800, 0, 0, 33, zlib.crc32(media), len(media), len(media), len(label), 0)
                out.write(b"PK\x03\x04" + common + label + media)
                # ZIP64 extra field: the offset may pass 4 GB.
                extra = struct.pack("<HHQ", 1, 8, at)
                directory.append(b"PK\x01\x02" + struct.pack("<H", 45) + common[:-2] + struct.pack("<HHHHII", len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + label + extra)
                at += 30 + len(label) + len(media)
                n += 1
        if out is not None:
            table = b"".join(directory)
            out.write(table)
            out.write(b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, len(table), at))
            out.write(b"PK\x06\x07" + struct.pack("<IQI", 0, at + len(table), 1))
            out.write(b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))
            out.close()
            fs.move(part, final)
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return payloads.mapInArrow(work, "n long").agg(F.sum("n")).first()[0] or 0


def directory_entries(handle, size: int) -> Iterator[tuple[str, int, int, int]]:
    """(name, offset, media bytes, crc) of each member, in order of offset."""
    handle.seek(size - 98)
    tail = handle.read(98)
    if tail[:4] != b"PK\x06\x06":
        raise ValueError("no archive directory")
    length, begin = struct.unpack_from("<QQ", tail, 40)
    handle.seek(begin)
    table, at = handle.read(length), 0
    while at < length:
        crc, stored, _, name, extra = struct.unpack_from("<IIIHH", table, at + 16)
        (offset,) = struct.unpack_from("<Q", table, at + 46 + name + 4)
        yield table[at + 46 : at + 46 + name].decode(), offset, stored, crc
        at += 46 + name + extra


class Range(InputPartition):
    def __init__(self, archive: str, begin: int, end: int, size: int):
        self.archive, self.begin, self.end, self.size = archive, begin, end, size


class ArchiveReader(DataSourceReader):
    """Options: path (URI of the folder), range_bytes, batch_bytes, attempts, on_error ('fail' or 'row')."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.range_bytes, self.batch_bytes = int(options.get("range_bytes", 16 << 20)), int(options.get("batch_bytes", 4 << 20))
        self.attempts, self.on_error = int(options.get("attempts", 3)), options.get("on_error", "fail")

    def partitions(self) -> list[Range]:
        from pyarrow import fs as pafs

        fs, root = open_fs(self.path)
        found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        return [Range(f.path, b, b + self.range_bytes, f.size) for f in sorted(found, key=lambda f: f.path) if f.path.endswith(".zip") for b in range(0, f.size, self.range_bytes)]

    def member(self, fs, handle, archive: str, offset: int, stored: int, crc: int):
        """The stored bytes of one member, read again by its offset until they match the directory."""
        for k in range(self.attempts):
            try:
                if k:
                    time.sleep(0.05 * 2**k)
                    handle = fs.open_input_file(archive)
                handle.seek(offset)
                head = handle.read(30)
                name, extra = struct.unpack_from("<HH", head, 26)
                handle.seek(offset + 30 + name + extra)
                media = handle.read(stored)
                if head[:4] != b"PK\x03\x04" or len(media) != stored or zlib.crc32(media) != crc:
                    raise ValueError(f"damaged member at {offset}")
                return media, None, handle
            except (OSError, ValueError, struct.error) as e:
                error = f"{type(e).__name__}: {e}"
        return None, error, handle

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no archive at all
            return
        fs, _ = open_fs(self.path)
        handle, rows, held = fs.open_input_file(partition.archive), [], 0
        schema = pa.schema([("archive", pa.string()), ("member", pa.string()), ("offset", pa.int64()), ("media", pa.binary()), ("error", pa.string())])
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
        for name, offset, stored, crc in directory_entries(handle, partition.size):
            if not partition.begin <= offset < partition.end:
                continue
            media, error, handle = self.member(fs, handle, partition.archive, offset, stored, crc)
            if error and self.on_error == "fail":
                raise OSError(f"{partition.archive}, {name}: {error}")
            rows.append((partition.archive, name, offset, media, error))
            held += stored
            if held >= self.batch_bytes:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, path: str, **options) -> DataFrame:
    """Rows (archive, member, offset, media, error) of the archives below a folder."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archive").options(path=path, **options).load()


def describe(members: DataFrame) -> DataFrame:
    """The query's rows, from what was read back."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, media in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                payload = decode(media)
                rows.append((int(name) if name else None, len(payload.rstrip(b"\xff")), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=schema)

    names = [x.split()[0] for x in RESULT.split(", ")]
    schema = pa.schema(list(zip(names, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))))
    return members.select("member", "media").mapInArrow(work, RESULT)


def media_report(docs: DataFrame) -> DataFrame:
    """Stores every text's payload, reads it back and describes it."""
    spark = docs.sparkSession
    path = scratch_path(spark, "media")
    write_archives(docs.select(F.col("doc_id").cast("string").alias("name"), text_bytes().alias("payload")), path)
    return describe(read_archives(spark, path))
