"""Media columns: byte payloads stored as 8-bit greyscale images inside ZIP archives, read by a custom source.

``write_archives`` packs rows into one archive per task (temporary name, then rename, so a task that is
lost and run again replaces its own file). ``ArchiveSource`` plans byte ranges over the archives: a
partition owns the members whose header starts in its range, found in the archive's own directory.
Members are read by offset, one at a time, each with its own retries, and leave as Arrow batches of
bounded bytes. ``read_media`` decodes them.

Defined results: null text counts as empty; an empty payload pads to one row of 192 samples; a very long text is one member, held
whole by the task that packs or reads it; repeated rows, and rows with the same key, are separate members; a null key has a name without a key
and comes back as null; keys may be any text; columns of other names are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from scanloom.llm.common import scratch

WIDTH = 192
PAD = b"\x20"
BATCH_BYTES = 8 << 20
PARTITION_BYTES = 64 << 20
ATTEMPTS = 4
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


# ---------------------------------------------------------------------------------- image form


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def pad(payload: bytes, multiple: int = WIDTH) -> bytes:
    """``payload`` followed by spaces up to a positive multiple."""
    size = max(1, -(-len(payload) // multiple)) * multiple
    return payload + PAD * (size - len(payload))


def encode_image(payload: bytes) -> bytes:
    """A greyscale PNG whose samples are the padded payload; the unpadded length is a text chunk."""
    samples = np.frombuffer(pad(payload), dtype=np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(samples), WIDTH + 1), dtype=np.uint8)
    lines[:, 1:] = samples
    head = struct.pack(">IIBBBBB", WIDTH, len(samples), 8, 0, 0, 0, 0)
    return b"".join((
        _SIGNATURE,
        _chunk(b"IHDR", head),
        _chunk(b"tEXt", b"n_bytes\x00" + str(len(payload)).encode()),
        _chunk(b"IDAT", zlib.compress(lines, 1)),
        _chunk(b"IEND", b""),
    ))


def decode_image(media: bytes) -> tuple[bytes, int]:
    """The samples of a stored image, row by row, and the payload's unpadded length. Checks every checksum."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not a stored image")
    at, body, width, height, n_bytes = 8, [], 0, 0, -1
    while at < len(media):
        (size,) = struct.unpack_from(">I", media, at)
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        (crc,) = struct.unpack_from(">I", media, at + 8 + size)
        if crc != zlib.crc32(kind + data):
            raise ValueError(f"checksum of chunk {kind!r}")
        if kind == b"IHDR":
            width, height, depth, colour = struct.unpack_from(">IIBB", data)
            if (depth, colour) != (8, 0):
                raise ValueError("only 8-bit greyscale is stored")
        elif kind == b"tEXt" and data.startswith(b"n_bytes\x00"):
            n_bytes = int(data[8:])
        elif kind == b"IDAT":
            body.append(data)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(body)), dtype=np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("only unfiltered scan lines are stored")
    return lines[:, 1:].tobytes(), n_bytes


def feature(samples: bytes) -> str:
    """Size, mean and spread in thousandths, and a 64-bit average hash over an 8 x 8 grid of bands."""
    x = np.frombuffer(samples, dtype=np.uint8).reshape(-1, WIDTH)
    total, squares = int(x.sum(dtype=np.int64)), int((x.astype(np.int64) ** 2).sum())
    mean = total * 1000 // x.size
    spread = squares * 1000 // x.size - mean * mean // 1000
    columns = x.reshape(len(x), 8, WIDTH // 8).sum(axis=2, dtype=np.int64)
    edges = np.arange(9) * len(x) // 8
    running = np.vstack([np.zeros((1, 8), np.int64), np.cumsum(columns, axis=0)])
    grid = running[np.maximum(edges[1:], edges[:-1] + 1).clip(max=len(x))] - running[edges[:-1]]
    rows = np.maximum(edges[1:], edges[:-1] + 1).clip(max=len(x)) - edges[:-1]
    bits = (grid * x.size >= total * (WIDTH // 8) * rows[:, None]).ravel()
    return f"{WIDTH}x{len(x)};mean={mean};var={spread};ahash={int(''.join('01'[int(b)] for b in bits), 2):016x}"


# ---------------------------------------------------------------------------------- files


def _open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI and the path inside it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def _write_archive(rows: Iterator[tuple[str, bytes]], folder: str, name: str) -> tuple[str, int]:
    fs, root = _open_fs(folder)
    fs.create_dir(root, recursive=True)
    partial, final, members = f"{root}/.{name}-{uuid.uuid4().hex}", f"{root}/{name}", 0
    with fs.open_output_stream(partial) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
        for member, media in rows:
            archive.writestr(zipfile.ZipInfo(member, (1980, 1, 1, 0, 0, 0)), media)
            members += 1
    if members:
        fs.move(partial, final)
    else:
        fs.delete_file(partial)
    return final, members


def write_archives(df: DataFrame, key: str, text: str, folder: str) -> DataFrame:
    """Pack ``df`` into archives below ``folder``; one row (archive, members) per archive. Runs lazily."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[str, bytes]]:
            n = 0
            for batch in batches:
                for k, payload in zip(batch.column(0), batch.column(1)):
                    payload = payload.as_py() or b""
                    name = "" if k.as_py() is None else f"-{quote(k.as_py(), safe='')}"
                    yield f"{n:010d}{name}.png", encode_image(payload)
                    n += 1

        name = f"part-{TaskContext.get().partitionId():06d}.zip"
        path, members = _write_archive(rows(), folder, name)
        if members:
            yield pa.RecordBatch.from_pydict({"archive": [path], "members": pa.array([members], pa.int64())})

    payloads = df.select(F.col(key).cast("string").alias("k"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("p"))
    return payloads.mapInArrow(pack, "archive string, members long")


@dataclass
class _Range(InputPartition):
    archive: str
    start: int
    end: int


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, partition_bytes: int, attempts: int) -> None:
        self.path, self.partition_bytes, self.attempts = path, partition_bytes, attempts

    def partitions(self) -> list[_Range]:
        """Byte ranges of at most ``partition_bytes``; only names and sizes of archives are looked at."""
        fs, root = _open_fs(self.path)
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        ranges = []
        for info in sorted((x for x in found if x.is_file and x.base_name.endswith(".zip") and x.base_name[0] not in "._"), key=lambda x: x.path):
            n = max(1, -(-info.size // self.partition_bytes))
            step = -(-info.size // n)
            ranges += [_Range(info.path, i * step, (i + 1) * step) for i in range(n)]
        return ranges or [_Range("", 0, 0)]

    def _member(self, fs: pafs.FileSystem, path: str, info: zipfile.ZipInfo) -> bytes:
        """One member's bytes, read by its offset; tried again on its own after a failure."""
        for attempt in range(self.attempts):
            try:
                with fs.open_input_file(path) as f:
                    f.seek(info.header_offset)
                    head = f.read(30)
                    name, extra = struct.unpack_from("<HH", head, 26)
                    f.seek(info.header_offset + 30 + name + extra)
                    body = f.read(info.compress_size)
                if info.compress_type == zipfile.ZIP_DEFLATED:
                    body = zlib.decompress(body, -15)
                if zlib.crc32(body) != info.CRC:
                    raise OSError(f"checksum of {info.filename} in {path}")
                return body
            except (OSError, struct.error, zlib.error):
                if attempt + 1 == self.attempts:
                    raise
                time.sleep(0.1 * 2**attempt)
        raise AssertionError

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        fs, _ = _open_fs(self.path)
        with fs.open_input_file(partition.archive) as f, zipfile.ZipFile(f) as archive:
            members = [x for x in archive.infolist() if partition.start <= x.header_offset < partition.end]
        names, offsets, bodies, size = [], [], [], 0
        for info in members:
            body = self._member(fs, partition.archive, info)
            names.append(info.filename)
            offsets.append(info.header_offset)
            bodies.append(body)
            size += len(body)
            if size >= BATCH_BYTES:
                yield self._batch(partition.archive, names, offsets, bodies)
                names, offsets, bodies, size = [], [], [], 0
        if names:
            yield self._batch(partition.archive, names, offsets, bodies)

    @staticmethod
    def _batch(archive: str, names: list[str], offsets: list[int], bodies: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"archive": pa.array([archive] * len(names)), "member": pa.array(names), "offset": pa.array(offsets, pa.int64()), "media": pa.array(bodies, pa.binary())})


class ArchiveSource(DataSource):
    """``spark.read.format("media_archive").load(folder)``: one row per member of the ZIP archives in a folder."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "archive string, member string, offset long, media binary"

    def reader(self, schema) -> ArchiveReader:  # noqa: ANN001
        size = int(self.options.get("partitionbytes", PARTITION_BYTES))
        return ArchiveReader(self.options["path"], size, int(self.options.get("attempts", ATTEMPTS)))


def read_archives(spark: SparkSession, folder: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archive").option("partitionBytes", str(partition_bytes)).load(folder)


def decode(media: DataFrame) -> DataFrame:
    """Key, payload and feature columns of every stored member, computed from the bytes read."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for member, body in zip(batch.column("member").to_pylist(), batch.column("media")):
                body = body.as_py()
                samples, n_bytes = decode_image(body)
                key = unquote(member[:-4].split("-", 1)[1]) if "-" in member else None
                out.append((
                    key, n_bytes, len(samples), hashlib.sha256(samples).hexdigest(),
                    zlib.crc32(samples[-16:]), len(body), hashlib.sha256(body).hexdigest(), feature(samples),
                ))
            if out:
                names = [x[0] for x in _DECODED]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), _DECODED)], names=names)

    return media.select("member", "media").mapInArrow(unpack, ", ".join(f"{n} {'string' if t == pa.string() else 'long'}" for n, t in _DECODED))


_DECODED = [
    ("key", pa.string()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()),
    ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()),
]


def media_columns(df: DataFrame, key: str = "doc_id", text: str = "text", partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Store every row's text as an image in archives of the shared folder, then read the archives back and decode them."""
    spark = df.sparkSession
    folder = scratch(spark, "media")
    write_archives(df, key, text, folder).agg(F.sum("members")).collect()  # one number: the archives are complete
    return decode(read_archives(spark, folder, partition_bytes))
