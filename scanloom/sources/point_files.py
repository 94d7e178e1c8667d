"""PLY and PCD point files: a custom data source that reads them, and writers.

Headers are parsed once when a read is planned. Binary files are split into ranges of rows, since every row has
the same size; text files are one partition each. Only the wanted fields leave the reader, as Arrow batches.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from scanloom.model import InspectionError, frame_id
from scanloom.surface import SCHEMA, Surface, validate_surface

ROWS_PER_PARTITION = 1_000_000
HEADER_BYTES = 1 << 16

# Scalar types of the formats.
PLY_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
PLY_CAMERA = ("view_px", "view_py", "view_pz", "x_axisx", "x_axisy", "x_axisz", "y_axisx", "y_axisy", "y_axisz", "z_axisx", "z_axisy", "z_axisz", "focal", "scalex", "scaley", "centerx", "centery", "viewportx", "viewporty", "k1", "k2")
NORMALS = ("normal_x", "normal_y", "normal_z")
SHORT_NORMALS = ("nx", "ny", "nz")


def _error(code: str, message: str, path: str) -> InspectionError:
    return InspectionError(code, "none", message, {"path": path})


def check_path(path: str, suffix: str) -> str:
    """A non-empty path without NUL and with the suffix in any case."""
    if not path or "\0" in path:
        raise _error("invalid_argument", "path must be non-empty and without NUL", repr(path))
    if not path.lower().endswith(suffix):
        raise _error("unsupported_format", f"path must end in {suffix}", path)
    return path


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


@dataclass
class Layout:
    """What a header says: fields with numpy types in row order, rows, encoding, where rows start, grid."""

    fields: list[tuple[str, str]]
    rows: int
    encoding: str  # ascii, <, > or compressed
    start: int
    width: int
    height: int
    lead: list[tuple[int, list[str]]] = field(default_factory=list)

    @property
    def dtype(self) -> np.dtype:
        order = self.encoding if self.encoding in "<>" else "<"
        return np.dtype([(n, order + t if t[0] != "S" else t) for n, t in self.fields])


def parse_ply(head: bytes, tail: bytes, path: str) -> Layout:
    """A PLY header. ``tail`` is the end of the file, where a camera element may hold the grid's size."""
    end = head.find(b"end_header")
    if not head.startswith(b"ply") or end < 0:
        raise _error("io_error", "not a PLY file", path)
    start = head.index(b"\n", end) + 1
    encoding, elements = "", []
    for line in head[:end].decode("ascii", "replace").split("\n")[1:]:
        words = line.split()
        if not words or words[0] in ("comment", "obj_info"):
            continue
        if words[0] == "format":
            encoding = {"ascii": "ascii", "binary_little_endian": "<", "binary_big_endian": ">"}.get(words[1], "")
        elif words[0] == "element":
            elements.append((words[1], int(words[2]), []))
        elif words[0] == "property" and elements:
            if words[1] == "list":
                elements[-1][2].append((words[-1], "list"))
            elif words[1] in PLY_TYPES:
                elements[-1][2].append((words[2], PLY_TYPES[words[1]]))
            else:
                raise _error("unsupported_format", f"unknown PLY type {words[1]}", path)
    if not encoding:
        raise _error("unsupported_format", "unknown PLY encoding", path)
    if not elements or elements[0][0] != "vertex":
        raise _error("unsupported_format", "vertex must be the first PLY element", path)
    _, rows, fields = elements[0]
    if any(t == "list" for _, t in fields):
        raise _error("unsupported_format", "list properties of vertices are not supported", path)
    layout = Layout(fields, rows, encoding, start, rows, 1)
    if len(elements) == 2 and elements[1][0] == "camera" and elements[1][1] == 1:
        names = [n for n, _ in elements[1][2]]
        if "viewportx" in names and "viewporty" in names:
            if encoding == "ascii":
                values = dict(zip(names, tail.decode("ascii", "replace").strip().split("\n")[-1].split()))
            else:
                kind = np.dtype([(n, encoding + t) for n, t in elements[1][2]])
                values = dict(zip(names, np.frombuffer(tail[-kind.itemsize :], kind)[0].tolist()))
            width, height = int(float(values["viewportx"])), int(float(values["viewporty"]))
            if width * height == rows and height > 0:
                layout.width, layout.height = width, height
    return layout


def parse_pcd(head: bytes, tail: bytes, path: str) -> Layout:
    """A PCD header."""
    entries, at = {}, 0
    while "DATA" not in entries:
        end = head.find(b"\n", at)
        if end < 0:
            raise _error("io_error", "not a PCD file", path)
        words = head[at:end].decode("ascii", "replace").split()
        at = end + 1
        if words and not words[0].startswith("#"):
            entries[words[0].upper()] = words[1:]
    try:
        names, sizes, types = entries["FIELDS"], entries["SIZE"], entries["TYPE"]
        counts = [int(c) for c in entries.get("COUNT", ["1"] * len(names))]
        width, height = int(entries["WIDTH"][0]), int(entries["HEIGHT"][0])
        encoding = {"ascii": "ascii", "binary": "<", "binary_compressed": "compressed"}[entries["DATA"][0].lower()]
    except (KeyError, IndexError, ValueError):
        raise _error("io_error", "incomplete PCD header", path) from None
    fields = []
    for name, size, kind, count in zip(names, sizes, types, counts):
        code = {"F": "f", "I": "i", "U": "u"}.get(kind)
        if code is None:
            raise _error("unsupported_format", f"unknown PCD type {kind}", path)
        fields += [(name if count == 1 else f"{name}[{i}]", code + size) for i in range(count)]
    if width == 0 or height == 0 or int(entries.get("POINTS", [width * height])[0]) == 0:
        raise _error("io_error", "PCD file without points", path)
    return Layout(fields, width * height, encoding, at, width, height)


def check_fields(layout: Layout, path: str) -> tuple[bool, bool, tuple[str, ...]]:
    """Needs x, y, z as float32; normals complete and float32 or absent; valid as uint8. Returns presence and names."""
    have = dict(layout.fields)
    if any(have.get(c) != "f4" for c in "xyz"):
        raise _error("unsupported_format", "x, y and z must be float32 fields", path)
    names = SHORT_NORMALS if any(n in have for n in SHORT_NORMALS) and not any(n in have for n in NORMALS) else NORMALS
    found = [have.get(n) == "f4" for n in names]
    if any(found) and not all(found):
        raise _error("unsupported_format", "normals must be complete float32 triples", path)
    if have.get("valid", "u1") != "u1":
        raise _error("unsupported_format", "valid must be a uint8 field", path)
    if layout.rows < 1:
        raise _error("invalid_input", "the file has no points", path)
    return all(found), "valid" in have, names


def lzf_decompress(data: bytes, size: int) -> bytes:
    """The LZF format: literal runs and back references, as PCD files use it."""
    out, at = bytearray(), 0
    while at < len(data):
        control = data[at]
        at += 1
        if control < 32:
            out += data[at : at + control + 1]
            at += control + 1
            continue
        length = control >> 5
        if length == 7:
            length += data[at]
            at += 1
        back = len(out) - ((control & 31) << 8) - data[at] - 1
        at += 1
        for i in range(length + 2):  # a reference may overlap what it makes
            out.append(out[back + i])
    if len(out) != size:
        raise ValueError("unexpected size of decompressed data")
    return bytes(out)


@dataclass
class _Rows(InputPartition):
    path: str
    layout: Layout
    first: int
    last: int


class PointFileReader(DataSourceReader):
    def __init__(self, path: str, kind: str, rows: int) -> None:
        self.path, self.kind, self.rows = path, kind, rows

    def layout(self) -> Layout:
        fs, inner = _open(self.path)
        try:
            with fs.open_input_file(inner) as f:
                size = f.size()
                head = f.read(min(HEADER_BYTES, size))
                f.seek(max(0, size - 1024))
                tail = f.read()
        except (OSError, pa.ArrowInvalid) as error:
            raise _error("io_error", f"cannot read point file: {error}", self.path) from None
        layout = (parse_ply if self.kind == "ply" else parse_pcd)(head, tail, self.path)
        check_fields(layout, self.path)
        if layout.encoding in "<>" and size < layout.start + layout.rows * layout.dtype.itemsize:
            raise _error("invalid_input", "the file is shorter than its header says", self.path)
        return layout

    def partitions(self) -> list[_Rows]:
        layout = self.layout()
        if layout.encoding not in "<>":
            return [_Rows(self.path, layout, 0, layout.rows)]
        return [_Rows(self.path, layout, a, min(a + self.rows, layout.rows)) for a in range(0, layout.rows, self.rows)]

    def read(self, part: _Rows) -> Iterator[pa.RecordBatch]:
        layout, (fs, inner) = part.layout, _open(part.path)
        with fs.open_input_file(inner) as f:
            if layout.encoding in "<>":
                size = layout.dtype.itemsize
                f.seek(layout.start + part.first * size)
                table = np.frombuffer(f.read((part.last - part.first) * size), layout.dtype)
            else:
                f.seek(layout.start)
                table = self._text(f.read(), layout) if layout.encoding == "ascii" else self._packed(f.read(), layout)
        names = check_fields(layout, part.path)[2]
        have = dict(layout.fields)
        idx = np.arange(part.first, part.last)
        grid = layout.height > 1
        none = pa.nulls(len(idx), pa.int32())
        columns = [pa.array(idx), pa.array((idx // layout.width).astype(np.int32)) if grid else none, pa.array((idx % layout.width).astype(np.int32)) if grid else none]
        columns += [pa.array(table[c].astype(np.float32), pa.float32()) for c in "xyz"]
        columns += [pa.array(table[c].astype(np.float32), pa.float32()) if c in have else pa.nulls(len(idx), pa.float32()) for c in names]
        columns.append(pa.array(table["valid"].astype(np.int16)) if "valid" in have else pa.nulls(len(idx), pa.int16()))
        batch = pa.RecordBatch.from_arrays(columns, names=["idx", "row_idx", "col_idx", "x", "y", "z", "nx", "ny", "nz", "mask"])
        for a in range(0, batch.num_rows, 65536):
            yield batch.slice(a, 65536)

    def _text(self, data: bytes, layout: Layout) -> np.ndarray:
        lines = [x for x in data.decode("ascii", "replace").split("\n") if x.strip()][: layout.rows]
        if len(lines) < layout.rows:
            raise _error("invalid_input", "the file is shorter than its header says", self.path)
        try:
            return np.array([tuple(float(v) for v in x.split()[: len(layout.fields)]) for x in lines], np.dtype([(n, "f8") for n, _ in layout.fields]))
        except (ValueError, TypeError):
            raise _error("io_error", "malformed point row", self.path) from None

    def _packed(self, data: bytes, layout: Layout) -> np.ndarray:
        packed, size = struct.unpack_from("<II", data)
        body = lzf_decompress(data[8 : 8 + packed], size)
        out, at = np.empty(layout.rows, layout.dtype), 0
        for name, kind in layout.fields:  # stored field by field
            step = np.dtype(kind).itemsize * layout.rows
            out[name] = np.frombuffer(body[at : at + step], "<" + kind)
            at += step
        return out


class PointFileSource(DataSource):
    """``spark.read.format("point_file").load(path)``: one row per point of a PLY or PCD file."""

    @classmethod
    def name(cls) -> str:
        return "point_file"

    def schema(self) -> str:
        return SCHEMA.replace("valid boolean", "mask short")

    def reader(self, schema) -> PointFileReader:  # noqa: ANN001
        path = self.options["path"]
        kind = "pcd" if path.lower().endswith(".pcd") else "ply"
        return PointFileReader(path, kind, int(self.options.get("rowsperpartition", ROWS_PER_PARTITION)))


def _read(spark: SparkSession, path: str, unit: str, frame: str, kind: str, rows: int) -> Surface:
    check_path(path, "." + kind)
    frame_id(frame)
    layout = PointFileReader(path, kind, rows).layout()
    has_normals, has_mask, _ = check_fields(layout, path)
    spark.dataSource.register(PointFileSource)
    raw = spark.read.format("point_file").option("rowsPerPartition", str(rows)).load(path)
    names = ["x", "y", "z", *(("nx", "ny", "nz") if has_normals else ())]
    finite = F.lit(True)
    for n in names:
        finite = finite & ~F.isnan(n) & (F.abs(n) < F.lit(float("inf")))
    bad = raw.agg(F.count_if(F.col("mask") > 1).alias("mask"), F.count_if((F.col("mask") == 1) & ~finite).alias("marked"), F.count_if(~finite).alias("dirty")).first()
    if bad["mask"]:
        raise _error("invalid_input", "valid values must be 0 or 1", path)
    if bad["marked"]:
        raise _error("invalid_input", "a non-finite sample is marked as valid", path)
    df = raw.withColumn("valid", F.col("mask") == 1 if has_mask else finite).drop("mask")
    grid = (layout.width, layout.height, layout.width) if layout.height > 1 else (None, None, None)
    return validate_surface(Surface(df, unit, frame, has_normals, has_mask or bad["dirty"] > 0, *grid))


def read_ply(spark: SparkSession, path: str, unit: str, frame: str, rows: int = ROWS_PER_PARTITION) -> Surface:
    return _read(spark, path, unit, frame, "ply", rows)


def read_pcd(spark: SparkSession, path: str, unit: str, frame: str, rows: int = ROWS_PER_PARTITION) -> Surface:
    return _read(spark, path, unit, frame, "pcd", rows)


def _ordered_batches(surface: Surface, columns: Sequence[str]) -> Iterator[np.ndarray]:
    """Rows in storage order, fetched a partition at a time: one file is one ordered stream."""
    rows = surface.df.select(*columns, "idx").orderBy("idx").drop("idx")
    held: list[tuple] = []
    for row in rows.toLocalIterator(prefetchPartitions=True):
        held.append(tuple(row))
        if len(held) == 65536:
            yield held
            held = []
    if held:
        yield held


def _write(surface: Surface, path: str, kind: str, encoding: str) -> int:
    check_path(path, "." + kind)
    if encoding not in ("ascii", "binary"):
        raise _error("invalid_argument", "encoding must be ascii or binary", path)
    count = surface.df.count()
    width, height = (surface.width, surface.height) if surface.width else (count, 1)
    names = ["x", "y", "z", *(NORMALS if surface.has_normals else ()), "valid"]
    columns = ["x", "y", "z", *(SHORT_NORMALS if surface.has_normals else ()), F.col("valid").cast("int").alias("valid")]
    dtype = np.dtype([(n, "<f4") for n in names[:-1]] + [("valid", "u1")])
    fs, inner = _open(path)
    text = encoding == "ascii"
    if kind == "ply":
        lines = ["ply", "format ascii 1.0" if text else "format binary_little_endian 1.0", f"element vertex {count}", *(f"property float {n}" for n in names[:-1]), "property uchar valid"]
        lines += ["element camera 1", *(f"property {'int' if n.startswith('viewport') else 'float'} {n}" for n in PLY_CAMERA), "end_header"]
    else:
        n = len(names)
        lines = ["# .PCD v0.7 - Point Cloud Data file format", "VERSION 0.7", "FIELDS " + " ".join(names), "SIZE " + "4 " * (n - 1) + "1", "TYPE " + "F " * (n - 1) + "U", "COUNT" + " 1" * n]
        lines += [f"WIDTH {width}", f"HEIGHT {height}", "VIEWPOINT 0 0 0 1 0 0 0", f"POINTS {count}", f"DATA {encoding}"]
    camera = dict.fromkeys(PLY_CAMERA, 0.0) | {"x_axisx": 1.0, "y_axisy": 1.0, "z_axisz": 1.0, "viewportx": width, "viewporty": height}
    try:
        with fs.open_output_stream(inner) as out:
            out.write(("\n".join(lines) + "\n").encode())
            for rows in _ordered_batches(surface, columns):
                if text:
                    out.write("".join(" ".join("nan" if v != v else repr(float(np.float32(v))) if i < len(names) - 1 else str(v) for i, v in enumerate(_nan(r))) + "\n" for r in rows).encode())
                else:
                    out.write(np.array([_nan(r) for r in rows], dtype).tobytes())
            if kind == "ply":
                if text:
                    out.write((" ".join(str(v) for v in camera.values()) + "\n").encode())
                else:
                    out.write(np.array([tuple(camera.values())], np.dtype([(n, "<i4" if n.startswith("viewport") else "<f4") for n in PLY_CAMERA])).tobytes())
    except OSError as error:
        raise _error("io_error", f"cannot write point file: {error}", path) from None
    return count


def _nan(row: tuple) -> tuple:
    return tuple(float("nan") if v is None else v for v in row)


def write_ply(surface: Surface, path: str, encoding: str = "binary") -> int:
    """Logical points in storage order; padding is left out. Returns their number."""
    return _write(surface, path, "ply", encoding)


def write_pcd(surface: Surface, path: str, encoding: str = "binary") -> int:
    return _write(surface, path, "pcd", encoding)


# ---------------------------------------------------------------------------------- attributes


def reason_code(column: str, reasons: Sequence[str]) -> Column:
    """A reason as its number in the list of reasons."""
    return F.array_position(F.array(*(F.lit(r) for r in reasons)), F.col(column)).cast("int") - 1


def attribute_line() -> Column:
    """One line of an attribute PLY file, six decimals."""
    return F.format_string("%.6f %.6f %.6f %.6f %d %d", *(F.col(c).cast("double") for c in ("x", "y", "z", "scalar")), F.col("reason").cast("int"), F.col("region_id").cast("int"))


def write_attribute_ply(attributes: DataFrame, path: str) -> int:
    """ASCII PLY of (idx, x, y, z, scalar, reason, region_id) rows in index order, six decimals. Returns the row count."""
    count = attributes.count()
    fs, inner = _open(path)
    head = ["ply", "format ascii 1.0", f"element vertex {count}", "property float x", "property float y", "property float z", "property float scalar", "property uchar reason", "property int region_id", "end_header"]
    try:
        with fs.open_output_stream(inner) as out, io.BytesIO() as held:
            held.write(("\n".join(head) + "\n").encode())
            for row in attributes.select("idx", attribute_line().alias("line")).orderBy("idx").toLocalIterator(prefetchPartitions=True):
                held.write(row["line"].encode() + b"\n")
                if held.tell() > 1 << 20:
                    out.write(held.getvalue())
                    held.seek(0)
                    held.truncate()
            out.write(held.getvalue())
    except OSError as error:
        raise _error("io_error", f"cannot write point file: {error}", path) from None
    return count


def attribute_table(surface: Surface, values: DataFrame) -> DataFrame:
    """Rows for ``write_attribute_ply`` from values keyed by idx; every logical point must have one."""
    joined = surface.df.select("idx", "x", "y", "z").join(values.select("idx", "scalar", "reason", "region_id"), "idx", "left")
    if joined.where("reason IS NULL").limit(1).count():
        raise _error("invalid_input", "attributes must span the surface", "attributes")
    return joined
