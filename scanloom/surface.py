"""A surface: a DataFrame of points with its unit, frame and topology; contract checks and normalization."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.functions import geometry as g
from scanloom.model import FLOAT_MAX, MM_PER_UNIT, InspectionError, RigidTransform, frame_id

SCHEMA = "idx long, row_idx int, col_idx int, x float, y float, z float, nx float, ny float, nz float, valid boolean"
#: Larger arrays are dealt to the executors at once.
LOCAL_ROWS = 10_000
COLUMNS = ("idx", "row_idx", "col_idx", "x", "y", "z", "nx", "ny", "nz", "valid")


@dataclass(frozen=True)
class Surface:
    """Points keyed by storage index ``idx``. Other columns of ``df``, such as ``scan_id``, are carried along.

    For a grid with ``row_stride`` > ``width`` the slots between rows exist in storage only: they have no row in ``df``
    and are counted by ``padding``.
    """

    df: DataFrame
    unit: str
    frame: str
    has_normals: bool
    has_mask: bool = True
    width: int | None = None
    height: int | None = None
    row_stride: int | None = None

    @property
    def padding(self) -> int:
        if self.width is None:
            return 0
        return (self.height - 1) * self.row_stride + self.width - self.width * self.height

    def valid_points(self) -> DataFrame:
        return self.df.where("valid")


def surface_error(field: str, reason: str, code: str = "invalid_input") -> InspectionError:
    return InspectionError(code, "validate", "invalid surface", {"field": field, "reason": reason})


def from_points(
    spark: SparkSession, points: Sequence[Sequence[float]] | np.ndarray, normals: Sequence[Sequence[float]] | np.ndarray = (), valid: Sequence[int] = (), grid: tuple[int, int, int] | None = None, unit: str = "millimeter", frame: str = "fixture", check: bool = True
) -> Surface:
    """A surface from arrays in storage order; ``grid`` is (width, height, row_stride)."""
    p = np.asarray(points, dtype=np.float32).reshape(-1, 3)
    n = np.asarray(normals, dtype=np.float32).reshape(-1, 3)
    mask = np.asarray(valid, dtype=np.int64)
    if not len(p):
        raise surface_error("points", "must not be empty")
    if len(n) not in (0, len(p)):
        raise surface_error("normals", "must be empty or match point storage size")
    if len(mask) not in (0, len(p)):
        raise surface_error("valid", "must be empty or match point storage size")
    if ((mask != 0) & (mask != 1)).any():
        raise surface_error("valid", "mask elements must be 0 or 1")
    idx = np.arange(len(p))
    row = col = None
    if grid is not None:
        width, height, stride = grid
        if width < 1 or height < 1:
            raise surface_error("grid", "width and height must be positive")
        if stride < width:
            raise surface_error("grid.row_stride", "must be at least grid.width")
        if (height - 1) * stride + width != len(p):
            raise surface_error("grid", "point storage does not match width, height, and row_stride")
        keep = idx % stride < width
        row, col = (idx // stride)[keep], (idx % stride)[keep]
        idx = idx[keep]
    none = pa.nulls(len(idx), pa.int32())
    table = pa.table({
        "idx": pa.array(idx, pa.int64()),
        "row_idx": none if row is None else pa.array(row, pa.int32()),
        "col_idx": none if col is None else pa.array(col, pa.int32()),
        **{c: pa.array(p[idx, i], pa.float32()) for i, c in enumerate("xyz")},
        **{c: pa.array(n[idx, i], pa.float32()) if len(n) else pa.nulls(len(idx), pa.float32()) for i, c in enumerate(("nx", "ny", "nz"))},
        "valid": pa.array(mask[idx] == 1 if len(mask) else np.ones(len(idx), dtype=bool)),
    })
    df = spark.createDataFrame(table, schema=SCHEMA)
    if len(idx) > LOCAL_ROWS:  # else the optimizer would evaluate projections of these rows on the driver
        df = df.repartition(spark.sparkContext.defaultParallelism, "idx")
    surface = Surface(df, unit, frame_id(frame), bool(len(n)), bool(len(mask)), *(grid or (None, None, None)))
    return validate_surface(surface) if check else surface


def contract_counts(surface: Surface) -> DataFrame:
    """One row: points, null mask elements, and valid points with a coordinate or a normal that is not finite."""
    bad_point = F.col("valid") & ~g.is_finite(*g.vector())
    bad_normal = F.col("valid") & ~g.is_finite(*g.vector("n")) if surface.has_normals else F.lit(False)
    return surface.df.agg(F.count("*").alias("n"), F.count_if(F.col("valid").isNull()).alias("mask"), F.count_if(bad_point).alias("points"), F.count_if(bad_normal).alias("normals"))


def validate_surface(surface: Surface) -> Surface:
    """Check the contract in one pass over the points; the first problem is raised."""
    if surface.unit not in MM_PER_UNIT:
        raise surface_error("unit", "is not supported", "invalid_argument")
    frame_id(surface.frame)
    found = contract_counts(surface).first()
    if not found["n"]:
        raise surface_error("points", "must not be empty")
    if found["mask"]:
        raise surface_error("valid", "mask elements must be 0 or 1")
    if found["points"]:
        raise surface_error("points", "valid points must contain only finite coordinates")
    if found["normals"]:
        raise surface_error("normals", "normals for valid points must be finite")
    return surface


def scaled(surface: Surface, target_frame: str, transform: RigidTransform | None) -> DataFrame:
    """The projection of ``normalize_surface`` alone: lazy, without its checks."""
    p = [c.cast("double") * F.lit(MM_PER_UNIT[surface.unit]) for c in g.vector()]
    n = g.vector("n")
    if transform is not None:
        p, n = g.transformed(transform.matrix, tuple(p)), g.rotated(transform.matrix, n)
    return surface.df.withColumns({**{c: v.cast("double") for c, v in zip("xyz", p)}, **{c: v.cast("double") for c, v in zip(("nx", "ny", "nz"), n)}})


def normalize_surface(surface: Surface, target_frame: str, transform: RigidTransform | None = None, check: bool = True) -> Surface:
    """Millimetres, optionally moved into ``target_frame``; computed in double and stored as float32."""

    def error(field: str, reason: str) -> InspectionError:
        return InspectionError("invalid_input", "normalize", "surface normalization failed", {"field": field, "reason": reason})

    if surface.unit not in MM_PER_UNIT:
        raise surface_error("unit", "is not supported", "invalid_argument")
    if target_frame != surface.frame and transform is None:
        raise error("transform", "is required when source and target frames differ")
    if transform is not None and (transform.source, transform.target) != (surface.frame, target_frame):
        raise error("transform", "frame direction must match surface -> target")
    moved = scaled(surface, target_frame, transform)
    if check:
        too_large = lambda names: F.max(F.when(F.col("valid"), F.greatest(*(F.abs(n) for n in names))))
        found = moved.agg(too_large(("x", "y", "z")).alias("p"), too_large(("nx", "ny", "nz")).alias("n")).first()
        if found["p"] is not None and not found["p"] <= FLOAT_MAX:
            raise error("points", "a valid point does not fit float32")
        if found["n"] is not None and not found["n"] <= FLOAT_MAX:
            raise error("normals", "a valid normal does not fit float32")
    floats = {c: F.col(c).cast("float") for c in ("x", "y", "z", "nx", "ny", "nz")}
    return replace(surface, df=moved.withColumns(floats), unit="millimeter", frame=target_frame)
