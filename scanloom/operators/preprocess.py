"""Validity masks, voxel sampling, normals and boundaries."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.functions import geometry as g
from scanloom.model import InspectionError
from scanloom.operators.spatial import CELL, indexed, radius_join
from scanloom.surface import Surface

Box = tuple[Sequence[float], Sequence[float]]


def _error(field: str, reason: str, code: str = "invalid_argument") -> InspectionError:
    return InspectionError(code, "preprocess", "preprocessing failed", {"field": field, "reason": reason})


def _positive(name: str, value: float) -> None:
    if not (math.isfinite(value) and value > 0):
        raise _error(name, "must be finite and positive")


def _needs_millimeters(surface: Surface) -> None:
    if surface.unit != "millimeter":
        raise _error("surface.unit", "must be normalized to millimetres", "invalid_input")


# ---------------------------------------------------------------------------------- validity


def roi_filter(df: DataFrame, box: Box) -> DataFrame:
    """Points in an axis-aligned box, faces included: plain conjuncts, which reach the file scan."""
    for c, low, high in zip("xyz", *box):
        df = df.where((F.col(c) >= F.lit(low).cast("float")) & (F.col(c) <= F.lit(high).cast("float")))
    return df


def check_box(box: Box) -> None:
    for low, high in zip(*box):
        if not (math.isfinite(low) and math.isfinite(high)):
            raise _error("roi", "bounds must be finite")
        if low > high:
            raise _error("roi", "minimum must not exceed maximum")


def invalid_reason(has_normals: bool, box: Box | None) -> Column:
    """The first of: non-finite point, non-finite normal, masked on input, outside the box; else none."""
    reason = F.when(~g.is_finite(*g.vector()), "non_finite_point")
    if has_normals:
        reason = reason.when(~g.is_finite(*g.vector("n")), "non_finite_normal")
    reason = reason.when(~F.col("valid"), "input_masked")
    if box is not None:
        inside = F.lit(True)
        for c, low, high in zip("xyz", *box):
            inside = inside & (F.col(c) >= F.lit(low).cast("float")) & (F.col(c) <= F.lit(high).cast("float"))
        reason = reason.when(~inside, "outside_roi")
    return reason.otherwise("none")


def validity_mask(surface: Surface, box: Box | None = None) -> Surface:
    """The surface with a mask that also drops non-finite samples and those outside the box, and ``invalid_reason``."""
    if box is not None:
        check_box(box)
    marked = surface.df.withColumn("invalid_reason", invalid_reason(surface.has_normals, box))
    return replace(surface, df=marked.withColumn("valid", F.col("invalid_reason") == "none"), has_mask=True)


def storage_reasons(masked: Surface) -> DataFrame:
    """(idx, invalid_reason) of every storage slot; slots between grid rows are row_padding."""
    own = masked.df.select("idx", "invalid_reason")
    if not masked.padding:
        return own
    slots = masked.df.sparkSession.range((masked.height - 1) * masked.row_stride + masked.width).select(F.col("id").alias("idx"))
    pads = slots.where(F.col("idx") % masked.row_stride >= masked.width).select("idx", F.lit("row_padding").alias("invalid_reason"))
    return own.unionByName(pads)


# ---------------------------------------------------------------------------------- voxels


def voxel_sample(surface: Surface, size: float, keys: Sequence[str] = ()) -> DataFrame:
    """One row per occupied voxel: key, centroid, unit mean normal (zero if it has none), members in order.

    A group-by that is combined before its shuffle for the sums; only the member lists grow with a voxel's points.
    """
    _needs_millimeters(surface)
    _positive("voxel_size_mm", size)
    valid = surface.valid_points()
    limit = float(2**63 - 1024)
    worst = valid.agg(F.count("*").alias("n"), F.max(F.greatest(*(F.abs(F.col(c).cast("double") / size) for c in "xyz"))).alias("far")).first()
    if not worst["n"]:
        raise _error("surface.valid", "must contain at least one valid sample", "invalid_input")
    if not worst["far"] < limit:
        raise _error("surface.points", "a coordinate is outside the range of voxel keys", "invalid_input")
    return voxels(valid, size, surface.has_normals, keys)


def voxels(valid: DataFrame, size: float, has_normals: bool, keys: Sequence[str] = ()) -> DataFrame:
    cells = [g.cell(F.col(c), size).alias(k) for c, k in zip("xyz", ("kx", "ky", "kz"))]
    means = [F.avg(F.col(c).cast("double")).cast("float").alias(c) for c in "xyz"]
    sums = [F.sum(F.col(c).cast("double")).alias(c) for c in ("nx", "ny", "nz")]
    grouped = valid.groupBy(*keys, *cells).agg(*means, *(sums if has_normals else [F.lit(None).cast("float").alias(c) for c in ("nx", "ny", "nz")]), F.array_sort(F.collect_list("idx")).alias("source_idx"))
    if not has_normals:
        return grouped
    unit = g.normalized(g.vector("n"))
    return grouped.withColumns(dict(zip(("nx", "ny", "nz"), unit)))


def voxel_offsets(sampled: DataFrame) -> DataFrame:
    """The voxels in key order with their number and the CSR offsets of their members.

    A running sum over the whole table: voxel counts are first summed by leading key, so that only those totals meet in one task.
    """
    sizes = sampled.withColumn("n", F.size("source_idx").cast("long"))
    slabs = sizes.groupBy("kx").agg(F.sum("n").alias("slab_n"), F.count("*").alias("slab_v"))
    before = Window.orderBy("kx").rowsBetween(Window.unboundedPreceding, -1)
    starts = slabs.select(F.col("kx").alias("slab"), F.coalesce(F.sum("slab_n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("slab_v").over(before), F.lit(0)).alias("v0"))
    inside = Window.partitionBy("kx").orderBy("ky", "kz").rowsBetween(Window.unboundedPreceding, -1)
    own = sizes.withColumns({"n1": F.coalesce(F.sum("n").over(inside), F.lit(0)), "v1": F.coalesce(F.count("n").over(inside), F.lit(0))})
    joined = own.join(starts, own["kx"] == starts["slab"])
    return joined.select("kx", "ky", "kz", (F.col("v0") + F.col("v1")).alias("voxel"), (F.col("n0") + F.col("n1")).alias("start"), (F.col("n0") + F.col("n1") + F.col("n")).alias("end"))


# ---------------------------------------------------------------------------------- normals


@dataclass(frozen=True)
class Orientation:
    """``align``: flip against a direction; ``viewpoint``: flip towards a point; ``unproven``: leave as they are."""

    mode: str = "unproven"
    value: tuple[float, float, float] = (0.0, 0.0, 0.0)


def neighbourhood_moments(valid: DataFrame, radius: float, keys: Sequence[str] = ()) -> DataFrame:
    """Count, sums and products of neighbour offsets within ``radius`` for each point, itself included. Points at one place are met once, with their number."""
    places = valid.groupBy(*keys, "x", "y", "z").agg(F.min("idx").alias("idx"), F.count("*").alias("copies"))
    pairs = radius_join(valid.select(*keys, "idx", "x", "y", "z"), indexed(places, radius, ("copies",), keys), radius, keys)
    w = F.col("r_copies")
    dx, dy, dz = (F.col(f"r_{c}").cast("double") - F.col(c).cast("double") for c in "xyz")
    sums = {"sx": dx, "sy": dy, "sz": dz, "xx": dx * dx, "xy": dx * dy, "xz": dx * dz, "yy": dy * dy, "yz": dy * dz, "zz": dz * dz}
    return pairs.groupBy(*keys, *CELL, "idx").agg(F.sum(w).alias("n"), *(F.sum(w * v).alias(k) for k, v in sums.items())).drop(*CELL)


def plane_normals(n: np.ndarray, s: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit normals of best-fit planes from moments (rows of s: 3 sums, of p: xx xy xz yy yz zz), and which are defined.

    The sign is arbitrary; the component of largest magnitude is made positive so that results repeat.
    """
    mean = s / n[:, None]
    cov = np.empty((len(n), 3, 3))
    for k, (i, j) in enumerate(((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))):
        cov[:, i, j] = cov[:, j, i] = p[:, k] / n - mean[:, i] * mean[:, j]
    values, vectors = np.linalg.eigh(cov)
    normal = vectors[:, :, 0]
    lead = np.take_along_axis(normal, np.abs(normal).argmax(axis=1)[:, None], axis=1)
    good = np.isfinite(normal).all(axis=1) & (values[:, 2] > 0)
    return normal * np.where(lead < 0, -1.0, 1.0), good


def estimate_normals(valid: DataFrame, radius: float, minimum: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, idx, ex, ey, ez) of the points with at least ``minimum`` neighbours (3 at least) and a defined plane."""
    moments = neighbourhood_moments(valid, radius, keys).where(F.col("n") >= max(minimum, 3))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = lambda c: batch.column(batch.schema.get_field_index(c)).to_numpy()
            normal, good = plane_normals(column("n").astype(float), np.column_stack([column(c) for c in ("sx", "sy", "sz")]), np.column_stack([column(c) for c in ("xx", "xy", "xz", "yy", "yz", "zz")]))
            own = [batch.column(batch.schema.get_field_index(k)) for k in (*keys, "idx")]
            out = pa.RecordBatch.from_arrays([*own, *(pa.array(normal[:, i].astype(np.float32)) for i in range(3))], names=[*keys, "idx", "ex", "ey", "ez"])
            yield out.filter(pa.array(good))

    kinds = ", ".join(f"`{k}` {valid.schema[k].dataType.simpleString()}" for k in keys)
    return moments.mapInArrow(solve, f"{kinds}{', ' if kinds else ''}idx long, ex float, ey float, ez float")


def grid_boundaries(df: DataFrame, radius: float, keys: Sequence[str] = ()) -> DataFrame:
    """``boundary``: a 4-neighbour is off the grid, invalid, or farther than ``radius``. Windows over rows and columns."""
    def step(window: Window, axis: str, side: int) -> Column:
        move = F.lag if side < 0 else F.lead
        other = lambda c: move(c).over(window)
        there = F.coalesce(other(axis) == F.col(axis) + side, F.lit(False)) & F.coalesce(other("valid"), F.lit(False))
        delta = g.minus(g.vector(), tuple(other(c) for c in "xyz"))  # type: ignore[arg-type]
        return ~there | ~F.coalesce(g.length(delta) <= F.lit(radius), F.lit(False))

    row = Window.partitionBy(*keys, "row_idx").orderBy("col_idx")
    column = Window.partitionBy(*keys, "col_idx").orderBy("row_idx")
    out = df.withColumn("__row", step(row, "col_idx", -1) | step(row, "col_idx", 1))
    out = out.withColumn("__column", step(column, "row_idx", -1) | step(column, "row_idx", 1))
    return out.withColumn("boundary", F.col("valid") & (F.col("__row") | F.col("__column"))).drop("__row", "__column")


def angular_boundaries(valid: DataFrame, radius: float, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, idx) of the boundary points: the largest gap between neighbours' directions in the tangent plane exceeds 90 degrees.

    Fewer than three directions also make a boundary. Gaps come from a window over each point's neighbours in angle order.
    """
    n = g.normalized(g.vector("n"))
    based = valid.select(*keys, "idx", "x", "y", "z", *(c.alias(a) for c, a in zip(n, ("mx", "my", "mz"))))
    ax, ay, az = (F.abs(c) for c in g.vector("m"))
    first = (ax <= ay) & (ax <= az)
    second = ~first & (ay <= az)
    axis = tuple(F.when(k, F.lit(1.0)).otherwise(F.lit(0.0)).cast("float") for k in (first, second, ~first & ~second))
    u = g.normalized(g.cross(g.vector("m"), axis))  # type: ignore[arg-type]
    based = based.withColumns(dict(zip(("ux", "uy", "uz"), u)))
    based = based.withColumns(dict(zip(("vx", "vy", "vz"), g.cross(g.vector("m"), g.vector("u")))))
    pairs = radius_join(based, indexed(valid, radius, keys=keys), radius, keys)
    delta = g.minus(g.vector("r_"), g.vector())
    px, py = g.dot(delta, g.vector("u")), g.dot(delta, g.vector("v"))
    seen = (F.col("idx") != F.col("r_idx")) & (px * px + py * py > 1e-20)
    angles = pairs.withColumn("angle", F.when(seen, F.atan2(py, px)))
    window = Window.partitionBy(*keys, *CELL, "idx").orderBy("angle")
    gaps = angles.withColumn("gap", F.col("angle") - F.lag("angle").over(window))
    found = gaps.groupBy(*keys, *CELL, "idx").agg(F.count("angle").alias("n"), F.max("gap").alias("gap"), (F.min("angle") + 2 * math.pi - F.max("angle")).alias("around"))
    wide = F.greatest(F.coalesce("gap", F.lit(0.0)), "around") > F.lit(math.pi / 2)
    return found.where((F.col("n") < 3) | wide).select(*keys, "idx")


@dataclass(frozen=True)
class Prepared:
    """A surface with unit normals whose mask holds only points that have one, with ``normal_reason``,
    ``orientation_valid`` and ``boundary`` columns, and whether all orientations are proven."""

    surface: Surface
    orientation_proven: bool


def oriented(df: DataFrame, hint: Orientation) -> DataFrame:
    """Normals flipped by the hint, and ``orientation_valid``."""
    n = g.vector("n")
    usable = F.col("valid")
    if hint.mode == "align":
        size = math.sqrt(sum(v * v for v in hint.value))
        towards = tuple(F.lit(v / size).cast("float") for v in hint.value)
        known = usable
    elif hint.mode == "viewpoint":
        towards = tuple(F.lit(v).cast("float") - F.col(c) for v, c in zip(hint.value, "xyz"))
        known = usable & (g.length(towards) > 0)  # type: ignore[arg-type]
    else:
        return df.withColumn("orientation_valid", F.lit(False))
    flip = known & (g.dot(n, towards) < 0)  # type: ignore[arg-type]
    return df.withColumns({**{c: F.when(flip, -F.col(c)).otherwise(F.col(c)) for c in ("nx", "ny", "nz")}, "orientation_valid": known})


def prepare(surface: Surface, normal_radius: float, minimum: int, boundary_radius: float, hint: Orientation = Orientation(), keys: Sequence[str] = ()) -> Prepared:
    """Supplied normals are made unit length (zero is missing); absent ones are estimated. Then orientation and boundaries."""
    _needs_millimeters(surface)
    _positive("normal_radius_mm", normal_radius)
    if minimum < 3:
        raise _error("normal_min_neighbors", "must be at least 3")
    _positive("boundary_radius_mm", boundary_radius)
    if hint.mode != "unproven" and not (all(math.isfinite(v) for v in hint.value) and any(hint.value)):
        raise _error("orientation.value", "must be finite and non-zero")
    df = surface.df
    if surface.has_normals:
        unit = g.normalized(g.vector("n"))
        df = df.withColumns({c: F.when(F.col("valid"), u) for c, u in zip(("nx", "ny", "nz"), unit)})
        has = F.coalesce(g.length(g.vector("n")) > 0, F.lit(False))
    else:
        found = estimate_normals(surface.valid_points(), normal_radius, minimum, keys)
        df = df.drop("nx", "ny", "nz").join(found, [*keys, "idx"], "left").withColumnsRenamed({"ex": "nx", "ey": "ny", "ez": "nz"})
        has = F.col("nx").isNotNull()
    reason = F.when(~F.col("valid"), "input_invalid").when(~has, "normal_missing").otherwise("none")
    df = df.withColumn("normal_reason", reason)
    zero = F.lit(0.0).cast("float")
    df = df.withColumns({"valid": F.col("normal_reason") == "none", **{c: F.coalesce(F.when(has, F.col(c)), zero) for c in ("nx", "ny", "nz")}})
    df = oriented(df, hint)
    if surface.width is not None:
        df = grid_boundaries(df, boundary_radius, keys)
    else:
        edge = angular_boundaries(df.where("valid"), boundary_radius, keys).select(*keys, "idx", F.lit(True).alias("boundary"))
        df = df.join(edge, [*keys, "idx"], "left").withColumn("boundary", F.coalesce("boundary", F.lit(False)))
    df = df.select(*(c for c in surface.df.columns), "normal_reason", "orientation_valid", "boundary")
    out = replace(surface, df=df, has_normals=True, has_mask=True)
    if hint.mode == "unproven":
        return Prepared(out, False)
    counted = df.agg(F.count_if("valid").alias("n"), F.count_if(F.col("valid") & F.col("orientation_valid")).alias("known")).first()
    return Prepared(out, counted["n"] > 0 and counted["n"] == counted["known"])
