"""Column functions of the geometry: all stay in Spark's expressions, none is a Python function."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def vector(prefix: str = "", names: Sequence[str] = ("x", "y", "z")) -> Vector:
    return tuple(F.col(prefix + n) for n in names)  # type: ignore[return-value]


def is_finite(*columns: Column) -> Column:
    """True where no column is NaN, infinite or null."""
    good = F.lit(True)
    for c in columns:
        good = good & F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))
    return good


def dot(a: Vector, b: Vector) -> Column:
    """(a0 b0 + a1 b1) + a2 b2 in double."""
    p = [x.cast("double") * y for x, y in zip(a, b)]
    return (p[0] + p[1]) + p[2]


def length(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def cross(a: Vector, b: Vector) -> Vector:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def minus(a: Vector, b: Vector) -> Vector:
    return tuple(x - y for x, y in zip(a, b))  # type: ignore[return-value]


def normalized(a: Vector) -> Vector:
    """Unit vector as float32; a zero vector stays zero."""
    size = length(a)
    return tuple(F.when(size > 0, x.cast("double") / size).otherwise(F.lit(0.0)).cast("float") for x in a)  # type: ignore[return-value]


def squared_distance(a: Vector, b: Vector, kind: str = "double") -> Column:
    """dx dx + dy dy + dz dz in ``kind`` arithmetic ("float" or "double")."""
    d = [x.cast(kind) - y.cast(kind) for x, y in zip(a, b)]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def transformed(matrix: Sequence[float], p: Vector) -> Vector:
    """((m0 x + m1 y) + m2 z) + m3 for each row, in double."""
    x, y, z = (c.cast("double") for c in p)
    return tuple(((F.lit(matrix[r]) * x + F.lit(matrix[r + 1]) * y) + F.lit(matrix[r + 2]) * z) + F.lit(matrix[r + 3]) for r in (0, 4, 8))  # type: ignore[return-value]


def rotated(matrix: Sequence[float], p: Vector) -> Vector:
    x, y, z = (c.cast("double") for c in p)
    return tuple((F.lit(matrix[r]) * x + F.lit(matrix[r + 1]) * y) + F.lit(matrix[r + 2]) * z for r in (0, 4, 8))  # type: ignore[return-value]


def angle_degrees(a: Vector, b: Vector) -> Column:
    """Angle between two vectors, 0 where one has no length."""
    scale = length(a) * length(b)
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / scale))
    return F.when(scale > 0, F.degrees(F.acos(cosine))).otherwise(F.lit(0.0))


def cell(c: Column, size: float) -> Column:
    """Index of the grid cell that holds a coordinate."""
    return F.floor(c.cast("double") / F.lit(size)).cast("long")


_SCALE = float(1 << 40)


def stable_sum(c: Column) -> Column:
    """A sum that is the same for every order and partitioning: fixed point with 40 binary places, null if there are no rows."""
    return F.sum(F.round(c * F.lit(_SCALE)).cast("decimal(28,0)")).cast("double") / F.lit(_SCALE)


def nearest_rank(column: str, share: float = 0.95) -> Column:
    """The value at rank ceil(share n) of a column, null values aside; null if there are none."""
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY `{column}`)")
