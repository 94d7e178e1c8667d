"""Surfaces derived from the driver's tables, as DataFrames and as SQL with the same meaning.

orders: a lattice of 100 columns, 0.5 mm apart; heights of the scan from o_totalprice. Deterministic rules on the key
make invalid samples, missing and flipped normals and far points, so that every reason occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, STEP = 100, 0.5
SEARCH, ANGLE, BOUNDARY = 0.8, 35.0, 0.6
POSITIVE, NEGATIVE, TOLERANCE, MIN_POINTS = 0.25, -0.25, 0.6, 3


def q(c: Column) -> Column:
    """Millionths, rounded half up: equal in both engines where the last digits of a double are not."""
    return F.floor(c.cast("double") * F.lit(1e6) + F.lit(0.5)).cast("long")


def q_sql(expression: str) -> str:
    return f"CAST(floor(CAST({expression} AS DOUBLE) * 1e6 + 0.5) AS BIGINT)"


def _float(value: float) -> Column:
    return F.lit(value).cast("float")


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat lattice; every 37th point is invalid, every 43rd has no normal."""
    k = F.col("o_orderkey")
    row, col = F.floor(k / WIDTH).cast("int"), (k % WIDTH).cast("int")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        k.alias("idx"), row.alias("row_idx"), col.alias("col_idx"), (col * STEP).cast("float").alias("x"), (row * STEP).cast("float").alias("y"), _float(0.0).alias("z"),
        _float(0.0).alias("nx"), _float(0.0).alias("ny"), F.when(k % 43 == 0, _float(0.0)).otherwise(_float(1.0)).alias("nz"), (k % 37 != 0).alias("valid"),
    )


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lattice with heights in [-0.5, 0.5]; every 41st is invalid, every 50th flipped, every 61st 5 mm up."""
    k = F.col("o_orderkey")
    row, col = F.floor(k / WIDTH).cast("int"), (k % WIDTH).cast("int")
    height = (F.col("o_totalprice") - 250000) / 500000 + F.when(k % 61 == 0, 5.0).otherwise(0.0)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        k.alias("idx"), row.alias("row_idx"), col.alias("col_idx"), (col * STEP).cast("float").alias("x"), (row * STEP).cast("float").alias("y"), height.cast("float").alias("z"),
        _float(0.0).alias("nx"), _float(0.0).alias("ny"), F.when(k % 50 == 0, _float(-1.0)).otherwise(_float(1.0)).alias("nz"), (k % 41 != 0).alias("valid"),
    )


REFERENCE_SQL = f"""reference AS (SELECT o_orderkey AS idx, CAST(o_orderkey // {WIDTH} AS INTEGER) AS row_idx, CAST(o_orderkey % {WIDTH} AS INTEGER) AS col_idx,
  CAST((o_orderkey % {WIDTH}) * {STEP} AS FLOAT) AS x, CAST((o_orderkey // {WIDTH}) * {STEP} AS FLOAT) AS y, CAST(0 AS FLOAT) AS z,
  CAST(0 AS FLOAT) AS nx, CAST(0 AS FLOAT) AS ny, CAST(CASE WHEN o_orderkey % 43 = 0 THEN 0 ELSE 1 END AS FLOAT) AS nz, o_orderkey % 37 <> 0 AS valid FROM orders)"""
SCAN_SQL = f"""scan AS (SELECT o_orderkey AS idx, CAST(o_orderkey // {WIDTH} AS INTEGER) AS row_idx, CAST(o_orderkey % {WIDTH} AS INTEGER) AS col_idx,
  CAST((o_orderkey % {WIDTH}) * {STEP} AS FLOAT) AS x, CAST((o_orderkey // {WIDTH}) * {STEP} AS FLOAT) AS y,
  CAST((o_totalprice - 250000) / 500000 + CASE WHEN o_orderkey % 61 = 0 THEN 5e0 ELSE 0e0 END AS FLOAT) AS z,
  CAST(0 AS FLOAT) AS nx, CAST(0 AS FLOAT) AS ny, CAST(CASE WHEN o_orderkey % 50 = 0 THEN -1 ELSE 1 END AS FLOAT) AS nz, o_orderkey % 41 <> 0 AS valid FROM orders)"""


def bounded_sql(name: str, source: str) -> str:
    """A table with the grid boundary of another: a 4-neighbour is absent, invalid or too far."""
    sides = ((0, -1), (0, 1), (-1, 0), (1, 0))
    joins = " ".join(f"LEFT JOIN {source} n{i} ON n{i}.row_idx = a.row_idx + {r} AND n{i}.col_idx = a.col_idx + {c}" for i, (r, c) in enumerate(sides))
    d = lambda i, c: f"CAST(a.{c} - n{i}.{c} AS DOUBLE)"
    far = " OR ".join(f"n{i}.idx IS NULL OR NOT n{i}.valid OR NOT sqrt({d(i, 'x')} * {d(i, 'x')} + {d(i, 'y')} * {d(i, 'y')} + {d(i, 'z')} * {d(i, 'z')}) <= {BOUNDARY}e0" for i in range(4))
    return f"{name} AS (SELECT a.*, a.valid AND ({far}) AS boundary FROM {source} a {joins})"


def nearest_sql(name: str, queries: str, points: str, radius: float, kind: str = "FLOAT") -> str:
    """(idx, r_idx, d2) of the nearest valid point within the radius, least index on ties; only rows that have one."""
    d = lambda c: f"(CAST(s.{c} AS {kind}) - CAST(r.{c} AS {kind}))"
    limit = f"CAST({radius}e0 AS {kind})"
    near = " AND ".join(f"r.{c} BETWEEN s.{c} - {radius + 0.01}e0 AND s.{c} + {radius + 0.01}e0" for c in "xy")
    return f"""{name}_pairs AS (SELECT s.idx, r.idx AS r_idx, {d('x')} * {d('x')} + {d('y')} * {d('y')} + {d('z')} * {d('z')} AS d2
  FROM (SELECT * FROM {queries} WHERE valid) s JOIN (SELECT * FROM {points} WHERE valid) r ON {near}),
{name} AS (SELECT idx, r_idx, d2 FROM (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY d2, r_idx) AS rn FROM {name}_pairs WHERE d2 <= {limit} * {limit}) WHERE rn = 1)"""


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An unorganized cloud: the first three components of each embedding, times 10."""
    e = F.col("embedding")
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.col("vec_id").alias("idx"), F.lit(None).cast("int").alias("row_idx"), F.lit(None).cast("int").alias("col_idx"), *((e[i].cast("double") * 10).cast("float").alias(c) for i, c in enumerate("xyz")),
        _float(0.0).alias("nx"), _float(0.0).alias("ny"), _float(1.0).alias("nz"), F.lit(True).alias("valid"),
    )


CLOUD_SQL = "cloud AS (SELECT vec_id AS idx, " + ", ".join(f"CAST(CAST(embedding[{i + 1}] AS DOUBLE) * 10 AS FLOAT) AS {c}" for i, c in enumerate("xyz")) + ", TRUE AS valid FROM embeddings)"
