"""Registered queries of the inspection engine and their SQL.

Each query applies one operator (or a short chain of them) to surfaces derived from the driver's tables. Values that
differ between engines in the last digits of a double are given in millionths.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.functions import geometry as g
from scanloom.model import InspectionError, RegistrationParameters, RigidTransform, parse_config, validate_config
from scanloom.operators import compare, detect, preprocess, spatial
from scanloom.operators.registration import RegistrationContext, gate_failure
from scanloom.plans import derived as d
from scanloom.plans.derived import q, q_sql
from scanloom.report import sha256_column
from scanloom.surface import Surface, contract_counts, normalize_surface, scaled

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

POSE = (0.8660254037844387, -0.5, 0.0, 1.5, 0.5, 0.8660254037844387, 0.0, -2.25, 0.0, 0.0, 1.0, 0.125, 0.0, 0.0, 0.0, 1.0)
BOX = ((5.0, 5.0, -0.25), (30.0, 40.0, 0.25))


def _register(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return keep


def _step_parameters(method: str) -> RegistrationParameters:
    return RegistrationParameters(40, d.SEARCH, 0.3, 1e-6, 1e-7, 1e-9, method)


def _in_blocks(points: DataFrame, block: Column) -> DataFrame:
    """Points as ``RegistrationContext.block_equations`` takes them."""
    return points.withColumns({"ord": F.col("idx"), "block": block}).repartition("block").sortWithinPartitions("block", "ord")


def _surface(df: DataFrame, unit: str = "millimeter", frame: str = "fixture") -> Surface:
    return Surface(df, unit, frame, True, True)


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


# ---------------------------------------------------------------------------------- projections and filters


@_register(_with(d.SCAN_SQL) + f"SELECT idx, {', '.join(f'''{q_sql(f'CAST(CAST({c} AS DOUBLE) * 1000 AS FLOAT)')} AS {c}_um''' for c in 'xyz')} FROM scan")
def unit_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = normalize_surface(_surface(d.scan(spark, sf_dir), unit="meter"), "fixture").df
    return moved.select("idx", *(q(F.col(c)).alias(f"{c}_um") for c in "xyz"))


def _row_sql(r: int, columns: str = "xyz", move: bool = True) -> str:
    m = [f"{v!r}e0" for v in POSE]
    x, y, z = (f"CAST({c} AS DOUBLE)" for c in (("x", "y", "z") if columns == "xyz" else ("nx", "ny", "nz")))
    return f"(({m[r]} * {x} + {m[r + 1]} * {y}) + {m[r + 2]} * {z})" + (f" + {m[r + 3]}" if move else "")


@_register(_with(d.SCAN_SQL) + f"SELECT idx, {', '.join(f'{q_sql(_row_sql(4 * i))} AS {c}_um' for i, c in enumerate('xyz'))}, {', '.join(f'{q_sql(_row_sql(4 * i, chr(110), False))} AS n{c}_um' for i, c in enumerate('xyz'))} FROM scan")
def rigid_transform_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    pose = RigidTransform.create(POSE, "fixture", "world", 1e-9)
    moved = scaled(_surface(d.scan(spark, sf_dir)), "world", pose)
    return moved.select("idx", *(q(F.col(c)).alias(f"{c}_um") for c in ("x", "y", "z", "nx", "ny", "nz")))


_BOX_SQL = " AND ".join(f"{c} >= CAST({low} AS FLOAT) AND {c} <= CAST({high} AS FLOAT)" for c, low, high in zip("xyz", *BOX))


@_register(_with(d.SCAN_SQL) + f"SELECT idx FROM scan WHERE {_BOX_SQL}")
def roi_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess.roi_filter(d.scan(spark, sf_dir), BOX).select("idx")


_DIRTY_SQL = d.SCAN_SQL + ", dirty AS (SELECT idx, CASE WHEN idx % 97 = 0 THEN CAST('nan' AS FLOAT) ELSE x END AS x, y, z, CASE WHEN idx % 89 = 0 THEN CAST('inf' AS FLOAT) ELSE nz END AS nz, valid FROM scan)"


def _dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    nan, inf = F.lit(float("nan")).cast("float"), F.lit(float("inf")).cast("float")
    return d.scan(spark, sf_dir).withColumns({"x": F.when(F.col("idx") % 97 == 0, nan).otherwise(F.col("x")), "nz": F.when(F.col("idx") % 89 == 0, inf).otherwise(F.col("nz"))})


@_register(_with(_DIRTY_SQL) + f"SELECT idx, CASE WHEN isnan(x) THEN 'non_finite_point' WHEN isinf(nz) THEN 'non_finite_normal' WHEN NOT valid THEN 'input_masked' WHEN NOT ({_BOX_SQL}) THEN 'outside_roi' ELSE 'none' END AS invalid_reason FROM dirty")
def validity_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess.validity_mask(_surface(_dirty(spark, sf_dir)), BOX).df.select("idx", "invalid_reason")


@_register(_with(_DIRTY_SQL) + f"SELECT count(*) AS valid_count FROM dirty WHERE NOT isnan(x) AND NOT isinf(nz) AND valid AND {_BOX_SQL}")
def validity_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess.validity_mask(_surface(_dirty(spark, sf_dir)), BOX).df.agg(F.count_if("valid").alias("valid_count"))


@_register(_with(_DIRTY_SQL) + "SELECT count(*) AS n_points, count(*) FILTER (valid AND isnan(x)) AS bad_points, count(*) FILTER (valid AND isinf(nz)) AS bad_normals FROM dirty")
def surface_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = contract_counts(_surface(_dirty(spark, sf_dir)))
    return counts.select(F.col("n").alias("n_points"), F.col("points").alias("bad_points"), F.col("normals").alias("bad_normals"))


@_register(_with(d.SCAN_SQL) + "SELECT idx, CASE WHEN nz < 0 THEN 1 ELSE CAST(nz AS INTEGER) END AS nz_aligned FROM scan")
def normal_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = preprocess.oriented(d.scan(spark, sf_dir).withColumn("valid", F.lit(True)), preprocess.Orientation("align", (0.0, 0.0, 2.0)))
    return out.select("idx", F.col("nz").cast("int").alias("nz_aligned"))


@_register(_with(d.SCAN_SQL) + "SELECT idx, valid AND (z <> CAST(3 AS FLOAT)) AS oriented, CASE WHEN valid AND CAST(nz AS DOUBLE) * (CAST(3 AS FLOAT) - z) < 0 THEN -CAST(nz AS INTEGER) ELSE CAST(nz AS INTEGER) END AS nz_facing FROM scan")
def viewpoint_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    spot = d.scan(spark, sf_dir).withColumns({"x": F.lit(0.0).cast("float"), "y": F.lit(0.0).cast("float")})
    out = preprocess.oriented(spot, preprocess.Orientation("viewpoint", (0.0, 0.0, 3.0)))
    return out.select("idx", F.col("orientation_valid").alias("oriented"), F.col("nz").cast("int").alias("nz_facing"))


@_register(_with(d.CLOUD_SQL) + f"SELECT idx, {q_sql('sqrt(CAST(x AS DOUBLE) * x + CAST(y AS DOUBLE) * y + CAST(z AS DOUBLE) * z)')} AS length_um, {q_sql('CAST(x AS DOUBLE) * y - CAST(y AS DOUBLE) * z')} AS mixed_um, CASE WHEN abs(CAST(x AS DOUBLE)) <= 0.5 THEN 1000000 ELSE {q_sql('0.5 / abs(CAST(x AS DOUBLE))')} END AS huber_um FROM cloud")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, z = (c.cast("double") for c in g.vector())
    size = F.abs(x)
    huber = F.when(size <= 0.5, F.lit(1.0)).otherwise(F.lit(0.5) / size)
    return d.cloud(spark, sf_dir).select("idx", q(g.length(g.vector())).alias("length_um"), q(x * y - y * z).alias("mixed_um"), q(huber).alias("huber_um"))


# ---------------------------------------------------------------------------------- voxels

_VOXEL = 1.75
_VOXEL_SQL = d.SCAN_SQL + f", vox AS (SELECT {', '.join(f'CAST(floor(CAST({c} AS DOUBLE) / {_VOXEL}e0) AS BIGINT) AS k{c}' for c in 'xyz')}, * FROM scan WHERE valid)"


@_register(_with(_VOXEL_SQL) + f"SELECT kx, ky, kz, count(*) AS n, {', '.join(q_sql(f'CAST(avg(CAST({c} AS DOUBLE)) AS FLOAT)') + f' AS {c}_um' for c in 'xyz')}, CAST(sign(sum(CAST(nz AS DOUBLE))) AS INTEGER) AS nz FROM vox GROUP BY kx, ky, kz")
def voxel_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = preprocess.voxel_sample(_surface(d.scan(spark, sf_dir)), _VOXEL)
    return out.select("kx", "ky", "kz", F.size("source_idx").cast("long").alias("n"), *(q(F.col(c)).alias(f"{c}_um") for c in "xyz"), F.col("nz").cast("int").alias("nz"))


@_register(_with(_VOXEL_SQL) + "SELECT kx, ky, kz, array_to_string(list_sort(list(idx)), ',') AS sources FROM vox GROUP BY kx, ky, kz")
def voxel_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = preprocess.voxel_sample(_surface(d.scan(spark, sf_dir)), _VOXEL)
    return out.select("kx", "ky", "kz", F.array_join(F.col("source_idx").cast("array<string>"), ",").alias("sources"))


@_register(_with(_VOXEL_SQL, "cells AS (SELECT kx, ky, kz, count(*) AS n FROM vox GROUP BY kx, ky, kz)") + 'SELECT kx, ky, kz, row_number() OVER o - 1 AS voxel, CAST(sum(n) OVER o - n AS BIGINT) AS "start", CAST(sum(n) OVER o AS BIGINT) AS "end" FROM cells WINDOW o AS (ORDER BY kx, ky, kz ROWS UNBOUNDED PRECEDING)')
def voxel_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess.voxel_offsets(preprocess.voxel_sample(_surface(d.scan(spark, sf_dir)), _VOXEL))


# ---------------------------------------------------------------------------------- joins


def _nearest(queries: DataFrame, points: DataFrame, radius: float, kind: str = "float") -> DataFrame:
    index = spatial.indexed(points.where("valid"), radius, copies=False)
    return spatial.nearest_join(queries.where("valid"), index, radius, kind=kind)


@_register(_with(d.REFERENCE_SQL, d.SCAN_SQL, d.nearest_sql("near", "scan", "reference", d.SEARCH)) + f"SELECT s.idx, n.r_idx, {q_sql('CAST(sqrt(CAST(n.d2 AS DOUBLE)) AS FLOAT)')} AS distance_um FROM scan s LEFT JOIN near n USING (idx) WHERE s.valid")
def nearest_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _nearest(d.scan(spark, sf_dir), d.reference(spark, sf_dir), d.SEARCH)
    return out.select("idx", "r_idx", q(F.col("r_distance")).alias("distance_um"))


_SHIFTED_SQL = "centres AS (SELECT idx, CAST(x + 0.25 AS FLOAT) AS x, CAST(y + 0.25 AS FLOAT) AS y, CAST(0 AS FLOAT) AS z, valid FROM reference)"


@_register(_with(d.REFERENCE_SQL, _SHIFTED_SQL, d.nearest_sql("near", "centres", "reference", 0.5, "DOUBLE")) + "SELECT c.idx, n.r_idx FROM centres c LEFT JOIN near n USING (idx) WHERE c.valid")
def nearest_tie_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = d.reference(spark, sf_dir)
    centres = ref.withColumns({"x": (F.col("x") + 0.25).cast("float"), "y": (F.col("y") + 0.25).cast("float")})
    return _nearest(centres, ref, 0.5, "double").select("idx", "r_idx")


_RAISED_SQL = "raised AS (SELECT idx, x, y, CAST(CASE WHEN idx % 2 = 0 THEN 0.5 ELSE 0.53125 END AS FLOAT) AS z, valid FROM reference)"


@_register(_with(d.REFERENCE_SQL, _RAISED_SQL, d.nearest_sql("near", "raised", "reference", 0.5)) + "SELECT c.idx, n.r_idx FROM raised c LEFT JOIN near n USING (idx) WHERE c.valid")
def nearest_inclusive_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = d.reference(spark, sf_dir)
    raised = ref.withColumn("z", F.when(F.col("idx") % 2 == 0, F.lit(0.5)).otherwise(F.lit(0.53125)).cast("float"))
    return _nearest(raised, ref, 0.5).select("idx", "r_idx")


_D2 = "(CAST(a.x AS DOUBLE) - b.x) * (CAST(a.x AS DOUBLE) - b.x) + (CAST(a.y AS DOUBLE) - b.y) * (CAST(a.y AS DOUBLE) - b.y) + (CAST(a.z AS DOUBLE) - b.z) * (CAST(a.z AS DOUBLE) - b.z)"


@_register(_with(d.CLOUD_SQL) + f"SELECT a.idx, count(*) AS neighbors FROM cloud a JOIN cloud b ON {_D2} <= 4e0 GROUP BY a.idx")
def radius_neighbor_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cloud = d.cloud(spark, sf_dir)
    pairs = spatial.radius_join(cloud.select("idx", "x", "y", "z"), spatial.indexed(cloud, 2.0), 2.0)
    return pairs.groupBy("idx").agg(F.count("*").alias("neighbors"))


@_register(_with(d.CLOUD_SQL) + f"SELECT idx, r_idx, CAST(rn AS INTEGER) AS rank FROM (SELECT a.idx, b.idx AS r_idx, row_number() OVER (PARTITION BY a.idx ORDER BY {_D2}, b.idx) AS rn FROM cloud a CROSS JOIN cloud b) WHERE rn <= 6")
def knn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.knn_join(d.cloud(spark, sf_dir), 6, 1.0).select("idx", "r_idx", "rank")


@_register(_with(d.REFERENCE_SQL, d.SCAN_SQL, d.nearest_sql("near", "scan", "reference", d.SEARCH, "DOUBLE")) + "SELECT n.idx, n.r_idx FROM near n JOIN scan s USING (idx) JOIN reference r ON r.idx = n.r_idx WHERE CAST(s.nz AS DOUBLE) * r.nz >= 0")
def back_facing_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = RegistrationContext(_surface(d.reference(spark, sf_dir)), _step_parameters("point_to_point"), broadcast_points=0)
    return context.pairs(_surface(d.scan(spark, sf_dir)), np.eye(4))


# ---------------------------------------------------------------------------------- boundaries


@_register(_with(d.SCAN_SQL, d.bounded_sql("bounded", "scan")) + "SELECT idx, boundary FROM bounded")
def grid_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess.grid_boundaries(d.scan(spark, sf_dir), d.BOUNDARY).select("idx", "boundary")


_GAP_SQL = f"""around AS (SELECT a.idx, atan2(CAST(b.x - a.x AS DOUBLE), CAST(b.y - a.y AS DOUBLE)) AS angle FROM pts a JOIN pts b ON b.row_idx BETWEEN a.row_idx - 2 AND a.row_idx + 2
  AND b.col_idx BETWEEN a.col_idx - 2 AND a.col_idx + 2 AND a.idx <> b.idx AND {_D2} <= 0.64e0),
gaps AS (SELECT idx, angle, angle - lag(angle) OVER (PARTITION BY idx ORDER BY angle) AS gap FROM around),
found AS (SELECT idx, count(*) AS n, max(gap) AS gap, min(angle) + 2 * pi() - max(angle) AS wrap FROM gaps GROUP BY idx)"""


@_register(_with(d.REFERENCE_SQL, "pts AS (SELECT * FROM reference WHERE valid)", _GAP_SQL) + "SELECT p.idx FROM pts p LEFT JOIN found f USING (idx) WHERE f.n IS NULL OR f.n < 3 OR greatest(coalesce(f.gap, 0), f.wrap) > pi() / 2 + 1e-9")
def angular_gap_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = d.reference(spark, sf_dir).withColumn("nz", F.lit(1.0).cast("float")).where("valid")
    return preprocess.angular_boundaries(points, d.SEARCH).select("idx")


# ---------------------------------------------------------------------------------- comparison

_DEVIATION_SQL = ", ".join([
    d.REFERENCE_SQL, d.SCAN_SQL, d.bounded_sql("bounded", "reference"), d.nearest_sql("near", "scan", "reference", d.SEARCH),
    """field AS (SELECT s.idx, s.x, s.y, s.z, CASE WHEN r.idx IS NOT NULL AND r.nz > 0 THEN CAST(s.z - r.z AS DOUBLE) ELSE 0e0 END AS signed_mm,
  CASE WHEN NOT s.valid THEN 'input_invalid' WHEN r.idx IS NULL THEN 'no_neighbor' WHEN r.nz = 0 THEN 'normal_missing' WHEN s.nz < 0 THEN 'normal_mismatch' WHEN r.boundary THEN 'reference_boundary' ELSE 'valid' END AS reason
  FROM scan s LEFT JOIN near n USING (idx) LEFT JOIN bounded r ON r.idx = n.r_idx)""",
])
_COVERAGE_SQL = ", ".join([
    d.REFERENCE_SQL, d.SCAN_SQL, d.bounded_sql("bounded", "scan"), d.nearest_sql("near", "reference", "scan", d.SEARCH),
    """cover AS (SELECT r.idx, r.x, r.y, r.z, CASE WHEN NOT r.valid THEN 'input_invalid' WHEN n.r_idx IS NULL THEN 'no_neighbor' WHEN s.boundary THEN 'scan_boundary' ELSE 'covered' END AS reason
  FROM reference r LEFT JOIN near n USING (idx) LEFT JOIN bounded s ON s.idx = n.r_idx)""",
])


def _field(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = preprocess.grid_boundaries(d.reference(spark, sf_dir), d.BOUNDARY)
    return compare.deviation_field(d.scan(spark, sf_dir), compare.deviation_index(ref, d.SEARCH), d.SEARCH, d.ANGLE)


def _cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = preprocess.grid_boundaries(d.scan(spark, sf_dir), d.BOUNDARY)
    return compare.coverage_field(d.reference(spark, sf_dir), scan, d.SEARCH)


@_register(_with(_DEVIATION_SQL) + f"SELECT idx, reason, {q_sql('signed_mm')} AS signed_um FROM field")
def deviation_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _field(spark, sf_dir).select("idx", "reason", q(F.col("signed_mm")).alias("signed_um"))


@_register(_with(_DEVIATION_SQL) + "SELECT reason, count(*) AS n FROM field GROUP BY reason")
def deviation_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _field(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("n"))


_REASONS = ("input_invalid", "no_neighbor", "normal_missing", "normal_mismatch", "reference_boundary")


@_register(_with(_DEVIATION_SQL) + f"SELECT count(*) FILTER (reason = 'valid') AS valid_count, {q_sql('''avg(signed_mm) FILTER (reason = 'valid')''')} AS mean_um, {q_sql('''sqrt(avg(signed_mm * signed_mm) FILTER (reason = 'valid'))''')} AS rms_um, {q_sql('''max(abs(signed_mm)) FILTER (reason = 'valid')''')} AS max_um, {q_sql('''quantile_disc(abs(signed_mm), 0.95) FILTER (reason = 'valid')''')} AS p95_um, " + ", ".join(f"count(*) FILTER (reason = '{r}') AS {r}" for r in _REASONS) + " FROM field")
def deviation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = compare.deviation_summary(_field(spark, sf_dir))
    return s.select("valid_count", q(F.col("mean_signed_mm")).alias("mean_um"), q(F.col("rms_mm")).alias("rms_um"), q(F.col("max_abs_mm")).alias("max_um"), q(F.col("p95_abs_mm")).alias("p95_um"), *_REASONS)


@_register(_with(_COVERAGE_SQL) + "SELECT idx, reason FROM cover")
def coverage_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cover(spark, sf_dir).select("idx", "reason")


@_register(_with(_COVERAGE_SQL) + f"SELECT count(*) FILTER (reason <> 'input_invalid') AS valid_count, count(*) FILTER (reason = 'covered') AS covered_count, {q_sql('''count(*) FILTER (reason = 'covered') / CAST(count(*) FILTER (reason <> 'input_invalid') AS DOUBLE)''')} AS ratio_um, count(*) FILTER (reason = 'covered') / CAST(count(*) FILTER (reason <> 'input_invalid') AS DOUBLE) < 0.9e0 AS coverage_failed FROM cover")
def coverage_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = compare.coverage_failed(compare.coverage_summary(_cover(spark, sf_dir)), 0.9)
    return s.select("valid_count", "covered_count", q(F.col("coverage_ratio")).alias("ratio_um"), "coverage_failed")


@_register(_with(d.REFERENCE_SQL, d.SCAN_SQL, d.nearest_sql("near", "reference", "scan", 0.3)) + "SELECT idx FROM near")
def covered_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = spatial.indexed(d.scan(spark, sf_dir).where("valid"), 0.3, copies=False)
    return compare.covered(d.reference(spark, sf_dir).where("valid"), index, 0.3).select("idx")


@_register(_with(d.REFERENCE_SQL, d.SCAN_SQL, d.nearest_sql("near", "reference", "scan", 0.3)) + "SELECT idx FROM reference WHERE valid AND idx NOT IN (SELECT idx FROM near)")
def uncovered_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = spatial.indexed(d.scan(spark, sf_dir).where("valid"), 0.3, copies=False)
    return compare.uncovered(d.reference(spark, sf_dir).where("valid"), index, 0.3).select("idx")


# ---------------------------------------------------------------------------------- detection

_CANDIDATE_SQL = _DEVIATION_SQL + f", candidates AS (SELECT CASE WHEN signed_mm > {d.POSITIVE} THEN 'bump' ELSE 'dent' END AS class, idx, x, y, z, signed_mm FROM field WHERE reason = 'valid' AND (signed_mm > {d.POSITIVE} OR signed_mm < {d.NEGATIVE}))"
_MISSING_SQL = _COVERAGE_SQL.replace(f"{d.SEARCH}e0", "0.3e0") + ", candidates AS (SELECT 'missing_material' AS class, idx, x, y, z, 0e0 AS signed_mm FROM cover WHERE reason = 'no_neighbor')"


#: Candidates by cells of the tolerance's edge, and with the nine cells that their neighbours can be in: an equi-join finds the pairs.
_CELLS_SQL = f"""cells AS (SELECT *, CAST(floor(CAST(x AS DOUBLE) / {d.TOLERANCE}e0) AS BIGINT) AS cx, CAST(floor(CAST(y AS DOUBLE) / {d.TOLERANCE}e0) AS BIGINT) AS cy FROM candidates),
beside_cells AS (SELECT c.*, c.cx + i.d AS nx, c.cy + j.d AS ny FROM cells c, (VALUES (-1), (0), (1)) i(d), (VALUES (-1), (0), (1)) j(d))"""


def _cluster_sql(candidates: str) -> str:
    """Candidates with their cluster, by transitive closure of pairs within the tolerance."""
    return f"""RECURSIVE {candidates}, {_CELLS_SQL},
edges AS MATERIALIZED (SELECT a.class, a.idx AS i, b.idx AS j, {_D2} AS d2 FROM beside_cells a JOIN cells b ON a.class = b.class AND a.nx = b.cx AND a.ny = b.cy AND a.idx <> b.idx WHERE {_D2} <= {d.TOLERANCE}e0 * {d.TOLERANCE}e0),
reach(class, idx, root) AS (SELECT class, idx, idx FROM candidates UNION SELECT e.class, e.j, r.root FROM reach r JOIN edges e ON e.class = r.class AND e.i = r.idx),
labels AS (SELECT class, idx, min(root) AS cluster FROM reach GROUP BY class, idx),
beside AS (SELECT class, i AS idx, sqrt(min(d2)) AS near_mm FROM edges GROUP BY class, i),
clusters AS (SELECT c.*, l.cluster, n.near_mm, count(*) OVER (PARTITION BY c.class, l.cluster) AS size FROM candidates c JOIN labels l USING (class, idx) LEFT JOIN beside n USING (class, idx) QUALIFY size >= {d.MIN_POINTS}),
regions AS (SELECT class, cluster, count(*) AS point_count, avg(CAST(x AS DOUBLE)) AS cx, avg(CAST(y AS DOUBLE)) AS cy, avg(CAST(z AS DOUBLE)) AS cz, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, max(abs(signed_mm)) AS max_abs_mm, avg(signed_mm) AS mean_mm, sqrt(avg(signed_mm * signed_mm)) AS rms_mm, quantile_disc(abs(signed_mm), 0.95) AS p95_abs_mm, CASE WHEN count(*) >= 2 THEN avg(near_mm) * avg(near_mm) * count(*) END AS area FROM clusters GROUP BY class, cluster) """


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.deviation_candidates(_field(spark, sf_dir), d.POSITIVE, d.NEGATIVE)


def _missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = preprocess.grid_boundaries(d.scan(spark, sf_dir), d.BOUNDARY)
    return detect.missing_candidates(compare.coverage_field(d.reference(spark, sf_dir), scan, 0.3))


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.measure(detect.cluster(_candidates(spark, sf_dir), d.TOLERANCE, d.MIN_POINTS))


@_register(_with(_CANDIDATE_SQL) + "SELECT class, idx FROM candidates")
def bump_dent_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).select("class", "idx")


@_register(_with(_CANDIDATE_SQL, _CELLS_SQL) + f"SELECT a.class, a.idx AS a, b.idx AS b FROM beside_cells a JOIN cells b ON a.class = b.class AND a.nx = b.cx AND a.ny = b.cy AND a.idx < b.idx WHERE {_D2} <= {d.TOLERANCE}e0 * {d.TOLERANCE}e0")
def cluster_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.cluster_edges(_candidates(spark, sf_dir), d.TOLERANCE).select("class", "a", "b")


@_register("WITH " + _cluster_sql(_CANDIDATE_SQL) + "SELECT class, cluster, idx FROM clusters")
def defect_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.cluster(_candidates(spark, sf_dir), d.TOLERANCE, d.MIN_POINTS).select("class", "cluster", "idx")


@_register("WITH " + _cluster_sql(_MISSING_SQL) + "SELECT class, cluster, idx FROM clusters")
def missing_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.cluster(_missing(spark, sf_dir), d.TOLERANCE, d.MIN_POINTS).select("class", "cluster", "idx")


@_register("WITH " + _cluster_sql(_CANDIDATE_SQL) + f"SELECT class, cluster, point_count, {', '.join(f'{q_sql(c)} AS {c}_um' for c in ('cx', 'cy', 'cz', 'x0', 'x1', 'y0', 'y1'))}, {q_sql('max_abs_mm')} AS max_um, {q_sql('mean_mm')} AS mean_um, {q_sql('rms_mm')} AS rms_um, {q_sql('p95_abs_mm')} AS p95_um FROM regions")
def region_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    parts = {"cx": c("centroid.x"), "cy": c("centroid.y"), "cz": c("centroid.z"), "x0": c("aabb_min.x"), "x1": c("aabb_max.x"), "y0": c("aabb_min.y"), "y1": c("aabb_max.y")}
    values = {"max": "max_abs_mm", "mean": "mean_mm", "rms": "rms_mm", "p95": "p95_abs_mm"}
    return _regions(spark, sf_dir).select("class", "cluster", "point_count", *(q(v).alias(f"{k}_um") for k, v in parts.items()), *(q(c(v)).alias(f"{k}_um") for k, v in values.items()))


@_register("WITH " + _cluster_sql(_CANDIDATE_SQL) + f"SELECT class, cluster, {q_sql('area')} AS area_um FROM regions")
def region_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _regions(spark, sf_dir).select("class", "cluster", q(F.col("estimated_area_mm2")).alias("area_um"))


_SEVERITY_SQL = f"CASE WHEN class = 'missing_material' OR max_abs_mm >= {2 * max(d.POSITIVE, -d.NEGATIVE)}e0 THEN 'reject' ELSE 'warning' END"


@_register("WITH " + _cluster_sql(_CANDIDATE_SQL) + f"SELECT CAST(row_number() OVER (ORDER BY class, cluster) - 1 AS INTEGER) AS id, class, cluster, {_SEVERITY_SQL} AS severity, CASE WHEN max_abs_mm >= 0.4e0 THEN 'reject' WHEN max_abs_mm >= 0.3e0 THEN 'warning' ELSE 'info' END AS rule_severity FROM regions")
def region_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = detect.numbered(_regions(spark, sf_dir))
    return numbered.select("id", "class", "cluster", detect.default_severity(d.POSITIVE, d.NEGATIVE).alias("severity"), detect.rule_severity(0.3, 0.4).alias("rule_severity"))


@_register("WITH " + _cluster_sql(_CANDIDATE_SQL) + f", stats AS (SELECT count(*) FILTER (reason = 'valid') AS n FROM field), worst AS (SELECT coalesce(bool_or({_SEVERITY_SQL} = 'reject'), FALSE) AS has_reject, count(*) AS n_regions FROM regions) SELECT n_regions, has_reject, CASE WHEN n = 0 THEN 'indeterminate' WHEN has_reject THEN 'fail' ELSE 'pass' END AS verdict FROM stats, worst")
def verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = _regions(spark, sf_dir).withColumn("severity", detect.default_severity(d.POSITIVE, d.NEGATIVE))
    worst = regions.agg(F.coalesce(F.bool_or(F.col("severity") == "reject"), F.lit(False)).alias("has_reject"), F.count("*").alias("n_regions"))
    stats = compare.deviation_summary(_field(spark, sf_dir)).select("valid_count")
    both = worst.join(F.broadcast(stats))  # one row each
    return both.select("n_regions", "has_reject", detect.verdict(F.lit(False), F.col("valid_count"), F.col("has_reject")).alias("verdict"))


@_register(f"""{_with(_CANDIDATE_SQL)} SELECT class, count(*) AS n FROM (SELECT class FROM candidates UNION ALL SELECT 'missing_material' FROM reference r WHERE r.valid AND NOT EXISTS (SELECT 1 FROM scan s WHERE s.valid AND s.idx = r.idx AND abs(s.z) <= CAST(0.3 AS FLOAT))
  AND NOT EXISTS (SELECT 1 FROM scan s WHERE s.valid AND s.idx <> r.idx AND sqrt((s.x - r.x) * (s.x - r.x) + (s.y - r.y) * (s.y - r.y) + (s.z - r.z) * (s.z - r.z)) <= CAST(0.3 AS FLOAT) AND s.row_idx = r.row_idx AND abs(s.col_idx - r.col_idx) <= 1)) GROUP BY class""")
def union_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _candidates(spark, sf_dir).unionByName(_missing(spark, sf_dir))
    return both.groupBy("class").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------------------------- registration

_JACOBIAN = ("p.y", "-p.x", "0e0", "0e0", "0e0", "1e0")  # cross(p, (0, 0, 1)), then the normal


@_register(_with(d.REFERENCE_SQL, d.SCAN_SQL, "flat AS (SELECT idx, x, y, z, valid FROM reference)", d.nearest_sql("near", "scan", "flat", d.SEARCH, "DOUBLE"),
    "pairs AS (SELECT p.idx // 256 AS block, CAST(p.y AS DOUBLE) AS j0, -CAST(p.x AS DOUBLE) AS j1, CAST(p.z AS DOUBLE) AS r, CASE WHEN abs(CAST(p.z AS DOUBLE)) <= 0.3e0 THEN 1e0 ELSE 0.3e0 / abs(CAST(p.z AS DOUBLE)) END AS w FROM near n JOIN scan p USING (idx))")
    + f"SELECT block, count(*) AS pairs, {', '.join(q_sql(f'sum(w * {e})') + f' AS {n}' for n, e in (('a00', 'j0 * j0'), ('a01', 'j0 * j1'), ('a05', 'j0'), ('a11', 'j1 * j1'), ('a15', 'j1'), ('a55', '1e0'), ('b0', '-r * j0'), ('b1', '-r * j1'), ('b5', '-r')))}, {q_sql('sum(abs(r))')} AS residual FROM pairs GROUP BY block")
def icp_block_equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = RegistrationContext(_surface(d.reference(spark, sf_dir).withColumns({c: F.lit(v).cast("float") for c, v in (("nx", 0.0), ("ny", 0.0), ("nz", 1.0))})), _step_parameters("point_to_plane"))
    block = F.floor(F.col("idx") / 256).cast("long")
    scan = _in_blocks(d.scan(spark, sf_dir).where("valid").select("idx", "x", "y", "z"), block)
    found = context.block_equations(scan, np.eye(4))
    entry = lambda i: F.col("sums")[i]
    matrix = {f"a{i}{j}": entry(6 * i + j) for i, j in ((0, 0), (0, 1), (0, 5), (1, 1), (1, 5), (5, 5))}
    terms = matrix | {f"b{i}": entry(36 + i) for i in (0, 1, 5)}
    return found.select("block", entry(43).cast("long").alias("pairs"), *(q(t).alias(n) for n, t in terms.items()), q(entry(42)).alias("residual"))


_METRICS = [
    ("converged", 500, 0.7, 0.2, 5.0, 5.0), ("not_converged", 1, 0.0, 9.0, 9.0, 9.0), ("converged", 499, 0.7, 0.2, 5.0, 5.0), ("converged", 500, 0.69, 0.2, 5.0, 5.0),
    ("converged", 500, 0.7, 0.21, 5.0, 5.0), ("converged", 500, 0.7, 0.2, 5.01, 5.0), ("converged", 500, 0.7, 0.2, 5.0, 5.01), ("degenerate_input", 0, 0.0, 0.0, 0.0, 0.0),
]


@_register("SELECT i, CASE WHEN c <> 'converged' THEN 'not_converged' WHEN p < 500 THEN 'insufficient_pairs' WHEN f < 0.7e0 THEN 'insufficient_overlap' WHEN r > 0.2e0 THEN 'excessive_residual' WHEN t > 5e0 THEN 'translation_prior' WHEN a > 5e0 THEN 'rotation_prior' ELSE 'none' END AS gate_failure FROM (VALUES " + ", ".join(f"({i}, '{c}', {p}, {f}e0, {r}e0, {t}e0, {a}e0)" for i, (c, p, f, r, t, a) in enumerate(_METRICS)) + ") v(i, c, p, f, r, t, a)")
def registration_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(i, *m) for i, m in enumerate(_METRICS)]
    table = spark.createDataFrame(rows, "i int, convergence string, valid_pairs long, fitness double, inlier_rmse_mm double, translation_delta_mm double, rotation_delta_deg double")
    return gate_failure(table, 500, 0.7, 0.2, 5.0, 5.0).select("i", "gate_failure")


def _aligned(method: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Pose found for the whole lattice, curved and moved by a known pose, in millionths, with its pair count.

        Curvature along y falls with the lattice's length, so that its slopes stay.
        """
        base = d.reference(spark, sf_dir)
        span = (base.agg(F.max("y")).first()[0] or 7.0) / 7.0  # the lattice of the smallest tables is 7 mm long
        x, y = F.col("x").cast("double") - 25, F.col("y").cast("double") - 3 * span
        sx, sy = -0.04 * x, -0.06 / span * y
        size = F.sqrt(sx * sx + sy * sy + 1)
        curved = base.withColumns({"z": (0.02 * x * x + 0.03 / span * y * y).cast("float"), "nx": (sx / size).cast("float"), "ny": (sy / size).cast("float"), "nz": (1 / size).cast("float"), "valid": F.lit(True)})
        shift = curved.withColumns({"x": (F.col("x") - 0.02).cast("float"), "y": (F.col("y") + 0.01).cast("float"), "z": (F.col("z") - 0.03).cast("float")})
        context = RegistrationContext(_surface(curved), RegistrationParameters(40, 0.4, 0.1, 1e-6, 1e-7, 1e-9, method))
        found = context.align(_surface(shift, frame="scanner"), RigidTransform.identity("scanner", "fixture"))
        context.close()
        m = found.final_transform.matrix
        row = (found.convergence, found.iterations, found.valid_pairs, *(int(round(v * 1e4)) for v in (m[3], m[7], m[11])))
        return spark.createDataFrame([row], "convergence string, iterations int, valid_pairs long, tx_e4 long, ty_e4 long, tz_e4 long")

    return run


for _method in ("point_to_plane", "point_to_point", "gicp"):
    _QUERIES[f"icp_{_method}"] = _aligned(_method)


@_register()
def normal_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = preprocess.estimate_normals(d.scan(spark, sf_dir).where("valid"), 1.0, 5)
    return found.select("idx", *(q(F.col(c)).alias(f"{c}_um") for c in ("ex", "ey", "ez")))


@_register()
def gicp_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scanloom.operators.registration import covariances

    points = d.cloud(spark, sf_dir).select("idx", *(F.col(c).cast("double").alias(c) for c in "xyz"))
    found = covariances(points, 12, 0.001, 1.0)
    return found.select("idx", *(q(F.col(f"c{i}")).alias(f"c{i}_um") for i in (0, 4, 8)))


# ---------------------------------------------------------------------------------- reports


@_register("SELECT r_regionkey, sha256(r_name) AS sha256 FROM region")
def sha256_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey", sha256_column("r_name").alias("sha256"))


@_register(_with(_DEVIATION_SQL) + "SELECT idx, printf('%.6f %.6f ', CAST(x AS DOUBLE), CAST(y AS DOUBLE)) || CASE reason WHEN 'valid' THEN 0 WHEN 'input_invalid' THEN 1 WHEN 'no_neighbor' THEN 2 WHEN 'normal_missing' THEN 3 WHEN 'normal_mismatch' THEN 4 ELSE 5 END || ' -1' AS line FROM field")
def attribute_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scanloom.model import DEVIATION_REASONS
    from scanloom.sources.point_files import attribute_line, reason_code

    values = _field(spark, sf_dir).select("idx", "x", "y", "z", F.col("signed_mm").alias("scalar"), reason_code("reason", DEVIATION_REASONS).alias("reason"), F.lit(-1).alias("region_id"))
    field = F.split(attribute_line(), " ")
    return values.select("idx", F.concat_ws(" ", field[0], field[1], field[4], field[5]).alias("line"))


@_register()
def region_report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = detect.numbered(_regions(spark, sf_dir)).withColumn("severity", detect.default_severity(d.POSITIVE, d.NEGATIVE))
    return numbered.select("id", F.to_json(F.struct("id", F.col("class").alias("type"), "point_count", "centroid", "aabb_min", "aabb_max", "max_abs_mm", "mean_mm", "rms_mm", "p95_abs_mm", "estimated_area_mm2", "area_is_approximate", "severity")).alias("region_json"))


_FILE_SQL = _with(d.SCAN_SQL) + f"SELECT idx, row_idx, col_idx, {', '.join(f'{q_sql(c)} AS {c}_um' for c in 'xyz')}, CAST(nz AS INTEGER) AS nz, valid FROM scan"


def _grid(df: DataFrame) -> tuple[DataFrame, int]:
    """A lattice with its height; places without a row get an invalid point, so that the grid is full."""
    found = df.agg(F.coalesce(F.max("idx"), F.lit(-1)).alias("last"), F.count("*").alias("n")).first()
    height = found["last"] // d.WIDTH + 1
    if found["n"] == height * d.WIDTH:
        return df, height
    k, zero = F.col("idx"), F.lit(0.0).cast("float")
    row, col = F.floor(k / d.WIDTH).cast("int"), (k % d.WIDTH).cast("int")
    pad = df.sparkSession.range(height * d.WIDTH).select(F.col("id").alias("idx")).join(df.select("idx"), "idx", "left_anti")
    values = {"row_idx": row, "col_idx": col, "x": (col * d.STEP).cast("float"), "y": (row * d.STEP).cast("float"), "z": zero, "nx": zero, "ny": zero, "nz": F.lit(1.0).cast("float"), "valid": F.lit(False)}
    return df.unionByName(pad.withColumns(values)), height


def _through_file(kind: str, encoding: str) -> Query:
    """Write the scan's whole lattice as a point file and read it back through the data source."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from scanloom import storage
        from scanloom.sources import point_files

        scan = d.scan(spark, sf_dir)
        full, height = _grid(scan)
        surface = Surface(full, "millimeter", "scanner", True, True, d.WIDTH, height, d.WIDTH)
        path = f"{storage.scratch(spark, 'files')}/scan.{kind}"
        write, read = (point_files.write_ply, point_files.read_ply) if kind == "ply" else (point_files.write_pcd, point_files.read_pcd)
        write(surface, path, encoding)
        back = read(spark, path, "millimeter", "scanner", rows=400)
        found = back.df if full is scan else back.df.join(scan.select("idx"), "idx", "left_semi")
        return found.select("idx", "row_idx", "col_idx", *(q(F.col(c)).alias(f"{c}_um") for c in "xyz"), F.col("nz").cast("int").alias("nz"), "valid")

    return run


for _kind, _encoding in (("ply", "binary"), ("ply", "ascii"), ("pcd", "binary"), ("pcd", "ascii")):
    _QUERIES[f"{_kind}_{_encoding}_scan"] = _through_file(_kind, _encoding)
    _SQL[f"{_kind}_{_encoding}_scan"] = _FILE_SQL


CONFIG = {
    "schema_version": "1.0", "profile": "catalog",
    "input": {"reference_unit": "millimeter", "scan_unit": "millimeter", "reference_frame": "fixture", "scan_frame": "scanner"},
    "preprocess": {"voxel_size_mm": 0.5, "normal_radius_mm": 1.0, "normal_min_neighbors": 5, "boundary_radius_mm": 0.8},
    "registration": {"method": "point_to_plane", "max_iterations": 30, "max_correspondence_distance_mm": 0.8, "huber_delta_mm": 0.1, "translation_epsilon_mm": 1e-4, "rotation_epsilon_rad": 1e-5, "residual_epsilon_mm": 1e-6},
    "registration_gate": {"min_overlap_ratio": 0.5, "max_inlier_rmse_mm": 0.5, "min_valid_pairs": 100, "max_translation_from_initial_mm": 5.0, "max_rotation_from_initial_deg": 5.0},
    "comparison": {"max_search_distance_mm": 0.8, "max_normal_angle_deg": 35.0, "boundary_exclusion_mm": 0.6, "min_valid_coverage_ratio": 0.5},
    "detection": {"positive_threshold_mm": 0.25, "negative_threshold_mm": -0.25, "cluster_tolerance_mm": 0.6, "min_cluster_points": 5, "measurement_error_budget_mm": 0.0},
    "execution": {"backend": "auto", "deterministic": True, "thread_count": 1, "random_seed": 1},
}


@_register()
def inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One whole inspection: the whole lattice with a raised square against the flat lattice."""
    from scanloom.plans.pipeline import InspectionPipeline

    base, height = _grid(d.reference(spark, sf_dir).withColumns({"valid": F.lit(True), "nz": F.lit(1.0).cast("float")}))
    square = F.col("col_idx").between(40, 46) & F.col("row_idx").between(4, 9)
    raised = base.withColumn("z", F.when(square, F.lit(0.6)).otherwise(F.lit(0.0)).cast("float"))
    config = parse_config(json.dumps(CONFIG))
    grid = (d.WIDTH, height, d.WIDTH)
    report = InspectionPipeline(config).run(Surface(base, "millimeter", "fixture", True, True, *grid), Surface(raised, "millimeter", "scanner", True, True, *grid))
    rows = [(report["verdict"], r["id"], r["type"], r["point_count"], r["severity"]) for r in report["regions"]] or [(report["verdict"], None, None, None, None)]
    return spark.createDataFrame(rows, "verdict string, id int, type string, point_count long, severity string")


_CHANGES = (("none", "", "", None), ("preprocess", "voxel_size_mm", "preprocess.voxel_size_mm", 0.0), ("comparison", "max_normal_angle_deg", "comparison.max_normal_angle_deg", 91.0), ("detection", "measurement_error_budget_mm", "detection.positive_threshold_mm", 0.25), ("execution", "thread_count", "execution.thread_count", 0))


@_register("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{found}')" for i, (_, _, found, _) in enumerate(_CHANGES)) + ") v(i, problem)")
def config_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first problem of each of some configurations; empty for a good one."""
    rows = []
    for i, (section, name, _, value) in enumerate(_CHANGES):
        document = json.loads(json.dumps(CONFIG))
        if name:
            document[section][name] = value
        try:
            validate_config(parse_config(json.dumps(document)))
            rows.append((i, ""))
        except InspectionError as error:
            rows.append((i, error.context["field"]))
    return spark.createDataFrame(rows, "i int, problem string")


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan points with the frame they came in: 25 columns of the lattice each."""
    return d.scan(spark, sf_dir).withColumn("scan_id", F.floor(F.col("col_idx") / 25).cast("int"))


@_register(_with(_DEVIATION_SQL) + f"SELECT CAST((idx % {d.WIDTH}) // 25 AS INTEGER) AS scan_id, count(*) FILTER (reason = 'valid') AS valid_count, {q_sql('''max(abs(signed_mm)) FILTER (reason = 'valid')''')} AS max_um FROM field GROUP BY 1")
def many_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many scans in one job: the scan's id is part of every key after the join."""
    ref = preprocess.grid_boundaries(d.reference(spark, sf_dir), d.BOUNDARY)
    field = compare.deviation_field(_frames(spark, sf_dir), compare.deviation_index(ref, d.SEARCH), d.SEARCH, d.ANGLE)
    return compare.deviation_summary(field, ["scan_id"]).select("scan_id", "valid_count", q(F.col("max_abs_mm")).alias("max_um"))


@_register(_SQL["many_scans"])
def streamed_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same frames through a file stream, each micro-batch compared with the prepared reference."""
    from scanloom import storage
    from scanloom.streaming import scans

    ref = preprocess.grid_boundaries(d.reference(spark, sf_dir), d.BOUNDARY)
    folder = storage.scratch(spark, "frames")
    _frames(spark, sf_dir).repartition("scan_id").write.parquet(f"{folder}/in")
    out = scans.summarize_stream(spark, f"{folder}/in", ref, d.SEARCH, d.ANGLE, f"{folder}/out")
    return out.select("scan_id", "valid_count", q(F.col("max_abs_mm")).alias("max_um"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalize, join nearest, classify, cluster, measure, grade: the regions of one inspection."""
    return region_severity(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
