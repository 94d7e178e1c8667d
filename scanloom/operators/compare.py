"""Scan-to-reference signed deviation, reference-to-scan coverage, and their summaries."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions import geometry as g
from scanloom.functions.selection import nearest_rank
from scanloom.operators.spatial import CELL, KernelIndex, index_for, indexed, met, nearest, placed, within

_PAYLOAD = ("nx", "ny", "nz", "boundary")


def deviation_index(reference: DataFrame, search: float, keys: Sequence[str] = ()) -> DataFrame:
    """The reference side of ``deviation_field`` as a table; cache it to compare many scans."""
    return indexed(reference.where("valid"), search, _PAYLOAD, keys, copies=False)


def sized_deviation_index(reference: DataFrame, search: float) -> KernelIndex | DataFrame:
    """The same by size: held by the workers while it is small."""
    return index_for(reference.where("valid"), search, _PAYLOAD)


def signed_distance() -> Column:
    """Offset from the matched point along its normal; the difference is taken in float32, the product in double."""
    n, d = g.vector("r_n"), g.minus(g.vector(), g.vector("r_"))
    return g.dot(n, d) / g.length(n)


def deviation_reason(max_angle: float) -> Column:
    """The first that holds: invalid input, no neighbour, no normal, normals too far apart, boundary; else valid."""
    scan, ref = g.vector("n"), g.vector("r_n")
    size = g.length(scan) * g.length(ref)
    apart = (g.length(scan) > 0) & (g.dot(scan, ref) / size < F.lit(math.cos(math.radians(max_angle))))
    return (
        F.when(~F.col("valid"), "input_invalid")
        .when(F.col("r_idx").isNull(), "no_neighbor")
        .when(~F.coalesce(g.length(ref) > 0, F.lit(False)), "normal_missing")
        .when(F.coalesce(apart, F.lit(False)), "normal_mismatch")
        .when(F.coalesce("r_boundary", F.lit(False)), "reference_boundary")
        .otherwise("valid")
    )


def deviation_field(scan: DataFrame, index: KernelIndex | DataFrame, search: float, max_angle: float, keys: Sequence[str] = ()) -> DataFrame:
    """The scan's rows with euclidean_mm, signed_mm, normal_angle_deg and reason. Values are 0 where they do not apply.

    Invalid rows do not enter the search: they have no cell and join as rows without a partner.
    """
    own = [c for c in scan.columns]
    searched = scan.where("valid")
    matched = nearest(searched, index, search, _PAYLOAD, keys)
    found = matched.withColumn("reason", deviation_reason(max_angle))
    measured = F.col("r_idx").isNotNull() & (g.length(g.vector("r_n")) > 0)
    zero = F.lit(0.0)
    found = found.select(
        *own, F.coalesce("r_distance", zero).alias("euclidean_mm"), F.coalesce(F.when(measured, signed_distance()), zero).alias("signed_mm"),
        F.coalesce(F.when(measured, g.angle_degrees(g.vector("n"), g.vector("r_n"))), zero).alias("normal_angle_deg"), "reason",
    )
    skipped = scan.where("NOT valid").select(*own, zero.alias("euclidean_mm"), zero.alias("signed_mm"), zero.alias("normal_angle_deg"), F.lit("input_invalid").alias("reason"))
    return found.unionByName(skipped)


def coverage_field(reference: DataFrame, scan: DataFrame, search: float, keys: Sequence[str] = (), index: KernelIndex | DataFrame | None = None) -> DataFrame:
    """The reference's rows with distance_mm and reason: invalid input, no neighbour, scan boundary, or covered.

    ``index`` is the scan's side when it is at hand, else it is made as a table.
    """
    own = [c for c in reference.columns]
    index = indexed(scan.where("valid"), search, ("boundary",), keys, copies=False) if index is None else index
    matched = nearest(reference.where("valid"), index, search, ("boundary",), keys)
    reason = F.when(F.col("r_idx").isNull(), "no_neighbor").when(F.coalesce("r_boundary", F.lit(False)), "scan_boundary").otherwise("covered")
    found = matched.select(*own, F.coalesce("r_distance", F.lit(0.0)).alias("distance_mm"), reason.alias("reason"))
    skipped = reference.where("NOT valid").select(*own, F.lit(0.0).alias("distance_mm"), F.lit("input_invalid").alias("reason"))
    return found.unionByName(skipped)


def sized_coverage_index(scan: DataFrame, search: float) -> KernelIndex | DataFrame:
    """The scan's side of ``coverage_field`` by size."""
    return index_for(scan.where("valid"), search, ("boundary",))


def covered(reference: DataFrame, index: DataFrame, search: float) -> DataFrame:
    """The reference rows with a scan point within reach, as a left-semi join on cells."""
    return _semi(reference, index, search, "left_semi")


def uncovered(reference: DataFrame, index: DataFrame, search: float) -> DataFrame:
    """The reference rows without one, as a left-anti join on cells."""
    return _semi(reference, index, search, "left_anti")


def _semi(reference: DataFrame, index: DataFrame, search: float, how: str) -> DataFrame:
    _, near = within(search, "float", ("x", "y", "z"))
    return met(placed(reference, search), index, near, how=how).drop(*CELL)


def deviation_report(field: DataFrame, padding: int = 0) -> dict:
    """``deviation_summary`` of one field of any size, as a dict: the percentile is selected by rank, not gathered."""
    row = deviation_summary(field, padding=padding, percentile=False).first().asDict()
    found = nearest_rank(field.where("reason = 'valid'").select(F.abs("signed_mm").alias("a")), "a")
    names = list(row)
    row["p95_abs_mm"] = 0.0 if found is None else found
    return {n: row[n] for n in [*names[:4], "p95_abs_mm", *names[4:]]}


def deviation_summary(field: DataFrame, keys: Sequence[str] = (), padding: int = 0, percentile: bool = True) -> DataFrame:
    """Count, mean, RMS, largest and 95th percentile absolute deviation of valid samples, and a count per reason.

    The percentile is an aggregate over one group's values: for many scans of moderate size. All 0 without valid samples. Slots between grid rows (``padding``) count as input_invalid.
    """
    good = F.when(F.col("reason") == "valid", F.col("signed_mm"))
    rows = field.withColumns({"__s": good, "__a": F.abs(good)})
    n = F.count("__s")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    counts = [(F.count_if(F.col("reason") == r) + (padding if r == "input_invalid" else 0)).alias(r) for r in ("input_invalid", "no_neighbor", "normal_missing", "normal_mismatch", "reference_boundary")]
    return rows.groupBy(*keys).agg(
        n.alias("valid_count"), zero(g.stable_sum(F.col("__s")) / n).alias("mean_signed_mm"), zero(F.sqrt(g.stable_sum(F.col("__s") * F.col("__s")) / n)).alias("rms_mm"),
        zero(F.max("__a")).alias("max_abs_mm"), *([zero(g.nearest_rank("__a")).alias("p95_abs_mm")] if percentile else []), *counts,
    )


def coverage_summary(field: DataFrame, keys: Sequence[str] = (), padding: int = 0) -> DataFrame:
    """Valid and covered counts, their ratio (0 without valid samples), and a count per reason."""
    n, hit = F.count_if(F.col("reason") != "input_invalid"), F.count_if(F.col("reason") == "covered")
    counts = [(F.count_if(F.col("reason") == r) + (padding if r == "input_invalid" else 0)).alias(r) for r in ("input_invalid", "no_neighbor", "scan_boundary")]
    ratio = F.when(n > 0, hit / F.nullif(n, F.lit(0))).otherwise(F.lit(0.0))
    return field.groupBy(*keys).agg(n.alias("valid_count"), hit.alias("covered_count"), ratio.alias("coverage_ratio"), *counts)


def coverage_failed(summary: DataFrame, minimum: float) -> DataFrame:
    """The summary with the coverage gate's outcome."""
    return summary.withColumn("coverage_failed", F.col("coverage_ratio") < F.lit(minimum))
