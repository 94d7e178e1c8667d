"""Defect candidates, clusters, region measurement, severity and verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.functions import geometry as g
from scanloom.operators.components import SMALL, sized_components
from scanloom.operators.spatial import indexed, radius_join
from scanloom.storage import cut


def deviation_candidates(field: DataFrame, positive: float, negative: float) -> DataFrame:
    """Valid samples beyond a threshold (strictly), as class bump or dent: bumps and dents in one pass."""
    kind = F.when(F.col("signed_mm") > F.lit(positive), "bump").when(F.col("signed_mm") < F.lit(negative), "dent")
    return field.where("reason = 'valid'").withColumn("class", kind).where("class IS NOT NULL").select("class", "idx", "x", "y", "z", "signed_mm")


def missing_candidates(field: DataFrame) -> DataFrame:
    """Reference samples without any scan point near them."""
    return field.where("reason = 'no_neighbor'").select(F.lit("missing_material").alias("class"), "idx", "x", "y", "z", F.lit(0.0).alias("signed_mm"))


def cluster_edges(candidates: DataFrame, tolerance: float) -> DataFrame:
    """(class, a, b, d2): pairs of candidates of one class within ``tolerance``, a < b."""
    pairs = radius_join(candidates, indexed(candidates, tolerance, keys=["class"]), tolerance, ["class"])
    return pairs.where("idx < r_idx").select("class", F.col("idx").alias("a"), F.col("r_idx").alias("b"), "d2")


def cluster(candidates: DataFrame, tolerance: float, min_points: int, small: int = SMALL) -> DataFrame:
    """Candidates in clusters of at least ``min_points``: class, cluster (its least index), idx, x, y, z, signed_mm, near_mm.

    Clusters are the components of the graph of pairs within ``tolerance``. near_mm is the distance to the nearest other
    member, which is such a pair's by construction. Classes hold disjoint points of their own index space. Pairs are made
    of places, not of points: the candidates at one place are one node, named by the least index, and 0 from one another.
    """
    candidates = cut(candidates)
    places = cut(candidates.groupBy("class", "x", "y", "z").agg(F.min("idx").alias("idx"), F.count("*").alias("copies")))
    edges = cut(cluster_edges(places, tolerance))
    # one index space: index * 4 + class
    code = F.when(F.col("class") == "bump", 0).when(F.col("class") == "dent", 1).otherwise(2)
    links = edges.select((F.col("a") * 4 + code).alias("a"), (F.col("b") * 4 + code).alias("b"))
    labels = sized_components(links, small).select(F.col("id").alias("__id"), F.col("component").alias("__component"))
    both = edges.select("class", F.col("a").alias("i"), "d2").unionByName(edges.select("class", F.col("b").alias("i"), "d2"))
    near = both.groupBy("class", "i").agg(F.sqrt(F.min("d2")).alias("beside_mm")).withColumnRenamed("class", "c")
    marked = places.withColumn("__node", F.col("idx") * 4 + code).join(labels, F.col("__node") == F.col("__id"), "left")
    marked = marked.join(near, (F.col("class") == F.col("c")) & (F.col("idx") == F.col("i")), "left")
    near_mm = F.when(F.col("copies") > 1, 0.0).otherwise(F.col("beside_mm")).alias("near_mm")
    nodes = marked.select("class", "x", "y", "z", F.floor(F.coalesce("__component", "__node") / 4).cast("long").alias("cluster"), near_mm)
    placed = candidates.join(nodes, ["class", "x", "y", "z"]).select("class", "cluster", "idx", "x", "y", "z", "signed_mm", "near_mm")
    large = placed.groupBy(F.col("class").alias("c"), F.col("cluster").alias("k")).agg(F.count("*").alias("n")).where(F.col("n") >= min_points)
    return placed.join(large, (F.col("class") == F.col("c")) & (F.col("cluster") == F.col("k"))).drop("c", "k", "n")


def _vec(prefix: str, aggregate) -> Column:  # noqa: ANN001
    return F.struct(*(aggregate(F.col(c).cast("double")).alias(c) for c in "xyz")).alias(prefix)


def measure(clusters: DataFrame) -> DataFrame:
    """One row per cluster: size, centroid, box, signed statistics (0 for missing material), approximate area."""
    n = F.count("*")
    mean = lambda c: g.stable_sum(c) / n
    s = F.col("signed_mm")
    rows = clusters.withColumn("__a", F.abs(s))
    near = mean(F.col("near_mm"))
    return rows.groupBy("class", "cluster").agg(
        n.alias("point_count"), _vec("centroid", mean), _vec("aabb_min", F.min), _vec("aabb_max", F.max), F.max("__a").alias("max_abs_mm"),
        mean(s).alias("mean_mm"), F.sqrt(mean(s * s)).alias("rms_mm"), g.nearest_rank("__a").alias("p95_abs_mm"),
        F.when(n >= 2, near * near * n).alias("estimated_area_mm2"), F.lit(True).alias("area_is_approximate"),
    )


def class_rank() -> Column:
    return F.when(F.col("class") == "bump", 0).when(F.col("class") == "dent", 1).otherwise(2)


def numbered(regions: DataFrame) -> DataFrame:
    """Regions with ``id``: bumps, dents, missing material, each by least member index. One task numbers the regions, which are few."""
    order = Window.orderBy(class_rank(), "cluster")
    return regions.withColumn("id", (F.row_number().over(order) - 1).cast("int"))


def default_severity(positive: float, negative: float) -> Column:
    """Missing material and deviations of at least twice the larger threshold reject; others warn."""
    limit = 2.0 * max(positive, -negative)
    return F.when((F.col("class") == "missing_material") | (F.col("max_abs_mm") >= F.lit(limit)), "reject").otherwise("warning")


def rule_severity(warning: float | None, reject: float | None) -> Column:
    """Severity by optional bounds on the largest absolute deviation, both inclusive."""
    level = F.lit("info")
    if warning is not None:
        level = F.when(F.col("max_abs_mm") >= F.lit(warning), "warning").otherwise(level)
    if reject is not None:
        level = F.when(F.col("max_abs_mm") >= F.lit(reject), "reject").otherwise(level)
    return level


def verdict(coverage_failed: Column, valid_count: Column, has_reject: Column) -> Column:
    return F.when(coverage_failed | (valid_count == 0), "indeterminate").when(has_reject, "fail").otherwise("pass")
