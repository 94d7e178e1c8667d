"""Single operators against hand-computed values and brute force."""

import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import scenes as S
from scanloom.functions import geometry as g
from scanloom.functions import kernels as k
from scanloom.functions import selection
from scanloom.model import InspectionError, RegistrationParameters, RigidTransform, frame_id, to_millimeters
from scanloom.operators import compare, components, detect, preprocess, registration, spatial
from scanloom.surface import from_points, normalize_surface, validate_surface

NAN = float("nan")


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).orderBy(columns[0]).collect()]


def test_units_and_frames():
    assert to_millimeters(2.0, "meter") == 2000.0 and to_millimeters(5.0, "micrometer") == 0.005
    with pytest.raises(InspectionError):
        to_millimeters(NAN, "meter")
    for bad in ("", "\ud800"):
        with pytest.raises(InspectionError):
            frame_id(bad)


def test_rigid_transform_contract():
    t = RigidTransform.create([0, -1, 0, 1, 1, 0, 0, 2, 0, 0, 1, 3, 0, 0, 0, 1], "a", "b")
    assert t.apply((1.0, 0.0, 0.0)) == (1.0, 3.0, 3.0)
    for broken in ([2, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1], [-1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1], [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 1, 1]):
        with pytest.raises(InspectionError):
            RigidTransform.create(broken, "a", "b")


def test_surface_contract(spark):
    for bad in (dict(points=[]), dict(points=[(0, 0, 0)], normals=[(0, 0, 1)] * 2), dict(points=[(0, 0, 0)], valid=[2]), dict(points=[(NAN, 0, 0)]), dict(points=[(0, 0, 0)], normals=[(NAN, 0, 1)]), dict(points=[(0, 0, 0)] * 4, grid=(2, 2, 1)), dict(points=[(0, 0, 0)] * 4, grid=(2, 2, 3))):
        with pytest.raises(InspectionError):
            from_points(spark, **bad)
    masked = from_points(spark, [(NAN, 0, 0), (1, 2, 3)], valid=[0, 1])
    assert masked.df.count() == 2


def test_normalize_units_frames_and_range(spark):
    s = from_points(spark, [(1, 2, 3)], [(0, 0, 1)], unit="meter")
    out = normalize_surface(s, "fixture")
    assert out.unit == "millimeter" and rows(out.df, "x", "y", "z") == [(1000.0, 2000.0, 3000.0)]
    turn = RigidTransform.create([0, -1, 0, 1, 1, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1], "fixture", "world")
    assert rows(normalize_surface(out, "world", turn).df, "x", "y", "z") == [(-1999.0, 1000.0, 3000.0)]
    with pytest.raises(InspectionError):
        normalize_surface(out, "world")
    with pytest.raises(InspectionError):
        normalize_surface(from_points(spark, [(3e38, 0, 0)], unit="meter"), "fixture")


def test_validity_precedence_and_padding(spark):
    s = from_points(spark, [(0, 0, 0), (1, 1, 1), (NAN, 0, 0), (3, 3, 3), (2, 2, 2)], [(0, 0, 1), (0, 0, 1), (NAN, 0, 0), (0, 0, 1), (NAN, 0, 1)], [1, 0, 0, 1, 0])
    out = preprocess.validity_mask(s, ((0, 0, 0), (2, 2, 2)))
    assert [r[1] for r in rows(out.df, "idx", "invalid_reason")] == ["none", "input_masked", "non_finite_point", "outside_roi", "non_finite_normal"]
    grid = from_points(spark, [(0, 0, 0), (2, 0, 0), (99, 99, 99), (0, 2, 0), (2, 2, 0)], grid=(2, 2, 3))
    assert grid.padding == 1
    reasons = dict(rows(preprocess.storage_reasons(preprocess.validity_mask(grid, ((0, 0, 0), (2, 2, 2)))), "idx", "invalid_reason"))
    assert reasons == {0: "none", 1: "none", 2: "row_padding", 3: "none", 4: "none"}
    with pytest.raises(InspectionError):
        preprocess.validity_mask(grid, ((1, 0, 0), (0, 2, 2)))


def test_voxels(spark):
    x = [-1.2, -0.8, 0.1, 99, 0.9, 1.1, 1.8]
    s = from_points(spark, [(v, 0, 0) for v in x], [(0, 0, 2)] * 7, [1, 1, 1, 0, 1, 0, 1], (3, 2, 4))
    v = preprocess.voxel_sample(s, 1.0)
    got = sorted((r["kx"], round(r["x"], 5), r["nz"], list(r["source_idx"])) for r in v.collect())
    assert got == [(-2, -1.2, 1.0, [0]), (-1, -0.8, 1.0, [1]), (0, 0.5, 1.0, [2, 4]), (1, 1.8, 1.0, [6])]
    offsets = sorted(tuple(r) for r in preprocess.voxel_offsets(v).select("voxel", "start", "end").collect())
    assert offsets == [(0, 0, 1), (1, 1, 2), (2, 2, 4), (3, 4, 5)]
    for size in (0.0, NAN, 1e-30):
        with pytest.raises(InspectionError):
            preprocess.voxel_sample(s, size)


def test_joins_match_brute_force(spark):
    rng = np.random.default_rng(7)
    p = rng.integers(0, 12, (300, 3)) * 0.5  # many ties and duplicates
    q = rng.uniform(0, 6, (200, 3))
    a, b = from_points(spark, p).df, from_points(spark, q).df
    p32, q32 = p.astype(np.float32).astype(float), q.astype(np.float32).astype(float)
    d2 = ((q32[:, None] - p32[None]) ** 2).sum(axis=2)
    want = {i: (int(d2[i].argmin()) if d2[i].min() <= 0.16 else None) for i in range(len(q))}
    for copies in (True, False):
        near = spatial.nearest_join(b, spatial.indexed(a, 0.4, copies=copies), 0.4, kind="double")
        assert dict(rows(near, "idx", "r_idx")) == want
    exact = {r["idx"]: r["p_idx"] for r in spatial.exhaustive_nearest(b, a, 0.4).collect()}
    assert exact == {i: j for i, j in want.items() if j is not None}
    pairs = spatial.radius_join(a.select("idx", "x", "y", "z"), spatial.indexed(a, 0.75), 0.75)
    self2 = ((p32[:, None] - p32[None]) ** 2).sum(axis=2)
    assert {(r["idx"], r["r_idx"]) for r in pairs.collect()} == set(zip(*map(list, np.nonzero(self2 <= 0.5625))))
    knn = {(r["idx"], r["rank"]): r["r_idx"] for r in spatial.knn_join(a, 5, 0.2).collect()}
    for i in range(len(p)):
        order = sorted(range(len(p)), key=lambda j: (self2[i, j], j))[:5]
        assert [knn[i, r + 1] for r in range(5)] == order
    index = k.CellIndex(p32, 0.4)
    assert index.nearest(q32).tolist() == [-1 if want[i] is None else want[i] for i in range(len(q))]


def test_many_points_at_one_place(spark):
    """30,000 points at one place and five beside them: no step makes their pairs, which would be 900 million."""
    n = 30_000
    p = np.zeros((n + 5, 3))
    p[n:, :2] = [(0.5, 0), (0, 0.5), (1, 0), (40, 40), (0.75, 0.75)]
    a = from_points(spark, p).df
    index = spatial.indexed(a, 2.0, ("nz",), copies=False)
    found = spatial.nearest_join(a, index, 2.0, ("nz",), kind="double").groupBy("r_idx").count()
    assert dict(rows(found, "r_idx", "count")) == {0: n} | {n + i: 1 for i in range(5)}
    kernel = k.CellIndex(p, 2.0)
    assert np.array_equal(kernel.nearest(p), np.append(np.zeros(n, np.int64), np.arange(n, n + 5)))
    knn = spatial.knn_join(a, 3, 0.25)
    assert knn.count() == 3 * (n + 5) and rows(knn.where("idx < 30000").select("r_idx").distinct(), "r_idx") == [(0,), (1,), (2,)]
    assert sorted(rows(knn.where(F.col("idx") == n), "rank", "r_idx")) == [(1, n), (2, 0), (3, 1)]
    moments = preprocess.neighbourhood_moments(a, 2.0).where(F.col("idx") == n).first()
    assert moments["n"] == n + 4 and math.isclose(moments["sx"], -0.5 * n - 0.5 + 0.5 + 0.25)
    candidates = a.select(F.lit("bump").alias("class"), "idx", "x", "y", "z", F.lit(1.0).alias("signed_mm"))
    groups = detect.cluster(candidates, 0.6, 1).groupBy("cluster").agg(F.count("*").alias("c"), F.max("near_mm").alias("m"))
    assert {r["cluster"]: (r["c"], r["m"] and round(r["m"], 6)) for r in groups.collect()} == {0: (n + 3, 0.5), n + 3: (1, None), n + 4: (1, None)}


@pytest.mark.parametrize("kind", ["float", "double"])
def test_both_kinds_of_index_agree(spark, kind):
    rng = np.random.default_rng(17)
    p = np.vstack([rng.uniform(0, 4, (300, 3)), rng.integers(0, 8, (200, 3)) * 0.5])
    q = np.vstack([rng.uniform(-1, 5, (200, 3)), rng.integers(0, 8, (200, 3)) * 0.5 + 0.25, [[50, 50, 50]]])
    a, b = from_points(spark, p).df.withColumn("boundary", F.col("idx") % 3 == 0), from_points(spark, q).df
    found = []
    for limit in (1000, 0):
        index = spatial.index_for(a, 0.45, ("nz", "boundary"), kind=kind, limit=limit)
        assert isinstance(index, spatial.KernelIndex) == bool(limit)
        df = spatial.nearest(b, index, 0.45, ("nz", "boundary"), kind=kind)
        found.append(sorted(map(tuple, df.select("idx", "x", "r_idx", "r_distance", "r_x", "r_y", "r_z", "r_nz", "r_boundary").collect())))
    assert found[0] == found[1] and any(r[2] is None for r in found[0])
    nothing = spatial.nearest(b, spatial.index_for(a.limit(0), 0.45, kind=kind), 0.45, kind=kind)
    assert nothing.where("r_idx IS NULL").count() == len(q)


def test_normals_orientation_and_boundary(spark):
    plane = [(i, j, 0) for i in range(5) for j in range(5)]
    s = from_points(spark, plane)
    made = preprocess.prepare(s, 1.5, 5, 1.5)
    r = {x["idx"]: x for x in made.surface.df.collect()}
    assert r[12]["valid"] and abs(abs(r[12]["nz"]) - 1) < 1e-5 and not r[12]["boundary"] and not made.orientation_proven
    assert r[0]["normal_reason"] == "normal_missing" and not r[0]["valid"]
    up = preprocess.prepare(s, 1.5, 5, 1.5, preprocess.Orientation("align", (0, 0, 1)))
    assert up.orientation_proven and all(x["nz"] > 0.99 for x in up.surface.df.where("valid").collect())
    one = preprocess.prepare(from_points(spark, [(0, 0, 0)], [(0, 0, -3)]), 1.0, 3, 1.0, preprocess.Orientation("viewpoint", (0, 0, 10)))
    assert one.surface.df.first()["nz"] == 1.0 and one.orientation_proven
    grid = [(c, r_, 5 if (r_, c) == (1, 2) else 0) for r_ in range(3) for c in range(3)]
    g3 = preprocess.prepare(from_points(spark, grid, [(0, 0, -2)] * 9, grid=(3, 3, 3)), 1.5, 3, 1.5).surface.df
    edge = dict(rows(g3, "idx", "boundary"))
    assert edge[0] and edge[4] and all(x["normal_reason"] == "none" for x in g3.collect())
    with pytest.raises(InspectionError):
        preprocess.prepare(s, 1.5, 2, 1.5)


def _field(spark, values):
    return spark.createDataFrame(values, "signed_mm double, reason string")


def test_summaries(spark):
    f = _field(spark, [(1.0, "valid"), (-2.0, "valid"), (3.0, "valid"), (4.0, "valid"), (9.0, "no_neighbor"), (9.0, "input_invalid")])
    s = compare.deviation_summary(f, padding=2).first()
    assert (s["valid_count"], s["mean_signed_mm"], s["max_abs_mm"], s["p95_abs_mm"], s["no_neighbor"], s["input_invalid"]) == (4, 1.5, 4.0, 4.0, 1, 3)
    assert math.isclose(s["rms_mm"], math.sqrt(7.5), rel_tol=1e-12)
    empty = compare.deviation_summary(_field(spark, [(1.0, "no_neighbor")])).first()
    assert empty["valid_count"] == 0 and empty["mean_signed_mm"] == 0.0 and empty["p95_abs_mm"] == 0.0
    c = compare.coverage_summary(spark.createDataFrame([(r,) for r in ["covered"] * 3 + ["no_neighbor"] * 2 + ["scan_boundary", "input_invalid"]], "reason string")).first()
    assert (c["valid_count"], c["covered_count"], c["coverage_ratio"]) == (6, 3, 0.5)


@pytest.mark.parametrize("small", [1_000_000, 3, 0])
def test_selection_by_rank(spark, small):
    rng = np.random.default_rng(12)
    for values in ([], [2.0], [1.0] * 50, rng.normal(size=400).tolist(), rng.integers(0, 4, 300).astype(float).tolist(), [1.0, 1.0 + 2**-52] * 40, [0.0, 1e300, 5e-324] * 9):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
        for share in (0.0, 0.5, 0.95, 1.0):
            want = sorted(values)[max(math.ceil(share * len(values)), 1) - 1] if values else None
            assert selection.nearest_rank(df, "v", share, small) == want


def test_report_equals_summary(spark):
    rows = [(float(v), "valid" if v > -1 else "no_neighbor") for v in np.random.default_rng(3).normal(size=200)]
    field = _field(spark, rows)
    assert compare.deviation_report(field, 4) == compare.deviation_summary(field, padding=4).first().asDict()


def test_stable_sum_ignores_partitioning(spark):
    values = np.random.default_rng(1).normal(size=5000)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    sums = {df.repartition(n).agg(g.stable_sum(F.col("v"))).first()[0] for n in (1, 3, 7)}
    assert len(sums) == 1 and math.isclose(sums.pop(), values.sum(), abs_tol=1e-8)


def test_deviation_reasons(spark):
    ref = from_points(spark, [(0, 0, 0), (10, 0, 0), (20, 0, 0), (30, 0, 0)], [(0, 0, 2), (0, 0, 0), (0, 0, 1), (0, 0, 1)]).df.withColumn("boundary", F.col("idx") == 3)
    scan = from_points(spark, [(0, 0, 0.5), (10, 0, 0.1), (20, 0, 0.1), (30, 0, 0.1), (40, 0, 0), (0, 0, 0)], [(0, 0, 1), (0, 0, 1), (0, 0, -1), (0, 0, 1), (0, 0, 1), (0, 0, 1)], [1, 1, 1, 1, 1, 0]).df
    out = compare.deviation_field(scan, compare.deviation_index(ref, 1.0), 1.0, 35.0)
    r = {x["idx"]: x for x in out.collect()}
    assert [r[i]["reason"] for i in range(6)] == ["valid", "normal_missing", "normal_mismatch", "reference_boundary", "no_neighbor", "input_invalid"]
    assert r[0]["signed_mm"] == 0.5 and r[0]["euclidean_mm"] == 0.5 and r[2]["normal_angle_deg"] == 180.0


@pytest.mark.parametrize("small", [1_000_000, 0])
def test_components_and_regions(spark, small):
    rng = np.random.default_rng(3)
    points = np.column_stack([rng.uniform(0, 20, (120, 2)), np.zeros(120)]).astype(np.float32)
    df = spark.createDataFrame([("bump" if i % 2 else "dent", i, *map(float, p), 0.5 + i / 100) for i, p in enumerate(points)], "class string, idx long, x float, y float, z float, signed_mm double")
    found = detect.cluster(df, 1.5, 3, small)
    want = {}
    for kind in (0, 1):
        ids = [i for i in range(120) if i % 2 == kind]
        label = {i: i for i in ids}
        d = {(i, j): float(((points[i].astype(float) - points[j]) ** 2).sum()) for i in ids for j in ids if i != j}
        changed = True
        while changed:
            changed = False
            for (i, j), v in d.items():
                if v <= 2.25 and label[j] > label[i]:
                    label[j], changed = label[i], True
        for i in ids:
            if sum(v == label[i] for v in label.values()) >= 3:
                want[i] = (label[i], math.sqrt(min(v for (a, _), v in d.items() if a == i)))
    got = {r["idx"]: (r["cluster"], r["near_mm"]) for r in found.collect()}
    assert got.keys() == want.keys() and all(got[i][0] == want[i][0] and math.isclose(got[i][1], want[i][1], rel_tol=1e-9) for i in got)
    regions = detect.numbered(detect.measure(found)).collect()
    assert sorted(r["id"] for r in regions) == list(range(len(regions)))
    assert [r["class"] for r in sorted(regions, key=lambda r: r["id"])] == sorted(r["class"] for r in regions)
    for r in regions:
        own = [want[i][1] for i in want if want[i][0] == r["cluster"] and (i % 2 == 1) == (r["class"] == "bump")]
        assert r["point_count"] == len(own) and math.isclose(r["estimated_area_mm2"], np.mean(own) ** 2 * len(own), rel_tol=1e-6)


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7)]
    for f in (components.components, components.sized_components):
        got = {r["id"]: r["component"] for r in f(spark.createDataFrame(links, "a long, b long")).collect()}
        assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 140), 100)}
        assert f(spark.createDataFrame([], "a long, b long")).count() == 0


def test_severity_and_verdict(spark):
    df = spark.createDataFrame([("bump", 0.5), ("dent", 0.49), ("missing_material", 0.0)], "class string, max_abs_mm double")
    assert [r[0] for r in df.select(detect.default_severity(0.25, -0.2)).collect()] == ["reject", "warning", "reject"]
    assert [r[0] for r in df.select(detect.rule_severity(0.49, 0.5)).collect()] == ["reject", "warning", "info"]
    assert [r[0] for r in df.select(detect.rule_severity(None, None)).collect()] == ["info"] * 3
    flags = spark.createDataFrame([(True, 5, True), (False, 0, True), (False, 5, True), (False, 5, False)], "c boolean, n long, r boolean")
    assert [r[0] for r in flags.select(detect.verdict(F.col("c"), F.col("n"), F.col("r"))).collect()] == ["indeterminate", "indeterminate", "fail", "pass"]


def test_kernels_against_differences():
    rng = np.random.default_rng(5)
    p, q, n = rng.normal(size=(3, 1, 3))
    n /= np.linalg.norm(n)
    for normal in (n, None):
        a, b, size = k.contributions(p, q, normal, None, 1e9)
        cost = lambda t: sum((lambda e: (normal[0] @ e) ** 2 if normal is not None else e @ e)(k.moved_by_twist(t, np.eye(4))[:3, :3] @ p[0] + t[3:] - q[0]) for _ in (0,)) / 2
        step = 1e-6
        gradient = [(cost(step * e) - cost(-step * e)) / (2 * step) for e in np.eye(6)]
        assert np.allclose(-b[0], gradient, atol=1e-6) and np.allclose(a[0], a[0].T)
    far, _, size = k.contributions(np.array([[3.0, 0, 0]]), np.zeros((1, 3)), None, None, 1.0)
    near, _, _ = k.contributions(np.array([[3.0, 0, 0]]), np.zeros((1, 3)), None, None, 9.0)
    assert np.allclose(far, near / 3.0) and size[0] == 3.0


def test_full_pivot_solve_ranks():
    m = np.diag([4.0, 0.0, 2.0, 0.0, 1.0, 0.0])
    x, rank = k.full_pivot_solve(m, np.array([4.0, 0, 6.0, 0, 5.0, 0]))
    assert rank == 3 and x.tolist() == [1.0, 0, 3.0, 0, 5.0, 0]
    a = np.random.default_rng(2).normal(size=(6, 6))
    b = np.arange(6.0)
    x, rank = k.full_pivot_solve(a, b)
    assert rank == 6 and np.allclose(a @ x, b)


def test_parameter_rules():
    good = dict(max_iterations=5, max_correspondence_distance_mm=1.0, huber_delta_mm=0.1, translation_epsilon_mm=1e-3, rotation_epsilon_rad=1e-3, residual_epsilon_mm=1e-3)
    RegistrationParameters(**good).validate()
    for change in (dict(max_iterations=0), dict(max_iterations=1001), dict(huber_delta_mm=0.0), dict(method="other"), dict(covariance_neighbors=2), dict(covariance_epsilon=1.5)):
        with pytest.raises(InspectionError):
            RegistrationParameters(**{**good, **change}).validate()


def test_validate_surface_rejects_unknown_unit(spark):
    s = from_points(spark, [(0, 0, 0)])
    with pytest.raises(InspectionError):
        validate_surface(type(s)(s.df, "inch", "fixture", False))


def test_cell_joins_never_broadcast_an_index_whose_copies_no_estimate_counts(spark):
    points = S.surface(spark, *S.plane()).df.withColumn("boundary", F.lit(False))
    payload, facing = ("nx", "ny", "nz", "boundary"), spatial.indexed(points, 0.8, ("nx", "ny", "nz"), copies=False)
    index = spatial.indexed(points, 0.8, payload, copies=False)
    assert index.count() > 7 * points.count()
    met = [spatial.nearest_join(points, index, 0.8, payload), spatial.nearest_join(points, facing, 0.8, ("nx", "ny", "nz"), kind="double"), spatial.radius_join(points, index, 0.8), compare.covered(points, index, 0.8), compare.uncovered(points, index, 0.8)]
    for df in met:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_registration_holds_few_copies_of_the_reference_on_the_driver():
    n, names = 20_000, [f"c{i}" for i in range(15)]
    order = np.random.default_rng(3).permutation(n)
    parts = [pa.table({"idx": part, **{c: part * 100.0 + i for i, c in enumerate(names)}}) for part in np.array_split(order, 4)]
    table = pa.concat_tables(parts)
    tracemalloc.start()
    try:
        rows = registration._rows(table, names)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert (rows == np.arange(n)[:, None] * 100.0 + np.arange(15)).all()
    assert peak < 1.5 * rows.nbytes  # side by side at once: 2 copies and more
