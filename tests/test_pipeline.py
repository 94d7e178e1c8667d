"""Alignment, gates and whole inspections on synthetic scenes."""

import numpy as np
import pytest

import scenes as S
from scanloom.model import InspectionError, RegistrationParameters, RigidTransform
from scanloom.operators.registration import GATE, RegistrationContext, evaluate_gate, gate_failure, select_backend
from scanloom.plans.pipeline import InspectionPipeline, metrics_table
from scanloom.report import serialize_result

# Poses found for the shifted patch, upper three rows.
POSES = {
    "point_to_plane": (7.7139155351063889e-09, [0.99999999999998568, 1.4551115378572414e-14, -1.6920887011115639e-07, 0.003010600629848429, -9.024642577792918e-15, 0.99999999999999944, 3.2660656602394294e-08, -0.0020013210741826057, 1.6920887011115676e-07, -3.2660656602392296e-08, 0.99999999999998535, 0.0099999987936659485]),
    "point_to_point": (7.6267261365844208e-08, [1, -2.9514334392654649e-20, -8.2606465157050444e-11, 0.0030000108722892365, 2.9451162271958817e-23, 1, -3.5693190810581679e-10, -0.0020000318903881679, 8.2606465157050444e-11, 3.5693190810581679e-10, 1, 0.0099999992431144356]),
    "gicp": (7.6302969320950894e-08, [1, 5.4151701490803706e-13, -1.6607571547921101e-10, 0.0030000114865706565, -5.4151712468498177e-13, 1, -6.6100540002328695e-10, -0.0020000337446110057, 1.6607571547885307e-10, 6.6100540002337691e-10, 1, 0.0099999982652406675]),
}


@pytest.mark.parametrize("method,broadcast", [("point_to_plane", 10**6), ("point_to_plane", 0), ("point_to_point", 10**6), ("point_to_point", 0), ("gicp", 10**6)])
def test_frozen_poses(spark, method, broadcast):
    ref = S.surface(spark, *S.patch(33, False), frame=S.FRAME)
    context = RegistrationContext(ref, RegistrationParameters(40, 0.2, 0.1, 1e-7, 1e-8, 1e-9, method), broadcast_points=broadcast)
    m = context.align(S.surface(spark, *S.patch(33, True)), S.identity())
    rmse, pose = POSES[method]
    assert (m.convergence, m.iterations, m.valid_pairs, m.fitness) == ("converged", 2, 1089, 1.0)
    assert np.allclose(m.final_transform.matrix[:12], pose, atol=1e-6) and abs(m.inlier_rmse_mm - rmse) < 1e-6
    with pytest.raises(InspectionError):  # the context stays usable after an error
        context.align(S.surface(spark, *S.patch(33, True), frame="elsewhere"), S.identity())
    assert context.align(S.surface(spark, *S.patch(33, True)), S.identity()) == m
    context.close()


def test_registration_errors(spark):
    flat = S.plane(half=2.0)
    p = RegistrationParameters(10, 1.0, 0.3, 1e-4, 1e-5, 1e-5)
    with pytest.raises(InspectionError):
        RegistrationContext(S.surface(spark, flat[0], frame=S.FRAME), p)  # plane method without normals
    with pytest.raises(InspectionError):
        RegistrationContext(S.surface(spark, *flat, frame=S.FRAME), p, backend="gpu")
    assert select_backend("auto") == "cpu"
    line = np.column_stack([np.arange(30) * 0.1, np.zeros(30), np.zeros(30)])
    with pytest.raises(InspectionError):
        RegistrationContext(S.surface(spark, line, frame=S.FRAME), RegistrationParameters(10, 1.0, 0.3, 1e-4, 1e-5, 1e-5, "gicp"))


def test_partitions_do_not_change_the_pose(spark):
    found = set()
    for n in ("2", "5"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        context = RegistrationContext(S.surface(spark, *S.ripples(), frame=S.FRAME), RegistrationParameters(8, 1.0, 0.3, 1e-4, 1e-5, 1e-5))
        found.add(context.align(S.surface(spark, *S.moved(*S.ripples(), np.linalg.inv(S.turn_z(1, (0.2, 0.1, 0.05))))), S.identity()).final_transform.matrix)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(found) == 1


def test_gate_order_and_bounds(spark):
    from types import SimpleNamespace

    from scanloom.operators.registration import RegistrationMetrics

    t = RigidTransform.identity("a", "b")
    cases = [("converged", 500, 0.7, 0.2, 5.0, 5.0), ("not_converged", 1, 0.0, 9.0, 9.0, 9.0), ("converged", 499, 0.0, 9.0, 9.0, 9.0), ("converged", 500, 0.69, 9.0, 9.0, 9.0), ("converged", 500, 0.7, 0.21, 9.0, 9.0), ("converged", 500, 0.7, 0.2, 5.1, 9.0), ("converged", 500, 0.7, 0.2, 5.0, 5.1)]
    gate = SimpleNamespace(min_valid_pairs=500, min_overlap_ratio=0.7, max_inlier_rmse_mm=0.2, max_translation_from_initial_mm=5.0, max_rotation_from_initial_deg=5.0)
    made = [RegistrationMetrics(t, c, 1, *rest) for c, *rest in cases]
    want = ["none", *GATE]
    assert [evaluate_gate(m, gate) for m in made] == want
    table = gate_failure(metrics_table(spark, made), 500, 0.7, 0.2, 5.0, 5.0)
    assert [r["gate_failure"] for r in table.collect()] == want


@pytest.fixture(scope="module")
def pipeline():
    return InspectionPipeline(S.config())


@pytest.fixture(scope="module")
def flat_context(spark, pipeline):
    context = pipeline.context(S.surface(spark, *S.plane(), frame=S.FRAME))
    yield context
    context.close()


def _business(report):
    return {k: v for k, v in report.items() if k not in ("timings", "provenance")}


def test_identical_passes_and_repeats(spark, flat_context, pipeline):
    first = flat_context.run(S.surface(spark, *S.plane()), run_id="r1")
    assert first["verdict"] == "pass" and first["regions"] == [] and first["deviations"]["max_abs_mm"] <= 1e-5 and first["provenance"]["run_id"] == "r1"
    again = flat_context.run(S.surface(spark, *S.plane()))
    fresh = pipeline.run(S.surface(spark, *S.plane(), frame=S.FRAME), S.surface(spark, *S.plane()))
    assert serialize_result(_business(first)) == serialize_result(_business(again)) == serialize_result(_business(fresh))
    assert [t["stage"] for t in first["timings"]] == ["normalize", "preprocess", "registration", "registration_gate", "transform", "compare", "coverage_gate", "detect"]


def test_rigid_motion_is_found(spark, pipeline):
    turn = S.turn_z(2, (0.5, 0.3, 0.1))
    r = pipeline.run(S.surface(spark, *S.ripples(), frame=S.FRAME), S.surface(spark, *S.moved(*S.ripples(), np.linalg.inv(turn))))
    pose = np.array(r["registration"]["final_pose"]["matrix"]).reshape(4, 4)
    assert r["verdict"] == "pass" and np.abs(pose - turn).max() < 1e-4


@pytest.mark.parametrize("height,kind,centre", [(0.7, "bump", (1.2, -0.8)), (-0.6, "dent", (-2.0, 0.4))])
def test_a_knob_is_found_where_it_stands(spark, flat_context, height, kind, centre):
    r = flat_context.run(S.surface(spark, *S.plane(height, 1.8, *centre)))
    assert r["verdict"] == "fail" and [x["type"] for x in r["regions"]] == [kind]
    region = r["regions"][0]
    assert abs(region["max_abs_mm"] - abs(height)) < 0.05 and region["mean_mm"] * height > 0 and region["severity"] == "reject"
    assert np.hypot(region["centroid"]["x"] - centre[0], region["centroid"]["y"] - centre[1]) < 0.3


def test_two_knobs_are_two_regions(spark, flat_context):
    p, n = S.plane(0.6, 1.5, -3.0, -3.0)
    p[:, 2] += S.plane(-0.6, 1.5, 3.0, 2.0)[0][:, 2]
    r = flat_context.run(S.surface(spark, p, n))
    assert sorted(x["type"] for x in r["regions"]) == ["bump", "dent"]


def test_a_hole_is_missing_material(spark, flat_context):
    p, n = S.plane()
    r = np.hypot(p[:, 0] - 1.0, p[:, 1])
    found = flat_context.run(S.surface(spark, p[r > 2.9], n[r > 2.9]))
    missing = sum(x["point_count"] for x in found["regions"] if x["type"] == "missing_material")
    assert missing >= 0.9 * (r <= 1.4).sum() and found["verdict"] != "pass"


def test_scans_that_cannot_be_judged(spark, flat_context):
    p, n = S.plane()
    lifted = flat_context.run(S.surface(spark, p + [0, 0, 60], n))
    assert lifted["verdict"] == "indeterminate" and lifted["regions"] == []
    quarter = (p[:, 0] < -1) & (p[:, 1] < -1)
    assert flat_context.run(S.surface(spark, p[quarter], n[quarter]))["verdict"] != "pass"
    upside_down = flat_context.run(S.surface(spark, p, -n))
    assert upside_down["deviations"]["valid_count"] == 0 and upside_down["verdict"] != "pass"


def test_unmasked_nan_is_an_error(spark):
    p, n = S.plane()
    p[3, 2] = float("nan")
    with pytest.raises(InspectionError) as error:
        S.surface(spark, p, n)
    assert error.value.code == "invalid_input"
