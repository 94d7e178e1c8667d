"""Whole inspections with a known truth on a 65 x 65 lattice."""

import numpy as np
import pytest

import scenes as S
from scanloom.plans.pipeline import InspectionPipeline

SIDE, STEP = 65, 0.25


def _flat():
    axis = (np.arange(SIDE) - SIDE // 2) * STEP
    x, y = (a.ravel() for a in np.meshgrid(axis, axis, indexing="ij"))
    return np.column_stack([x, y, np.zeros_like(x)])


@pytest.fixture(scope="module")
def context(spark):
    config = S.config(comparison__max_search_distance_mm=0.8)
    p = _flat()
    made = InspectionPipeline(config).context(S.surface(spark, p, np.tile([0.0, 0.0, 1.0], (len(p), 1)), frame=S.FRAME))
    yield made
    made.close()


def _scan(kind):
    p = _flat()
    r2 = p[:, 0] ** 2 + p[:, 1] ** 2
    keep = np.ones(len(p), dtype=bool)
    if kind in ("bump", "dent"):
        p[:, 2] = (0.7 if kind == "bump" else -0.7) * np.exp(-r2 / 4.5)
    elif kind == "missing":
        keep = r2 > 9
    elif kind == "noise":
        p[:, 2] = np.random.default_rng(5489).uniform(-0.015, 0.015, len(p))
    elif kind == "density":
        keep = (p[:, 0] <= 0) | (np.arange(len(p)) % 2 == 0)
    elif kind == "translated":
        p[:, 2] = -0.1
    elif kind == "bad_pose":
        p[:, 2] = 20.0
    return p[keep]


@pytest.mark.parametrize("kind", ["normal", "bump", "dent", "missing", "noise", "density", "translated", "bad_pose"])
def test_scene(spark, context, kind):
    p = _scan(kind)
    r = context.run(S.surface(spark, p, np.tile([0.0, 0.0, 1.0], (len(p), 1))))
    want = {"bump": "fail", "dent": "fail", "missing": "fail", "bad_pose": "indeterminate"}.get(kind, "pass")
    assert r["verdict"] == want and r["deviations"]["input_invalid"] == 0
    if kind in ("normal", "noise"):
        assert r["deviations"]["max_abs_mm"] <= 0.03 and r["regions"] == []
    if kind in ("bump", "dent"):
        (region,) = r["regions"]
        assert region["type"] == kind and abs(region["max_abs_mm"] - 0.7) <= 0.06 and abs(region["centroid"]["x"]) <= 0.5
        assert (region["mean_mm"] > 0) == (kind == "bump")
    if kind == "missing":
        assert {x["type"] for x in r["regions"]} == {"missing_material"} and r["coverage"]["no_neighbor"] >= 100
    if kind == "translated":
        assert abs(r["registration"]["final_pose"]["matrix"][11] - 0.1) <= 0.002
    if kind == "bad_pose":
        assert r["regions"] == []
