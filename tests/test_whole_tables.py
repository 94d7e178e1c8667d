"""Registered queries take the whole tables: sf0.01 has ten times the lattice of sf0.001."""

import os

import pytest

from scanloom.plans import catalog
from scanloom.plans import derived as d

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.mark.parametrize("method", ["point_to_plane", "point_to_point", "gicp"])
def test_alignment_of_the_whole_lattice(spark, method):
    found = catalog.queries()[f"icp_{method}"](spark, DATA).collect()[0]
    assert found["valid_pairs"] == d.reference(spark, DATA).count()
    assert found["convergence"] == "converged"
    assert (found["tx_e4"], found["ty_e4"], found["tz_e4"]) == pytest.approx((200, -100, 300), abs=1)


@pytest.mark.parametrize("name", ["ply_binary_scan", "ply_ascii_scan", "pcd_binary_scan", "pcd_ascii_scan"])
def test_whole_scan_through_files(spark, name):
    got = catalog.queries()[name](spark, DATA)
    nz = d.F.col("nz").cast("int").alias("nz")
    want = d.scan(spark, DATA).select("idx", "row_idx", "col_idx", *(d.q(d.F.col(c)).alias(f"{c}_um") for c in "xyz"), nz, "valid")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_grid_is_filled(spark):
    full, height = catalog._grid(d.scan(spark, DATA).where("idx < 1234 AND idx <> 7"))
    assert height == 13 and full.count() == 1300 and full.where("NOT valid AND (idx = 7 OR idx >= 1234)").count() == 67


def test_inspection_of_the_whole_lattice(spark, monkeypatch):
    from scanloom.plans.pipeline import InspectionPipeline

    seen, run = [], InspectionPipeline.run
    monkeypatch.setattr(InspectionPipeline, "run", lambda self, *surfaces: seen.extend((s.df.count(), s.height) for s in surfaces) or run(self, *surfaces))
    rows = catalog.queries()["inspection"](spark, DATA).collect()
    assert seen == [(15000, 150)] * 2
    assert {r["verdict"] for r in rows} == {"fail"}
