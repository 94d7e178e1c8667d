"""Registration of clouds beyond memory: what a worker holds, and what goes to disk."""

import numpy as np
import pyarrow as pa
import pytest

import scenes as S
from scanloom.functions import kernels as k
from scanloom.model import RegistrationParameters
from scanloom.operators import registration, spatial
from scanloom.operators.registration import RegistrationContext, covariances
from test_cell_joins import _plans


DATA = "/root/testdata/sf0.001"


class _Frame:
    """Stands for a scan: gives the function that would run on the executors."""

    columns = ["idx", "x", "y", "z", "ord", "block"]

    def mapInArrow(self, f, schema):  # noqa: N802
        return f


def test_blocks_leave_the_worker_as_they_end(spark):
    context = RegistrationContext(S.surface(spark, *S.plane(half=2.0), frame=S.FRAME), RegistrationParameters(10, 1.0, 0.3, 1e-4, 1e-5, 1e-5, "point_to_point"))
    n, taken = 1000, []
    block = np.arange(n) // 7  # batches of 10 rows cut blocks
    z = np.linspace(0.0, 0.5, n)

    def batches():
        for i in range(0, n, 10):
            taken.append(i)
            own = slice(i, i + 10)
            columns = [pa.array(np.arange(n)[own]), pa.array(np.zeros(10)), pa.array(np.zeros(10)), pa.array(z[own]), pa.array(np.arange(n)[own]), pa.array(block[own])]
            yield pa.RecordBatch.from_arrays(columns, names=_Frame.columns)

    run = context.block_equations(_Frame(), np.eye(4))
    seen, sums = [], []
    for out in run(batches()):
        assert len(taken) <= 2 or seen
        assert out.num_rows <= 3
        seen += out.column("block").to_pylist()
        sums += out.column("sums").to_pylist()
    context.close()
    assert seen == sorted(set(block.tolist()))
    assert [s[43] for s in sums] == np.bincount(block).tolist()
    assert np.allclose([s[42] for s in sums], np.bincount(block, z))


def test_k_nearest_is_exact():
    rng = np.random.default_rng(5)
    p = np.repeat(np.round(rng.uniform(0, 6, (300, 3)) * (1, 1, 0.2), 1), 2, axis=0)[rng.permutation(600)]
    d2 = ((p[:, None] - p[None]) ** 2).sum(axis=2)
    want = {i: np.sort(np.lexsort((np.arange(600), d2[i]))[:12]) for i in range(600)}
    for reach in (0.5, 4.0):
        got = {i: n for some, near in k.k_nearest(p, np.arange(600), 12, reach) for i, n in zip(some.tolist(), near)}
        assert len(got) == 600
        for i in range(600):
            assert np.array_equal(got[i], want[i] if (d2[i] <= reach * reach).sum() >= 12 else np.full(12, -1))


def test_covariances_over_several_tiles(spark, monkeypatch):
    """Tiles of few points, copies, and a few points so far away that they are looked up again, by tiles and by joins."""
    monkeypatch.setattr(spatial, "TILE_POINTS", 20)
    rng = np.random.default_rng(6)
    p = np.round(rng.uniform(0, 5, (400, 3)) * (1, 1, 0.2), 1).astype(np.float32)
    p = np.concatenate([p, p[:50], p[:3] + 12, p[:2] + 70]).astype(np.float32)
    d2 = ((p[:, None].astype(float) - p[None]) ** 2).sum(axis=2)
    near = np.array([np.sort(np.lexsort((np.arange(len(p)), d))[:12]) for d in d2])
    want = k.regularized(p[near].astype(float), 0.001).reshape(-1, 9)
    points = S.surface(spark, p, frame=S.FRAME).df.select("idx", *(registration.F.col(c).cast("double") for c in "xyz"))
    for limit in (10**6, 20):
        monkeypatch.setattr(registration, "TILE_POINTS", limit)
        got = {r["idx"]: [r[f"c{i}"] for i in range(9)] for r in covariances(points, 12, 0.001, 0.3).collect()}
        assert len(got) == len(p)
        assert np.allclose([got[i] for i in range(len(p))], want, atol=1e-9)


@pytest.mark.parametrize("method", ["point_to_point", "gicp"])
def test_tiles_find_the_pose_of_the_broadcast_index(spark, monkeypatch, method):
    """No job deals out the cell index, whose copies went to disk in each iteration; tiles are dealt again as the scan moves."""
    monkeypatch.setattr(spatial, "TILE_POINTS", 100)
    parameters = RegistrationParameters(40, 0.2, 0.1, 1e-7, 1e-8, 1e-9, method)
    found, dealt = [], []
    rows = RegistrationContext._tile_rows
    monkeypatch.setattr(RegistrationContext, "_tile_rows", lambda self, *a: dealt.append(a) or rows(self, *a))
    for broadcast in (10**6, 0):
        context = RegistrationContext(S.surface(spark, *S.patch(33, False), frame=S.FRAME), parameters, broadcast_points=broadcast)
        before = max(_plans(spark), default=-1)
        for skin in (1.0,) if broadcast else (1.0, 1e-3):
            monkeypatch.setattr(registration, "SKIN", skin)
            found.append(context.align(S.surface(spark, *S.patch(33, True)), S.identity()))
        plans = [plan for i, plan in _plans(spark).items() if i > before]
        context.close()
    assert not any("__cx" in plan for plan in plans)
    assert len(dealt) > 2
    for m in found[1:]:
        assert (m.convergence, m.iterations, m.valid_pairs) == (found[0].convergence, found[0].iterations, found[0].valid_pairs)
        assert np.allclose(m.final_transform.matrix, found[0].final_transform.matrix, atol=1e-9)


def test_back_facing_filter_deals_by_tiles(spark, monkeypatch):
    """Its rows by brute force, and no job of it deals out the cell index."""
    from scanloom.plans import catalog
    from scanloom.plans import derived as d

    monkeypatch.setattr(spatial, "TILE_POINTS", 100)
    before = max(_plans(spark), default=-1)
    got = sorted(map(tuple, catalog.queries()["back_facing_filter"](spark, DATA).collect()))
    assert not any("__cx" in plan for i, plan in _plans(spark).items() if i > before)
    ref, scan = (np.array([tuple(r) for r in f(spark, DATA).where("valid").select("idx", "x", "y", "z", "nz").orderBy("idx").collect()]) for f in (d.reference, d.scan))
    d2 = ((scan[:, None, 1:4] - ref[None, :, 1:4]) ** 2).sum(axis=2)
    near = d2.argmin(axis=1)
    kept = (d2.min(axis=1) <= d.SEARCH**2) & (scan[:, 4] * ref[near, 4] >= 0)
    assert got == [(int(a), int(b)) for a, b in zip(scan[kept, 0], ref[near[kept], 0])]
