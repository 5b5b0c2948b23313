"""Leaves of points beside the sweep's comparison of single pairs: the same counts, sums and multipoles."""

import numpy as np
import pytest

from pairwave.functions.bins import Bins
from pairwave.operators import dense
from pairwave.operators import sweep as sw


def table(xyz, seed=0, weights=False):
    rng = np.random.default_rng(seed)
    return np.column_stack([np.arange(len(xyz)), xyz, rng.normal(size=len(xyz)) + 1, rng.integers(1, 4, len(xyz)) if weights else np.ones(len(xyz))]).astype(float)


def catalog(kind, n, seed=1):
    v = np.random.default_rng(seed).normal(size=(n, 3))
    if kind == "sphere":
        return v / np.linalg.norm(v, axis=1)[:, None]
    if kind == "plane":
        return np.random.default_rng(seed).random((n, 3)) * [1, 1, 0]
    if kind == "lattice":  # many distances that equal an edge, equal positions
        return np.round(np.random.default_rng(seed).random((n, 3)), 1) + 3.0
    return np.concatenate([v[: n // 2] * 0.02, v[n // 2 :]]) + 100


def summed(pivots, around, bins, most, counts, monkeypatch, least, plane=False, same=True, third=None, drop=False, reach=None, pieces=1):
    monkeypatch.setattr(dense, "DENSE", least)
    plan = sw.Plan(tuple(bins.edges), most, counts, plane, same, None, ((0, bins.n),), drop, third is not None, reach or bins.rmax, False, (), True)
    out = sw.Sums(plan)
    out.block(pivots, iter([[part] if third is None else [part, third] for part in np.array_split(around, pieces)]))
    return {(r["what"], r["m"], r["b1"], r["b2"]): np.array([r[k] for k in ("cc", "ss", "sc", "cs")]) for r in out.rows().to_pylist()}


@pytest.mark.parametrize("kind", ["sphere", "plane", "lattice", "clusters"])
@pytest.mark.parametrize(("most", "counts"), [(-1, -1), (0, 0), (3, -1), (2, 4), (-1, 3)])
def test_leaves_give_the_sums_over_pairs(monkeypatch, kind, most, counts):
    if kind == "lattice" and max(most, counts) > 0:
        pytest.skip("points in line with a pivot: rounding decides on which side they are")
    monkeypatch.setattr(dense, "CROSSED", 1e9)
    monkeypatch.setattr(dense, "CERTAIN", 0.0)
    around = table(catalog(kind, 3000), 2, weights=True)
    pivots = around[:400]
    for bins, more in ((Bins(0.2, 0.9, 4), {}), (Bins(0.0, 0.5, 5, "linear"), {}), (Bins(0.05, 0.4, 10), {"reach": 0.3}), (Bins(0.3, 0.7, 2, "linear"), {"third": table(catalog(kind, 2500, 5)), "same": False}), (Bins(0.3, 0.7, 2), {"pieces": 3, "drop": most >= 0})):
        want, got = (summed(pivots, around, bins, most, counts, monkeypatch, least, plane=kind == "plane", **more) for least in (1 << 40, 1))
        assert got.keys() == want.keys()
        for k, v in want.items():
            if k[0] == "counters":
                continue
            if k[0].startswith("pairs"):
                assert got[k][0] == v[0], k
            scale = max(np.abs(w).max() for j, w in want.items() if j[0] == k[0])
            assert np.allclose(got[k], v, rtol=1e-9, atol=1e-11 * scale), (k, got[k], v)
        points = lambda s: sum(v[2] for k, v in s.items() if k[0] == "counters")
        assert points(got) == points(want)


def test_one_id_at_two_places_is_no_pair(monkeypatch):
    around = table(catalog("sphere", 2000))
    around[:50, 0] = around[50:100, 0]
    want, got = (summed(around[:300], around, Bins(0.2, 0.9, 4), -1, -1, monkeypatch, least) for least in (1 << 40, 1))
    assert all((got[k] == v).all() for k, v in want.items() if k[0] == "pairs")


def test_few_points_are_compared_one_by_one(monkeypatch):
    """The work for a denser catalog grows by less than its pairs."""
    bins, looked, pairs = Bins(0.1, 0.4, 3), [], []
    for n in (5_000, 20_000, 80_000):
        around = table(catalog("sphere", n))
        got = summed(around[(around[:, 1:4] @ [0, 0, 1]) > 0.99], around, bins, -1, -1, monkeypatch, 1)
        looked.append(sum(v[0] for k, v in got.items() if k[0] == "counters"))
        pairs.append(sum(v[0] for k, v in got.items() if k[0] == "pairs"))
    assert looked[2] / looked[0] < 0.5 * pairs[2] / pairs[0] and looked[2] < 0.5 * pairs[2]


@pytest.mark.parametrize("kind", ["sphere", "plane", "clusters", "twice"])
def test_triangles_by_angle_are_those_listed(kind):
    """Sorted arms give the sums over triangles, with equal positions too, and for more arms than could be paired."""
    xyz = catalog("sphere" if kind == "twice" else kind, 120)
    around, bins = table(np.concatenate([xyz[:60]] * 2) if kind == "twice" else xyz, 3, weights=True), Bins(0.1, 1.5, 3)
    plan = sw.Plan(tuple(bins.edges), -1, -1, kind == "plane", True, None, ((0, bins.n),), False, False, bins.rmax, angles=8)
    out = sw.Sums(plan)
    out.block(around[:40], iter([[around[:50]], [around[50:]]]))
    want = np.zeros((8, 3, 3))
    for p in around[:40]:
        q = around[(r2 := ((p[1:4] - around[:, 1:4]) ** 2).sum(1)) > bins.edges[0] ** 2]
        q = q[(r2 := ((p[1:4] - q[:, 1:4]) ** 2).sum(1)) < bins.edges[-1] ** 2]
        r2 = ((p[1:4] - q[:, 1:4]) ** 2).sum(1)
        a, b = out._arms(p[:, None], np.zeros(len(q), int), list((p[1:4] - q[:, 1:4]).T))
        c = np.clip(a / np.sqrt(r2), -1, 1)
        phi = np.arctan2(b, a) if kind == "plane" else np.arctan2(np.sqrt(1 - c * c) * np.where(b < 0, -1, 1), c)
        turn = phi[:, None] - phi[None]
        l = np.minimum(((turn - np.floor(turn / (2 * np.pi)) * 2 * np.pi) / (np.pi / 4)).astype(int), 7)
        bin_, k = np.searchsorted(np.array(bins.edges[1:-1]) ** 2, r2, "right"), q[:, 4] * q[:, 5]
        np.add.at(want, (l, *np.broadcast_arrays(bin_[:, None], bin_[None])), p[4] * p[5] * np.outer(k, k))
    assert np.allclose(out.triangles, want, rtol=1e-9, atol=1e-9 * np.abs(want).max())


def test_triangles_of_many_points_in_a_moment(monkeypatch):
    """2,000 pivots with 1,500 million triangles: listed they'd take minutes."""
    around, bins = table(catalog("sphere", 4000)), Bins(0.2, 0.9, 4)
    out = summed(around[:2000], around, bins, 3, 0, monkeypatch, 1)
    n = sum(v[0] for k, v in out.items() if k[0] == "counts")
    far = around[:2000, 1:4] @ around[:, 1:4].T
    far = 2 - 2 * far
    each = ((far > 0.04) & (far < 0.81)).sum(1)
    assert n == (each.astype(float) ** 2).sum() and n > 1e9


def test_all_with_all_is_dealt_to_many_tasks(spark):
    """As many tasks as the session has partitions, though the catalog is one file."""
    from pairwave.operators.pairs import _partitions, brute_pairs

    p = spark.range(50).selectExpr("id", "id * 0.01 AS x", "0.0 AS y", "0.0 AS z").coalesce(1)
    assert brute_pairs(p, p, 0.1).rdd.getNumPartitions() >= _partitions(p)


@pytest.mark.parametrize("kind", ["sphere", "lattice", "clusters"])
def test_two_trees_give_the_sums_over_pairs(monkeypatch, kind):
    """Counts and sums of a walk down two trees, in pieces and with few pairs of cells at once, with ids that occur twice and values that aren't numbers."""
    around = table(catalog(kind, 3000), 2, weights=True)
    around[:20, 0] = around[20:40, 0]
    around[50, 4], around[60, 4], around[70, 1] = np.nan, np.inf, np.nan
    pivots = around[:700]
    for bins, sides, pieces, at_once in ((Bins(0.2, 0.9, 4), (0.02, 0.04, 0.08, 0.16), 1, 1 << 18), (Bins(0.05, 0.4, 10), (0.1, 0.2, 0.4), 3, 500), (Bins(0.0, 0.5, 5, "linear"), (0.5,), 1, 1 << 18)):
        monkeypatch.setattr(sw, "PAIRS_AT_ONCE", at_once)
        monkeypatch.setattr(sw, "PAIRS_KEPT", at_once)
        plan = sw.Plan(tuple(bins.edges), -1, -1, False, True, None, ((0, bins.n),), False, False, bins.rmax, sides=sides, tally=True, two=True)
        out = sw.Sums(plan)
        out.block(pivots, iter([[part] for part in np.array_split(around, pieces)]))
        off = pivots[:, None, 1:4] - around[None, :, 1:4]
        r2 = off[..., 0] * off[..., 0] + off[..., 1] * off[..., 1] + off[..., 2] * off[..., 2]
        i, j = np.nonzero((r2 > bins.edges[0] ** 2) & (r2 < bins.edges[-1] ** 2) & (pivots[:, None, 0] != around[None, :, 0]))
        b = np.searchsorted(np.array(bins.edges[1:-1]) ** 2, r2[i, j], "right")
        weight = pivots[i, 5] * around[j, 5]
        assert (out.pairs[0] == np.bincount(b, weight, bins.n)).all()
        assert np.allclose(out.products[0], np.bincount(b, weight * pivots[i, 4] * around[j, 4], bins.n), rtol=1e-9, equal_nan=True)


def test_two_trees_store_no_pairs(spark, tmp_path, monkeypatch):
    """No frontier of pairs of cells is stored or shuffled: what is written to the folder of checkpoints stays nothing."""
    from pathlib import Path

    from pairwave.operators import trees

    monkeypatch.setattr(sw, "FEWEST", 1)
    xyz = catalog("sphere", 2000)
    df = spark.createDataFrame([(k, *map(float, v), 1.0) for k, v in enumerate(xyz)], "id long, x double, y double, z double, kappa double")
    files = lambda: sum(1 for f in Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")).rglob("part-*"))
    before = files()
    found, levels = trees.two_balls(df, Bins(0.2, 0.9, 4), 0.05, 2)
    r2 = 2 - 2 * xyz @ xyz.T
    assert sum(r["n"] for r in found.collect()) == ((r2 > 0.04) & (r2 < 0.81)).sum()
    told = levels.toPandas()
    assert files() == before and told["accepted"].sum() > 0 and (told["looked_at"] == told["accepted"] + told["opened"]).all()


@pytest.mark.parametrize("kind", ["sphere", "plane"])
@pytest.mark.parametrize(("most", "counts"), [(3, -1), (3, 6), (1, -1), (9, 10)])
def test_angles_of_bins_narrower_than_leaves_go_by_matrices(monkeypatch, kind, most, counts):
    """A leaf of pivots that is wider than the bins: points that several edges may part, and points at a pivot."""
    around = table(catalog(kind, 6000), 2, weights=True)
    pivots = around[np.argsort(((around[:, 1:4] - around[-1, 1:4]) ** 2).sum(1))[:300]]
    for bins, more in ((Bins(0.1, 0.3, 5), {}), (Bins(0.0, 0.4, 7, "linear"), {}), (Bins(0.1, 0.3, 5), {"reach": 0.25, "drop": True})):
        plan = sw.Plan(tuple(bins.edges), most, counts, kind == "plane", True, None, ((0, bins.n),), more.get("drop", False), False, more.get("reach", bins.rmax))
        assert sw.Sums(plan).densely(pivots, [around]) is not None
        want, got = (summed(pivots, around, bins, most, counts, monkeypatch, least, plane=kind == "plane", **more) for least in (1 << 40, 1))
        assert got.keys() == want.keys()
        for k, v in want.items():
            if k[0] == "counters":
                continue
            if k[0].startswith("pairs"):
                assert got[k][0] == v[0], k
            scale = max(np.abs(w).max() for j, w in want.items() if j[0] == k[0])
            assert np.allclose(got[k], v, rtol=1e-9, atol=1e-11 * scale), (k, got[k], v)


def test_blocks_of_a_large_catalog_are_dealt_to_more_tasks(spark, monkeypatch):
    """A session with few partitions doesn't put many blocks into one task."""
    monkeypatch.setattr(sw, "TASK_POINTS", 20, raising=False)
    xyz = catalog("sphere", 2000)
    df = spark.createDataFrame([(k, *map(float, v), 1.0) for k, v in enumerate(xyz)], "id long, x double, y double, z double, kappa double")
    found = sw.sweep(df, df, Bins(0.1, 0.3, 5), 3)
    assert ", 100" in next(line for line in found._jdf.queryExecution().logical().toString().splitlines() if "RepartitionByExpression" in line)
