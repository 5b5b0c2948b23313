"""Cells within one bin, pieces of points, splits by pivots, half of all pairs: against sums over all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwave.functions import healpix as hp
from pairwave.functions.bins import Bins
from pairwave.operators import sweep as sw
from pairwave.operators.sweep import multipole_rows, pair_rows, sweep


def table(xyz, kappa, weight=None):
    return np.column_stack([np.arange(len(xyz)), xyz, kappa, np.ones(len(xyz)) if weight is None else weight]).astype(float)


def sphere(n, seed):
    v = np.random.default_rng(seed).normal(size=(n, 3))
    return v / np.linalg.norm(v, axis=1)[:, None]


def summed(pivots, around, bins, most=3, counts=-1, pieces=1, same=True, box=None, sides=(), half=False, reach=None):
    plan = sw.Plan(tuple(bins.edges), most, counts, False, same, box, ((0, bins.n),), False, False, reach or bins.rmax, half, sides)
    out = sw.Sums(plan)
    out.block(pivots, iter([[part] for part in np.array_split(around, pieces)]))
    return {(r["what"], r["m"], r["b1"], r["b2"]): np.array([r[k] for k in ("cc", "ss", "sc", "cs")]) for r in out.rows().to_pylist()}, out


def equal(a, b, tolerance=1e-9, keys=lambda k: True):
    scale = max(np.abs(v).max() for v in b.values())
    return all(np.allclose(a.get(k, 0), b.get(k, 0), rtol=tolerance, atol=tolerance * scale) for k in a.keys() | b.keys() if keys(k))


@pytest.mark.parametrize("box", [None, 1.0])
@pytest.mark.parametrize("sides", [(0.01, 0.02, 0.04), (0.005, 0.01, 0.02, 0.04, 0.08), (0.3,)])
def test_counts_and_sums_by_bin_are_those_of_all_points(box, sides):
    rng = np.random.default_rng(4)
    xyz = rng.random((1500, 3)) * [1, 1, 0.1] + [0, 0, 2]
    xyz[:60] = xyz[60:120]  # equal positions
    around = table(xyz, rng.normal(size=1500), rng.integers(1, 4, 1500))
    pivots = around[rng.permutation(1500)[:200]]
    for bins in (Bins(0.02, 0.35, 6), Bins(0.0, 0.3, 4, "linear")):
        exact, _ = summed(pivots, around, bins, 2, box=box)
        got, sums = summed(pivots, around, bins, 2, box=box, sides=sides)
        for k, v in exact.items():
            if k[0] == "pairs":
                assert got[k][0] == v[0] and np.allclose(got[k][1], v[1], rtol=1e-12, atol=1e-9)
        # The monopole needs no angle.
        assert equal(got, exact, 1e-9, lambda k: k[1] == 0)
        assert equal(got, exact, 0.12)
    cut, _ = summed(pivots, around, Bins(0.02, 0.35, 6), -1, box=box, sides=sides, reach=0.2)
    want, _ = summed(pivots, around, Bins(0.02, 0.35, 6), -1, box=box, reach=0.2)
    assert all(cut[k][0] == want[k][0] for k in want)


def test_fewer_samples_where_points_are_dense():
    rng = np.random.default_rng(1)
    xy = rng.random((40_000, 2))
    around, bins = table(np.column_stack([xy, np.zeros(40_000)]), rng.normal(size=40_000) + 1), Bins(0.02, 0.3, 8)
    pivots = around[(np.abs(xy - 0.5) < 0.01).all(1)]
    exact, _ = summed(pivots, around, bins)
    got, sums = summed(pivots, around, bins, sides=(0.01, 0.02, 0.04))
    pairs = sum(exact["pairs", 0, b, 0][0] for b in range(1, 9))
    assert pairs == sum(got["pairs", 0, b, 0][0] for b in range(1, 9)) and sums.samples < 0.5 * pairs
    assert equal(got, exact, 0.02)


def test_pieces_give_the_same_moments():
    rng = np.random.default_rng(7)
    around = table(sphere(3000, 2), rng.normal(size=3000))
    bins = Bins(0.05, 0.6, 5)
    want, _ = summed(around[:150], around, bins, 3, counts=4)
    for pieces in (2, 7):
        assert equal(summed(around[:150], around, bins, 3, counts=4, pieces=pieces)[0], want)
    assert summed(around[:0], around, bins)[1].pairs.sum() == 0 and summed(around, around[:0], bins)[1].pairs.sum() == 0


@pytest.mark.parametrize("box", [None, 1.0])
def test_half_of_all_pairs(box):
    rng = np.random.default_rng(3)
    xyz = np.round(rng.random((700, 3)), 1) + rng.choice([0, 1e-3], (700, 3))  # many equal x, equal positions
    around, bins = table(xyz, rng.normal(size=700)), Bins(0.05, 0.4, 5)
    want, got = (summed(around, around, bins, -1, box=box, half=h)[0] for h in (False, True))
    assert equal(got, want) and all(got[k][0] == want[k][0] for k in want)


def points(spark, xyz, kappa=None):
    return spark.createDataFrame([(k, *map(float, v), 1.0 if kappa is None else float(kappa[k])) for k, v in enumerate(xyz)], "id long, x double, y double, z double, kappa double")


def test_few_pivots_against_a_dense_cluster(spark, monkeypatch):
    """Pivots are dealt out although they are few, and the cluster comes in pieces."""
    rng = np.random.default_rng(2)
    cluster, pivots = points(spark, rng.random((4000, 3)) * 0.05, rng.normal(size=4000)).cache(), points(spark, rng.random((4, 3)) * 0.05)
    bins = Bins(0.001, 0.06, 4)
    want = {tuple(r)[:4]: tuple(r)[4:] for r in sweep(pivots, cluster, bins, 2, same=False).collect()}
    for name, value in (("HOT_PAIRS", 1000), ("PIECE", 500), ("PIECE_PIVOTS", 2)):
        monkeypatch.setattr(sw, name, value)
    salts = []
    plain = sw._split
    monkeypatch.setattr(sw, "_split", lambda *a: salts.append(plain(*a)) or salts[-1])
    got = {tuple(r)[:4]: tuple(r)[4:] for r in sweep(pivots, cluster, bins, 2, same=False).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=1e-9, atol=1e-9) for k in want)
    assert salts[0][0].select("salt").distinct().count() > 1


def test_map_within_bins(spark):
    """A map of NSIDE 16: counts are exact, multipoles near."""
    x, y, z = hp.pix2vec(16, F.col("id"))
    sky = spark.range(hp.nside2npix(16)).select("id", x.alias("x"), y.alias("y"), z.alias("z"), (1.0 + 0.3 * F.cos(F.col("id") * 0.7)).alias("kappa")).cache()
    bins = Bins(0.1, 0.5, 4)
    exact, safe = (sweep(sky, sky, bins, 2, safe=s).cache() for s in (False, True))
    rows = lambda s: [(r["bin"], r["n"], round(r["xi"], 10)) for r in pair_rows(s, bins).orderBy("bin").collect()]
    assert rows(safe) == rows(exact)
    zeta = [{tuple(r)[:3]: r["cc"] + r["ss"] for r in multipole_rows(s, "pivot", sky.count()).collect()} for s in (exact, safe)]
    assert all(abs(zeta[1][k] - v) < (1e-9 if k[0] == 0 else 0.01) for k, v in zeta[0].items())
    with pytest.raises(ValueError):
        sweep(sky, sky, bins, theta=1.0, safe=True)


def test_leaves_hold_as_many_pivots_wherever_they_cluster():
    from pairwave.operators.blocktree import Leaves

    rng = np.random.default_rng(6)
    xyz = np.concatenate([rng.random((1000, 3)), 0.5 + 1e-4 * rng.random((7000, 3)), np.full((100, 3), 0.25)])
    tree = Leaves(xyz, 6)
    assert np.bincount(tree.of(xyz)).max() < 2 * len(xyz) / 64
    near = lambda k: {(int(a), int(n)) for a, n in zip(*tree.reached(xyz[k : k + 1], 0.01), strict=True)}
    leaf = tree.of(xyz)
    for k in (0, 1500, 8050):
        inside = np.flatnonzero(((xyz - xyz[k]) ** 2).sum(1) < 0.01**2)
        assert {int(n) for n in leaf[inside]} <= {n for _, n in near(k)}
    assert (Leaves(xyz[:0], 3).of(xyz) > 0).all()


def test_blocks_by_a_tree_give_the_same_sums(spark, monkeypatch):
    rng = np.random.default_rng(8)
    monkeypatch.setattr(sw, "BLOCK_POINTS", 40)
    xyz = np.concatenate([rng.random((150, 3)), 0.4 + 0.01 * rng.random((250, 3))])
    p, q, bins = points(spark, xyz, rng.normal(size=400)), points(spark, xyz[::3] + 0.003), Bins(0.002, 0.2, 4)
    for a, b, same in ((p, p, True), (p, q, False)):
        want, got = ({tuple(r)[:4]: tuple(r)[4:] for r in sweep(a, b, bins, 2, same=same, blocks=k).collect()} for k in ("grid", "tree"))
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=1e-9, atol=1e-9) for k in want)
    with pytest.raises(ValueError):
        sweep(p, p, bins, box=1.0, blocks="tree")
