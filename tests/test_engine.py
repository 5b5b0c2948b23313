"""Properties of the operators, by hand-made points and by other ways to the same numbers."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairwave import catalog as c
from pairwave.functions import geometry as g
from pairwave.functions import healpix as hp
from pairwave.functions import numeric
from pairwave.functions.bins import Bins
from pairwave.operators import cells, compare, counts, synthesis, threepoint, twopoint
from pairwave.operators import sweep as sw
from pairwave.operators.pairs import best_side, brute_pairs, grid_pairs
from pairwave.operators.sweep import multipole_rows, pair_rows, sweep
from pairwave.plans import derived as d


def points(spark, xyz, kappa=None):
    kappa = [1.0] * len(xyz) if kappa is None else kappa
    return spark.createDataFrame([(i, *map(float, p), float(k)) for i, (p, k) in enumerate(zip(xyz, kappa, strict=True))], "id long, x double, y double, z double, kappa double")


def key(df):
    return sorted((r["pid"], r["qid"], round(r["r2"], 12)) for r in df.select("pid", "qid", "r2").collect())


def random_points(n, seed, scale=1.0):
    return np.random.default_rng(seed).random((n, 3)) * scale


@pytest.mark.parametrize("box", [None, 1.0])
@pytest.mark.parametrize("size", [None, 0.05, 0.4])
def test_grid_join_gives_the_pairs_of_all_with_all(spark, box, size):
    p, q = points(spark, random_points(60, 1)), points(spark, random_points(50, 2))
    assert key(grid_pairs(p, q, 0.23, box=box, size=size, same=False)) == key(brute_pairs(p, q, 0.23, box=box, same=False))


def test_split_cells_lose_no_pair(spark):
    p = points(spark, random_points(80, 3, 0.1))
    assert key(grid_pairs(p, p, 0.05, hot=50)) == key(brute_pairs(p, p, 0.05))


def sums_of(df):
    return {(r["what"], r["m"], r["b1"], r["b2"]): r[4:8] for r in df.collect()}


def same_sums(a, b):
    a, b = sums_of(a), sums_of(b)
    assert all(np.allclose(a.get(k, (0,) * 4), b.get(k, (0,) * 4), rtol=1e-9, atol=1e-9) for k in a.keys() | b.keys())


@pytest.mark.parametrize("box", [None, 1.0])
@pytest.mark.parametrize("seed", [1, 2])
def test_sweep_is_the_sum_over_pairs(spark, box, seed, monkeypatch):
    rng = np.random.default_rng(seed)
    p, q, bins = points(spark, random_points(70, seed), rng.random(70)), points(spark, random_points(60, 9), rng.random(60)), Bins(0.05, 0.3, 3)
    for wide, at_once, cell in ((sw.WIDE, sw.AT_ONCE, sw.CELL_POINTS), (1, 64, 1), (0.2, 1 << 18, 4)):
        for name, value in (("WIDE", wide), ("AT_ONCE", at_once), ("CELL_POINTS", cell)):
            monkeypatch.setattr(sw, name, value)
        for a, b, same in ((p, p, True), (p, q, False)):
            sums = sweep(a, b, bins, 2, counts=3, box=box, same=same, squares=True).cache()
            pairs = grid_pairs(a, b, bins.rmax, box=box, same=same)
            n = counts.pair_counts(pairs, bins)
            assert [(r["bin"], r["n"]) for r in pair_rows(sums, bins).orderBy("bin").collect()] == [(r["bin"], r["n"]) for r in n.orderBy("bin").collect()]
            found = threepoint.moments(pairs, bins, 2)
            ones = threepoint.moments(pairs, bins, 3, weight=F.lit(1.0), field=F.lit(1.0))
            key = lambda df: {tuple(r[:3]): r[3:] for r in df.collect()}
            for got, want in ((multipole_rows(sums, "pivot", 70), threepoint.multipoles(found, 2, 70)), (multipole_rows(sums, "plain"), threepoint.multipoles(found, 2, 70, norm="none")), (multipole_rows(sums, "counts"), threepoint.multipoles(ones, 3, 70, norm="none")), (multipole_rows(sums, "plain", None, True), threepoint.multipoles(found, 2, 70, norm="none", drop_degenerate=True))):
                got, want = key(got), key(want)
                assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=1e-8, atol=1e-8) for k in want)


def test_sweep_splits_hot_blocks_and_takes_empty_catalogs(spark, monkeypatch):
    p, bins = points(spark, random_points(90, 3, 0.1)), Bins(0.01, 0.05, 3)
    want = sweep(p, p, bins, 2).cache()
    want.count()
    monkeypatch.setattr(sw, "HOT_PAIRS", 50)
    same_sums(sweep(p, p, bins, 2), want)
    none = p.limit(0)
    for a, b in ((none, p), (p, none), (none, none)):
        assert [r["n"] for r in pair_rows(sweep(a, b, bins, 2), bins).collect()] == [0, 0, 0]


def test_cells_stand_for_points_within_an_error(spark):
    """The finer the opening angle, the nearer to the exact sums; with cells of one point they are exact."""
    xyz, k = on_sphere(3000, 4), np.random.default_rng(5).random(3000) + 1.0
    p, bins = points(spark, xyz, k), Bins(0.05, 0.6, 5)
    exact = sums_of(sweep(p, p, bins, 2))
    errors = []
    for theta in (1.0, 0.3):
        got = sums_of(sweep(p, p, bins, 2, theta=theta, cell=0.02))
        errors.append(max(abs(got["pivot", 0, a, b][0] / exact["pivot", 0, a, b][0] - 1) for a in range(1, 6) for b in range(1, 6)))
        assert abs(sum(got["pairs", 0, b, 0][0] for b in range(1, 6)) / sum(exact["pairs", 0, b, 0][0] for b in range(1, 6)) - 1) < 0.02
    assert errors[1] < 0.01 and errors[0] < 0.05
    tiny = sums_of(sweep(p, p, bins, 2, theta=1e-4, cell=1e-7))
    assert all(np.allclose(tiny[key], exact[key], rtol=1e-6, atol=1e-6) for key in exact)


def test_levels_of_cells():
    bins = Bins(0.1, 1.6, 4)
    assert sw.cell_levels(bins, 0.0, "default", 0.01) == [(0.0, 0, 4)] == sw.cell_levels(bins, 1.0, "exact", 0.01)
    levels = sw.cell_levels(bins, 1.0, "bh86", 0.15)
    assert levels == [(0.0, 0, 1), (0.15, 1, 2), (0.3, 2, 3), (0.6, 3, 4)]
    for side, first, last in levels:
        assert all(cells.opening(side, 1.0, "bh86") <= bins.edges[b] for b in range(first, last))


def test_negative_coordinates_and_cell_edges(spark):
    p = points(spark, [(0, 0, 0), (-0.5, 0, 0), (0.5, 0, 0), (1.0, 0, 0), (-1.0, 0, 0), (0, 0.5, -0.5)])
    assert key(grid_pairs(p, p, 0.8, size=0.5)) == key(brute_pairs(p, p, 0.8))


def test_periodic_counts_do_not_change_with_translation(spark):
    xyz, bins = random_points(100, 4), Bins(0.0, 0.2, 5, "linear")
    a, b = ([r["n"] for r in counts.pair_counts(grid_pairs(p, p, 0.2, box=1.0), bins).orderBy("bin").collect()] for p in (points(spark, xyz), points(spark, (xyz + [0.37, 0.61, 0.05]) % 1.0)))
    assert a == b


def test_a_radius_beyond_half_the_box_is_refused(spark):
    p = points(spark, random_points(5, 1))
    with pytest.raises(ValueError):
        grid_pairs(p, p, 0.6, box=1.0)


def test_two_points_and_empty_bins(spark):
    p = points(spark, [(0, 0, 0), (0.31, 0, 0)], [2.0, 3.0])
    rows = twopoint.auto(p, Bins(0.1, 0.5, 4, "linear"), symmetric=False).orderBy("bin").collect()
    assert [(r["n"], r["xi"]) for r in rows] == [(0, 0), (0, 0), (2, 6.0), (0, 0)]


def test_no_points(spark):
    p = points(spark, [(0, 0, 0)]).limit(0)
    assert [r["n"] for r in counts.pair_counts(grid_pairs(p, p, 0.5), Bins(0.1, 0.5, 3)).collect()] == [0, 0, 0]


def test_doubling_a_catalog_scales_counts_by_four(spark):
    p, bins = points(spark, random_points(60, 5)), Bins(0.05, 0.4, 4)
    twice = p.union(p.withColumn("id", F.col("id") + 1000))
    a, b = ([r["n"] for r in counts.pair_counts(grid_pairs(x, x, 0.4), bins).orderBy("bin").collect()] for x in (p, twice))
    assert b == [4 * n for n in a]


def test_constant_field_correlates_with_one(spark, data):
    s = c.constant_field(d.sphere(spark, data("0.001")), 1.0)
    assert all(r["xi"] == 1.0 for r in twopoint.auto(s, Bins(0.1, 0.4, 5)).where("n > 0").collect())


@settings(max_examples=40, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.floats(0.01, 1.0), st.floats(1.1, 50.0), st.integers(1, 30), st.floats(0.001, 100.0))
def test_bins_by_comparison_are_bins_by_logarithm(rmin, times, n, r):
    b = Bins(rmin, rmin * times, n)
    e = b.edges
    assert len(e) == n + 1 and all(x < y for x, y in zip(e, e[1:])) and all(lo < m < hi for lo, hi, m in zip(e, e[1:], b.centers))
    if e[0] * 1.000001 < r < e[-1] * 0.999999:
        k = 1 + sum(r * r >= x * x for x in e[1:-1])
        assert abs(k - (math.log10(r / rmin) / b.width + 1)) <= 1 + 1e-6 and e[k - 1] <= r * (1 + 1e-12)


def zeta_of(spark, xyz, kappa, bins, most, **kw):
    p = points(spark, xyz, kappa)
    return threepoint.multipoles(threepoint.moments(grid_pairs(p, p, bins.rmax), bins, most), most, p.count(), **kw)


def on_sphere(n, seed):
    v = np.random.default_rng(seed).normal(size=(n, 3))
    return v / np.linalg.norm(v, axis=1)[:, None]


def test_multipoles_are_symmetric_and_equal_triangles(spark):
    bins, xyz, k = Bins(0.2, 0.9, 3), on_sphere(60, 7), np.random.default_rng(8).random(60)
    z = synthesis.re_im(zeta_of(spark, xyz, k, bins, 3, norm="none")).toPandas().set_index(["m", "b1", "b2"])["re"]
    for (m, a, b), v in z.items():
        assert v == pytest.approx(z[m, b, a], rel=1e-9, abs=1e-9)
    p = points(spark, xyz, k)
    t = threepoint.triangles(grid_pairs(p, p, bins.rmax), bins)
    for m in range(4):
        for r in t.groupBy("b1", "b2").agg(F.sum(F.col("w") * F.col("product") * F.cos(m * F.col("dphi"))).alias("v")).collect():
            assert r["v"] == pytest.approx(z[m, r["b1"], r["b2"]], rel=1e-8, abs=1e-8)


def test_monopole_of_a_constant_field_is_the_share_of_pivots_with_both_bins(spark):
    bins, xyz = Bins(0.2, 0.9, 3), on_sphere(50, 9)
    r = np.linalg.norm(xyz[:, None] - xyz[None], axis=2)
    e = bins.edges
    has = [((r > lo) & (r < hi)).any(1) for lo, hi in zip(e, e[1:])]
    for row in zeta_of(spark, xyz, [1.0] * 50, bins, 2).where("m = 0").collect():
        assert row["cc"] == pytest.approx((has[row["b1"] - 1] & has[row["b2"] - 1]).mean())


def test_edge_correction_recovers_the_field_from_uneven_angles(spark):
    """A band-limited dependence on the angle between both arms comes back whatever the distribution of angles."""
    rng, most = np.random.default_rng(3), 2
    true = {0: 1.0, 1: 0.4, 2: -0.3}
    phi = rng.random(400) ** 2 * 2 * math.pi
    weight = rng.random(400)
    value = sum((1 if m == 0 else 2) * v * np.cos(m * phi) for m, v in true.items())
    rows = lambda f, top: [(m, 1, 1, float((f * np.cos(m * phi)).sum()), 0.0, float((f * np.sin(m * phi)).sum()), 0.0) for m in range(top + 1)]
    schema = "m int, b1 int, b2 int, cc double, ss double, sc double, cs double"
    out = threepoint.edge_corrected(spark.createDataFrame(rows(weight * value, most), schema), spark.createDataFrame(rows(weight, 2 * most), schema), most)
    for r in out.collect():
        assert r["re"] == pytest.approx(true[r["m"]], abs=1e-9) and r["im"] == pytest.approx(0, abs=1e-9)


def test_full_fills_every_cell(spark):
    bins = Bins(0.2, 0.9, 3)
    assert threepoint.full(zeta_of(spark, on_sphere(5, 1), [1.0] * 5, bins, 2), bins, 2).count() == 27


def test_dft_is_numpys(spark):
    bins = Bins(0.2, 0.9, 2)
    z = threepoint.full(zeta_of(spark, on_sphere(40, 2), np.random.default_rng(1).random(40), bins, 3), bins, 3)
    x = synthesis.re_im(z).toPandas()
    for (a, b), part in synthesis.dft(z, 3).toPandas().groupby(["b1", "b2"]):
        f = x[(x.b1 == a) & (x.b2 == b)].sort_values("m")
        want = np.fft.ifft(f["re"].to_numpy() + 1j * f["im"].to_numpy())
        got = part.sort_values("l")
        assert np.allclose(got["re"] + 1j * got["im"], want)


@pytest.mark.parametrize("nside", [1, 2, 4, 16])
def test_healpix(spark, nside):
    n = hp.nside2npix(nside)
    assert hp.npix2nside(n) == nside and hp.npix2nside(n + 1) == -1
    nest = np.arange(n)
    ring = hp.nest_to_ring(nside, nest)
    assert sorted(ring) == list(range(n)) and (hp.ring_to_nest(nside, ring) == nest).all()
    p = spark.range(n)
    v = p.select("id", *[x.alias(k) for k, x in zip("xyz", hp.pix2vec(nside, F.col("id")), strict=True)])
    assert v.where(F.abs(g.dot(g.cols(), g.cols()) - 1) > 1e-12).count() == 0
    assert v.where(hp.vec2pix(nside, *g.cols()) != F.col("id")).count() == 0
    mean = v.agg(*[F.avg(k) for k in "xyz"]).first()
    assert all(abs(m) < 1e-12 for m in mean)


def test_nested_children_lie_near_their_parent(spark):
    a = spark.range(hp.nside2npix(4)).select("id", *[x.alias(k) for k, x in zip("xyz", hp.pix2vec(4, F.col("id"), True), strict=True)])
    b = spark.range(hp.nside2npix(8)).select((F.col("id") / 4).cast("long").alias("id"), *[x.alias(f"c{k}") for k, x in zip("xyz", hp.pix2vec(8, F.col("id"), True), strict=True)])
    near = a.join(b, "id").select(g.dot(g.cols(), g.cols("c")).alias("d")).agg(F.min("d")).first()[0]
    assert near > math.cos(0.25)


def test_degrade_and_upgrade(spark):
    m = spark.createDataFrame([(k, float(k)) for k in range(7)] + [(7, float("nan"))], "pix long, value double")
    assert {r["pix"]: r["value"] for r in hp.degrade(m, "pix", "value", 1).collect()} == {0: 1.5, 1: 5.0}
    assert {r["pix"]: r["value"] for r in hp.degrade(m, "pix", "value", 1, True).collect()} == {0: 1.5, 1: None}
    assert hp.upgrade(m.limit(2), "pix", "value", 2).count() == 32


def test_geometry(spark):
    one = spark.range(1).select(F.lit(1.0).alias("ax"), F.lit(0.0).alias("ay"), F.lit(0.0).alias("az"), F.lit(0.0).alias("bx"), F.lit(1.0).alias("by"), F.lit(0.0).alias("bz"))
    t = one.select(*[v.alias(k) for k, v in zip("xyz", g.turn_towards(g.cols("a"), g.cols("b"), 0.5), strict=True)]).first()
    assert t["x"] == pytest.approx(math.cos(0.5)) and t["y"] == pytest.approx(math.sin(0.5))
    m = np.array(g.euler(0.3, 0.5, 0.7))
    assert np.allclose(m @ m.T, np.eye(3)) and np.linalg.det(m) == pytest.approx(1)
    assert np.abs(m - np.array(g.euler_linear(0.3, 0.5, 0.7))).max() < 1
    w = spark.range(1).select(*g.spherical_wrap(F.lit(3.5), F.lit(0.1))).first()
    assert w[0] == pytest.approx(2 * math.pi - 3.5) and w[1] == pytest.approx(math.pi + 0.1)


def test_catalog_defaults_duplicates_and_jitter(spark):
    p = c.catalog(points(spark, [(0, 0, 0), (0, 0, 0), (1, 0, 0)]))
    assert p.dtypes == [(f.name, f.dataType.simpleString()) for f in c.SCHEMA.fields] and p.first()["weight"] == 1.0 and p.first()["mask"]
    with pytest.raises(ValueError):
        c.require_distinct(p)
    moved = c.part_duplicates(p)
    assert c.duplicates(moved).isEmpty() and moved.where("active").count() == 2


def test_cells_far_from_the_origin_stay_apart(spark):
    p = c.catalog(points(spark, [(0, 0, 0), (0.1, 0, 0), (0.2, 0, 0), (-0.1, 0.1, 0.05)]))
    assert cells.summaries(p, 1e-4).count() == 4 and cells.inertia(p, 1e-4).count() == 4
    assert [r["cells"] for r in cells.diagnostics(p, 1e-4, 2).orderBy("level").collect()] == [4, 4]
    with pytest.raises(Exception, match="cells of"):
        cells.summaries(p, 1e-8).collect()


def test_pyramid(spark):
    p = c.catalog(points(spark, random_points(150, 6), np.random.default_rng(1).random(150)))
    levels = 3
    tree = cells.pyramid(p, 0.05, levels).cache()
    rows = lambda df: sorted((r["nb"], round(r["radius"], 9), round(r["kappa"], 9), round(r["x"], 9)) for r in df.collect())
    assert rows(cells.summaries(p, 0.1)) == rows(tree.where("level = 1"))


def test_kd_tree_halves_nodes(spark):
    xyz = np.array(random_points(400, 8)) * [3, 1, 0.2]
    p = cells.kd_tree(points(spark, xyz), 4).cache()
    leaves = p.groupBy("node").count().collect()
    assert len(leaves) == 16 and all(16 <= r["node"] < 32 and 20 <= r["count"] <= 30 for r in leaves)
    # The first cut is along x, at its median.
    side = {r["id"]: r["node"] >> 3 for r in p.collect()}
    median = np.sort(xyz[:, 0])[199]
    assert all((side[i] == 3) == (xyz[i, 0] > median) for i in side)
    boxes = {r["node"]: r for r in cells.extents(p, "node").collect()}
    for r in p.collect():
        b = boxes[r["node"]]
        assert all(b[f"min_{k}"] <= r[k] <= b[f"max_{k}"] for k in "xyz")
    assert sum(b["nb"] for b in boxes.values()) == 400 and cells.kd_tree(points(spark, [(0, 0, 0)] * 3), 2).select("node").distinct().count() == 1


def test_smooth_pivots_and_approximate_cells(spark, data):
    s = c.catalog(d.sphere(spark, data("0.001")))
    smooth = cells.smooth_pivots(s, 0.3)
    assert smooth.agg(F.sum("nb")).first()[0] == s.count()
    assert cells.active(s, smooth).where("active").count() == smooth.count()
    bins = Bins(0.15, 0.4, 2)
    exact = twopoint.auto(s, bins, symmetric=False).orderBy("bin").toPandas()
    near = cells.approximate_correlation(s, bins, 1e-4).orderBy("bin").toPandas()
    assert (exact["n"] == near["n"]).all() and np.allclose(exact["xi"], near["xi"])


def test_curves(spark):
    q = spark.createDataFrame([(float(x), float(x * x)) for x in range(6)], "x double, y double")
    ref = spark.createDataFrame([(0.5, 0.0), (5.0, 0.0), (7.0, 0.0)], "x double, y double")
    assert {r["x"]: r["y_source"] for r in compare.interpolate(q, ref).collect()} == {0.5: 0.5, 5.0: 25.0, 7.0: None}
    assert compare.bao_peak(q.select(F.col("x").alias("r"), F.lit(1.0).alias("xi"))).count() == 0


def test_numeric_kernels(spark):
    v = np.random.default_rng(1).random(8)
    df = spark.createDataFrame([(0, i, float(x), 0.0) for i, x in enumerate(v)], "g int, i int, re double, im double")
    out = numeric.fourier(df, ["g"], "i", "re", "im").orderBy("k").toPandas()
    assert np.allclose(out["re"] + 1j * out["im"], np.fft.fft(v))
    half = numeric.fourier_real(df, ["g"], "i", "re").orderBy("k").toPandas()
    assert np.allclose(half["re"] + 1j * half["im"], np.fft.rfft(v))
    x = np.array([0.5, 1.0, 60.0])
    for f in (lambda v: numeric.bessel_j(1, v), lambda v: numeric.bessel_i(0, v), lambda v: numeric.bessel_k(2, v), numeric.expint1, lambda v: numeric.gamma_p(2.5, v)):
        assert np.allclose(f(x), [f(float(u)) for u in x], rtol=1e-12)
    got = spark.createDataFrame([(1.0,), (None,), (2.0,)], "x double").select(numeric.elementwise(lambda v: numeric.bessel_j(0, v))(F.col("x")).alias("y")).collect()
    assert got[1]["y"] is None and got[0]["y"] == pytest.approx(0.7651976865579666)
    system = spark.createDataFrame([(0, 0, 0, 2.0), (0, 0, 1, 1.0), (0, 1, 1, 4.0), (0, 0, 2, 4.0), (0, 1, 2, 8.0)], "g int, i int, j int, a double")
    assert [r["x"] for r in numeric.solve(system, ["g"], 2).orderBy("i").collect()] == pytest.approx([1.0, 2.0])
    assert numeric.bessel_j(0, 1.0) == pytest.approx(0.7651976865579666) and numeric.bessel_i(1, 1.0) == pytest.approx(0.5651591039924851)
    assert numeric.bessel_k(0, 1.0) == pytest.approx(0.42102443824070834, rel=1e-6) and numeric.expint1(1.0) == pytest.approx(0.21938393439552029, rel=1e-6)
    assert numeric.gamma_p(2.0, 1.0) == pytest.approx(1 - 2 / math.e) and numeric.gamma_p(2.0, 100.0) == pytest.approx(1.0)
    assert numeric.find_root(lambda x: x * x - 2, 0, 2) == pytest.approx(math.sqrt(2))
    assert spark.range(1).select(numeric.elementwise(math.erfc, True)(F.lit(0.0))).first()[0] == 1.0
    df, theta = spark.range(1).select(F.lit(math.cos(0.7)).alias("a"), F.lit(math.sin(0.7)).alias("b")), 0.7
    row = numeric.chebyshev(df, "a", "b", 6).first()
    assert all(row[f"_c{m}"] == pytest.approx(math.cos(m * theta)) and row[f"_s{m}"] == pytest.approx(math.sin(m * theta)) for m in range(7))


def test_best_side():
    assert best_side(512, 100, 10**6) == 40 and best_side(1, 0.001, 16) == 2 and best_side(1, 10, 5) == 1


def test_plan_has_one_shuffle_of_points_and_prunes_columns(spark, data):
    """The moments and products of a three-point run group within cells: pairs aren't shuffled."""
    s, bins = d.sphere(spark, data("0.001")), Bins(0.1, 0.3, 3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        z = threepoint.multipoles(threepoint.moments(grid_pairs(s, s, bins.rmax), bins, 2), 2, 1)
        plan = z._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("Exchange hashpartitioning") == 3  # both sides by cell, sums by (b1, b2)
    assert "c_name" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_points_go_to_blocks_with_pivots_only(spark, monkeypatch):
    """On a sphere many blocks that a point's ball reaches hold no pivot: nothing is sent there, and the sums stay."""
    v = np.random.default_rng(4).normal(size=(1500, 3))
    s, bins, beside, split = points(spark, v / np.linalg.norm(v, axis=1)[:, None]), Bins(0.05, 0.3, 4), [], sw._split

    def noted(*args):
        mine, around = split(*args)
        beside.append(around.join(mine.select(*sw._GRID).distinct(), sw._GRID, "left_anti").count())
        return mine, around

    monkeypatch.setattr(sw, "_split", noted)
    monkeypatch.setattr(sw, "BLOCK_POINTS", 100)
    found = []
    for sent in (0, 100_000):
        monkeypatch.setattr(sw, "CELLS_SENT", sent)
        found.append(sw.sweep(s, s, bins, 2, counts=1).orderBy("what", "m", "b1", "b2").toPandas())
    assert beside[0] > 0 and beside[1] == 0
    assert (found[0].iloc[:, :4] == found[1].iloc[:, :4]).all().all()
    assert np.allclose(found[0].iloc[:, 4:], found[1].iloc[:, 4:], rtol=1e-9, atol=1e-9)


def test_points_of_one_file_are_dealt_before_they_are_copied(spark, monkeypatch):
    """A large catalog in one file would be copied to its blocks by one task."""
    p, bins = points(spark, random_points(500, 8)).coalesce(1), Bins(0.05, 0.3, 4)
    plain = sweep(p, p, bins).orderBy("b1").collect()
    monkeypatch.setattr(sw, "BLOCK_POINTS", 100)
    dealt = sweep(p, p, bins)
    assert "RoundRobinPartitioning" in dealt._jdf.queryExecution().executedPlan().toString()
    assert [(r["b1"], r["cc"]) for r in dealt.orderBy("b1").collect()] == [(r["b1"], r["cc"]) for r in plain]
