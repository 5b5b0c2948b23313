"""Runs: brute and sweep agree over all options, cells and trees in runs, headers, catalogs written over themselves, ids over several files."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwave import catalog as c
from pairwave.functions import healpix as hp
from pairwave.operators import trees
from pairwave.params import Params
from pairwave.plans.run import Correlator
from pairwave.sources import binary, models, registry

BASE = dict(sizeHistN=3, rangeN=0.8, rminHist=0.2, mChebyshev=2, rootDir="")


@pytest.fixture(scope="module")
def sky(spark):
    return c.catalog(models.unit_sphere_random(spark, 150).withColumn("kappa", 1.0 + F.cos(F.col("id").cast("double")))).cache()


@pytest.mark.parametrize("options", ["compute-HistN", "NNEstimator", "KKCorrelation,asymmetric", "edge-corrections,compute-HistN", "smooth-pivot,and-CF", "no-normalize-HistZeta,Rcut/theta"])
def test_brute_is_the_sweep(spark, sky, options):
    run = lambda method: Correlator(spark, **BASE, options=options, theta=2.0, searchMethod=method).use(sky).run().tables
    got, want = run("octree-sincos-omp"), run("brute")
    assert set(got) - {"counters"} == set(want)
    for name in want:
        keys = [k for k in ("m", "bin", "b1", "b2") if k in want[name].columns]
        a, b = (t[name].select(*sorted(want[name].columns)).orderBy(*keys).toPandas().to_numpy(float) for t in (got, want))
        assert np.allclose(a, b, rtol=1e-8, atol=1e-12), name


def test_brute_of_two_catalogs_and_what_it_refuses(spark, sky):
    other = c.catalog(models.unit_sphere_random(spark, 90, seed=5))
    a, b = (Correlator(spark, **BASE, iCatalogs="1,2", searchMethod=m).use(sky, other).run() for m in ("octree-sincos-omp", "brute"))
    assert (a.getHistNN() == b.getHistNN()).all() and np.allclose(a.getHistZetaMsincos(2, 1), b.getHistZetaMsincos(2, 1), rtol=1e-8)
    with pytest.raises(ValueError):
        Correlator(spark, **BASE, searchMethod="brute").use(sky, other, other).run()
    for bad in ("one-ball", "behavior-ball"):
        with pytest.raises(ValueError):
            Params(options=bad, searchMethod="brute")
    for bad in ("one-ball,no-one-ball", "two-balls", "one-ball,behavior-ball"):
        with pytest.raises(ValueError):
            Params(options=bad)


def test_cells_and_trees_in_runs(spark, sky):
    exact = Correlator(spark, **BASE).use(sky).run()
    near = Correlator(spark, **BASE, options="one-ball", nsmooth=1).use(sky).run()
    assert (near.getHistNN() == exact.getHistNN()).all() and np.allclose(near.getHistXi2pcf(), exact.getHistXi2pcf(), rtol=1e-10)
    assert np.allclose(near.getHistZetaMsincos(1, 1), exact.getHistZetaMsincos(1, 1), rtol=1e-9)
    told = near.tables["counters"].toPandas()
    assert told["points"].sum() == 2 * exact.getHistNN().sum() and (told["candidates"] >= told["taken"]).all()
    pairs = Correlator(spark, **BASE, options="KKCorrelation").use(sky).run()
    balls = Correlator(spark, **BASE, options="KKCorrelation,two-balls", nsmooth=1).use(sky).run()
    assert (balls.getHistNN() == pairs.getHistNN()).all() and np.allclose(balls.getHistXi2pcf(), pairs.getHistXi2pcf(), rtol=1e-9)
    assert balls.tables["counters"].agg(F.sum("accepted")).first()[0] > 0
    assert np.array_equal(Correlator(spark, **BASE, searchMethod="kdtree-omp").use(sky).run().getHistNN(), exact.getHistNN())
    tree = Correlator(spark, **BASE, options="make-tree,NNCorrelation").use(sky).run().tables
    assert {r["level"]: r["mean_nb"] * r["cells"] for r in tree["cells"].collect()} == pytest.approx({k: 150 for k in range(8)})
    assert {r[0] for r in tree["cell_radii"].groupBy("level").agg(F.sum("cells")).collect()} == set(range(8))


def test_rollup_scans_once_and_bounds_radii(spark, sky):
    out = trees.rollup(sky, 0.3, 4)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("InMemoryRelation") == 1
    far = sky.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(3))))
    from pairwave.operators.cells import morton

    far = far.withColumn("cell", F.expr("shiftright(_k, 3 * level)")) if "_k" in far.columns else far.withColumn("_k", morton(0.3)).withColumn("cell", F.expr("shiftright(_k, 3 * level)"))
    own = far.groupBy("level", "cell").agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.collect_list(F.struct("x", "y", "z")).alias("v"))
    both = own.join(out, ["level", "cell"]).toPandas()
    assert len(both) == out.count()
    for r in both.itertuples():
        v = np.array([list(x) for x in r.v])
        assert r.n == r.nb and np.linalg.norm(v - v.mean(0), axis=1).max() <= r.radius + 1e-12


def test_shapes_have_the_eigenvalues(spark):
    rng = np.random.default_rng(3)
    xyz = np.concatenate([rng.normal(size=(40, 3)) * [3, 1, 0.2], [[1, 2, 3]], np.zeros((2, 3))])
    frame = spark.createDataFrame([(int(k >= 40) + int(k >= 41), *map(float, v)) for k, v in enumerate(xyz)], "node int, x double, y double, z double")
    got = {r["node"]: r for r in trees.shapes(trees.node_summaries(frame, 0)).collect()}
    for node, part in ((0, xyz[:40]), (1, xyz[40:41]), (2, xyz[41:])):
        want = np.linalg.eigvalsh(part.T @ part)[::-1]
        assert np.allclose([got[node][f"e{k}"] for k in (1, 2, 3)], want, atol=1e-6 * max(1, want.max()))
    i = xyz[:40].T @ xyz[:40]
    assert got[0]["etaxz"] == pytest.approx(np.hypot((i[0, 0] - i[2, 2]) / (i[0, 0] + i[2, 2]), 2 * i[0, 2] / (i[0, 0] + i[2, 2]))) and got[2]["etaxy"] == 0


@pytest.mark.parametrize("format", ["binary", "fits", "columns-ascii"])
def test_a_catalog_is_written_over_its_own_source(spark, tmp_path, format):
    path = f"{tmp_path}/catalog"
    sky = models.unit_sphere_random(spark, 200)
    registry.write(sky, path, format)
    registry.write(registry.read(spark, path, format), path, format)
    assert registry.read(spark, path, format).count() == 200 and os.listdir(tmp_path) == ["catalog"]
    # A job that fails leaves what was there.
    broken = sky.withColumn("kappa", F.when(F.col("id") > 0, F.raise_error(F.lit("no"))).otherwise(F.lit(1.0)).cast("double"))
    with pytest.raises(Exception, match="no"):
        registry.write(broken, path, format)
    assert registry.read(spark, path, format).count() == 200 and os.listdir(tmp_path) == ["catalog"]


def test_numpy_maps_out(spark, tmp_path, monkeypatch):
    x, y, z = hp.pix2vec(4, F.col("id"))
    full = c.catalog(spark.range(192).select("id", x.alias("x"), y.alias("y"), z.alias("z"), (F.col("id") * 0.5).alias("kappa")))
    value = lambda df: sorted((r["id"], r["kappa"]) for r in df.collect())
    for name, df, nside in (("whole", full, None), ("part", full.where("id % 3 = 0"), 4)):
        registry.write(df, f"{tmp_path}/{name}", "numpy-healpix", nside=nside)
        assert value(registry.read(spark, f"{tmp_path}/{name}", "numpy-healpix")) == value(df)
    (file,) = os.listdir(tmp_path / "whole")
    assert np.array_equal(np.load(tmp_path / "whole" / file), np.arange(192) * 0.5)
    monkeypatch.setattr(binary, "RANGE", 40)
    assert value(registry.read(spark, f"{tmp_path}/part", "numpy-healpix")) == value(full.where("id % 3 = 0"))


def test_headers_without_rows(spark, tmp_path):
    sky = models.unit_sphere_random(spark, 50)
    registry.write(sky, f"{tmp_path}/b", "binary-all")
    registry.write(sky, f"{tmp_path}/f", "fits")
    registry.write(sky, f"{tmp_path}/t", "columns-ascii")
    (tmp_path / "map.fits").write_bytes(binary.map_bytes(np.zeros(192)))
    (tmp_path / "snap").write_bytes(binary.gadget_bytes(np.zeros((9, 3)), 5.0, tagged=True))
    run = Correlator(spark, infile=f"{tmp_path}/b,{tmp_path}/f,{tmp_path}/t,{tmp_path}/map.fits,{tmp_path}/snap", infileformat="binary-all,fits,columns-ascii,fits-healpix,gadget", options="header-info", **BASE).run()
    rows = run.tables["headers"].collect()
    total = {k: sum(r["rows"] or 0 for r in rows if r["format"] == k) for k in ("binary-all", "fits", "columns-ascii", "fits-healpix", "gadget")}
    assert total == {"binary-all": 50, "fits": 50, "columns-ascii": 50, "fits-healpix": 192, "gadget": 9}
    by = {r["format"]: r for r in rows}
    assert by["fits-healpix"]["nside"] == 4 and by["gadget"]["box"] == [5.0] * 3 and by["gadget"]["columns"] == "HEAD,POS" and by["binary-all"]["columns"].startswith("x,y,z,kappa,weight")
    assert run.getNBody() == sum(total.values())


@pytest.mark.parametrize("tagged", [False, True])
def test_snapshots_in_both_formats_by_ranges(spark, tmp_path, monkeypatch, tagged):
    pos = np.random.default_rng(1).random((50, 3)) * 10
    path = str(tmp_path / "snap")
    for ids in (np.arange(50, dtype="<u4"), np.arange(50, dtype="<u8") + (1 << 40)):
        with open(path, "wb") as f:
            f.write(binary.gadget_bytes(pos, 10.0, velocities=pos * 2, ids=ids, tagged=tagged))
        for size in (1 << 27, 100):
            monkeypatch.setattr(binary, "RANGE", size)
            rows = binary.snapshot(spark, path).orderBy("particle").collect()
            assert [r["particle"] for r in rows] == ids.tolist() and np.allclose([[r["vx"], r["vy"], r["vz"]] for r in rows], pos * 2, rtol=1e-6)
            assert registry.read(spark, path, "gadget").count() == 50
    with open(path, "wb") as f:
        f.write(binary.gadget_bytes(pos, 10.0, tagged=tagged)[:-9])
    with pytest.raises(Exception, match="broken"):
        binary.snapshot(spark, path).count()


def test_points_of_several_files_are_told_apart(spark, tmp_path):
    """As many pairs from one file as from the same points in two."""
    sky = models.unit_sphere_random(spark, 120)
    rows = [(r["x"], r["y"], r["z"], r["kappa"]) for r in sky.collect()]
    for name, part in (("all", rows), ("a", rows[:60]), ("b", rows[60:])):
        (tmp_path / name).write_text("# nbody NDIM Lx Ly Lz\n# 0 3 1 1 1\n" + "\n".join(" ".join(map(repr, r)) for r in part))
    one = Correlator(spark, **BASE, infile=f"{tmp_path}/all").run()
    two = Correlator(spark, **BASE, infile=f"{tmp_path}/a,{tmp_path}/b", options="all-in-one").run()
    assert (one.getHistNN() == two.getHistNN()).all() and one.getHistNN().sum() > 0
    assert registry.read_all_in_one(spark, f"{tmp_path}/a,{tmp_path}/b").select("id").distinct().count() == 120


def test_a_run_parses_its_input_once(spark, tmp_path, monkeypatch):
    """Rows are parsed by one job's tasks, however many passes a run makes."""
    counted = spark.sparkContext.accumulator(0)
    sky = models.unit_sphere_random(spark, 200)

    def seen(frames):
        for frame in frames:
            counted.add(len(frame))
            yield frame

    parsed = sky.mapInPandas(seen, sky.schema)
    Correlator(spark, **BASE).use(parsed).run()
    assert counted.value == 200
