"""Readers and writers by round trips and hand-made files."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwave import catalog as c
from pairwave.functions import healpix as hp
from pairwave.params import Params, from_dict, numbers, parse_file
from pairwave.plans import cli
from pairwave.plans.run import Correlator
from pairwave.sources import binary, models, registry, text


@pytest.fixture
def put(tmp_path):
    def write(name, content):
        path = tmp_path / name
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
        return str(path)

    return write


def xyz(df):
    return sorted(tuple(round(v, 9) for v in r) for r in df.select("x", "y", "z", "kappa").collect())


def test_ascii_family(spark, put):
    path = put("a.txt", "# nbody NDIM Lx Ly Lz\n# 2 3 1.0 2.0 3.0\n 0.1 0.2 0.3 4\n\n% c\n1 2  3 5\n")
    assert xyz(registry.read(spark, path)) == [(0.1, 0.2, 0.3, 4.0), (1, 2, 3, 5)]
    assert text.header(spark, path) == {"nbody": 2, "ndim": 3, "box": [1.0, 2.0, 3.0]}
    assert {r["kappa"] for r in registry.read(spark, path, "columns-ascii-pos").collect()} == {2.0}
    assert xyz(registry.read(spark, path, columns="4,3,2,1")) == [(4, 0.3, 0.2, 0.1), (5, 3, 2, 1)]
    assert text.require_even(spark, path) == 4
    sky = registry.read(spark, put("s.txt", "90 0 7\n"), "ra-dec-ascii", degrees=True).first()
    assert (round(sky["x"], 12), round(sky["y"], 12), sky["kappa"]) == (0, 1, 7)
    pole = registry.read(spark, put("t.txt", "0 1.0 3\n"), "columns-ascii-2d-to-3d", convention="colatitude").first()
    assert round(pole["z"], 12) == 1 and pole["kappa"] == 3
    shear = registry.read(spark, put("g.txt", "1 2 3 0.5 0.6 0.7\n"), "multi-columns-ascii", kind="pos-and-shear").first()
    assert (shear["gamma1"], shear["gamma2"], shear["weight"]) == (0.5, 0.6, 0.7)


def test_ragged_lines_are_an_error(spark, put):
    path = put("r.txt", "1 2 3 4\n1 2\n")
    with pytest.raises(ValueError):
        text.require_even(spark, path)
    with pytest.raises(Exception, match="less than 4 values"):
        registry.read(spark, path).collect()
    with pytest.raises(Exception, match="of the first"):
        registry.read(spark, put("l.txt", "1 2 3 4\n1 2 3 4 5\n")).collect()


def test_columns_choice():
    assert text.choose("3,1,2", [1]) == [3, 1, 2] and text.choose("", [5]) == [5] and text.choose("9,8,7,6,5,4,3,2,1", [1]) == [9, 8, 7, 6, 5, 4, 3, 2, 1]
    for bad in ("0,1", "x", [-1]):
        with pytest.raises(ValueError):
            text.choose(bad, [1])


def test_matrix_and_vector(spark, put):
    path = put("m.txt", "# m\n1 2\n3 4\n")
    assert {(r["i"], r["j"]): r["value"] for r in text.matrix(spark, path).collect()} == {(0, 0): 1, (0, 1): 2, (1, 0): 3, (1, 1): 4}
    assert [r["value"] for r in text.vector(spark, path, 2).orderBy("i").collect()] == [2, 4]


@pytest.mark.parametrize("format", ["columns-ascii", "columns-ascii-all", "binary", "binary-all", "fits", "parquet"])
def test_written_catalogs_are_read_back(spark, tmp_path, format):
    df = models.simple_cubic(spark, 30, 2.0)
    path = str(tmp_path / "out")
    registry.write(df, path, format)
    got = registry.read(spark, path + ("/*" if format in ("fits", "binary", "binary-all") else ""), format)
    assert xyz(got) == xyz(df)


def test_positions_only_and_shift(spark, tmp_path):
    df = models.simple_cubic(spark, 8, 2.0)
    registry.write(df, str(tmp_path / "p"), "columns-ascii-pos", box=1.0)
    assert registry.read(spark, str(tmp_path / "p"), "columns-ascii-pos").agg(F.min("x")).first()[0] == pytest.approx(0.6)


def test_gadget(spark, put, tmp_path):
    pos = np.array([[0.5, 1.5, 11.0], [-1.0, 2.0, 3.0]], "f4")
    path = put("snap.0", binary.gadget_bytes(pos, 10.0))
    put("snap.1", binary.gadget_bytes(pos[:1], 10.0))
    rows = registry.read(spark, path, "gadget").orderBy("x").collect()
    assert [(r["x"], r["y"], r["z"]) for r in rows] == [(0.5, 1.5, 1.0), (9.0, 2.0, 3.0)]
    assert rows[0]["kappa"] == pytest.approx(1 + math.cos(40 * math.pi * 0.05) * math.sin(40 * math.pi * 0.15))
    assert registry.read(spark, str(tmp_path / "snap.*"), "gadget").count() == 3
    with pytest.raises(Exception, match="length marks"):
        registry.read(spark, put("bad", binary.gadget_bytes(pos, 10.0)[:-2]), "gadget").collect()


def test_maps_and_masks(spark, put):
    import io

    nside, values = 2, np.arange(48.0)
    path, mask = put("m.fits", binary.map_bytes(values)), put("k.fits", binary.map_bytes((values % 2 == 0).astype(float)))
    points = registry.read(spark, path, "fits-healpix")
    assert points.count() == 48
    first = points.where("id = 5").first()
    theta, phi = spark.range(1).select(*hp.pix2ang_ring(nside, F.lit(5))).first()
    assert first["kappa"] == 5 and first["z"] == pytest.approx(math.cos(theta)) and first["x"] == pytest.approx(math.sin(theta) * math.cos(phi))
    assert registry.read(spark, path, "fits-healpix", mask=mask).count() == 24
    assert registry.read(spark, path, "fits-healpix", mask=mask, inside_only=False).where("mask").count() == 24
    out = io.BytesIO()
    np.save(out, values)
    assert registry.read(spark, put("m.npy", out.getvalue()), "numpy-healpix").count() == 48


def test_large_files_are_read_in_ranges(spark, put, monkeypatch):
    """The same rows from ranges as from whole files, for every format that is read so."""
    import io

    rng = np.random.default_rng(1)
    n = 1000
    columns = {k: rng.random(n) for k in ("X", "Y", "Z", "K")}
    array = io.BytesIO()
    np.save(array, rng.random(192).astype("f4"))
    record = lambda b: struct.pack("<i", len(b)) + b + struct.pack("<i", len(b))
    k = rng.random(48).astype("<f4")
    files = {
        "fits": put("a.fits", binary.fits_bytes(columns | {"I": np.arange(n, dtype="i4")})),
        "binary-all": put("a.bin", binary.packed_bytes({c: rng.random(n) for c in "abcdefg"})),
        "fits-healpix": put("m.fits", binary.map_bytes(rng.random(192))),
        "numpy-healpix": put("m.npy", array.getvalue()),
        "takahashi": put("t.dat", record(struct.pack("<i", 2)) + record(struct.pack("<q", 48)) + record(k.tobytes()) + record((k + 1).tobytes())),
    }
    rows = lambda: {f: sorted(tuple(round(v, 12) if isinstance(v, float) else v for v in r) for r in registry.read(spark, p, f).select("x", "y", "z", "kappa", "weight", "mask", F.coalesce("gamma1", F.lit(-1.0))).collect()) for f, p in files.items()}
    whole = rows()
    assert {f: len(r) for f, r in whole.items()} == {"fits": n, "binary-all": n, "fits-healpix": 192, "numpy-healpix": 192, "takahashi": 48}
    monkeypatch.setattr(binary, "RANGE", 100)
    monkeypatch.setattr(binary, "BATCH", 7)
    assert rows() == whole


def test_maps_are_written_by_tasks(spark, tmp_path):
    df = binary.map_catalog(spark.range(48).select(F.col("id").alias("pix"), (F.col("id") * 0.5).alias("value"), F.lit(2).alias("nside"), F.lit(False).alias("nest"))).repartition(3)
    registry.write(df, str(tmp_path / "map"), "fits-healpix")
    assert len(list((tmp_path / "map").glob("part-*.fits"))) == 3
    got = registry.read(spark, str(tmp_path / "map"), "fits-healpix")
    assert xyz(got) == xyz(df) and sorted(r["id"] for r in got.select("id").collect()) == list(range(48))
    with pytest.raises(ValueError):
        registry.write(df.limit(5), str(tmp_path / "part"), "fits-healpix")


def test_fits_sky_tables(spark, put):
    path = put("t.fits", binary.fits_bytes({"RA": np.array([0.0, 90.0]), "DEC": np.array([0.0, 0.0]), "R": np.array([2.0, 3.0]), "K": np.array([1.0, 2.0])}))
    r = registry.read(spark, path, "fits-radecr-field").orderBy("kappa").collect()
    assert r[0]["x"] == pytest.approx(2) and r[1]["y"] == pytest.approx(3)
    assert registry.read(spark, path, "fits-radec-field", columns=[1, 2, 4]).agg(F.max("kappa")).first()[0] == 2


def test_fortran_map(spark, put):
    record = lambda b: struct.pack("<i", len(b)) + b + struct.pack("<i", len(b))
    k = np.arange(12, dtype="<f4")
    raw = record(struct.pack("<i", 1)) + record(struct.pack("<q", 12)) + record(k.tobytes()) + record((k + 1).tobytes()) + record((k + 2).tobytes()) + record((k + 3).tobytes())
    rows = registry.read(spark, put("t.dat", raw), "takahashi").orderBy("id").collect()
    assert len(rows) == 12 and (rows[3]["kappa"], rows[3]["gamma1"], rows[3]["gamma2"]) == (3, 4, 5)


def test_many_files(spark, put):
    a, b = put("a", "1 2 3 4\n"), put("b", "5 6 7 8\n")
    assert [x.first()["cat_id"] for x in registry.read_many(spark, f"{a},{b}", catalogs="2,1")] == [1, 0]
    assert registry.read_all_in_one(spark, f"{a},{b}").count() == 2
    with pytest.raises(ValueError):
        registry.read_many(spark, f"{a},{b}", "columns-ascii,fits,fits")
    with pytest.raises(ValueError):
        registry.read(spark, a, "no-such-format")


def test_models(spark):
    s = models.simple_cubic(spark, 30, 2.0)
    assert s.count() == 27 and s.agg(F.min("x"), F.max("z")).first() == (pytest.approx(0.1), pytest.approx(1.9))
    r = models.unit_sphere_random(spark, 2000, patch=(1.0, 1.5, 0.5, 1.0))
    theta = F.acos("z")
    assert 0 < r.count() < 2000 and r.where((theta < 1.0) | (theta > 1.5)).count() == 0
    assert models.ball(spark, 500, 2.0).where("x*x+y*y+z*z > 4").count() == 0
    assert models.simple_cubic_random(spark, 100, 3.0).where("x < 0 or x > 3").count() == 0


def test_cloud_in_cell_keeps_mass(spark):
    df = c.catalog(models.simple_cubic_random(spark, 125, 1.0))
    total = c.cloud_in_cell(df, 4, 1.0).agg(F.sum(F.col("density") + 1)).first()[0]
    assert total == pytest.approx(64)


def test_parameters():
    p = from_dict({"bins": "12", "range": 0.4, "rminHist": "0.05", "useLogHist": "true", "m": 3})
    assert p.sizeHistN == 12 and p.bins.n == 12 and p.key == p.replace().key != p.replace(seed=5).key
    for bad in ({"nope": 1}, {"searchMethod": "nope"}, {"options": "nope"}, {"sizeHistPhi": 33}, {"rminHist": 0.0}, {"nbody": 2}, {"options": "bh86,sw94"}, {"options": "only-pos,pos-and-shear"}, {"useLogHist": "maybe"}, {"mChebyshev": 1}):
        with pytest.raises(ValueError):
            from_dict(bad)
    assert parse_file("a = 1 # x\n% y\nb='z'\n") == {"a": "1", "b": "z"} and numbers("1, 2,") == [1, 2]
    for bad in ("a", "a=1\na=2"):
        with pytest.raises(ValueError):
            parse_file(bad)
    assert Params().sizeHistN == 20


def test_correlator(spark, tmp_path):
    seen = []
    run = Correlator(spark, nbody=300, sizeHistN=4, rangeN=0.5, rminHist=0.1, mChebyshev=3, rootDir=str(tmp_path / "out"), options="out-m-HistZeta,out-HistZetaG,xr1r2,edge-corrections,no-normalize-HistZeta")
    run.before.append(lambda r: seen.append("before"))
    run.after.append(lambda r: seen.append("after"))
    run.run().run()
    assert seen == ["before", "after"]  # unchanged parameters aren't run again
    assert run.getNBody() == 300 and run.getnMultipoles() == 4 and len(run.getrBins()) == 4 and run.getVersion()
    assert run.getHistNN().sum() > 0 and run.getHistXi2pcf().shape == (4,)
    a = run.getHistZetaMsincos(1, 1)
    assert a.shape == (4, 4) and np.allclose(a, a.T) and run.getHistZetaM_EE(1).shape == (4, 4)
    saved = spark.read.parquet(str(tmp_path / "out" / "tables" / "histZetaM"))
    assert saved.count() == 4 * 16 and "nbody" in (tmp_path / "out" / "parameters-usedvalues").read_text()
    # The text files that scripts read hold the same numbers.
    file = lambda name: np.loadtxt(tmp_path / "out" / name)
    assert np.allclose(file("rBins.txt"), run.getrBins()) and np.allclose(file("histNN.txt")[:, 1], run.getHistNN()) and np.allclose(file("histXi2pcf.txt")[:, 1], run.getHistXi2pcf())
    for k, name in enumerate(("cos", "sin", "sincos", "cossin"), 1):
        for m in (1, 4):
            assert np.allclose(file(f"histZetaM_{name}_{m}.txt"), run.getHistZetaMsincos(m, k))
    assert file("mhistZetaM_cos_2.txt").shape == (4, 6) and file("histZetaG_1.txt").shape == (4, 4)
    assert "300 points" in (tmp_path / "out" / "pairwave.log").read_text() or run.params.verbose_log < 2
    with pytest.raises(KeyError):
        run.getHistCF()
    run.set(searchMethod="neighbor-boxes-omp", testmodel="simple-cubic-random", lengthBox=1.0, useLogHist=False, rangeN=0.3, rminHist=0.0, options="").run()
    assert run.getHistCF().shape == (4,) and (run.getHistNN() >= 0).all()
    run.clean_all()
    assert run.tables == {} and run.params == Params()


def test_correlator_methods_agree(spark):
    s = models.unit_sphere_random(spark, 150)
    base = dict(sizeHistN=3, rangeN=0.8, rminHist=0.2, mChebyshev=3, rootDir="")
    a, b = (Correlator(spark, searchMethod=m, **base).use(s).run() for m in ("octree-ggg-omp", "brute"))
    assert np.allclose(a.getHistZetaMsincos(2, 2), b.getHistZetaMsincos(2, 2)) and (a.getHistNN() == b.getHistNN()).all()
    three = Correlator(spark, options="KKCorrelation", **base).use(s, s, s).run()
    assert np.allclose(three.getHistXi2pcf12(), three.getHistXi2pcf13())


@pytest.mark.parametrize("rsmooth", ["30", "400", "2000"])
def test_smoothing_keeps_a_constant_field_at_one(spark, rsmooth):
    """Whatever the radius: all weights are the pivots' numbers of points, in sums and in counts."""
    s = models.unit_sphere_random(spark, 400, constant=1.0)
    base = dict(sizeHistN=2, rangeN=1.2, rminHist=0.4, mChebyshev=2, rootDir="")
    plain = Correlator(spark, **base).use(s).run()
    smooth = Correlator(spark, options="smooth-pivot", rsmooth=rsmooth, **base).use(s).run()
    assert np.allclose(smooth.getHistXi2pcf(), 1.0) and np.allclose(smooth.getHistZetaMsincos(1, 1), 1.0)
    assert np.allclose(plain.getHistZetaMsincos(1, 1), 1.0) and abs(smooth.getHistNN().sum() / plain.getHistNN().sum() - 1) < 0.1


def test_roles_of_catalogs(spark, put):
    rng = np.random.default_rng(5)
    paths = [put(f"c{k}", "".join(f"{a} {b} {c} {v}\n" for a, b, c, v in rng.random((n, 4)))) for k, n in enumerate((30, 40, 50))]
    base = dict(sizeHistN=3, rangeN=0.8, rminHist=0.1, mChebyshev=2, rootDir="")
    read = [registry.read(spark, p) for p in paths]
    run = lambda **kw: Correlator(spark, infile=",".join(paths), **base, **kw).run()
    use = lambda *c, **kw: Correlator(spark, **base, **kw).use(*c).run()
    both = run(iCatalogs="1,1", options="KKCorrelation")
    assert (both.getHistNN() == use(read[0], options="KKCorrelation").getHistNN()).all() and both.same
    crossed = run(iCatalogs="2,3", options="KKCorrelation,asymmetric")
    assert np.allclose(crossed.getHistXi2pcf(), use(read[1], read[2], options="KKCorrelation").getHistXi2pcf()) and crossed.getNBody() == 30
    three = run(iCatalogs="3,1,2")
    assert np.allclose(three.getHistZetaMsincos(1, 1), use(read[2], read[0], read[1]).getHistZetaMsincos(1, 1)) and three.getHistXi2pcf13().shape == (3,)
    # By hand: pivots of the third, first bin around by the first, second bin by the second.
    p, a, b = (np.array(x.select("x", "y", "z", "kappa").collect()) for x in (read[2], read[0], read[1]))
    e, want = three.bins.edges, np.zeros((3, 3))
    for i in range(len(p)):
        mean = []
        for q in (a, b):
            r = np.sqrt(((p[i, :3] - q[:, :3]) ** 2).sum(1))
            mean.append([q[(r >= lo) & (r < hi), 3].sum() / max(1, ((r >= lo) & (r < hi)).sum()) for lo, hi in zip(e, e[1:])])
        want += p[i, 3] * np.outer(*mean) / len(p)
    assert np.allclose(three.getHistZetaMsincos(1, 1), want)
    for bad in ("4", "0", "1,2,3,1"):
        with pytest.raises(ValueError):
            run(iCatalogs=bad)


def test_levels_are_part_of_a_run(spark):
    s = models.unit_sphere_random(spark, 60)
    run = Correlator(spark, sizeHistN=2, rangeN=0.8, rminHist=0.2, mChebyshev=2, rootDir="").use(s)
    run.run(("StartRun",))
    assert run.tables == {} and run.getNBody() == 60
    run.run(("MainLoop",))
    assert run.getHistNN().sum() > 0


def test_options_act_or_are_refused(spark, tmp_path):
    s = models.unit_sphere_random(spark, 300)
    base = dict(sizeHistN=3, rangeN=0.8, rminHist=0.2, mChebyshev=2, rootDir="")
    exact = Correlator(spark, **base).use(s).run()
    assert (Correlator(spark, options="no-one-ball,KKKCorrelation", **base).use(s).run().getHistNN() == exact.getHistNN()).all()
    near = Correlator(spark, options="behavior-ball", theta=0.2, **base).use(s).run()
    assert not (near.getHistNN() == exact.getHistNN()).all() and np.allclose(near.getHistNN(), exact.getHistNN(), rtol=0.15)
    assert np.abs(near.getHistXi2pcf() - exact.getHistXi2pcf()).max() < 2e-5
    assert not np.allclose(Correlator(spark, options="behavior-ball,bh86", theta=2.0, **base).use(s).run().getHistNN(), Correlator(spark, options="behavior-ball,sw94", theta=2.0, **base).use(s).run().getHistNN())
    cut = Correlator(spark, options="Rcut/theta", theta=2.0, **base).use(s).run().getHistNN()
    assert cut[0] == exact.getHistNN()[0] and cut[2] == 0 and 0 < cut[1] <= exact.getHistNN()[1]
    cf = Correlator(spark, options="NNEstimator", **base).use(s).run()
    assert set(cf.tables) == {"histNN", "histCF", "counters"}
    assert "cells" in Correlator(spark, options="make-tree,NNCorrelation", **base).use(s).run().tables
    wide = Correlator(spark, options="patch,patch-with-all,NNCorrelation", nbody=2000, **base).run()
    inside = Correlator(spark, options="patch,NNCorrelation", nbody=2000, **base).run()
    assert wide.getHistNN().sum() > 2 * inside.getHistNN().sum() > 0
    seen = []
    scripted = Correlator(spark, options="pre-processing,post-processing,stop", preScript="a", posScript="b", **base).use(s)
    scripted.scripts |= {"a": lambda r: seen.append("a"), "b": lambda r: seen.append("b")}
    scripted.run()
    assert seen == ["a", "b"]
    with pytest.raises(ValueError):
        Correlator(spark, options="pre-processing", preScript="rm -rf x", **base).use(s).run()
    for bad in ("bh86", "behavior-ball,no-one-ball", "NNCorrelation,KKCorrelation", "patch-with-all", "cute-box-rmin", "check-eq-pos,no-check-two-bodies-eq-pos"):
        with pytest.raises(ValueError):
            Params(options=bad)
    folders = []
    for k in range(3):
        folders.append(str(tmp_path / f"r{k}"))
        Correlator(spark, **(base | {"rootDir": folders[-1]}), options="edge-corrections", numberThreads=3).use(models.unit_sphere_random(spark, 100, seed=k)).run()
    stat = Correlator(spark, infile=",".join(folders), options="statistics-histograms", **base).run()
    assert stat.tables["histNN_stat"].count() == 3
    again = Correlator(spark, infile=folders[0], options="edge-corrections-from-files", **base).run()
    assert np.allclose(again.getHistZetaM_EE(1), np.array([[r["re"] for r in spark.read.parquet(f"{folders[0]}/tables/histZetaM_EE").where(f"m = 0 and b1 = {a}").orderBy("b2").collect()] for a in (1, 2, 3)]))
    assert "numberThreads" in (tmp_path / "r0" / "pairwave.log").read_text()


def test_brute_run_counts_triangles_by_angle(spark):
    s = models.unit_sphere_random(spark, 40)
    base = dict(sizeHistN=2, rangeN=1.2, rminHist=0.3, mChebyshev=3, sizeHistPhi=8, rootDir="", options="out-HistZetaG,no-normalize-HistZeta")
    brute = Correlator(spark, searchMethod="brute", **base).use(s).run()
    zeta = brute.getHistZetaMsincos(1, 1)
    total = brute.tables["histZetaG"].groupBy("b1", "b2").agg(F.sum("re").alias("v"))
    for r in total.collect():
        assert r["v"] == pytest.approx(zeta[r["b1"] - 1, r["b2"] - 1], rel=1e-9)
    assert brute.tables["histZetaG"].count() == 8 * 4


def test_correlator_reads_files(spark, put, tmp_path):
    """Formats with three columns take the first three of the default four; results go with the parameters that made them."""
    rng = np.random.default_rng(2)
    path = put("p.txt", "".join(f"{a} {b} {c}\n" for a, b, c in rng.random((40, 3))))
    base = dict(sizeHistN=3, rangeN=0.4, rminHist=0.05, mChebyshev=3, rootDir="", lengthBox=1.0, usePeriodic=True)
    run = Correlator(spark, infile=path, infileformat="columns-ascii-pos", options="KKCorrelation", **base).run()
    assert run.getNBody() == 40 and set(np.round(run.getHistXi2pcf()[run.getHistNN() > 0], 9)) == {4.0}
    sky = put("s.txt", "".join(f"{a * 360} {b * 90} 1.5\n" for a, b in rng.random((30, 2))))
    assert Correlator(spark, infile=sky, infileformat="ra-dec-ascii", options="in-degrees,KKCorrelation", **(base | {"usePeriodic": False})).run().getNBody() == 30
    both = Correlator(spark, infile=f"{path},{path}", infileformat="columns-ascii-pos", iCatalogs="1,2", options="KKCorrelation,asymmetric", **base).run()
    assert (both.getHistNN() == 2 * run.getHistNN()).all()
    out = str(tmp_path / "copy")
    Correlator(spark, infile=path, infileformat="columns-ascii-pos", options="stop", **(base | {"rootDir": str(tmp_path)}), outfile="copy", outfileformat="columns-ascii-pos").run()
    assert registry.read(spark, out, "columns-ascii-pos").count() == 40


def test_command_line(tmp_path, capsys):
    f = tmp_path / "p"
    f.write_text("nbody = 10\nsizeHistN = 5\n")
    assert cli.arguments([f"parameters={f}", "nbody=20"]) == {"nbody": "20", "sizeHistN": "5"}
    assert cli.main(["--help"]) == 0 and "sizeHistN" in capsys.readouterr().out and cli.main(["--version"]) == 0


@pytest.mark.parametrize("box", [None, 1.0])
def test_stream_reads_the_blocks_that_a_batch_reaches(spark, tmp_path, box):
    from pairwave.functions.bins import Bins
    from pairwave.operators import twopoint
    from pairwave.operators.pairs import grid_pairs
    from pairwave.streaming.histogram import PairStream

    bins = Bins(0.0, 0.06, 3, "linear")
    s = models.simple_cubic_random(spark, 1000, 1.0).select("id", "x", "y", "z", "kappa").cache()
    stream = PairStream(str(tmp_path / "state"), bins, box)
    for k, part in enumerate((F.col("x") < 0.5, F.col("x") >= 0.5)):
        stream.batch(s.where(part), k)
    stream.batch(s.where(F.col("x") >= 0.5), 1)  # run again
    assert len(list((tmp_path / "state" / "points" / "batch=0").glob("block=*"))) > 8
    got, want = stream.result(spark).orderBy("bin").toPandas(), twopoint.field_correlation(grid_pairs(s, s, bins.rmax, box=box), bins, symmetric=False).orderBy("bin").toPandas()
    assert (got["n"] == want["n"]).all() and got["n"].sum() > 0 and np.allclose(got["xi"], want["xi"])


def test_stream_adds_up(spark, tmp_path):
    from pairwave.functions.bins import Bins
    from pairwave.operators import counts, twopoint
    from pairwave.operators.pairs import grid_pairs
    from pairwave.streaming.histogram import PairStream

    bins = Bins(0.2, 0.9, 3)
    s = models.unit_sphere_random(spark, 120, constant=1.5).select("id", "x", "y", "z", "kappa").cache()
    source = str(tmp_path / "in")
    for k in range(3):
        s.where(F.col("id") % 3 == k).coalesce(1).write.mode("append").parquet(source)
    stream = PairStream(str(tmp_path / "state"), bins)
    q = stream.start(spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(source), str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got, want = stream.result(spark).orderBy("bin").toPandas(), twopoint.field_correlation(grid_pairs(s, s, 0.9), bins, symmetric=False).orderBy("bin").toPandas()
    assert (got["n"] == want["n"]).all() and np.allclose(got["xi"], want["xi"])
    assert counts.pair_counts(grid_pairs(s, s, 0.9), bins).agg(F.sum("n")).first()[0] == got["n"].sum()


def test_results_as_text(spark, tmp_path):
    from pairwave.functions.bins import Bins
    from pairwave.operators import counts, synthesis, threepoint
    from pairwave.operators.pairs import grid_pairs
    from pairwave.sources import histograms

    bins, s = Bins(0.2, 0.9, 4), models.unit_sphere_random(spark, 60, constant=1.0)
    pairs = grid_pairs(s, s, 0.9)
    nn = counts.pair_counts(pairs, bins)
    histograms.write_curve(nn, str(tmp_path / "histNN"), "n")
    assert [r["value"] for r in text.vector(spark, str(tmp_path / "histNN"), 2).orderBy("i").collect()] == [r["n"] for r in nn.orderBy("bin").collect()]
    histograms.write_counts(counts.box_correlation(nn, bins, 60, 2.0), str(tmp_path / "cf"))
    histograms.write_bins(bins.frame(spark), str(tmp_path / "r"))
    assert text.matrix(spark, str(tmp_path / "cf")).count() == 16 and text.matrix(spark, str(tmp_path / "r")).count() == 4
    zeta = threepoint.full(threepoint.multipoles(threepoint.moments(pairs, bins, 2), 2, 60), bins, 2)
    files = histograms.write_matrices(zeta, str(tmp_path), 2)
    assert len(files) == 12 and files[0].endswith("histZetaM_cos_1")
    got = {(r["i"] + 1, r["j"] + 1): r["value"] for r in text.matrix(spark, files[1]).collect()}
    assert got == {(r["b1"], r["b2"]): r["cc"] for r in zeta.where("m = 1").collect()}
    assert text.matrix(spark, histograms.write_slices(synthesis.slices(zeta, bins), str(tmp_path), 2, "cc")[0]).count() == 24
