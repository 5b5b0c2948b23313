"""Runs by parameters: catalogs in, statistics out, with getters, sinks and hooks."""

from __future__ import annotations

import dataclasses
import logging
import time
from collections.abc import Callable
from pathlib import Path

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__, catalog as c
from ..functions.bins import Bins
from ..operators import cells, compare, counts, synthesis, threepoint, trees
from ..operators.brute import brute
from ..operators.sweep import counters, multipole_rows, pair_rows, sweep
from ..params import METHODS, Params, from_dict, numbers
from ..session import ship
from ..sources import histograms, models, registry

log = logging.getLogger("pairwave")
LEVELS = {0: logging.ERROR, 1: logging.WARNING, 2: logging.INFO, 3: logging.DEBUG}
PARTS = {1: "cc", 2: "ss", 3: "sc", 4: "cs"}


class Correlator:
    """Set parameters, run, and read results as arrays or DataFrames.

    Results are small tables by bin, pair of bins or angle. A run with unchanged parameters, catalogs and levels is not repeated. All sums of a
    run come from one pass over its pairs.

    Pairs are exact unless cells stand for their points: with behavior-ball where they are far (theta, bh86 or sw94 say how far), with one-ball where all their points lie in
    one bin of a pivot, so counts and two-point sums are exact and only angles are the cells'. two-balls walks down two trees for pairs alone, exactly. With
    smooth-pivot a pivot stands for the nb points of its cell: numbers of pairs and all sums are weighted by nb and divided by the sums of nb,
    so a constant field 1 has xi = 1, and zeta_0 = 1 where every pivot has points in both bins, for any radius.
    """

    def __init__(self, spark: SparkSession, **parameters):
        self.spark = spark
        self.before: list[Callable[[Correlator], None]] = []
        self.after: list[Callable[[Correlator], None]] = []
        #: Functions that preScript and posScript may name; no command is ever started.
        self.scripts: dict[str, Callable[[Correlator], None]] = {}
        self.clean_all()
        self.set(**parameters)

    # Parameters.

    def set(self, *given: dict, **parameters) -> Correlator:
        for values in (*given, parameters):
            self.values |= values
        self.params = from_dict(self.values)
        log.setLevel(LEVELS.get(self.params.verbose, logging.DEBUG))
        return self

    def clean(self) -> None:
        """Forgets results."""
        self.tables: dict[str, DataFrame] = {}
        self.kept: list[DataFrame] = []
        self.done = None
        self.cpu_time = 0.0
        self.points = 0

    struct_cleanup = clean

    def clean_all(self) -> None:
        """Forgets results, parameters and catalogs."""
        self.clean()
        self.values: dict = {}
        self.params = Params()
        self.given: list[DataFrame] = []

    def use(self, *catalogs: DataFrame) -> Correlator:
        """Catalogs to take in place of infile: pivots first, then the points around them (and a second such)."""
        self.given = [c.catalog(x) for x in catalogs]
        self.done = None
        return self

    # Catalogs.

    def load(self) -> list[DataFrame]:
        p = self.params
        if self.given:
            out = self.given
        elif not p.infile:
            model = models.MODELS.get(p.testmodel)
            if model is None:
                raise ValueError(f"no such testmodel: {p.testmodel}")
            options = {"seed": p.seed, "length": p.lengthBox}
            if p.testmodel == "unit-sphere-random":
                patch = (p.thetaL, p.thetaR, p.phiL, p.phiR) if p.has("patch") else None
                options = {"seed": p.seed, "patch": patch, "whole": p.has("all") or p.has("patch-with-all")}
            out = [model(self.spark, p.nbody, **options)]
        else:
            kind = next((k for k in ("only-pos", "pos-and-convergence", "pos-and-shear") if p.has(k)), "pos-and-convergence")
            options = {"degrees": p.has("in-degrees"), "convention": "colatitude" if p.has("arfken") else "latitude", "kind": kind}
            text = any(f.strip().endswith("ascii") for f in p.infileformat.split(","))
            if text and p.columns:
                from ..sources.text import choose

                options["columns"] = choose(p.columns, [1, 2, 3, 4])
            files = p.infile.split(",")
            if p.has("read-mask"):
                if len(files) < 2:
                    raise ValueError("read-mask needs catalogs and, as the last file, their mask")
                kinds = p.infileformat.split(",")
                kinds = kinds * len(files) if len(kinds) == 1 else kinds
                if len(kinds) != len(files):
                    raise ValueError("lists of files and formats differ in length")
                out = [registry.read(self.spark, f, k, mask=files[-1], **options).withColumn("cat_id", F.lit(n)) for n, (f, k) in enumerate(zip(files[:-1], kinds))]
            elif p.has("all-in-one"):
                out = [registry.read_all_in_one(self.spark, p.infile, p.infileformat, **options)]
            else:
                out = registry.read_many(self.spark, p.infile, p.infileformat, **options)
        if p.has("kappa-constant"):
            out = [c.constant_field(x, 1.0 if p.has("kappa-constant-one") else 2.0) for x in out]
        if p.has("check-eq-pos"):
            out = [c.require_distinct(x) for x in out]
        if p.searchMethod == "octree-ggg-omp" and not p.has("patch-with-all") or p.has("read-mask"):
            out = [x.where("mask") for x in out]
        return out

    def roles(self, catalogs: list[DataFrame]) -> list[DataFrame]:
        """Pivots, the points around them and, for three fields, the second points, as iCatalogs numbers them (from 1); the last number stands for what it leaves out.

        With one catalog all are that one. The default takes several catalogs in their order. With patch-with-all only the patch has pivots.
        """
        p = self.params
        wanted = numbers(p.iCatalogs)
        if len(catalogs) > 1 and p.iCatalogs == Params.iCatalogs:
            wanted = list(range(1, len(catalogs) + 1))
        # A number beyond the catalogs is the mask's, which comes last.
        wanted = [k for k in wanted if not (p.has("read-mask") and k == len(catalogs) + 1)]
        if len(catalogs) == 1:
            wanted = [1]
        if not wanted or min(wanted) < 1 or max(wanted) > len(catalogs) or len(wanted) > 3:
            raise ValueError(f"iCatalogs={p.iCatalogs} for {len(catalogs)} catalogs")
        self.same = len(set(wanted[:2])) == 1
        out = [catalogs[k - 1] for k in wanted]
        if len(out) == 1:
            out.append(out[0])
        if p.has("patch-with-all"):
            out[0] = out[0].where("mask")
        return out

    # Running.

    def run(self, levels: tuple[str, ...] = ("MainLoop",)) -> Correlator:
        """Levels build on each other: input (checks parameters), StartRun (loads), MainLoop (computes and writes)."""
        unknown = set(levels) - {"input", "StartRun_Common", "StartRun", "MainLoop"}
        if unknown:
            raise ValueError(f"no such levels: {', '.join(sorted(unknown))}")
        p = self.params
        key = (p.key, tuple(map(id, self.given)), frozenset(levels))
        if self.done == key:
            return self
        self.clean()
        began = time.process_time()
        ship(self.spark)
        self._log_file()
        for name in p.by_spark:
            log.warning("%s is accepted but not used: Spark's settings say how work is shared out", name)
        scripts = [self._script(p.preScript)] if p.preScript else []
        after = [self._script(p.posScript)] if p.posScript else []
        for hook in (*scripts, *self.before):
            hook(self)
        if set(levels) == {"input"}:
            return self
        if p.has("statistics-histograms") or p.has("edge-corrections-from-files"):
            self._from_files()
        elif p.has("header-info") and p.infile and not self.given:
            self._keep("headers", registry.headers(self.spark, p.infile, p.infileformat))
            for r in self.tables["headers"].collect():
                log.info("%s (%s): %s rows of %s, nside %s, box %s, %s", *r)
            self.points = sum(r["rows"] or 0 for r in self.tables["headers"].collect())
        else:
            # Parsed once: counts, extents and both sides of the search read what is kept, and lost parts are read again.
            catalogs = [x.persist(StorageLevel.MEMORY_AND_DISK) for x in self.load()]
            self.kept = catalogs
            self.points = catalogs[0].count()
            log.info("%d points in the first of %d catalogs", self.points, len(catalogs))
            if p.outfile and not p.has("save-ra-dec"):
                registry.write(catalogs[0], f"{p.rootDir}/{p.outfile}", p.outfileformat, box=p.lengthBox if p.has("cute-box-fmt") else None)
            if p.outfile and p.has("save-ra-dec"):
                registry.write_sky(catalogs[0], f"{p.rootDir}/{p.outfile}")
            if not p.has("stop") and not p.has("header-info") and "MainLoop" in levels:
                self._compute(catalogs)
        for hook in (*self.after, *after):
            hook(self)
        for x in self.kept:
            x.unpersist()
        self.kept = []
        self.done = key
        self.cpu_time = time.process_time() - began
        log.info("done after %.2f s of the driver's time", self.cpu_time)
        return self

    Run = run

    def _script(self, name: str) -> Callable[[Correlator], None]:
        if name not in self.scripts:
            raise ValueError(f"no function {name} in scripts")
        return self.scripts[name]

    def _log_file(self) -> None:
        """A log below rootDir with the level of verbose_log, if rootDir is a local folder."""
        p = self.params
        for old in list(log.handlers):
            if getattr(old, "pairwave", False):
                log.removeHandler(old)
                old.close()
        if not p.rootDir or "://" in p.rootDir or p.verbose_log <= 0:
            return
        folder = Path(p.rootDir.removeprefix("file:"))
        folder.mkdir(parents=True, exist_ok=True)
        handler = logging.FileHandler(folder / f"pairwave{p.suffixOutFiles}.log", mode="w")
        handler.pairwave = True
        handler.setLevel(LEVELS.get(p.verbose_log, logging.DEBUG))
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(handler)
        log.setLevel(min(LEVELS.get(max(p.verbose, p.verbose_log), logging.DEBUG), log.level))

    def _keep(self, name: str, df: DataFrame) -> None:
        """A result table: a row for each bin, or pair of bins, and multipole at most. It stays in the driver."""
        self.tables[name] = self.spark.createDataFrame(df.toArrow(), df.schema)

    def _from_files(self) -> None:
        """Statistics over saved runs, or edge corrections of one: infile names their folders."""
        p, folders = self.params, [f.strip() for f in self.params.infile.split(",")]
        self.bins = p.bins
        if p.has("edge-corrections-from-files"):
            self._keep("histZetaM_EE", edge_corrections_from_files(self.spark, folders[0], p.mChebyshev))
        else:
            for table, value in (("histNN", "n"), ("histXi2pcf", "xi")):
                self._keep(f"{table}_stat", statistics(self.spark, folders, table, "bin", value))
        self._write()

    def _bins(self) -> Bins:
        p = self.params
        box = METHODS[p.searchMethod] == "box"
        return Bins(0.0, p.rangeN, p.sizeHistN, "linear") if box and not p.useLogHist and p.searchMethod == "neighbor-boxes-omp" else p.bins

    def smoothing(self, pivots: DataFrame) -> float:
        """The side of the cells whose points one pivot stands for."""
        p = self.params
        if p.rsmooth:
            return cells.smoothing_radius(self.bins, float(p.rsmooth))
        smallest = None
        if not p.has("fix-rsmooth"):
            smallest = cells.smallest_cell(pivots, p.nsmooth) * (2.0 if p.has("default-rsmooth") else 1.0)
        return cells.smoothing_radius(self.bins, fixed=p.has("fix-rsmooth"), smallest_cell=smallest)

    def _compute(self, catalogs: list[DataFrame]) -> None:
        p = self.params
        bins = self.bins = self._bins()
        pivots, around, *third = self.roles(catalogs)
        box_search = METHODS[p.searchMethod] == "box"
        total = pivots.count()
        symmetric = self.same and not p.has("asymmetric") and not p.has("patch-with-all")
        if p.has("make-tree"):
            self._tree(pivots)
        if p.has("smooth-pivot"):
            pivots = cells.smooth_pivots(pivots, self.smoothing(pivots))
        only_pairs = box_search or bool(p.flags & {"NNCorrelation", "NNEstimator", "KKCorrelation"})
        edge = p.has("edge-corrections")
        most, many = (-1, -1) if only_pairs else (p.mChebyshev, 2 * p.mChebyshev if edge else -1)
        box = p.lengthBox if p.usePeriodic or box_search else None
        theta = p.theta if p.has("behavior-ball") else 0.0
        rule = next((r for r in ("bh86", "sw94") if p.has(r)), "default")
        reach = p.rangeN / p.theta if p.has("Rcut/theta") else None
        if p.has("two-balls"):
            return self._two_balls(pivots, around, symmetric)
        brute_force = METHODS[p.searchMethod] == "brute"
        if brute_force:
            if third:
                raise ValueError("brute compares two catalogs at most")
            found, pairs_ = brute(pivots, around, bins, most, counts=many, box=box, same=self.same, reach=reach)
        else:
            safe = p.has("one-ball")
            # nsmooth, where set, says how many points the finest cell has; else cells are used where they are worth it.
            cell = cells.smallest_cell(pivots, p.nsmooth) or None if safe and p.nsmooth != Params.nsmooth else None
            found = sweep(pivots, around, bins, most, counts=many, box=box, same=self.same, theta=theta, rule=rule, cell=cell, third=third[0] if third else None, reach=reach, by_mass=p.has("center-of-mass"), safe=safe, counters=True, blocks="tree" if p.searchMethod == "kdtree-omp" and not box else "grid")
        self._keep("sums", found)
        sums = self.tables.pop("sums")
        if not brute_force:
            self._keep("counters", counters(sums))
        counted = box_search or p.has("compute-HistN") or p.has("and-CF") or p.has("NNEstimator")
        pairs = pair_rows(sums, bins, symmetric)
        nn = pair_rows(sums, bins, symmetric and not counted).select("bin", "r", "n")
        self._keep("histNN", nn)
        if p.has("and-CF") or p.has("NNEstimator") or box_search:
            self._keep("histCF", self._correlation(pair_rows(sums, bins).select("bin", "r", "n"), total))
        if p.has("NNCorrelation") or p.has("NNEstimator"):
            return self._write()
        self._keep("histXi2pcf", pairs)
        if third:
            self._keep("histXi2pcf13", pair_rows(sums, bins, what="pairs13"))
        if only_pairs:
            return self._write()
        plain = p.has("no-normalize-HistZeta") or edge
        zeta = threepoint.full(multipole_rows(sums, "plain" if plain else "pivot", None if plain else total), bins, p.mChebyshev)
        counts_ = multipole_rows(sums, "counts") if edge else None
        self._multipoles(zeta, counts_)
        if brute_force and p.has("out-HistZetaG"):
            self._keep("histZetaG", threepoint.by_angle(threepoint.triangles(pairs_, bins), bins, p.sizeHistPhi))
        self._write()

    def _tree(self, points: DataFrame) -> None:
        """How points fill cells of growing size, and how wide these are."""
        size = cells.smallest_cell(points, self.params.nsmooth)
        if not size:
            return
        tree = trees.rollup(points, size, 8).persist(StorageLevel.MEMORY_AND_DISK)
        self._keep("cells", tree.groupBy("level").agg(F.count("*").alias("cells"), F.max("nb").alias("most"), F.avg("nb").alias("mean_nb"), F.avg("radius").alias("mean_radius"), F.max("radius").alias("most_radius")))
        self._keep("cell_radii", trees.radius_histogram(tree))
        tree.unpersist()

    def _two_balls(self, pivots: DataFrame, around: DataFrame, symmetric: bool) -> None:
        p, bins = self.params, self.bins
        if pivots is not around:
            raise ValueError("two-balls is for one catalog, without smoothed pivots")
        found, levels = trees.two_balls(pivots, bins, cells.smallest_cell(pivots, p.nsmooth) or bins.rmax, 1)
        half = 2.0 if symmetric else 1.0
        self._keep("histNN", found.select("bin", "r", (F.col("n") / (1.0 if p.has("compute-HistN") else half)).alias("n")))
        if p.has("KKCorrelation"):
            n = F.col("n") / half
            self._keep("histXi2pcf", found.select("bin", "r", n.alias("n"), (F.col("xi") * F.greatest(F.col("n"), F.lit(1.0)) / half / F.greatest(n, F.lit(1.0))).alias("xi")))
        self._keep("counters", levels)
        self._write()

    def _correlation(self, nn: DataFrame, total: int) -> DataFrame:
        p = self.params
        out = counts.box_correlation(nn, self.bins, total, p.lengthBox)
        if p.has("cute-box-rmin"):
            out = out.withColumn("r", (F.col("bin") - 0.5) * (p.rangeN / p.sizeHistN))
        return out

    def _multipoles(self, zeta: DataFrame, many: DataFrame | None) -> None:
        p, bins, most = self.params, self.bins, self.params.mChebyshev
        self._keep("histZetaM", zeta)
        zeta = self.tables["histZetaM"]
        if many is not None:
            self._keep("histZetaM_N", many)
            self._keep("histZetaM_EE", threepoint.edge_corrected(zeta, self.tables["histZetaM_N"], most))
        if p.has("xr1r2"):
            self._keep("histZetaM_r1r2", synthesis.weighted(zeta, bins))
        if p.has("out-m-HistZeta"):
            for part in threepoint.PARTS:
                self._keep(f"mhistZetaM_{part}", synthesis.slices(zeta, bins, part))
        if p.has("out-HistZetaG"):
            self._keep("histZetaGm", synthesis.re_im(zeta))
            self._keep("histZetaG", synthesis.at_angles(zeta, p.sizeHistPhi))
            self._keep("histZetaG_fft", synthesis.dft(zeta, most))

    def _write(self) -> None:
        """Every table as Parquet below rootDir/tables, and as the text files that plotting scripts read, with the parameters that made them; nothing with no-out-Hist or without rootDir."""
        p, spark = self.params, self.spark
        if p.has("no-out-Hist") or not p.rootDir:
            return
        for name, df in self.tables.items():
            df.coalesce(1).write.mode("overwrite").parquet(f"{p.rootDir}/tables/{name}{p.suffixOutFiles}")
        path = lambda name: f"{p.rootDir}/{name}{p.suffixOutFiles}.txt"
        have = self.tables.get
        bins = self.bins.frame(spark)
        bins.coalesce(1).write.mode("overwrite").parquet(f"{p.rootDir}/tables/rBins{p.suffixOutFiles}")
        histograms.write_bins(bins, path("rBins"))
        if nn := have("histNN"):
            histograms.write_curve(nn, path(p.histNNFileName), "n")
        if cf := have("histCF"):
            histograms.write_curve(cf, path("histCF"), "cf")
            histograms.write_counts(cf, path("histCF_errors"))
        for name, suffix in (("histXi2pcf", ""), ("histXi2pcf13", "13")):
            if xi := have(name):
                histograms.write_curve(xi, path(p.histXi2pcfFileName + suffix), "xi")
        ends = f"{p.suffixOutFiles}.txt"
        for name in ("histZetaM", "histZetaM_r1r2"):
            if zeta := have(name):
                histograms.write_matrices(zeta, p.rootDir, p.mChebyshev, name.replace("histZeta", p.histZetaFileName, 1), ends)
        for part in threepoint.PARTS:
            if sliced := have(f"mhistZetaM_{part}"):
                histograms.write_slices(sliced, p.rootDir, p.mChebyshev, part, ends)
        if by_angle := have("histZetaG"):
            histograms.write_angles(by_angle, p.rootDir, p.sizeHistPhi, f"{p.histZetaFileName}G", suffix=ends)
        histograms.write_file(spark, f"{p.rootDir}/parameters-usedvalues", p.to_json().encode())

    # Getters.

    def _array(self, name: str, column: str) -> np.ndarray:
        if name not in self.tables:
            raise KeyError(f"this run has no {name}")
        return np.array([r[0] for r in self.tables[name].orderBy("bin").select(column).collect()])

    def _matrix(self, name: str, m: int, column: str) -> np.ndarray:
        if name not in self.tables:
            raise KeyError(f"this run has no {name}")
        out = np.zeros((self.params.sizeHistN, self.params.sizeHistN))
        for r in self.tables[name].where(F.col("m") == m - 1).select("b1", "b2", column).collect():
            out[r[0] - 1, r[1] - 1] = r[2]
        return out

    def getrBins(self) -> np.ndarray:
        return np.array(self.params.bins.centers)

    def getHistNN(self) -> np.ndarray:
        return self._array("histNN", "n")

    def getHistCF(self) -> np.ndarray:
        return self._array("histCF", "cf")

    def getHistXi2pcf(self) -> np.ndarray:
        return self._array("histXi2pcf", "xi")

    getHistXi2pcf12 = getHistXi2pcf

    def getHistXi2pcf13(self) -> np.ndarray:
        return self._array("histXi2pcf13", "xi")

    def getHistZetaMsincos(self, m: int, type: int) -> np.ndarray:
        """m from 1; type 1 cos, 2 sin, 3 sincos, 4 cossin."""
        return self._matrix("histZetaM", m, PARTS[type])

    def getHistZetaM_EE(self, m: int) -> np.ndarray:
        return self._matrix("histZetaM_EE", m, "re")

    def getNThreads(self) -> int:
        return self.spark.sparkContext.defaultParallelism

    def getnMultipoles(self) -> int:
        return self.params.mChebyshev + 1

    getnMonopoles = getnMultipoles

    def getTheta(self) -> float:
        return self.params.theta

    def getrsmooth(self) -> float:
        self.bins = self._bins()
        return self.smoothing(self.roles(self.load())[0])

    def getCPUTime(self) -> float:
        return self.cpu_time

    def getsizeHistN(self) -> int:
        return self.params.sizeHistN

    def getVersion(self) -> str:
        return __version__

    def getRootDir(self) -> str:
        return self.params.rootDir

    def getNBody(self) -> int:
        return self.points

    def state(self) -> dict:
        """All parameters as a dict."""
        return dataclasses.asdict(self.params)


def statistics(spark: SparkSession, folders: list[str], table: str, key: str, value: str) -> DataFrame:
    """Mean, deviation and range of a table's values over saved runs."""
    parts = [spark.read.parquet(f"{f}/tables/{table}") for f in folders]
    return compare.over_runs(c.union(*parts), [key], value)


def edge_corrections_from_files(spark: SparkSession, folder: str, most: int) -> DataFrame:
    """Edge-corrected multipoles from saved sums and counts."""
    return threepoint.edge_corrected(spark.read.parquet(f"{folder}/tables/histZetaM"), spark.read.parquet(f"{folder}/tables/histZetaM_N"), most)


__all__ = ["Correlator", "edge_corrections_from_files", "statistics"]
