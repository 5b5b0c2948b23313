"""Three-point functions by multipoles: angular moments around each pivot, then products of moments.

For pivot p, bin n and multipole m, C = sum of kappa cos(m phi) and S = sum of kappa sin(m phi) over the points in the
bin. The multipoles of the three-point function are averages over pivots of w C C, w S S, w S C and w C S for each pair
of bins. Pairs are shuffled once, by cell; moments and products are grouped within the cell, and only sums by (bin, bin)
leave it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.bins import Bins, angle_bin
from ..functions.numeric import chebyshev
from .pairs import CELL

NORMS = ("pivot", "none")
PARTS = ("cc", "ss", "sc", "cs")


def moments(pairs: DataFrame, bins: Bins, most: int, *, plane: bool = False, weight: Column | None = None, field: Column | None = None) -> DataFrame:
    """CELL, pid, w, bin, n, k2 (sum of squared fields), c0..cM, s0..sM by pivot and bin.

    weight: the pivot's value, its field by default; field: the value of the points around, their field by default.
    """
    p, d = g.cols("p"), g.cols("d")
    near = bins.near(pairs).withColumn("_r", F.sqrt("r2"))
    cosine, sine = g.direction_in_plane(d, F.col("_r")) if plane else g.direction_on_sphere(p, d, F.col("_r"))
    near = near.select(*CELL, "pid", (F.col("pkappa") if weight is None else weight).alias("w"), "bin", (F.col("qkappa") if field is None else field).alias("_k"), cosine.alias("_c"), sine.alias("_s"))
    near = chebyshev(near, "_c", "_s", most)
    sums = [F.sum(F.col("_k") * F.col(f"_{kind}{m}")).alias(f"{kind}{m}") for kind in "cs" for m in range(most + 1)]
    return near.groupBy(*CELL, "pid", "w", "bin").agg(F.count("*").alias("n"), F.sum(F.col("_k") * F.col("_k")).alias("k2"), *sums)


def multipoles(moments_: DataFrame, most: int, pivots: int, *, norm: str = "pivot", scale: float = 1.0, drop_degenerate: bool = False) -> DataFrame:
    """m, b1, b2, cc, ss, sc, cs for pairs of bins that some pivot fills.

    norm "pivot": moments are divided by the pivot's number of points in the bin, sums by the number of pivots; "none":
    plain sums. drop_degenerate: takes out of the diagonal the terms in which both points are one.
    """
    if norm not in NORMS:
        raise ValueError(f"no such norm: {norm}")
    each = F.greatest(F.col("n"), F.lit(1)).cast("double") if norm == "pivot" else F.lit(1.0)
    names = [f"{kind}{m}" for kind in "cs" for m in range(most + 1)]
    scaled = moments_.select(*CELL, "pid", "w", "bin", (F.col("k2") / (each * each)).alias("k2"), *[(F.col(c) / each).alias(c) for c in names])
    lists = scaled.groupBy(*CELL, "pid", "w").agg(F.collect_list(F.struct("bin", "k2", *names)).alias("v"))  # one entry a bin at most
    both = lists.select("w", "v", F.explode("v").alias("a")).select("w", "a", F.explode("v").alias("b"))
    factor = F.lit(scale / pivots if norm == "pivot" else scale)
    same = F.when(F.col("a.bin") == F.col("b.bin"), F.col("a.k2")).otherwise(0.0) if drop_degenerate else F.lit(0.0)
    sums = []
    for m in range(most + 1):
        for part in PARTS:
            # The squared fields of a bin are the sum of their cos^2 and sin^2 parts; all is taken from the first.
            less = same if part == "cc" else F.lit(0.0)
            sums.append((F.sum(F.col("w") * (F.col(f"a.{part[0]}{m}") * F.col(f"b.{part[1]}{m}") - less)) * factor).alias(f"{part}{m}"))
    wide = both.groupBy(F.col("a.bin").alias("b1"), F.col("b.bin").alias("b2")).agg(*sums)
    rows = F.inline(F.array(*[F.struct(F.lit(m).alias("m"), *[F.col(f"{part}{m}").alias(part) for part in PARTS]) for m in range(most + 1)]))
    return wide.select("b1", "b2", rows).select("m", "b1", "b2", *PARTS)


def full(zeta: DataFrame, bins: Bins, most: int) -> DataFrame:
    """zeta with a row for each m, b1, b2; zeros where no pivot fills both bins."""
    spark = zeta.sparkSession
    b = spark.range(1, bins.n + 1)
    grid = spark.range(most + 1).select(F.col("id").cast("int").alias("m")).crossJoin(b.select(F.col("id").cast("int").alias("b1"))).crossJoin(b.select(F.col("id").cast("int").alias("b2")))  # (M + 1) n^2 rows by parameters
    return grid.join(F.broadcast(zeta), ["m", "b1", "b2"], "left").select("m", "b1", "b2", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in PARTS])


def ratio(zeta: DataFrame, counts: DataFrame) -> DataFrame:
    """zeta divided by the monopole of the counts: both with norm "none"."""
    n0 = counts.where("m = 0").select("b1", "b2", F.col("cc").alias("_n0"))
    return zeta.join(n0, ["b1", "b2"]).where("_n0 <> 0").select("m", "b1", "b2", *[(F.col(c) / F.col("_n0")).alias(c) for c in PARTS])


def edge_corrected(zeta: DataFrame, counts: DataFrame, most: int) -> DataFrame:
    """m, b1, b2, re, im: multipoles freed of the mixing that an uneven distribution of angles causes.

    In the angle between both points, sums K and counts N obey K_m = sum over k of Z_k N_(m - k); zeta has K for m up to M,
    counts N for m up to 2 M, both with norm "none". The system of 2 M + 1 equations is solved for each pair of bins.
    """
    complex_ = lambda df, tag: df.select("m", "b1", "b2", (F.col("cc") + F.col("ss")).alias("re"), (F.col("sc") - F.col("cs")).alias("im"), F.lit(tag).alias("kind"))
    both = complex_(zeta, 0).unionByName(complex_(counts, 1))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        k, n = np.zeros(2 * most + 1, complex), np.zeros(4 * most + 1, complex)
        for kind, m, re, im in zip(pdf["kind"], pdf["m"], pdf["re"], pdf["im"], strict=True):
            target, middle = (k, most) if kind == 0 else (n, 2 * most)
            if m <= middle:
                target[middle + m], target[middle - m] = re + 1j * im, re - 1j * im
        at = np.arange(2 * most + 1)
        matrix = n[at[:, None] - at[None, :] + 2 * most]
        z = np.linalg.lstsq(matrix, k, rcond=None)[0][most:]
        return pd.DataFrame({"m": range(most + 1), "b1": pdf["b1"].iloc[0], "b2": pdf["b2"].iloc[0], "re": z.real, "im": z.imag})

    return both.groupBy("b1", "b2").applyInPandas(solve, "m int, b1 int, b2 int, re double, im double")


def triangles(pairs: DataFrame, bins: Bins, *, plane: bool = False) -> DataFrame:
    """pid, w, b1, b2, product, dphi: every pivot with two points around it, listed one by one: for tests of small catalogs."""
    p, d = g.cols("p"), g.cols("d")
    near = bins.near(pairs).withColumn("_r", F.sqrt("r2"))
    cosine, sine = g.direction_in_plane(d, F.col("_r")) if plane else g.direction_on_sphere(p, d, F.col("_r"))
    arm = near.select(*CELL, "pid", F.col("pkappa").alias("w"), "qid", F.col("qkappa").alias("k"), "bin", F.atan2(sine, cosine).alias("phi"))
    a, b = arm.alias("a"), arm.alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*CELL, "pid")]
    return a.join(b, on).select(F.col("a.pid").alias("pid"), F.col("a.w").alias("w"), F.col("a.bin").alias("b1"), F.col("b.bin").alias("b2"), (F.col("a.k") * F.col("b.k")).alias("product"), (F.col("a.phi") - F.col("b.phi")).alias("dphi"))


def by_angle(triangles_: DataFrame, bins: Bins, angles: int) -> DataFrame:
    """l, phi, b1, b2, re, im (0): sums of products of triangles by the angle between both arms, for every bin of angles and distances."""
    turn = F.pmod("dphi", F.lit(2 * math.pi))
    found = triangles_.select((angle_bin(turn, angles) - 1).alias("l"), "b1", "b2", (F.col("w") * F.col("product")).alias("_v")).groupBy("l", "b1", "b2").agg(F.sum("_v").alias("re"))
    return on_angles(found, bins, angles)


def on_angles(found: DataFrame, bins: Bins, angles: int) -> DataFrame:
    """l, phi, b1, b2, re, im (0) for every bin of angles and distances, 0 where found has no re."""
    spark = found.sparkSession
    b = spark.range(1, bins.n + 1)
    grid = spark.range(angles).select(F.col("id").cast("int").alias("l")).crossJoin(b.select(F.col("id").cast("int").alias("b1"))).crossJoin(b.select(F.col("id").cast("int").alias("b2")))  # angles n^2 rows by parameters
    phi = (F.col("l") + 0.5) * (2 * math.pi / angles)
    return grid.join(F.broadcast(found), ["l", "b1", "b2"], "left").select("l", phi.alias("phi"), "b1", "b2", F.coalesce("re", F.lit(0.0)).alias("re"), F.lit(0.0).alias("im"))
