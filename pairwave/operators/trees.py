"""Trees of cells: summaries that are rolled up from points in one scan, shapes of nodes, and a walk with two trees.

A summary is mergeable: numbers, sums, second moments and a bounding box. So every level is made of the cells below, and the
greatest distance of a point from the mean is bounded by the box's far corner.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bins import Bins
from .cells import morton
from .sweep import counters, pair_rows, sweep

_AXES = ("x", "y", "z")
_SECOND = [(a, b) for k, a in enumerate(_AXES) for b in _AXES[k:]]


def _sums(df: DataFrame) -> list[Column]:
    """What a point adds to its cell."""
    w = F.col("weight") if "weight" in df.columns else F.lit(1.0)
    m = F.col("mass") if "mass" in df.columns else F.lit(1.0)
    kappa = F.col("kappa") if "kappa" in df.columns else F.lit(1.0)
    first = [F.count("*").alias("nb"), F.sum(m).alias("mass"), F.sum(w).alias("weight"), F.sum(w * kappa).alias("wk")]
    moments = [F.sum(m * F.col(a) * F.col(b)).alias(f"s{a}{b}") for a, b in _SECOND]
    return [*first, *[F.sum(c).alias(f"s{c}") for c in _AXES], *moments, *[F.min(c).alias(f"min_{c}") for c in _AXES], *[F.max(c).alias(f"max_{c}") for c in _AXES]]


def merged(parts: DataFrame, by: list[str]) -> DataFrame:
    """Summaries of groups of summaries."""
    names = [c for c in parts.columns if c not in by and c not in ("level", "cell", "node")]
    of = {"min": F.min, "max": F.max}
    return parts.groupBy(*by).agg(*[of.get(c[:3] if c[3:4] == "_" else "", F.sum)(c).alias(c) for c in names])


def described(sums: DataFrame) -> DataFrame:
    """Summaries with means x, y, z, kappa (sum of weighted fields by number), and radius: no point is farther from the mean."""
    mean = {c: F.col(f"s{c}") / F.col("nb") for c in _AXES}
    far = reduce(Column.__add__, [F.pow(F.greatest(F.col(f"max_{c}") - mean[c], mean[c] - F.col(f"min_{c}")), F.lit(2.0)) for c in _AXES])
    return sums.withColumns({**mean, "kappa": F.col("wk") / F.col("nb"), "radius": F.sqrt(far)})


def rollup(df: DataFrame, size: float, levels: int) -> DataFrame:
    """level, cell and a summary for each cell of size, 2 size, 4 size, ...: points are scanned and shuffled once, all levels are made of the finest cells."""
    finest = df.withColumn("_cell", morton(size)).groupBy("_cell").agg(*_sums(df))
    up = finest.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))).withColumn("cell", F.expr("shiftright(_cell, 3 * level)")).drop("_cell")
    return described(merged(up, ["level", "cell"]))


def node_summaries(df: DataFrame, levels: int, node: str = "node") -> DataFrame:
    """node and a summary for each node of a tree, from points with their leaf: leaves first, then each ancestor (node >> k) from the leaves."""
    leaves = df.withColumnRenamed(node, "_leaf").groupBy("_leaf").agg(*_sums(df))
    up = leaves.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumn("node", F.expr("shiftright(_leaf, _k)")).drop("_leaf", "_k")
    return described(merged(up, ["node"]))


def shapes(summaries: DataFrame) -> DataFrame:
    """summaries with etaxy, etaxz, etayz (deformation: how far second moments of mass are from equal in each plane) and e1 >= e2 >= e3, the eigenvalues of these moments.

    The eigenvalues come from the characteristic polynomial's roots by angles; a node without extent has equal ones.
    """
    s = {(a, b): F.col(f"s{min(a, b)}{max(a, b)}") for a in _AXES for b in _AXES}
    etas = {}
    for a, b in (("x", "y"), ("x", "z"), ("y", "z")):
        total = s[a, a] + s[b, b]
        part = F.sqrt(F.pow((s[a, a] - s[b, b]) / total, F.lit(2.0)) + F.pow(2.0 * s[a, b] / total, F.lit(2.0)))
        etas[f"eta{a}{b}"] = F.when(total > 0, part).otherwise(0.0)
    mean = (s["x", "x"] + s["y", "y"] + s["z", "z"]) / 3.0
    d = {k: v - mean if k[0] == k[1] else v for k, v in s.items()}
    p = F.sqrt(sum((d[a, b] * d[a, b] for a in _AXES for b in _AXES), F.lit(0.0)) / 6.0)
    det = d["x", "x"] * (d["y", "y"] * d["z", "z"] - d["y", "z"] * d["y", "z"]) - d["x", "y"] * (d["x", "y"] * d["z", "z"] - d["y", "z"] * d["x", "z"]) + d["x", "z"] * (d["x", "y"] * d["y", "z"] - d["y", "y"] * d["x", "z"])
    turn = F.acos(F.greatest(F.least(det / (2.0 * p * p * p), F.lit(1.0)), F.lit(-1.0))) / 3.0
    at = lambda k: F.when(p > 0, mean + 2.0 * p * F.cos(turn + k * 2 * math.pi / 3)).otherwise(mean)
    return summaries.withColumns(etas).withColumns({"e1": at(0), "e2": at(2), "e3": at(1)})


def radius_histogram(summaries: DataFrame, per_octave: int = 1) -> DataFrame:
    """level, bin, cells: how many cells have a radius from 2^(bin / per_octave) on; cells of one point have no bin."""
    b = F.when(F.col("radius") > 0, F.floor(F.log2("radius") * per_octave).cast("int"))
    return summaries.groupBy("level", b.alias("bin")).agg(F.count("*").alias("cells"))


def two_balls(df: DataFrame, bins: Bins, size: float, levels: int) -> tuple[DataFrame, DataFrame]:
    """bin, r, n, xi of all directed pairs of a catalog by a walk down two trees, and counters by level: pairs of cells looked at, accepted, opened.

    Two cells are accepted if the distances of all their points lie in one bin: so numbers of pairs and sums of products are exact. They are left out if all
    lie beyond the bins, else both are opened; pairs of finest cells (of size, or wider where these would hold few points) end at their points. The
    coarsest cells are no smaller than the radius. Both trees of a block of space are made and walked within one task, one branch at a time, so no pair of cells is stored.
    """
    sums = sweep(df, df, bins, two=(size, levels), counters=True)
    sums = sums.sparkSession.createDataFrame(sums.toArrow(), sums.schema)  # a row for each bin and level, read twice
    long = lambda c: c.cast("long")
    found = counters(sums).where("level > 0").select((F.col("level") - 1).alias("level"), long(F.col("candidates")).alias("looked_at"), long(F.col("taken")).alias("accepted"), long(F.col("candidates") - F.col("taken")).alias("opened"))
    return pair_rows(sums, bins), found
