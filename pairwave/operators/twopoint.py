"""Two-point functions of a field: products of values, averaged over pairs in distance bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bins import Bins
from .counts import on_bins
from .pairs import grid_pairs


def field_correlation(pairs: DataFrame, bins: Bins, *, pivot: Column | None = None, symmetric: bool = True) -> DataFrame:
    """bin, r, n, xi: sum of pivot value times field over max(pairs, 1).

    pivot: the value of the pivot, its field by default. symmetric: numbers of pairs and sums are halved, as each pair comes
    twice; the ratio only changes in bins with a single pair.
    """
    value = (F.col("pkappa") if pivot is None else pivot) * F.col("qkappa")
    half = 2.0 if symmetric else 1.0
    found = bins.near(pairs).groupBy("bin").agg((F.count("*") / half).alias("n"), (F.sum(value) / half).alias("_s"))
    return on_bins(found.withColumn("xi", F.col("_s") / F.greatest("n", F.lit(1.0))), bins, "n", "xi")


def auto(df: DataFrame, bins: Bins, *, box: float | None = None, symmetric: bool = True) -> DataFrame:
    return field_correlation(grid_pairs(df, df, bins.rmax, box=box), bins, symmetric=symmetric)


def crossed(p: DataFrame, q: DataFrame, bins: Bins, *, box: float | None = None) -> DataFrame:
    return field_correlation(grid_pairs(p, q, bins.rmax, box=box, same=False), bins, symmetric=False)


def pivot_crossed(p: DataFrame, q: DataFrame, s: DataFrame, bins: Bins, *, box: float | None = None) -> DataFrame:
    """bin, r, xi12, xi13: one catalog of pivots against two others."""
    a, b = (crossed(p, x, bins, box=box) for x in (q, s))
    return a.select("bin", "r", F.col("xi").alias("xi12")).join(b.select("bin", F.col("xi").alias("xi13")), "bin")
