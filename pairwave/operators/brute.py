"""The sums of `sweep` by comparing all with all: a yardstick for small catalogs, with nothing of the sweep's own in it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bins import Bins
from . import threepoint
from .pairs import brute_pairs


def brute(pivots: DataFrame, around: DataFrame, bins: Bins, most: int = -1, *, counts: int = -1, box: float | None = None, same: bool = True, reach: float | None = None) -> tuple[DataFrame, DataFrame]:
    """what, m, b1, b2, cc, ss, sc, cs as `sweep` gives them, and the pairs, whose pkappa is multiplied by the number of points that a pivot stands for."""
    counted = lambda df: df.withColumn("nb", F.col("nb").cast("double") if "nb" in df.columns else F.lit(1.0))
    pairs = brute_pairs(counted(pivots), counted(around), min(bins.rmax, reach or bins.rmax), box=box, extra=("nb",), same=same)
    pairs = pairs.withColumn("pkappa", F.col("pkappa") * F.col("pnb"))
    near = bins.near(pairs).groupBy("bin").agg(F.sum("pnb").alias("cc"), F.sum(F.col("pkappa") * F.col("qkappa")).alias("ss"))
    zero = F.lit(0.0)
    parts = [near.select(F.lit("pairs").alias("what"), F.lit(0).alias("m"), F.col("bin").alias("b1"), F.lit(0).alias("b2"), "cc", "ss", zero.alias("sc"), zero.alias("cs"))]
    named = lambda df, what: df.select(F.lit(what).alias("what"), "m", "b1", "b2", *threepoint.PARTS)
    if most >= 0:
        moments = threepoint.moments(pairs, bins, most)
        parts += [named(threepoint.multipoles(moments, most, 1, norm=norm), what) for what, norm in (("pivot", "pivot"), ("plain", "none"))]
    if counts >= 0:
        ones = threepoint.moments(pairs, bins, counts, weight=F.col("pnb"), field=F.lit(1.0))
        parts.append(named(threepoint.multipoles(ones, counts, 1, norm="none"), "counts"))
    return reduce(DataFrame.unionByName, parts), pairs
