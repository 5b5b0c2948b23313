"""Comparing curves: errors, residuals, interpolation, smoothing, peaks, statistics over runs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EPS = 1e-30


def crop(df: DataFrame, column: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Rows with a finite column, within bounds."""
    df = df.where(F.col(column).isNotNull() & ~F.isnan(column) & (F.abs(column) != float("inf")))
    if low is not None:
        df = df.where(F.col(column) >= low)
    return df if high is None else df.where(F.col(column) <= high)


def interpolate(source: DataFrame, reference: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, x, y of reference with y_source: source (by, x, y) read at reference's x by straight lines; null outside its range.

    Curves are short, a row for each bin; many of them are told apart by `by`.
    """
    by = by or []
    w = Window.partitionBy(*by).orderBy("x")
    segments = source.select(*by, F.col("x").alias("_x0"), F.col("y").alias("_y0"), F.lead("x").over(w).alias("_x1"), F.lead("y").over(w).alias("_y1"))
    inside = (F.col("x") >= F.col("_x0")) & (F.col("x") < F.col("_x1")) | (F.col("_x1").isNull() & (F.col("x") == F.col("_x0")))
    on = inside
    for b in by:
        on = on & (F.col(f"r.{b}") == F.col(f"s.{b}"))
    joined = reference.alias("r").join(F.broadcast(segments.alias("s")), on, "left")
    y = F.when(F.col("_x1").isNull(), F.col("_y0")).otherwise(F.col("_y0") + (F.col("_y1") - F.col("_y0")) * (F.col("x") - F.col("_x0")) / (F.col("_x1") - F.col("_x0")))
    return joined.select(*[F.col(f"r.{b}") for b in by], F.col("r.x").alias("x"), F.col("r.y").alias("y"), y.alias("y_source"))


def _valid(df: DataFrame, y: str, ref: str) -> DataFrame:
    return crop(crop(df, y), ref)


def error_stats(df: DataFrame, y: str, ref: str, by: list[str] | None = None) -> DataFrame:
    """mae, rmse, l1 in percent of the reference."""
    d = F.col(y) - F.col(ref)
    size = F.greatest(F.abs(ref), F.lit(EPS))
    return _valid(df, y, ref).groupBy(*(by or [])).agg((100.0 * F.avg(F.abs(d) / size)).alias("mae"), (100.0 * F.sqrt(F.avg((d / size) * (d / size)))).alias("rmse"), (100.0 * F.sum(F.abs(d)) / F.greatest(F.sum(F.abs(ref)), F.lit(EPS))).alias("l1"))


def residuals(df: DataFrame, y: str, ref: str) -> DataFrame:
    """df with residual in percent of the reference; null where either isn't finite."""
    ok = F.col(y).isNotNull() & F.col(ref).isNotNull() & ~F.isnan(y) & ~F.isnan(ref)
    return df.withColumn("residual", F.when(ok, 100.0 * (F.col(y) - F.col(ref)) / F.greatest(F.abs(ref), F.lit(EPS))))


def gaussian_smooth(df: DataFrame, order: str, value: str, sigma: float = 2.0, by: list[str] | None = None) -> DataFrame:
    """df with smooth: value weighted by a Gaussian over neighbouring rows, cut at three sigma; beyond the ends it counts as 0."""
    sigma = max(0.5, float(sigma))
    half = int(3 * sigma)
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-half, half + 1)]
    total = sum(weights)
    w = Window.partitionBy(*(by or [])).orderBy(order)
    parts = [F.coalesce(F.lead(value, k).over(w) if k > 0 else F.lag(value, -k).over(w), F.lit(0.0)) * (x / total) for k, x in zip(range(-half, half + 1), weights, strict=True)]
    return df.withColumn("smooth", sum(parts[1:], parts[0]))


def bao_peak(df: DataFrame, low: float = 80.0, high: float = 140.0, sigma: float = 3.0) -> DataFrame:
    """r, peak: where smoothed r^2 xi is greatest within bounds; the first of equal ones. df: r, xi."""
    smooth = gaussian_smooth(df.withColumn("_v", F.col("r") * F.col("r") * F.col("xi")), "r", "_v", sigma)
    best = smooth.where((F.col("r") >= low) & (F.col("r") <= high)).agg(F.max(F.struct("smooth", (-F.col("r")).alias("_r"))).alias("b"))
    return best.where("b is not null").select((-F.col("b._r")).alias("r"), F.col("b.smooth").alias("peak"))


def over_runs(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, std (n - 1), median, least, most of each key's values over saved runs."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.median(value).alias("median"), F.min(value).alias("least"), F.max(value).alias("most"))


def run_covariance(df: DataFrame, run: str, key: str, value: str) -> DataFrame:
    """a, b, cov: covariance over runs between each two keys (bins)."""
    left, right = (df.select(F.col(run), F.col(key).alias(k), F.col(value).alias(v)) for k, v in (("a", "_va"), ("b", "_vb")))
    return left.join(right, run).groupBy("a", "b").agg(F.covar_samp("_va", "_vb").alias("cov"))
