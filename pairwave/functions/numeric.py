"""Numeric kernels: Chebyshev columns, Fourier synthesis, moments, integrals, linear systems, special functions."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chebyshev(df: DataFrame, cosine: str, sine: str, most: int) -> DataFrame:
    """df with _c0.._cM and _s0.._sM: cos and sin of multiples of an angle, by recurrence from its cosine and sine."""
    df = df.withColumns({"_c0": F.lit(1.0), "_s0": F.lit(0.0), **({"_c1": F.col(cosine), "_s1": F.col(sine)} if most else {})})
    for m in range(2, most + 1):
        df = df.withColumns({f"_{k}{m}": 2.0 * F.col(cosine) * F.col(f"_{k}{m - 1}") - F.col(f"_{k}{m - 2}") for k in "cs"})
    return df


def moments(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """n, mean, adev (mean absolute deviation), sdev, var (n - 1), skew, kurt (excess), the last two with the sample variance."""
    by = by or []
    base = df.where(F.col(column).isNotNull() & ~F.isnan(column)).select(*by, F.col(column).cast("double").alias("_v"))
    means = base.groupBy(*by).agg(F.avg("_v").alias("_mean"), F.count("*").alias("_n"), F.var_samp("_v").alias("_var"))
    joined = base.join(F.broadcast(means), by) if by else base.crossJoin(F.broadcast(means))
    d = F.col("_v") - F.col("_mean")
    return (
        joined.groupBy(*by)
        .agg(F.max("_n").alias("n"), F.max("_mean").alias("mean"), F.avg(F.abs(d)).alias("adev"), F.sqrt(F.max("_var")).alias("sdev"), F.max("_var").alias("var"), F.sum(d * d * d).alias("_c3"), F.sum(d * d * d * d).alias("_c4"))
        .withColumn("skew", F.col("_c3") / (F.col("n") * F.col("var") * F.col("sdev")))
        .withColumn("kurt", F.col("_c4") / (F.col("n") * F.col("var") * F.col("var")) - 3.0)
        .select(*by, "n", "mean", "adev", "sdev", "var", "skew", "kurt")
    )


def covariance(df: DataFrame, x: str, y: str) -> DataFrame:
    """xx, xy, yy: the 2 x 2 covariance matrix (n - 1)."""
    return df.agg(F.var_samp(x).alias("xx"), F.covar_samp(x, y).alias("xy"), F.var_samp(y).alias("yy"))


def trapezoid(df: DataFrame, order: str, value: str) -> DataFrame:
    """integral: by the trapezoid rule with unit steps."""
    return df.agg((F.sum(value) - (F.min_by(value, order) + F.max_by(value, order)) / 2.0).alias("integral"))


def fourier(df: DataFrame, by: list[str], order: str, re: str, im: str, inverse: bool = False) -> DataFrame:
    """by, k, re, im: the discrete Fourier transform of each group's values in order (an inverse one is divided by n)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        z = pdf[re].to_numpy() + 1j * pdf[im].to_numpy()
        out = np.fft.ifft(z) if inverse else np.fft.fft(z)
        return pd.DataFrame({**{b: [pdf[b].iloc[0]] * len(z) for b in by}, "k": range(len(z)), "re": out.real, "im": out.imag})

    kinds = dict(df.dtypes)
    return df.groupBy(*by).applyInPandas(run, ", ".join(f"{b} {kinds[b]}" for b in by) + ", k int, re double, im double")


def solve(df: DataFrame, by: list[str], size: int) -> DataFrame:
    """by, i, x: the solution of each group's linear system, given as rows (i, j, a) and (i, j = size, b)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((size, size + 1))
        m[pdf["i"], pdf["j"]] = pdf["a"]
        x = np.linalg.solve(m[:, :size], m[:, size])
        return pd.DataFrame({**{b: [pdf[b].iloc[0]] * size for b in by}, "i": range(size), "x": x})

    kinds = dict(df.dtypes)
    return df.groupBy(*by).applyInPandas(run, ", ".join(f"{b} {kinds[b]}" for b in by) + ", i int, x double")


def fourier_real(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """by, k, re, im: the transform of each group's real values in order, for the frequencies 0 to n/2 that tell all others."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.fft.rfft(pdf.sort_values(order)[value].to_numpy())
        return pd.DataFrame({**{b: [pdf[b].iloc[0]] * len(out) for b in by}, "k": range(len(out)), "re": out.real, "im": out.imag})

    kinds = dict(df.dtypes)
    return df.groupBy(*by).applyInPandas(run, ", ".join(f"{b} {kinds[b]}" for b in by) + ", k int, re double, im double")


def elementwise(function: Callable[[np.ndarray], np.ndarray], single: bool = False) -> Callable[[Column], Column]:
    """A function of an array as a function of Columns, in Arrow batches; null stays null. single: a function of one number, which is mapped."""

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out = pd.Series(np.nan, part.index, "float64")
            known = part.notna()
            values = part[known].to_numpy()
            if len(values):
                out[known] = [function(v) for v in values.tolist()] if single else function(values)
            yield out.where(known, None)

    return lambda c: run(c.cast("double"))


def quadrature(f: Callable[[np.ndarray, np.ndarray], np.ndarray], x, top, steps: int):
    """Integrals over t from 0 to top (a number, or one for each x) of f(x, t) by the midpoint rule; x: a number or an array, a part of it at a time."""
    flat = np.atleast_1d(np.asarray(x, np.float64)).ravel()
    tops = np.broadcast_to(np.asarray(top, np.float64), flat.shape) if np.ndim(top) else np.full(flat.shape, float(top))
    out, middle = np.empty(len(flat)), (np.arange(steps) + 0.5) / steps
    for at in range(0, len(flat), max(1, (1 << 20) // steps)):
        part = slice(at, at + max(1, (1 << 20) // steps))
        t = middle[None, :] * tops[part, None]
        out[part] = f(flat[part, None], t).sum(1) * tops[part] / steps
    return float(out[0]) if np.ndim(x) == 0 else out.reshape(np.shape(x))


def bessel_j(n: int, x, steps: int = 400):
    """J_n(x) from its integral over half a turn."""
    return quadrature(lambda v, t: np.cos(n * t - v * np.sin(t)) / math.pi, x, math.pi, steps)


def bessel_i(n: int, x, steps: int = 400):
    """I_n(x) from its integral over half a turn."""
    return quadrature(lambda v, t: np.exp(v * np.cos(t)) * np.cos(n * t) / math.pi, x, math.pi, steps)


def bessel_k(n: int, x, steps: int = 4000):
    """K_n(x), x > 0, from the integral of exp(-x cosh t) cosh(n t)."""
    top = np.arccosh(1 + 750 / np.asarray(x, np.float64))
    return quadrature(lambda v, t: np.exp(-v * np.cosh(t)) * np.cosh(n * t), x, top, steps)


def gamma_p(a: float, x):
    """The regularised lower incomplete gamma function: its power series, or 1 less the integral of the rest."""
    flat = np.atleast_1d(np.asarray(x, np.float64)).ravel()
    out = np.zeros(len(flat))
    near, far = np.flatnonzero((flat > 0) & (flat < a + 40)), np.flatnonzero(flat >= a + 40)
    if len(near):
        v = flat[near]
        term = np.full(len(v), 1.0 / a)
        total, k = term.copy(), a
        while (np.abs(term) > np.abs(total) * 1e-16).any():
            k += 1
            term = term * v / k
            total += term
        out[near] = np.minimum(1.0, total * np.exp(a * np.log(v) - v - math.lgamma(a)))
    if len(far):
        v = flat[far]
        rest = quadrature(lambda u, t: np.exp(-t) * (1 + t / u) ** (a - 1), v, 40.0, 20000)
        out[far] = 1.0 - rest * np.exp((a - 1) * np.log(v) - v - math.lgamma(a))
    return float(out[0]) if np.ndim(x) == 0 else out.reshape(np.shape(x))


def expint1(x, steps: int = 40000):
    """E_1(x), x > 0: the integral of exp(-x e^s) over s from 0."""
    return quadrature(lambda v, s: np.exp(-v * np.exp(s)), x, np.log(1 + 750 / np.asarray(x, np.float64)), steps)


def find_root(f: Callable[[float], float], low: float, high: float, tolerance: float = 1e-12) -> float:
    """A root between low and high, where f changes sign: halving, with a secant step where it falls inside."""
    a, b = f(low), f(high)
    if a * b > 0:
        raise ValueError("no change of sign")
    while high - low > tolerance * max(1.0, abs(low) + abs(high)):
        mid = low - a * (high - low) / (b - a) if a != b else (low + high) / 2
        if not low < mid < high or min(mid - low, high - mid) < 0.01 * (high - low):
            mid = (low + high) / 2
        v = f(mid)
        if v == 0:
            return mid
        if a * v < 0:
            high, b = mid, v
        else:
            low, a = mid, v
    return (low + high) / 2
