"""Generated catalogs: lattices and random points."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import catalog, in_patch
from ..functions.geometry import sphere
from .binary import wave

#: Mean and deviation of the convergence that the random sphere is given.
KAPPA_MEAN, KAPPA_SD = 2.936728e-08, 6.528639e-03


def _side_count(n: int, dims: int = 3) -> int:
    """The greatest k with k^dims <= n."""
    k = round(n ** (1 / dims))
    return k if k**dims <= n else k - 1


def simple_cubic(spark: SparkSession, nbody: int, length: float = 1.0, **_) -> DataFrame:
    """A lattice of floor(nbody^(1/3))^3 points with a margin of 5 %."""
    k = _side_count(nbody)
    if k < 2:
        raise ValueError("a lattice needs eight points at least")
    margin = 0.05 * length
    step = (1 - 2 * margin / length) * length / (k - 1)
    i = F.col("id")
    at = {"x": F.floor(i / (k * k)), "y": F.floor(i / k) % k, "z": i % k}
    df = spark.range(k**3).withColumns({c: v * step + margin for c, v in at.items()})
    return catalog(df.withColumn("kappa", wave(F.lit(float(length)))))


def simple_cubic_random(spark: SparkSession, nbody: int, length: float = 1.0, seed: int = 123, **_) -> DataFrame:
    """floor(nbody^(1/3))^3 points at random in a cube."""
    df = spark.range(_side_count(nbody) ** 3).withColumns({c: F.rand(seed + k) * length for k, c in enumerate("xyz")})
    return catalog(df.withColumn("kappa", wave(F.lit(float(length)))))


def unit_sphere_random(spark: SparkSession, nbody: int, seed: int = 123, patch: tuple[float, float, float, float] | None = None, constant: float | None = None, convention: str = "colatitude", whole: bool = False, **_) -> DataFrame:
    """Points at random on the unit sphere with a Gaussian field; patch: only those within (thetaL, thetaR, phiL, phiR), or with whole all, whose mask says which."""
    df = spark.range(nbody).withColumns({"phi": 2 * math.pi * F.rand(seed), "theta": F.acos(1.0 - 2.0 * F.rand(seed + 1))})
    inside = in_patch(F.col("theta"), F.col("phi"), *patch) if patch else F.lit(True)
    df = df.withColumn("mask", inside) if whole else df.where(inside)
    xyz = sphere(F.col("phi"), F.col("theta"), convention)
    kappa = F.lit(float(constant)) if constant is not None else KAPPA_MEAN + KAPPA_SD * F.randn(seed + 2)
    return catalog(df.withColumns({**dict(zip("xyz", xyz, strict=True)), "kappa": kappa}))


def shell(spark: SparkSession, n: int, radius: float = 1.0, seed: int = 1) -> DataFrame:
    """Points at random on a sphere."""
    return unit_sphere_random(spark, n, seed, constant=1.0).withColumns({c: F.col(c) * radius for c in "xyz"})


def ball(spark: SparkSession, n: int, radius: float = 1.0, seed: int = 1) -> DataFrame:
    """Points at random in a ball."""
    r = radius * F.pow(F.rand(seed + 7), F.lit(1 / 3))
    return unit_sphere_random(spark, n, seed, constant=1.0).withColumn("_r", r).withColumns({c: F.col(c) * F.col("_r") for c in "xyz"}).drop("_r")


MODELS = {"simple-cubic": simple_cubic, "simple-cubic-random": simple_cubic_random, "unit-sphere-random": unit_sphere_random}
