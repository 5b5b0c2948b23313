"""Catalogs: the schema of points and the operators that make one catalog from others.

A catalog is a DataFrame with cat_id, id, x, y, z, kappa, weight, mass, mask, gamma1, gamma2. Two-dimensional points
have z = 0. Fields that a source lacks get the defaults below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .functions import geometry as g

SCHEMA = T.StructType(
    [
        T.StructField("cat_id", T.IntegerType()), T.StructField("id", T.LongType()),
        *(T.StructField(c, T.DoubleType()) for c in ("x", "y", "z", "kappa", "weight", "mass")),
        T.StructField("mask", T.BooleanType()), T.StructField("gamma1", T.DoubleType()), T.StructField("gamma2", T.DoubleType()),
    ]
)
DEFAULTS = {"cat_id": 0, "z": 0.0, "kappa": 1.0, "weight": 1.0, "mass": 1.0, "mask": True, "gamma1": None, "gamma2": None}
#: Size of the random step that parts equal positions.
JITTER = 1e-4


def catalog(df: DataFrame, **defaults) -> DataFrame:
    """df with the catalog's columns and no others."""
    fill = DEFAULTS | defaults
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(fill[f.name])).cast(f.dataType).alias(f.name) for f in SCHEMA.fields])


def union(*catalogs: DataFrame) -> DataFrame:
    """All points of several catalogs as one; cat_id tells where a point comes from, ids stay."""
    out = catalogs[0]
    for c in catalogs[1:]:
        out = out.unionByName(c, allowMissingColumns=True)
    return out


def combined(*catalogs: DataFrame) -> DataFrame:
    """All points of several catalogs as one whose points are told apart: of k catalogs, the n-th (from 0) has ids k id + n.

    Pairs leave out equal ids, so points of different files must not share one.
    """
    return union(*[c.withColumn("id", F.col("id") * len(catalogs) + n) for n, c in enumerate(catalogs)])


def number(df: DataFrame) -> DataFrame:
    """df with distinct ids (not consecutive, so no pass over all partitions is needed)."""
    return df.withColumn("id", F.monotonically_increasing_id())


def extent(df: DataFrame) -> DataFrame:
    """n and the least and greatest x, y, z: one row."""
    return df.agg(F.count("*").alias("n"), *[f(c).alias(f"{name}_{c}") for c in "xyz" for name, f in (("min", F.min), ("max", F.max))])


def center(df: DataFrame) -> DataFrame:
    """Points relative to the middle of their bounding box. Not for full skies, whose angles use absolute positions."""
    box = extent(df).select(*[((F.col(f"min_{c}") + F.col(f"max_{c}")) / 2.0).alias(f"_m{c}") for c in "xyz"])
    return df.crossJoin(F.broadcast(box)).withColumns({c: F.col(c) - F.col(f"_m{c}") for c in "xyz"}).drop("_mx", "_my", "_mz")  # one row


def root_box(df: DataFrame, start: float = 1.0) -> DataFrame:
    """size: the least start x 2^k, k >= 0, that is no less than twice the greatest coordinate."""
    most = F.greatest(*[F.max(F.abs(c)) for c in "xyz"])
    k = F.greatest(F.ceil(F.log2(2.0 * most / start)), F.lit(0))
    return df.agg(F.when(most > 0, start * F.pow(F.lit(2.0), k)).otherwise(F.lit(start)).alias("size"))


def from_sky(df: DataFrame, lon: str, lat: str, degrees: bool = False, convention: str = "latitude", radius: str | None = None) -> DataFrame:
    """df with x, y, z from longitude and latitude, on the unit sphere or at a radius."""
    to = F.radians if degrees else (lambda c: c)
    xyz = g.sphere(to(F.col(lon)), to(F.col(lat)), convention)
    r = F.col(radius) if radius else None
    return df.withColumns({c: v if r is None else v * r for c, v in zip("xyz", xyz, strict=True)})


def in_patch(theta: Column, phi: Column, theta_l: float, theta_r: float, phi_l: float, phi_r: float) -> Column:
    """Strictly inside a patch of the sky."""
    return (theta > theta_l) & (theta < theta_r) & (phi > phi_l) & (phi < phi_r)


def masked(df: DataFrame, mask: DataFrame, key: str = "pix") -> DataFrame:
    """Points whose pixel the mask keeps (a positive value)."""
    return df.join(mask.where("mask > 0").select(key), key, "left_semi")


def finite(df: DataFrame, *columns: str) -> DataFrame:
    out = df
    for c in columns or ("kappa",):
        out = out.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return out


def demean(df: DataFrame, column: str = "kappa") -> DataFrame:
    """column without its mean over finite values."""
    mean = finite(df, column).agg(F.avg(column).alias("_mean"))
    return df.crossJoin(F.broadcast(mean)).withColumn(column, F.col(column) - F.col("_mean")).drop("_mean")  # one row


def constant_field(df: DataFrame, value: float) -> DataFrame:
    return df.withColumn("kappa", F.lit(float(value)))


def duplicates(df: DataFrame) -> DataFrame:
    """x, y, z, n, first_id: positions that several points share."""
    return df.groupBy("x", "y", "z").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


def require_distinct(df: DataFrame) -> DataFrame:
    """df, or an error if two points share a position."""
    if not duplicates(df).isEmpty():
        raise ValueError("several points share a position")
    return df


def part_duplicates(df: DataFrame, size: float = JITTER, seed: int = 0) -> DataFrame:
    """df with all but the first point of each shared position moved by a random step; column active is false for those.

    Only shared positions are ranked, so a unique position costs no sort.
    """
    shared = duplicates(df).select("x", "y", "z", F.col("first_id").alias("_first"))
    tagged = df.join(shared, ["x", "y", "z"], "left").withColumn("active", F.col("_first").isNull() | (F.col("id") == F.col("_first")))
    steps = {c: F.col(c) + F.when(F.col("active"), 0.0).otherwise(size * F.randn(seed + k)) for k, c in enumerate("xyz")}
    return tagged.withColumns(steps).drop("_first")


def halo_cut(df: DataFrame, log_min: float | None = None, log_max: float | None = None, centrals: bool = True) -> DataFrame:
    """Halos with finite position and positive finite mass in a window of log10 mass; centrals by pid = -1, or type = 0 where there's no pid."""
    out = finite(df, "x", "y", "z", "mass").where("mass > 0")
    if centrals:
        if "pid" in df.columns:
            out = out.where("pid = -1")
        elif "type" in df.columns:
            out = out.where("type = 0")
    if log_min is not None:
        out = out.where(F.col("mass") >= 10.0**log_min)
    if log_max is not None:
        out = out.where(F.col("mass") < 10.0**log_max)
    return out


def cloud_in_cell(df: DataFrame, cells: int, length: float) -> DataFrame:
    """ix, iy, iz, density: mass shared among the eight nearest cells of a periodic grid, in units of its mean, less 1.

    Only cells that got mass are returned; the density of all others is -1.
    """
    scaled = {c: F.pmod(F.col(c) / length, F.lit(1.0)) * cells for c in "xyz"}
    low = {c: F.floor(v).cast("int") for c, v in scaled.items()}
    df = df.select("mass", *[F.least(low[c], F.lit(cells - 1)).alias(f"_i{c}") for c in "xyz"], *[(scaled[c] - low[c]).alias(f"_d{c}") for c in "xyz"])
    parts = []
    for k in range(8):
        up = {c: k >> j & 1 for j, c in enumerate("xyz")}
        weight = F.col("mass")
        for c in "xyz":
            weight = weight * (F.col(f"_d{c}") if up[c] else 1.0 - F.col(f"_d{c}"))
        parts.append(F.struct(*[F.pmod(F.col(f"_i{c}") + up[c], F.lit(cells)).alias(f"i{c}") for c in "xyz"], weight.alias("w")))
    total = df.agg(F.sum("mass").alias("_total"))
    sums = df.select(F.inline(F.array(*parts))).groupBy("ix", "iy", "iz").agg(F.sum("w").alias("w"))
    return sums.crossJoin(F.broadcast(total)).select("ix", "iy", "iz", (F.col("w") * float(cells**3) / F.col("_total") - 1.0).alias("density"))  # one row


def first_of_each(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")
