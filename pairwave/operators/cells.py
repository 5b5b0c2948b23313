"""Cells: summaries of points by cube, a pyramid of them, pivot smoothing and approximate pair sums."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.bins import Bins
from .counts import on_bins
from .pairs import grid_pairs

#: Factors of the smoothing radius.
THETA, MOST_SHARE, FIXED_SHARE = 1.25, 0.05, 0.01


#: Bits of a cell's number on each axis.
AXIS_BITS = 21


def _spread(n: Column) -> Column:
    """The bits of a number at every third place: its binary digits read as octal ones."""
    return F.conv(F.bin(n), 8, 10).cast("long")


def morton(size: float) -> Column:
    """Interleaved cell numbers of x, y, z for cubes of a side, counted from -2^20 sides; a point farther off is an error."""
    out = F.lit(0).cast("long")
    for k, c in enumerate("xyz"):
        n = F.floor(F.col(c) / size).cast("long") + (1 << AXIS_BITS - 1)
        n = F.when((n < 0) | (n >= 1 << AXIS_BITS), F.raise_error(F.lit(f"{c} is more than 2^{AXIS_BITS - 1} cells of {size} from 0")).cast("long")).otherwise(n)
        out = out.bitwiseOR(F.shiftleft(_spread(n), k))
    return out


def summaries(df: DataFrame, size: float, level: int = 0, center_of_mass: bool = False) -> DataFrame:
    """cell, nb, mass, weight, kappa (weighted mean), x, y, z (mean or mass-weighted), radius (greatest distance of a point).

    level: cells of 2^level sides, from the same keys.
    """
    keyed = df.withColumn("cell", F.shiftright(morton(size), 3 * level))
    w = F.col("mass") if center_of_mass else F.lit(1.0)
    means = keyed.groupBy("cell").agg(F.count("*").alias("nb"), F.sum("mass").alias("mass"), F.sum("weight").alias("weight"), (F.sum(F.col("weight") * F.col("kappa")) / F.count("*")).alias("kappa"), *[(F.sum(w * F.col(c)) / F.sum(w)).alias(f"m{c}") for c in "xyz"])
    far = keyed.select("cell", "x", "y", "z").join(means.select("cell", "mx", "my", "mz"), "cell").groupBy("cell").agg(F.sqrt(F.max(sum(((F.col(c) - F.col(f"m{c}")) ** 2 for c in "xyz"), F.lit(0.0)))).alias("radius"))
    return means.join(far, "cell").select("cell", "nb", "mass", "weight", "kappa", *[F.col(f"m{c}").alias(c) for c in "xyz"], "radius")


def inertia(df: DataFrame, size: float) -> DataFrame:
    """cell, nb, bounding box, and second moments of positions about their mean."""
    return extents(df.withColumn("cell", morton(size)), "cell")


def extents(keyed: DataFrame, key: str) -> DataFrame:
    """key, nb, bounding box, and second moments of positions about their mean, for each group of points."""
    second = [(F.avg(F.col(a) * F.col(b)) - F.avg(a) * F.avg(b)).alias(f"i{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")]
    return keyed.groupBy(key).agg(F.count("*").alias("nb"), *[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))], *second)


def opening(size, theta: float, rule: str = "default", dims: int = 3):
    """How near a cell of a size (number or Column) is opened, theta > 0: its size over theta ("bh86"), that times sqrt(d) / 2 ("default"), or its half diagonal plus ("sw94")."""
    if rule == "bh86":
        return size / theta
    if rule == "default":
        return size / theta * (math.sqrt(dims) / 2)
    if rule == "sw94":
        return size * (math.sqrt(dims) / 2) * (1 + 1 / theta)
    raise ValueError(f"no such rule: {rule}")


def opening_radius(size: Column, theta: float, rule: str = "default", dims: int = 3) -> Column:
    """The same as a Column; with theta 0 or rule "exact" a cell is always opened."""
    return F.lit(float("inf")) if theta == 0 or rule == "exact" else opening(size, theta, rule, dims)


def samples(df: DataFrame, size: float, by_mass: bool = False) -> DataFrame:
    """id (0), x, y, z (means, by_mass: weighted by mass), kappa (mean), nb of each cube that holds points: what stands for its points where they are far."""
    nb = F.col("nb") if "nb" in df.columns else F.lit(1.0)
    mass = F.col("mass") if by_mass and "mass" in df.columns else nb
    keyed = df.select(*[F.floor(F.col(c) / size).alias(f"g{c}") for c in "xyz"], "x", "y", "z", "kappa", nb.cast("double").alias("nb"), mass.cast("double").alias("_mass"))
    mean = lambda c, w: (F.sum(F.col(c) * F.col(w)) / F.sum(w)).alias(c)
    return keyed.groupBy("gx", "gy", "gz").agg(F.sum("nb").alias("nb"), *[mean(c, "_mass") for c in "xyz"], mean("kappa", "nb")).select(F.lit(0).cast("long").alias("id"), "x", "y", "z", "kappa", "nb")


def pyramid(df: DataFrame, size: float, levels: int) -> DataFrame:
    """level, cell, nb, mass, weight, kappa, x, y, z, radius: summaries of cells of size, 2 size, 4 size, ...; one pass over the points serves all levels but their radii."""
    keyed = df.withColumn("_k", morton(size)).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))).withColumn("cell", F.expr("shiftright(_k, 3 * level)"))
    by = ["level", "cell"]
    means = keyed.groupBy(*by).agg(F.count("*").alias("nb"), F.sum("mass").alias("mass"), F.sum("weight").alias("weight"), (F.sum(F.col("weight") * F.col("kappa")) / F.count("*")).alias("kappa"), *[F.avg(c).alias(f"m{c}") for c in "xyz"])
    distance = sum(((F.col(c) - F.col(f"m{c}")) ** 2 for c in "xyz"), F.lit(0.0))
    far = keyed.select(*by, "x", "y", "z").join(means.select(*by, "mx", "my", "mz"), by).groupBy(*by).agg(F.sqrt(F.max(distance)).alias("radius"))
    return means.join(far, by).select(*by, "nb", "mass", "weight", "kappa", *[F.col(f"m{c}").alias(c) for c in "xyz"], "radius")


def smoothing_radius(bins: Bins, rsmooth_arcmin: float | None = None, fixed: bool = False, smallest_cell: float | None = None) -> float:
    """In radians: as given, 1 % of the range, or the smallest cell, but no more than 5 % of the range; times THETA."""
    if rsmooth_arcmin is not None:
        r = rsmooth_arcmin / 3437.74677
    else:
        r = FIXED_SHARE * bins.rmax if fixed or smallest_cell is None else smallest_cell
    return THETA * min(r, MOST_SHARE * bins.rmax)


def smallest_cell(df: DataFrame, points: int) -> float:
    """The side of cells that hold so many points each, if they fill the widest face of their bounding box evenly: a row from one pass."""
    box = df.agg(F.count("*").alias("n"), *[(F.max(c) - F.min(c)).alias(c) for c in "xyz"]).first()
    if not box["n"]:
        return 0.0
    wide = sorted(box[c] for c in "xyz")
    return math.sqrt(wide[1] * wide[2] * points / box["n"])


def smooth_pivots(df: DataFrame, size: float) -> DataFrame:
    """Pivots that stand for all points of their cell: id (the least), position of that point, nb, kappa (mean), kappa_sum.

    Which point absorbs which depends on order in a serial scan; here it depends on positions alone.
    """
    keyed = df.withColumns({f"g{c}": F.floor(F.col(c) / size) for c in "xyz"})
    lead = F.min(F.struct("id", "x", "y", "z"))
    out = keyed.groupBy("gx", "gy", "gz").agg(lead.alias("p"), F.count("*").alias("nb"), F.sum("kappa").alias("kappa_sum"))
    return out.select("p.id", "p.x", "p.y", "p.z", "nb", (F.col("kappa_sum") / F.col("nb")).alias("kappa"), "kappa_sum")


def active(df: DataFrame, pivots: DataFrame) -> DataFrame:
    """df with active: whether a point is still a pivot."""
    return df.join(pivots.select("id", F.lit(True).alias("_on")), "id", "left").withColumn("active", F.coalesce("_on", F.lit(False))).drop("_on")


def approximate_correlation(df: DataFrame, bins: Bins, size: float) -> DataFrame:
    """bin, r, n, xi with each cell taken as one point of its number of points: near the exact result where size is far below the bins' widths."""
    cells = summaries(df.select("id", "x", "y", "z", "kappa", F.lit(1.0).alias("weight"), F.lit(1.0).alias("mass")), size).select(F.col("cell").alias("id"), "x", "y", "z", "kappa", F.col("nb").cast("double").alias("weight"))
    pairs = grid_pairs(cells, cells, bins.rmax)
    n = F.col("pweight") * F.col("qweight")
    found = bins.near(pairs).groupBy("bin").agg(F.sum(n).alias("n"), F.sum(n * F.col("pkappa") * F.col("qkappa")).alias("_s"))
    return on_bins(found.withColumn("xi", F.col("_s") / F.greatest("n", F.lit(1.0))), bins, "n", "xi")


def diagnostics(df: DataFrame, size: float, levels: int) -> DataFrame:
    """level, cells, most, mean_nb: how points fill cells of growing size."""
    keyed = df.select(morton(size).alias("k"))
    by = keyed.select(F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level"), "k").select("level", F.expr("shiftright(k, 3 * level)").alias("cell"))
    return by.groupBy("level", "cell").count().groupBy("level").agg(F.count("*").alias("cells"), F.max("count").alias("most"), F.avg("count").alias("mean_nb"))


def halves(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """df with half 0 or 1: below or from the median of column in each group on."""
    w = Window.partitionBy(*by).orderBy(column, "id")
    return df.withColumn("half", (F.ntile(2).over(w) - 1).cast("int"))


def kd_tree(df: DataFrame, levels: int, accuracy: int = 10_000) -> DataFrame:
    """df with node: a number from 2^levels on, its leaf in a tree that halves each node at the median of its widest axis; node >> k is the ancestor k levels up.

    Medians are taken by partial aggregates, good to 1 / accuracy of a node's points, so no node is one task. Points on a median go to the
    lower half, equal points stay together.
    """
    out = df.withColumn("node", F.lit(1).cast("long"))
    for _ in range(levels):
        wide = F.greatest(*[F.max(c) - F.min(c) for c in "xyz"])
        axis = F.when(F.max("x") - F.min("x") == wide, 0).when(F.max("y") - F.min("y") == wide, 1).otherwise(2)
        cuts = out.groupBy("node").agg(axis.alias("_axis"), *[F.percentile_approx(c, 0.5, accuracy).alias(f"_m{c}") for c in "xyz"]).withColumnRenamed("node", "_node")
        value, cut = (F.when(F.col("_axis") == 0, F.col(f"{p}x")).when(F.col("_axis") == 1, F.col(f"{p}y")).otherwise(F.col(f"{p}z")) for p in ("", "_m"))
        joined = out.join(F.broadcast(cuts), F.col("node") == F.col("_node"))  # 2^levels rows at most
        out = joined.withColumn("node", F.col("node") * 2 + (value > cut).cast("long")).drop("_node", "_axis", "_mx", "_my", "_mz")
    return out
