"""The spatial range join: all pairs of points nearer than a radius.

Points are hashed by grid cell. The pivot side has one row for each point, the other side one for each cell that its ball
reaches, so an equi-join on the cell gives every pair once, in the pivot's cell. Whatever is then grouped by
(cell, pivot) needs no further shuffle. Cells with very much work are split: pivots by a salt, the other side copied
for each salt.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g

#: Keys of a cell and its salt, in all results.
CELL = ["gx", "gy", "gz", "salt"]
#: Candidate pairs of one cell from which it is split, and the pairs that a split should have.
HOT_PAIRS = 200_000_000
FIELDS = ("id", "x", "y", "z", "kappa", "weight")


def _side(df: DataFrame, prefix: str, extra: tuple[str, ...] = ()) -> DataFrame:
    have = set(df.columns)
    fill = {"z": F.lit(0.0), "kappa": F.lit(1.0), "weight": F.lit(1.0)}
    return df.select(*[(F.col(c) if c in have else fill[c]).alias(f"{prefix}{c}") for c in (*FIELDS, *extra)])


def _cells(p: DataFrame, q: DataFrame, rmax: float, box: float | None, size: float, half: bool = False) -> tuple[DataFrame, DataFrame]:
    """p with its cell, q with each cell that its ball reaches; half: only those not beyond its own along x."""
    n = max(1, math.floor(box / size)) if box else None
    step = box / n if box else size

    def cell(c: Column) -> Column:
        k = F.floor(c / step).cast("int")
        return F.pmod(k, F.lit(n)).cast("int") if n else k

    p = p.withColumns({f"g{c}": cell(F.col(f"p{c}")) for c in "xyz"})
    slack = 1e-9 * step  # rounding may put a point into the neighbouring cell; a pair too many is filtered later
    for c in "xyz":
        low, high = (F.floor((F.col(f"q{c}") + s * (rmax + slack)) / step).cast("int") for s in (-1, 1))
        if n:
            high = F.least(high, low + (n - 1))  # each cell of the ring once
        if half and c == "x" and not (n and n * step < 2 * (rmax + step)):
            high = F.floor((F.col("qx") + slack) / step).cast("int")
        q = q.withColumn(f"_c{c}", F.explode(F.sequence(low, high)))
    # The distance from q to the cell's box must not exceed the radius.
    gap = [F.greatest(F.col(f"_c{c}") * step - F.col(f"q{c}"), F.col(f"q{c}") - (F.col(f"_c{c}") + 1) * step, F.lit(0.0)) for c in "xyz"]
    if not n or n * step >= 2 * (rmax + step):
        q = q.where(g.dot(gap, gap) <= (rmax * 1.000001 + slack) ** 2)
    return p, q.select(*[(F.pmod(F.col(f"_c{c}"), F.lit(n)).cast("int") if n else F.col(f"_c{c}")).alias(f"g{c}") for c in "xyz"], *[c for c in q.columns if c[0] == "q"])


def _split(p: DataFrame, q: DataFrame, hot: int) -> tuple[DataFrame, DataFrame]:
    """p and q with a salt; cells with more than `hot` candidate pairs get several."""
    grid = CELL[:3]
    many_p, many_q = (x.groupBy(*grid).agg(F.count("*").alias(n)) for x, n in ((p, "_np"), (q, "_nq")))
    cells = many_p.join(many_q, grid).where(F.col("_np") * F.col("_nq") > hot).select(*grid, F.ceil(F.col("_np") * F.col("_nq") / hot).cast("int").alias("_splits"))
    p = p.join(cells, grid, "left").withColumn("salt", F.pmod(F.xxhash64("pid"), F.coalesce("_splits", F.lit(1))).cast("int")).drop("_splits")
    q = q.join(cells, grid, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("_splits", F.lit(1)) - 1))).drop("_splits")
    return p, q


def grid_pairs(p: DataFrame, q: DataFrame, rmax: float, *, box: float | None = None, size: float | None = None, extra: tuple[str, ...] = (), same: bool = True, hot: int = HOT_PAIRS) -> DataFrame:
    """Pairs (p, q) with 0 < r < rmax: CELL, p and q columns with prefixes p and q, dx, dy, dz = p - q, r2.

    box: side of a periodic cube; differences are to the nearest image, and rmax must not exceed half of it. same: both sides are
    one catalog, in which a point is no pair with itself. size: side of a cell. extra: more columns of both sides.
    """
    if box and rmax > box / 2:
        raise ValueError("the radius exceeds half the periodic box")
    a, b = _cells(_side(p, "p", extra), _side(q, "q", extra), rmax, box, size or rmax)
    # As many partitions as asked for: small inputs make much work here, so they must not be merged into one task.
    n, keys = _partitions(p), CELL[:3]
    if _is_hot(a, b, hot, p is q and size is None):
        (a, b), keys = _split(a, b, hot), CELL
    both = a.repartition(n, *keys).join(b.repartition(n, *keys), keys)
    return _near(both if "salt" in keys else both.withColumn("salt", F.lit(0)), rmax, box, same)


def _partitions(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def _is_hot(p: DataFrame, q: DataFrame, hot: int, twice: bool) -> bool:
    """Whether any cell may have more than `hot` candidate pairs: one number for each side, whatever the input.

    A cell gets q's points from 27 cells at most where cells are as wide as the radius. twice: both sides have the same points.
    """
    most = p.groupBy(*CELL[:3]).count().agg(F.max("count")).first()[0] or 0
    if twice and 27 * most * most <= hot:
        return False
    return most * (q.groupBy(*CELL[:3]).count().agg(F.max("count")).first()[0] or 0) > hot


def brute_pairs(p: DataFrame, q: DataFrame, rmax: float, *, box: float | None = None, extra: tuple[str, ...] = (), same: bool = True) -> DataFrame:
    """The same pairs by comparing all with all: a yardstick for small catalogs. p is dealt to many tasks, as its files may be few."""
    both = _side(p, "p", extra).repartition(_partitions(p)).crossJoin(_side(q, "q", extra)).withColumns({c: F.lit(0) for c in CELL})
    return _near(both, rmax, box, same)


def _near(both: DataFrame, rmax: float, box: float | None, same: bool) -> DataFrame:
    d = g.sub(g.cols("p"), g.cols("q"))
    if box:
        d = tuple(g.nearest_image(v, box) for v in d)
    both = both.withColumns({f"d{c}": v for c, v in zip("xyz", d, strict=True)})
    both = both.withColumn("r2", g.dot(g.cols("d"), g.cols("d"))).where((F.col("r2") > 0) & (F.col("r2") < rmax * rmax))
    return both.where("pid <> qid") if same else both


def best_side(length: float, rmax: float, n: int, fraction: float = 8.0) -> int:
    """Cells along a side of a periodic box: fine enough for the radius, coarse enough for two points in a cell."""
    return max(1, min(int(fraction * length / rmax), int((0.5 * n) ** (1 / 3))))
