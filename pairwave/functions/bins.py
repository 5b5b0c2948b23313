"""Distance bins: edges as numbers, bins as comparisons of squared distances with squared edges.

No logarithm is taken of data, so a distance falls into the same bin in every engine. The first bin is open below (r >
rmin), all others hold their lower edge; the last is open above.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bins:
    """n bins from rmin to rmax. kind: log, linear, or decade (log bins counted down from rmax, per_decade to each decade, rmin 0)."""

    rmin: float
    rmax: float
    n: int
    kind: str = "log"
    per_decade: float = 5.0

    def __post_init__(self):
        if self.n < 1 or not 0 <= self.rmin < self.rmax:
            raise ValueError("bins need n >= 1 and 0 <= rmin < rmax")
        if self.kind == "log" and self.rmin <= 0:
            raise ValueError("logarithmic bins need rmin > 0")
        if self.kind not in ("log", "linear", "decade"):
            raise ValueError(f"no such bins: {self.kind}")

    @property
    def width(self) -> float:
        if self.kind == "log":
            return math.log10(self.rmax / self.rmin) / self.n
        return (self.rmax - self.rmin) / self.n if self.kind == "linear" else 1 / self.per_decade

    def edge(self, k: float) -> float:
        """The edge after k bins; k may be a half."""
        if self.kind == "log":
            return 10 ** (math.log10(self.rmin) + k * self.width)
        if self.kind == "decade":
            return 10 ** (math.log10(self.rmax) + (k - self.n) * self.width)
        return self.rmin + k * self.width

    @property
    def edges(self) -> list[float]:
        inner = [self.edge(k) for k in range(1, self.n)]
        return [self.edge(0) if self.kind == "decade" else self.rmin, *inner, self.rmax]

    @property
    def centers(self) -> list[float]:
        return [self.edge(k + 0.5) for k in range(self.n)]

    def rows(self) -> list[tuple[int, float, float, float]]:
        """(bin from 1, lower edge, upper edge, center)."""
        e = self.edges
        return [(k + 1, e[k], e[k + 1], c) for k, c in enumerate(self.centers)]

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = ", ".join(f"({k}, " + ", ".join(f"double('{x!r}')" for x in xs) + ")" for k, *xs in self.rows())
        return spark.sql(f"SELECT * FROM VALUES {rows} AS t(bin, lo, hi, r)")

    def inside(self, r2: Column) -> Column:
        e = self.edges
        return (r2 > e[0] * e[0]) & (r2 < e[-1] * e[-1])

    def of(self, r2: Column) -> Column:
        """The bin of a squared distance that is inside.

        A logarithm or root only guesses it; the squared edges decide, so rounding can't move a distance to another bin. The
        generated code is short whatever the number of bins, which keeps the join's loop small enough to be compiled.
        """
        squares = [e * e for e in self.edges]
        if self.n == 1:
            return F.lit(1)
        if self.kind == "linear":
            place = (F.sqrt(r2) - self.rmin) / self.width
        else:
            place = (F.log(r2) - math.log(squares[0])) / (math.log(squares[-1] / squares[0]) / self.n)
        guess = F.greatest(F.least(F.floor(place).cast("int"), F.lit(self.n - 1)), F.lit(0))
        edges = F.array(*map(F.lit, squares))
        return guess + 1 + (r2 >= F.get(edges, guess + 1)).cast("int") - ((r2 < F.get(edges, guess)) & (guess > 0)).cast("int")

    def near(self, pairs: DataFrame) -> DataFrame:
        """pairs with a distance inside, and their bin."""
        return pairs.where(self.inside(F.col("r2"))).withColumn("bin", self.of(F.col("r2")))


def widths(bins: Bins) -> list[tuple[int, float, float]]:
    """(bin, width, difference of this width from the one before)."""
    w = [hi - lo for _, lo, hi, _ in bins.rows()]
    return [(k + 1, w[k], w[k] - w[k - 1] if k else 0.0) for k in range(len(w))]


def angle_bin(phi: Column, n: int) -> Column:
    """Bin 1 to n of an angle in [0, 2 pi)."""
    return F.least(F.floor(phi / F.lit(2 * math.pi / n)).cast("int") + 1, F.lit(n))
