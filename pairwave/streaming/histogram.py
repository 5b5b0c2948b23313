"""Pair counts that grow with a stream of points.

Counts are sums, so a micro-batch adds the pairs within itself and those with all points seen before. Points and counts are
kept as Parquet, each batch in a folder of its number: a batch that is run again replaces what it wrote before. Points are stored by
blocks of space, and a batch reads only the blocks that the balls around its points reach.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.bins import Bins
from ..operators.counts import on_bins
from ..operators.pairs import grid_pairs


#: Radii that a block of the store is wide.
BLOCK_RADII = 4


class PairStream:
    """Directed pair counts and field sums of a stream with columns id, x, y, z, kappa. folder: shared by all executors."""

    def __init__(self, folder: str, bins: Bins, box: float | None = None):
        self.folder, self.bins, self.box = folder, bins, box

    def _sums(self, pairs: DataFrame, factor: int) -> DataFrame:
        return self.bins.near(pairs).groupBy("bin").agg((F.count("*") * factor).alias("n"), (F.sum(F.col("pkappa") * F.col("qkappa")) * factor).alias("s"))

    def _blocks(self) -> tuple[float, int | None]:
        """Side of a block, several radii wide, and in a periodic box their number along a side."""
        side = BLOCK_RADII * self.bins.rmax
        if not self.box:
            return side, None
        n = max(1, math.floor(self.box / side))
        return self.box / n, n

    def _name(self, *cells: Column) -> Column:
        return F.concat_ws("_", *[c.cast("string") for c in cells])

    def _block(self, df: DataFrame) -> DataFrame:
        """df with the name of each point's block."""
        side, n = self._blocks()
        cells = [F.floor(F.col(c) / side) for c in "xyz"]
        return df.withColumn("block", self._name(*[F.pmod(c, F.lit(n)) if n else c for c in cells]))

    def _reached(self, df: DataFrame) -> DataFrame:
        """The names of all blocks that the balls around points reach."""
        side, n = self._blocks()
        slack = self.bins.rmax * 1.000001
        for c in "xyz":
            df = df.withColumn(f"_{c}", F.explode(F.sequence(F.floor((F.col(c) - slack) / side), F.floor((F.col(c) + slack) / side))))
        return df.select(self._name(*[F.pmod(f"_{c}", F.lit(n)) if n else F.col(f"_{c}") for c in "xyz"]).alias("block")).distinct()

    def batch(self, df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        new = f"{self.folder}/points/batch={number}"
        self._block(df.select("id", "x", "y", "z", "kappa")).repartition("block").write.mode("overwrite").partitionBy("block").parquet(new)
        schema = "id long, x double, y double, z double, kappa double"
        points = spark.read.schema(schema).parquet(new)
        parts = self._sums(grid_pairs(points, points, self.bins.rmax, box=self.box), 1)
        if number:
            # A join on the partition column: blocks that the batch doesn't reach aren't read.
            before = spark.read.schema(f"{schema}, batch long, block string").parquet(f"{self.folder}/points").where(F.col("batch") < number)
            near = before.join(self._reached(points), "block", "left_semi")
            parts = parts.union(self._sums(grid_pairs(points, near, self.bins.rmax, box=self.box, same=False), 2))
        parts.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/sums/batch={number}")

    def start(self, stream: DataFrame, checkpoint: str) -> DataStreamWriter:
        """A writer for the stream; call start() on it."""
        return stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint)

    def result(self, spark) -> DataFrame:
        """bin, r, n, xi so far."""
        sums = spark.read.parquet(f"{self.folder}/sums").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("s").alias("_s"))
        return on_bins(sums.withColumn("xi", F.col("_s") / F.greatest("n", F.lit(1))), self.bins, "n", "xi")
