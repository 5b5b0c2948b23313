"""Results as text files: curves, matrices by multipole, slices, and counts with errors.

Results are small, a line for each bin, so each is one file, written by the driver through Hadoop's file system.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.threepoint import PARTS
from .text import number_text

#: Names of the four components in file names.
NAMES = dict(zip(PARTS, ("cos", "sin", "sincos", "cossin"), strict=True))


def write_file(spark: SparkSession, path: str, content: bytes) -> None:
    """One file of any file system that Spark knows; an older one is replaced."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def _write(df: DataFrame, path: str) -> None:
    """Lines of a column value, as many as there are bins."""
    write_file(df.sparkSession, path, "".join(r[0] + "\n" for r in df.collect()).encode())


def _lines(df: DataFrame, order: list[str], columns: list[str], path: str) -> None:
    _write(df.orderBy(*order).select(F.concat_ws(" ", *[number_text(F.col(c)) for c in columns]).alias("value")), path)


def write_curve(df: DataFrame, path: str, value: str) -> None:
    """r and a value, a line for each bin."""
    _lines(df, ["bin"], ["r", value], path)


def write_bins(df: DataFrame, path: str) -> None:
    _lines(df, ["bin"], ["r"], path)


def write_counts(df: DataFrame, path: str) -> None:
    """r, correlation, error, pairs."""
    _lines(df, ["bin"], ["r", "cf", "err", "n"], path)


def matrix_lines(zeta: DataFrame, m: int, part: str) -> DataFrame:
    """b1, value: one line of a matrix for each first bin, in the order of the second."""
    cells = zeta.where(F.col("m") == m).groupBy("b1").agg(F.array_sort(F.collect_list(F.struct("b2", F.col(part).alias("v")))).alias("c"))  # as many as there are bins
    return cells.select("b1", F.array_join(F.transform("c", lambda x: F.format_string("%.16e", x["v"])), " ").alias("value"))


def write_matrices(zeta: DataFrame, folder: str, most: int, prefix: str = "histZetaM", suffix: str = "") -> list[str]:
    """A file for each component and multipole, numbered from 1: full matrices, so zeta must have every pair of bins."""
    out = []
    for part, name in NAMES.items():
        for m in range(most + 1):
            out.append(f"{folder}/{prefix}_{name}_{m + 1}{suffix}")
            _write(matrix_lines(zeta, m, part).orderBy("b1").select("value"), out[-1])
    return out


def write_slices(slices: DataFrame, folder: str, most: int, part: str, suffix: str = "") -> list[str]:
    """A file for each multipole: r, diagonal, four slices."""
    out = []
    for m in range(most + 1):
        out.append(f"{folder}/mhistZetaM_{NAMES[part]}_{m + 1}{suffix}")
        _lines(slices.where(F.col("m") == m), ["b1"], ["r", "diag", "q1", "q2", "q3", "q4"], out[-1])
    return out


def write_angles(zeta: DataFrame, folder: str, angles: int, prefix: str = "histZetaG", part: str = "re", suffix: str = "") -> list[str]:
    """A file for each angle, numbered from 1: a full matrix of bins."""
    out = []
    for k in range(angles):
        out.append(f"{folder}/{prefix}_{k + 1}{suffix}")
        _write(matrix_lines(zeta.where(F.col("l") == k).withColumn("m", F.lit(0)), 0, part).orderBy("b1").select("value"), out[-1])
    return out
