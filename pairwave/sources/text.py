"""Text catalogs: columns of numbers with comment lines, read and written in parallel."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import catalog, from_sky, number


def _values(spark: SparkSession, path: str) -> DataFrame:
    """v: the values of all lines but comments (# or %) and empty ones."""
    return spark.read.text(path).where(~F.trim("value").rlike(r"^([#%]|$)")).select(F.split(F.trim("value"), r"[\s,]+").alias("v"))


def table(spark: SparkSession, path: str, columns: list[int] | None = None, strict: bool = True) -> DataFrame:
    """c1, c2, ... (double): chosen 1-based columns, or all that the first line has.

    strict: a line with another number of values than the first, or with less than it takes, or a value that isn't a number, is an error when it is read.
    """
    parts = _values(spark, path)
    first = parts.first()
    width = len(first["v"]) if first else 0
    wanted = columns or list(range(1, width + 1))
    if not strict:
        return parts.select(*[F.get("v", F.lit(c - 1)).try_cast("double").alias(f"c{c}") for c in wanted])
    few = max(wanted, default=0)
    said = F.concat(F.lit(f"a line has less than {few} values, or not the {width} of the first: "), F.array_join("v", " "))
    checked = F.when((F.size("v") < few) | (F.size("v") != width), F.raise_error(said)).otherwise(F.col("v"))
    return parts.select(checked.alias("v")).select(*[F.get("v", F.lit(c - 1)).cast("double").alias(f"c{c}") for c in wanted])


def require_even(spark: SparkSession, path: str) -> int:
    """The number of values that every line has; an error if lines differ."""
    parts = _values(spark, path).select(F.size("v").alias("n"))
    least, most = parts.agg(F.min("n"), F.max("n")).first()
    if least != most:
        raise ValueError(f"{path}: lines have {least} to {most} values")
    return most or 0


def header(spark: SparkSession, path: str) -> dict:
    """nbody, ndim and sides of the box, from the second comment line."""
    comments = [r[0].lstrip("#% ") for r in spark.read.text(path).where(F.trim("value").startswith("#")).limit(2).collect()]
    for line in reversed(comments):
        parts = line.split()
        try:
            return {"nbody": int(parts[0]), "ndim": int(parts[1]), "box": [float(x) for x in parts[2:]]}
        except (ValueError, IndexError):
            continue
    raise ValueError(f"{path}: no header with nbody, dimensions and sides")


def head_of(spark: SparkSession, path: str) -> tuple:
    """rows, columns (their number as names), nside, box, other of a text file, from its first lines."""
    lines = [r[0].strip() for r in spark.read.text(path).head(64)]
    said, first = {}, next((x for x in lines if x and x[0] not in "#%"), None)
    for line in lines:
        parts = line.lstrip("#% ").split()
        if line.startswith("#") and len(parts) >= 2 and parts[0].isdigit() and parts[1].isdigit():
            said = {"nbody": int(parts[0]), "box": [float(x) for x in parts[2:]]}
            break
    columns = ",".join(f"c{k + 1}" for k in range(len(re.split(r"[\s,]+", first)))) if first else ""
    return said.get("nbody"), columns, None, said.get("box") or None, None


def choose(columns: str | list[int] | None, default: list[int]) -> list[int]:
    """1-based columns from a list or a comma list, the default if none are given; anything else than positive numbers is an error."""
    if columns is None or columns == "":
        return default
    try:
        got = [int(c) for c in (columns.split(",") if isinstance(columns, str) else columns)]
    except ValueError as e:
        raise ValueError(f"columns are numbers, not {columns}") from e
    if min(got, default=0) < 1:
        raise ValueError(f"columns count from 1: {columns}")
    return got


def columns_ascii(spark: SparkSession, path: str, columns=None, **_) -> DataFrame:
    """x y z kappa."""
    c = choose(columns, [1, 2, 3, 4])[:4]
    return catalog(number(_named(table(spark, path, c), c, ("x", "y", "z", "kappa"))))


def columns_ascii_all(spark: SparkSession, path: str, **_) -> DataFrame:
    """x y z kappa weight mass mask."""
    df = _named(table(spark, path, list(range(1, 8))), list(range(1, 8)), ("x", "y", "z", "kappa", "weight", "mass", "m"))
    return catalog(number(df.withColumn("mask", F.col("m") > 0)))


def columns_ascii_pos(spark: SparkSession, path: str, columns=None, **_) -> DataFrame:
    """x y z only; the field is 2."""
    c = choose(columns, [1, 2, 3])[:3]
    return catalog(number(_named(table(spark, path, c), c, ("x", "y", "z"))), kappa=2.0)


def columns_ascii_2d_to_3d(spark: SparkSession, path: str, columns=None, convention: str = "latitude", **_) -> DataFrame:
    """theta phi kappa, on the unit sphere: (latitude, longitude), or (polar angle, azimuth) with convention colatitude."""
    c = choose(columns, [1, 2, 3])[:3]
    return catalog(number(from_sky(_named(table(spark, path, c), c, ("theta", "phi", "kappa")), "phi", "theta", convention=convention)))


def multi_columns_ascii(spark: SparkSession, path: str, columns=None, kind: str = "pos-and-convergence", **_) -> DataFrame:
    """Chosen columns as only-pos (x y z), pos-and-convergence (x y z kappa weight) or pos-and-shear (x y z gamma1 gamma2 weight)."""
    names = {"only-pos": ("x", "y", "z"), "pos-and-convergence": ("x", "y", "z", "kappa", "weight"), "pos-and-shear": ("x", "y", "z", "gamma1", "gamma2", "weight")}
    if kind not in names:
        raise ValueError(f"choose one of {', '.join(names)}")
    c = choose(columns, list(range(1, 5)) if kind == "pos-and-convergence" else list(range(1, len(names[kind]) + 1)))[: len(names[kind])]
    return catalog(number(_named(table(spark, path, c), c, names[kind])), kappa=2.0 if kind == "only-pos" else 1.0)


def ra_dec_ascii(spark: SparkSession, path: str, columns=None, degrees: bool = False, **_) -> DataFrame:
    """ra dec kappa, on the unit sphere."""
    c = choose(columns, [1, 2, 3])[:3]
    return catalog(number(from_sky(_named(table(spark, path, c), c, ("ra", "dec", "kappa")), "ra", "dec", degrees)))


def _named(df: DataFrame, columns: list[int], names: tuple[str, ...]) -> DataFrame:
    return df.select(*[F.col(f"c{c}").alias(n) for c, n in zip(columns, names)])


def matrix(spark: SparkSession, path: str) -> DataFrame:
    """i, j, value: a matrix in text; rows are numbered in the order of the file."""
    lines = spark.read.text(path).where(~F.trim("value").rlike(r"^([#%]|$)")).select(F.monotonically_increasing_id().alias("_at"), F.split(F.trim("value"), r"\s+").alias("v"))
    from pyspark.sql.window import Window

    numbered = lines.withColumn("i", F.row_number().over(Window.orderBy("_at")) - 1)  # histogram files: a line for each bin
    return numbered.select("i", F.posexplode("v").alias("j", "value")).select("i", "j", F.col("value").cast("double").alias("value"))


def vector(spark: SparkSession, path: str, column: int = 1) -> DataFrame:
    """i, value: one column of a text file, in order."""
    return matrix(spark, path).where(F.col("j") == column - 1).select("i", "value")


def number_text(c: Column) -> Column:
    """A number with 16 digits after the point, as readers of such files take it."""
    return F.format_string("%.16e", c.cast("double"))


def write_columns(df: DataFrame, path: str, columns: list[str], head: list[str] | None = None, single: bool = False) -> None:
    """Numbers separated by blanks, a part file for each partition; head: comment lines of a file of their own, which readers skip."""
    lines = df.select(F.concat_ws(" ", *[number_text(F.col(c)) for c in columns]).alias("value"))
    (lines.coalesce(1) if single else lines).write.mode("overwrite").text(path)
    if head:
        df.sparkSession.createDataFrame([(f"# {h}",) for h in head], "value string").coalesce(1).write.mode("append").text(path)
