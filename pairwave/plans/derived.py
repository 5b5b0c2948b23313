"""Catalogs derived from the sample tables, as DataFrames and as the same SQL.

SPH, SPH2, SPH3: a spiral lattice on the unit sphere from the keys of customer, supplier and part. BOX: an additive
recurrence in the unit cube from the keys of part. Numbers are written alike in both, so both engines compute the same
doubles up to the last bit of sines and cosines.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bins import Bins
from ..functions.geometry import REFERENCE_ANGLE, euler

TURN, GOLDEN = 6.283185307179586, 0.6180339887498949
STEPS = (0.8191725134, 0.6710436067, 0.5497004779)

SPHERE_SOURCES = {"sph": ("customer", "c_custkey", "c_acctbal", 10000.0), "sph2": ("supplier", "s_suppkey", "s_acctbal", 10000.0), "sph3": ("part", "p_partkey", "p_retailprice", 1000.0)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sphere(spark: SparkSession, sf_dir: str, name: str = "sph") -> DataFrame:
    source, key, value, scale = SPHERE_SOURCES[name]
    df = table(spark, sf_dir, source)
    n = float(df.count())
    df = df.select(F.col(key).alias("id"), (1.0 - 2.0 * (F.col(key) + 0.5) / n).alias("z"), (TURN * ((F.col(key) * GOLDEN) % 1.0)).alias("ph"), (F.col(value) / scale).alias("kappa"))
    return df.select("id", (F.sqrt(1.0 - F.col("z") * F.col("z")) * F.cos("ph")).alias("x"), (F.sqrt(1.0 - F.col("z") * F.col("z")) * F.sin("ph")).alias("y"), "z", "kappa")


def box(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("id"), *[((k * s) % 1.0).alias(c) for c, s in zip("xyz", STEPS, strict=True)], (F.col("p_retailprice") / 1000.0).alias("kappa"))


def lit(x: float) -> str:
    """A double in SQL."""
    text = repr(float(x))
    return text if "e" in text else f"{text}e0"


def sphere_sql(name: str = "sph") -> str:
    source, key, value, scale = SPHERE_SOURCES[name]
    return f"""{name} AS (SELECT id, sqrt(1e0-z*z)*cos(ph) AS x, sqrt(1e0-z*z)*sin(ph) AS y, z, kappa FROM
  (SELECT {key} AS id, 1e0-2e0*({key}+0.5e0)/(SELECT count(*) FROM {source}) AS z, {lit(TURN)}*(({key}*{lit(GOLDEN)}) % 1e0) AS ph, {value}/{lit(scale)} AS kappa FROM {source}))"""


def box_sql() -> str:
    xyz = ", ".join(f"(p_partkey*{lit(s)}) % 1e0 AS {c}" for c, s in zip("xyz", STEPS, strict=True))
    return f"box AS (SELECT p_partkey AS id, {xyz}, p_retailprice/1000e0 AS kappa FROM part)"


def bins_sql(bins: Bins) -> str:
    e = bins.edges
    rows = ", ".join(f"({k}, {lit(lo * lo)}, {lit(hi * hi)}, {lit(lo)}, {lit(hi)}, {lit(c)})" for (k, lo, hi, c) in [(i + 1, e[i], e[i + 1], c) for i, c in enumerate(bins.centers)])
    return f"bins(bin, lo2, hi2, lo, hi, r) AS (VALUES {rows})"


def pairs_sql(bins: Bins, p: str = "sph", q: str = "sph", length: float | None = None, plane: bool = False, name: str = "pr", same: bool | None = None) -> str:
    """Directed pairs with their bin, by comparing all with all. same: no point with itself, by default where both are one catalog."""
    d = {c: f"(p.{c}-q.{c})" for c in ("xy" if plane else "xyz")}
    if length:
        d = {c: f"({v} - {lit(length)}*round({v}/{lit(length)}))" for c, v in d.items()}
    if plane:
        d["z"] = "0e0"
    top = lit(bins.edges[-1] ** 2)
    keep = "pid <> qid AND " if (p == q if same is None else same) else ""
    z = {s: "0e0" if plane else f"{s}.z" for s in "pq"}
    return f"""{name}0 AS (SELECT p.id AS pid, q.id AS qid, p.x AS px, p.y AS py, {z['p']} AS pz, p.kappa AS pk, q.kappa AS qk, {d['x']} AS dx, {d['y']} AS dy, {d['z']} AS dz FROM {p} p, {q} q),
{name}1 AS (SELECT *, dx*dx+dy*dy+dz*dz AS r2 FROM {name}0),
{name} AS (SELECT a.*, b.bin FROM (SELECT * FROM {name}1 WHERE {keep}r2 > 0 AND r2 < {top}) a JOIN bins b ON a.r2 < b.hi2 AND (a.r2 > b.lo2 OR (b.bin > 1 AND a.r2 = b.lo2)))"""


def moments_sql(bins: Bins, most: int, p: str = "sph", plane: bool = False, weight: str = "pk", field: str = "qk", name: str = "mo", number: str = "") -> str:
    """Moments by pivot and bin from pr, by angles and their multiples. number: a column of pr with the points that a row stands for."""
    if plane:
        angle = f"ang AS (SELECT pr.*, -dx/sqrt(r2) AS cs, -dy/sqrt(r2) AS sn FROM pr)"
    else:
        m = euler(REFERENCE_ANGLE, REFERENCE_ANGLE, REFERENCE_ANGLE)
        axis = ", ".join(f"p{c}-({lit(r[0])}*px+{lit(r[1])}*py+{lit(r[2])}*pz) AS a{c}" for c, r in zip("xyz", m, strict=True))
        angle = f"""ax AS (SELECT pr.*, {axis} FROM pr),
ang0 AS (SELECT *, greatest(least((dx*ax+dy*ay+dz*az)/(sqrt(r2)*sqrt(ax*ax+ay*ay+az*az)),1e0),-1e0) AS cs, dx*(ay*pz-az*py)+dy*(az*px-ax*pz)+dz*(ax*py-ay*px) AS side FROM ax),
ang AS (SELECT *, CASE WHEN side < 0 THEN -sqrt(1e0-cs*cs) ELSE sqrt(1e0-cs*cs) END AS sn FROM ang0)"""
    sums = ", ".join(f"sum({field}*{f}({m}*phi)) AS {k}{m}" for k, f in (("c", "cos"), ("s", "sin")) for m in range(most + 1))
    return f"""{angle},
ph AS (SELECT pid, bin, {weight} AS w, pk, qk, atan2(sn, cs) AS phi{", " + number if number else ""} FROM ang),
{name} AS (SELECT pid, bin, w, {f"sum({number})" if number else "count(*)"} AS n, sum({field}*{field}) AS k2, {sums} FROM ph GROUP BY pid, bin, w)"""


def zeta_sql(most: int, points: str, norm: str = "pivot", source: str = "mo", name: str = "zeta") -> str:
    """m, b1, b2, cc, ss, sc, cs for pairs of bins that some pivot fills."""
    den = "(greatest(a.n,1)*greatest(b.n,1))::DOUBLE" if norm == "pivot" else "1e0"
    over = f"/(SELECT count(*) FROM {points})" if norm == "pivot" else ""
    parts = {"cc": "c{m}*b.c{m}", "ss": "s{m}*b.s{m}", "sc": "s{m}*b.c{m}", "cs": "c{m}*b.s{m}"}
    one = " UNION ALL ".join(f"SELECT {m} AS m, a.bin AS b1, b.bin AS b2, " + ", ".join(f"sum(a.w*a.{e.format(m=m)}/{den}){over} AS {k}" for k, e in parts.items()) + f" FROM {source} a JOIN {source} b ON a.pid = b.pid GROUP BY a.bin, b.bin" for m in range(most + 1))
    return f"{name} AS ({one})"


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """df with columns rounded, no negative zero."""
    return df.withColumns({c: tidy(F.col(c), digits) for c in columns})


def tidy(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits) + 0.0


def tidy_sql(expression: str, alias: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0e0 AS {alias}"


PI = math.pi
