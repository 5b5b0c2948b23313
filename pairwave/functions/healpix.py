"""HEALPix pixels: ring scheme as Columns, nested scheme and conversions in Arrow batches.

From the published definition of the tessellation: 12 base pixels, nside a power of two for the nested scheme, pixels of
equal area on rings of equal latitude.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nside2npix(nside: int) -> int:
    return 12 * nside * nside


def npix2nside(npix: int) -> int:
    """nside, or -1 if no map has so many pixels."""
    nside = math.isqrt(npix // 12)
    return nside if nside2npix(nside) == npix else -1


def pix2ang_ring(nside: int, pix: Column) -> tuple[Column, Column]:
    """Polar angle and azimuth of pixel centers, ring scheme."""
    npix, cap = nside2npix(nside), 2 * nside * (nside - 1)
    n = float(nside)
    # From either pole, ring i has 4 i pixels, so 2 i (i - 1) pixels come before it.
    north = pix < cap
    south = pix >= npix - cap
    from_pole = F.when(south, npix - 1 - pix).otherwise(pix)
    i = F.floor((1.0 + F.sqrt(1.0 + 2.0 * from_pole)) / 2.0)
    k = from_pole - 2 * i * (i - 1)
    polar_phi = (k + 0.5) * (math.pi / 2) / i
    j = pix - cap
    ring = F.floor(j / (4 * nside)) + nside
    across = F.pmod(j, F.lit(4 * nside))
    shift = F.when(F.pmod(ring - nside, F.lit(2)) == 0, 0.5).otherwise(0.0)
    z = F.when(north, 1.0 - i * i / (3.0 * n * n)).when(south, -1.0 + i * i / (3.0 * n * n)).otherwise((2.0 * n - ring) * 2.0 / (3.0 * n))
    phi = F.when(north, polar_phi).when(south, 2 * math.pi - polar_phi).otherwise((across + shift) * (math.pi / 2) / n)
    return F.acos(z), phi


def ang2pix_ring(nside: int, theta: Column, phi: Column) -> Column:
    """The pixel, ring scheme, that holds a direction."""
    n, z = float(nside), F.cos(theta)
    turn = F.pmod(phi / (math.pi / 2), F.lit(4.0))
    # Equatorial belt: counted along both diagonals.
    rise, fall = F.floor(n * (0.5 + turn - 0.75 * z)), F.floor(n * (0.5 + turn + 0.75 * z))
    ring = nside + 1 + rise - fall
    shift = 1 - F.pmod(ring, F.lit(2))  # rings, counted from 1 in the belt, whose pixels begin at azimuth 0
    along = F.pmod(F.floor((rise + fall - nside + shift + 1) / 2), F.lit(4 * nside))
    belt = 2 * nside * (nside - 1) + (ring - 1) * 4 * nside + along
    # Caps: counted from the pole.
    part = turn - F.floor(turn)
    size = n * F.sqrt(3.0 * (1.0 - F.abs(z)))
    up, down = F.floor(part * size), F.floor((1.0 - part) * size)
    i = up + down + 1
    at = F.pmod(F.floor(turn * i), 4 * i)
    cap = F.when(z > 0, 2 * i * (i - 1) + at).otherwise(nside2npix(nside) - 2 * i * (i + 1) + at)
    return F.when(F.abs(z) <= 2.0 / 3.0, belt).otherwise(cap).cast("long")


def _spread(v: np.ndarray) -> np.ndarray:
    """The bits of v at even places."""
    v = v.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = (v | v << np.uint64(shift)) & np.uint64(mask)
    return v


def _gather(v: np.ndarray) -> np.ndarray:
    """The bits at even places of v."""
    v = v.astype(np.uint64) & np.uint64(0x5555555555555555)
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        v = (v | v >> np.uint64(shift)) & np.uint64(mask)
    return v


def _check_nested(nside: int) -> None:
    if nside < 1 or nside & (nside - 1):
        raise ValueError("the nested scheme needs nside to be a power of two")


def nest_to_ring(nside: int, pix: np.ndarray) -> np.ndarray:
    """Ring numbers of nested pixels, from their base pixel and place in it."""
    _check_nested(nside)
    pix = np.asarray(pix, np.int64)
    face, inner = pix // (nside * nside), pix % (nside * nside)
    x, y = _gather(inner).astype(np.int64), _gather(inner >> 1).astype(np.int64)
    row, column = face // 4, face % 4
    ring = (row + 2) * nside - x - y - 1  # from 1 at the north pole
    size = np.minimum(np.minimum(ring, 4 * nside - ring), nside)
    before = np.where(ring < nside, 2 * ring * (ring - 1), np.where(ring > 3 * nside, 12 * nside * nside - 2 * size * (size + 1), 2 * nside * (nside - 1) + (ring - nside) * 4 * nside))
    # Twice the azimuth of the base pixel's center, in quarter turns.
    centre = np.where(row == 1, 2 * column, 2 * column + 1)
    shift = np.where((ring < nside) | (ring > 3 * nside), 0, (ring - nside) % 2)
    along = (centre * size + x - y + 1 + shift) // 2 - 1
    return before + along % (4 * size)


def ring_to_nest(nside: int, pix: np.ndarray) -> np.ndarray:
    """Nested numbers of ring pixels: the base pixel and place whose ring number that is."""
    _check_nested(nside)
    pix = np.asarray(pix, np.int64)
    npix, cap = 12 * nside * nside, 2 * nside * (nside - 1)
    from_pole = np.where(pix < cap, pix, npix - 1 - pix)
    i = ((1 + np.sqrt(1 + 2.0 * from_pole)) // 2).astype(np.int64)
    i = np.where(2 * i * (i - 1) > from_pole, i - 1, np.where(2 * i * (i + 1) <= from_pole, i + 1, i))
    belt = (pix >= cap) & (pix < npix - cap)
    ring = np.where(belt, (pix - cap) // (4 * nside) + nside, np.where(pix < cap, i, 4 * nside - i))
    size = np.where(belt, nside, i)
    along = np.where(belt, (pix - cap) % (4 * nside), np.where(pix < cap, from_pole - 2 * i * (i - 1), 4 * i - 1 - (from_pole - 2 * i * (i - 1))))
    # In the belt, pixel centers lie on two families of diagonals, counted by azimuth and ring; each base pixel spans nside of both.
    rise, fall = along + (ring - nside) // 2, along + (3 * nside - ring) // 2
    up, down = rise // nside, fall // nside
    face = np.where(up == down, up % 4 + 4, np.where(up < down, up % 4, down % 4 + 8))
    x, y = fall % nside, nside - 1 - rise % nside
    # In a cap, a ring has size pixels of each of four base pixels, on one line x + y = const, x - y rising with azimuth.
    quarter, place = along // size, along % size
    north = pix < cap
    face = np.where(belt, face, np.where(north, quarter, quarter + 8))
    x = np.where(belt, x, np.where(north, nside - size + place, place))
    y = np.where(belt, y, np.where(north, nside - 1 - place, size - 1 - place))
    return face * nside * nside + (_spread(x) | _spread(y) << np.uint64(1)).astype(np.int64)


def _numbers(convert):
    def build(nside: int, pix: Column) -> Column:
        @F.pandas_udf("long")
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in parts:
                yield pd.Series(convert(nside, part.to_numpy()), dtype="int64")

        return run(pix.cast("long"))

    return build


nest2ring = _numbers(nest_to_ring)
ring2nest = _numbers(ring_to_nest)


def pix2ang_nest(nside: int, pix: Column) -> tuple[Column, Column]:
    return pix2ang_ring(nside, nest2ring(nside, pix))


def ang2pix_nest(nside: int, theta: Column, phi: Column) -> Column:
    return ring2nest(nside, ang2pix_ring(nside, theta, phi))


def ang2vec(theta: Column, phi: Column) -> tuple[Column, Column, Column]:
    return F.sin(theta) * F.cos(phi), F.sin(theta) * F.sin(phi), F.cos(theta)


def vec2ang(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    return F.acos(z / F.sqrt(x * x + y * y + z * z)), F.pmod(F.atan2(y, x), F.lit(2 * math.pi))


def pix2vec(nside: int, pix: Column, nest: bool = False) -> tuple[Column, Column, Column]:
    return ang2vec(*(pix2ang_nest if nest else pix2ang_ring)(nside, pix))


def vec2pix(nside: int, x: Column, y: Column, z: Column, nest: bool = False) -> Column:
    return (ang2pix_nest if nest else ang2pix_ring)(nside, *vec2ang(x, y, z))


def degrade(df: DataFrame, pix: str, value: str, levels: int, pessimistic: bool = False) -> DataFrame:
    """pix, value: means over the 4^levels nested children of each coarser pixel.

    Null and NaN children don't count; a pessimistic mean needs all of them to be there.
    """
    known = F.when(~F.isnan(value), F.col(value))
    out = df.select(F.shiftright(F.col(pix).cast("long"), 2 * levels).alias("pix"), known.alias("_v")).groupBy("pix").agg(F.avg("_v").alias("value"), F.count("_v").alias("_n"))
    if pessimistic:
        out = out.withColumn("value", F.when(F.col("_n") == 4**levels, F.col("value")))
    return out.select("pix", "value")


def upgrade(df: DataFrame, pix: str, value: str, levels: int) -> DataFrame:
    """pix, value: each nested pixel's value for all its 4^levels children."""
    first = F.shiftleft(F.col(pix).cast("long"), 2 * levels)
    return df.select(F.explode(F.sequence(first, first + (4**levels - 1))).alias("pix"), F.col(value).alias("value"))
