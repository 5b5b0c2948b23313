"""Geometry as Columns: coordinates, rotations, minimum image, the angle around a pivot."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]
ARCMIN_PER_RADIAN = 3437.74677
#: The angle, in radians, by which a pivot is turned around each axis to get a reference direction.
REFERENCE_ANGLE = 0.01


def cols(prefix: str = "") -> Vector:
    return F.col(f"{prefix}x"), F.col(f"{prefix}y"), F.col(f"{prefix}z")


def add(a: Vector, b: Vector) -> Vector:
    return tuple(u + v for u, v in zip(a, b, strict=True))


def sub(a: Vector, b: Vector) -> Vector:
    return tuple(u - v for u, v in zip(a, b, strict=True))


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def matmul(m: Sequence[Sequence[float]], a: Vector) -> Vector:
    return tuple(sum((F.lit(float(r[k])) * a[k] for k in range(1, 3)), F.lit(float(r[0])) * a[0]) for r in m)


def euler(alpha: float, beta: float, gamma: float) -> list[list[float]]:
    """Matrix of the z-y-z rotation, angles in radians."""
    ca, sa, cb, sb, cg, sg = (f(t) for t in (alpha, beta, gamma) for f in (math.cos, math.sin))
    return [[cg * cb * ca - sg * sa, cg * cb * sa + sg * ca, -cg * sb], [-sg * cb * ca - cg * sa, cg * ca - sg * cb * sa, sg * sb], [sb * ca, sb * sa, cb]]


def euler_linear(alpha: float, beta: float, gamma: float) -> list[list[float]]:
    """The same to first order in the angles."""
    turn = alpha + gamma
    return [[1.0, turn, -beta], [-turn, 1.0, 0.0], [beta, 0.0, 1.0]]


def rotate(a: Vector, alpha: float, beta: float, gamma: float, linear: bool = False) -> Vector:
    return matmul((euler_linear if linear else euler)(alpha, beta, gamma), a)


def turn_towards(a: Vector, b: Vector, angle: float) -> Vector:
    """Unit vector a turned by an angle in the plane of a and b, towards b."""
    across = cross(cross(a, b), a)
    size = norm(across)
    return tuple(math.cos(angle) * u + math.sin(angle) * v / size for u, v in zip(a, across, strict=True))


def sphere(lon: Column, lat: Column, convention: str = "latitude") -> Vector:
    """Unit vector of longitude and latitude, or with convention "colatitude" of azimuth and polar angle; radians."""
    if convention == "latitude":
        return F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)
    if convention == "colatitude":
        return F.sin(lat) * F.cos(lon), F.sin(lat) * F.sin(lon), F.cos(lat)
    raise ValueError(f"no such convention: {convention}")


def angle(x: Column, y: Column) -> Column:
    """Direction of (x, y), 0 to 2 pi."""
    return F.pmod(F.atan2(y, x), F.lit(2 * math.pi))


def wrap(x: Column, length: float) -> Column:
    """x brought into [0, length)."""
    return F.pmod(x, F.lit(float(length)))


def nearest_image(d: Column, length: float) -> Column:
    """A coordinate difference to the nearest periodic image."""
    return d - F.lit(float(length)) * F.floor(d / F.lit(float(length)) + 0.5)


def spherical_wrap(theta: Column, phi: Column) -> tuple[Column, Column]:
    """Polar angle into [0, pi] and azimuth into [0, 2 pi): a step over a pole comes down on the other side."""
    t = F.pmod(theta, F.lit(2 * math.pi))
    over = t > math.pi
    return F.when(over, 2 * math.pi - t).otherwise(t), F.pmod(phi + F.when(over, math.pi).otherwise(0.0), F.lit(2 * math.pi))


def direction_on_sphere(p: Vector, d: Vector, r: Column) -> tuple[Column, Column]:
    """Cosine and sine of the angle between d = p - q and a reference direction at p, which is p minus p slightly turned."""
    axis = sub(p, rotate(p, REFERENCE_ANGLE, REFERENCE_ANGLE, REFERENCE_ANGLE))
    c = F.greatest(F.least(dot(d, axis) / (r * norm(axis)), F.lit(1.0)), F.lit(-1.0))
    side = dot(d, cross(axis, p))
    return c, F.when(side < 0, -F.sqrt(1.0 - c * c)).otherwise(F.sqrt(1.0 - c * c))


def direction_in_plane(d: Vector, r: Column) -> tuple[Column, Column]:
    """Cosine and sine of the direction from p to q in two dimensions; d = p - q."""
    return -d[0] / r, -d[1] / r
