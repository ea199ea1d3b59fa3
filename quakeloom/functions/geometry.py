"""Orientations of lines and planes as column expressions. Angles are in degrees, x is east, y north, z up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def line_vector(trend: Column, plunge: Column) -> Vector:
    """Unit vector of a line; a positive plunge points down."""
    t, p = F.radians(trend), F.radians(plunge)
    return F.cos(p) * F.sin(t), F.cos(p) * F.cos(t), -F.sin(p)


def plane_normal(azimuth: Column, dip: Column) -> Vector:
    """Downward unit normal of the plane that dips towards azimuth."""
    a, d = F.radians(azimuth), F.radians(dip)
    return -F.sin(d) * F.sin(a), -F.sin(d) * F.cos(a), -F.cos(d)


def normal_azimuth_dip(n: Vector) -> tuple[Column, Column]:
    """Whole-degree dip direction and dip of the plane with downward normal n; halves round to even."""
    azimuth = F.pmod(F.bround(F.degrees(F.atan2(n[0], n[1]) - F.pi()), 0), F.lit(360.0))
    dip = F.bround(F.degrees(F.pi() - F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), n[2])))), 0)
    return azimuth, dip


def rake_line(strike: Column, dip: Column, rake: Column) -> tuple[Column, Column]:
    """Whole-degree trend and plunge of the line at `rake` (0 to 180) in the plane."""
    r, d = F.radians(rake), F.radians(dip)
    b = F.abs(F.atan(F.tan(r) * F.cos(d)))
    beta = F.when(r > F.pi() / 2, F.pi() - b).otherwise(b)
    trend = F.pmod(F.bround(F.degrees(F.radians(strike) + beta), 0), F.lit(360.0))
    return trend, F.bround(F.degrees(F.asin(F.sin(d) * F.sin(r))), 0)


def angle_between(a: Vector, b: Vector) -> Column:
    c = dot(a, b) / (norm(a) * norm(b))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))))


def mean_azimuth(azimuth: Column) -> Column:
    """Aggregate: circular mean of azimuths."""
    return F.pmod(F.degrees(F.atan2(F.avg(F.sin(F.radians(azimuth))), F.avg(F.cos(F.radians(azimuth))))), F.lit(360.0))


def upward_normal_strike_dip(n: Vector) -> tuple[Column, Column]:
    """Strike and dip of the plane with normal n, turned upward first."""
    s = F.when(n[2] < 0, -1.0).otherwise(1.0)
    x, y, z = n[0] * s, n[1] * s, n[2] * s
    return F.pmod(F.degrees(F.atan2(x, y)) - 90, F.lit(360.0)), F.degrees(F.acos(F.least(F.lit(1.0), z)))


def slip_vector(p: Vector, radius: Column, n: Vector, rake: Column) -> Vector:
    """End of the slip vector: p moved by radius along the rake in the plane with normal n."""
    azimuth, _ = normal_azimuth_dip(n)
    h = plane_normal(F.pmod(azimuth + 90, F.lit(360.0)), F.lit(90.0))
    size = F.sqrt(h[0] * h[0] + h[1] * h[1])
    along = h[0] / size, h[1] / size, F.lit(0.0)
    down = cross(n, along)
    c, s = F.cos(F.radians(-rake)), F.sin(F.radians(-rake))
    return tuple(p[i] + radius * (c * along[i] + s * down[i]) for i in range(3))


def plane_corners(p: Vector, strike: Column, dip: Column, size: Column) -> Column:
    """Array of the four corners (struct x, y, z) of a square of half-width size in the plane, around p."""
    s, d = F.radians(strike), F.radians(dip)
    along = F.cos(s), F.sin(s), F.lit(0.0)
    down = -F.sin(s) * F.cos(d), F.cos(s) * F.cos(d), -F.sin(d)
    corners = [F.struct(*((p[i] + a * size * along[i] + b * size * down[i]).alias("xyz"[i]) for i in range(3))) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
    return F.array(*corners)


def disc_axes(n: Vector) -> tuple[Vector, Vector]:
    """Two unit vectors that span the plane with unit normal n: n x z (n x x for planes flatter than about 26 degrees), and n x that."""
    flat = F.abs(n[2]) >= 0.9
    u = F.when(flat, 0.0).otherwise(n[1]), F.when(flat, n[2]).otherwise(-n[0]), F.when(flat, -n[1]).otherwise(0.0)
    size = norm(u)
    u = tuple(x / size for x in u)
    return u, cross(n, u)
