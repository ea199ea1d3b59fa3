"""Focal-mechanism geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import Vector, angle_between, plane_normal

#: Names and order of the ways in which an active plane was found. Fixed values.
METHODS = (
    "Pre-specified (A=1 or A=2)",
    "Newly determined (A=0, geometric selection)",
    "Newly determined (no A, geometric selection)",
    "Newly determined (invalid A, geometric selection)",
    "Not determined (A specified but no rupture plane)",
    "Not determined (no computed rupture plane)",
    "Not determined (other reason)",
)


def auxiliary_plane(strike: Column, dip: Column, rake: Column) -> tuple[Column, Column, Column]:
    """Strike, dip and rake of the second nodal plane of a double couple, cut to whole degrees; null for values out of range.

    The second plane's normal is the first one's slip vector and the other way round (north, east, down axes).
    """
    valid = strike.between(0, 360) & dip.between(0, 90) & rake.between(-180, 180)
    s, d, r = F.radians(strike), F.radians(dip), F.radians(rake)
    n = -F.sin(d) * F.sin(s), F.sin(d) * F.cos(s), -F.cos(d)
    u = F.cos(r) * F.cos(s) + F.cos(d) * F.sin(r) * F.sin(s), F.cos(r) * F.sin(s) - F.cos(d) * F.sin(r) * F.cos(s), -F.sin(r) * F.sin(d)
    # an upward normal is one with negative down component
    flip = F.when(u[2] > 0, -1.0).otherwise(1.0)
    m, v = tuple(x * flip for x in u), tuple(x * flip for x in n)
    unit = lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))
    dip2 = F.acos(unit(-m[2]))
    strike2 = F.atan2(-m[0], m[1])
    level = F.sqrt(m[0] * m[0] + m[1] * m[1]) < 1e-9
    strike2 = F.when(level, F.lit(0.0)).otherwise(strike2)
    along = v[0] * F.cos(strike2) + v[1] * F.sin(strike2)
    down = v[0] * F.cos(dip2) * F.sin(strike2) - v[1] * F.cos(dip2) * F.cos(strike2) - v[2] * F.sin(dip2)
    whole = lambda x: F.when(valid, F.when(x < 0, F.ceil(x - 1e-6)).otherwise(F.floor(x + 1e-6)).cast("double"))
    return whole(F.pmod(F.degrees(strike2), F.lit(360.0))), whole(F.degrees(dip2)), whole(F.degrees(F.atan2(down, along)))


def misfit(n: Vector, plane1: tuple[Column, Column], plane2: tuple[Column, Column], active: Column) -> tuple[Column, Column]:
    """epsilon and pref_foc: the angle between a fitted plane's normal and the preferred nodal plane (strike, dip), and which it is.

    An active plane of 1 or 2 decides; else the smaller angle does, the first plane on ties.
    """
    fold = lambda a: F.when(a < 90, a).otherwise(180 - a)
    e1, e2 = (fold(angle_between(n, plane_normal(F.pmod(s + 90, F.lit(360.0)), d))) for s, d in (plane1, plane2))
    known = n[0].isNotNull() & plane1[0].isNotNull() & plane1[1].isNotNull() & plane2[0].isNotNull() & plane2[1].isNotNull()
    pref = F.when(known, F.when(active.isin(1, 2), active.cast("int")).when(e1 <= e2, 1).otherwise(2))
    return F.when(pref == 1, e1).when(pref == 2, e2), pref


def determination_method(pref: Column, active: Column, azimuth: Column) -> Column:
    given = active.isin(1, 2)
    found = F.when(given, METHODS[0]).when(active == 0, METHODS[1]).when(active.isNull(), METHODS[2]).otherwise(METHODS[3])
    return F.when(pref.isNotNull(), found).when(given, METHODS[4]).when(azimuth.isNull(), METHODS[5]).otherwise(METHODS[6])


def method_rank(method: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, METHODS)), method) - 1


def preferred(pref: Column, one: Column, two: Column) -> Column:
    return F.when(pref == 1, one).when(pref == 2, two)


def consistent(magnitude: Column, focal_magnitude: Column, most: float = 0.2) -> Column:
    """False where catalog and focal magnitude differ by more than `most` (to nine decimals)."""
    return ~F.coalesce(F.round(F.abs(magnitude - focal_magnitude), 9) > most, F.lit(False))


def numeric_key(event_id: Column) -> Column:
    """Digits of an event id, without its KP prefix."""
    return F.regexp_replace(F.regexp_replace(event_id, "^KP", ""), "[^0-9]", "")
