"""Magnitude conversions and rupture sizes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (a, b) of Mw = a + b * log10(area in km2), by scaling law. Fixed values from the published relations.
RUPTURE_LAWS = {"L14": (4.18, 1.0), "WC94": (3.98, 1.02), "T17": (3.486, 0.942)}
#: The relations that bound a fault patch's largest magnitude. Fixed values.
PATCH_LAWS = {"L14": (4.18, 1.0), "WC94": (3.98, 1.02), "patch": (4.441, 0.846)}


def ml_to_mw(ml: Column) -> Column:
    low, middle = 0.594 * ml + 0.985, 1.327 + 0.253 * ml + 0.085 * ml * ml
    return F.when(ml <= 2, low).when(ml <= 4, middle).when(ml.isNotNull(), ml - 0.3)


def sane_mw(mw: Column) -> Column:
    """Mw, or null outside -3 .. 10: the event stays, its magnitude doesn't."""
    return F.when(mw.between(-3, 10), mw)


def rupture_area(mw: Column, law: str = "L14") -> Column:
    """Rupture area in km2."""
    a, b = RUPTURE_LAWS[law]
    return F.pow(F.lit(10.0), (mw - a) / b)


def rupture_radius(mw: Column, law: str = "L14") -> Column:
    """Radius in metres of the circle of the rupture's area."""
    return 1000 * F.sqrt(rupture_area(mw, law) / F.pi())


def displacement(mw: Column) -> Column:
    """Mean slip in metres."""
    return F.pow(F.lit(10.0), (mw - 3.71) / 2)


def patch_magnitude(area_km2: Column, law: str = "L14") -> Column:
    """Largest magnitude of a fault patch of that area; null for none."""
    a, b = PATCH_LAWS[law]
    return F.when(area_km2 > 0, a + b * F.log10(area_km2))
