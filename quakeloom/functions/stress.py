"""Resolved stress on planes as column expressions.

A field is the trend and plunge of the largest and the smallest principal stress and the shape ratio R, each a number or a
column (for fields that vary by domain). Tensors are in north, east, down axes.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import cross, dot, norm

#: The field of the published example data: trend and plunge of sigma 1 and sigma 3, and R. Fixed values.
EXAMPLE_FIELD = {"s1_trend": 301.0, "s1_plunge": 23.0, "s3_trend": 43.0, "s3_plunge": 26.0, "R": 0.35}


def _axis(trend: Column, plunge: Column) -> tuple[Column, Column, Column]:
    t, p = F.radians(trend), F.radians(plunge)
    return F.cos(p) * F.cos(t), F.cos(p) * F.sin(t), F.sin(p)


def _tractions(strike: Column, dip: Column, field: Mapping[str, Any], sizes: tuple) -> tuple[Column, Column, Column]:
    """Normal, down-dip and along-strike component of the traction on the plane, for principal stresses `sizes`."""
    f = {k: v if isinstance(v, Column) else F.lit(float(v)) for k, v in field.items() if k != "Domain"}
    one, three = _axis(f["s1_trend"], f["s1_plunge"]), _axis(f["s3_trend"], f["s3_plunge"])
    two = cross(one, three)
    size = norm(two)
    two = tuple(x / size for x in two)
    axes = [tuple(F.round(x, 10) for x in a) for a in (one, two, three)]
    s, d = F.radians(strike), F.radians(dip)
    n = -F.sin(s) * F.sin(d), F.cos(s) * F.sin(d), -F.cos(d)
    along = F.cos(s), F.sin(s), F.lit(0.0)
    down = -F.sin(s) * F.cos(d), F.cos(s) * F.cos(d), F.sin(d)
    part = [m * dot(a, n) for m, a in zip(sizes, axes, strict=True)]
    t = tuple(part[0] * axes[0][i] + part[1] * axes[1][i] + part[2] * axes[2][i] for i in range(3))
    return dot(t, n), dot(t, down), dot(t, along)


def stress_on_plane(strike: Column, dip: Column, field: Mapping[str, Any], friction: float = 0.75, pore_pressure: float = 0.0) -> dict[str, Column]:
    """effective_normal_stress, shear_stress, rake_angle and instability_index for principal stresses 1, 1 - 2 R, -1."""
    r = field["R"] if isinstance(field["R"], Column) else F.lit(float(field["R"]))
    normal, down, along = _tractions(strike, dip, field, (F.lit(1.0), 1 - 2 * r, F.lit(-1.0)))
    effective, shear = normal - pore_pressure, F.sqrt(down * down + along * along)
    return {
        "effective_normal_stress": effective,
        "shear_stress": shear,
        "rake_angle": F.round(F.degrees(F.atan2(down, -along)), 10),
        "instability_index": (shear - friction * (effective - 1)) / (friction + (1 + friction**2) ** 0.5),
    }


def tendencies(strike: Column, dip: Column, field: Mapping[str, Any], friction: float = 0.75) -> dict[str, Column]:
    """slip_tendency and dilation_tendency on the reduced tensor whose largest slip tendency is the friction."""
    r = field["R"] if isinstance(field["R"], Column) else F.lit(float(field["R"]))
    largest = 0.5 * ((1 + friction**2) ** 0.5 / friction + 1)  # 1 / sin(atan(friction)) = sqrt(1 + friction^2) / friction
    normal, down, along = _tractions(strike, dip, field, (F.lit(largest), largest - (1 - r), F.lit(largest - 1)))
    shear = F.sqrt(down * down + along * along)
    return {"slip_tendency": F.round(shear / normal, 10), "dilation_tendency": F.round(largest - normal, 10)}


def all_on_plane(strike: Column, dip: Column, field: Mapping[str, Any], friction: float = 0.75, pore_pressure: float = 0.0) -> dict[str, Column]:
    return stress_on_plane(strike, dip, field, friction, pore_pressure) | tendencies(strike, dip, field, friction)
