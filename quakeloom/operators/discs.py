"""Point clouds and meshes of rupture discs, by exploding rings and points: nothing is built on the driver."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import disc_axes, plane_normal
from ..functions.magnitude import ml_to_mw, rupture_radius

NORMAL = ("normal_vector_x", "normal_vector_y", "normal_vector_z")


def _with_axes(planes: DataFrame) -> DataFrame:
    size = F.sqrt(sum((F.col(c) * F.col(c) for c in NORMAL), F.lit(0.0)))
    u, v = disc_axes(tuple(F.col(c) / size for c in NORMAL))
    return planes.withColumns({f"_u{i}": u[i] for i in range(3)} | {f"_v{i}": v[i] for i in range(3)})


def _scaled(planes: DataFrame, ring_m: float, spacing_m: float, max_points: int | None) -> tuple[float, float]:
    """Ring and point spacing, widened by the root of the excess if the discs would have more than max_points points."""
    if max_points is None:
        return ring_m, spacing_m
    # points of a disc with n rings: about 1 + 2 pi ring_m (1 + .. + n) / spacing_m
    n = F.greatest(F.lit(1), F.floor(F.col("rupt_radius") / ring_m))
    total = planes.agg(F.sum(1 + 2 * math.pi * ring_m * n * (n + 1) / 2 / spacing_m)).first()[0] or 0
    f = math.sqrt(total / max_points) if total > max_points else 1.0
    return ring_m * f, spacing_m * f


def disc_points(planes: DataFrame, ring_m: float = 20.0, spacing_m: float = 12.0, max_points: int | None = None, least: int = 3, edge: bool = False, max_rings: int | None = None, centre: bool = True) -> DataFrame:
    """planes' rows (X, Y, Z, normal_vector_*, rupt_radius and more), once per point of their disc, with X, Y, Z of the point,
    point_type, ring_index and point_index_on_ring.

    edge: a last ring lies on the rim. max_rings: wider rings instead of more. A radius of zero gives the centre alone.
    """
    ring_m, spacing_m = _scaled(planes, ring_m, spacing_m, max_points)
    r = F.col("rupt_radius")
    step = F.lit(ring_m) if max_rings is None else F.when(r / ring_m <= max_rings, F.lit(ring_m)).otherwise(r / max_rings)
    p = _with_axes(planes).withColumn("_step", step)
    whole = F.floor(r / F.col("_step") + (1e-12 if edge else 0)).cast("int")
    n = F.when(r > 0, (whole + (r - whole * F.col("_step") > 1e-9).cast("int")) if edge else F.greatest(F.lit(1), whole)).otherwise(0)
    p = p.withColumn("ring_index", F.explode(F.sequence(F.lit(0 if centre else 1), F.greatest(n, F.lit(0 if centre else 1)))))
    p = p.filter((F.col("ring_index") <= n) | (F.col("ring_index") == 0)).withColumn("_r", F.least(F.col("ring_index") * F.col("_step"), r))
    count = F.when(F.col("ring_index") == 0, 1).otherwise(F.greatest(F.lit(least), F.floor(2 * math.pi * F.col("_r") / spacing_m).cast("int")))
    p = p.withColumn("_count", count).withColumn("point_index_on_ring", F.explode(F.sequence(F.lit(0), F.col("_count") - 1)))
    angle = 2 * math.pi * F.col("point_index_on_ring") / F.col("_count")
    at = {c: F.col(c) + F.col("_r") * (F.cos(angle) * F.col(f"_u{i}") + F.sin(angle) * F.col(f"_v{i}")) for i, c in enumerate("XYZ")}
    kind = F.when(F.col("ring_index") == 0, "center").otherwise("fault_plane")
    return p.withColumns(at | {"point_type": kind}).drop("_r", "_count", "_step", *(f"_{a}{i}" for a in "uv" for i in range(3)))


def focal_points(focals: DataFrame, ring_m: float = 25.0, spacing_m: float = 25.0) -> DataFrame:
    """Points of the active planes (A of 1 or 2) of events with a focal, without the centres; radius from the magnitude if there is none."""
    pick = lambda n: F.when(F.col("A") == 1, F.col(f"{n}1")).when(F.col("A") == 2, F.col(f"{n}2"))
    f = focals.withColumns({"_strike": pick("Strike"), "_dip": pick("Dip")}).filter(F.col("_strike").between(0, 360) & F.col("_dip").between(0, 90))
    n = plane_normal(F.pmod(F.col("_strike") + 90, F.lit(360.0)), F.col("_dip"))
    radius = rupture_radius(ml_to_mw(F.col("MAG")))
    if "rupt_radius" in focals.columns:
        radius = F.coalesce("rupt_radius", radius)
    f = f.withColumns(dict(zip(NORMAL, n, strict=True)) | {"rupt_radius": radius}).filter("rupt_radius IS NOT NULL").drop("_strike", "_dip")
    return disc_points(f, ring_m, spacing_m, least=8, edge=True, centre=False)


def surface_points(planes: DataFrame, ring_m: float = 50.0, spacing_m: float = 50.0, max_points: int | None = 100_000) -> DataFrame:
    """Points for fault surfaces: rim included, 50 rings at most."""
    return disc_points(planes, ring_m, spacing_m, max_points, least=8, edge=True, max_rings=50)


def segments(radius):
    """Segments of a disc's mesh by its radius in metres."""
    return F.when(radius < 50, 8).when(radius < 200, 12).otherwise(16)


def disc_vertices(planes: DataFrame) -> DataFrame:
    """planes' rows once per vertex: 0 the centre, then the ring at half the radius, then the rim; with n_segments."""
    p = _with_axes(planes).withColumn("n_segments", segments(F.col("rupt_radius"))).withColumn("vertex", F.explode(F.sequence(F.lit(0), 2 * F.col("n_segments"))))
    r = F.when(F.col("vertex") == 0, 0.0).when(F.col("vertex") <= F.col("n_segments"), F.col("rupt_radius") / 2).otherwise(F.col("rupt_radius"))
    angle = 2 * math.pi * F.pmod(F.col("vertex") - 1, F.col("n_segments")) / F.col("n_segments")
    at = {c: F.col(c) + r * (F.cos(angle) * F.col(f"_u{i}") + F.sin(angle) * F.col(f"_v{i}")) for i, c in enumerate("XYZ")}
    return p.withColumns(at).drop(*(f"_{a}{i}" for a in "uv" for i in range(3)))


def disc_faces(planes: DataFrame, key: str = "ID") -> DataFrame:
    """(key, face, a, b, c): vertex numbers of each triangle, n around the centre and two for each segment between the rings."""
    p = planes.select(key, segments(F.col("rupt_radius")).alias("n"))
    p = p.withColumn("s", F.explode(F.expr("sequence(0, n - 1)"))).withColumn("t", F.expr("(s + 1) % n"))
    triangles = F.expr("""array(struct(s AS face, 0 AS a, 1 + s AS b, 1 + t AS c),
        struct(n + 2 * s AS face, 1 + s AS a, 1 + n + s AS b, 1 + t AS c), struct(n + 2 * s + 1 AS face, 1 + t AS a, 1 + n + s AS b, 1 + n + t AS c))""")
    return p.select(key, F.explode(triangles).alias("f")).select(key, "f.*")
