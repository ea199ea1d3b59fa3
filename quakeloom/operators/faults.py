"""Fault tables: ids, attributes, planarity, traces and patch areas."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import disc_axes, plane_normal
from ..functions.magnitude import patch_magnitude
from .lineage import numbered
from .planes import mean_orientation

NORMAL = ("normal_vector_x", "normal_vector_y", "normal_vector_z")


def fault_ids(events: DataFrame, by: tuple[str, ...] = ("sequence_label", "cluster")) -> DataFrame:
    """events with fault_id: F0001, ... by sequence and cluster, without gaps; null where a key is."""
    keys = numbered(events.select(*by).dropna().distinct(), by, "_no").select(*by, F.format_string("F%04d", "_no").alias("fault_id"))
    return events.join(keys, list(by), "left")


def fault_metadata(events: DataFrame) -> DataFrame:
    """Per fault: events, sequence, centroid, mean orientation and mean stress values, rounded as the database has them."""
    e = events.filter("fault_id IS NOT NULL")
    r = lambda c, n: F.round(F.avg(c), n)
    g = e.groupBy("fault_id").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.min("sequence_label").alias("sequence_label"),
        *(r(c, 2).alias(f"centroid_{c.lower()}") for c in "XYZ"),
        r("instability_index", 3).alias("rupture_mean_instability"),
        r("slip_tendency", 3).alias("rupture_mean_sliptend"),
        r("dilation_tendency", 3).alias("rupture_mean_dilatend"),
    )
    return g.join(mean_orientation(e, "fault_id"), "fault_id", "left")


def _aligned(planes: DataFrame, by: str) -> DataFrame:
    """Unit normals (x, y, z), those against their group's mean turned over."""
    size = F.sqrt(sum((F.col(c) * F.col(c) for c in NORMAL), F.lit(0.0)))
    u = planes.filter(size > 0).withColumns({n: F.col(c) / size for c, n in zip(NORMAL, ("nx", "ny", "nz"), strict=True)})
    mean = u.groupBy(by).agg(*(F.avg(n).alias(f"m{n}") for n in ("nx", "ny", "nz")))
    u = u.join(mean, by)
    side = F.when(sum((F.col(n) * F.col(f"m{n}") for n in ("nx", "ny", "nz")), F.lit(0.0)) < 0, -1.0).otherwise(1.0)
    return u.withColumns({n: F.col(n) * side for n in ("nx", "ny", "nz")}).drop("mnx", "mny", "mnz")


def align_normals(planes: DataFrame, by: str) -> DataFrame:
    """planes with normals turned to the side of their group's mean."""
    return _aligned(planes, by).withColumns(dict(zip(NORMAL, map(F.col, ("nx", "ny", "nz")), strict=True))).drop("nx", "ny", "nz")


def _angles(planes: DataFrame, by: str) -> DataFrame:
    u = _aligned(planes, by)
    mean = u.groupBy(by).agg(*(F.avg(n).alias(f"m{n}") for n in ("nx", "ny", "nz")))
    size = F.sqrt(F.expr("mnx * mnx + mny * mny + mnz * mnz"))
    cos = sum((F.col(n) * F.col(f"m{n}") for n in ("nx", "ny", "nz")), F.lit(0.0)) / size
    return u.join(mean, by).withColumn("angle", F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))))


def orientation_consistency(planes: DataFrame, by: str, most: float = 45.0) -> DataFrame:
    """(by, max_deviation, consistent): the largest angle to the mean normal, and whether it is at most `most` degrees."""
    g = _angles(planes, by).groupBy(by).agg(F.max("angle").alias("max_deviation"))
    return g.withColumn("consistent", F.col("max_deviation") <= most)


def planarity(planes: DataFrame, by: str) -> DataFrame:
    """(by, planarity): exp(-0.06 * mean angle to the mean normal in degrees); null for fewer than three normals."""
    g = _angles(planes, by).groupBy(by).agg(F.avg("angle").alias("a"), F.count(F.lit(1)).alias("n"))
    return g.select(by, F.when(F.col("n") >= 3, F.exp(-0.06 * F.col("a"))).alias("planarity"))


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def half(q: np.ndarray) -> list:
        out: list = []
        for x in q:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (x[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (x[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(x)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def _hulls(points: DataFrame, by: str, u: str, v: str) -> DataFrame:
    """(by, area, length, ax, ay, bx, by_): hull area and the farthest pair. Each partition's points are reduced to hulls first,
    so a task gets no more than one hull per group and partition."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for pdf in batches:
            for k, g in pdf.groupby(by):
                q = g[[u, v]].to_numpy(float)
                held[k] = hull(np.vstack([held[k], q]) if k in held else q)
        for k, h in held.items():
            yield pd.DataFrame({by: k, u: h[:, 0], v: h[:, 1]})

    def whole(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        h = hull(pdf[[u, v]].to_numpy(float))
        d = ((h[:, None] - h[None]) ** 2).sum(-1)
        i, j = divmod(int(d.argmax()), len(h))
        x, y = h[:, 0], h[:, 1]
        area = 0.5 * abs(float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))) if len(h) > 2 else 0.0
        a, b = sorted([tuple(h[i]), tuple(h[j])])
        return pd.DataFrame([(k[0], area, float(np.sqrt(d[i, j])), *a, *b)], columns=[by, "area", "length", "ax", "ay", "bx", "by_"])

    kind = dict(points.dtypes)[by]
    few = points.select(by, u, v).mapInPandas(partial, f"{by} {kind}, {u} double, {v} double")
    return few.groupBy(by).applyInPandas(whole, f"{by} {kind}, area double, length double, ax double, ay double, bx double, by_ double")


def traces(points: DataFrame, by: str = "fault_id") -> DataFrame:
    """Per fault: length between its farthest map points, the two ends, and their bearing from the western one."""
    h = _hulls(points.filter(F.col(by).isNotNull()).withColumns({"_u": F.col("X"), "_v": F.col("Y")}), by, "_u", "_v")
    bearing = F.pmod(F.degrees(F.atan2(F.col("bx") - F.col("ax"), F.col("by_") - F.col("ay"))), F.lit(360.0))
    return h.select(by, F.col("length").alias("fault_length_m"), F.col("ax").alias("trace_start_x"), F.col("ay").alias("trace_start_y"), F.col("bx").alias("trace_end_x"), F.col("by_").alias("trace_end_y"), bearing.alias("bearing"))


def patches(points: DataFrame, orientation: DataFrame, by: str = "fault_id", law: str = "L14") -> DataFrame:
    """Per fault: area of its points' hull on its mean plane (rupture_mean_azimuth and _dip of `orientation`), and the largest magnitude."""
    n = plane_normal(F.col("rupture_mean_azimuth"), F.col("rupture_mean_dip"))
    u, v = disc_axes(n)
    on = lambda a: sum((F.col(c) * x for c, x in zip("XYZ", a, strict=True)), F.lit(0.0))
    flat = points.join(orientation, by).select(by, on(u).alias("_u"), on(v).alias("_v"))
    h = _hulls(flat, by, "_u", "_v")
    return h.select(by, F.col("area").alias("area_m2"), patch_magnitude(F.col("area") / 1e6, law).alias("max_mag"))
