"""Rupture planes: principal components of each event's neighbourhood, Monte-Carlo copies, orientation statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import normal_azimuth_dip, plane_normal
from .neighbors import XYZ
from .tiles import boxes, gaps, ranges, small_cells, tile_groups, whole_groups

TERMS = {"sx": "dx", "sy": "dy", "sz": "dz", "sxx": "dx * dx", "syy": "dy * dy", "szz": "dz * dz", "sxy": "dx * dy", "sxz": "dx * dz", "syz": "dy * dz"}
PRODUCTS = ((0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2))
COVARIANCE = ("cxx", "cyy", "czz", "cxy", "cxz", "cyz")


def moments(pairs: DataFrame, by: tuple[str, ...] = ("i",)) -> DataFrame:
    """n and the covariances of the neighbours, per group. The sums are of offsets from the event, so nothing cancels,
    and are combined before the shuffle; the neighbours are never gathered."""
    return _covariances(pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.expr(e)).alias(k) for k, e in TERMS.items())), by)


def _covariances(m: DataFrame, by: tuple[str, ...]) -> DataFrame:
    cov = lambda a, b: F.expr(f"(s{a}{b} - s{a} * s{b} / n) / nullif(n - 1, 0)").alias(f"c{a}{b}")
    return m.select(*by, "n", cov("x", "x"), cov("y", "y"), cov("z", "z"), cov("x", "y"), cov("x", "z"), cov("y", "z"))


def _ring_sums(x: np.ndarray, by: np.ndarray, at: np.ndarray, low: np.ndarray, r: float, some: int = 1024) -> np.ndarray:
    """For each place x the number of the places `at` of by (3, n) within r, and the sums of their offsets from `low` and of the products of these."""
    out = np.zeros((len(x), 1 + len(TERMS)))
    for i in range(0, len(at), some):
        y = np.take(by, at[i : i + some], axis=1)
        d2 = np.subtract.outer(x[:, 0], y[0])
        d2 *= d2
        for k in (1, 2):
            gap = np.subtract.outer(x[:, k], y[k])
            gap *= gap
            d2 += gap
        terms = np.empty((1 + len(TERMS), y.shape[1]))
        terms[0] = 1.0
        np.subtract(y, low[:, None], out=terms[1:4])
        for k, (a, b) in enumerate(PRODUCTS, 4):
            np.multiply(terms[1 + a], terms[1 + b], out=terms[k])
        out += (d2 <= r * r).astype(float) @ terms.T
    return out


def _cell_sums(mine: np.ndarray, other: np.ndarray, r: float, most: int = 16, own: int = 48) -> np.ndarray:
    """_group_sums() by small cells on both sides."""
    return cell_sums(mine, other, [r], most, own)[:, 0]


def cell_sums(mine: np.ndarray, other: np.ndarray, radii: Sequence[float], most: int = 16, own: int = 48) -> np.ndarray:
    """(len(mine), radii, 10): for each place of `mine` the number of places of `other` within each radius (the largest last) and the sums of TERMS.

    Cells wholly within a radius of one another go by the sums over their rows, rows are only held against those of cells that a sphere may cut.
    """
    out, r = np.zeros((len(mine), len(radii), 1 + len(TERMS))), radii[-1]
    order, starts = small_cells(other, r, most)
    other = other[order]
    (lows, highs), ends = boxes(other, starts), np.r_[starts[1:], len(other)]
    axis = int(np.argmax(np.ptp(other, axis=0)))
    size = (ends - starts).astype(float)
    off = other - np.repeat(lows, ends - starts, axis=0)  # sums are of offsets from a cell's lowest corner, so little cancels
    first = np.add.reduceat(off, starts, axis=0)
    second = np.add.reduceat(off[:, :, None] * off[:, None, :], starts, axis=0).reshape(-1, 9)
    by = np.ascontiguousarray(other.T)
    left, right, widest = np.ascontiguousarray(lows.T), np.ascontiguousarray(highs.T), float(np.max(highs[:, axis] - lows[:, axis]))
    at, begin = small_cells(mine, r, own)
    end = np.r_[begin[1:], len(mine)]
    x, rows, turn = mine[at], 128, lows[:, axis]
    sorted_cells = bool((turn[1:] >= turn[:-1]).all())
    for i, j in ((i, min(i + rows, b)) for a, b in zip(begin, end, strict=True) for i in range(a, b, rows)):
        low, high = x[i:j].min(axis=0), x[i:j].max(axis=0)
        lo, hi = 0, len(starts)
        if sorted_cells:
            slack = r + 1e-9 * (r + abs(low[axis]) + abs(high[axis]))
            lo, hi = np.searchsorted(turn, (low[axis] - slack - widest, high[axis] + slack))
        near, far = gaps(low, high, left[:, lo:hi], right[:, lo:hi])
        t = x[i:j] - low  # from the box's corner to each row
        for m, q in enumerate(radii):
            whole = lo + np.flatnonzero(far <= q * q)
            rim = lo + np.flatnonzero((near <= q * q) & (far > q * q))
            d, a, n = lows[whole] - low, first[whole], size[whole]
            da = d.T @ a
            ss = second[whole].sum(axis=0).reshape(3, 3) + da + da.T + (d * n[:, None]).T @ d
            base = np.r_[n.sum(), a.sum(axis=0) + n @ d, [ss[k] for k in PRODUCTS]]
            sums = base + _ring_sums(x[i:j], by, ranges(starts[rim], ends[rim]), low, q)
            s = sums[:, 1:4] - sums[:, :1] * t
            out[at[i:j], m, 0], out[at[i:j], m, 1:4] = sums[:, 0], s
            for k, (a, b) in enumerate(PRODUCTS, 4):
                out[at[i:j], m, k] = sums[:, k] - t[:, a] * sums[:, 1 + b] - t[:, b] * s[:, a]
    return out


def _group_sums(mine: np.ndarray, other: np.ndarray, r: float, area: int = 131_072) -> np.ndarray:
    """For each place of `mine`, the number of places of `other` within r and the sums of TERMS over them, a few rows at a time."""
    if len(mine) * len(other) > 16 * area:
        return _cell_sums(mine, other, r)
    out = np.zeros((len(mine), 1 + len(TERMS)))
    axis = int(np.argmax(np.ptp(other, axis=0)))
    other = np.ascontiguousarray(other[np.argsort(other[:, axis])].T)
    order = np.argsort(mine[:, axis])
    reach = r + 1e-9 * (r + np.abs(mine).max())  # over what rounding can move
    rows = max(8, min(256, area // other.shape[1]))
    for i in range(0, len(mine), rows):
        at = order[i : i + rows]
        lo, hi = np.searchsorted(other[axis], (mine[at[0], axis] - reach, mine[at[-1], axis] + reach))
        g = [other[k, lo:hi] - mine[at, k, None] for k in range(3)]
        near = g[0] * g[0] + g[1] * g[1] + g[2] * g[2] <= r * r
        for x in g:
            x *= near
        out[at] = np.stack([near.sum(axis=1), *(x.sum(axis=1) for x in g), *(np.einsum("ij,ij->i", g[a], g[b]) for a, b in PRODUCTS)], -1)
    return out


def _sums_of_groups(batches: Iterator[pa.RecordBatch], by: list[str], kept: list[str], r: float) -> Iterator[pa.RecordBatch]:
    """The columns `kept` of the probing rows with n and the sums of TERMS, group by group of rows that come sorted by `by`."""
    for t, starts in whole_groups(batches, by):
        probing, place = t["_mine"].to_numpy(), np.stack([t[f"_{c}"].to_numpy() for c in XYZ], -1)
        found, at = [], []
        for a, b in zip(starts, np.r_[starts[1:], t.num_rows]):
            mine, other = a + np.flatnonzero(probing[a:b]), a + np.flatnonzero(~probing[a:b])
            if len(mine) and len(other):
                at.append(mine)
                found.append(_group_sums(place[mine], place[other], r))
        if at:
            values = np.concatenate(found)
            out = t.select(kept).take(pa.array(np.concatenate(at)))
            out = out.append_column("n", pa.array(values[:, 0].astype("int64")))
            for k, name in enumerate(TERMS, 1):
                out = out.append_column(name, pa.array(values[:, k]))
            yield from out.combine_chunks().to_batches()


def neighbor_moments(cat: DataFrame, r: float, key: str = "ID", seq: tuple[str, ...] = (), extra_build: DataFrame | None = None, block: int = 131_072) -> DataFrame:
    """(i, *seq, n, covariances): moments() of the pairs of neighbor_pairs() without a span, added up in vectors; no pair becomes a row.

    Rows are held against those around them by tiles of edge 2 r, so each row is looked at in 8 tiles.
    """
    cols = [key, *seq, *XYZ]
    rows = cat.select(*cols, F.lit(True).alias("_own"))
    if extra_build is not None:
        rows = rows.unionByName(extra_build.select(*cols, F.lit(False).alias("_own")))
    rows = rows.select(F.col(key).alias("i"), *seq, "_own", *(F.col(c).cast("double").alias(f"_{c}") for c in XYZ))
    met, by = tile_groups(rows, r, seq, block)
    kept = ["i", *seq]
    kinds = dict(met.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), "n long", *(f"{k} double" for k in TERMS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _sums_of_groups(batches, by, kept, r)

    sums = met.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, schema)
    return _covariances(sums.groupBy(*kept).agg(F.sum("n").alias("n"), *(F.sum(k).alias(k) for k in TERMS)), tuple(kept))


def _eigen(*c: pd.Series) -> pd.DataFrame:
    """Eigenvalues, largest first, and the eigenvector of the least, turned to z <= 0."""
    xx, yy, zz, xy, xz, yz = (x.to_numpy(float) for x in c)
    m = np.stack([np.stack([xx, xy, xz], -1), np.stack([xy, yy, yz], -1), np.stack([xz, yz, zz], -1)], -2)
    good = np.isfinite(m).all(axis=(1, 2))
    w, v = np.full((len(m), 3), np.nan), np.full((len(m), 3), np.nan)
    if good.any():
        values, vectors = np.linalg.eigh(m[good])
        w[good] = np.maximum(values[:, ::-1], 0)
        n = vectors[:, :, 0]
        v[good] = np.where(n[:, 2:] > 0, -n, n)
    return pd.DataFrame(np.hstack([w, v]), columns=["l1", "l2", "l3", "nx", "ny", "nz"]).astype(object).where(np.isfinite(np.hstack([w, v])), None).astype("Float64")


def principal_axes(m: DataFrame) -> DataFrame:
    """m (from moments) with lambda_1 >= lambda_2 >= lambda_3 and the normal of the best plane; null for NaN."""
    run = F.pandas_udf(_eigen, "l1 double, l2 double, l3 double, nx double, ny double, nz double")
    out = m.withColumn("_e", run(*COVARIANCE))
    names = {"lambda_1": "l1", "lambda_2": "l2", "lambda_3": "l3", "normal_vector_x": "nx", "normal_vector_y": "ny", "normal_vector_z": "nz"}
    return out.withColumns({k: F.col(f"_e.{v}") for k, v in names.items()}).drop("_e")


def fit_planes(pairs: DataFrame, errors: DataFrame, r: float, by: tuple[str, ...] = ("i",), seq: tuple[str, ...] = (), min_n: int = 5, min_ratio: float = 5.0) -> DataFrame:
    """Accepted planes: at least min_n neighbours, lambda_2 over min(mean location error squared, (r / 5) squared), lambda_2 / lambda_3 over min_ratio.

    errors: the catalog's EX, EY (and seq); their means are per sequence. Adds lambda_2_3, total_variance, rupture_plane_azimuth
    and _dip. Events without an accepted plane are absent.
    """
    return accept_planes(moments(pairs, (*by, *seq)), errors, r, seq, min_n, min_ratio)


def accept_planes(m: DataFrame, errors: DataFrame, r: float, seq: tuple[str, ...] = (), min_n: int = 5, min_ratio: float = 5.0) -> DataFrame:
    """fit_planes() from the moments of the neighbours."""
    m = m.filter(F.col("n") >= min_n)
    fits = principal_axes(m).withColumn("lambda_2_3", F.col("lambda_2") / (F.col("lambda_3") + 1e-12))
    e = (F.coalesce(F.avg("EX"), F.lit(0.0)) + F.coalesce(F.avg("EY"), F.lit(0.0))) / 2
    least = (errors.groupBy(*seq) if seq else errors).agg(F.least(e * e, F.lit((r / 5) ** 2)).alias("_least"))
    fits = fits.join(F.broadcast(least), list(seq)) if seq else fits.crossJoin(F.broadcast(least))
    fits = fits.filter((F.col("lambda_2") > F.col("_least")) & (F.col("lambda_2_3") > min_ratio)).drop("_least")
    azimuth, dip = normal_azimuth_dip(tuple(F.col(f"normal_vector_{c}") for c in "xyz"))
    return fits.withColumns({"total_variance": F.expr("lambda_1 + lambda_2 + lambda_3"), "rupture_plane_azimuth": azimuth, "rupture_plane_dip": dip})


def _normal(seed: int, key: str, axis: int) -> Column:
    """Standard normal variate of a row, by Box and Muller from hashes: equal whenever a task is run again."""
    u = [(F.pmod(F.xxhash64(F.lit(seed), F.lit(2 * axis + i), F.col(key), F.col("k")), F.lit(2**52)) + 0.5) / 2.0**52 for i in (0, 1)]
    return F.sqrt(-2 * F.log(u[0])) * F.cos(2 * math.pi * u[1])


def perturb(cat: DataFrame, n_mc: int = 1, seed: int = 42, key: str = "ID") -> DataFrame:
    """n_mc copies of each event, numbered k, with X, Y, Z moved by normal errors of EX, EY, EZ; one copy stays where it is."""
    copies = cat.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n_mc - 1))))
    if n_mc == 1:
        return copies
    return copies.withColumns({c: F.col(c) + F.coalesce(F.col(f"E{c}"), F.lit(0.0)) * _normal(seed, key, i) for i, c in enumerate("XYZ")})


def _kent(n: pd.Series, *c: pd.Series) -> pd.DataFrame:
    """Kent's moment estimates of concentration and ovalness from the sums of unit vectors and of their products."""
    n = n.to_numpy(float)
    sx, sy, sz, xx, yy, zz, xy, xz, yz = (x.to_numpy(float) for x in c)
    size = np.sqrt(sx**2 + sy**2 + sz**2)
    with np.errstate(all="ignore"):
        mean = np.stack([sx, sy, sz], -1) / size[:, None]
        r1 = size / n
        second = np.stack([np.stack([xx, xy, xz], -1), np.stack([xy, yy, yz], -1), np.stack([xz, yz, zz], -1)], -2) / n[:, None, None]
        # two axes across the mean direction; the spread between the second moments along its own axes is r2
        ref = np.where(np.abs(mean[:, 2:]) < 0.9, [[0.0, 0.0, 1.0]], [[1.0, 0.0, 0.0]])
        u = np.cross(mean, ref)
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        v = np.cross(mean, u)
        uu, vv, uv = (np.einsum("ni,nij,nj->n", a, second, b) for a, b in ((u, u), (v, v), (u, v)))
        r2 = np.sqrt((uu - vv) ** 2 + 4 * uv**2)
        a, b = 1 / (2 - 2 * r1 - r2), 1 / (2 - 2 * r1 + r2)
        kappa, beta = a + b, 0.5 * (a - b)
    out = np.stack([np.trunc(kappa), np.trunc(beta)], -1)
    return pd.DataFrame(out, columns=["kappa", "beta"]).astype(object).where(np.isfinite(out), None).astype("Float64")


def orientation_stats(planes: DataFrame, n_mc: int, key: str = "i", min_share: float = 0.8) -> DataFrame:
    """Per event over its fitted copies (k, normal_vector_*, lambda_2_3): nr_rupt_fits, mean normal, resultant length R, N,
    R / N, Kent's kappa and beta, mean lambda_2_3.

    Normals are turned to the side of the first copy's. Under min_share of fitted copies only the share and the mean ratio
    are given. A single copy is its own mean with kappa and beta -999; where kappa cannot be estimated it is the largest known.
    """
    v = [F.col(f"normal_vector_{c}") for c in "xyz"]
    first = planes.groupBy(key).agg(F.min_by(F.struct(*(x.alias(c) for x, c in zip(v, "xyz", strict=True))), "k").alias("_f"))
    p = planes.join(first, key)
    side = F.when(sum((x * F.col(f"_f.{c}") for x, c in zip(v, "xyz", strict=True)), F.lit(0.0)) < 0, -1.0).otherwise(1.0)
    p = p.select(key, "lambda_2_3", *((x * side).alias(c) for x, c in zip(v, "xyz", strict=True)))
    products = ("x * x", "y * y", "z * z", "x * y", "x * z", "y * z")
    g = p.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg("lambda_2_3").alias("lambda_2_3"), *(F.sum(c).alias(f"s{c}") for c in "xyz"), *(F.sum(F.expr(e)).alias(f"p{i}") for i, e in enumerate(products)))
    enough = F.col("n") / n_mc >= min_share
    size = F.sqrt(F.expr("sx * sx + sy * sy + sz * sz"))
    down = F.when(F.col("sz") > 0, -1.0).otherwise(1.0)
    g = g.withColumn("nr_rupt_fits", F.col("n") / n_mc)
    if n_mc > 1:
        g = g.withColumn("_k", F.pandas_udf(_kent, "kappa double, beta double")("n", "sx", "sy", "sz", *(f"p{i}" for i in range(6))))
        top = g.filter(enough).agg(F.max("_k.kappa").alias("_top"))
        g = g.crossJoin(F.broadcast(top)).withColumns({"kappa": F.coalesce(F.col("_k.kappa"), F.col("_top")), "beta": F.col("_k.beta")})
    else:
        g = g.withColumns({"kappa": F.lit(-999.0), "beta": F.lit(-999.0)})
    mean = {f"normal_vector_{c}": F.when(enough, F.col(f"s{c}") / size * down) for c in "xyz"}
    quality = {"nvector_quality_R": F.when(enough, size), "nvector_quality_N": F.when(enough, F.lit(float(n_mc))), "nvector_quality_ratio": F.when(enough, size / n_mc)}
    return g.withColumns(mean | quality | {c: F.when(enough, F.col(c)) for c in ("kappa", "beta")}).select(key, "nr_rupt_fits", *mean, *quality, "kappa", "beta", "lambda_2_3")


def mean_orientation(planes: DataFrame, by: str) -> DataFrame:
    """Per group: azimuth and dip (whole degrees) of the mean downward normal of planes given by azimuth and dip."""
    n = plane_normal(F.col("rupture_plane_azimuth"), F.col("rupture_plane_dip"))
    g = planes.groupBy(by).agg(*(F.avg(x).alias(c) for x, c in zip(n, "xyz", strict=True)))
    size = F.sqrt(F.expr("x * x + y * y + z * z"))
    azimuth, dip = normal_azimuth_dip(tuple(F.col(c) / size for c in "xyz"))
    return g.select(by, azimuth.alias("rupture_mean_azimuth"), dip.alias("rupture_mean_dip"))


def plane_quality(planes: DataFrame, events: DataFrame) -> DataFrame:
    """One row: mean and median lambda_2_3, the shares over 5, 20, 50 and 100, and the share of events with a plane."""
    x = F.col("lambda_2_3")
    total = events.agg(F.count(F.lit(1)).alias("_n"))
    q = planes.agg(F.count(x).alias("_p"), F.avg(x).alias("mean_lambda23_ratio"), F.median(x).alias("median_lambda23_ratio"), *(F.avg((x >= t).cast("double")).alias(f"share_over_{t}") for t in (5, 20, 50, 100)))
    return q.crossJoin(total).withColumn("plane_recovery_rate", F.col("_p") / F.col("_n")).drop("_p", "_n")

