"""Catalog statistics, and the search for the neighbourhood radius and time span."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.score import fixed_objective
from .lineage import cut
from .neighbors import XYZ, knn, neighbor_pairs
from .planes import cell_sums, principal_axes
from .tiles import PLACE, tile_groups, whole_groups

POINTS = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def inter_event_hours(cat: DataFrame, key: str = "ID", part_s: int = 86_400 * 30) -> DataFrame:
    """(key, hours): whole hours since the event before, by time and key; null for the first.

    A lag within stretches of time and the last event of the stretch before, so no task sorts the whole catalog.
    """
    t = F.unix_timestamp("Date")
    c = cat.select(key, t.alias("t"), F.floor(t / part_s).alias("p"))
    last = c.groupBy("p").agg(F.max("t").alias("last"))
    last = last.select("p", F.lag("last").over(Window.orderBy("p")).alias("carried"))
    inside = F.lag("t").over(Window.partitionBy("p").orderBy("t", key))
    return c.withColumn("before", inside).join(last, "p").select(key, F.floor((F.col("t") - F.coalesce("before", "carried")) / 3600).alias("hours"))


def _spread(x: str, name: str) -> list:
    q = F.percentile(x, F.array(*map(F.lit, POINTS)))
    return [F.min(x).alias(f"{name}_min"), F.max(x).alias(f"{name}_max"), F.avg(x).alias(f"{name}_mean"), *(q[i].alias(f"{name}_p{round(100 * p)}") for i, p in enumerate(POINTS))]


def catalog_stats(cat: DataFrame, key: str = "ID") -> DataFrame:
    """One row: nearest-neighbour distances, hours between events, extents, duration, rate and magnitudes."""
    near = knn(cat, 1, key).agg(*_spread("d", "nn"))
    hours = inter_event_hours(cat, key).agg(*_spread("hours", "hours"))
    t = F.unix_timestamp("Date")
    days = (F.max(t) - F.min(t)) / 86_400
    rest = cat.agg(F.count(F.lit(1)).alias("n_events"), *((F.max(c) - F.min(c)).alias(f"range_{c.lower()}") for c in "XYZ"), days.alias("duration_days"), (F.count(F.lit(1)) / F.greatest(days, F.lit(1.0))).alias("events_per_day"), F.min("MAG").alias("mag_min"), F.max("MAG").alias("mag_max"), F.avg("MAG").alias("mag_mean"))
    return rest.crossJoin(near).crossJoin(hours)


def heuristic(stats: DataFrame) -> DataFrame:
    """One row, r_nn and dt_nn: the 99th percentile distance, and hours by the event rate, kept from a day to five years."""
    dt = F.when(F.col("events_per_day") > 1, F.col("hours_p75")).when(F.col("events_per_day") > 0.1, F.col("hours_p90")).otherwise(F.least(F.col("hours_max"), F.lit(3 * 365 * 24.0)))
    return stats.select(F.col("nn_p99").alias("r_nn"), F.greatest(F.lit(24.0), F.least(dt, F.lit(5 * 365 * 24.0))).alias("dt_nn"))


def _binned_sums(mine: np.ndarray, other: np.ndarray, when: tuple[np.ndarray, np.ndarray], rs: np.ndarray, spans: np.ndarray, area: int = 131_072) -> np.ndarray:
    """(len(mine), radii, spans, 10): number and sums of offsets of the places of `other` around each of `mine`, those within each radius and span."""
    bins = len(rs) * len(spans)
    out = np.zeros((len(mine) * bins, 10))
    axis = int(np.argmax(np.ptp(other, axis=0)))
    by = np.argsort(other[:, axis])
    other, then, order = np.ascontiguousarray(other[by].T), when[1][by], np.argsort(mine[:, axis])
    reach = rs[-1] + 1e-9 * (rs[-1] + np.abs(mine).max())  # over what rounding can move
    rows = max(8, min(256, area // other.shape[1]))
    for i in range(0, len(mine), rows):
        at = order[i : i + rows]
        lo, hi = np.searchsorted(other[axis], (mine[at[0], axis] - reach, mine[at[-1], axis] + reach))
        g = [other[k, lo:hi] - mine[at, k, None] for k in range(3)]
        d2 = g[0] * g[0] + g[1] * g[1] + g[2] * g[2]
        x, y = np.nonzero(d2 <= rs[-1] * rs[-1])
        gap = np.abs(then[lo:hi][y] - when[0][at][x])
        short = np.flatnonzero(gap < spans[-1])
        x, y, gap = x[short], y[short], gap[short]
        place = (x * len(rs) + np.searchsorted(rs * rs, d2[x, y])) * len(spans) + np.searchsorted(spans, gap, side="right")
        g = [v[x, y] for v in g]
        terms = (None, *g, *(g[a] * g[b] for a, b in ((0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2))))
        sums = np.stack([np.bincount(place, t, len(at) * bins) for t in terms], -1)
        out.reshape(len(mine), bins, 10)[at] = sums.reshape(len(at), bins, 10)
    return out.reshape(len(mine), len(rs), len(spans), 10).cumsum(axis=1).cumsum(axis=2)


def _dense_sums(mine: np.ndarray, other: np.ndarray, when: tuple[np.ndarray, np.ndarray], rs: np.ndarray, spans: np.ndarray, few: int = 2_097_152) -> np.ndarray:
    """_binned_sums() by small cells: over all times where a span holds all, else by slices of time, four to a span.

    All rows up to three slices away are within the span, none over four, so only those four away are tested one by one.
    """
    if len(mine) * len(other) <= few:
        return _binned_sums(mine, other, when, rs, spans)
    out = np.zeros((len(mine), len(rs), len(spans), 10))
    start = min(x.min() for x in when)
    whole = spans > max(x.max() for x in when) - start
    if whole.any():
        out[:, :, whole] = cell_sums(mine, other, rs)[:, :, None]
    for k in np.flatnonzero(~whole):
        own, there = ((x - start) // (int(spans[k]) // 4) for x in when)
        order, by = np.argsort(own, kind="stable"), np.argsort(there, kind="stable")
        own, there = own[order], there[by]
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], len(own)]):
            at, ends = order[a:b], np.searchsorted(there, own[a] + np.array((-4, -3, 4, 5)))
            inside, edge = by[ends[1] : ends[2]], np.r_[by[ends[0] : ends[1]], by[ends[2] : ends[3]]]
            if len(at) * len(inside) <= few // 8:
                inside, edge = inside[:0], np.r_[inside, edge]
            if len(inside):
                out[at, :, k] = cell_sums(mine[at], other[inside], rs)
            if len(edge):
                out[at, :, k] += _binned_sums(mine[at], other[edge], (when[0][at], when[1][edge]), rs, spans[k : k + 1])[:, :, 0]
    return out


def _tile_sums(cat: DataFrame, rs: list[float], ts: list[float], key: str) -> DataFrame:
    """(i, a, b, n, s0 .. s8): sums over the neighbours within the radius a and span b, added up in vectors by tiles; no pair becomes a row."""
    kind = dict(cat.dtypes)[key]
    spans, radii = np.array([(int(t) + 1) * 3600 for t in ts], float), np.array(rs, float)
    rows = cat.select(F.col(key).alias("i"), F.unix_timestamp("Date").alias("t"), F.lit(True).alias("_own"), *(F.col(c).cast("double").alias(f"_{c}") for c in XYZ)).filter("t IS NOT NULL")
    met, by = tile_groups(rows, rs[-1], block=32_768)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, by):
            probing, place, then = t["_mine"].to_numpy(), np.stack([t[c].to_numpy() for c in PLACE], -1), t["t"].to_numpy()
            found = []
            for a, b in zip(starts, np.r_[starts[1:], t.num_rows]):
                mine, other = a + np.flatnonzero(probing[a:b]), a + np.flatnonzero(~probing[a:b])
                if len(mine) and len(other):
                    sums = _dense_sums(place[mine], place[other], (then[mine], then[other]), radii, spans)
                    row, r, s = np.nonzero(sums[..., 0])
                    found.append((mine[row], r, s, sums[row, r, s]))
            if found:
                row, r, s, sums = (np.concatenate(x) for x in zip(*found, strict=True))
                columns = [t["i"].take(pa.array(row)).combine_chunks(), *(pa.array(x.astype(k)) for x, k in ((r, "int32"), (s, "int32"), (sums[:, 0], "int64"))), *(pa.array(sums[:, k]) for k in range(1, 10))]
                yield pa.RecordBatch.from_arrays(columns, ["i", "a", "b", "n", *(f"s{k}" for k in range(9))])

    schema = f"i {kind}, a int, b int, n long, " + ", ".join(f"s{k} double" for k in range(9))
    return met.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, schema)


def _pair_sums(cat: DataFrame, rs: list[float], ts: list[float], key: str) -> DataFrame:
    """_tile_sums() over the neighbour join. Each pair counts once, in the first radius and span that hold it; sums of the smaller ones are then
    added up, so a finer grid costs no more pairs."""
    pairs = neighbor_pairs(cat, rs[-1], ts[-1], key)
    a = sum(((F.col("d2") > r * r).cast("int") for r in rs), F.lit(0))
    b = sum(((F.col("dt_s") >= (int(t) + 1) * 3600).cast("int") for t in ts), F.lit(0))
    terms = ("dx", "dy", "dz", "dx * dx", "dy * dy", "dz * dz", "dx * dy", "dx * dz", "dy * dz")
    cells = pairs.groupBy("i", a.alias("a"), b.alias("b")).agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.expr(e)).alias(f"s{k}") for k, e in enumerate(terms)))
    up = cells.select("i", F.explode(F.sequence("a", F.lit(len(rs) - 1))).alias("a"), "b", "n", *(f"s{k}" for k in range(9)))
    return up.select("i", "a", F.explode(F.sequence("b", F.lit(len(ts) - 1))).alias("b"), "n", *(f"s{k}" for k in range(9)))


def grid_moments(cat: DataFrame, r_values: list[float], dt_values: list[float], key: str = "ID") -> DataFrame:
    """(i, r, dt, n, covariances) for every pair of a radius and a time span in hours that holds 5 events or more.

    All are found at once from the neighbours within the largest ones: by tiles in vectors or, where the largest span is under a year, by the
    neighbour join, which is then keyed by time too.
    """
    found, equal = _distinct_moments(cat, r_values, dt_values, key)
    return found.withColumn("dt", _each(equal))


def _distinct_moments(cat: DataFrame, r_values: list[float], dt_values: list[float], key: str) -> tuple[DataFrame, list[float]]:
    """grid_moments() at the spans up to the first that holds the whole catalog, and that one with those after it, which hold the same."""
    rs, every = sorted(r_values), sorted(dt_values)
    t = F.unix_timestamp("Date")
    length = cat.agg(F.max(t) - F.min(t)).first()[0]
    ts = every if length is None else [x for k, x in enumerate(every) if k == 0 or (int(every[k - 1]) + 1) * 3600 <= length]
    up = (_pair_sums if int(every[-1]) + 1 < 366 * 24 else _tile_sums)(cat, rs, ts, key)
    g = up.groupBy("i", "a", "b").agg(F.sum("n").alias("n"), *(F.sum(f"s{k}").alias(f"s{k}") for k in range(9))).filter("n >= 5")
    cov = {"cxx": (3, 0, 0), "cyy": (4, 1, 1), "czz": (5, 2, 2), "cxy": (6, 0, 1), "cxz": (7, 0, 2), "cyz": (8, 1, 2)}
    g = g.select("i", F.array(*map(F.lit, rs))[F.col("a")].alias("r"), F.array(*map(F.lit, ts))[F.col("b")].alias("dt"), "n", *(F.expr(f"(s{p} - s{x} * s{y} / n) / (n - 1)").alias(c) for c, (p, x, y) in cov.items()))
    return g, every[len(ts) - 1 :]


def _each(equal: list[float]) -> Column:
    """The row's span, and for the first of `equal` all of them."""
    return F.explode(F.when(F.col("dt") == equal[0], F.array(*map(F.lit, equal))).otherwise(F.array("dt")))


def grid_search(cat: DataFrame, r_values: list[float], dt_values: list[float], key: str = "ID", focals: DataFrame | None = None) -> DataFrame:
    """(r, dt, planes, recovery, mean_ratio, mean_angle, score): the objective of each parameter pair, best first.

    focals: key, Strike1, Dip1, Strike2, Dip2, A of events with a focal mechanism.
    """
    from ..functions.focal import misfit

    found, equal = _distinct_moments(cat, r_values, dt_values, key)
    fits = principal_axes(found).withColumn("ratio", F.col("lambda_2") / (F.col("lambda_3") + 1e-12))
    e = cat.agg(F.avg("EX").alias("_ex"), F.avg("EY").alias("_ey"), F.count(F.lit(1)).alias("_n"))
    ok = fits.crossJoin(F.broadcast(e)).filter((F.col("lambda_2") > F.least(F.pow((F.col("_ex") + F.col("_ey")) / 2, F.lit(2)), F.pow(F.col("r") / 5, F.lit(2)))) & (F.col("ratio") > 5))
    if focals is not None:
        f = F.broadcast(focals.withColumnRenamed(key, "i")) if focals.limit(100_001).count() <= 100_000 else focals.withColumnRenamed(key, "i")
        ok = ok.join(f, "i", "left")
        eps, _ = misfit(tuple(F.col(f"normal_vector_{c}") for c in "xyz"), (F.col("Strike1"), F.col("Dip1")), (F.col("Strike2"), F.col("Dip2")), F.col("A"))
        ok = ok.withColumn("epsilon", eps)
    else:
        ok = ok.withColumn("epsilon", F.lit(None).cast("double"))
    g = ok.groupBy("r", "dt").agg(F.count(F.lit(1)).alias("planes"), (F.count(F.lit(1)) / F.first("_n")).alias("recovery"), F.avg("ratio").alias("mean_ratio"), F.avg("epsilon").alias("mean_angle"))
    score = fixed_objective(F.col("recovery"), F.col("mean_ratio"), F.col("mean_angle"), F.lit(None).cast("double"))
    return g.withColumns({"score": score, "dt": _each(equal)}).orderBy("score", "r", "dt")


def _skyline(v: np.ndarray, against: np.ndarray | None = None) -> np.ndarray:
    """Which rows of v no row of `against` (of v itself if not given) beats or equals in all columns while beating it in one."""
    other = v if against is None else against
    other = other[np.argsort(other.sum(axis=1), kind="stable")]
    stays = np.ones(len(v), bool)
    for row in other:  # those with small sums first: they drop most
        at = np.flatnonzero(stays)
        if not len(at):
            break
        x = v[at]
        stays[at[(row <= x).all(axis=1) & (row < x).any(axis=1)]] = False
    return stays


def pareto(results: DataFrame, objectives: tuple[str, ...], block: int = 4096) -> DataFrame:
    """The rows that no other one beats or equals in all objectives (all to be small) while beating it in one.

    Each part of the table keeps its own front; the fronts are then dealt into blocks of about `block` rows, and each block is
    held against every other one, each such pair of blocks being a group of its own. Rows with a null objective are beaten
    by none and beat none.
    """
    r = cut(results.withColumn("_id", F.monotonically_increasing_id()))
    known = " AND ".join(f"`{c}` IS NOT NULL" for c in objectives)
    named = [F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(objectives)]
    axes = [f"_{i}" for i in range(len(objectives))]
    schema = "_id long, " + ", ".join(f"{a} double" for a in axes)

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        front = None
        for pdf in batches:
            front = pdf if front is None else pd.concat([front, pdf], ignore_index=True)
            front = front[_skyline(front[axes].to_numpy(float))].reset_index(drop=True)
        if front is not None:
            yield front

    def beaten(mine: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        return mine[~_skyline(mine[axes].to_numpy(float), other[axes].to_numpy(float))][["_id"]]

    front = cut(r.filter(known).select("_id", *named).mapInPandas(local, schema))
    blocks = max(1, -(-front.count() // block))
    own, every = F.pmod(F.xxhash64("_id"), F.lit(blocks)), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    mine, other = (front.withColumn(p, own).withColumn(q, every).groupBy("p", "q") for p, q in ("pq", "qp"))
    gone = mine.cogroup(other).applyInPandas(beaten, "_id long").distinct()
    kept = front.select("_id").join(gone, "_id", "left_anti").union(r.filter(f"NOT ({known})").select("_id"))
    return r.join(kept, "_id", "left_semi").drop("_id")


def representatives(front: DataFrame, objectives: tuple[str, ...]) -> DataFrame:
    """The front's best row for each objective, and the balanced one: nearest to the ideal after scaling to 0 .. 1."""
    ends = front.agg(*(F.min(c).alias(f"_lo_{c}") for c in objectives), *(F.max(c).alias(f"_hi_{c}") for c in objectives))
    f = front.crossJoin(F.broadcast(ends))
    scaled = [F.coalesce((F.col(c) - F.col(f"_lo_{c}")) / F.nullif(F.col(f"_hi_{c}") - F.col(f"_lo_{c}"), F.lit(0.0)), F.lit(0.0)) for c in objectives]
    f = f.withColumn("_d", F.sqrt(sum((s * s for s in scaled), F.lit(0.0)))).select(*front.columns, "_d")
    row = F.struct(*front.columns)
    picks = f.agg(F.min_by(row, F.struct("_d", *objectives)).alias("balanced"), *(F.min_by(row, F.struct(c, "_d")).alias(f"best_{c}") for c in objectives))
    kinds = ["balanced", *(f"best_{c}" for c in objectives)]
    return picks.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("r")) for k in kinds))).alias("p")).select("p.kind", "p.r.*")
