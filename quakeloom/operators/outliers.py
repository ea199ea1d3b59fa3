"""Outlier flags for catalog events: density, local outlier factor, isolation forest."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import dbscan, pick_cluster
from .lineage import cut
from .neighbors import XYZ, knn

#: An active plane of 1 or 2 keeps an event from being an outlier.
PROTECTED = "coalesce(A IN (1, 2), false)"


def _focal(cat: DataFrame) -> Column:
    return F.expr(PROTECTED) if "A" in cat.columns else F.lit(False)


def flag_outliers_dbscan(cat: DataFrame, min_samples: int = 5, key: str = "ID") -> DataFrame:
    """(key, label, outlier): clusters at 1.5 times the 75th percentile of the fifth-neighbour distance; noise is an outlier.

    Events with an active plane that are noise join the largest cluster (0 if there is none).
    """
    near = knn(cat, 5, key)
    eps = 1.5 * (near.filter("rank = 5").agg(F.percentile("d", F.lit(0.75))).first()[0] or 0.0)
    if eps <= 0:
        return cat.select(key, F.lit(0).alias("label"), F.lit(False).alias("outlier"))
    found = cut(dbscan(cat, XYZ, eps, min_samples, key).select(key, "label"))
    top = pick_cluster(found.filter("label >= 0"), "label").agg(F.coalesce(F.max("label"), F.lit(0)).alias("_top"))
    out = found.join(cat.select(key, _focal(cat).alias("_f")), key).crossJoin(F.broadcast(top))
    label = F.when((F.col("label") < 0) & F.col("_f"), F.col("_top")).otherwise(F.col("label"))
    return out.select(key, label.alias("label"), (label < 0).alias("outlier"))


def local_outlier_factor(cat: DataFrame, k: int, key: str = "ID") -> DataFrame:
    """(key, lof): mean local reachability density of the k neighbours over the event's own."""
    near = cut(knn(cat, k, key))
    top = near.groupBy("i").agg(F.max("d").alias("kd"))
    reach = near.join(top.select(F.col("i").alias("j"), "kd"), "j").withColumn("r", F.greatest("kd", "d"))
    lrd = cut(reach.groupBy("i").agg((1 / (F.avg("r") + 1e-10)).alias("lrd")))
    both = near.join(lrd.select(F.col("i").alias("j"), F.col("lrd").alias("lj")), "j").groupBy("i").agg(F.avg("lj").alias("lj")).join(lrd, "i")
    return both.select(F.col("i").alias(key), (F.col("lj") / F.col("lrd")).alias("lof"))


def flag_outliers_lof(cat: DataFrame, k: int | None = None, contamination: float | None = None, key: str = "ID") -> DataFrame:
    """(key, lof, outlier): factor over 1.5, or the given share with the largest ones; k is the root of the rows, 10 to 50, by default."""
    k = k or max(10, min(50, math.isqrt(cat.count())))
    f = local_outlier_factor(cat, k, key)
    if contamination is None:
        flag = F.col("lof") > 1.5
    else:
        f = f.crossJoin(F.broadcast(f.agg(F.percentile("lof", F.lit(1 - contamination)).alias("_t"))))
        flag = F.col("lof") > F.col("_t")
    return f.join(cat.select(key, _focal(cat).alias("_f")), key).select(key, "lof", (flag & ~F.col("_f")).alias("outlier"))


def _path(n: float) -> float:
    """Mean depth of an unsuccessful search among n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _grow(rows: np.ndarray, rng: np.random.Generator, depth: int, limit: int, out: list) -> int:
    """Adds a subtree's nodes (axis, cut, left, right, path length) to out; returns its root. Axis -1: a leaf."""
    at = len(out)
    out.append(None)
    spread = np.flatnonzero(np.ptp(rows, axis=0) > 0) if len(rows) > 1 else []
    if depth >= limit or len(spread) == 0:
        out[at] = (-1, 0.0, -1, -1, depth + _path(len(rows)))
        return at
    axis = int(rng.choice(spread))
    split = float(rng.uniform(rows[:, axis].min(), rows[:, axis].max()))
    low = rows[:, axis] <= split
    left = _grow(rows[low], rng, depth + 1, limit, out)
    out[at] = (axis, split, left, _grow(rows[~low], rng, depth + 1, limit, out), 0.0)
    return at


def flag_outliers_iforest(cat: DataFrame, trees: int = 100, contamination: float = 0.05, sample: int = 256, seed: int = 42, key: str = "ID", axes: tuple[str, ...] = XYZ) -> DataFrame:
    """(key, score, outlier): isolation score (near 1: easily isolated) and the given share with the largest ones.

    Each tree is grown in its own task from at most `sample` rows, chosen by a hash; the trees together have a bounded
    size, so they are broadcast and all rows are scored in vectors.
    """
    n = cat.count()
    share = min(1.0, 2.0 * sample / max(n, 1))
    chance = F.pmod(F.xxhash64(F.lit(seed), F.col("tree"), F.col(key)), F.lit(2**40)) / 2.0**40
    rows = cat.select(key, *axes).withColumn("tree", F.explode(F.expr(f"sequence(0, {trees - 1})"))).withColumn("_h", chance).filter(F.col("_h") < share)
    names = list(axes)

    def grow(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        part = pdf.sort_values(["_h", key]).head(sample)
        out: list = []
        _grow(part[names].to_numpy(float), np.random.default_rng([seed, int(k[0])]), 0, math.ceil(math.log2(max(2, len(part)))), out)
        return pd.DataFrame([(int(k[0]), i, *x) for i, x in enumerate(out)], columns=["tree", "node", "axis", "cut", "l", "r", "path"])

    forest = rows.groupBy("tree").applyInPandas(grow, "tree int, node int, axis int, cut double, l int, r int, path double").toPandas()
    arrays = [g.sort_values("node")[["axis", "cut", "l", "r", "path"]].to_numpy(float) for _, g in forest.groupby("tree")]
    shared = cat.sparkSession.sparkContext.broadcast(arrays)
    norm = _path(min(sample, n)) or 1.0

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[names].to_numpy(float)
            depth = np.zeros(len(x))
            for t in shared.value:
                at = np.zeros(len(x), int)
                while True:
                    inner = np.flatnonzero(t[at, 0] >= 0)
                    if not len(inner):
                        break
                    node = t[at[inner]]
                    low = x[inner, node[:, 0].astype(int)] <= node[:, 1]
                    at[inner] = np.where(low, node[:, 2], node[:, 3]).astype(int)
                depth += t[at, 4]
            yield pd.DataFrame({key: pdf[key], "score": 2.0 ** (-depth / max(1, len(shared.value)) / norm), "_f": pdf["_f"]})

    kind = dict(cat.dtypes)[key]
    scored = cut(cat.select(key, *axes, _focal(cat).alias("_f")).mapInPandas(score, f"{key} {kind}, score double, _f boolean"))
    top = scored.agg(F.percentile("score", F.lit(1 - contamination)).alias("_t"))
    return scored.crossJoin(F.broadcast(top)).select(key, "score", ((F.col("score") > F.col("_t")) & ~F.col("_f")).alias("outlier"))
