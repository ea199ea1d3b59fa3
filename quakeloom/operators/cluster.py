"""Density clustering on grid joins, catalog segmentation, and measures of clusters."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import distances
from .graph import connected_components
from .lineage import cut, numbered
from .neighbors import d2, grid_pairs


def _norm(gaps: list[Column], metric: str) -> Column:
    if metric == "manhattan":
        return sum(gaps[1:], gaps[0])
    if metric == "chebyshev":
        return F.greatest(*gaps) if len(gaps) > 1 else gaps[0]
    return F.sqrt(sum((g * g for g in gaps), F.lit(0.0)))


def _distance(axes: tuple[str, ...], metric: str) -> Column:
    return _norm([F.abs(F.col(f"j_{c}") - F.col(f"i_{c}")) for c in axes], metric)


def _number(roots: DataFrame, on: tuple[str, ...]) -> DataFrame:
    """(root, *on, label): labels 0, 1, ... of the clusters by their smallest key, starting anew for each value of `on`."""
    every = numbered(roots.select(*on, "root").distinct(), (*on, "root"), "_no")
    if not on:
        return every.select("root", (F.col("_no") - 1).cast("int").alias("label"))
    first = every.groupBy(*on).agg(F.min("_no").alias("_first"))
    return every.join(first, list(on)).select("root", *on, (F.col("_no") - F.col("_first")).cast("int").alias("label"))


def _core_roots(core: DataFrame, axes: tuple[str, ...], eps: float, fine: float, on: tuple[str, ...], metric: str) -> DataFrame:
    """(node, root): the components of the nodes of core rows (*axes, *on, _node; a node's rows lie in one cell of edge `fine`).

    Nodes are compared by the boxes around their rows. Boxes wholly within eps are linked, boxes over eps apart are not. Of the
    other pairs of boxes, first one row of each third of a node's cell is compared, so at most 3 ** axes rows a node however
    many it has, which joins most; then all rows, only for the pairs that are still not in one component. In both turns
    only rows within eps of the other box are compared.
    """
    sides = [x for c in axes for x in (f"_lo_{c}", f"_hi_{c}")]
    nodes = cut(core.groupBy("_node", *on).agg(*(f(c).alias(n) for c in axes for f, n in ((F.min, f"_lo_{c}"), (F.max, f"_hi_{c}")))))
    at = lambda p, x: F.col(f"{p}_{x}")
    apart = [F.greatest(at("j", f"_lo_{c}") - at("i", f"_hi_{c}"), at("i", f"_lo_{c}") - at("j", f"_hi_{c}"), F.lit(0.0)) for c in axes]
    reach = [F.greatest(at("j", f"_hi_{c}") - at("i", f"_lo_{c}"), at("i", f"_hi_{c}") - at("j", f"_lo_{c}")) for c in axes]
    pairs = grid_pairs(nodes, nodes, tuple(f"_lo_{c}" for c in axes), eps + fine, on).filter((F.col("i__node") < F.col("j__node")) & (_norm(apart, metric) <= eps))
    pairs = cut(pairs.select(*(at(p, x) for p in "ij" for x in ("_node", *sides)), (_norm(reach, metric) <= eps).alias("linked")))
    roots = connected_components(pairs.filter("linked").select(F.col("i__node").alias("a"), F.col("j__node").alias("b")))
    roots = cut(nodes.select(F.col("_node").alias("node")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    third = F.struct(*(F.floor(F.col(c) / (fine / 3)).cast("long").alias(f"t{i}") for i, c in enumerate(axes)))
    few = core.groupBy("_node", third.alias("_third")).agg(F.min(F.struct(*axes)).alias("_row")).select("_node", "_row.*")
    for rows in (few, core):
        roots = cut(_joined(pairs.filter("NOT linked"), roots, rows, axes, eps, metric))
    return roots


def _joined(pairs: DataFrame, roots: DataFrame, core: DataFrame, axes: tuple[str, ...], eps: float, metric: str) -> DataFrame:
    """roots (node, root) after the pairs of nodes of different roots are joined that have rows of `core` within eps of one another."""
    sides = [x for c in axes for x in (f"_lo_{c}", f"_hi_{c}")]
    at = lambda p, x: F.col(f"{p}_{x}")
    for p in "ij":
        pairs = pairs.join(roots.select(F.col("node").alias(f"{p}__node"), F.col("root").alias(f"{p}_root")), f"{p}__node")
    unsure = cut(pairs.filter("i_root <> j_root"))
    if unsure.isEmpty():
        return roots
    rows = []
    for p, q in ("ij", "ji"):
        mine = core.select(F.col("_node").alias(f"{p}__node"), *(F.col(c).alias(f"{p}_{c}") for c in axes))
        off = _norm([F.greatest(at(q, f"_lo_{c}") - at(p, c), at(p, c) - at(q, f"_hi_{c}"), F.lit(0.0)) for c in axes], metric)
        both = unsure.select("i__node", "j__node", f"{p}_root", *(at(q, x) for x in sides))
        rows.append(both.join(mine, f"{p}__node").filter(off <= eps).select("i__node", "j__node", f"{p}_root", *(at(p, c) for c in axes)))
    met = rows[0].join(rows[1], ["i__node", "j__node"]).filter(_distance(axes, metric) <= eps)
    top = connected_components(met.select(F.col("i_root").alias("a"), F.col("j_root").alias("b")).distinct()).select(F.col("node").alias("root"), F.col("root").alias("_top"))
    return roots.join(top, "root", "left").select("node", F.coalesce("_top", "root").alias("root"))


def dbscan(points: DataFrame, axes: tuple[str, ...], eps: float, min_samples: int, key: str = "ID", on: tuple[str, ...] = (), metric: str = "euclidean") -> DataFrame:
    """(key, *on, label, core): density clusters, -1 for noise, numbered by their smallest key; a border point takes its lowest cluster.

    Rows of a cell of edge eps / sqrt(axes) are all within eps of one another, so cells with min_samples rows are core
    at once, and the core rows of a cell are one node of the graph. Clusters are kept apart by the columns `on`.
    """
    p = points.select(key, *axes, *on)
    fine = eps / math.sqrt(len(axes)) if metric == "euclidean" else eps / (len(axes) if metric == "manhattan" else 1)
    p = p.withColumn("_cell", F.struct(*(F.floor(F.col(c) / fine).cast("long").alias(f"f{i}") for i, c in enumerate(axes)), *on))
    dense = p.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_samples).select("_cell", F.lit(True).alias("_dense"))
    p = cut(p.join(dense, "_cell", "left").withColumn("_dense", F.coalesce("_dense", F.lit(False))))
    near = _distance(axes, metric) <= eps
    few = p.filter(~F.col("_dense"))
    counts = grid_pairs(few.select(key, *axes, *on), p.select(key, *axes, *on), axes, eps, on).filter(near).groupBy(F.col(f"i_{key}").alias(key)).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_samples)
    core = p.filter("_dense").select(key, *axes, *on, "_cell").union(few.join(counts.select(key), key, "left_semi").select(key, *axes, *on, "_cell"))
    core = cut(core.join(core.groupBy("_cell").agg(F.min(key).alias("_node")), "_cell").drop("_cell"))
    roots = cut(_core_roots(core, axes, eps, fine, on, metric).withColumnRenamed("node", "_node"))
    core = core.join(roots, "_node").drop("_node")
    core = cut(core.join(_number(core, on), ["root", *on]).drop("root"))
    rest = few.join(core.select(key), key, "left_anti").select(key, *axes, *on)
    border = grid_pairs(rest, core, axes, eps, on).filter(near).groupBy(F.col(f"i_{key}").alias(key)).agg(F.min("j_label").alias("label"))
    others = rest.join(border, key, "left").select(key, *on, F.coalesce("label", F.lit(-1)).alias("label"), F.lit(False).alias("core"))
    return core.select(key, *on, "label", F.lit(True).alias("core")).union(others)


def dbscan_pairs(rows: DataFrame, pairs: DataFrame, min_samples: int, key: str = "ID", on: tuple[str, ...] = ()) -> DataFrame:
    """(key, *on, label, core) as dbscan(), over a given neighbour relation instead of places: pairs (i, j) holds both directions.

    A row with min_samples - 1 neighbours or more is core; pairs of core rows link clusters, a row next to core rows takes
    the lowest of their labels. Pairs must not link rows of different `on`. Loops don't count.
    """
    near = pairs.select("i", "j").filter("i <> j")
    p = rows.select(key, *on)
    many = near.groupBy(F.col("i").alias(key)).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_samples - 1).select(key)
    core = cut(p.join(many, key, "left_semi") if min_samples > 1 else p)
    at = lambda c: core.select(F.col(key).alias(c))
    from_core = cut(near.join(at("i"), "i", "left_semi"))
    roots = connected_components(from_core.filter("i < j").join(at("j"), "j", "left_semi").select(F.col("i").alias("a"), F.col("j").alias("b")))
    core = core.join(roots.withColumnRenamed("node", key), key, "left").withColumn("root", F.coalesce("root", key))
    core = cut(core.join(_number(core, on), ["root", *on]).drop("root"))
    rest = p.join(core.select(key), key, "left_anti")
    beside = from_core.join(core.select(F.col(key).alias("i"), "label"), "i").groupBy(F.col("j").alias(key)).agg(F.min("label").alias("label"))
    others = rest.join(beside, key, "left").select(key, *on, F.coalesce("label", F.lit(-1)).alias("label"), F.lit(False).alias("core"))
    return core.select(key, *on, "label", F.lit(True).alias("core")).union(others)


def features(cat: DataFrame, names: tuple[str, ...] = ("spatial",), dims: int = 3, window_days: float = 30.0, eps: float = 1000.0) -> tuple[DataFrame, tuple[str, ...]]:
    """cat with clustering features, and their names: places as they are, time scaled so that a window is as long as eps
    (z-score without places), magnitude as a z-score with missing ones at the mean."""
    out: list[str] = list("XYZ"[:dims]) if "spatial" in names else []
    t = F.unix_timestamp("Date").cast("double")
    mag = next((c for c in ("ML", "Mw", "MAG") if c in cat.columns), None)
    stats = [F.min(t).alias("_t0"), F.avg(t).alias("_tm"), F.stddev_samp(t).alias("_ts")] + ([F.avg(mag).alias("_mm")] if mag else [])
    df = cat.crossJoin(F.broadcast(cat.agg(*stats)))
    if "temporal" in names:
        scaled = (t - F.col("_t0")) / (window_days * 86400) * eps if "spatial" in names else (t - F.col("_tm")) / F.col("_ts")
        df = df.withColumn("time_feature", scaled)
        out.append("time_feature")
    if "magnitude" in names and mag:
        df = df.withColumn("_m", F.coalesce(F.col(mag), F.col("_mm")))
        spread = df.agg(F.avg("_m").alias("_m1"), F.stddev_pop("_m").alias("_m2"))
        df = df.crossJoin(F.broadcast(spread)).withColumn("magnitude_feature", (F.col("_m") - F.col("_m1")) / F.col("_m2"))
        out.append("magnitude_feature")
    if not out:
        raise ValueError("no known features")
    return df.drop("_t0", "_tm", "_ts", "_mm", "_m", "_m1", "_m2"), tuple(out)


def weighted(df: DataFrame, axes: tuple[str, ...], spatial_weight: float = 0.7) -> DataFrame:
    """Features times the weight of their kind: places the one, all others the rest to 1."""
    return df.withColumns({c: F.col(c) * (spatial_weight if c in "XYZ" else 1 - spatial_weight) for c in axes})


def time_windows(cat: DataFrame, days: float, key: str = "ID") -> DataFrame:
    """(key, label): the number of the event's time window; the last window, which is not whole, is -1."""
    span = int(days * 86_400_000_000)
    t = F.unix_micros("Date")
    ends = cat.agg(F.min(t).alias("_a"), F.max(t).alias("_b"))
    n = F.floor((t - F.col("_a")) / span)
    return cat.crossJoin(F.broadcast(ends)).select(key, F.when(n < F.floor((F.col("_b") - F.col("_a")) / span), n).otherwise(-1).cast("int").alias("label"))


def small_to_noise(labels: DataFrame, least: int, label: str = "label") -> DataFrame:
    """Clusters of fewer than `least` rows become noise."""
    labels = cut(labels)  # counted and read: else the clusters are found twice
    n = labels.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    return labels.join(n, label).withColumn(label, F.when(F.col("_n") < least, -1).otherwise(F.col(label))).drop("_n")


def drop_small_clusters(df: DataFrame, key: str, min_events: int = 10) -> DataFrame:
    """The cluster id becomes null where fewer than min_events rows have it."""
    n = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") < min_events).select(key, F.lit(True).alias("_small"))
    return df.join(n, key, "left").withColumn(key, F.when(F.col("_small").isNull(), F.col(key))).drop("_small")


def _ratio(*c: pd.Series) -> pd.Series:
    d = int((math.isqrt(8 * len(c) + 1) - 1) // 2)
    m = np.zeros((len(c[0]), d, d))
    for x, (i, j) in zip(c, [(i, j) for i in range(d) for j in range(i, d)], strict=True):
        m[:, i, j] = m[:, j, i] = x.to_numpy(float)
    good = np.isfinite(m).all(axis=(1, 2))
    out = np.ones(len(m))
    if good.any():
        w = np.linalg.eigvalsh(m[good])
        out[good] = np.where(w[:, 0] < 1e-10, 1.0, w[:, -1] / np.maximum(w[:, 0], 1e-10))
    return pd.Series(out)


def aspect_ratios(df: DataFrame, axes: tuple[str, ...], label: str = "label") -> DataFrame:
    """(label, n, aspect_ratio): largest over smallest eigenvalue of a cluster's covariance; 1 for single or flat clusters."""
    pairs = [(a, b) for i, a in enumerate(axes) for b in axes[i:]]
    g = df.filter(F.col(label) >= 0).groupBy(label).agg(F.count(F.lit(1)).alias("n"), *(F.covar_samp(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)))
    return g.select(label, "n", F.pandas_udf(_ratio, "double")(*(f"_{i}" for i in range(len(pairs)))).alias("aspect_ratio"))


def aspect_filter(df: DataFrame, axes: tuple[str, ...], min_ratio: float = 1.5, label: str = "label") -> DataFrame:
    """Clusters with a smaller aspect ratio become noise."""
    ratio = aspect_ratios(df, axes, label).select(label, "aspect_ratio")
    return df.join(ratio, label, "left").withColumn(label, F.when(F.col("aspect_ratio") >= min_ratio, F.col(label)).otherwise(-1)).drop("aspect_ratio")


def segment(cat: DataFrame, steps: list[dict], final: str = "keep", key: str = "ID", max_outlier_ratio: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Labels of all events, (key, sequence_label, segmentation_level), and a report per step.

    Each step (eps, min_samples, min_size, axes, outliers) clusters what the one before left: clusters of min_size or
    more become A1, A2, ... (B1, ... in the next step); the rest goes on (next_step), joins the step's smallest sequence
    (merge_smallest) or is dropped (discard). What is left at the end is Z_outliers (keep), dropped (discard), or joins
    the largest sequence (merge_largest). A step with fewer rows than min_size is not run.
    """
    left, done, report = cat, None, []
    spark = cat.sparkSession
    for i, s in enumerate(steps):
        n = left.count()
        size = s.get("min_size", 20)
        if n < size:
            break
        level, axes = chr(ord("A") + i), tuple(s.get("axes", "XYZ"))
        found = small_to_noise(dbscan(left, axes, s["eps"], s["min_samples"], key).select(key, "label"), size)
        named = numbered(found.filter("label >= 0").select("label").distinct(), ("label",), "_r")
        found = cut(found.join(named, "label", "left").select(key, F.concat(F.lit(level), F.col("_r").cast("string")).alias("sequence_label")))
        kept, rest = found.filter("sequence_label IS NOT NULL"), found.filter("sequence_label IS NULL").select(key)
        outliers = rest.count()
        ratio = outliers / n
        report.append((level, n, n - outliers, outliers, ratio, ratio <= max_outlier_ratio))
        mode = s.get("outliers", "next_step")
        if mode == "merge_smallest" and n > outliers:
            pick = pick_cluster(kept, "sequence_label", smallest=True)
            kept = kept.union(rest.crossJoin(F.broadcast(pick)).select(key, "sequence_label"))
        done = kept if done is None else done.union(kept)
        left = left.join(rest, key, "left_semi")
        if mode in ("discard", "merge_smallest"):
            left = left.limit(0)
    if done is None:
        done = cat.select(key, F.lit("").alias("sequence_label")).limit(0)
    rest = left.select(key).join(done.select(key), key, "left_anti")
    if final == "keep":
        done = done.union(rest.select(key, F.lit("Z_outliers")))
    elif final == "merge_largest":
        done = done.union(rest.crossJoin(F.broadcast(pick_cluster(done, "sequence_label"))).select(key, "sequence_label"))
    steps_df = spark.createDataFrame(report, "level string, events long, clustered long, outliers long, outlier_ratio double, accepted boolean")
    return done.withColumn("segmentation_level", F.substring("sequence_label", 1, 1)), steps_df


def pick_cluster(df: DataFrame, label: str, smallest: bool = False) -> DataFrame:
    """One row: the label with the most (or fewest) rows, the first label on ties."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    return n.orderBy(F.col("_n") if smallest else F.col("_n").desc(), label).limit(1).select(label)


def sequence_summary(events: DataFrame) -> DataFrame:
    """Per sequence: level, number, events and centroid to three decimals, by level and number."""
    g = events.groupBy("sequence_label").agg(F.count(F.lit(1)).alias("n_events"), *(F.round(F.avg(c), 3).alias(f"centroid_{c.lower()}") for c in "XYZ"))
    g = g.withColumns({"level": F.substring("sequence_label", 1, 1), "sequence_number": F.expr("try_cast(substring(sequence_label, 2) AS INT)")})
    return g.orderBy("level", F.col("sequence_number").asc_nulls_last())


def cluster_diagnostics(df: DataFrame, label: str = "label") -> DataFrame:
    """Per cluster (noise too): rows, centroid, diagonal of the box, first, last and middle time, span in days, longest axis, share of all rows."""
    t = F.unix_micros("Date")
    ext = {c: F.max(c) - F.min(c) for c in "XYZ"}
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"centroid_{c.lower()}") for c in "XYZ"), *(e.alias(f"_{c}") for c, e in ext.items()), F.min(t).alias("start_us"), F.max(t).alias("end_us"))
    total = df.agg(F.count(F.lit(1)).alias("_all"))
    g = g.crossJoin(F.broadcast(total)).withColumns({
        "diagonal": F.sqrt(F.expr("_X * _X + _Y * _Y + _Z * _Z")),
        "span_days": (F.col("end_us") - F.col("start_us")) / 86_400_000_000,
        "mid_us": F.expr("start_us + (end_us - start_us) DIV 2"),
        "elongated_axis": F.when((F.col("_X") >= F.col("_Y")) & (F.col("_X") >= F.col("_Z")), "X").when(F.col("_Y") >= F.col("_Z"), "Y").otherwise("Z"),
        "share": F.col("n") / F.col("_all"),
    })
    return g.drop("_X", "_Y", "_Z", "_all")


def _node_rows(rows: pd.DataFrame, axes: tuple[str, ...]) -> pd.DataFrame:
    """The nodes of a cluster's box, with the weights that stand for some of its rows."""
    x, w = rows[list(axes)].to_numpy(float), np.ones(len(rows))
    middle, half = (rows[[f"{p}_{a}" for a in axes]].to_numpy(float)[0] for p in "ch")
    out = pd.DataFrame(distances.nodes(middle, half), columns=list(axes))
    return out.assign(to=rows["label"].iloc[0], node=np.arange(len(out)), w=distances.at_nodes(x, w, middle, half))


def _group_distances(rows: pd.DataFrame, axes: tuple[str, ...]) -> pd.DataFrame:
    """For each of the probing rows, the summed distances to the other rows by their cluster `to`, of n rows."""
    mine, others = rows[rows["mine"]], rows[~rows["mine"]]
    if len(mine) == len(others) and rows["dest"].iloc[0] == rows["label"].iloc[0] and others["to"].iloc[0] == rows["label"].iloc[0]:
        mine, others = mine.sort_values("r"), others.sort_values("r")  # a part with itself
    x, found = mine[list(axes)].to_numpy(float), []
    for to, y in others.groupby("to", sort=False):
        place = y[list(axes)].to_numpy(float)
        alike = to == rows["label"].iloc[0] and np.array_equal(mine["r"], y["r"])
        found.append(mine[["r", "label"]].assign(to=to, s=distances.distance_sums(x, x if alike else place, y["w"].to_numpy(float)), n=y["n"].iloc[0]))
    return pd.concat(found) if found and len(mine) else pd.DataFrame({k: [] for k in ("r", "label", "to", "s", "n")})


def _nearest_clusters(s: DataFrame, axes: tuple[str, ...]) -> DataFrame:
    """(label, to, far): the clusters that may be the nearest to a row of each cluster, by sure bounds of mean distances, and the cluster itself.

    The mean distance from a row to k rows of mean squared distance v to their centre is at least the distance d to the centre and at most
    sqrt(d * d + v). far: the other cluster's box is so far away that its nodes may stand for its rows.
    """
    stats = ["n", "k", "v", "reach", "odd", *(f"{p}_{a}" for p in "mch" for a in axes)]
    i, j = (s.select(F.col("label").alias(name), *(F.col(c).alias(f"{p}_{c}") for c in stats)) for p, name in (("i", "label"), ("j", "to")))
    gap = lambda p: F.sqrt(sum(((F.col(f"i_{p}_{a}") - F.col(f"j_{p}_{a}")) * (F.col(f"i_{p}_{a}") - F.col(f"j_{p}_{a}")) for a in axes), F.lit(0.0)))
    size = lambda p: F.sqrt(sum((F.col(f"{p}_h_{a}") * F.col(f"{p}_h_{a}") for a in axes), F.lit(0.0)))
    share, wide = F.col("j_k") / F.col("j_n"), F.greatest(*(F.col(f"j_h_{a}") for a in axes), F.lit(0.0))
    between, apart = gap("m"), gap("c") - size("i") - size("j")
    known = ~F.col("i_odd") & ~F.col("j_odd")
    low = F.when(known & (F.col("j_k") > 0), share * F.greatest(between - F.col("i_reach"), F.lit(0.0))).otherwise(0.0)
    high = F.when(F.col("j_k") == 0, 0.0).when(known, share * F.sqrt(F.pow(between + F.col("i_reach"), F.lit(2.0)) + F.col("j_v"))).otherwise(float("inf"))
    far = F.coalesce((F.col("j_k") == 0) | known & (apart > 0) & (apart >= distances.FAR * wide), F.lit(False))
    met = cut(i.filter("i_k > 0").join(j, F.col("label") != F.col("to")).select("label", "to", F.coalesce(low, F.lit(0.0)).alias("low"), F.coalesce(high, F.lit(float("inf"))).alias("high"), far.alias("far")))
    least = met.groupBy("label").agg((F.min("high") * (1 + 1e-9)).alias("least"))
    own = s.filter("n > 1 AND k > 0").select("label", F.col("label").alias("to"), F.lit(False).alias("far"))
    return met.join(least, "label").filter("low <= least").select("label", "to", "far").union(own)


def _distance_sums(c: DataFrame, axes: tuple[str, ...], block: int) -> DataFrame:
    """(r, label, to, s, n): for each row of a place of c (label, *axes, r) the summed distances to its cluster and to those that may be the nearest.

    A cluster's rows are dealt into parts of about `block`; a pair of parts is a group. Where the clusters are far apart, a few nodes stand
    for the other one's rows, so a row is repeated for the parts of its own cluster and of those that touch it.
    """
    kind = dict(c.dtypes)["label"]
    placed, fine = F.expr(" AND ".join(f"`{a}` IS NOT NULL" for a in axes)), F.expr(" AND ".join(f"abs(`{a}`) < double('Infinity')" for a in axes))
    at = lambda a: F.when(fine, F.col(a))
    box = [x for a in axes for x in (F.avg(at(a)).alias(f"m_{a}"), ((F.min(at(a)) + F.max(at(a))) / 2).alias(f"c_{a}"), ((F.max(at(a)) - F.min(at(a))) / 2).alias(f"h_{a}"))]
    s = cut(c.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(placed).alias("k"), (F.count_if(placed) > F.count_if(fine)).alias("odd"), *box))
    off = sum(((F.col(a) - F.col(f"m_{a}")) * (F.col(a) - F.col(f"m_{a}")) for a in axes), F.lit(0.0))
    s = cut(s.join(c.filter(fine).join(s, "label").groupBy("label").agg(F.avg(off).alias("v"), F.sqrt(F.max(off)).alias("reach")), "label", "left").withColumn("parts", F.ceil(F.col("n") / block)))
    near = _nearest_clusters(s, axes)
    half = F.array(*(F.coalesce(F.col(f"h_{a}"), F.lit(0.0)) for a in axes))
    count = F.udf(lambda h: math.prod(distances.nodes_along(np.array(h))), "long")(half)
    near = cut(near.join(s.select(F.col("label").alias("to"), F.col("n").alias("to_n"), F.col("parts").alias("to_parts"), count.alias("nodes"), F.col("k").alias("to_k")), "to").withColumn("far", F.col("far") & ((F.col("to_k") == 0) | (F.col("nodes") < F.col("to_k")))))
    sizes = s.select("label", "parts")
    links = near.filter("far").select("label", F.col("label").alias("dest"), F.lit(0).cast("long").alias("to_parts")).distinct().union(near.filter("NOT far").select("label", F.col("to").alias("dest"), "to_parts"))
    links = cut(links.join(sizes, "label").withColumn("q", F.explode(F.when(F.col("to_parts") == 0, F.array(F.lit(-1).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("to_parts") - 1)))).drop("to_parts"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("p")
    dealt = lambda n: F.pmod(F.xxhash64("r"), F.col(n))
    c = c.filter(placed)
    mine = c.join(links, "label").select("label", dealt("parts").alias("p"), "dest", "q", F.lit(True).alias("mine"), "r", F.lit(None).cast(kind).alias("to"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("double").alias("w"), *axes)
    held = near.filter("NOT far").join(sizes, "label").select("label", every, F.col("to").alias("dest"), "to", F.col("to_n").alias("n"), "to_parts")
    plain = c.select(F.col("label").alias("to"), "r", *axes).join(held, "to").select("label", "p", "dest", dealt("to_parts").alias("q"), F.lit(False).alias("mine"), "r", "to", "n", F.lit(1.0).alias("w"), *axes)
    asked = near.filter("far AND to_k > 0").select(F.col("to").alias("label")).distinct()
    boxes = s.select("label", "parts", *(f"{p}_{a}" for p in "ch" for a in axes)).join(asked, "label")

    def node_rows(rows: pd.DataFrame) -> pd.DataFrame:
        return _node_rows(rows, axes)

    def group_distances(rows: pd.DataFrame) -> pd.DataFrame:
        return _group_distances(rows, axes)

    part = c.join(boxes, "label").withColumn("part", dealt("parts")).groupBy("label", "part").applyInPandas(node_rows, ", ".join(f"`{a}` double" for a in axes) + f", to {kind}, node int, w double")
    stand = cut(part.groupBy("to", "node").agg(F.sum("w").alias("w"), *(F.first(a).alias(a) for a in axes)))
    empty = near.filter("far AND to_k = 0").select("to").distinct().select("to", F.lit(0).alias("node"), F.lit(0.0).alias("w"), *(F.lit(0.0).alias(a) for a in axes))
    held = near.filter("far").join(sizes, "label").select("label", every, F.col("label").alias("dest"), "to", F.col("to_n").alias("n"))
    stand = stand.union(empty).join(held, "to").select("label", "p", "dest", F.lit(-1).cast("long").alias("q"), F.lit(False).alias("mine"), F.col("node").cast("long").alias("r"), "to", "n", "w", *axes)
    met = mine.union(plain).union(stand)
    return met.groupBy("label", "p", "dest", "q").applyInPandas(group_distances, f"r long, label {kind}, to {kind}, s double, n long")


def clustering_quality(df: DataFrame, axes: tuple[str, ...], label: str = "label", block: int = 524_288) -> DataFrame:
    """One row: clusters, noise share, size statistics, Calinski-Harabasz and Davies-Bouldin index, and the silhouette.

    The silhouette is that of all clustered rows. A row's distances are added up over its own cluster and those that may be the nearest to
    it, by parts of about `block` rows of either; see _distance_sums().
    """
    c = df.filter(F.col(label) >= 0).select(F.col(label).alias("label"), *axes)
    g = c.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *(F.avg(a).alias(f"m_{a}") for a in axes))
    whole = c.agg(F.count(F.lit(1)).alias("rows"), *(F.avg(a).alias(f"w_{a}") for a in axes))
    d = c.join(g, "label").crossJoin(F.broadcast(whole))
    sq = lambda p, q: sum(((F.col(f"{p}{a}") - F.col(f"{q}{a}")) * (F.col(f"{p}{a}") - F.col(f"{q}{a}")) for a in axes), F.lit(0.0))
    spread = d.groupBy("label").agg(F.sum(sq("", "m_")).alias("within"), F.avg(F.sqrt(sq("", "m_"))).alias("radius"), F.first(F.col("n") * sq("m_", "w_")).alias("between"))
    s = g.join(spread, "label")
    k, rows = F.count(F.lit(1)), F.sum("n")
    ch = s.agg(k.alias("n_clusters"), rows.alias("rows"), (F.sum("between") / (k - 1) / (F.sum("within") / (rows - k))).alias("calinski_harabasz"), F.avg("n").alias("size_mean"), F.stddev_pop("n").alias("size_std"), F.min("n").alias("size_min"), F.max("n").alias("size_max"))
    one, two = s.select(*(F.col(x).alias(f"i_{x}") for x in ("label", "radius", *(f"m_{a}" for a in axes)))), s.select(*(F.col(x).alias(f"j_{x}") for x in ("label", "radius", *(f"m_{a}" for a in axes))))
    gap = F.sqrt(sum(((F.col(f"i_m_{a}") - F.col(f"j_m_{a}")) * (F.col(f"i_m_{a}") - F.col(f"j_m_{a}")) for a in axes), F.lit(0.0)))
    worst = one.join(two, F.col("i_label") != F.col("j_label")).groupBy("i_label").agg(F.max((F.col("i_radius") + F.col("j_radius")) / gap).alias("w"))
    noise = df.agg(F.avg((F.col(label) < 0).cast("double")).alias("noise_ratio"))
    out = ch.crossJoin(worst.agg(F.avg("w").alias("davies_bouldin"))).crossJoin(noise)
    c = cut(c.withColumns({a: F.col(a).cast("double") for a in axes} | {"r": F.monotonically_increasing_id()}))
    sums = _distance_sums(c, axes, block)
    mean = sums.groupBy("r", "label", "to").agg(F.sum("s").alias("s"), F.first("n").alias("n"))
    own = F.max(F.when((F.col("label") == F.col("to")) & (F.col("n") > 1), F.col("s") / (F.col("n") - 1))).alias("a")
    other = F.min(F.when(F.col("label") != F.col("to"), F.col("s") / F.col("n"))).alias("b")
    value = F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0))
    total = mean.groupBy("r").agg(own, other).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("_sum"))  # rows without a place count as 0
    return out.crossJoin(total).withColumn("silhouette", F.col("_sum") / F.col("rows")).drop("rows", "_sum")


def _cell_bounds(rows: pd.DataFrame, cells: pd.DataFrame, axes: tuple[str, ...], tile: int = 128) -> pd.DataFrame:
    """The sums of the bounds of the silhouettes of one cell's rows, and their number, from the cells of the clusters near them."""
    if rows.empty:
        return pd.DataFrame({"low": [], "high": [], "n": []})
    cells = cells.sort_values("to")
    to, k, v = cells["to"].to_numpy(), cells["k"].to_numpy(float), cells["v"].fillna(0.0).to_numpy(float)
    at = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
    own = cells["own"].to_numpy(bool)[at]
    void = cells[[f"o_{a}" for a in axes]].isna().to_numpy().any(axis=1)
    known, size = np.add.reduceat(~void, at) > 0, np.add.reduceat(k, at)
    k = np.where(void, 0.0, k)
    n, total = int(rows["n"].iloc[0]), [0.0, 0.0]
    good = rows[list(axes)].dropna().to_numpy(float)
    if n < 2 or not (known & ~own).any():  # alone, or no other cluster: all count as 0
        return pd.DataFrame({"low": [0.0], "high": [0.0], "n": [len(rows)]})
    for i in range(0, len(good), tile):
        e2 = np.zeros((len(good[i : i + tile]), len(k)))
        for x, a in enumerate(axes):
            e = np.subtract.outer(good[i : i + tile, x], np.where(void, 0.0, cells[f"o_{a}"].to_numpy(float)))
            e *= e
            e2 += e
        low, high = (np.add.reduceat(np.sqrt(x) * k, at, axis=1) for x in (e2, e2 + v))
        a = [(x[:, own] / (n - 1))[:, 0] for x in (low, high)]
        b = [(x / size)[:, known & ~own].min(axis=1) for x in (low, high)]
        for j, (p, q) in enumerate(((a[1], b[0]), (a[0], b[1]))):
            most = np.maximum(p, q)
            total[j] += float(np.where(most > 0, (q - p) / np.where(most > 0, most, 1.0), 0.0).sum())
    return pd.DataFrame({"low": [total[0]], "high": [total[1]], "n": [len(rows)]})


def silhouette_bounds(df: DataFrame, axes: tuple[str, ...], label: str = "label", detail: int = 12, block: int = 16_384) -> DataFrame:
    """One row, silhouette, silhouette_low and silhouette_high: the mean silhouette of the clustered rows between sure bounds.

    A cluster is cut into cells, `detail` along its longest side. The mean distance from a row to a cell's rows is at least the
    distance d to their centre and at most sqrt(d * d + v), v their mean squared distance to it; so it needs no pair of rows, and
    cells of one row are exact. Clusters that can't be the nearest to any row of a cell are left out by the same bounds for
    whole clusters. Rows of a cell, at most about `block` a group, are held in vectors against the cells that its bounds leave. Work
    grows with rows times cells of a cluster. A finer `detail` narrows the bounds. Rows of
    clusters of one row count as 0, as do all rows if there is one cluster; without clusters the result is null.
    """
    c = df.filter(F.col(label) >= 0).select(F.col(label).alias("label"), *axes).withColumn("r", F.monotonically_increasing_id())
    box = c.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *(F.min(a).alias(f"lo_{a}") for a in axes), F.greatest(*(F.max(a) - F.min(a) for a in axes), F.lit(0.0)).alias("wide"))
    box = box.withColumn("edge", F.when(F.col("wide") > 0, F.col("wide") / detail).otherwise(1.0)).drop("wide")
    rel = {a: F.col(a) - F.col(f"lo_{a}") for a in axes}
    c = cut(c.join(box, "label").withColumn("cell", F.struct(*(F.floor(x / F.col("edge")).alias(f"c{i}") for i, x in enumerate(rel.values())))))
    mean = [F.avg(x).alias(f"m_{a}") for a, x in rel.items()]
    spread = F.greatest(sum((F.avg(x * x) - F.avg(x) * F.avg(x) for x in rel.values()), F.lit(0.0)), F.lit(0.0)).alias("v")

    def groups(*by: str) -> DataFrame:
        g = c.groupBy("label", *by).agg(F.count(F.lit(1)).alias("k"), F.first("edge").alias("edge"), *mean, *(F.first(f"lo_{a}").alias(f"lo_{a}") for a in axes), spread)
        return cut(g.select("label", *by, "k", "edge", *((F.col(f"m_{a}") + F.col(f"lo_{a}")).alias(f"m_{a}") for a in axes), F.when(F.col("k") > 1, F.col("v")).otherwise(0.0).alias("v")))

    cells_, whole = cut(groups("cell").withColumns({"id": F.monotonically_increasing_id(), "parts": F.ceil(F.col("k") / block)})), groups()
    gap = lambda p, q: F.sqrt(sum(((F.col(f"{p}{a}") - F.col(f"{q}{a}")) * (F.col(f"{p}{a}") - F.col(f"{q}{a}")) for a in axes), F.lit(0.0)))
    other = whole.select(F.col("label").alias("to"), F.col("v").alias("w"), *(F.col(f"m_{a}").alias(f"o_{a}") for a in axes))
    d, reach = gap("m_", "o_"), F.col("edge") * math.sqrt(len(axes))  # no row of a cell is farther from its centre
    near = cells_.join(other, F.col("label") != F.col("to")).withColumns({"low": d - reach, "high": F.sqrt(d * d + F.col("w")) + reach}).select("id", "parts", "to", "low", "high")
    near = cut(near)
    least = near.groupBy("id").agg(F.min("high").alias("least"))
    own = cells_.select("id", "parts", F.col("label").alias("to"), F.lit(True).alias("own"))
    near = near.join(least, "id").filter("low <= least").select("id", "parts", "to", F.lit(False).alias("own")).union(own)
    held = cells_.select(F.col("label").alias("to"), "k", "v", *(F.col(f"m_{a}").alias(f"o_{a}") for a in axes))
    met = near.join(held, "to").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select("id", "part", F.dense_rank().over(Window.partitionBy("id", "part").orderBy("to")).alias("to"), "own", "k", "v", *(f"o_{a}" for a in axes))
    mine = c.join(cells_.select("label", "cell", "id", "parts"), ["label", "cell"]).select("id", F.pmod(F.xxhash64("r"), "parts").alias("part"), "n", *axes)

    def cell_bounds(rows: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        return _cell_bounds(rows, cells, axes)

    sums = mine.groupBy("id", "part").cogroup(met.groupBy("id", "part")).applyInPandas(cell_bounds, "low double, high double, n long")
    out = sums.agg((F.sum("low") / F.sum("n")).alias("silhouette_low"), (F.sum("high") / F.sum("n")).alias("silhouette_high"))
    return out.select(((F.col("silhouette_low") + F.col("silhouette_high")) / 2).alias("silhouette"), "silhouette_low", "silhouette_high")


def majority_label(points: DataFrame, source: str, label: str = "label", order: str = "point") -> DataFrame:
    """(source, label): the most frequent label of a plane's points other than noise, the first seen on ties, -1 if all are noise."""
    n = points.filter(F.col(label) >= 0).groupBy(source, label).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_o"))
    best = n.groupBy(source).agg(F.min_by(label, F.struct(-F.col("_n"), F.col("_o"))).alias(label))
    return points.select(source).distinct().join(best, source, "left").withColumn(label, F.coalesce(label, F.lit(-1)))


def density_ladder(points: DataFrame, axes: tuple[str, ...], levels: list[float], k: int = 5, key: str = "ID") -> DataFrame:
    """(key, eps, label): clusters of the mutual-reachability graph at each eps of a ladder; noise -1.

    A row's core distance is that to its k-th neighbour; two rows are linked at the largest of their distance and their
    core distances. So two rows are linked at eps where they are within eps and both have k others within it, and the clusters
    are DBSCAN's core rows with k + 1 rows. No pairs of rows are kept.
    """
    p = points.select(key, *axes)
    placed = p.filter(" AND ".join(f"`{c}` IS NOT NULL AND NOT isnan(`{c}`)" for c in axes))
    out = None
    for eps in levels:
        live = dbscan(placed, axes, eps, k + 1, key).filter("core").select(key, "label")
        lab = p.select(key).join(live, key, "left").select(key, F.lit(float(eps)).alias("eps"), F.coalesce("label", F.lit(-1)).alias("label"))
        out = lab if out is None else out.union(lab)
    return out


def subcluster_benefit(df: DataFrame, label: str, min_points: int) -> DataFrame:
    """One row, beneficial: at least two clusters of min_points, whose nearest centres are over a tenth of the data's extent apart and
    whose sizes are within a factor of five."""
    g = df.filter(F.col(label) >= 0).groupBy(label).agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for c in "XYZ")).filter(F.col("n") >= min_points)
    i, j = (g.select(*(F.col(c).alias(f"{p}_{c}") for c in (label, *"XYZ"))) for p in "ij")
    gap = i.join(j, F.col(f"i_{label}") < F.col(f"j_{label}")).agg(F.min(F.sqrt(d2(tuple("XYZ")))).alias("gap"))
    size = g.agg(F.count(F.lit(1)).alias("k"), (F.min("n") / F.max("n")).alias("balance"))
    ext = df.agg(F.greatest(*(F.max(c) - F.min(c) for c in "XYZ")).alias("extent"))
    ok = (F.col("k") >= 2) & (F.col("gap") > 0.1 * F.col("extent")) & (F.col("balance") > 0.2)
    return size.crossJoin(gap).crossJoin(ext).select(F.coalesce(ok, F.lit(False)).alias("beneficial"))
