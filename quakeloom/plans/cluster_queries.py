"""Registered queries: density clustering, segmentation, outliers, and measures of clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cluster, discs, hierarchy, outliers, reachability, subclusters
from ..operators.lineage import numbered
from ..operators.neighbors import XYZ
from ..sources import derived
from .plane_queries import AXES, DISC, disc_planes
from .register import Book

book = Book()
QUERIES, ORACLE_SQL = book.queries, book.sql
EPS, MIN = 150.0, 8

_D2 = "(b.X - a.X) * (b.X - a.X) + (b.Y - a.Y) * (b.Y - a.Y) + (b.Z - a.Z) * (b.Z - a.Z)"


def grid_cte(eps: float, extra: str = "") -> str:
    """e: pairs within eps, by cells."""
    cell = ", ".join(f"floor({c} / {eps}) AS c{c}" for c in XYZ)
    return f"""gc AS (SELECT eid, X, Y, Z, {cell}{extra} FROM cat), ga AS (SELECT *, unnest([cX - 1, cX, cX + 1]) AS pX FROM gc), gb AS (SELECT *, unnest([cY - 1, cY, cY + 1]) AS pY FROM ga), gd AS (SELECT *, unnest([cZ - 1, cZ, cZ + 1]) AS pZ FROM gb),
    e AS MATERIALIZED (SELECT a.eid AS i, b.eid AS j, sqrt({_D2}) AS d FROM gd a JOIN gc b ON b.cX = a.pX AND b.cY = a.pY AND b.cZ = a.pZ WHERE {_D2} <= {eps * eps})"""


#: Connected components of the edges (i, j) of `core_e` by a closure over reachable smallest nodes, then DBSCAN's labels.
DBSCAN = f"""{grid_cte(EPS)}, co AS MATERIALIZED (SELECT i FROM e GROUP BY i HAVING count(*) >= {MIN}), ce AS MATERIALIZED (SELECT i, j FROM e WHERE i IN (SELECT i FROM co) AND j IN (SELECT i FROM co)),
    reach AS (SELECT i AS n, i AS r FROM co UNION SELECT ce.j, reach.r FROM reach JOIN ce ON ce.i = reach.n),
    ro AS (SELECT n, min(r) AS root FROM reach GROUP BY n), nu AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS label FROM (SELECT DISTINCT root FROM ro)),
    cl AS (SELECT n AS eid, label, true AS core FROM ro JOIN nu USING (root)),
    db AS (SELECT * FROM cl UNION ALL SELECT c.eid, coalesce(b.label, -1) AS label, false AS core FROM cat c LEFT JOIN (SELECT e.i, min(cl.label) AS label FROM e JOIN cl ON cl.eid = e.j GROUP BY e.i) b ON b.i = c.eid WHERE c.eid NOT IN (SELECT i FROM co))"""


def labels(spark, d):
    return cluster.dbscan(derived.catalog(spark, d), XYZ, EPS, MIN, "eid")


def labelled(spark, d):
    return derived.catalog(spark, d).join(labels(spark, d).select("eid", "label"), "eid")


book.add("c1_dbscan", "SELECT eid, CAST(label AS INT) AS label, core FROM db", DBSCAN, recursive=True)(lambda s, d: labels(s, d))
book.add("d2_small_to_noise", "SELECT eid, CAST(CASE WHEN n < 60 THEN -1 ELSE label END AS INT) AS label FROM (SELECT *, count(*) OVER (PARTITION BY label) AS n FROM db)", DBSCAN, recursive=True)(
    lambda s, d: cluster.small_to_noise(labels(s, d).select("eid", "label"), 60).select("eid", "label"))
_TF = "(floor(epoch(Date)) - (SELECT floor(epoch(min(Date))) FROM cat)) / (30 * 86400) * 1000"
book.add("c2_features", f"""SELECT ID, round({_TF}, 6) AS time_feature, round((MAG - (SELECT avg(MAG) FROM cat)) / (SELECT stddev_pop(MAG) FROM cat), 6) + 0.0 AS magnitude_feature, round((floor(epoch(Date)) - (SELECT avg(floor(epoch(Date))) FROM cat)) / (SELECT stddev_samp(floor(epoch(Date))) FROM cat), 5) + 0.0 AS z_time FROM cat""")(
    lambda s, d: _features(s, d))


def _features(spark, d):
    cat = derived.catalog(spark, d)
    df, _ = cluster.features(cat, ("spatial", "temporal", "magnitude"))
    z, _ = cluster.features(cat, ("temporal",))
    a = df.select("ID", F.round("time_feature", 6).alias("time_feature"), (F.round("magnitude_feature", 6) + 0.0).alias("magnitude_feature"))
    return a.join(z.select("ID", (F.round("time_feature", 5) + 0.0).alias("z_time")), "ID")


@book.add("c3_weighted_dbscan", "SELECT eid, CAST(label AS INT) AS label FROM db", DBSCAN, recursive=True)
def _c3(spark, d):
    """Weighted places alone: the weight scales the axes and eps alike."""
    df = cluster.weighted(derived.catalog(spark, d), XYZ, 0.5)
    return cluster.dbscan(df, XYZ, EPS / 2, MIN, "eid").select("eid", "label")


@book.add("c3_space_time_dbscan")
def _c3t(spark, d):
    df, axes = cluster.features(derived.catalog(spark, d), ("spatial", "temporal"), eps=EPS)
    return cluster.dbscan(cluster.weighted(df, axes, 0.7), axes, EPS, MIN, "eid").select("eid", "label")


book.add("c4_time_windows", """SELECT ID, CAST(CASE WHEN n < (SELECT floor((epoch_us(max(Date)) - epoch_us(min(Date))) / (86400000000 * 5)) FROM cat) THEN n ELSE -1 END AS INT) AS label FROM (SELECT ID, floor((epoch_us(Date) - (SELECT epoch_us(min(Date)) FROM cat)) / (86400000000 * 5)) AS n FROM cat)""")(
    lambda s, d: cluster.time_windows(derived.catalog(s, d), 5))
_PAT = "pt AS (SELECT eid, X, Y, Z, Date, CASE WHEN eid % 17 = 0 THEN -1 ELSE CAST(eid % 40 AS INT) END AS label FROM cat)"


def _patches(spark, d):
    return derived.catalog(spark, d).selectExpr("eid", "ID", "X", "Y", "Z", "Date", "CASE WHEN eid % 17 = 0 THEN -1 ELSE CAST(eid % 40 AS INT) END AS label")


_R2 = "SELECT label, count(*) AS n, covar_samp(X, X) AS a, covar_samp(X, Y) AS b, covar_samp(Y, Y) AS c FROM pt WHERE label >= 0 GROUP BY label"
_RATIO = "CASE WHEN (a + c) / 2 - sqrt((a - c) * (a - c) / 4 + b * b) < 1e-10 THEN 1 ELSE ((a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b)) / ((a + c) / 2 - sqrt((a - c) * (a - c) / 4 + b * b)) END"
book.add("a7_aspect_ratio", f"SELECT label, n, round({_RATIO}, 3) AS aspect_ratio FROM ({_R2})", _PAT)(lambda s, d: cluster.aspect_ratios(_patches(s, d), ("X", "Y")).select("label", "n", F.round("aspect_ratio", 3).alias("aspect_ratio")))
book.add("c5_aspect_filter", f"SELECT eid, CASE WHEN r >= 1500 THEN label ELSE -1 END AS label FROM (SELECT pt.eid, pt.label, r FROM pt LEFT JOIN (SELECT label, {_RATIO} AS r FROM ({_R2})) USING (label))", _PAT)(
    lambda s, d: cluster.aspect_filter(_patches(s, d), ("X", "Y"), 1500.0).select("eid", "label"))
book.add("a8_cluster_diagnostics", """SELECT label, count(*) AS n, round(avg(X), 4) AS centroid_x, round(avg(Y), 4) AS centroid_y, round(avg(Z), 4) AS centroid_z, round(sqrt(pow(max(X) - min(X), 2) + pow(max(Y) - min(Y), 2) + pow(max(Z) - min(Z), 2)), 4) AS diagonal,
    epoch_us(min(Date)) AS start_us, epoch_us(max(Date)) AS end_us, epoch_us(min(Date)) + (epoch_us(max(Date)) - epoch_us(min(Date))) // 2 AS mid_us, round((epoch_us(max(Date)) - epoch_us(min(Date))) / 86400000000, 6) AS span_days, round(count(*) / (SELECT count(*) FROM pt), 6) AS share,
    CASE WHEN max(X) - min(X) >= max(Y) - min(Y) AND max(X) - min(X) >= max(Z) - min(Z) THEN 'X' WHEN max(Y) - min(Y) >= max(Z) - min(Z) THEN 'Y' ELSE 'Z' END AS elongated_axis FROM pt GROUP BY label""", _PAT)(
    lambda s, d: (g := cluster.cluster_diagnostics(_patches(s, d))).select(*(F.round(c, 4 if c.startswith(("cen", "diag")) else 6).alias(c) if k == "double" else F.col(c) for c, k in g.dtypes)))
_QS = "qs AS (SELECT label, X, Y, Z FROM pt)"
book.add("a9_clustering_quality", """SELECT (SELECT count(DISTINCT label) FROM qs WHERE label >= 0) AS n_clusters, round((SELECT avg((label < 0)::INT) FROM qs), 6) AS noise_ratio, round((SELECT avg(n) FROM m), 6) AS size_mean, round((SELECT stddev_pop(n) FROM m), 6) AS size_std,
    (SELECT min(n) FROM m) AS size_min, (SELECT max(n) FROM m) AS size_max, round((SELECT sum(n * (pow(mx - (SELECT avg(X) FROM qc), 2) + pow(my - (SELECT avg(Y) FROM qc), 2) + pow(mz - (SELECT avg(Z) FROM qc), 2))) / (count(*) - 1) FROM m) / (SELECT sum(w) / (sum(n) - count(*)) FROM sp), 3) AS calinski_harabasz,
    round((SELECT avg(v) FROM (SELECT max((a.rad + b.rad) / sqrt(pow(a.mx - b.mx, 2) + pow(a.my - b.my, 2) + pow(a.mz - b.mz, 2))) AS v FROM sp a JOIN sp b ON a.label <> b.label GROUP BY a.label)), 6) AS davies_bouldin,
    round((SELECT avg(CASE WHEN greatest(a, b) = 0 OR a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) FROM (SELECT r, max(s / nullif(n - 1, 0)) FILTER (li = lj) AS a, min(s / n) FILTER (li <> lj) AS b FROM (SELECT p.rowid_ AS r, p.label AS li, q.label AS lj, count(*) AS n, sum(sqrt(pow(p.X - q.X, 2) + pow(p.Y - q.Y, 2) + pow(p.Z - q.Z, 2))) AS s
    FROM qn p, qn q GROUP BY 1, 2, 3) GROUP BY r)), 6) AS silhouette""", f"{_PAT}, {_QS}, qc AS (SELECT * FROM qs WHERE label >= 0), qn AS (SELECT *, row_number() OVER () AS rowid_ FROM qc), m AS (SELECT label, count(*) AS n, avg(X) AS mx, avg(Y) AS my, avg(Z) AS mz FROM qc GROUP BY label), sp AS (SELECT label, any_value(m.n) AS n, any_value(mx) AS mx, any_value(my) AS my, any_value(mz) AS mz, sum(pow(X - mx, 2) + pow(Y - my, 2) + pow(Z - mz, 2)) AS w, avg(sqrt(pow(X - mx, 2) + pow(Y - my, 2) + pow(Z - mz, 2))) AS rad FROM qc JOIN m USING (label) GROUP BY label)")(
    lambda s, d: (g := cluster.clustering_quality(_patches(s, d), XYZ)).select(*(F.round(c, 3 if c.startswith("cal") else 6).alias(c) if k == "double" else F.col(c) for c, k in g.dtypes)))
_MV = "mv AS (SELECT fault_id AS source, eid AS point, CASE WHEN eid % 3 = 0 THEN -1 ELSE CAST(eid % 7 AS INT) END AS label FROM hyp WHERE fault_id IS NOT NULL)"
book.add("a10_majority_label", "SELECT s.source, coalesce(b.label, -1) AS label FROM (SELECT DISTINCT source FROM mv) s LEFT JOIN (SELECT source, label FROM (SELECT source, label, count(*) AS n, min(point) AS o FROM mv WHERE label >= 0 GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, o) = 1) b USING (source)", _MV)(
    lambda s, d: cluster.majority_label(derived.hypocenters(s, d).filter("fault_id IS NOT NULL").selectExpr("fault_id AS source", "eid AS point", "CASE WHEN eid % 3 = 0 THEN -1 ELSE CAST(eid % 7 AS INT) END AS label"), "source"))
book.add("a12_segmentation_summary", "SELECT sequence_label, count(*) AS n_events, round(avg(X), 3) AS centroid_x, round(avg(Y), 3) AS centroid_y, round(avg(Z), 3) AS centroid_z, sequence_label[1] AS level, TRY_CAST(sequence_label[2:] AS INT) AS sequence_number FROM hyp GROUP BY sequence_label")(
    lambda s, d: cluster.sequence_summary(derived.hypocenters(s, d)))
_W = "SELECT label, n FROM (SELECT label, count(*) AS n FROM db WHERE label >= 0 GROUP BY label)"
book.add("w3_cluster_renumbering", f"SELECT label, 'A' || row_number() OVER (ORDER BY label) AS sequence_label FROM ({_W}) WHERE n >= 30", DBSCAN, recursive=True)(
    lambda s, d: _renumbered(s, d))


def _renumbered(spark, d):
    kept = labels(spark, d).filter("label >= 0").groupBy("label").count().filter("count >= 30")
    return numbered(kept.select("label"), ("label",), "no").select("label", F.concat(F.lit("A"), F.col("no").cast("string")).alias("sequence_label"))


book.add("w7_largest_cluster", "SELECT label FROM (SELECT label, count(*) AS n FROM pt WHERE label >= 0 GROUP BY label) ORDER BY n DESC, label LIMIT 1", _PAT)(lambda s, d: cluster.pick_cluster(_patches(s, d).filter("label >= 0"), "label"))
book.add("c6_segmentation", f"""SELECT eid, CASE WHEN a.r IS NOT NULL THEN 'A' || a.r ELSE 'Z_outliers' END AS sequence_label, CASE WHEN a.r IS NOT NULL THEN 'A' ELSE 'Z' END AS segmentation_level FROM db LEFT JOIN (SELECT label, row_number() OVER (ORDER BY label) AS r FROM ({_W}) WHERE n >= 40) a USING (label)""", DBSCAN, recursive=True)(
    lambda s, d: cluster.segment(derived.catalog(s, d), [{"eps": EPS, "min_samples": MIN, "min_size": 40}], key="eid")[0])


@book.add("c6_two_step_report")
def _c6(spark, d):
    steps = [{"eps": EPS, "min_samples": MIN, "min_size": 40}, {"eps": 2 * EPS, "min_samples": MIN, "min_size": 20, "outliers": "merge_smallest"}]
    return cluster.segment(derived.catalog(spark, d), steps, "merge_largest", "eid")[1]


_LAD = f"""{grid_cte(150.0)}, kd AS MATERIALIZED (SELECT i, d AS core FROM e WHERE i <> j QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) = 5), w AS MATERIALIZED (SELECT e.i, e.j, greatest(d, a.core, b.core) AS w FROM e JOIN kd a ON a.i = e.i JOIN kd b ON b.i = e.j WHERE e.i <> e.j),
    lv AS (SELECT unnest([80.0, 150.0])::DOUBLE AS eps), reach AS (SELECT eps, i AS n, i AS r FROM kd, lv WHERE core <= eps UNION SELECT reach.eps, w.j, reach.r FROM reach JOIN w ON w.i = reach.n AND w.w <= reach.eps),
    ro AS (SELECT eps, n, min(r) AS root FROM reach GROUP BY 1, 2), nu AS (SELECT eps, root, row_number() OVER (PARTITION BY eps ORDER BY root) - 1 AS label FROM (SELECT DISTINCT eps, root FROM ro))"""
book.add("c7_density_ladder", "SELECT c.eid, lv.eps, CAST(coalesce(x.label, -1) AS INT) AS label FROM cat c CROSS JOIN lv LEFT JOIN (SELECT ro.n, ro.eps, label FROM ro JOIN nu USING (eps, root)) x ON x.n = c.eid AND x.eps = lv.eps", _LAD, recursive=True)(
    lambda s, d: cluster.density_ladder(derived.catalog(s, d), XYZ, [80.0, 150.0], 5, "eid"))


#: DBSCAN at 1.5 times the 75th percentile of the distance to the fifth neighbour.
_C8 = f"""k5 AS MATERIALIZED (SELECT sqrt({_D2}) AS d FROM cat a JOIN cat b ON a.eid <> b.eid QUALIFY row_number() OVER (PARTITION BY a.eid ORDER BY {_D2}, b.eid) = 5), ep AS MATERIALIZED (SELECT 1.5 * quantile_cont(d, 0.75) AS eps FROM k5),
    e AS MATERIALIZED (SELECT a.eid AS i, b.eid AS j FROM cat a JOIN cat b ON sqrt({_D2}) <= (SELECT eps FROM ep)), {DBSCAN[DBSCAN.index("co AS MATERIALIZED"):].replace(f">= {MIN})", ">= 5)", 1)}, tp AS (SELECT coalesce((SELECT label FROM db WHERE label >= 0 GROUP BY label ORDER BY count(*) DESC, label LIMIT 1), 0) AS top)"""


@book.add("c8_dbscan_outliers", "SELECT eid, CAST(CASE WHEN label < 0 AND eid % 25 = 0 THEN top ELSE label END AS INT) AS label, label < 0 AND eid % 25 <> 0 AS outlier FROM db, tp", _C8, recursive=True)
def _c8(spark, d):
    return outliers.flag_outliers_dbscan(derived.catalog(spark, d).withColumn("A", F.expr("if(eid % 25 = 0, 1, NULL)")), key="eid")


_KN = f"kn AS MATERIALIZED (SELECT a.eid AS i, b.eid AS j, sqrt({_D2}) AS d FROM cat a JOIN cat b ON a.eid <> b.eid QUALIFY row_number() OVER (PARTITION BY a.eid ORDER BY {_D2}, b.eid) <= 10)"
book.add("c9_lof", "SELECT n.i AS eid, round(avg(l2.lrd) / any_value(l1.lrd), 6) AS lof FROM kn n JOIN lr l1 ON l1.i = n.i JOIN lr l2 ON l2.i = n.j GROUP BY n.i", f"{_KN}, kd AS (SELECT i, max(d) AS kd FROM kn GROUP BY i), lr AS MATERIALIZED (SELECT kn.i, 1 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM kn JOIN kd ON kd.i = kn.j GROUP BY kn.i)")(
    lambda s, d: outliers.local_outlier_factor(derived.catalog(s, d), 10, "eid").select("eid", F.round("lof", 6).alias("lof")))


@book.add("c10_isolation_forest")
def _c10(spark, d):
    return outliers.flag_outliers_iforest(derived.catalog(spark, d), key="eid")


@book.add("c14_spatial_subclusters", f"""SELECT eid, CAST(label AS INT) AS label FROM (SELECT ro.n AS eid, row_number() OVER (PARTITION BY o ORDER BY root) AS x, root, o FROM ro) q JOIN nu USING (root, o) UNION ALL
    SELECT c.eid, CAST(coalesce(b.label, -1) AS INT) FROM cat c LEFT JOIN (SELECT e.i, min(nu.label) AS label FROM e JOIN ro ON ro.n = e.j JOIN nu USING (root, o) WHERE e.i % 5 = e.j % 5 GROUP BY e.i) b ON b.i = c.eid WHERE c.eid NOT IN (SELECT i FROM co)""",
    f"""{grid_cte(EPS)}, co AS MATERIALIZED (SELECT i FROM e WHERE i % 5 = j % 5 GROUP BY i HAVING count(*) >= {MIN}), ce AS MATERIALIZED (SELECT i, j FROM e WHERE i % 5 = j % 5 AND i IN (SELECT i FROM co) AND j IN (SELECT i FROM co)),
    reach AS (SELECT i AS n, i AS r FROM co UNION SELECT ce.j, reach.r FROM reach JOIN ce ON ce.i = reach.n), ro AS (SELECT n, min(r) AS root, n % 5 AS o FROM reach GROUP BY n), nu AS (SELECT root, o, row_number() OVER (PARTITION BY o ORDER BY root) - 1 AS label FROM (SELECT DISTINCT root, o FROM ro))""", recursive=True)  # fmt: skip
def _c14(spark, d):
    """Clusters within each of five orientation classes, all in one job."""
    return cluster.dbscan(derived.catalog(spark, d).withColumn("orient", F.col("eid") % 5), XYZ, EPS, MIN, "eid", ("orient",)).select("eid", "label")


book.add("c16_small_clusters_dropped", "SELECT eid, CASE WHEN count(*) OVER (PARTITION BY label) >= 240 THEN label END AS label FROM pt", _PAT)(lambda s, d: cluster.drop_small_clusters(_patches(s, d), "label", 240).select("eid", "label"))
book.add("c17_subcluster_benefit", """SELECT coalesce(count(*) >= 2 AND (SELECT min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))) FROM c a JOIN c b ON a.label < b.label) > 0.1 * (SELECT greatest(max(X) - min(X), max(Y) - min(Y), max(Z) - min(Z)) FROM pt) AND min(n) / max(n) > 0.2, false) AS beneficial FROM c""",
    f"{_PAT}, c AS (SELECT label, count(*) AS n, avg(X) AS x, avg(Y) AS y, avg(Z) AS z FROM pt WHERE label >= 0 GROUP BY label HAVING count(*) >= 5)")(lambda s, d: cluster.subcluster_benefit(_patches(s, d), "label", 5))


@book.add("c7_hdbscan")
def _c7h(spark, d):
    """Clusters of all densities of the catalog, by stability; tests hold the operator against a plain condensation."""
    return hierarchy.hdbscan(derived.catalog(spark, d), XYZ, 15, key="eid")


@book.add("c7_optics")
def _c7o(spark, d):
    """Reachability order of the catalog and the clusters of its steep areas; tests hold both against plain versions."""
    found = reachability.optics(derived.catalog(spark, d), XYZ, 10, 0.05, key="eid")
    return found.select("eid", "label", "position", F.round("reachability", 6).alias("reachability"))


#: Four points of each disc (its centre and a ring) in four classes; planes turned to the side of their class's first.
_SPLIT = f"""{DISC}, {AXES}, tu AS (SELECT bx.*, normal_vector_x * g AS nx, normal_vector_y * g AS ny, normal_vector_z * g AS nz FROM (SELECT q.*, CASE WHEN q.normal_vector_x * f.fx + q.normal_vector_y * f.fy + q.normal_vector_z * f.fz < 0 THEN -1 ELSE 1 END AS g
    FROM (SELECT *, eid // 40 % 4 AS o FROM bx) q JOIN (SELECT eid // 40 % 4 AS o, arg_min(normal_vector_x, eid) AS fx, arg_min(normal_vector_y, eid) AS fy, arg_min(normal_vector_z, eid) AS fz FROM bx GROUP BY 1) f USING (o)) bx),
    pt4 AS (SELECT row_number() OVER (ORDER BY eid, k) AS n, eid, o, nx, ny, nz, {', '.join(f'{c} + rr * (cos(2 * pi() * (k - 1) / 3) * u[{i}] + sin(2 * pi() * (k - 1) / 3) * v[{i}]) AS {c}' for i, c in enumerate('XYZ', 1))} FROM (SELECT *, CASE WHEN k = 0 THEN 0 ELSE least(50.0, r) END AS rr FROM (SELECT *, unnest(range(4)) AS k FROM tu))),
    gc AS (SELECT *, floor(X / 64) AS cX, floor(Y / 64) AS cY, floor(Z / 64) AS cZ FROM pt4), ga AS (SELECT *, unnest([cX - 1, cX, cX + 1]) AS pX FROM gc), gb AS (SELECT *, unnest([cY - 1, cY, cY + 1]) AS pY FROM ga), gd AS (SELECT *, unnest([cZ - 1, cZ, cZ + 1]) AS pZ FROM gb),
    pr AS (SELECT a.n AS i, b.n AS j, a.o, {_D2} AS d2, abs((b.X - a.X) * (a.nx + b.nx) / 2 + (b.Y - a.Y) * (a.ny + b.ny) / 2 + (b.Z - a.Z) * (a.nz + b.nz) / 2) AS al, sqrt(pow((a.nx + b.nx) / 2, 2) + pow((a.ny + b.ny) / 2, 2) + pow((a.nz + b.nz) / 2, 2)) AS s
      FROM gd a JOIN gc b ON b.cX = a.pX AND b.cY = a.pY AND b.cZ = a.pZ AND a.o = b.o WHERE a.n <> b.n),
    e AS MATERIALIZED (SELECT i, j, o FROM pr WHERE s > 0 AND al / s <= 20 AND sqrt(greatest(d2 - (al / s) * (al / s), 0)) <= 60),
    co AS MATERIALIZED (SELECT i FROM e GROUP BY i HAVING count(*) >= 4), ce AS MATERIALIZED (SELECT i, j FROM e WHERE i IN (SELECT i FROM co) AND j IN (SELECT i FROM co)),
    reach AS (SELECT i AS n, i AS r FROM co UNION SELECT ce.j, reach.r FROM reach JOIN ce ON ce.i = reach.n AND reach.r < ce.j), ro AS (SELECT n, min(r) AS root FROM reach GROUP BY n),
    nu AS (SELECT root, row_number() OVER (PARTITION BY o ORDER BY root) - 1 AS label FROM (SELECT DISTINCT root FROM ro) q JOIN pt4 ON pt4.n = q.root),
    cl AS (SELECT ro.n, label FROM ro JOIN nu USING (root)), lb AS (SELECT n, label FROM cl UNION ALL SELECT e.i, min(cl.label) FROM e JOIN cl ON cl.n = e.j WHERE e.i NOT IN (SELECT i FROM co) GROUP BY e.i)"""


@book.add("c14_disc_split", """SELECT c.eid, c.eid // 40 % 4 AS orient, CAST(coalesce(b.label, -1) AS INT) AS label FROM cat c LEFT JOIN (SELECT eid, label FROM (SELECT pt4.eid, lb.label, count(*) AS k, min(pt4.n) AS f FROM pt4 JOIN lb USING (n) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY eid ORDER BY k DESC, f) = 1) b USING (eid)""", _SPLIT, recursive=True)
def _c14d(spark, d):
    """Parts of four classes of planes by plane-wise distances of their disc points (60 m along, 20 m across)."""
    planes = disc_planes(spark, d).withColumn("orient", F.expr("eid DIV 40 % 4"))
    return subclusters.split_spatially(planes, discs.disc_points(planes, 50.0, 1000.0), min_samples=5, anisotropic=(60.0, 20.0), key="eid", on=("orient",))


@book.add("c15_adaptive_split", """SELECT eid, grp, CAST(dense_rank() OVER (PARTITION BY grp ORDER BY first) - 1 AS INT) AS label FROM (SELECT eid, grp, min(eid) OVER (PARTITION BY grp, part) AS first FROM (SELECT eid, eid % 40 AS grp, eid // 40 % 2 AS part FROM cat WHERE eid % 17 <> 0))""")
def _c15a(spark, d):
    """Each fault patch, doubled 50 km away by half of its events, in its two parts."""
    moved = derived.catalog(spark, d).filter("eid % 17 <> 0").selectExpr("eid", "X + (eid DIV 40 % 2) * 50000 AS X", "Y", "Z", "eid % 40 AS grp")
    return subclusters.adaptive_split(moved, 2, 10, key="eid", on=("grp",))


@book.add("c15_kmeans_fallback", """SELECT eid, grp, CAST(eid // 3 % 2 AS INT) AS label FROM (SELECT eid, 'g' || eid // 6 AS grp FROM cat) q JOIN (SELECT 'g' || eid // 6 AS grp FROM cat GROUP BY 1 HAVING count(*) = 6) USING (grp)""")
def _c15k(spark, d):
    """Groups of six events as two loose triples, too sparse for a density cluster: k-means parts them."""
    rows = derived.catalog(spark, d).selectExpr("eid", "CONCAT('g', eid DIV 6) AS grp", "CAST((eid DIV 3 % 2) * 1000 + (eid % 3) * 400 AS DOUBLE) AS X", "CAST((eid % 3 = 1) AS INT) * 500.0D AS Y", "0.0D AS Z")
    whole = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).filter("n = 6").select("grp")
    return subclusters.adaptive_split(rows.join(whole, "grp"), 2, 3, key="eid", on=("grp",))


@book.add("a9_silhouette_bounds")
def _a9s(spark, d):
    """The silhouette of the fault patches between sure bounds, without pairs of rows."""
    return cluster.silhouette_bounds(_patches(spark, d), XYZ)
