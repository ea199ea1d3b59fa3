"""Registered queries: orientation clusters, fault tables, catalog statistics and parameter search, and whole workloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry, stress
from ..operators import faults, orient, tuning
from ..sources import derived
from . import pipeline
from .function_queries import ANG, ANGLES, r6
from .plane_queries import FITS, NEAR, G, fitted
from .register import Book

book = Book()
QUERIES, ORACLE_SQL = book.queries, book.sql

#: Vertical planes of each fault with five strikes, as planted, with a small wobble by event.
_FAULT = {"azi": "CAST((eid % 5) * 35 + (eid * 7) % 11 AS DOUBLE)", "dip": "CAST(70 + (eid * 3) % 13 AS DOUBLE)"}
_FCTE = f"""fl AS (SELECT *, -sin(radians(dip)) * sin(radians(azi)) AS nx, -sin(radians(dip)) * cos(radians(azi)) AS ny, -cos(radians(dip)) AS nz FROM (SELECT eid, ID, fault_id, sequence_label, X, Y, Z, {', '.join(f'{e} AS {c}' for c, e in _FAULT.items())} FROM hyp WHERE fault_id IS NOT NULL)),
    fs AS (SELECT fl.*, nx * g AS ax, ny * g AS ay, nz * g AS az FROM (SELECT fl.*, CASE WHEN nx * mx + ny * my + nz * mz < 0 THEN -1 ELSE 1 END AS g FROM fl JOIN (SELECT fault_id, avg(nx) AS mx, avg(ny) AS my, avg(nz) AS mz FROM fl GROUP BY fault_id) USING (fault_id)) fl),
    fa AS (SELECT fs.*, degrees(acos(greatest(-1, least(1, (ax * mx + ay * my + az * mz) / sqrt(mx*mx+my*my+mz*mz))))) AS angle FROM fs JOIN (SELECT fault_id, avg(ax) AS mx, avg(ay) AS my, avg(az) AS mz FROM fs GROUP BY fault_id) USING (fault_id))"""


def planted(spark, d):
    h = derived.hypocenters(spark, d).filter("fault_id IS NOT NULL").selectExpr("*", *(f"{e} AS {c}" for c, e in _FAULT.items()))
    n = geometry.plane_normal(F.col("azi"), F.col("dip"))
    return h.withColumns({f"normal_vector_{c}": n[i] for i, c in enumerate("xyz")})


book.add("a17_orientation_consistency", "SELECT fault_id, round(max(angle), 5) AS max_deviation, max(angle) <= 45 AS consistent FROM fa GROUP BY fault_id", _FCTE)(
    lambda s, d: faults.orientation_consistency(planted(s, d), "fault_id").select("fault_id", F.round("max_deviation", 5).alias("max_deviation"), "consistent"))
book.add("a18_planarity", "SELECT fault_id, CASE WHEN count(*) >= 3 THEN round(exp(-0.06 * avg(angle)), 6) END AS planarity FROM fa GROUP BY fault_id", _FCTE)(
    lambda s, d: faults.planarity(planted(s, d), "fault_id").select("fault_id", F.round("planarity", 6).alias("planarity")))
book.add("a21_aligned_normals", "SELECT eid, round(ax, 6) + 0.0 AS x, round(ay, 6) + 0.0 AS y, round(az, 6) + 0.0 AS z FROM fs", _FCTE)(
    lambda s, d: faults.align_normals(planted(s, d), "fault_id").select("eid", *(r6(F.col(f"normal_vector_{c}"), c) for c in "xyz")))
book.add("a11_fault_metadata", """SELECT fault_id, count(*) AS n_events, min(sequence_label) AS sequence_label, round(avg(X), 2) AS centroid_x, round(avg(Y), 2) AS centroid_y, round(avg(Z), 2) AS centroid_z, round(avg(instability_index), 3) AS rupture_mean_instability, round(avg(slip_tendency), 3) AS rupture_mean_sliptend,
    round(avg(dilation_tendency), 3) AS rupture_mean_dilatend FROM hyp WHERE fault_id IS NOT NULL GROUP BY fault_id""")(lambda s, d: faults.fault_metadata(derived.hypocenters(s, d)).drop("rupture_mean_azimuth", "rupture_mean_dip"))  # fmt: skip
_TR = """tp AS (SELECT DISTINCT fault_id, X, Y FROM hyp WHERE fault_id IS NOT NULL), tt AS (SELECT a.fault_id, max(sqrt(pow(a.X - b.X, 2) + pow(a.Y - b.Y, 2))) AS length FROM tp a JOIN tp b USING (fault_id) GROUP BY a.fault_id)"""
book.add("a19_fault_traces", "SELECT fault_id, round(length, 4) AS fault_length_m FROM tt", _TR)(lambda s, d: faults.traces(derived.hypocenters(s, d)).select("fault_id", F.round("fault_length_m", 4).alias("fault_length_m")))


@book.add("a20_fault_patches")
def _a20(spark, d):
    p = planted(spark, d)
    return faults.patches(p, faults.fault_metadata(p))


book.add("w4_fault_ids", "SELECT eid, CASE WHEN fault_id IS NOT NULL THEN 'F' || lpad(CAST(dense_rank() OVER (ORDER BY sequence_label, c) AS VARCHAR), 4, '0') END AS fault_id FROM (SELECT *, eid % 40 AS c FROM hyp WHERE fault_id IS NOT NULL)")(
    lambda s, d: faults.fault_ids(derived.hypocenters(s, d).filter("fault_id IS NOT NULL").drop("fault_id").withColumn("cluster", F.col("eid") % 40)).select("eid", "fault_id"))

_H = "hh AS (SELECT ID, floor((floor(epoch(Date)) - lag(floor(epoch(Date))) OVER (ORDER BY floor(epoch(Date)), ID)) / 3600) AS hours FROM cat)"
book.add("w2_inter_event_hours", "SELECT ID, CAST(hours AS BIGINT) AS hours FROM hh", _H)(lambda s, d: tuning.inter_event_hours(derived.catalog(s, d), part_s=86_400))
_NN = "nn AS (SELECT a.eid AS i, min(sqrt((b.X - a.X) * (b.X - a.X) + (b.Y - a.Y) * (b.Y - a.Y) + (b.Z - a.Z) * (b.Z - a.Z))) AS d FROM cat a JOIN cat b ON a.eid <> b.eid GROUP BY a.eid)"
_STATS = f"{_H}, {_NN}"
_SPAN = "(floor(epoch(max(Date))) - floor(epoch(min(Date)))) / 86400"
book.add("a13_catalog_stats", f"""SELECT count(*) AS n_events, max(X) - min(X) AS range_x, round({_SPAN}, 6) AS duration_days, round(count(*) / greatest({_SPAN}, 1), 6) AS events_per_day, round(avg(MAG), 6) AS mag_mean, round((SELECT quantile_cont(d, 0.99) FROM nn), 6) AS nn_p99, round((SELECT quantile_cont(d, 0.5) FROM nn), 6) AS nn_p50,
    round((SELECT avg(d) FROM nn), 6) AS nn_mean, CAST((SELECT max(hours) FROM hh) AS DOUBLE) AS hours_max, (SELECT quantile_cont(hours, 0.75) FROM hh) AS hours_p75 FROM cat""", _STATS)(
    lambda s, d: (t := tuning.catalog_stats(derived.catalog(s, d))).select("n_events", "range_x", *(F.round(F.col(c).cast("double"), 6).alias(c) for c in ("duration_days", "events_per_day", "mag_mean", "nn_p99", "nn_p50", "nn_mean", "hours_max", "hours_p75"))))
book.add("c19_heuristic", f"""SELECT round((SELECT quantile_cont(d, 0.99) FROM nn), 6) AS r_nn, greatest(24, least(43800, CASE WHEN rate > 1 THEN (SELECT quantile_cont(hours, 0.75) FROM hh) WHEN rate > 0.1 THEN (SELECT quantile_cont(hours, 0.9) FROM hh) ELSE least((SELECT max(hours) FROM hh), 26280) END))::DOUBLE AS dt_nn FROM (SELECT count(*) / greatest({_SPAN}, 1) AS rate FROM cat)""", _STATS)(
    lambda s, d: tuning.heuristic(tuning.catalog_stats(derived.catalog(s, d))).select(F.round("r_nn", 6).alias("r_nn"), F.col("dt_nn").cast("double")))

_GR, _GT = [60.0, 100.0, 150.0], [2.0, 24.0, 9_999_999.0]
_GM = "gm AS (SELECT i, r, t AS dt, count(*) AS n, (sum(dx * dx) - sum(dx) * sum(dx) / count(*)) / (count(*) - 1) AS cxx, (sum(dy * dz) - sum(dy) * sum(dz) / count(*)) / (count(*) - 1) AS cyz FROM nb, (SELECT unnest([60.0, 100.0, 150.0])::DOUBLE AS r), (SELECT unnest([2.0, 24.0, 9999999.0])::DOUBLE AS t) WHERE d2 <= r * r AND nb.dt < (floor(t) + 1) * 3600 GROUP BY 1, 2, 3 HAVING count(*) >= 5)"
book.add("c18_grid_moments", "SELECT i, r, dt, n, round(cxx, 9) + 0.0 AS cxx, round(cyz, 9) + 0.0 AS cyz FROM gm", f"{G}, {NEAR}, {_GM}")(
    lambda s, d: tuning.grid_moments(derived.catalog(s, d), _GR, _GT, "eid").select("i", "r", "dt", "n", r6(F.col("cxx"), "cxx", 9), r6(F.col("cyz"), "cyz", 9)))


@book.add("c18_grid_search")
def _c18(spark, d):
    f = derived.focal_table(spark, d).select("eid", "Strike1", "Dip1", "Strike2", "Dip2", "A")
    return tuning.grid_search(derived.catalog(spark, d), [60.0, 80.0, 100.0, 125.0, 150.0], [24.0, 720.0, 8760.0, 43_800.0, 9_999_999.0], "eid", f)


_PR = "pr AS (SELECT fault_id AS id, round(avg(instability_index), 2) AS a, round(avg(slip_tendency), 2) AS b, round(avg(dilation_tendency), 2) AS c FROM hyp WHERE fault_id IS NOT NULL GROUP BY fault_id)"
_DOM = "SELECT * FROM pr p WHERE NOT EXISTS (SELECT 1 FROM pr q WHERE q.a <= p.a AND q.b <= p.b AND q.c <= p.c AND (q.a < p.a OR q.b < p.b OR q.c < p.c))"


def _front(spark, d):
    g = derived.hypocenters(spark, d).filter("fault_id IS NOT NULL").groupBy(F.col("fault_id").alias("id"))
    return tuning.pareto(g.agg(F.round(F.avg("instability_index"), 2).alias("a"), F.round(F.avg("slip_tendency"), 2).alias("b"), F.round(F.avg("dilation_tendency"), 2).alias("c")), ("a", "b", "c"))


book.add("c20_pareto_front", f"{_DOM}", _PR)(_front)
book.add("c20_representatives", "SELECT 'best_a' AS kind, min(a) AS best FROM f UNION ALL SELECT 'best_b', min(b) FROM f UNION ALL SELECT 'best_c', min(c) FROM f", f"{_PR}, f AS ({_DOM})")(
    lambda s, d: tuning.representatives(_front(s, d), ("a", "b", "c")).filter("kind <> 'balanced'").select("kind", F.expr("CASE kind WHEN 'best_a' THEN a WHEN 'best_b' THEN b ELSE c END").alias("best")))


def _vectors(spark, d):
    """Unit vectors of the first three components of the embeddings, as normals."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("ID"), *(F.col("embedding")[i].cast("double").alias(f"normal_vector_{c}") for i, c in enumerate("xyz")))
    return orient.unit(e)


@book.add("c11_spherical_kmeans")
def _c11(spark, d):
    return orient.spherical_kmeans(_vectors(spark, d), 4, 3)[0].groupBy("label").count()


#: One expectation step from fixed centres: weights 1/2 each, concentration 5. Fixed values.
_MU, _KAPPA = ((1.0, 0.0, 0.0), (0.0, 0.0, -1.0)), 5.0


@book.add("c12_vmf_step", """SELECT CAST(count(*) AS BIGINT) AS n, round(sum(p), 6) AS weight_1, round(sum(p * nx), 6) + 0.0 AS x_1, round(sum(p * nz), 6) + 0.0 AS z_1, round(sum(1 - p), 6) AS weight_2 FROM (SELECT nx, ny, nz, exp(5 * nx) / (exp(5 * nx) + exp(-5 * nz)) AS p FROM
    (SELECT -sin(radians(dip)) * sin(radians(azi)) AS nx, -sin(radians(dip)) * cos(radians(azi)) AS ny, -cos(radians(dip)) AS nz FROM ang))""", ANG)  # fmt: skip
def _c12(spark, d):
    a = derived.catalog(spark, d).selectExpr("ID", "eid", *(f"{e} AS {c}" for c, e in ANGLES.items()))
    n = geometry.plane_normal(F.col("azi"), F.col("dip"))
    u = orient.unit(a.withColumns({f"normal_vector_{c}": n[i] for i, c in enumerate("xyz")}))
    logs, total = orient._terms(_np(_MU), _np([_KAPPA] * 2), _np([0.5] * 2))
    p = F.exp(logs[0] - total)
    return u.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(p), 6).alias("weight_1"), r6(F.sum(p * F.col("x")), "x_1"), r6(F.sum(p * F.col("z")), "z_1"), F.round(F.sum(1 - p), 6).alias("weight_2"))


def _np(x):
    import numpy as np

    return np.array(x, float)


@book.add("c12_vmf_mixture")
def _c12m(spark, d):
    """Orientation classes of the planted faults."""
    labels, _ = orient.vmf_mixture(orient.unit(planted(spark, d), "eid"), 5, key="eid")
    return labels


@book.add("c13_orientation_count")
def _c13(spark, d):
    k = orient.choose_k(planted(spark, d), 4, "eid", starts=1, max_iter=15)
    return planted(spark, d).agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.lit(k))


@book.add("c15_kmeans_split")
def _c15(spark, d):
    return orient.kmeans_split(derived.catalog(spark, d), 2, key="eid")


@book.add("workload_single_sequence")
def _single(spark, d):
    """Catalog and focals to fault events, in one job over all sequences."""
    cat, foc = derived.catalog(spark, d), derived.focals(spark, d).drop("eid", "lead_s")
    out = pipeline.image_sequence(cat, foc, stress.EXAMPLE_FIELD, 150.0, k=3, eps=250.0)
    return out.select("ID", "fault_id", "rupture_plane_azimuth", "rupture_plane_dip", "epsilon", "pref_foc", "plane_determination_method", "instability_index", "slip_tendency", "dilation_tendency")


@book.add("workload_database")
def _database(spark, d):
    """Metadata of the fault database of the whole catalog, segmented first."""
    cat, foc = derived.catalog(spark, d).drop("eid"), derived.focals(spark, d).drop("eid", "lead_s")
    steps = [{"eps": 300.0, "min_samples": 8, "min_size": 40}]
    return pipeline.build_database(cat, foc, steps, stress.EXAMPLE_FIELD, 150.0, k=3, eps=250.0)["metadata"]


book.add("s6_plane_orientation", "SELECT i, round_even(degrees(pi() - acos(greatest(-1, nz))), 0) AS rupture_plane_dip FROM n2", FITS)(lambda s, d: fitted(s, d).select("i", "rupture_plane_dip"))
