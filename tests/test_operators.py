"""Hand-made cases and properties."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quakeloom.functions import focal, geometry, magnitude, stress
from quakeloom.operators import cluster, faults, matching, neighbors, orient, outliers, planes, tuning
from quakeloom.sources import catalogs, database

XYZ = ("X", "Y", "Z")


def frame(spark, points, extra=""):
    return spark.createDataFrame([(i, *map(float, p), 10.0, 10.0, 20.0, 1.0) for i, p in enumerate(points)], "ID long, X double, Y double, Z double, EX double, EY double, EZ double, MAG double").withColumn("Date", F.timestamp_seconds(F.lit(0)))


def test_exact_plane_is_recovered(spark):
    """Nine points on the plane that dips 60 degrees to 120, and one off it."""
    a, d = math.radians(120), math.radians(60)
    along, down = np.array([-math.cos(a), math.sin(a), 0]), np.array([math.sin(a) * math.cos(d), math.cos(a) * math.cos(d), -math.sin(d)])
    pts = [np.array([600_000, 200_000, -5000]) + 40 * i * along + 30 * j * down for i in (-1, 0, 1) for j in (-1, 0, 1)]
    cat = frame(spark, [*pts, np.array([601_000, 200_000, -5000])])
    fits = planes.fit_planes(neighbors.neighbor_pairs(cat, 150.0), cat, 150.0).collect()
    assert len(fits) == 9 and all((r.rupture_plane_azimuth, r.rupture_plane_dip) == (120, 60) for r in fits)


@pytest.mark.parametrize("pts", [[(i, 0, 0) for i in range(4)], [(10 * i, 0, 0) for i in range(6)], [(1, 2, 3)] * 6])
def test_degenerate_neighborhoods_have_no_plane(spark, pts):
    cat = frame(spark, pts)
    assert planes.fit_planes(neighbors.neighbor_pairs(cat, 100.0), cat, 100.0).count() == 0


def test_radius_is_inclusive_and_hours_are_cut(spark):
    t = [0, 2 * 3600 + 59 * 60, 3 * 3600]
    cat = spark.createDataFrame([(i, 100.0 * i, 0.0, 0.0, s) for i, s in enumerate(t)], "ID long, X double, Y double, Z double, s long").withColumn("Date", F.timestamp_seconds("s"))
    got = {(r.i, r.j) for r in neighbors.neighbor_pairs(cat, 100.0, 2.0).collect()}
    assert got == {(0, 0), (1, 1), (2, 2), (0, 1), (1, 0), (1, 2), (2, 1)}
    assert (0, 2) not in {(r.i, r.j) for r in neighbors.neighbor_pairs(cat, 200.0, 2.0).collect()}


def test_knn_against_brute_force(spark):
    g = np.random.default_rng(1)
    p = np.vstack([g.normal(size=(150, 3)) * 10, g.uniform(-5000, 5000, (20, 3)), [[0, 0, 90_000]]])
    got = {(r.i, r.rank): (r.j, r.d) for r in neighbors.knn(frame(spark, p), 4).collect()}
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")
    assert len(got) == 4 * len(p)
    for i in range(len(p)):
        for k in range(4):
            assert got[i, k + 1][1] == pytest.approx(d[i, order[i, k]])


def brute_dbscan(p, eps, least):
    near = np.linalg.norm(p[:, None] - p[None], axis=2) <= eps
    core = near.sum(1) >= least
    label, n = np.full(len(p), -1), 0
    for i in np.flatnonzero(core):
        if label[i] < 0:
            stack, label[i] = [i], n
            while stack:
                for j in np.flatnonzero(near[stack.pop()] & core):
                    if label[j] < 0:
                        label[j] = n
                        stack.append(j)
            n += 1
    for i in np.flatnonzero(~core):
        adjacent = label[near[i] & core]
        label[i] = adjacent.min() if len(adjacent) else -1
    return label


@pytest.mark.parametrize("parts", [1, 7])
def test_dbscan_against_brute_force(spark, parts):
    g = np.random.default_rng(2)
    p = np.vstack([g.normal(size=(80, 3)) * 8, g.normal(size=(60, 3)) * 8 + 100, g.uniform(-200, 200, (40, 3)), [[0, 0, 0]] * 12])
    got = {r.ID: r.label for r in cluster.dbscan(frame(spark, p).repartition(parts), XYZ, 12.0, 5).collect()}
    assert [got[i] for i in range(len(p))] == brute_dbscan(p, 12.0, 5).tolist()


def test_segmentation_of_too_few_rows_and_outlier_options(spark):
    g = np.random.default_rng(3)
    p = np.vstack([g.normal(size=(30, 3)), g.normal(size=(20, 3)) + 500, [[9e4, 0, 0], [0, 9e4, 0]]])
    cat = frame(spark, p)
    step = {"eps": 5.0, "min_samples": 4, "min_size": 10}
    sizes = lambda df: {r[0]: r[1] for r in df.groupBy("sequence_label").count().collect()}
    assert sizes(cluster.segment(cat, [step])[0]) == {"A1": 30, "A2": 20, "Z_outliers": 2}
    assert sizes(cluster.segment(cat, [step], "discard")[0]) == {"A1": 30, "A2": 20}
    assert sizes(cluster.segment(cat, [step], "merge_largest")[0]) == {"A1": 32, "A2": 20}
    assert sizes(cluster.segment(cat, [step | {"outliers": "merge_smallest"}])[0]) == {"A1": 30, "A2": 22}
    assert sizes(cluster.segment(cat, [step | {"min_size": 100}])[0]) == {"Z_outliers": 52}


def test_perturbation(spark):
    cat = frame(spark, [(0, 0, 0)] * 3000)
    assert planes.perturb(cat, 1).select(*XYZ).distinct().count() == 1
    r = planes.perturb(cat, 4).groupBy("k").agg(F.avg("X"), F.stddev("X"), F.corr("X", "Y"), F.stddev("Z")).collect()
    assert len(r) == 4 and all(abs(x[1]) < 1 and abs(x[2] - 10) < 0.6 and abs(x[3]) < 0.08 and abs(x[4] - 20) < 1.2 for x in r)


def test_kent_parameters_of_a_tight_girdle(spark):
    g = np.random.default_rng(4)
    v = np.stack([g.normal(0, 0.10, 400), g.normal(0, 0.04, 400), -np.ones(400)], 1)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(0, k, *map(float, x), 9.0) for k, x in enumerate(v)], "i long, k int, normal_vector_x double, normal_vector_y double, normal_vector_z double, lambda_2_3 double")
    r = planes.orientation_stats(df, 400).first()
    mean = v.mean(0)
    r1 = np.linalg.norm(mean)
    r2 = np.ptp(np.linalg.eigvalsh(np.cov((v @ np.linalg.svd(mean[None])[2][1:].T).T, bias=True)))
    assert r.kappa == pytest.approx(1 / (2 - 2 * r1 - r2) + 1 / (2 - 2 * r1 + r2), rel=0.03)
    assert r.beta > 0 and r.normal_vector_z < -0.99


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


@pytest.mark.parametrize("ml, mw", [(-1, 0.391), (2, 2.173), (2.01, 2.17894), (4, 3.699), (4.01, 3.71), (32, 31.7), (None, None)])
def test_magnitudes(spark, ml, mw):
    r = one(spark, mw=magnitude.ml_to_mw(F.lit(ml).cast("double")), ok=magnitude.sane_mw(magnitude.ml_to_mw(F.lit(ml).cast("double"))))
    assert r.mw == (None if mw is None else pytest.approx(mw, abs=2e-3)) and (r.ok is None) == (ml in (32, None))


def test_azimuths_average_over_north(spark):
    assert spark.createDataFrame([(5.0,), (355.0,)], "a double").agg(geometry.mean_azimuth(F.col("a")).alias("a")).first().a % 360 == pytest.approx(0, abs=1e-9)


@pytest.mark.parametrize("plane", [(0, 90, 0), (40, 60, -90), (120, 35, 80), (300, 70, 170), (10, 80, -20)])
def test_auxiliary_plane_twice_is_the_plane(spark, plane):
    s, d, r = (F.lit(float(x)) for x in plane)
    a = one(spark, **dict(zip("sdr", focal.auxiliary_plane(s, d, r), strict=True)))
    b = one(spark, **dict(zip("sdr", focal.auxiliary_plane(*(F.lit(x) for x in a)), strict=True)))
    n1, n2 = (np.array(one(spark, **dict(zip("xyz", geometry.plane_normal((F.lit(float(p[0])) + 90) % 360, F.lit(float(p[1]))), strict=True)))) for p in (plane, b))
    assert abs(n1 @ n2) > math.cos(math.radians(4))


def test_no_shear_across_principal_axes(spark):
    """Planes normal to the principal stresses carry no shear."""
    f = {"s1_trend": 90.0, "s1_plunge": 0.0, "s3_trend": 0.0, "s3_plunge": 0.0, "R": 0.5}
    for strike, dip, normal in ((0, 90, 1.0), (90, 90, -1.0), (0, 0, 0.0)):
        r = one(spark, **stress.stress_on_plane(F.lit(float(strike)), F.lit(float(dip)), f))
        assert r.shear_stress == pytest.approx(0, abs=1e-9) and r.effective_normal_stress == pytest.approx(normal, abs=1e-9)


def test_time_match_is_backward_with_tolerance(spark):
    ev = spark.createDataFrame([("E", 1000)], "ID string, s long").withColumn("Date", F.timestamp_seconds("s"))
    for lead, hit in ((0, True), (60, True), (61, False), (-1, False)):
        fm = spark.createDataFrame([("F", 1000 - lead)], "ID string, s long").withColumn("Date", F.timestamp_seconds("s"))
        assert (matching.match_focals(ev, fm).first().ID_fm == "F") is hit


def test_lof_of_a_grid_is_about_one(spark):
    cat = frame(spark, [(x, y, z) for x in range(6) for y in range(6) for z in range(6)])
    f = [r.lof for r in outliers.local_outlier_factor(cat, 10).collect()]
    assert max(f) < 1.5 and min(f) > 0.7


def test_far_points_are_isolated(spark):
    g = np.random.default_rng(5)
    cat = frame(spark, np.vstack([g.normal(size=(400, 3)), [[60, 60, 60], [-70, 0, 0]]]))
    out = outliers.flag_outliers_iforest(cat, trees=40, contamination=0.01)
    assert {400, 401} <= {r.ID for r in out.filter("outlier").collect()}
    near = outliers.flag_outliers_dbscan(cat)
    assert {400, 401} <= {r.ID for r in near.filter("outlier").collect()}


def test_likelihood_never_falls(spark):
    g = np.random.default_rng(6)
    v = np.vstack([g.normal((1, 0, 0), 0.2, (60, 3)), g.normal((0, 1, -1), 0.2, (40, 3))])
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(v)], "ID long, normal_vector_x double, normal_vector_y double, normal_vector_z double")
    u = orient.unit(df).cache()
    mu, kappa, w, before = np.eye(3)[:2], np.full(2, 5.0), np.full(2, 0.5), -math.inf
    for _ in range(6):
        mu, kappa, w, ll = orient.em_step(u, mu, kappa, w)
        assert ll >= before - 1e-3
        before = ll
    labels = {r.ID: r.orientation_cluster for r in orient.cluster_orientations(df, 2, starts=2, max_iter=30).collect()}
    assert len({labels[i] for i in range(60)}) == 1 and labels[0] != labels[99]


def test_hull_area_and_farthest_pair(spark):
    p = np.array([[0, 0], [4, 0], [4, 3], [0, 3], [2, 1], [4, 0]], float)
    assert len(faults.hull(p)) == 4
    df = spark.createDataFrame([("F1", *map(float, x)) for x in p], "fault_id string, X double, Y double")
    r = faults.traces(df).first()
    assert r.fault_length_m == 5 and r.bearing == pytest.approx(math.degrees(math.atan2(4, 3)))


def test_pareto_keeps_ties(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, 2.0, 1.0), (3, 2.0, 2.0), (4, 1.0, 2.0)], "id long, a double, b double")
    assert {r.id for r in tuning.pareto(df, ("a", "b")).collect()} == {1, 2, 4}


def test_readers(spark, tmp_path):
    (tmp_path / "hypo.csv").write_text("MAG,ID,LAT,LON,DEPTH,X,Y,Z,EX,EY,EZ,YR,MO,DY,HR,MI,SC\n1.5,KP1,46,7,5,1,2,-5000,,1,2,2001,2,3,4,5,6.25\nx,KP2,46,7,5,1,2,-5000,1,1,2,2001,13,3,4,5,6\n")
    a, b = catalogs.read_hypocenters(spark, str(tmp_path / "hypo.csv")).orderBy("ID").collect()
    assert a.EX == 0 and a.MAG == 1.5 and str(a.Date) == "2001-02-03 04:05:06.250000" and b.MAG is None and b.Date is None
    (tmp_path / "b.txt").write_text("# text\n#KP-ID | Pref-lat|Pref-lon|Pref-dep|YYYY|MM|DD|HH|MI|SS|mag|\nKP9| 46.1 | 7 | 3.5|2000|1|2|3|4|5.5| bad |\n\n")
    r = catalogs.read_bulletin(spark, str(tmp_path / "b.txt"), "hypocenters").first()
    assert (r.ID, r.LAT, r.Z, r.SC, r.MAG, r.X) == ("KP9", 46.1, -3500.0, 5.5, None, None)
    assert catalogs.bulletin_kind("/x/y.txt", ["c"] * 41) == "hypocenters" and catalogs.bulletin_kind("/x/FM_a.csv", []) == "focals"


def test_database_round_trip(spark, tmp_path):
    meta = spark.createDataFrame([("F0001", 3)], "fault_id string, n_events long")
    database.write_database({"metadata": meta}, str(tmp_path))
    status = {r.name: r.loaded for r in database.load_database(spark, {"metadata": f"{tmp_path}/metadata"}).collect()}
    assert status == {"metadata": True, "hypocenters": False, "focals": False}
    assert database.query(spark, "SELECT n_events FROM metadata").first()[0] == 3
    assert "metadata" in {r.name for r in database.list_tables(spark).collect()}
    assert database.table_info(spark, "metadata").count() == 2
