"""Registered queries: neighbour joins, rupture planes, point clouds, stress domains."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import discs, neighbors, planes
from ..sources import derived
from .function_queries import ANG, ANGLES, r6
from .register import Book

book = Book()
QUERIES, ORACLE_SQL = book.queries, book.sql
R, DT = 150.0, 2.0

_D2 = "(b.X - a.X) * (b.X - a.X) + (b.Y - a.Y) * (b.Y - a.Y) + (b.Z - a.Z) * (b.Z - a.Z)"
G = f"g AS (SELECT *, floor(X / {R}) AS cx, floor(Y / {R}) AS cy, floor(Z / {R}) AS cz FROM cat)"
NEAR = f"""gx AS (SELECT *, unnest([cx - 1, cx, cx + 1]) AS px FROM g), gy AS (SELECT *, unnest([cy - 1, cy, cy + 1]) AS py FROM gx), gp AS (SELECT *, unnest([cz - 1, cz, cz + 1]) AS pz FROM gy),
    nb AS (SELECT a.eid AS i, b.eid AS j, b.X - a.X AS dx, b.Y - a.Y AS dy, b.Z - a.Z AS dz, {_D2} AS d2, abs(floor(epoch(a.Date)) - floor(epoch(b.Date))) AS dt FROM gp a JOIN g b ON b.cx = a.px AND b.cy = a.py AND b.cz = a.pz WHERE {_D2} <= {R * R})"""


def _pairs(spark, d, dt=None):
    return neighbors.neighbor_pairs(derived.catalog(spark, d), R, dt, "eid")


book.add("j1_neighbor_pairs", "SELECT i, j, dx, dy, dz, d2, CAST(dt AS BIGINT) AS dt_s FROM nb", f"{G}, {NEAR}")(lambda s, d: _pairs(s, d))
book.add("j1_neighbor_pairs_in_time", f"SELECT i, j, dx, dy, dz, d2, CAST(dt AS BIGINT) AS dt_s FROM nb WHERE dt < {(int(DT) + 1) * 3600}", f"{G}, {NEAR}")(lambda s, d: _pairs(s, d, DT))

_S = "m AS (SELECT i, count(*) AS n, " + ", ".join(f"(sum(d{a} * d{b}) - sum(d{a}) * sum(d{b}) / count(*)) / (count(*) - 1) AS c{a}{b}" for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")) + " FROM nb GROUP BY i HAVING count(*) >= 5)"
book.add("a1_neighborhood_moments", "SELECT i, n, " + ", ".join(f"round(c{k}, 9) + 0.0 AS c{k}" for k in ("xx", "yy", "zz", "xy", "xz", "yz")) + " FROM m", f"{G}, {NEAR}, {_S}")(
    lambda s, d: planes.neighbor_moments(derived.catalog(s, d), R, "eid").filter("n >= 5").select("i", "n", *(r6(F.col(c), c, 9) for c in planes.COVARIANCE)))

#: Eigenvalues of the covariances in closed form, and the normal as the largest cross product of rows of C - lambda_3.
_EIG = """e0 AS (SELECT *, cxx + cyy + czz AS tr, (cxx + cyy + czz) / 3 AS q FROM m),
    e1 AS (SELECT *, sqrt(((cxx - q) * (cxx - q) + (cyy - q) * (cyy - q) + (czz - q) * (czz - q) + 2 * (cxy * cxy + cxz * cxz + cyz * cyz)) / 6) AS p FROM e0),
    e2 AS (SELECT *, CASE WHEN p > 0 THEN acos(greatest(-1, least(1, (((cxx - q) * ((cyy - q) * (czz - q) - cyz * cyz) - cxy * (cxy * (czz - q) - cyz * cxz) + cxz * (cxy * cyz - (cyy - q) * cxz)) / (p * p * p)) / 2))) / 3 ELSE 0 END AS phi FROM e1),
    e3 AS (SELECT *, q + 2 * p * cos(phi) AS l1, q + 2 * p * cos(phi + 2 * pi() / 3) AS l3 FROM e2), e4 AS (SELECT *, tr - l1 - l3 AS l2 FROM e3)"""
_ACCEPT = f"pl AS (SELECT * FROM e4 WHERE l2 > (SELECT least(pow((avg(EX) + avg(EY)) / 2, 2), {(R / 5) ** 2}) FROM cat) AND l2 / (l3 + 1e-12) > 5)"
_NORMAL = """n0 AS (SELECT *, cxy * cyz - cxz * (cyy - l3) AS ax, cxz * cxy - (cxx - l3) * cyz AS ay, (cxx - l3) * (cyy - l3) - cxy * cxy AS az, cxy * (czz - l3) - cxz * cyz AS b1, cxz * cxz - (cxx - l3) * (czz - l3) AS b2, (cxx - l3) * cyz - cxy * cxz AS b3,
    (cyy - l3) * (czz - l3) - cyz * cyz AS cx_, cyz * cxz - cxy * (czz - l3) AS cy_, cxy * cyz - (cyy - l3) * cxz AS cz_ FROM pl),
    n1 AS (SELECT *, CASE WHEN ka >= kb AND ka >= kc THEN [ax, ay, az] WHEN kb >= kc THEN [b1, b2, b3] ELSE [cx_, cy_, cz_] END AS v FROM (SELECT *, ax*ax+ay*ay+az*az AS ka, b1*b1+b2*b2+b3*b3 AS kb, cx_*cx_+cy_*cy_+cz_*cz_ AS kc FROM n0)),
    n2 AS (SELECT *, v[1] / s AS nx, v[2] / s AS ny, v[3] / s AS nz FROM (SELECT *, sqrt(v[1]*v[1]+v[2]*v[2]+v[3]*v[3]) * CASE WHEN v[3] > 0 THEN -1 ELSE 1 END AS s FROM n1))"""
FITS = f"{G}, {NEAR}, {_S}, {_EIG}, {_ACCEPT}, {_NORMAL}"


def fitted(spark, d, r=R):
    cat = derived.catalog(spark, d)
    return planes.accept_planes(planes.neighbor_moments(cat, r, "eid"), cat, r)


def flagship(spark, d):
    """A rupture plane per event, from neighbours within 500 m, so that the smallest table has some."""
    return fitted(spark, d, 500.0).select("i", "n", "lambda_2_3", "rupture_plane_azimuth", "rupture_plane_dip")


book.add("a1_plane_fit", "SELECT i, n, round(sqrt(l1 + l2 + l3), 6) AS spread, round(l2 / l1, 6) AS planarity, round(abs(nz), 5) AS steepness FROM n2", FITS)(
    lambda s, d: fitted(s, d).select("i", "n", F.round(F.sqrt("total_variance"), 6).alias("spread"), F.round(F.col("lambda_2") / F.col("lambda_1"), 6).alias("planarity"), F.round(F.abs("normal_vector_z"), 5).alias("steepness")))
book.add("a2_plane_acceptance", "SELECT count(*) AS planes, min(n) AS least_n, CAST(sum(n) AS BIGINT) AS neighbors, round(avg(l2 / (l3 + 1e-12)), 3) AS mean_ratio FROM pl", f"{G}, {NEAR}, {_S}, {_EIG}, {_ACCEPT}")(
    lambda s, d: fitted(s, d).agg(F.count(F.lit(1)).alias("planes"), F.min("n").alias("least_n"), F.sum("n").alias("neighbors"), F.round(F.avg("lambda_2_3"), 3).alias("mean_ratio")))
book.add("a14_plane_quality", """SELECT round(avg(x), 3) AS mean_lambda23_ratio, round(median(x), 3) AS median_lambda23_ratio, round(avg((x >= 5)::INT), 6) AS share_over_5, round(avg((x >= 20)::INT), 6) AS share_over_20, round(avg((x >= 50)::INT), 6) AS share_over_50,
    round(avg((x >= 100)::INT), 6) AS share_over_100, round(count(*) / (SELECT count(*) FROM cat), 6) AS plane_recovery_rate FROM (SELECT l2 / (l3 + 1e-12) AS x FROM pl)""", f"{G}, {NEAR}, {_S}, {_EIG}, {_ACCEPT}")(
    lambda s, d: (q := planes.plane_quality(fitted(s, d), derived.catalog(s, d))).select(*(F.round(c, 3 if "lambda" in c else 6).alias(c) for c in q.columns)))


@book.add("g1_perturbation")
def _g1(spark, d):
    """Moments of the moved coordinates by copy; no SQL has this hash, so tests hold them against the errors."""
    moved = planes.perturb(derived.catalog(spark, d), 10, 42, "eid").withColumnsRenamed({"X": "PX"})
    both = moved.select("eid", "k", "PX", "EX").join(derived.catalog(spark, d).select("eid", "X"), "eid")
    return both.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("PX") - F.col("X")) / F.col("EX")).alias("mean"), F.stddev((F.col("PX") - F.col("X")) / F.col("EX")).alias("deviation"))


@book.add("a3_monte_carlo_planes")
def _a3_full(spark, d):
    """Planes of five moved copies of the catalog in one job, and their statistics per event."""
    cat = planes.perturb(derived.catalog(spark, d), 5, 42, "eid")
    fits = planes.accept_planes(planes.neighbor_moments(cat, R, "eid", ("k",)), cat, R, ("k",))
    return planes.orientation_stats(fits, 5)


#: Ten copies of each event's normal, some turned over and one in five of them missing for a third of the events.
_COPIES = {"nx": "CAST((eid * 7 + k) % 19 - 9 AS DOUBLE) / 90", "ny": "CAST((eid * 5 + k * 3) % 17 - 8 AS DOUBLE) / 80", "nz": "CASE WHEN (eid + k) % 3 = 0 THEN 0.9E0 ELSE -0.9E0 END"}
_MC = f"mc AS (SELECT eid AS i, k, lambda_2_3, nx / s AS nx, ny / s AS ny, nz / s AS nz FROM (SELECT eid, k, CAST(5 + (eid + k) % 7 AS DOUBLE) AS lambda_2_3, nx, ny, nz, sqrt(nx * nx + ny * ny + nz * nz) AS s FROM (SELECT eid, k, {', '.join(f'{e} AS {c}' for c, e in _COPIES.items())} FROM cat, (SELECT unnest(range(10)) AS k)) WHERE NOT (eid % 3 = 0 AND k IN (1, 4, 7))))"
_STAT = """st AS (SELECT i, count(*) AS n, avg(lambda_2_3) AS lambda_2_3, sum(nx * g) AS sx, sum(ny * g) AS sy, sum(nz * g) AS sz FROM (SELECT mc.*, CASE WHEN mc.nx * f.nx + mc.ny * f.ny + mc.nz * f.nz < 0 THEN -1 ELSE 1 END AS g
    FROM mc JOIN (SELECT * FROM mc WHERE k = 0) f USING (i)) GROUP BY i)"""


def _copies(spark, d):
    c = derived.catalog(spark, d).selectExpr("eid", "explode(sequence(0, 9)) AS k").filter("NOT (eid % 3 = 0 AND k IN (1, 4, 7))").selectExpr("eid AS i", "k", "CAST(5 + (eid + k) % 7 AS DOUBLE) AS lambda_2_3", *(f"{e} AS {n}" for n, e in _COPIES.items()))
    return c.selectExpr("i", "k", "lambda_2_3", *(f"{n} / sqrt(nx * nx + ny * ny + nz * nz) AS normal_vector_{n[1]}" for n in _COPIES))


_LEN = "sqrt(sx * sx + sy * sy + sz * sz)"
_DOWN = "CASE WHEN sz > 0 THEN -1 ELSE 1 END"
book.add("a3_orientation_stats", f"""SELECT i, n / 10 AS nr_rupt_fits, {', '.join(f"CASE WHEN n >= 8 THEN round(s{c} / {_LEN} * {_DOWN}, 6) + 0.0 END AS normal_vector_{c}" for c in 'xyz')}, CASE WHEN n >= 8 THEN round({_LEN}, 6) END AS nvector_quality_R,
    CASE WHEN n >= 8 THEN 10.0::DOUBLE END AS nvector_quality_N, round(lambda_2_3, 6) AS lambda_2_3 FROM st""", f"{_MC}, {_STAT}")(
    lambda s, d: planes.orientation_stats(_copies(s, d), 10).select("i", "nr_rupt_fits", *(r6(F.col(f"normal_vector_{c}"), f"normal_vector_{c}") for c in "xyz"), F.round("nvector_quality_R", 6).alias("nvector_quality_R"), "nvector_quality_N", F.round("lambda_2_3", 6).alias("lambda_2_3")))
#: Kent's moment estimates: the spread of the second moments across the mean direction, along its own axes, is r2.
_KENT = f"""{_MC}, al AS (SELECT mc.i, mc.nx * g AS x, mc.ny * g AS y, mc.nz * g AS z FROM (SELECT mc.*, CASE WHEN mc.nx * f.nx + mc.ny * f.ny + mc.nz * f.nz < 0 THEN -1 ELSE 1 END AS g FROM mc JOIN (SELECT * FROM mc WHERE k = 0) f USING (i)) mc),
    me AS (SELECT i, count(*) AS n, sum(x) / sqrt(pow(sum(x), 2) + pow(sum(y), 2) + pow(sum(z), 2)) AS mx, sum(y) / sqrt(pow(sum(x), 2) + pow(sum(y), 2) + pow(sum(z), 2)) AS my, sum(z) / sqrt(pow(sum(x), 2) + pow(sum(y), 2) + pow(sum(z), 2)) AS mz, sqrt(pow(sum(x), 2) + pow(sum(y), 2) + pow(sum(z), 2)) / count(*) AS r1 FROM al GROUP BY i),
    ua AS (SELECT *, CASE WHEN abs(mz) < 0.9 THEN my / sqrt(mx * mx + my * my) ELSE 0 END AS ux, CASE WHEN abs(mz) < 0.9 THEN -mx / sqrt(mx * mx + my * my) ELSE mz / sqrt(my * my + mz * mz) END AS uy, CASE WHEN abs(mz) < 0.9 THEN 0 ELSE -my / sqrt(my * my + mz * mz) END AS uz FROM me),
    va AS (SELECT *, my * uz - mz * uy AS vx, mz * ux - mx * uz AS vy, mx * uy - my * ux AS vz FROM ua),
    kt AS (SELECT i, any_value(n) AS n, any_value(r1) AS r1, sqrt(pow(avg(p * p) - avg(q * q), 2) + 4 * pow(avg(p * q), 2)) AS r2 FROM (SELECT va.i, va.n, va.r1, x * ux + y * uy + z * uz AS p, x * vx + y * vy + z * vz AS q FROM al JOIN va USING (i)) GROUP BY i)"""
book.add("a4_kent_parameters", "SELECT i, CASE WHEN n >= 8 THEN trunc(1 / (2 - 2 * r1 - r2) + 1 / (2 - 2 * r1 + r2)) END AS kappa, CASE WHEN n >= 8 THEN trunc(0.5 * (1 / (2 - 2 * r1 - r2) - 1 / (2 - 2 * r1 + r2))) END AS beta FROM kt", _KENT)(
    lambda s, d: planes.orientation_stats(_copies(s, d), 10).select("i", "kappa", "beta"))
book.add("w5_reference_flip", "SELECT i, k, round(nx * g, 9) + 0.0 AS x FROM (SELECT mc.*, CASE WHEN mc.nx * f.nx + mc.ny * f.ny + mc.nz * f.nz < 0 THEN -1 ELSE 1 END AS g FROM mc JOIN (SELECT * FROM mc WHERE k = 0) f USING (i))", _MC)(
    lambda s, d: _flipped(_copies(s, d)))


def _flipped(copies):
    v = [F.col(f"normal_vector_{c}") for c in "xyz"]
    first = copies.groupBy("i").agg(F.min_by(F.struct(*v), "k").alias("f"))
    dot = geometry.dot(tuple(v), tuple(F.col(f"f.normal_vector_{c}") for c in "xyz"))
    return copies.join(first, "i").select("i", "k", r6(v[0] * F.when(dot < 0, -1).otherwise(1), "x", 9))


_NN = ", ".join(f"{e} AS normal_vector_{c}" for c, e in zip("xyz", ("-sin(radians(dip)) * sin(radians(azi))", "-sin(radians(dip)) * cos(radians(azi))", "-cos(radians(dip))"), strict=True))
DISC = f"{ANG}, dp AS (SELECT ID, eid, X, Y, Z, {_NN}, CAST(10 + eid % 90 AS DOUBLE) AS r FROM ang)"
AXES = """ax AS (SELECT *, CASE WHEN abs(normal_vector_z) >= 0.9 THEN [0, normal_vector_z / sqrt(normal_vector_z * normal_vector_z + normal_vector_y * normal_vector_y), -normal_vector_y / sqrt(normal_vector_z * normal_vector_z + normal_vector_y * normal_vector_y)]
    ELSE [normal_vector_y / sqrt(normal_vector_x * normal_vector_x + normal_vector_y * normal_vector_y), -normal_vector_x / sqrt(normal_vector_x * normal_vector_x + normal_vector_y * normal_vector_y), 0] END AS u FROM dp),
    bx AS (SELECT *, [normal_vector_y * u[3] - normal_vector_z * u[2], normal_vector_z * u[1] - normal_vector_x * u[3], normal_vector_x * u[2] - normal_vector_y * u[1]] AS v FROM ax)"""


def disc_planes(spark, d):
    a = derived.catalog(spark, d).selectExpr("ID", "eid", "X", "Y", "Z", *(f"{e} AS {c}" for c, e in ANGLES.items()), "CAST(10 + eid % 90 AS DOUBLE) AS rupt_radius")
    n = geometry.plane_normal(F.col("azi"), F.col("dip"))
    return a.withColumns({f"normal_vector_{c}": n[i] for i, c in enumerate("xyz")}).drop("azi", "dip")


_AT = ", ".join(f"round({c} + rr * (cos(2 * pi() * p / cnt) * u[{i}] + sin(2 * pi() * p / cnt) * v[{i}]), 4) + 0.0 AS {c}" for i, c in enumerate("XYZ", 1))
_ON = "SELECT ID, k AS ring_index, CAST(p AS INT) AS point_index_on_ring, " + _AT + " FROM (SELECT *, unnest(range(cnt)) AS p FROM (SELECT *, CASE WHEN k = 0 THEN 1 ELSE greatest({least}, CAST(floor(2 * pi() * rr / {spacing}) AS BIGINT)) END AS cnt FROM ({rings})))"
_RINGS2 = "SELECT *, least(k * 20.0, r) AS rr FROM (SELECT *, CAST(unnest(range(0, greatest(1, CAST(floor(r / 20) AS BIGINT)) + 1)) AS INT) AS k FROM bx)"
_RINGS4 = "SELECT *, least(k * {s}, r) AS rr FROM (SELECT *, CAST(unnest(range({first}, CAST(ceil(r / {s}) AS BIGINT) + 1)) AS INT) AS k FROM bx)"


def _cloud(df):
    return df.select("ID", "ring_index", "point_index_on_ring", *(r6(F.col(c), c, 4) for c in "XYZ"))


book.add("g2_disc_points", _ON.format(least=3, spacing=12, rings=_RINGS2), f"{DISC}, {AXES}")(lambda s, d: _cloud(discs.disc_points(disc_planes(s, d))))
book.add("g4_surface_points", _ON.format(least=8, spacing=30, rings=_RINGS4.format(s="25.0", first=0)), f"{DISC}, {AXES}")(lambda s, d: _cloud(discs.surface_points(disc_planes(s, d), 25.0, 30.0, None)))
_FP = "fp AS (SELECT ID, X, Y, Z, radians((Strike1 + 90) % 360) AS a, radians(Dip1) AS p, 1000 * sqrt(pow(10, (CASE WHEN MAG <= 2 THEN 0.594 * MAG + 0.985 WHEN MAG <= 4 THEN 1.327 + 0.253 * MAG + 0.085 * MAG * MAG ELSE MAG - 0.3 END) - 4.18) / pi()) AS r FROM foc WHERE A = 1 AND Strike1 BETWEEN 0 AND 360), dp AS (SELECT ID, X, Y, Z, r, -sin(p) * sin(a) AS normal_vector_x, -sin(p) * cos(a) AS normal_vector_y, -cos(p) AS normal_vector_z FROM fp)"
book.add("g3_focal_points", _ON.format(least=8, spacing=25, rings=_RINGS4.format(s="25.0", first=1)), f"{_FP}, {AXES}")(
    lambda s, d: _cloud(discs.focal_points(derived.focals(s, d).withColumns({"Strike2": F.lit(None).cast("double"), "Dip2": F.lit(None).cast("double")}).drop("Date"))))
_SEG = "CASE WHEN r < 50 THEN 8 WHEN r < 200 THEN 12 ELSE 16 END"
_VAT = ", ".join(f"round({c} + rr * (cos(2 * pi() * ((w - 1 + n) % n) / n) * u[{i}] + sin(2 * pi() * ((w - 1 + n) % n) / n) * v[{i}]), 4) + 0.0 AS {c}" for i, c in enumerate("XYZ", 1))
book.add("g5_disc_vertices", f"SELECT ID, CAST(w AS INT) AS vertex, {_VAT} FROM (SELECT *, CASE WHEN w = 0 THEN 0 WHEN w <= n THEN r / 2 ELSE r END AS rr FROM (SELECT *, unnest(range(0, 2 * n + 1)) AS w FROM (SELECT *, {_SEG} AS n FROM bx)))", f"{DISC}, {AXES}")(
    lambda s, d: discs.disc_vertices(disc_planes(s, d)).select("ID", "vertex", *(r6(F.col(c), c, 4) for c in "XYZ")))
book.add("g5_disc_faces", f"""SELECT ID, CAST(f[1] AS INT) AS face, CAST(f[2] AS INT) AS a, CAST(f[3] AS INT) AS b, CAST(f[4] AS INT) AS c FROM (SELECT ID, unnest([[s, 0, 1 + s, 1 + t], [n + 2 * s, 1 + s, 1 + n + s, 1 + t], [n + 2 * s + 1, 1 + t, 1 + n + s, 1 + n + t]]) AS f
    FROM (SELECT *, (s + 1) % n AS t FROM (SELECT ID, n, unnest(range(n)) AS s FROM (SELECT ID, {_SEG} AS n FROM dp))))""", DISC)(lambda s, d: discs.disc_faces(disc_planes(s, d)))  # fmt: skip

book.add("a5_mean_azimuth", "SELECT fault_id, round((degrees(atan2(avg(sin(radians(rupture_plane_azimuth))), avg(cos(radians(rupture_plane_azimuth))))) + 360) % 360, 5) AS azimuth FROM hyp WHERE fault_id IS NOT NULL GROUP BY fault_id")(
    lambda s, d: derived.hypocenters(s, d).filter("fault_id IS NOT NULL").groupBy("fault_id").agg(F.round(geometry.mean_azimuth(F.col("rupture_plane_azimuth")), 5).alias("azimuth")))
book.add("a6_mean_orientation", """SELECT fault_id, ((round_even(degrees(atan2(x, y) - pi()), 0) % 360) + 360) % 360 AS rupture_mean_azimuth, round_even(degrees(pi() - acos(z / sqrt(x*x+y*y+z*z))), 0) AS rupture_mean_dip FROM (SELECT fault_id,
    avg(-sin(radians(rupture_plane_dip)) * sin(radians(rupture_plane_azimuth))) AS x, avg(-sin(radians(rupture_plane_dip)) * cos(radians(rupture_plane_azimuth))) AS y, avg(-cos(radians(rupture_plane_dip))) AS z FROM hyp WHERE fault_id IS NOT NULL GROUP BY fault_id)""")(
    lambda s, d: planes.mean_orientation(derived.hypocenters(s, d).filter("fault_id IS NOT NULL"), "fault_id"))

#: Four stress domains around the planted faults: two boxes that overlap, a triangle, and a concave ring. Fixed values.
DOMAINS = (
    ("D1", 300.0, 20.0, 40.0, 25.0, 0.3, ((588000, 118000), (600000, 118000), (600000, 130000), (588000, 130000))),
    ("D2", 310.0, 10.0, 50.0, 15.0, 0.5, ((595000, 125000), (612000, 125000), (612000, 138000), (595000, 138000))),
    ("D3", 280.0, 30.0, 20.0, 5.0, 0.4, ((605000, 117000), (621000, 117000), (613000, 126000))),
    ("D4", 290.0, 25.0, 30.0, 10.0, 0.6, ((612000, 126000), (622000, 126000), (622000, 140000), (617000, 131000), (612000, 140000))),
)


@book.add("j8_stress_domains", """SELECT c.ID, min(g.Domain) AS Domain, arg_min(g.R, g.Domain) AS R FROM cat c LEFT JOIN (SELECT Domain, R, X, Y, ID FROM (SELECT c.ID, c.X, c.Y, d.Domain, any_value(d.R) AS R, count(*) FILTER ((e.y1 > c.Y) <> (e.y2 > c.Y) AND c.X < (e.x2 - e.x1) * (c.Y - e.y1) / (e.y2 - e.y1) + e.x1) AS k
    FROM cat c, dom d, LATERAL (SELECT unnest(d.edges, recursive := true)) e GROUP BY c.ID, c.X, c.Y, d.Domain) WHERE k % 2 = 1) g USING (ID) GROUP BY c.ID""",
    "dom AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {r}::DOUBLE, [{', '.join('{' + f'x1: {a[0]}::DOUBLE, y1: {a[1]}::DOUBLE, x2: {b[0]}::DOUBLE, y2: {b[1]}::DOUBLE' + '}' for a, b in zip(ring, ring[1:] + ring[:1], strict=True))}])" for n, *_, r, ring in DOMAINS) + ") t(Domain, R, edges))")
def _j8(spark, d):
    rows = [(n, *v, [(float(x), float(y)) for x, y in ring]) for n, *v, ring in DOMAINS]
    dom = spark.createDataFrame(rows, "Domain string, s1_trend double, s1_plunge double, s3_trend double, s3_plunge double, R double, ring array<struct<x: double, y: double>>")
    return neighbors.with_domain(derived.catalog(spark, d), dom).select("ID", "Domain", "R")


_KNN = """kn AS (SELECT a.eid AS i, b.eid AS j, sqrt({d}) AS d, row_number() OVER (PARTITION BY a.eid ORDER BY {d}, b.eid) AS rank FROM cat a JOIN cat b ON a.eid <> b.eid QUALIFY rank <= {k})"""
book.add("j2_knn", "SELECT i, j, round(d, 6) AS d, CAST(rank AS INT) AS rank FROM kn", _KNN.format(d=_D2, k=6))(lambda s, d: neighbors.knn(derived.catalog(s, d), 6, "eid").select("i", "j", F.round("d", 6).alias("d"), "rank"))


@book.add("j9_anisotropic_pairs", """SELECT i, j, round(greatest(sqrt(greatest(d2 - o * o, 0)) / 120, o / 15), 6) AS dist FROM (SELECT i, j, d2, abs(dx * mx + dy * my + dz * mz) / sqrt(mx*mx+my*my+mz*mz) AS o FROM (SELECT nb.*, (a.normal_vector_x + b.normal_vector_x) / 2 AS mx, (a.normal_vector_y + b.normal_vector_y) / 2 AS my,
    (a.normal_vector_z + b.normal_vector_z) / 2 AS mz FROM nb JOIN pn a ON a.eid = i JOIN pn b ON b.eid = j WHERE i <> j)) WHERE greatest(sqrt(greatest(d2 - o * o, 0)) / 120, o / 15) <= 1""", f"{G}, {NEAR}, {ANG}, pn AS (SELECT eid, {_NN} FROM ang)")  # fmt: skip
def _j9(spark, d):
    a = derived.catalog(spark, d).selectExpr("eid", "X", "Y", "Z", *(f"{e} AS {c}" for c, e in ANGLES.items()))
    n = geometry.plane_normal(F.col("azi"), F.col("dip"))
    a = a.withColumns({f"normal_vector_{c}": n[i] for i, c in enumerate("xyz")})
    return neighbors.anisotropic_pairs(a, 120.0, 15.0, "eid").select("i", "j", F.round("dist", 6).alias("dist"))
