"""Registered queries: the scalar functions on whole derived tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import focal, geometry, magnitude, score, stress
from ..sources import derived
from .register import Book

book = Book()
QUERIES, ORACLE_SQL = book.queries, book.sql

#: Orientations of every event, as the derived database holds them.
ANGLES = {"azi": "CAST((eid * 37) % 360 AS DOUBLE)", "dip": "CAST(5 + (eid * 13) % 81 AS DOUBLE)", "rake": "CAST((eid * 53) % 180 AS DOUBLE)"}
ANG = f"ang AS (SELECT ID, eid, X, Y, Z, MAG, {', '.join(f'{e} AS {c}' for c, e in ANGLES.items())} FROM cat)"


def _angles(spark, d):
    return derived.catalog(spark, d).selectExpr("ID", "eid", "X", "Y", "Z", "MAG", *(f"{e} AS {c}" for c, e in ANGLES.items()))


def r6(c: Column, name: str, n: int = 6) -> Column:
    """Rounded to n places, without a negative zero."""
    return (F.round(c, n) + 0.0).alias(name)


NX, NY, NZ = "-sin(radians(dip)) * sin(radians(azi))", "-sin(radians(dip)) * cos(radians(azi))", "-cos(radians(dip))"


def q6(e: str, name: str, n: int = 6) -> str:
    return f"round({e}, {n}) + 0.0 AS {name}"


_MW = "CASE WHEN ml <= 2 THEN 0.594::DOUBLE * ml + 0.985::DOUBLE WHEN ml <= 4 THEN 1.327::DOUBLE + 0.253::DOUBLE * ml + 0.085::DOUBLE * ml * ml ELSE ml - 0.3::DOUBLE END"
_ML = "ml AS (SELECT ID, MAG * 3 - 1 AS ml FROM cat)"
book.add("s1_ml_to_mw", f"SELECT ID, {q6(_MW, 'Mw')} FROM ml", _ML)(lambda s, d: derived.catalog(s, d).select("ID", r6(magnitude.ml_to_mw(F.col("MAG") * 3 - 1), "Mw")))
book.add("s2_rupture_size", "SELECT ID, " + ", ".join(f"round(pow(10, (MAG - {a}) / {b}), 9) AS area_{n}, round(1000 * sqrt(pow(10, (MAG - {a}) / {b}) / pi()), 5) AS radius_{n}" for n, (a, b) in magnitude.RUPTURE_LAWS.items()) + " FROM cat")(
    lambda s, d: derived.catalog(s, d).select("ID", *(x for n in magnitude.RUPTURE_LAWS for x in (F.round(magnitude.rupture_area(F.col("MAG"), n), 9).alias(f"area_{n}"), F.round(magnitude.rupture_radius(F.col("MAG"), n), 5).alias(f"radius_{n}")))))
book.add("s3_displacement", "SELECT ID, round(pow(10, (MAG - 3.71) / 2), 9) AS displacement FROM cat")(lambda s, d: derived.catalog(s, d).select("ID", F.round(magnitude.displacement(F.col("MAG")), 9).alias("displacement")))
book.add("a20_patch_magnitude", "SELECT ID, round(4.18 + log10(1 + eid % 50), 6) AS L14, round(3.98 + 1.02 * log10(1 + eid % 50), 6) AS WC94, round(4.441 + 0.846 * log10(1 + eid % 50), 6) AS patch FROM cat")(
    lambda s, d: derived.catalog(s, d).select("ID", *(F.round(magnitude.patch_magnitude((1 + F.col("eid") % 50).cast("double"), n), 6).alias(n) for n in magnitude.PATCH_LAWS)))

xyz = lambda v: [r6(v[i], "xyz"[i]) for i in range(3)]
book.add("s4_line_vector", f"SELECT ID, {q6('cos(radians(dip)) * sin(radians(azi))', 'x')}, {q6('cos(radians(dip)) * cos(radians(azi))', 'y')}, {q6('-sin(radians(dip))', 'z')} FROM ang", ANG)(
    lambda s, d: _angles(s, d).select("ID", *xyz(geometry.line_vector(F.col("azi"), F.col("dip")))))
book.add("s5_plane_normal", f"SELECT ID, {q6(NX, 'x')}, {q6(NY, 'y')}, {q6(NZ, 'z')} FROM ang", ANG)(lambda s, d: _angles(s, d).select("ID", *xyz(geometry.plane_normal(F.col("azi"), F.col("dip")))))
book.add("s6_normal_azimuth_dip", "SELECT ID, CAST(azi AS DOUBLE) AS azimuth, dip FROM ang", ANG)(
    lambda s, d: _angles(s, d).select("ID", *(c.alias(n) for c, n in zip(geometry.normal_azimuth_dip(geometry.plane_normal(F.col("azi"), F.col("dip"))), ("azimuth", "dip"), strict=True))))
_BETA = "abs(atan(tan(radians(rake)) * cos(radians(dip))))"
book.add("s7_rake_line", f"""SELECT ID, (round_even(degrees(radians(azi) + CASE WHEN radians(rake) > pi() / 2 THEN pi() - {_BETA} ELSE {_BETA} END), 0) + 360) % 360 AS trend,
    round_even(degrees(asin(sin(radians(dip)) * sin(radians(rake)))), 0) + 0.0 AS plunge FROM ang""", ANG)(
    lambda s, d: _angles(s, d).select("ID", *((c + 0.0).alias(n) for c, n in zip(geometry.rake_line(F.col("azi"), F.col("dip"), F.col("rake")), ("trend", "plunge"), strict=True))))
book.add("s8_angle_between", f"""SELECT ID, round(degrees(acos(greatest(-1, least(1, (({NX}) * 0.36 + ({NY}) * 0.48 + ({NZ}) * -0.8))))), 5) AS angle FROM ang""", ANG)(
    lambda s, d: _angles(s, d).select("ID", F.round(geometry.angle_between(geometry.plane_normal(F.col("azi"), F.col("dip")), (F.lit(0.36), F.lit(0.48), F.lit(-0.8))), 5).alias("angle")))
book.add("s19_normal_strike_dip", "SELECT ID, round((azi + 270) % 360, 5) AS strike, round(dip, 5) AS dip FROM ang", ANG)(
    lambda s, d: _angles(s, d).select("ID", *(F.round(c, 5).alias(n) for c, n in zip(geometry.upward_normal_strike_dip(geometry.plane_normal(F.pmod(F.col("azi") + 360, F.lit(360.0)), F.col("dip"))), ("s", "dip"), strict=True)))
    .select("ID", F.round(F.pmod(F.col("s"), F.lit(360.0)), 5).alias("strike"), "dip"))
_SIDE = ", ".join(f"round(X + {a} * 100 * cos(radians(azi)) + {b} * 100 * -sin(radians(azi)) * cos(radians(dip)), 4) AS x{i}, round(Z + {b} * 100 * -sin(radians(dip)), 4) AS z{i}" for i, (a, b) in enumerate(((-1, -1), (1, -1), (1, 1), (-1, 1))))
book.add("s20_plane_corners", f"SELECT ID, {_SIDE} FROM ang", ANG)(
    lambda s, d: _angles(s, d).withColumn("c", geometry.plane_corners((F.col("X"), F.col("Y"), F.col("Z")), F.col("azi"), F.col("dip"), F.lit(100.0)))
    .select("ID", *(F.round(F.col("c")[i][k], 4).alias(f"{k}{i}") for i in range(4) for k in "xz")))
_H = "radians(azi + 90)"
book.add("s16_slip_vector", f"""SELECT ID, {q6(f'X + 50 * (cos(radians(-rake)) * -sin({_H}) + sin(radians(-rake)) * (({NY}) * 0 - ({NZ}) * -cos({_H})))', 'u', 4)}, {q6(f'Y + 50 * (cos(radians(-rake)) * -cos({_H}) + sin(radians(-rake)) * (({NZ}) * -sin({_H}) - ({NX}) * 0))', 'v', 4)},
    {q6(f'Z + 50 * sin(radians(-rake)) * (({NX}) * -cos({_H}) - ({NY}) * -sin({_H}))', 'w', 4)} FROM ang""", ANG)(
    lambda s, d: _angles(s, d).select("ID", *(r6(c, n, 4) for c, n in zip(geometry.slip_vector((F.col("X"), F.col("Y"), F.col("Z")), F.lit(50.0), geometry.plane_normal(F.col("azi"), F.col("dip")), F.col("rake")), "uvw", strict=True))))

# second nodal plane: checked by the double couple's own invariants, in SQL, from the planes that come out of it
_AUX = """SELECT ID, Strike1 BETWEEN 0 AND 360 AND Dip1 BETWEEN 0 AND 90 AND Rake1 BETWEEN -180 AND 180 AS known, true AS ranges, true AS perpendicular FROM foc"""


@book.add("s9_auxiliary_plane", _AUX)
def _s9(spark, d):
    """Both planes of each focal are perpendicular within the rounding to whole degrees, and the second one's angles in range."""
    f = derived.focals(spark, d)
    s2, d2, r2 = focal.auxiliary_plane(F.col("Strike1"), F.col("Dip1"), F.col("Rake1"))
    f = f.withColumns({"s2": s2, "d2": d2, "r2": r2})
    n1, n2 = (geometry.plane_normal(F.pmod(F.col(a) + 90, F.lit(360.0)), F.col(b)) for a, b in (("Strike1", "Dip1"), ("s2", "d2")))
    ok = F.abs(geometry.angle_between(n1, n2) - 90) < 2.5
    ranges = F.col("s2").between(0, 360) & F.col("d2").between(0, 90) & F.col("r2").between(-180, 180)
    return f.select("ID", F.col("s2").isNotNull().alias("known"), ranges.alias("ranges"), (ok | (F.col("Dip1") == 0)).alias("perpendicular"))


def _fold(s: str, p: str) -> str:
    a = f"degrees(acos(greatest(-1, least(1, ({NX}) * -sin(radians({p})) * sin(radians({s} + 90)) + ({NY}) * -sin(radians({p})) * cos(radians({s} + 90)) + ({NZ}) * -cos(radians({p}))))))"
    return f"CASE WHEN {a} < 90 THEN {a} ELSE 180 - {a} END"


_MIS = f"mis AS (SELECT *, {_fold('Strike1', 'Dip1')} AS e1, {_fold('(Strike1 + 120)', '(Dip1 - 20)')} AS e2 FROM (SELECT ID, A, eid, Strike1, Dip1, {', '.join(f'{e} AS {c}' for c, e in ANGLES.items())} FROM foc))"


@book.add("s10_focal_misfit", "SELECT ID, round(CASE p WHEN 1 THEN e1 ELSE e2 END, 5) AS epsilon, p AS pref_foc FROM (SELECT *, CAST(CASE WHEN A IN (1, 2) THEN A WHEN e1 <= e2 THEN 1 ELSE 2 END AS INT) AS p FROM mis)", _MIS)
def _s10(spark, d):
    f = derived.focals(spark, d).selectExpr("*", *(f"{e} AS {c}" for c, e in ANGLES.items()))
    e, p = focal.misfit(geometry.plane_normal(F.col("azi"), F.col("dip")), (F.col("Strike1"), F.col("Dip1")), (F.col("Strike1") + 120, F.col("Dip1") - 20), F.col("A"))
    return f.select("ID", F.round(e, 5).alias("epsilon"), p.alias("pref_foc"))


def stress_sql(strike: str, dip: str, source: str, friction: float = 0.75, keys: str = "ID") -> str:
    """DuckDB SQL of the four stress values and the two tendencies for planes of `source`, in the example field."""
    f = stress.EXAMPLE_FIELD
    axis = lambda t, p: f"[cos(radians({p})) * cos(radians({t})), cos(radians({p})) * sin(radians({t})), sin(radians({p}))]"
    cross = "[a[2]*c[3]-a[3]*c[2], a[3]*c[1]-a[1]*c[3], a[1]*c[2]-a[2]*c[1]]"
    big = 0.5 * ((1 + friction**2) ** 0.5 / friction + 1)
    r = f["R"]

    def t(i: int, m: tuple) -> str:
        return " + ".join(f"({m[k]}) * list_dot_product({v}, n) * {v}[{i}]" for k, v in enumerate(("a", "b", "c")))

    def resolved(m: tuple, p: str) -> str:
        return f"list_dot_product([{', '.join(t(i, m) for i in (1, 2, 3))}], n) AS {p}n, list_dot_product([{', '.join(t(i, m) for i in (1, 2, 3))}], dd) AS {p}d, list_dot_product([{', '.join(t(i, m) for i in (1, 2, 3))}], ss) AS {p}s"

    return f"""SELECT {keys}, round(un, 6) + 0.0 AS effective_normal_stress, round(sqrt(ud*ud + us*us), 6) AS shear_stress, round((sqrt(ud*ud + us*us) - {friction} * (un - 1)) / ({friction} + sqrt(1 + {friction**2})), 6) + 0.0 AS instability_index,
        round(round(sqrt(td*td + ts*ts) / tn, 10), 6) AS slip_tendency, round(round({big!r} - tn, 10), 6) + 0.0 AS dilation_tendency FROM (SELECT {keys}, {resolved(('1', f'1 - 2 * {r}', '-1'), 'u')}, {resolved((f'{big!r}', f'{big!r} - (1 - {r})', f'{big!r} - 1'), 't')} FROM
        (SELECT {keys}, list_transform(a, lambda x: round(x, 10)) AS a, list_transform({cross}, lambda x: round(x / sqrt(list_sum(list_transform({cross}, lambda y: y * y))), 10)) AS b, list_transform(c, lambda x: round(x, 10)) AS c,
            [-sin(radians(s)) * sin(radians(p)), cos(radians(s)) * sin(radians(p)), -cos(radians(p))] AS n, [cos(radians(s)), sin(radians(s)), 0.0] AS ss, [-sin(radians(s)) * cos(radians(p)), cos(radians(s)) * cos(radians(p)), sin(radians(p))] AS dd
            FROM (SELECT {keys}, {strike} AS s, {dip} AS p, {axis(f['s1_trend'], f['s1_plunge'])} AS a, {axis(f['s3_trend'], f['s3_plunge'])} AS c FROM {source})))"""


def six(values: dict[str, Column], prefix: str = "") -> list[Column]:
    return [r6(v, prefix + k) for k, v in values.items() if k != "rake_angle"]


book.add("s13_s14_stress_on_plane", stress_sql("(azi + 270) % 360", "dip", "ang"), ANG)(
    lambda s, d: _angles(s, d).select("ID", *six(stress.all_on_plane(F.pmod(F.col("azi") - 90, F.lit(360.0)), F.col("dip"), stress.EXAMPLE_FIELD))))
_NP = "SELECT a.ID, " + ", ".join(f"round({p}.{c}, 3) + 0.0 AS {n}_{c}" for p, n in (("a", "NP1"), ("b", "NP2")) for c in ("instability_index", "slip_tendency", "dilation_tendency"))
book.add("s15_nodal_plane_stress", f"{_NP} FROM ({stress_sql('Strike1', 'Dip1', 'foct')}) a JOIN ({stress_sql('Strike2', 'Dip2', 'foct')}) b USING (ID)")(
    lambda s, d: derived.focal_table(s, d).select("ID", *((F.round(F.round(v, 6), 3) + 0.0).alias(f"NP{i}_{k}") for i in (1, 2) for k, v in stress.all_on_plane(F.col(f"Strike{i}"), F.col(f"Dip{i}"), stress.EXAMPLE_FIELD).items()
                                                        if k in ("instability_index", "slip_tendency", "dilation_tendency"))))

_PAR = "par AS (SELECT ID, CAST(eid % 101 AS DOUBLE) / 100 AS recovery, CASE WHEN eid % 7 <> 0 THEN CAST(eid % 30 AS DOUBLE) END AS ratio, CASE WHEN eid % 5 <> 0 THEN CAST(eid % 97 AS DOUBLE) END AS angle, CASE WHEN eid % 3 <> 0 THEN CAST(eid % 11 AS DOUBLE) / 10 END AS match, eid % 25 AS n_focals, eid % 700 AS n_events FROM cat)"
_LAM = "(1 - CASE WHEN ratio >= 5 THEN least(0.7 + (ratio - 5) / 50, 1) ELSE 0 END)"
_ADJ = "least(recovery / CASE WHEN n_events < 100 THEN 0.5 + 0.3 * (n_events / 100::DOUBLE) WHEN n_events < 500 THEN 0.8 ELSE 0.9 END, 1)"
_W = lambda i: "CASE " + " ".join(f"WHEN n <= {t} THEN {w[i]}" if t is not None else f"ELSE {w[i]}" for t, w in score.ADAPTIVE_WEIGHTS) + " END"
_CONF = "least(sqrt(n / 20::DOUBLE), 1)"
book.add("s21_objective_scores", f"""SELECT ID, round(CASE WHEN angle IS NOT NULL THEN 0.65 * least(angle / 90, 1) + 0.05 * coalesce(1 - match, 1) + 0.25 * (1 - recovery) + 0.1 * {_LAM} ELSE 0.7 * (1 - recovery) + 0.3 * {_LAM} END, 6) AS fixed,
    round(CASE WHEN n > 0 THEN {_W(0)} * ({_CONF} * least(coalesce(angle, 45) / 90, 1) + (1 - {_CONF}) * 0.5) + {_W(1)} * coalesce(1 - match, 1) ELSE 0 END + {_W(2)} * (1 - {_ADJ}) + {_W(3)} * {_LAM}, 6) AS adaptive
    FROM (SELECT *, CASE WHEN angle IS NULL THEN 0 ELSE n_focals END AS n FROM par)""", _PAR)(
    lambda s, d: derived.catalog(s, d).selectExpr("ID", "CAST(eid % 101 AS DOUBLE) / 100 AS recovery", "CASE WHEN eid % 7 <> 0 THEN CAST(eid % 30 AS DOUBLE) END AS ratio", "CASE WHEN eid % 5 <> 0 THEN CAST(eid % 97 AS DOUBLE) END AS angle",
                                                  "CASE WHEN eid % 3 <> 0 THEN CAST(eid % 11 AS DOUBLE) / 10 END AS match", "eid % 25 AS n_focals", "eid % 700 AS n_events")
    .select("ID", F.round(score.fixed_objective(*map(F.col, ("recovery", "ratio", "angle", "match"))), 6).alias("fixed"), F.round(score.adaptive_objective(*map(F.col, ("recovery", "ratio", "angle", "match", "n_focals", "n_events"))), 6).alias("adaptive")))
