"""Registered queries: readers, checks, filters, and matching of focals and results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import focal, magnitude
from ..operators import matching, quality
from ..schema import BULLETIN_FOCALS, BULLETIN_HYPOCENTERS
from ..sources import catalogs, derived
from .register import Book

book = Book()
QUERIES, ORACLE_SQL = book.queries, book.sql

#: Text columns as a file would hold them, with some bad values. The same SQL in both engines.
RAW = {
    "ID": "CASE WHEN eid % 97 = 0 THEN '' WHEN eid % 101 = 0 THEN 'EV1' ELSE ID END",
    "LAT": "CASE WHEN eid % 53 = 0 THEN 'bad' WHEN eid % 59 = 0 THEN '95.5' ELSE CAST(46 + eid % 2 AS VARCHAR(9)) END",
    "LON": "CAST(7 + eid % 3 AS VARCHAR(9))",
    "DEPTH": "CASE WHEN eid % 61 = 0 THEN '-1' ELSE CAST(eid % 30 AS VARCHAR(9)) END",
    "X": "CAST(CAST(X AS BIGINT) AS VARCHAR(20))",
    "Y": "CAST(CAST(FLOOR(Y) AS BIGINT) AS VARCHAR(20))",
    "Z": "CAST(CAST(Z AS BIGINT) AS VARCHAR(20))",
    "EX": "CASE WHEN eid % 19 <> 0 THEN CASE WHEN eid % 23 = 0 THEN '0' ELSE CAST(10 + eid % 7 AS VARCHAR(9)) END END",
    "EY": "CASE WHEN eid % 29 = 0 THEN '20000' ELSE CAST(10 + eid % 5 AS VARCHAR(9)) END",
    "EZ": "CAST(20 + eid % 11 AS VARCHAR(9))",
    "YR": "CAST(1980 + eid % 40 AS VARCHAR(9))",
    "MO": "CAST(1 + eid % 13 AS VARCHAR(9))",
    "DY": "CAST(1 + eid % 28 AS VARCHAR(9))",
    "HR": "CASE WHEN eid % 67 = 0 THEN '7.5' ELSE CAST(eid % 24 AS VARCHAR(9)) END",
    "MI": "CAST(eid % 60 AS VARCHAR(9))",
    "SC": "CONCAT(CAST(eid % 60 AS VARCHAR(9)), '.25')",
    "MAG": "CASE WHEN eid % 211 = 0 THEN '12' WHEN eid % 199 = 0 THEN '-4' ELSE CAST(eid % 7 AS VARCHAR(9)) END",
}
RAW_CTE = f"raw AS (SELECT eid, {', '.join(f'{e} AS {c}' for c, e in RAW.items())} FROM cat)"
_TIME = "CASE WHEN CAST(MO AS INT) <= 12 AND eid % 67 <> 0 THEN CAST(make_timestamp(CAST(YR AS BIGINT), CAST(MO AS BIGINT), CAST(DY AS BIGINT), CAST(HR AS BIGINT), CAST(MI AS BIGINT), 0.0) AS TIMESTAMP) + to_milliseconds(CAST(round(CAST(SC AS DOUBLE) * 1000) AS BIGINT)) END"


def _raw(spark, d):
    return derived.catalog(spark, d).selectExpr("eid", *(f"{e} AS {c}" for c, e in RAW.items()))


_D = lambda c: f"TRY_CAST({c} AS DOUBLE) AS {c}"
_I = lambda c: f"CASE WHEN regexp_full_match({c}, '-?\\d+') THEN TRY_CAST({c} AS INT) END AS {c}"


@book.add("io1_read_hypocenters", f"""SELECT ID, {', '.join(_D(c) for c in ('LAT', 'LON', 'DEPTH', 'X', 'Y', 'Z'))}, {', '.join(f"coalesce(TRY_CAST({c} AS DOUBLE), 0) AS {c}" for c in ('EX', 'EY', 'EZ'))},
    {', '.join(_I(c) for c in ('YR', 'MO', 'DY', 'HR', 'MI'))}, {_D('SC')}, {_D('MAG')}, epoch_us({_TIME}) AS us FROM raw""", RAW_CTE)  # fmt: skip
def _io1(spark, d):
    """The catalog's columns and time from text."""
    df = catalogs.with_errors(catalogs.by_name(_raw(spark, d), catalogs.HYPOCENTERS))
    df = df.withColumn("Date", catalogs.origin_time(*(F.col(c) for c in catalogs.HYPOCENTER_COLUMNS[10:16])))
    return df.select(*catalogs.HYPOCENTER_COLUMNS, F.unix_micros("Date").alias("us"))


@book.add("io2_read_focals", """SELECT ID, Strike1, CAST(eid % 24 AS INT) AS HR, CAST(eid % 60 AS INT) AS MI, CASE WHEN eid % 50 = 0 THEN CAST(eid % 59 AS DOUBLE) ELSE 0 END AS SC,
    epoch_us(make_timestamp(2000 + eid % 20, 1 + eid % 12, 1 + eid % 28, eid % 24, eid % 60, CASE WHEN eid % 50 = 0 THEN CAST(eid % 59 AS DOUBLE) ELSE 0 END)) AS us FROM foc""")  # fmt: skip
def _io2(spark, d):
    """Focals whose time is HH:MM or HH:MM:SS.f in one column."""
    clock = "concat(lpad(CAST(eid % 24 AS STRING), 2, '0'), ':', lpad(CAST(eid % 60 AS STRING), 2, '0'), if(eid % 50 = 0, concat(':', lpad(CAST(eid % 59 AS STRING), 2, '0'), '.7'), ''))"
    raw = derived.focals(spark, d).selectExpr("ID", "CAST(Strike1 AS STRING) AS Strike1", "CAST(2000 + eid % 20 AS STRING) AS YR", "CAST(1 + eid % 12 AS STRING) AS MO", "CAST(1 + eid % 28 AS STRING) AS DY", f"{clock} AS `Hr:Mi`")
    return catalogs.normalize_focals(raw).select("ID", "Strike1", "HR", "MI", "SC", F.unix_micros("Date").alias("us"))


def _lines(df, names):
    return df.select(F.concat_ws("|", *(F.concat(F.lit(" "), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("  ")) for c in names.values()), F.lit("")).alias("value"))


@book.add("io3_hypocenter_bulletin", f"""SELECT ID, {', '.join(_D(c) for c in ('LAT', 'LON', 'DEPTH', 'X', 'Y', 'EX', 'EY', 'EZ'))}, TRY_CAST(DEPTH AS DOUBLE) * -1000 AS Z, {', '.join(_I(c) for c in ('YR', 'MO', 'DY', 'HR', 'MI'))}, {_D('SC')}, {_D('MAG')} FROM raw""", RAW_CTE)
def _io3(spark, d):
    return catalogs.parse_bulletin(_lines(_raw(spark, d), BULLETIN_HYPOCENTERS), list(BULLETIN_HYPOCENTERS), "hypocenters")


@book.add("io4_focal_bulletin", """SELECT ID, CAST(46.5 AS DOUBLE) AS LAT, CAST(7.5 AS DOUBLE) AS LON, CAST(eid % 20 AS DOUBLE) AS DEPTH, X, Y, CAST(eid % 20 AS DOUBLE) * -1000 AS Z, CAST(2000 AS INT) AS YR, CAST(NULL AS INT) AS MO, CAST(1 AS INT) AS DY, CAST(2 AS INT) AS HR, CAST(3 AS INT) AS MI,
    CAST(4.5 AS DOUBLE) AS SC, CAST(eid % 5 AS DOUBLE) AS MAG, A, Strike1, Dip1, Rake1, CAST(NULL AS DOUBLE) AS Strike2, CAST(NULL AS DOUBLE) AS Dip2, CAST(NULL AS DOUBLE) AS Rake2, CAST(NULL AS DOUBLE) AS Pazim, CAST(NULL AS DOUBLE) AS Pdip, CAST(NULL AS DOUBLE) AS Tazim, CAST(NULL AS DOUBLE) AS Tdip, CAST(1 AS INT) AS Q, 'SS' AS Type FROM foc""")  # fmt: skip
def _io4(spark, d):
    raw = derived.focals(spark, d).selectExpr("ID", "'46.5' AS LAT", "'7.5' AS LON", "eid % 20 AS DEPTH", "X", "Y", "'2000' AS YR", "'x' AS MO", "1 AS DY", "2 AS HR", "3 AS MI", "'4.5' AS SC", "eid % 5 AS MAG", "A", "Strike1", "Dip1", "Rake1",
                                               "'' AS Strike2", "'' AS Dip2", "'' AS Rake2", "'' AS Pazim", "'' AS Pdip", "'' AS Tazim", "'' AS Tdip", "1 AS Q", "'SS' AS Type")
    return catalogs.parse_bulletin(_lines(raw, BULLETIN_FOCALS), list(BULLETIN_FOCALS), "focals")


def _check_sql() -> str:
    n = lambda c: f"TRY_CAST({c} AS DOUBLE)"
    rows = []
    for c in quality.HYPOCENTER_COLUMNS[1:]:
        rows += [(c, "not_numeric", f"{c} IS NOT NULL AND {n(c)} IS NULL"), (c, "infinite", f"isinf({n(c)})")]
        if c in quality.HYPOCENTER_RANGES:
            rows.append((c, "out_of_range", "{} NOT BETWEEN {} AND {}".format(n(c), *quality.HYPOCENTER_RANGES[c])))
        if c in quality.WHOLE:
            rows.append((c, "not_whole", f"{n(c)} % 1 <> 0"))
        if c in quality.ERRORS:
            rows += [(c, "not_positive", f"{n(c)} <= 0"), (c, "over_10_km", f"{n(c)} > 10000")]
    rows += [("MAG", "too_large", f"{n('MAG')} > 10"), ("MAG", "too_small", f"{n('MAG')} < -3")]
    parts = [f"SELECT '{c}' AS \"column\", '{k}' AS \"check\", count(*) FILTER ({w}) AS n FROM raw" for c, k, w in rows]
    parts += ["SELECT 'ID', 'missing', count(*) FILTER (ID = '') FROM raw", "SELECT 'ID', 'duplicate', count(*) FILTER (ID <> '') - count(DISTINCT nullif(ID, '')) FROM raw", "SELECT 'ID', 'too_long', 0", "SELECT 'ID', 'no_prefix', 0"]
    return f"SELECT 'hypocenters' AS file, \"column\", \"check\", CAST(n AS BIGINT) AS n, \"check\" IN {quality.FATAL} AND n > 0 AS fatal FROM ({' UNION ALL '.join(parts)})"


@book.add("v1_v7_hypocenter_checks", _check_sql(), RAW_CTE)
def _v(spark, d):
    return quality.check_hypocenters(_raw(spark, d).drop("eid"))


@book.add("v8_verdict", f"SELECT file, NOT bool_or(fatal) AS valid, count(*) FILTER (n > 0) AS issues FROM ({_check_sql()}) GROUP BY file", RAW_CTE)
def _v8(spark, d):
    return quality.verdict(quality.check_hypocenters(_raw(spark, d).drop("eid")))


_STRUCTURE = """SELECT 'focals' AS file, "column", "check", CAST(n AS BIGINT) AS n, "check" IN ('missing_column', 'missing', 'duplicate', 'too_large', 'too_small') AND n > 0 AS fatal FROM (
    SELECT unnest(['LAT', 'LON', 'DEPTH', 'YR', 'MO', 'DY', 'HR', 'MI', 'SC', 'Strike2', 'Dip2', 'Rake2', 'Pazim', 'Pdip', 'Tazim', 'Tdip']) AS "column", 'missing_column' AS "check", 1 AS n
    UNION ALL SELECT c, k, 0 FROM (SELECT unnest(['X', 'Y', 'Z', 'MAG', 'A', 'Strike1', 'Dip1', 'Rake1']) AS c), (SELECT unnest(['not_numeric', 'infinite']) AS k)
    UNION ALL SELECT 'Strike1', 'out_of_range', count(*) FILTER (Strike1 NOT BETWEEN 0 AND 360) FROM foc UNION ALL SELECT 'Dip1', 'out_of_range', count(*) FILTER (Dip1 + 15 NOT BETWEEN 0 AND 90) FROM foc
    UNION ALL SELECT 'Rake1', 'out_of_range', count(*) FILTER (Rake1 NOT BETWEEN -180 AND 180) FROM foc
    UNION ALL SELECT 'MAG', unnest(['too_large', 'too_small']), 0 UNION ALL SELECT 'ID', unnest(['missing', 'duplicate', 'too_long', 'no_prefix']), 0)"""


@book.add("v4_focal_checks", _STRUCTURE)
def _v4(spark, d):
    return quality.check_focals(derived.focals(spark, d).select("ID", "X", "Y", "Z", "MAG", "A", "Strike1", (F.col("Dip1") + 15).alias("Dip1"), "Rake1"))


@book.add("f1_sane_magnitude", "SELECT ID, CASE WHEN MAG * 4 - 6 BETWEEN -3 AND 10 THEN MAG * 4 - 6 END AS Mw FROM cat")
def _f1(spark, d):
    return derived.catalog(spark, d).select("ID", magnitude.sane_mw(F.col("MAG") * 4 - 6).alias("Mw"))


_PLANES = {"normal_vector_x": "CASE WHEN eid % 9 <> 0 THEN CAST(1 AS DOUBLE) END", "normal_vector_y": "CAST(0 AS DOUBLE)", "normal_vector_z": "CAST(0 AS DOUBLE)", "rupt_radius": "CAST(CASE WHEN eid % 501 = 0 THEN 1000000 ELSE eid % 50 END AS DOUBLE)"}
PLANES_CTE = f"pl AS (SELECT ID, eid, {', '.join(f'{e} AS {c}' for c, e in _PLANES.items())} FROM cat)"


def _planes(spark, d):
    return derived.catalog(spark, d).selectExpr("ID", "eid", *(f"{e} AS {c}" for c, e in _PLANES.items()))


book.add("f2_valid_planes", "SELECT ID, rupt_radius FROM pl WHERE normal_vector_x IS NOT NULL AND rupt_radius > 0", PLANES_CTE)(lambda s, d: quality.valid_planes(_planes(s, d)).select("ID", "rupt_radius"))
book.add("f3_corrupt_radius_cap", "SELECT ID, rupt_radius FROM pl WHERE rupt_radius <= 100 * (SELECT quantile_cont(rupt_radius, 0.99) FROM pl)", PLANES_CTE)(lambda s, d: quality.without_corrupt_radii(_planes(s, d)).select("ID", "rupt_radius"))

book.add("j3_match_by_id", "SELECT c.ID, c.MAG, f.MAG AS MAG_fm, Strike1, Dip1, Rake1, A FROM cat c LEFT JOIN foc f USING (ID)")(
    lambda s, d: matching.match_by_id(derived.catalog(s, d), derived.focals(s, d)).select("ID", "MAG", "MAG_fm", "Strike1", "Dip1", "Rake1", "A"))

_FT = "ft AS (SELECT CONCAT('FM', eid) AS ID, eid, Date, Strike1 FROM foc)"


@book.add("j4_match_by_time", """SELECT c.ID, f.ID AS ID_fm, f.Strike1 FROM cat c LEFT JOIN (SELECT c.ID, max((epoch_us(f.Date), f.ID)) AS k FROM cat c JOIN ft f ON epoch_us(c.Date) - epoch_us(f.Date) BETWEEN 0 AND 60000000 GROUP BY c.ID) b ON b.ID = c.ID
    LEFT JOIN ft f ON f.ID = b.k[2]""", _FT)  # fmt: skip
def _j4(spark, d):
    fm = derived.focals(spark, d).selectExpr("CONCAT('FM', eid) AS ID", "Date", "Strike1")
    return matching.match_focals(derived.catalog(spark, d), fm).select("ID", "ID_fm", "Strike1")


@book.add("s17_focal_consistency", """SELECT c.ID, f.A, CASE WHEN round(abs(c.MAG - f.MAG), 9) > 0.2 THEN NULL ELSE f.Strike1 END AS Strike1, f.X IS NOT NULL OR NULL AS loc_ok FROM cat c LEFT JOIN foc f USING (ID)""")
def _s17(spark, d):
    return matching.null_inconsistent(matching.match_by_id(derived.catalog(spark, d), derived.focals(spark, d))).select("ID", "A", "Strike1", "loc_ok")


book.add("s18_numeric_key", "SELECT ID, regexp_replace(ID, '[^0-9]', '', 'g') AS key FROM cat")(lambda s, d: derived.catalog(s, d).select("ID", focal.numeric_key(F.col("ID")).alias("key")))


@book.add("j5_enrich", "SELECT c.ID, coalesce(r.sequence_label, 'unclustered') AS sequence_label, r.rupture_plane_dip FROM cat c LEFT JOIN (SELECT * FROM hyp WHERE sequence_label <> 'unclustered') r USING (ID)")
def _j5(spark, d):
    results = derived.hypocenters(spark, d).filter("sequence_label <> 'unclustered'").select("ID", "sequence_label", "rupture_plane_dip")
    return matching.enrich(derived.catalog(spark, d), results).select("ID", "sequence_label", "rupture_plane_dip")


_AP = "ap AS (SELECT ID, unnest([CASE WHEN eid % 3 = 0 THEN 'Not determined (other reason)' ELSE 'Newly determined (A=0, geometric selection)' END, 'Not determined (no computed rupture plane)']) AS plane_determination_method, unnest([CASE WHEN eid % 3 = 0 THEN NULL ELSE eid % 45 END, NULL])::DOUBLE AS epsilon FROM foc)"
_BEST = "SELECT * FROM ap QUALIFY row_number() OVER (PARTITION BY ID ORDER BY starts_with(plane_determination_method, 'Not'), epsilon NULLS LAST, plane_determination_method) = 1"


def _ap(spark, d):
    e = "explode(array(struct(if(eid % 3 = 0, 'Not determined (other reason)', 'Newly determined (A=0, geometric selection)') AS m, if(eid % 3 = 0, NULL, CAST(eid % 45 AS DOUBLE)) AS e), struct('Not determined (no computed rupture plane)' AS m, NULL AS e)))"
    return derived.focals(spark, d).selectExpr("ID", f"{e} AS r").selectExpr("ID", "r.m AS plane_determination_method", "r.e AS epsilon")


book.add("d3_prefer_determined", _BEST, _AP)(lambda s, d: matching.prefer_determined(_ap(s, d)))
book.add("j6_enrich_focals", f"""SELECT f.ID, coalesce(h.sequence_label, 'unclustered') AS sequence_label, h.fault_id, CASE WHEN h.sequence_label <> 'unclustered' THEN h.sequence_label[1] END AS segmentation_level,
    coalesce(h.sequence_label, 'unclustered') <> 'unclustered' AS is_clustered, b.plane_determination_method, b.epsilon FROM foc f LEFT JOIN (SELECT * FROM hyp WHERE sequence_label <> 'unclustered') h USING (ID) LEFT JOIN ({_BEST}) b USING (ID)""", _AP)(
    lambda s, d: matching.enrich_focals(derived.focals(s, d).select("ID"), derived.hypocenters(s, d).filter("sequence_label <> 'unclustered'"), _ap(s, d)))
book.add("j7_semi_by_id", "SELECT count(*) AS n FROM foc WHERE ID IN (SELECT ID FROM hyp WHERE sequence_label <> 'unclustered')")(lambda s, d: derived.focals(s, d).join(derived.hypocenters(s, d).filter("sequence_label <> 'unclustered'"), "ID", "left_semi").agg(F.count(F.lit(1)).alias("n")))
book.add("j11_anti_by_id", "SELECT ID, MAG FROM cat WHERE ID NOT IN (SELECT ID FROM hyp WHERE sequence_label <> 'unclustered')")(
    lambda s, d: derived.catalog(s, d).join(derived.hypocenters(s, d).filter("sequence_label <> 'unclustered'"), "ID", "left_anti").select("ID", "MAG"))
book.add("d1_union_results", "SELECT ID, 'A' AS source_cluster, MAG, NULL::DOUBLE AS Z FROM hyp WHERE segmentation_level = 'A' UNION ALL SELECT ID, 'B', NULL, Z FROM hyp WHERE segmentation_level = 'B'")(
    lambda s, d: (h := derived.hypocenters(s, d)).filter("segmentation_level = 'A'").select("ID", F.lit("A").alias("source_cluster"), "MAG")
    .unionByName(h.filter("segmentation_level = 'B'").select("ID", F.lit("B").alias("source_cluster"), "Z"), allowMissingColumns=True))
book.add("d4_metadata_upsert", "SELECT fault_id, n_events FROM meta WHERE fault_id >= 'F0020' UNION ALL SELECT fault_id, -1 FROM meta WHERE fault_id < 'F0020'")(
    lambda s, d: matching.upsert((m := derived.metadata(s, d)).select("fault_id", "n_events"), m.filter("fault_id < 'F0020'").select("fault_id", F.lit(-1).cast("long").alias("n_events")), "fault_id"))
_SUM = "su AS (SELECT ID, A, eid, CASE WHEN eid % 2 = 0 THEN 1 + eid % 4 // 2 END AS pref_foc, CASE WHEN eid % 2 = 0 THEN CAST(eid % 90 AS DOUBLE) + 0.25 END AS epsilon, CASE WHEN eid % 3 <> 0 THEN 10.0::DOUBLE END AS az, Strike1, Dip1, Rake1 FROM foc)"
_METHOD = "CASE WHEN pref_foc IS NOT NULL THEN CASE WHEN A IN (1, 2) THEN 'Pre-specified (A=1 or A=2)' ELSE 'Newly determined (A=0, geometric selection)' END WHEN A IN (1, 2) THEN 'Not determined (A specified but no rupture plane)' WHEN az IS NULL THEN 'Not determined (no computed rupture plane)' ELSE 'Not determined (other reason)' END"


def _sum(spark, d):
    df = derived.focals(spark, d).selectExpr("ID", "A", "if(eid % 2 = 0, CAST(1 + eid % 4 DIV 2 AS INT), NULL) AS pref_foc", "if(eid % 2 = 0, eid % 90 + 0.25D, NULL) AS epsilon", "if(eid % 3 <> 0, 10.0D, NULL) AS rupture_plane_azimuth", "Strike1", "Dip1", "Rake1", "Strike1 + 1 AS Strike2", "Dip1 + 2 AS Dip2", "Rake1 + 3 AS Rake2")
    return matching.active_plane_summary(df)


book.add("s11_s12_active_planes", f"""SELECT ID, {_METHOD} AS plane_determination_method, round(epsilon, 1) AS epsilon, CASE pref_foc WHEN 1 THEN Strike1 WHEN 2 THEN Strike1 + 1 END AS preferred_strike,
    CASE pref_foc WHEN 1 THEN Dip1 WHEN 2 THEN Dip1 + 2 END AS preferred_dip, CASE pref_foc WHEN 1 THEN Rake1 WHEN 2 THEN Rake1 + 3 END AS preferred_rake FROM su""", _SUM)(
    lambda s, d: _sum(s, d).select("ID", "plane_determination_method", "epsilon", "preferred_strike", "preferred_dip", "preferred_rake"))
book.add("w6_ordered_report", f"SELECT ID, {_METHOD} AS plane_determination_method, round(epsilon, 1) AS epsilon FROM su", _SUM)(
    lambda s, d: _sum(s, d).orderBy("rank", F.col("epsilon").asc_nulls_last(), "ID").select("ID", "plane_determination_method", "epsilon"))
book.add("a16_active_plane_stats", f"""SELECT plane_determination_method, count(*) AS n, round(avg(e), 6) AS mean_epsilon, round(median(e), 6) AS median_epsilon, min(e) AS min_epsilon, max(e) AS max_epsilon
    FROM (SELECT {_METHOD} AS plane_determination_method, round(epsilon, 1) AS e FROM su) GROUP BY 1""", _SUM)(
    lambda s, d: matching.active_plane_stats(_sum(s, d)).withColumns({c: F.round(c, 6) for c in ("mean_epsilon", "median_epsilon")}))
book.add("j10_a15_agreement", """SELECT count(*) AS n_compared, round(avg(e), 6) AS mean_angular_diff, round(median(e), 6) AS median_angular_diff, round(avg((e < 30)::INT), 6) AS share_below_30, round(avg((e < 15)::INT), 6) AS share_below_15,
    round(avg(CASE WHEN A IN (1, 2) THEN (1 + eid % 2 = A)::INT END), 6) AS active_plane_match_rate, count(*) FILTER (A = 0) AS n_unknown, round(avg(e) FILTER (A = 0), 6) AS mean_unknown
    FROM (SELECT *, CAST(eid % 90 AS DOUBLE) AS e FROM foc WHERE eid % 3 <> 0)""")(
    lambda s, d: (lambda r: r.select(*(F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in r.dtypes)))(matching.agreement(derived.catalog(s, d).selectExpr("ID", "if(eid % 3 = 0, NULL, CAST(eid % 90 AS DOUBLE)) AS epsilon", "1 + eid % 2 AS pref_geom"), derived.focals(s, d))))
