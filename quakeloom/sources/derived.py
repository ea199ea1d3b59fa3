"""Catalogs and database tables derived from the `events` table by exact arithmetic, in SQL that other engines read too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CATALOG = {
    "ID": "CONCAT('EV', CAST(event_id AS VARCHAR(20)))",
    "eid": "event_id",
    "X": "CAST(CASE WHEN event_id % 17 = 0 THEN 590000 + (event_id * 7919) % 32000 ELSE 590000 + (event_id % 8) * 4000 + (event_id * 7919) % 1009 - 504 END AS DOUBLE)",
    "Y": "CASE WHEN event_id % 17 = 0 THEN CAST(120000 + (event_id * 104729) % 20000 AS DOUBLE) ELSE CAST(120000 + (CAST(FLOOR(event_id / CAST(8 AS DOUBLE)) AS BIGINT) % 5) * 4000 AS DOUBLE)"
    " + CAST(((event_id * 7919) % 1009 - 504) * (event_id % 5 - 2) AS DOUBLE) / CAST(2 AS DOUBLE) + CAST((event_id * 1299709) % 101 - 50 AS DOUBLE) / CAST(4 AS DOUBLE) END",
    "Z": "CAST(CASE WHEN event_id % 17 = 0 THEN -1000 - (event_id * 15485863) % 9000 ELSE -5000 - ((event_id * 104729) % 1013 - 506) END AS DOUBLE)",
    "EX": "CAST(10 + event_id % 7 AS DOUBLE)",
    "EY": "CAST(10 + event_id % 5 AS DOUBLE)",
    "EZ": "CAST(20 + event_id % 11 AS DOUBLE)",
    "MAG": "CAST((event_id * 31) % 45 - 5 AS DOUBLE) / CAST(10 AS DOUBLE)",
    "Date": "CAST(ts AS TIMESTAMP)",
}

#: Over the catalog: one focal mechanism for each 25th event, up to 39 s before it, one in five off in magnitude.
FOCALS = {
    "ID": "ID",
    "eid": "eid",
    "X": "X",
    "Y": "Y",
    "Z": "Z",
    "lead_s": "eid % 40",
    "Date": None,  # Date less lead_s seconds, spelled by each engine
    "MAG": "MAG + CASE WHEN eid % 125 = 0 THEN 0.5E0 ELSE 0.1E0 END",
    "A": "CAST(CAST(FLOOR(eid / CAST(25 AS DOUBLE)) AS BIGINT) % 3 AS INT)",
    "Strike1": "CAST((eid * 37) % 361 AS DOUBLE)",
    "Dip1": "CAST(30 + (eid * 13) % 61 AS DOUBLE)",
    "Rake1": "CAST((eid * 53) % 361 - 180 AS DOUBLE)",
}

HYPOCENTERS = {
    **{c: c for c in ("ID", "eid", "X", "Y", "Z", "MAG", "Date")},
    "fault_id": "CASE WHEN eid % 17 <> 0 THEN CONCAT('F', LPAD(CAST(eid % 40 AS VARCHAR(9)), 4, '0')) END",
    "sequence_label": "CASE WHEN eid % 17 = 0 THEN 'unclustered' ELSE CONCAT(CASE WHEN eid % 2 = 0 THEN 'A' ELSE 'B' END, CAST(eid % 8 + 1 AS VARCHAR(9))) END",
    "segmentation_level": "CASE WHEN eid % 17 <> 0 THEN CASE WHEN eid % 2 = 0 THEN 'A' ELSE 'B' END END",
    "rupture_plane_azimuth": "CASE WHEN eid % 9 <> 0 THEN CAST((eid * 37) % 360 AS DOUBLE) END",
    "rupture_plane_dip": "CASE WHEN eid % 9 <> 0 THEN CAST((eid * 13) % 91 AS DOUBLE) END",
    "instability_index": "CASE WHEN eid % 9 <> 0 THEN CAST((eid * 7) % 65 AS DOUBLE) / CAST(64 AS DOUBLE) END",
    "slip_tendency": "CASE WHEN eid % 9 <> 0 THEN CAST((eid * 11) % 65 AS DOUBLE) / CAST(64 AS DOUBLE) END",
    "dilation_tendency": "CASE WHEN eid % 9 <> 0 THEN CAST((eid * 3) % 65 AS DOUBLE) / CAST(64 AS DOUBLE) END",
}

METADATA = """SELECT fault_id, MIN(sequence_label) AS sequence_label, COUNT(*) AS n_events, AVG(X) AS centroid_x, AVG(Y) AS centroid_y, AVG(Z) AS centroid_z,
    AVG(rupture_plane_azimuth) AS rupture_mean_azimuth, AVG(rupture_plane_dip) AS rupture_mean_dip, CAST(COUNT(*) AS DOUBLE) * 12500 AS mesh_area_m2, MAX(MAG) + 1 AS max_mag,
    CASE WHEN fault_id < 'F0036' THEN AVG(instability_index) END AS rupture_mean_instability, AVG(slip_tendency) AS rupture_mean_sliptend, AVG(dilation_tendency) AS rupture_mean_dilatend,
    AVG(instability_index) / 2 AS mesh_mean_instability FROM {hypocenters} WHERE fault_id IS NOT NULL GROUP BY fault_id"""

FOCAL_TABLE = {
    **{c: c for c in ("ID", "eid", "MAG", "A", "Strike1", "Dip1", "Rake1")},
    "Strike2": "CAST((eid * 41) % 361 AS DOUBLE)",
    "Dip2": "CAST(20 + (eid * 17) % 71 AS DOUBLE)",
    "Rake2": "CAST((eid * 59) % 361 - 180 AS DOUBLE)",
    "fault_id": "CASE WHEN eid % 17 <> 0 THEN CONCAT('F', LPAD(CAST(eid % 40 AS VARCHAR(9)), 4, '0')) END",
    "segmentation_level": "CASE WHEN eid % 17 <> 0 THEN CASE WHEN eid % 2 = 0 THEN 'A' ELSE 'B' END END",
    "is_clustered": "eid % 17 <> 0",
}


def _list(columns: dict[str, str | None]) -> list[str]:
    return [f"{e} AS {n}" for n, e in columns.items()]


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*_list(CATALOG))


def focals(spark: SparkSession, sf_dir: str) -> DataFrame:
    spelled = FOCALS | {"Date": "timestamp_micros(unix_micros(Date) - (eid % 40) * 1000000L)"}
    return catalog(spark, sf_dir).filter("eid % 25 = 0").selectExpr(*_list(spelled))


def hypocenters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).selectExpr(*_list(HYPOCENTERS))


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(METADATA.format(hypocenters="{h}"), h=hypocenters(spark, sf_dir))


def focal_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return focals(spark, sf_dir).selectExpr(*_list(FOCAL_TABLE))


def _select(columns: dict, source: str) -> str:
    return f"SELECT {', '.join(_list(columns))} FROM {source}"


#: The same tables as common table expressions for SQL checks: cat, foc, hyp, meta, foct.
CTE = f"""cat AS ({_select(CATALOG, 'events')}),
foc AS ({_select(FOCALS | {'Date': 'Date - to_seconds(eid % 40)'}, 'cat')} WHERE eid % 25 = 0),
hyp AS ({_select(HYPOCENTERS, 'cat')}), meta AS ({METADATA.format(hypocenters='hyp')}), foct AS ({_select(FOCAL_TABLE, 'foc')})"""
