"""Analytical queries on the fault database, and its input and output operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import new_folder
from ..sources import database, derived, versions
from .register import Book

book = Book()
QUERIES, ORACLE_SQL = book.queries, book.sql


def fault_systems_overview(metadata: DataFrame, min_events: int = 5) -> DataFrame:
    r = lambda c, n, name: F.round(c, n).alias(name)
    return (
        metadata.filter(F.col("n_events") >= min_events)
        .select("fault_id", "sequence_label", "n_events", r("rupture_mean_azimuth", 1, "azimuth"), r("rupture_mean_dip", 1, "dip"), r(F.col("mesh_area_m2") / 1e6, 2, "area_km2"), r("max_mag", 2, "max_mag"), r("rupture_mean_instability", 3, "instability"))
        .orderBy("fault_id")
    )


def events_by_fault_system(hypocenters: DataFrame) -> DataFrame:
    g = hypocenters.filter("fault_id IS NOT NULL").groupBy("fault_id", "sequence_label")
    return g.agg(
        F.count(F.lit(1)).alias("num_events"),
        F.round(F.avg("MAG"), 2).alias("avg_magnitude"),
        F.round(F.min("MAG"), 2).alias("min_mag"),
        F.round(F.max("MAG"), 2).alias("max_mag"),
        F.count("rupture_plane_azimuth").alias("with_planes"),
        F.count("instability_index").alias("with_stress"),
    ).orderBy(F.desc("num_events"), "fault_id", "sequence_label")


def high_instability_faults(metadata: DataFrame, limit: int = 10) -> DataFrame:
    top = metadata.filter("rupture_mean_instability IS NOT NULL").orderBy(F.desc("rupture_mean_instability"), "fault_id").limit(limit)
    r = lambda c, name: F.round(c, 3).alias(name)
    return top.select("fault_id", "n_events", r("rupture_mean_instability", "instability"), r("rupture_mean_sliptend", "slip_tendency"), r("rupture_mean_dilatend", "dilation_tendency"), r("mesh_mean_instability", "mesh_instability"))


def magnitude_distribution(hypocenters: DataFrame, bin_size: float = 0.1) -> DataFrame:
    g = hypocenters.groupBy((F.round(F.col("MAG") / bin_size) * bin_size).alias("mag_bin"))
    return g.agg(F.count(F.lit(1)).alias("event_count"), F.count("fault_id").alias("in_fault_system")).orderBy(F.col("mag_bin").asc_nulls_last())


def spatial_query(hypocenters: DataFrame, x: float, y: float, radius_km: float = 5.0, limit: int = 50) -> DataFrame:
    """Events nearer than the radius; the surrounding box is a pushed-down filter before the exact distance."""
    r = radius_km * 1000
    box = hypocenters.filter(F.col("X").between(x - r, x + r) & F.col("Y").between(y - r, y + r))
    d = F.sqrt((F.col("X") - x) * (F.col("X") - x) + (F.col("Y") - y) * (F.col("Y") - y))
    near = box.withColumn("d", d).filter(F.col("d") < r).orderBy("d", "ID").limit(limit)
    return near.select("ID", "fault_id", F.round("MAG", 2).alias("magnitude"), F.round("X", 0).alias("x"), F.round("Y", 0).alias("y"), F.round("Z", 0).alias("z"), F.round(F.col("d") / 1000, 2).alias("distance_km"))


def focal_mechanisms_summary(focals: DataFrame) -> DataFrame:
    g = focals.filter("is_clustered").groupBy("fault_id", "segmentation_level")
    out = g.agg(F.count(F.lit(1)).alias("num_focals"), F.round(F.avg("Dip1"), 1).alias("avg_dip1"), F.round(F.avg("Dip2"), 1).alias("avg_dip2"), F.round(F.avg("Rake1"), 1).alias("avg_rake1"), F.count("A").alias("with_active_plane"))
    return out.orderBy(F.desc("num_focals"), F.col("fault_id").asc_nulls_last(), F.col("segmentation_level").asc_nulls_last())


def summary_statistics(metadata: DataFrame) -> DataFrame:
    return metadata.agg(
        F.count(F.lit(1)).alias("total_fault_systems"),
        F.sum("n_events").alias("total_events_in_faults"),
        F.round(F.avg("n_events"), 1).alias("avg_events_per_fault"),
        F.round(F.sum("mesh_area_m2") / 1e6, 2).alias("total_area_km2"),
        F.round(F.avg("rupture_mean_instability"), 3).alias("avg_instability"),
        F.round(F.max("max_mag"), 2).alias("max_potential_mag"),
    )


def depth_distribution(hypocenters: DataFrame, min_depth: float = -30000, max_depth: float = 0) -> DataFrame:
    g = hypocenters.filter(F.col("Z").between(min_depth, max_depth)).groupBy(F.round(F.col("Z") / 1000, 1).alias("depth_km"))
    return g.agg(F.count(F.lit(1)).alias("event_count"), F.count("fault_id").alias("in_fault_system"), F.round(F.avg("MAG"), 2).alias("avg_magnitude")).orderBy(F.desc("depth_km"))


def temporal_distribution(hypocenters: DataFrame, time_column: str = "Date") -> DataFrame:
    t = F.col(time_column)
    g = hypocenters.filter(t.isNotNull()).groupBy(F.year(t).alias("year"), F.month(t).alias("month"))
    return g.agg(F.count(F.lit(1)).alias("event_count"), F.count("fault_id").alias("in_fault_system")).orderBy("year", "month")


def _matching(table: DataFrame, fault_id: str) -> DataFrame:
    """Rows of the fault, or, if it has none, of the first fault whose id contains fault_id."""
    like = table.filter(F.col("fault_id").contains(fault_id))
    best = like.agg(F.min(F.struct((F.col("fault_id") != fault_id).alias("other"), "fault_id")).alias("m")).select(F.col("m.fault_id").alias("fault_id"))
    return like.join(F.broadcast(best), "fault_id")


def fault_system_details(metadata: DataFrame, hypocenters: DataFrame, focals: DataFrame, fault_id: str) -> dict[str, DataFrame]:
    """metadata, events and focals of one fault; if metadata doesn't know it, available_ids: the first ten known ids."""
    own = metadata.filter(F.col("fault_id") == fault_id)
    if own.isEmpty():
        return {"available_ids": metadata.select("fault_id").distinct().orderBy("fault_id").limit(10)}
    events = _matching(hypocenters, fault_id).select("ID", "MAG", "X", "Y", "Z", "rupture_plane_azimuth", "rupture_plane_dip", "instability_index", "slip_tendency", "dilation_tendency")
    return {"metadata": own, "events": events.orderBy(F.col("MAG").desc_nulls_last(), "ID"), "focals": _matching(focals, fault_id).orderBy(F.col("segmentation_level").asc_nulls_last())}


def list_faults(metadata: DataFrame, hypocenters: DataFrame, focals: DataFrame) -> DataFrame:
    """Every fault id with its rows in the three tables."""
    parts = [t.filter("fault_id IS NOT NULL").groupBy("fault_id").agg(F.count(F.lit(1)).alias("n")).withColumn("t", F.lit(n)) for n, t in (("in_metadata", metadata), ("in_hypocenters", hypocenters), ("in_focals", focals))]
    rows = parts[0].union(parts[1]).union(parts[2])
    return rows.groupBy("fault_id").agg(*(F.coalesce(F.sum(F.when(F.col("t") == n, F.col("n"))), F.lit(0)).alias(n) for n in ("in_metadata", "in_hypocenters", "in_focals")))


def _on(name: str, f, table: str, sql: str) -> None:
    book.add(name, sql)(lambda spark, d: f(getattr(derived, table)(spark, d)))


_on("q1_fault_systems_overview", fault_systems_overview, "metadata", """SELECT fault_id, sequence_label, n_events, round(rupture_mean_azimuth, 1) AS azimuth, round(rupture_mean_dip, 1) AS dip,
    round(mesh_area_m2 / 1e6, 2) AS area_km2, round(max_mag, 2) AS max_mag, round(rupture_mean_instability, 3) AS instability FROM meta WHERE n_events >= 5""")
_on("q2_events_by_fault_system", events_by_fault_system, "hypocenters", """SELECT fault_id, sequence_label, count(*) AS num_events, round(avg(MAG), 2) AS avg_magnitude, round(min(MAG), 2) AS min_mag, round(max(MAG), 2) AS max_mag,
    count(*) FILTER (rupture_plane_azimuth IS NOT NULL) AS with_planes, count(*) FILTER (instability_index IS NOT NULL) AS with_stress FROM hyp WHERE fault_id IS NOT NULL GROUP BY ALL""")
_on("q3_high_instability_faults", high_instability_faults, "metadata", """SELECT fault_id, n_events, round(rupture_mean_instability, 3) AS instability, round(rupture_mean_sliptend, 3) AS slip_tendency,
    round(rupture_mean_dilatend, 3) AS dilation_tendency, round(mesh_mean_instability, 3) AS mesh_instability FROM meta WHERE rupture_mean_instability IS NOT NULL ORDER BY rupture_mean_instability DESC, fault_id LIMIT 10""")
_on("q4_magnitude_distribution", magnitude_distribution, "hypocenters", "SELECT round(MAG / 0.1::DOUBLE) * 0.1::DOUBLE AS mag_bin, count(*) AS event_count, count(fault_id) AS in_fault_system FROM hyp GROUP BY 1")
book.add("q5_spatial_query", """SELECT ID, fault_id, round(MAG, 2) AS magnitude, round(X, 0) AS x, round(Y, 0) AS y, round(Z, 0) AS z, round(d / 1000, 2) AS distance_km FROM
    (SELECT *, sqrt((X - 598000) * (X - 598000) + (Y - 128000) * (Y - 128000)) AS d FROM hyp) WHERE d < 5000 ORDER BY d, ID LIMIT 50""")(lambda s, d: spatial_query(derived.hypocenters(s, d), 598000.0, 128000.0))  # fmt: skip
_on("q6_focal_mechanisms_summary", focal_mechanisms_summary, "focal_table", """SELECT fault_id, segmentation_level, count(*) AS num_focals, round(avg(Dip1), 1) AS avg_dip1, round(avg(Dip2), 1) AS avg_dip2, round(avg(Rake1), 1) AS avg_rake1,
    count(A) AS with_active_plane FROM foct WHERE is_clustered GROUP BY ALL""")
_on("q7_summary_statistics", summary_statistics, "metadata", """SELECT count(*) AS total_fault_systems, CAST(sum(n_events) AS BIGINT) AS total_events_in_faults, round(avg(n_events), 1) AS avg_events_per_fault,
    round(sum(mesh_area_m2) / 1e6, 2) AS total_area_km2, round(avg(rupture_mean_instability), 3) AS avg_instability, round(max(max_mag), 2) AS max_potential_mag FROM meta""")
_on("q8_depth_distribution", depth_distribution, "hypocenters", """SELECT round(Z / 1000, 1) AS depth_km, count(*) AS event_count, count(fault_id) AS in_fault_system, round(avg(MAG), 2) AS avg_magnitude
    FROM hyp WHERE Z BETWEEN -30000 AND 0 GROUP BY 1""")
_on("q9_temporal_distribution", temporal_distribution, "hypocenters", """SELECT CAST(year(Date) AS INT) AS year, CAST(month(Date) AS INT) AS month, count(*) AS event_count, count(fault_id) AS in_fault_system FROM hyp WHERE Date IS NOT NULL GROUP BY 1, 2""")


def _details(part: str):
    return lambda s, d: fault_system_details(derived.metadata(s, d), derived.hypocenters(s, d), derived.focal_table(s, d), "F0005")[part]


book.add("q10_fault_events", """SELECT ID, MAG, X, Y, Z, rupture_plane_azimuth, rupture_plane_dip, instability_index, slip_tendency, dilation_tendency FROM hyp WHERE fault_id = 'F0005'""")(_details("events"))
book.add("q10_fault_metadata", "SELECT * FROM meta WHERE fault_id = 'F0005'")(_details("metadata"))
book.add("q10_fault_focals", """SELECT * FROM foct WHERE fault_id = (SELECT CASE WHEN count(*) FILTER (fault_id = 'F0005') > 0 THEN 'F0005' ELSE min(fault_id) END FROM foct WHERE contains(fault_id, 'F0005'))""")(_details("focals"))
book.add("q10_available_ids", "SELECT DISTINCT fault_id FROM meta ORDER BY fault_id LIMIT 10")(lambda s, d: fault_system_details(derived.metadata(s, d), derived.hypocenters(s, d), derived.focal_table(s, d), "none")["available_ids"])
book.add("q11_list_faults", """SELECT fault_id, CAST(coalesce(sum(a), 0) AS BIGINT) AS in_metadata, CAST(coalesce(sum(b), 0) AS BIGINT) AS in_hypocenters, CAST(coalesce(sum(c), 0) AS BIGINT) AS in_focals FROM (SELECT fault_id, 1 AS a, NULL AS b, NULL AS c FROM meta
    UNION ALL SELECT fault_id, NULL, 1, NULL FROM hyp UNION ALL SELECT fault_id, NULL, NULL, 1 FROM foct) WHERE fault_id IS NOT NULL GROUP BY fault_id""")(
    lambda s, d: list_faults(derived.metadata(s, d), derived.hypocenters(s, d), derived.focal_table(s, d)))


@book.add("io7_free_sql", "SELECT sequence_label, count(*) AS n, max(MAG) AS top FROM hyp GROUP BY 1 HAVING count(*) > 3")
def _free(spark, d):
    return database.query(spark, "SELECT sequence_label, count(*) AS n, max(MAG) AS top FROM {hyp} GROUP BY 1 HAVING count(*) > 3", hyp=derived.hypocenters(spark, d))


@book.add("io8_event_results", """SELECT ID, eid, X, Y, Z, round(MAG, 3) AS MAG, strftime(Date, '%Y-%m-%dT%H:%M:%S.%f') AS Date, eid % 5 = 0 AS sequence_outlier, rupture_plane_azimuth, round(slip_tendency, 6) AS slip_tendency,
    CASE WHEN rupture_plane_azimuth IS NOT NULL THEN (rupture_plane_azimuth + 270) % 360 END AS rupture_plane_strike FROM hyp""")  # fmt: skip
def _results(spark, d):
    df = derived.hypocenters(spark, d).selectExpr("ID", "eid", "X", "Y", "Z", "MAG", "Date", "if(eid % 5 = 0, -1, eid % 3) AS clust_labels", "rupture_plane_azimuth AS rupt_plane_azi", "slip_tendency AS sliptend")
    return database.results(df)


@book.add("io10_run_summary", """SELECT count(*) AS total_events, count(rupture_plane_azimuth) AS with_planes, count(*) FILTER (eid % 25 = 0) AS validated_focals, count(instability_index) AS with_stress, count(DISTINCT fault_id) AS faults FROM hyp""")
def _summary(spark, d):
    return database.run_summary(derived.hypocenters(spark, d).selectExpr("*", "if(eid % 25 = 0, 1.0D, NULL) AS epsilon"))


@book.add("io11_temporal_attributes", """SELECT ID, CAST(floor(epoch(Date)) AS BIGINT) AS unix_timestamp, CAST(floor((floor(epoch(Date)) - (SELECT floor(epoch(min(Date))) FROM cat)) / 86400) AS BIGINT) AS days_since_first,
    round(year(Date) + dayofyear(Date) / 365.25, 9) AS decimal_year, CAST(month(Date) AS INT) AS month FROM cat""")  # fmt: skip
def _temporal(spark, d):
    return database.temporal_attributes(derived.catalog(spark, d)).select("ID", "unix_timestamp", "days_since_first", F.round("decimal_year", 9).alias("decimal_year"), "month")


@book.add("io9_versions", """SELECT 1 AS version, 'hypocenters' AS name, count(*) AS n, max(eid) AS top, CAST(round(sum(MAG), 3) AS DOUBLE) AS total FROM hyp UNION ALL SELECT 1, 'metadata', count(*), max(n_events), CAST(sum(n_events) AS DOUBLE) FROM meta
    UNION ALL SELECT 2, 'hypocenters', count(*), max(eid), CAST(round(sum(MAG), 3) AS DOUBLE) FROM hyp UNION ALL SELECT 2, 'metadata', count(*), max(CASE WHEN fault_id < 'F0020' THEN -1 ELSE n_events END), CAST(sum(CASE WHEN fault_id < 'F0020' THEN -1 ELSE n_events END) AS DOUBLE) FROM meta""")
def _versions(spark, d):
    """Writes the database, merges new metadata into a second version, and reads both versions back."""
    folder = new_folder(spark, "database")
    hyp, meta = derived.hypocenters(spark, d), derived.metadata(spark, d).select("fault_id", "n_events")
    first = versions.publish(spark, folder, {"hypocenters": hyp, "metadata": meta})
    new = meta.filter("fault_id < 'F0020'").select("fault_id", F.lit(-1).cast("long").alias("n_events"))
    versions.publish(spark, folder, {"metadata": new}, {"metadata": "fault_id"}, first)
    out = None
    for v in versions.versions(spark, folder):
        tables = versions.load(spark, folder, v)
        h = tables["hypocenters"].agg(F.count(F.lit(1)).alias("n"), F.max("eid").alias("top"), F.round(F.sum("MAG"), 3).alias("total"))
        m = tables["metadata"].agg(F.count(F.lit(1)).alias("n"), F.max("n_events").alias("top"), F.sum("n_events").cast("double").alias("total"))
        for name, t in (("hypocenters", h), ("metadata", m)):
            row = t.select(F.lit(v).alias("version"), F.lit(name).alias("name"), "n", "top", "total")
            out = row if out is None else out.union(row)
    return out


@book.add("io6_load_database", "SELECT * FROM (VALUES ('metadata', true, (SELECT count(*) FROM meta)), ('hypocenters', true, (SELECT count(*) FROM hyp)), ('focals', false, NULL)) t(name, loaded, n)")
def _load(spark, d):
    """Tables written and registered as views; the one that is not there is told, not raised."""
    folder = new_folder(spark, "database")
    database.write_database({"hypocenters": derived.hypocenters(spark, d), "metadata": derived.metadata(spark, d)}, folder)
    status = database.load_database(spark, {n: f"{folder}/{n}" for n in database.TABLES})
    counts = [spark.table(n).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n")) for n in ("metadata", "hypocenters")]
    return status.select("name", "loaded").join(counts[0].union(counts[1]), "name", "left")
