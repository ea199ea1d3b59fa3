"""The fault database: its tables as views, free SQL on them, and writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("metadata", "hypocenters", "focals")

#: Names of result columns against those of the calculation. Fixed values.
RESULT_NAMES = {
    "clust_labels": "sequence_outlier", "nor_x_mean": "normal_vector_x", "nor_y_mean": "normal_vector_y", "nor_z_mean": "normal_vector_z", "R": "nvector_quality_R", "N": "nvector_quality_N",
    "R/N": "nvector_quality_ratio", "nr_fits": "nr_rupt_fits", "rupt_plane_azi": "rupture_plane_azimuth", "rupt_plane_dip": "rupture_plane_dip", "Sn_eff": "effective_normal_stress", "Tau": "shear_stress",
    "rake": "rake_angle", "instab": "instability_index", "sliptend": "slip_tendency", "dilatend": "dilation_tendency",
}
#: Decimals of result columns; other doubles have three. Fixed values.
SIX_DECIMALS = ("LAT", "LON", "normal_vector_x", "normal_vector_y", "normal_vector_z", "instability_index", "slip_tendency", "dilation_tendency")


def load_database(spark: SparkSession, paths: dict[str, str], form: str = "parquet") -> DataFrame:
    """Register each table that can be read as a view. Returns name, loaded, message, one row per table."""
    from pyspark.errors import AnalysisException

    status = []
    for name in TABLES:
        try:
            reader = spark.read.option("header", True).option("inferSchema", True)
            reader.format(form).load(paths[name]).createOrReplaceTempView(name)
            status.append((name, True, "ok"))
        except (KeyError, AnalysisException) as e:
            status.append((name, False, "no path" if isinstance(e, KeyError) else str(e).splitlines()[0][:200]))
    return spark.createDataFrame(status, "name string, loaded boolean, message string")


def query(spark: SparkSession, sql: str, **views: DataFrame) -> DataFrame:
    """Any SQL, on registered views or on DataFrames given by name (written {name} in the text)."""
    return spark.sql(sql, **views)


def list_tables(spark: SparkSession) -> DataFrame:
    return spark.sql("SHOW TABLES").select(F.col("tableName").alias("name"))


def table_info(spark: SparkSession, name: str) -> DataFrame:
    return spark.sql(f"DESCRIBE {name}").select("col_name", "data_type")


def results(events: DataFrame) -> DataFrame:
    """Event results with their public names, the strike, rounded values and ISO-8601 times. -1 marks a sequence outlier."""
    df = events.withColumnsRenamed({a: b for a, b in RESULT_NAMES.items() if a in events.columns})
    if "sequence_outlier" in df.columns:
        df = df.withColumn("sequence_outlier", F.col("sequence_outlier") == -1)
    if "rupture_plane_azimuth" in df.columns:
        df = df.withColumn("rupture_plane_strike", F.pmod(F.col("rupture_plane_azimuth") - 90, F.lit(360.0)))
    kinds = dict(df.dtypes)
    rounded = {c: F.round(c, 6 if c in SIX_DECIMALS else 3) for c, k in kinds.items() if k in ("double", "float")}
    stamps = {c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") for c, k in kinds.items() if k.startswith("timestamp")}
    return df.withColumns(rounded | stamps)


def write_results(events: DataFrame, path: str, form: str = "parquet", by: str | None = None) -> None:
    writer = results(events).write.mode("overwrite").format(form).option("header", True)
    (writer.partitionBy(by) if by else writer).save(path)


def write_database(tables: dict[str, DataFrame], folder: str, form: str = "parquet") -> None:
    """hypocenters by segmentation level, the other tables whole; each is replaced."""
    for name, df in tables.items():
        write_results(df, f"{folder}/{name}", form, "segmentation_level" if name == "hypocenters" and "segmentation_level" in df.columns else None)


def run_summary(events: DataFrame) -> DataFrame:
    """One row of counts over an event table."""
    return events.agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count("rupture_plane_azimuth").alias("with_planes"),
        F.count("epsilon").alias("validated_focals"),
        F.count("instability_index").alias("with_stress"),
        F.countDistinct("fault_id").alias("faults"),
    )


def temporal_attributes(events: DataFrame) -> DataFrame:
    """events with unix_timestamp, days_since_first (whole days), decimal_year and month."""
    first = events.agg(F.min(F.unix_timestamp("Date")).alias("_first"))
    df = events.crossJoin(F.broadcast(first)).withColumn("unix_timestamp", F.unix_timestamp("Date"))
    df = df.withColumn("days_since_first", F.floor((F.col("unix_timestamp") - F.col("_first")) / 86400))
    return df.withColumn("decimal_year", F.year("Date") + F.dayofyear("Date") / 365.25).withColumn("month", F.month("Date")).drop("_first")
