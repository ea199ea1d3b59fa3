"""Data-quality checks of both catalogs: every check over all rows, in one aggregate per catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import FOCAL_COLUMNS, HYPOCENTER_COLUMNS, OPTIONAL_FOCAL_COLUMNS

#: Accepted ranges. Fixed values.
HYPOCENTER_RANGES = {"LAT": (-90, 90), "LON": (-180, 180), "DEPTH": (0, 1000), "YR": (1900, 2030), "MO": (1, 12), "DY": (1, 31), "HR": (0, 23), "MI": (0, 59)}
FOCAL_RANGES = {"Strike1": (0, 360), "Dip1": (0, 90), "Rake1": (-180, 180), "Strike2": (0, 360), "Dip2": (0, 90), "Rake2": (-180, 180), "Pazim": (0, 360), "Pdip": (0, 90), "Tazim": (0, 360), "Tdip": (0, 90)}
WHOLE = ("YR", "MO", "DY", "HR", "MI")
ERRORS = ("EX", "EY", "EZ")
#: Checks that make a catalog invalid.
FATAL = ("missing_column", "missing", "duplicate", "too_large", "too_small")


def missing_columns(columns: list[str], required: tuple[str, ...], optional: tuple[str, ...] = ()) -> tuple[list[str], list[str]]:
    """Required columns that are absent, and columns that are not known."""
    return [c for c in required if c not in columns and c not in optional], [c for c in columns if c not in required]


def number(c: str) -> Column:
    return F.expr(f"try_cast(trim(CAST(`{c}` AS STRING)) AS DOUBLE)")


def _count(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def _checks(df: DataFrame, ranges: dict[str, tuple[float, float]], numeric: list[str]) -> dict[tuple[str, str], Column]:
    have = set(df.columns)
    out: dict[tuple[str, str], Column] = {}
    for c in (c for c in numeric if c in have):
        x = number(c)
        out[c, "not_numeric"] = _count(F.col(c).isNotNull() & x.isNull())
        out[c, "infinite"] = _count(F.abs(x) == float("inf"))
        if c in ranges:
            low, high = ranges[c]
            out[c, "out_of_range"] = _count(~x.between(low, high))
        if c in WHOLE:
            out[c, "not_whole"] = _count(x % 1 != 0)
        if c in ERRORS:
            out[c, "not_positive"] = _count(x <= 0)
            out[c, "over_10_km"] = _count(x > 10_000)
    if "MAG" in have:
        out["MAG", "too_large"] = _count(number("MAG") > 10)
        out["MAG", "too_small"] = _count(number("MAG") < -3)
    return out


def _id_checks(df: DataFrame) -> DataFrame:
    """missing, duplicate, too_long and no_prefix counts of ID; the prefix is asked for if the smallest ID has it."""
    ids = df.groupBy(F.trim("ID").alias("ID")).agg(F.count(F.lit(1)).alias("n"))
    blank = F.col("ID").isNull() | (F.col("ID") == "")
    one = ids.agg(
        F.coalesce(F.sum(F.when(blank, F.col("n"))), F.lit(0)).alias("missing"),
        F.coalesce(F.sum(F.when(~blank, F.col("n") - 1)), F.lit(0)).alias("duplicate"),
        F.coalesce(F.sum(F.when(F.length("ID") > 50, F.col("n"))), F.lit(0)).alias("too_long"),
        F.coalesce(F.sum(F.when(~F.col("ID").startswith("KP"), F.col("n"))), F.lit(0)).alias("others"),
        F.min(F.when(~blank, F.col("ID"))).alias("least"),
    )
    prefix = F.when(F.col("least").startswith("KP"), F.col("others")).otherwise(0)
    return one.select("missing", "duplicate", "too_long", prefix.alias("no_prefix"))


def _report(df: DataFrame, file: str, required: tuple[str, ...], optional: tuple[str, ...], ranges: dict, numeric: list[str]) -> DataFrame:
    absent, _ = missing_columns(df.columns, required, optional)
    checks = list(_checks(df, ranges, numeric).items())
    rows = [F.struct(F.lit(c).alias("column"), F.lit("missing_column").alias("check"), F.lit(1).cast("long").alias("n")) for c in absent]
    found = df.agg(*(x.alias(f"c{i}") for i, (_, x) in enumerate(checks))) if checks else df.sparkSession.range(1)
    rows += [F.struct(F.lit(c).alias("column"), F.lit(k).alias("check"), F.col(f"c{i}").cast("long").alias("n")) for i, ((c, k), _) in enumerate(checks)]
    out = found.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    if "ID" in df.columns:
        kinds = ("missing", "duplicate", "too_long", "no_prefix")
        ids = _id_checks(df).select(F.explode(F.array(*(F.struct(F.lit("ID").alias("column"), F.lit(k).alias("check"), F.col(k).cast("long").alias("n")) for k in kinds))).alias("r")).select("r.*")
        out = out.union(ids)
    return out.select(F.lit(file).alias("file"), "column", "check", "n", (F.col("check").isin(*FATAL) & (F.col("n") > 0)).alias("fatal"))


def check_hypocenters(df: DataFrame) -> DataFrame:
    """(file, column, check, n, fatal): how many rows fail each check."""
    return _report(df, "hypocenters", HYPOCENTER_COLUMNS, (), HYPOCENTER_RANGES, [c for c in HYPOCENTER_COLUMNS if c != "ID"])


def check_focals(df: DataFrame) -> DataFrame:
    return _report(df, "focals", FOCAL_COLUMNS, OPTIONAL_FOCAL_COLUMNS, FOCAL_RANGES, [c for c in FOCAL_COLUMNS if c not in ("ID", "Type")])


def verdict(*reports: DataFrame) -> DataFrame:
    """(file, valid, issues): whether each file is free of fatal issues, and in how many checks rows failed."""
    out = reports[0]
    for r in reports[1:]:
        out = out.union(r)
    return out.groupBy("file").agg((~F.bool_or("fatal")).alias("valid"), F.count_if(F.col("n") > 0).alias("issues"))


def valid_planes(df: DataFrame) -> DataFrame:
    """Events with a plane: all normal components known, and a positive rupture radius."""
    return df.filter("normal_vector_x IS NOT NULL AND normal_vector_y IS NOT NULL AND normal_vector_z IS NOT NULL AND rupt_radius > 0")


def without_corrupt_radii(df: DataFrame, radius: str = "rupt_radius", times: float = 100.0) -> DataFrame:
    """Rows whose radius is at most `times` the 99th percentile of all."""
    top = df.agg(F.percentile(radius, F.lit(0.99)).alias("_p99"))
    return df.crossJoin(F.broadcast(top)).filter(F.col(radius) <= times * F.col("_p99")).drop("_p99")
