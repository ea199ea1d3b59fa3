"""Reading hypocenter and focal-mechanism catalogs, and raw pipe-delimited bulletins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import BULLETIN_FOCALS, BULLETIN_HYPOCENTERS, FOCAL_COLUMNS, FOCALS, HYPOCENTER_COLUMNS, HYPOCENTERS


def origin_time(yr: Column, mo: Column, dy: Column, hr: Column, mi: Column, sc: Column) -> Column:
    """Timestamp of split date and time columns, to the microsecond; null where they are no date. Seconds may have a fraction."""
    whole = F.format_string("%04d-%02d-%02d %02d:%02d:00", yr.cast("int"), mo.cast("int"), dy.cast("int"), hr.cast("int"), mi.cast("int"))
    known = yr.isNotNull() & mo.isNotNull() & dy.isNotNull() & hr.isNotNull() & mi.isNotNull() & sc.isNotNull()
    start = F.when(known, F.try_to_timestamp(whole, F.lit("yyyy-MM-dd HH:mm:ss")))
    return F.timestamp_micros(F.unix_micros(start) + F.round(sc * 1_000_000).cast("long"))


def with_errors(df: DataFrame) -> DataFrame:
    """Missing location errors count as zero."""
    return df.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("EX", "EY", "EZ")})


def by_name(df: DataFrame, schema) -> DataFrame:
    """The schema's columns, by name and in any order, cast (bad values to null); absent ones are null."""
    have = set(df.columns)
    return df.select(*(F.expr(f"try_cast(trim(`{f.name}`) AS {f.dataType.simpleString()})").alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))


def read_hypocenters(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """The catalog with Date. The header is read once; columns are picked by name."""
    raw = spark.read.csv(path, sep=sep, header=True)
    df = with_errors(by_name(raw, HYPOCENTERS))
    return df.withColumn("Date", origin_time(*(F.col(c) for c in HYPOCENTER_COLUMNS[10:16])))


def split_clock(text: Column) -> tuple[Column, Column, Column]:
    """Hour, minute and whole second of HH:MM or HH:MM:SS[.f]."""
    part = F.split(F.trim(text), ":")
    n = lambda i: F.try_element_at(part, F.lit(i))
    whole = lambda c: F.floor(F.when(c.rlike(r"^\d+(\.\d*)?$"), c).cast("double")).cast("int")
    return whole(n(1)), whole(n(2)), F.coalesce(whole(n(3)), F.lit(0))


def read_focals(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """Focal mechanisms with Date, from any of the time layouts HR, MI, SC / Hr:Mi / Hr, Mi, Sc."""
    raw = spark.read.csv(path, sep=sep, header=True)
    return normalize_focals(raw)


def normalize_focals(raw: DataFrame) -> DataFrame:
    if "Hr:Mi" in raw.columns:
        h, m, s = split_clock(F.col("`Hr:Mi`"))
        raw = raw.withColumns({"HR": h.cast("string"), "MI": m.cast("string"), "SC": s.cast("string")})
    else:
        raw = raw.withColumnsRenamed({a: b for a, b in (("Hr", "HR"), ("Mi", "MI"), ("Sc", "SC")) if a in raw.columns and b not in raw.columns})
    df = by_name(raw, FOCALS)
    return df.withColumn("Date", origin_time(*(F.col(c) for c in FOCAL_COLUMNS[7:13])))


def bulletin_header(lines: DataFrame) -> list[str]:
    """Column names: the last comment line that holds a delimiter. lines: value, one row per line, in file order."""
    head = lines.filter(F.col("value").startswith("#") & F.col("value").contains("|")).withColumn("n", F.monotonically_increasing_id())
    row = head.agg(F.max_by("value", "n")).first()
    return [c.strip() for c in row[0].lstrip("#").split("|")] if row and row[0] else []


def bulletin_kind(path: str, header: list[str]) -> str:
    """hypocenters or focals: by the file's name, else by the number of columns (over 40: hypocenters)."""
    name = path.rsplit("/", 1)[-1].lower()
    if "focal" in name or "_fm" in name or name.startswith("fm"):
        return "focals"
    if "hypo" in name:
        return "hypocenters"
    return "hypocenters" if len(header) > 40 else "focals"


def read_bulletin(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """A raw bulletin in the catalogs' columns. Only comment lines decide the header; data lines are parsed in parallel."""
    lines = spark.read.text(path)
    header = bulletin_header(lines)
    return parse_bulletin(lines, header, kind or bulletin_kind(path, header))


def parse_bulletin(lines: DataFrame, header: list[str], kind: str) -> DataFrame:
    """Catalog rows of the lines that are no comment; fields are trimmed, bad numbers are null, Z is -1000 times DEPTH."""
    names = BULLETIN_HYPOCENTERS if kind == "hypocenters" else BULLETIN_FOCALS
    schema = HYPOCENTERS if kind == "hypocenters" else FOCALS
    data = lines.filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    fields = data.select(F.split("value", r"\|").alias("f"))
    at = {ours: header.index(theirs) for theirs, ours in names.items() if theirs in header}
    raw = fields.select(*(F.trim(F.try_element_at("f", F.lit(i + 1))).alias(c) for c, i in at.items()))
    out = by_name(raw, schema).withColumn("Z", F.col("DEPTH") * -1000)
    return out.select(*(HYPOCENTER_COLUMNS if kind == "hypocenters" else FOCAL_COLUMNS))
