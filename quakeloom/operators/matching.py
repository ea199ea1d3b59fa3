"""Matching focal mechanisms and results to catalog events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import focal


def first_focals(focals: DataFrame) -> DataFrame:
    """One focal per ID, the earliest."""
    return focals.withColumn("_n", F.row_number().over(Window.partitionBy("ID").orderBy(F.col("Date").asc_nulls_last(), "Strike1", "Dip1", "Rake1"))).filter("_n = 1").drop("_n")


def match_by_id(catalog: DataFrame, focals: DataFrame) -> DataFrame:
    """Left join on ID; the focals' own columns get the suffix _fm where the catalog has them too."""
    own = set(catalog.columns)
    fm = first_focals(focals)
    return catalog.join(fm.select("ID", *(F.col(c).alias(f"{c}_fm" if c in own else c) for c in fm.columns if c != "ID")), "ID", "left")


def match_by_time(catalog: DataFrame, focals: DataFrame, tolerance_s: int = 60) -> DataFrame:
    """As-of join: each event's latest focal that is not later and at most tolerance_s earlier.

    Times meet in equal buckets of the tolerance (the focal's own and the next), so no pair further apart is formed.
    """
    own = set(catalog.columns)
    us, span = F.unix_micros("Date"), tolerance_s * 1_000_000
    fm = focals.select(F.struct(*focals.columns).alias("f"), us.alias("_f"), F.explode(F.array(F.floor(us / span), F.floor(us / span) + 1)).alias("_b"))
    ev = catalog.select("ID", us.alias("_t"), F.floor(us / span).alias("_b"))
    near = ev.join(fm, "_b").filter((F.col("_t") - F.col("_f")).between(0, span))
    best = near.groupBy("ID").agg(F.max_by("f", F.struct(F.col("_f"), F.col("f.ID"))).alias("f"))
    names = [F.col(f"f.{c}").alias(f"{c}_fm" if c in own else c) for c in focals.columns]
    return catalog.join(best, "ID", "left").select(*catalog.columns, *names)


def match_focals(catalog: DataFrame, focals: DataFrame, tolerance_s: int = 60) -> DataFrame:
    """By ID, or by time if no ID of the focals is in the catalog."""
    known = focals.join(catalog.select("ID"), "ID", "left_semi").limit(1).count()
    return match_by_id(catalog, focals) if known else match_by_time(catalog, focals, tolerance_s)


FOCAL_FIELDS = ("Strike1", "Dip1", "Rake1", "Strike2", "Dip2", "Rake2")


def null_inconsistent(matched: DataFrame, most: float = 0.2, most_km: float = 1.0) -> DataFrame:
    """Focal planes become null where the magnitudes differ by more than `most`; A stays. loc_ok tells whether the places agree."""
    ok = focal.consistent(F.col("MAG"), F.col("MAG_fm"), most)
    d = F.sqrt(sum(((F.col(c) - F.col(f"{c}_fm")) * (F.col(c) - F.col(f"{c}_fm")) for c in ("X", "Y", "Z")), F.lit(0.0)))
    have = [c for c in FOCAL_FIELDS if c in matched.columns]
    return matched.withColumns({c: F.when(ok, F.col(c)) for c in have} | {"loc_ok": d <= most_km * 1000})


def enrich(catalog: DataFrame, results: DataFrame) -> DataFrame:
    """All events with their results; events without any are unclustered."""
    out = catalog.join(results, "ID", "left")
    return out.withColumn("sequence_label", F.coalesce("sequence_label", F.lit("unclustered")))


def enrich_focals(focals: DataFrame, events: DataFrame, planes: DataFrame) -> DataFrame:
    """Focals with their event's sequence, level (its first letter) and fault, and the active-plane summary."""
    level = F.when(F.col("sequence_label") != "unclustered", F.substring("sequence_label", 1, 1))
    ev = events.select("ID", "sequence_label", "fault_id")
    out = focals.join(ev, "ID", "left").withColumn("sequence_label", F.coalesce("sequence_label", F.lit("unclustered")))
    out = out.withColumns({"segmentation_level": level, "is_clustered": F.col("sequence_label") != "unclustered"})
    return out.join(prefer_determined(planes), "ID", "left")


def prefer_determined(focals: DataFrame) -> DataFrame:
    """One row per ID, a determined plane before one that is not."""
    w = Window.partitionBy("ID").orderBy(F.col("plane_determination_method").startswith("Not"), F.col("epsilon").asc_nulls_last(), "plane_determination_method")
    return focals.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both by key, those of `new` first."""
    both = new.withColumn("_p", F.lit(0)).unionByName(old.withColumn("_p", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_p"))).filter("_n = 1").drop("_n", "_p")


def active_plane_summary(df: DataFrame) -> DataFrame:
    """Events with a focal: method, preferred strike, dip and rake, and epsilon to one decimal."""
    pref = F.col("pref_foc")
    out = df.filter("Strike1 IS NOT NULL OR A IS NOT NULL").withColumn("plane_determination_method", focal.determination_method(pref, F.col("A"), F.col("rupture_plane_azimuth")))
    out = out.withColumns({f"preferred_{n.lower()}": focal.preferred(pref, F.col(f"{n}1"), F.col(f"{n}2")) for n in ("Strike", "Dip", "Rake")})
    return out.withColumn("epsilon", F.round("epsilon", 1)).withColumn("rank", focal.method_rank(F.col("plane_determination_method")))


def active_plane_stats(summary: DataFrame) -> DataFrame:
    """Per method: count, and mean, median, least and largest epsilon."""
    e = F.col("epsilon")
    return summary.groupBy("plane_determination_method").agg(F.count(F.lit(1)).alias("n"), F.avg(e).alias("mean_epsilon"), F.median(e).alias("median_epsilon"), F.min(e).alias("min_epsilon"), F.max(e).alias("max_epsilon"))


def agreement(planes: DataFrame, focals: DataFrame) -> DataFrame:
    """One row: focal-fit metrics of planes (ID, epsilon, pref_geom: the plane nearer by angle) joined with focals (ID, A)."""
    m = planes.join(focals.select("ID", "A"), "ID")
    e = F.col("epsilon")
    given = F.col("A").isin(1, 2)
    return m.filter(e.isNotNull()).agg(
        F.count(F.lit(1)).alias("n_compared"),
        F.avg(e).alias("mean_angular_diff"),
        F.median(e).alias("median_angular_diff"),
        F.avg((e < 30).cast("double")).alias("share_below_30"),
        F.avg((e < 15).cast("double")).alias("share_below_15"),
        F.avg(F.when(given, (F.col("pref_geom") == F.col("A")).cast("double"))).alias("active_plane_match_rate"),
        F.count_if(F.col("A") == 0).alias("n_unknown"),
        F.avg(F.when(F.col("A") == 0, e)).alias("mean_unknown"),
    )
