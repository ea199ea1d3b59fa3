"""Column layouts of the catalogs, as fixed values."""

from __future__ import annotations

from pyspark.sql import types as T

HYPOCENTER_COLUMNS = ("ID", "LAT", "LON", "DEPTH", "X", "Y", "Z", "EX", "EY", "EZ", "YR", "MO", "DY", "HR", "MI", "SC", "MAG")
FOCAL_COLUMNS = ("ID", "LAT", "LON", "DEPTH", "X", "Y", "Z", "YR", "MO", "DY", "HR", "MI", "SC", "MAG", "A", "Strike1", "Dip1", "Rake1", "Strike2", "Dip2", "Rake2", "Pazim", "Pdip", "Tazim", "Tdip", "Q", "Type")
OPTIONAL_FOCAL_COLUMNS = ("Q", "Type")
_WHOLE = {"YR", "MO", "DY", "HR", "MI", "A", "Q"}


def struct(columns: tuple[str, ...]) -> T.StructType:
    kind = lambda c: T.StringType() if c in ("ID", "Type") else T.IntegerType() if c in _WHOLE else T.DoubleType()
    return T.StructType([T.StructField(c, kind(c)) for c in columns])


HYPOCENTERS, FOCALS = struct(HYPOCENTER_COLUMNS), struct(FOCAL_COLUMNS)

#: Raw bulletins: their column names and ours, in our order. Fixed values.
BULLETIN_HYPOCENTERS = {
    "KP-ID": "ID", "Pref-lat": "LAT", "Pref-lon": "LON", "Pref-dep": "DEPTH", "CHX": "X", "CHY": "Y", "Err-X-m": "EX", "Err-Y-m": "EY", "Err-Z-m": "EZ",
    "YYYY": "YR", "MM": "MO", "DD": "DY", "HH": "HR", "MI": "MI", "SS": "SC", "mag": "MAG",
}
BULLETIN_FOCALS = {
    "EvID_KP": "ID", "Lat": "LAT", "Lon": "LON", "Dep": "DEPTH", "CH-X": "X", "CH-Y": "Y", "YYYY": "YR", "MM": "MO", "DD": "DY", "HH": "HR", "MI": "MI", "SS.S": "SC", "Mag": "MAG",
    "AP": "A", "S1": "Strike1", "D1": "Dip1", "R1": "Rake1", "S2": "Strike2", "D2": "Dip2", "R2": "Rake2", "Paz": "Pazim", "Ppl": "Pdip", "Taz": "Tazim", "Tpl": "Tdip", "FMQ": "Q", "FMT": "Type",
}
