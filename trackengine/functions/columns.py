"""Column expressions: geometry, rounding, scaling, names and labels. No Python runs on executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values
EARTH_RADIUS_KM = 6371.0088
PLACEHOLDER_NAMES = ("", "UNNAMED", "NOT_NAMED", "UNKNOWN", "NAN", "INVEST")
SPELLINGS = {"KYAAR": "KYARR"}
CLASS_CODES = {1: "L", 2: "D", 3: "DD", 4: "CS", 5: "SCS", 6: "VSCS"}
CLASS_SHORT = {1: "L", 2: "D", 3: "DD", 4: "CS", 5: "SCS", 6: "VSCS+"}
CLASS_LABELS = {1: "Low", 2: "Depression", 3: "Deep Depression", 4: "Cyclonic Storm", 5: "Severe Cyclonic Storm", 6: "Very Severe Cyclonic Storm or stronger"}
SEASONS = {"jjas": (6, 7, 8, 9), "mam": (3, 4, 5), "ond": (10, 11, 12), "djf": (12, 1, 2)}
GRADES = {1: ("L", "LOW"), 2: ("D", "DEP"), 3: ("DD",), 4: ("CS",), 5: ("SCS",), 6: ("VSCS", "ESCS", "SUCS")}
# ---


def epoch_hours(time: Column) -> Column:
    """Hours since 1970 as a double; wall-clock arithmetic that doesn't depend on the session's time zone."""
    zero = F.expr("timestamp_ntz '1970-01-01 00:00:00'")
    return F.timestamp_diff("SECOND", zero, time.cast("timestamp_ntz")) / F.lit(3600.0)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; null if any coordinate is null."""
    d_lat, d_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(d_lat) * F.sin(d_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(d_lon) * F.sin(d_lon)
    a = F.least(F.lit(1.0), a)
    return F.lit(2 * EARTH_RADIUS_KM) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def finite(value: Column) -> Column:
    """Null for NaN and infinities."""
    value = value.cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def scaled(value: Column, factor: float, default: int | None = None) -> Column:
    """Half-even integer of ``value * factor``; missing values take the default."""
    out = F.rint(finite(value) * F.lit(float(factor))).cast("int")
    return out if default is None else F.coalesce(out, F.lit(default))


def unscaled(value: Column, divisor: float, missing: int | None = None) -> Column:
    """Inverse of ``scaled``; the marker for missing values becomes null."""
    out = value / F.lit(float(divisor))
    return out if missing is None else F.when(value != missing, out)


def half_up(value: Column) -> Column:
    """Rounds halves towards plus infinity."""
    return F.floor(value + F.lit(0.5))


def peak_class(highest: Column) -> Column:
    """Class 1 to 6 of a track from the highest class of its observed points; null counts as 1."""
    return F.least(F.lit(6), F.greatest(F.lit(1), F.rint(F.coalesce(highest.cast("double"), F.lit(1.0))).cast("int")))


def first_extreme(value: Column, time: Column, result: Column, largest: bool = True) -> Column:
    """Aggregate: ``result`` of the row with the extreme value, the earliest on ties; if all values are null, of the first row."""
    rank = -value if largest else value
    best = F.min(F.when(value.isNotNull(), F.struct(rank.alias("v"), time.alias("t"), result.alias("r"))))
    return F.coalesce(best["r"], F.min(F.struct(time.alias("t"), result.alias("r")))["r"])


def display_name(name: Column) -> Column:
    """Readable storm name: parts at ':', placeholders and repeats dropped, spellings unified, title case, joined by ' / '."""
    parts = F.split(F.upper(F.trim(F.coalesce(name, F.lit("")))), ":")
    known = F.create_map(*(F.lit(x) for pair in SPELLINGS.items() for x in pair))
    parts = F.transform(parts, lambda p: F.trim(F.regexp_replace(p, "-GU$", "")))
    parts = F.transform(parts, lambda p: F.coalesce(known[p], p))
    parts = F.array_distinct(F.filter(parts, lambda p: ~p.isin(*PLACEHOLDER_NAMES)))
    title = lambda p: F.array_join(F.transform(F.split(p, "(?<=[^A-Z])(?=[A-Z])"), lambda x: F.initcap(F.lower(x))), "")
    return F.array_join(F.transform(parts, title), " / ")


def credible(confidence: Column) -> Column:
    return F.coalesce(confidence.isin("high", "medium"), F.lit(False))


def official_name(name: Column, confidence: Column) -> Column:
    """The matched storm's name, only where the match is credible."""
    return F.when(credible(confidence) & (name != ""), name)


def lookup(value: Column, table: dict) -> Column:
    """Literal map."""
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[value]


def seasons(month: Column) -> Column:
    """Names of the seasons that a month belongs to; December is in two."""
    return F.array_compact(F.array(*(F.when(month.isin(*months), name) for name, months in SEASONS.items())))


def grade_class(grade: Column) -> Column:
    """Class 1 to 6 of an official grade text; null for other texts."""
    return lookup(F.upper(F.trim(grade)), {g: k for k, names in GRADES.items() for g in names})


def system_label(name: Column, part: Column, parts: Column, fallback: Column) -> Column:
    """``Cyclone NAME``, with its part if the storm has several tracks; else the fallback label."""
    tail = F.when(parts > 1, F.concat(F.lit(" · catalogue part "), part, F.lit("/"), parts)).otherwise("")
    return F.coalesce(F.concat(F.lit("Cyclone "), F.upper(name), tail), fallback)
