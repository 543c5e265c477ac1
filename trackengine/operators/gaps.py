"""Gaps in hourly tracks: find them, fill them, judge them, and cut tracks where a gap is rejected.

Filled points are linear between the fixes at either side. A gap row knows its block, the hours since the fix before
(k of n) and whether its diagnostics support it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackengine.functions.columns import epoch_hours, haversine_km

# --- fixed values: the published limits
SHORT_H, MIDDLE_H, RUN_H = 6, 11, 4
SHORT_MS, MIDDLE_SHARE, LONG_SHARE = 20.0, 0.65, 0.75
VORT, VORT_KM, DEFICIT, MSLP_KM = 5.0, 225.0, 4.0, 250.0
#: Hours of a block that one number holds.
DIGITS = 30
# ---


def gap_blocks(fixes: DataFrame, key: str = "track_id") -> DataFrame:
    """Maximal runs of hours without a fix: block number in the track, hour of the fix before, missing hours, end points, speed."""
    w = Window.partitionBy(key).orderBy("time")
    hours = F.rint(epoch_hours(F.col("time"))).cast("long")
    pairs = fixes.withColumn("hour", hours)
    last = lambda c: F.lag(c).over(w)
    pairs = pairs.select(key, last("hour").alias("h0"), F.col("hour").alias("h1"), *(x for c in ("lat", "lon", "vort", "deficit") for x in (last(c).alias(f"{c}0"), F.col(c).alias(f"{c}1"))))
    gaps = pairs.filter(F.col("h1") - F.col("h0") > 1)
    km = haversine_km(F.col("lat0"), F.col("lon0"), F.col("lat1"), F.col("lon1"))
    return gaps.withColumns(
        {"block": F.row_number().over(Window.partitionBy(key).orderBy("h0")), "missing": F.col("h1") - F.col("h0") - 1, "speed_ms": km * 1000 / ((F.col("h1") - F.col("h0")) * 3600)}
    )


def fill_hourly(blocks: DataFrame, key: str = "track_id") -> DataFrame:
    """One interpolated row for each missing hour."""
    rows = blocks.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("missing"))))
    share = F.col("k") / (F.col("missing") + 1)
    between = [(F.col(f"{c}0") + (F.col(f"{c}1") - F.col(f"{c}0")) * share).alias(c) for c in ("lat", "lon", "vort", "deficit")]
    return rows.select(key, "block", "missing", "speed_ms", "h0", "k", (F.col("h0") + F.col("k")).alias("hour"), *between)


def supported_hour(vort_km: Column, mslp_km: Column) -> Column:
    """Enough vorticity near by, or enough deficit with a pressure minimum near by."""
    return ((F.col("vort") >= VORT) & (vort_km <= VORT_KM)) | ((F.col("deficit") >= DEFICIT) & (mslp_km <= MSLP_KM))


def gap_decision(filled: DataFrame, key: str = "track_id", complete: Column | None = None) -> DataFrame:
    """Keeps or rejects each block: short ones by speed and complete fields, else by the share of supported hours and the
    longest unsupported run. ``filled`` has ``supported``."""
    # hours of a block as digits of four, 30 to a number: 1 unsupported, 2 supported, 0 unknown; so no filled row is sorted
    digit = F.when(F.col("supported"), 2).when(~F.col("supported"), 1).otherwise(0).cast("long")
    digit = F.call_function("shiftleft", digit, (2 * F.pmod(F.col("k"), F.lit(DIGITS))).cast("int"))
    parts = filled.withColumn("complete", F.lit(True) if complete is None else complete).groupBy(key, "block", F.floor(F.col("k") / DIGITS).alias("part")).agg(
        F.first("missing").alias("missing"), F.first("h0").alias("h0"), F.first("speed_ms").alias("speed_ms"), F.count_if("supported").alias("n_supported"), F.bit_or(digit).alias("digits"), F.min("complete").alias("complete")
    )
    out = parts.groupBy(key, "block").agg(
        F.first("missing").alias("missing"), F.first("h0").alias("h0"), F.first("speed_ms").alias("speed_ms"), F.sum("n_supported").alias("n_supported"), F.sort_array(F.collect_list(F.struct("part", "digits"))).alias("parts"), F.min("complete").alias("complete")
    )
    digits = F.transform("parts", lambda p: F.reverse(F.lpad(F.conv(p["digits"].cast("string"), 10, 4), DIGITS, "0")))
    runs = F.split(F.replace(F.array_join(digits, ""), F.lit("0"), F.lit("")), "2")
    out = out.withColumn("longest_bad", F.array_max(F.transform(runs, F.length)).cast("long")).drop("parts")
    share = F.col("n_supported") / F.col("missing")
    held = F.col("longest_bad") <= RUN_H
    kept = (
        F.when((F.col("missing") <= SHORT_H) & F.col("complete") & (F.col("speed_ms") <= SHORT_MS), True)
        .when(F.col("missing") <= MIDDLE_H, (share >= MIDDLE_SHARE) & held)
        .otherwise((share >= LONG_SHARE) & held)
    )
    return out.withColumn("keep", kept)


def resegment(fixes: DataFrame, decisions: DataFrame, key: str = "track_id") -> DataFrame:
    """Adds ``segment``: 0-based number inside a track, one more after each rejected block."""
    cut = decisions.filter(~F.col("keep")).select(key, F.col("h0").alias("hour"), F.lit(1).alias("cut"))
    hours = fixes.withColumn("hour", F.rint(epoch_hours(F.col("time"))).cast("long"))
    joined = hours.join(cut, [key, "hour"], "left")
    w = Window.partitionBy(key).orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn("segment", F.coalesce(F.sum("cut").over(w), F.lit(0)).cast("long")).drop("cut")


def kept_rows(filled: DataFrame, decisions: DataFrame, key: str = "track_id") -> DataFrame:
    """The interpolated rows of accepted blocks."""
    return rows_of_blocks(filled, decisions.filter("keep"), key)


def rows_of_blocks(filled: DataFrame, blocks: DataFrame, key: str = "track_id") -> DataFrame:
    """The interpolated rows of some blocks: a task's blocks are hashed, the rows, which are many more, are not sorted."""
    return filled.join(blocks.select(key, "block").hint("shuffle_hash"), [key, "block"], "left_semi")
