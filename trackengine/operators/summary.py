"""Per-track summaries. Points have track_id, time, lat, lon, metric columns, ``category`` (class) and ``observed``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackengine.functions.columns import epoch_hours, finite, first_extreme, peak_class, scaled
from trackengine.operators import kinematics

#: Metrics whose extreme is a maximum, and those whose extreme is a minimum.
LARGEST, SMALLEST = ("vort", "wind", "deficit", "precip"), ("mslp",)
# --- fixed values: limits of the quality flags and grades
LONG_RUN_H, FAST_MS, LONG_H, FAR_KM, THIN = 24, 30.0, 720, 8000, 0.5
GRADE_LIMITS = ((1, 0.75, 12), (3, 0.5, 36))
GRADE_SPEED_MS = 29.5
# ---


def _peak_columns() -> list[Column]:
    month, out = F.month("time"), []
    for names, largest in ((LARGEST, True), (SMALLEST, False)):
        for n in names:
            value = finite(F.col(n))
            out += [(F.max if largest else F.min)(value).alias(f"peak_{n}"), first_extreme(value, F.col("time"), month, largest).alias(f"month_{n}")]
    return out


def _end_columns() -> list[Column]:
    first, last = (f(F.struct("time", "lat", "lon")) for f in (F.min, F.max))
    start, end = epoch_hours(first["time"]), epoch_hours(last["time"])
    return [
        F.rint(start).cast("long").alias("start_hour"),
        F.rint(end).cast("long").alias("end_hour"),
        F.year(first["time"]).alias("start_year"),
        F.rint(end - start).cast("long").alias("duration_hours"),
        *(at[c].alias(f"{n}_{c}") for n, at in (("genesis", first), ("lysis", last)) for c in ("lat", "lon")),
    ]


def _support_columns(segment: str | None, qualifying: Column | None) -> list[Column]:
    observed = F.col("observed")
    good = observed & (F.lit(False) if qualifying is None else F.coalesce(qualifying, F.lit(False)))
    return [
        F.count("*").alias("n_rows"),
        F.count_if(observed).alias("n_observed"),
        F.count_if(good).alias("n_qualifying"),
        F.avg(observed.cast("double")).alias("observed_fraction"),
        F.avg((~observed).cast("double")).alias("interpolated_fraction"),
        (F.count_distinct(segment) if segment else F.max(F.lit(1)).cast("long")).alias("n_segments"),
        F.bit_or(F.call_function("shiftleft", F.lit(1), F.month("time") - 1)).alias("month_mask"),
        peak_class(F.max(F.when(observed, F.col("category")))).alias("peak_class"),
        F.bround(F.min("lon"), 4).alias("min_lon"),
        F.bround(F.max("lon"), 4).alias("max_lon"),
        F.bround(F.min("lat"), 4).alias("min_lat"),
        F.bround(F.max("lat"), 4).alias("max_lat"),
    ]


def peaks(points: DataFrame, key: str = "track_id") -> DataFrame:
    """Extreme value of each metric and the month of its first occurrence (of the first row where a metric is all null)."""
    return points.groupBy(key).agg(*_peak_columns())


def endpoints(points: DataFrame, key: str = "track_id") -> DataFrame:
    """First and last position and time (epoch hours), start year, duration in hours."""
    return points.groupBy(key).agg(*_end_columns())


def support(points: DataFrame, key: str = "track_id", segment: str | None = None, qualifying: Column | None = None) -> DataFrame:
    """Row counts, months touched as a bit mask, peak class over observed points, bounds."""
    return points.groupBy(key).agg(*_support_columns(segment, qualifying))


def quality(summary: DataFrame) -> DataFrame:
    """qc_flags and qc_severity from max_missing_run_hours, max_speed_ms, duration_hours, distance_km, observed_fraction, n_segments."""
    run, speed, seg, share = F.col("max_missing_run_hours"), F.col("max_speed_ms"), F.col("n_segments"), F.col("observed_fraction")
    bits = [(1, run > LONG_RUN_H), (2, speed > FAST_MS), (4, F.col("duration_hours") > LONG_H), (8, F.col("distance_km") > FAR_KM), (16, share < THIN), (32, seg > 1)]
    flags = sum((F.when(test, bit).otherwise(0) for bit, test in bits), F.lit(0))
    severity = F.lit(None)
    for grade, (most, least, longest) in enumerate(GRADE_LIMITS):
        test = (seg <= most) & (share >= least) & (run <= longest) & (speed <= GRADE_SPEED_MS)
        severity = F.when(test, grade) if grade == 0 else severity.when(test, grade)
    return summary.withColumns({"qc_flags": flags, "qc_severity": severity.otherwise(2)})


def qc_record(summary: DataFrame, key: str = "track_id") -> DataFrame:
    return quality(summary).select(
        key,
        F.bround("max_gap_hours", 1).alias("max_gap_h"),
        F.bround("max_speed_ms", 1).alias("max_speed_ms"),
        F.rint(F.col("observed_fraction") * 100).cast("int").alias("coverage_pct"),
        F.col("qc_flags").alias("flags"),
        F.col("qc_severity").alias("severity"),
        (F.col("n_segments") - 1).alias("break_count"),
    )


def track_summary(points: DataFrame, key: str = "track_id", segment: str | None = None, qualifying: Column | None = None) -> DataFrame:
    """All summary columns of a track. Points are shuffled once by ``key``; ends, peaks and support are one aggregation."""
    points = points.repartition(key)
    stepped = kinematics.steps(points, key, segment or key)
    out = points.groupBy(key).agg(*_end_columns(), *_peak_columns(), *_support_columns(segment, qualifying))
    return quality(out.join(kinematics.motion(stepped, key), key).join(kinematics.max_missing_run(points, F.col("observed"), key), key))


def coverage(points: DataFrame, key: str = "track_id") -> DataFrame:
    """One row about a whole catalogue."""
    hours = epoch_hours(F.col("time"))
    return points.agg(
        F.rint(F.min(hours)).cast("long").alias("first_hour"),
        F.rint(F.max(hours)).cast("long").alias("last_hour"),
        *(f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))),
        F.count("*").alias("n_rows"),
        F.count_if(F.col("observed")).alias("n_observed"),
        F.count_if(~F.col("observed")).alias("n_posterior"),
        F.count_distinct(key).alias("n_tracks"),
    )


def scaled_columns(rows: DataFrame, factors: dict[str, float], key: str = "track_id", default: int = -1) -> DataFrame:
    """Integer export columns; missing values take the default."""
    return rows.select(key, *(scaled(F.col(c), k, default).alias(c) for c, k in factors.items()))


def detail_series(points: DataFrame, columns: tuple[str, ...], key: str = "track_id") -> DataFrame:
    """Aligned arrays per track in time order; the class is limited to 6."""
    fields = [F.least(F.col(c), F.lit(6)).alias(c) if c == "category" else F.col(c) for c in columns]
    rows = points.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("time", *fields))).alias("s"))
    return rows.select(key, *(F.col(f"s.{c}").alias(c) for c in columns))
