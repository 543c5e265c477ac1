"""Life-cycle composites and look-ups along tracks. Points have track_id, ``hour`` since genesis and metric columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackengine.functions.columns import finite, first_extreme, half_up
from trackengine.operators import asof, ranks

BINS, PEAK_H, PEAK_STEP_H = 24, 72, 6


def _long(points: DataFrame, metrics: list[str], keep: list[str]) -> DataFrame:
    values = points.select(*keep, *(finite(F.col(m)).alias(m) for m in metrics))
    return values.unpivot(keep, metrics, "metric", "value").filter(F.col("value").isNotNull())


def _bins(binned: DataFrame, key: str) -> DataFrame:
    """Mean of each track and bin, then their spread over tracks."""
    per_track = binned.groupBy("metric", key, "bin").agg(F.avg("value").alias("value"))
    return ranks.quantiles(per_track, ["metric", "bin"], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, moments=True)


def life_cycle(points: DataFrame, metrics: list[str], key: str = "track_id") -> DataFrame:
    """25 bins over each track's life: median, mean, quartiles and number of tracks."""
    last = F.max("hour").over(Window.partitionBy(key))
    binned = points.withColumn("bin", half_up(F.col("hour") / F.greatest(F.lit(1), last) * BINS))
    return _bins(_long(binned, metrics, [key, "bin"]), key)


def peak_aligned(points: DataFrame, metric: str, largest: bool = True, key: str = "track_id") -> DataFrame:
    """25 bins of 6 hours around the first extreme of the metric, from -72 to 72 hours."""
    peak = points.groupBy(key).agg(first_extreme(finite(F.col(metric)), F.col("hour"), F.col("hour"), largest).alias("peak_hour"))
    binned = points.join(peak, key).withColumn("bin", half_up((F.col("hour") - F.col("peak_hour") + PEAK_H) / PEAK_STEP_H))
    return _bins(_long(binned.filter(F.col("bin").between(0, BINS)), [metric], [key, "bin"]), key)


def cohort_against_all(points: DataFrame, cohort: DataFrame, metrics: list[str], key: str = "track_id") -> DataFrame:
    """The cohort's median and quartiles beside the mean over all tracks."""
    mine = life_cycle(points.join(cohort.select(key), key, "left_semi"), metrics, key)
    whole = life_cycle(points, metrics, key).select("metric", "bin", F.col("mean").alias("all_mean"))
    return mine.join(whole, ["metric", "bin"])


def evolution(points: DataFrame, metric: str, other: str, key: str = "track_id") -> DataFrame:
    return points.groupBy(key).agg(F.count("*").alias("n_hours"), F.min(metric).alias("low"), F.max(metric).alias("high"), F.max(other).alias("peak_other"))


def value_at_hour(points: DataFrame, targets: DataFrame, metric: str, key: str = "track_id") -> DataFrame:
    """Value at the hour nearest a target (columns key, target); the later hour wins ties."""
    out = asof.nearest_in_time(targets.select(key, "target"), points.select(key, "hour", metric), [key], "target", "hour", [metric], later_wins=True)
    return out.select(key, "target", "hour", F.col(metric).alias("value"))
