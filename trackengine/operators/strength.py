"""Event strength and persistent intensity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values: the published thresholds of a qualifying point
LIMITS = {
    "heat_low_score": ("<=", 0.544212),
    "quality": (">=", 5.832555),
    "category": (">=", 1.0),
    "centre_score": (">=", 6.446782),
    "deficit": (">=", 3.495224),
    "vort": (">=", 7.036606),
}
DOMAIN = {"lon": (65.0, 100.0), "lat": (0.0, 32.0)}
MIN_HOURS, MIN_OBSERVED, MIN_QUALIFYING = 30, 12, 3
PERSISTENCE_H = 6
# ---


def qualifying(columns: list[str], limits: dict[str, tuple[str, float]] | None = None) -> Column:
    """All limits on the columns that are there, and the domain; false where a value is null."""
    test = F.lit(True)
    for name, (sign, limit) in (limits or LIMITS).items():
        if name in columns:
            test &= F.col(name) <= F.lit(limit) if sign == "<=" else F.col(name) >= F.lit(limit)
    for name, (low, high) in DOMAIN.items():
        if name in columns:
            test &= F.col(name).between(low, high)
    return F.coalesce(test, F.lit(False))


def strength(observed: DataFrame, keys: list[str], min_hours: int = MIN_HOURS, min_observed: int = MIN_OBSERVED, min_qualifying: int = MIN_QUALIFYING) -> DataFrame:
    """hours from first to last observed point, counts, and whether the event passes. ``observed`` has hour and good."""
    out = observed.groupBy(*keys).agg((F.max("hour") - F.min("hour")).alias("hours"), F.count("*").alias("n_observed"), F.count_if("good").alias("n_qualifying"))
    return out.withColumn("passed", (F.col("hours") >= min_hours) & (F.col("n_observed") >= min_observed) & (F.col("n_qualifying") >= min_qualifying))


def strength_filter(points: DataFrame, judged: DataFrame, keys: list[str]) -> DataFrame:
    """The points of events that pass."""
    return points.join(judged.filter("passed").select(*keys), keys, "left_semi")


def persistent_class(points: DataFrame, width: int = PERSISTENCE_H, key: str = "track_id") -> DataFrame:
    """Class held for ``width`` hours of unbroken observed support: inside each hourly run a rolling minimum, then a
    rolling maximum over the windows that hold the point; observed points stay at least 1, others have none.

    Points have hour, category and observed."""
    seen = points.filter("observed")
    # hours are whole and there once: ``width`` rows in as many hours are unbroken, so windows by hour need no runs, and one sort
    w = Window.partitionBy(key).orderBy("hour")
    ahead = w.rangeBetween(0, width - 1)
    low = F.when(F.count("*").over(ahead) == width, F.min("category").over(ahead))
    held = seen.withColumn("low", low).withColumn("persistent", F.greatest(F.lit(1), F.coalesce(F.max("low").over(w.rangeBetween(-(width - 1), 0)), F.lit(1)), F.lit(1)))
    rest = points.filter(~F.col("observed")).withColumn("persistent", F.lit(None).cast("int"))
    return held.drop("low").unionByName(rest)


def class_distribution(points: DataFrame, columns: list[str], classes: range = range(1, 8), key: str = "track_id") -> DataFrame:
    """Counts of points and of tracks by peak, per class and column, zero-filled."""
    long = points.select(key, F.explode(F.create_map(*(x for c in columns for x in (F.lit(c), F.col(c).cast("int"))))).alias("measure", "class"))
    per_point = long.filter(F.col("class").isNotNull()).groupBy("measure", "class").agg(F.count("*").alias("n_points"))
    per_track = long.groupBy("measure", key).agg(F.max("class").alias("class")).groupBy("measure", "class").agg(F.count("*").alias("n_tracks"))
    spark = points.sparkSession
    grid = spark.createDataFrame([(c, k) for c in columns for k in classes], "measure string, class int")
    out = grid.join(per_point, ["measure", "class"], "left").join(per_track, ["measure", "class"], "left")
    return out.select("measure", "class", F.coalesce("n_points", F.lit(0)).alias("n_points"), F.coalesce("n_tracks", F.lit(0)).alias("n_tracks"))
