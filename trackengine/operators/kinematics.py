"""Per-track motion and runs. Points have track_id, time, lat, lon; a parent may own several tracks (segments)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackengine.functions.columns import epoch_hours, haversine_km


def in_parent(parent: str, key: str) -> Window:
    return Window.partitionBy(parent).orderBy("time", key)


def steps(points: DataFrame, parent: str = "track_id", key: str = "track_id") -> DataFrame:
    """Adds step_hours, step_km, within_segment, speed_ms and idx (0-based place in the parent), all from one window sort."""
    w = in_parent(parent, key)
    hours = epoch_hours(F.col("time"))
    out = points.withColumns(
        {
            "idx": F.row_number().over(w) - 1,
            "step_hours": hours - F.lag(hours).over(w),
            "step_km": haversine_km(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")),
            "within_segment": F.lag(key).over(w) == F.col(key),
        }
    )
    speed = F.when(F.col("within_segment") & (F.col("step_hours") > 0), F.col("step_km") * 1000 / (F.col("step_hours") * 3600))
    return out.withColumn("speed_ms", speed)


def breaks(stepped: DataFrame, parent: str = "track_id") -> DataFrame:
    """Where a new segment starts inside a parent: point index, gap in hours to one decimal, and the marker 999."""
    return stepped.filter(~F.col("within_segment")).select(parent, "idx", F.bround("step_hours", 1).alias("gap_hours"), F.lit(999).alias("marker"))


def motion(stepped: DataFrame, parent: str = "track_id") -> DataFrame:
    """distance_km over steps inside segments, and the greatest speed and gap (0 for single points)."""
    inside = F.when(F.col("within_segment"), F.col("step_km"))
    return stepped.groupBy(parent).agg(
        F.rint(F.coalesce(F.sum(inside), F.lit(0.0))).cast("long").alias("distance_km"),
        F.coalesce(F.max("speed_ms"), F.lit(0.0)).alias("max_speed_ms"),
        F.coalesce(F.max("step_hours"), F.lit(0.0)).alias("max_gap_hours"),
    )


def run_lengths(points: DataFrame, value: Column, key: str = "track_id", order: tuple[str, ...] = ("time",)) -> DataFrame:
    """Run-length encoding: start and end (0-based, inclusive) and the value of each maximal run."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = points.select(key, *order, value.alias("value")).withColumn("idx", F.row_number().over(w) - 1)
    changed = F.coalesce(~F.lag("value").over(w).eqNullSafe(F.col("value")), F.lit(True)) | (F.col("idx") == 0)
    runs = marked.withColumn("run", F.sum(changed.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(key, "run").agg(F.min("idx").alias("start"), F.max("idx").alias("end"), F.first("value").alias("value")).drop("run")


def missing_runs(points: DataFrame, observed: Column, key: str = "track_id") -> DataFrame:
    """Maximal runs of points that were not observed."""
    return run_lengths(points, observed, key).filter(~F.col("value")).drop("value")


def max_missing_run(points: DataFrame, observed: Column, key: str = "track_id") -> DataFrame:
    """Length of the longest such run of each track; 0 without one."""
    size = F.when(~F.col("value"), F.col("end") - F.col("start") + 1)
    return run_lengths(points, observed, key).groupBy(key).agg(F.coalesce(F.max(size), F.lit(0)).alias("max_missing_run_hours"))


def expand_runs(runs: DataFrame, key: str = "track_id") -> DataFrame:
    """Inverse of ``run_lengths``: a value for each index."""
    return runs.select(key, F.explode(F.sequence("start", "end")).alias("idx"), "value")


def hours_since_genesis(points: DataFrame, key: str = "track_id") -> DataFrame:
    hours = epoch_hours(F.col("time"))
    return points.withColumn("hour", F.rint(hours - F.min(hours).over(Window.partitionBy(key))).cast("int"))


def typical_step(stepped: DataFrame, key: str = "track_id") -> DataFrame:
    """Median positive step in hours, 1 without one."""
    positive = F.when(F.col("step_hours") > 0, F.col("step_hours"))
    return stepped.groupBy(key).agg(F.coalesce(F.percentile(positive, 0.5), F.lit(1.0)).alias("typical_step"))


def line_groups(stepped: DataFrame, value: Column, key: str = "track_id", max_gap: float = 6) -> DataFrame:
    """Numbers the pieces of a line through the non-null values: a gap over ``max_gap`` hours or a segment break between
    two of them starts a new piece."""
    w = Window.partitionBy(key).orderBy("idx")
    breaks_so_far = F.sum(F.coalesce(~F.col("within_segment"), F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    kept = stepped.withColumn("value", value).withColumn("breaks", breaks_so_far).filter(F.col("value").isNotNull())
    hours = epoch_hours(F.col("time"))
    new = F.coalesce((hours - F.lag(hours).over(w) > max_gap) | (F.lag("breaks").over(w) != F.col("breaks")), F.lit(False))
    return kept.withColumn("piece", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).select(key, "idx", "value", "piece")


def thin_path(stepped: DataFrame, step: int, key: str = "track_id", months: tuple[int, ...] | None = None) -> DataFrame:
    """Every step-th point of a path and its last one; with months, only points in them, and a left-out point or a
    segment break starts a new line."""
    w = Window.partitionBy(key).orderBy("idx")
    last = F.max("idx").over(Window.partitionBy(key))
    inside = F.month("time").isin(*months) if months else F.lit(True)
    marked = stepped.withColumns({"last": last, "inside": inside})
    new = F.coalesce(~F.col("within_segment"), F.lit(False)) | ~F.coalesce(F.lag("inside").over(w), F.lit(True))
    marked = marked.withColumn("line", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.filter(F.col("inside") & ((F.col("idx") % step == 0) | (F.col("idx") == F.col("last")))).select(key, "idx", "line", "lat", "lon")


def stride_sample(rows: DataFrame, key: str = "track_id", max_rows: int = 160) -> DataFrame:
    """Every ceil(n / max_rows)-th row of a track and its last one."""
    whole = Window.partitionBy(key)
    n = F.count("*").over(whole)
    rows = rows.withColumn("stride", F.ceil(n / F.lit(max_rows))).withColumn("last", F.max("idx").over(whole))
    return rows.filter((F.col("idx") % F.col("stride") == 0) | (F.col("idx") == F.col("last"))).drop("stride", "last")


def split_path(stepped: DataFrame, parent: str = "track_id") -> DataFrame:
    """Lines between segment breaks; a piece of one point is dropped."""
    w = Window.partitionBy(parent).orderBy("idx")
    piece = F.sum(F.coalesce(~F.col("within_segment"), F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    numbered = stepped.withColumn("piece", piece)
    return numbered.withColumn("n", F.count("*").over(Window.partitionBy(parent, "piece"))).filter("n >= 2").select(parent, "piece", "idx", "lat", "lon")
