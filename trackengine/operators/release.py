"""Release checks over tracks: speed caps, path efficiency, hourly series, reconciliation, families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackengine.functions.columns import haversine_km

# --- fixed values
MAX_SPEED_MS, MAX_RESIDUAL_KM, LOW_EFFICIENCY, COLLAPSE_SHARE = 20.0, 125.0, 0.1, 0.1
# ---


def kinematic_caps(stepped: DataFrame, residual_km: Column | None = None, key: str = "track_id") -> DataFrame:
    """One row: greatest speed, residual and acceleration (km/h per hour), and rows over the caps."""
    w = Window.partitionBy(key).orderBy("idx")
    kmh = F.col("speed_ms") * 3.6
    rows = stepped.withColumn("acceleration", F.when(F.col("within_segment"), F.abs(kmh - F.lag(kmh).over(w)) / F.col("step_hours"))).withColumn("residual", F.lit(0.0) if residual_km is None else residual_km)
    return rows.agg(
        F.max("speed_ms").alias("max_speed_ms"), F.count_if(F.col("speed_ms") > MAX_SPEED_MS).alias("n_fast"), F.max("residual").alias("max_residual_km"), F.count_if(F.col("residual") > MAX_RESIDUAL_KM).alias("n_far"), F.max("acceleration").alias("max_acceleration")
    )


def path_efficiency(stepped: DataFrame, key: str = "track_id") -> DataFrame:
    """Net displacement over path length of each track; null for a path of length 0."""
    ends = [f(F.struct("idx", "lat", "lon")).alias(n) for n, f in (("f", F.min), ("l", F.max))]
    out = stepped.groupBy(key).agg(*ends, F.sum("step_km").alias("path_km"))
    net = haversine_km(F.col("f.lat"), F.col("f.lon"), F.col("l.lat"), F.col("l.lon"))
    return out.select(key, F.when(F.col("path_km") > 0, net / F.col("path_km")).alias("efficiency"))


def low_tail(efficiency: DataFrame) -> DataFrame:
    low = F.count_if(F.col("efficiency") < LOW_EFFICIENCY)
    return efficiency.agg(F.count("*").alias("n"), low.alias("n_low"), (low / F.count("*")).alias("rate"))


def trailing_sum(points: DataFrame, column: str, hours: int = 24, key: str = "track_id") -> DataFrame:
    """Sum over the last ``hours`` hours and how many of them have a value. Points have ``hour``."""
    w = Window.partitionBy(key).orderBy("hour").rangeBetween(-(hours - 1), 0)
    return points.withColumns({"trailing_sum": F.sum(column).over(w), "valid_hours": F.count(column).over(w)})


def precipitation_checks(points: DataFrame, tolerance: float = 0.0, floor: float = 1.0, key: str = "track_id") -> DataFrame:
    """One row of counts: nulls, negatives, incomplete 24-hour histories, and isolated collapses (below a tenth of both
    neighbours, each above a floor) of the hourly and the 24-hour values."""
    w = Window.partitionBy(key).orderBy("hour")
    rows = trailing_sum(points, "precip", 24, key)
    first = F.min("hour").over(Window.partitionBy(key))

    def collapse(c: str) -> Column:
        before, after = F.lag(c).over(w), F.lead(c).over(w)
        return F.coalesce((before > floor) & (after > floor) & (F.col(c) < before * COLLAPSE_SHARE) & (F.col(c) < after * COLLAPSE_SHARE), F.lit(False))

    rows = rows.withColumns({"c1": collapse("precip"), "c24": collapse("trailing_sum"), "aged": F.col("hour") - first >= 23})
    return rows.agg(
        F.count_if(F.col("precip").isNull()).alias("n_null"), F.count_if(F.col("precip") < -tolerance).alias("n_negative"), F.count_if(F.col("aged") & (F.col("valid_hours") < 24)).alias("n_incomplete"), F.count_if("c1").alias("n_collapse_1h"), F.count_if("c24").alias("n_collapse_24h")
    )


def outside_fraction(points: DataFrame, flag: Column) -> DataFrame:
    return points.agg(F.avg(flag.cast("double")).alias("outside_fraction"))


def reconcile(stages: dict[str, tuple[DataFrame, DataFrame, DataFrame]]) -> DataFrame:
    """Inputs must be the selected and the rejected rows of each stage: (stage, inputs, selected, rejected, passed)."""
    out = None
    for name, tables in stages.items():
        one = None
        for column, t in zip(("inputs", "selected", "rejected"), tables, strict=True):
            n = t.agg(F.count("*").alias(column))
            one = n if one is None else one.crossJoin(n)  # one row each
        one = one.select(F.lit(name).alias("stage"), "*", (F.col("inputs") == F.col("selected") + F.col("rejected")).alias("passed"))
        out = one if out is None else out.unionByName(one)
    return out


def families(tracks: DataFrame, family: str, key: str = "track_id") -> DataFrame:
    """Events of each family."""
    return tracks.groupBy(family).agg(F.count_distinct(key).alias("n_events"))
