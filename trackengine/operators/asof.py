"""Nearest in time: an as-of join that merges both sides instead of copying one of them into buckets.

Rows of both sides are put together and dealt by key and slice of time, sorted once in each direction, and the last and the
next point are carried to each row. What a slice can't know is handed over its edges: a summary of each slice (its first
and last point, one row) is carried on over the slices of a key. No row is copied, and the tolerance is a filter, so a
long one costs what a short one does. A key with very many rows is split by its slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hours of a slice: ten days of hourly points.
SLICE_HOURS = 240.0


def nearest_in_time(rows: DataFrame, points: DataFrame, keys: list[str], at: str, time: str, payload: list[str], tolerance: float | None = None, later_wins: bool = False, slice_width: float = SLICE_HOURS) -> DataFrame:
    """Each of ``rows`` with the point of its key whose ``time`` is nearest to ``at``: the point's time and ``payload`` columns,
    and ``away``. Times are numbers of one unit. The earlier point wins a tie unless ``later_wins``; of points of one time the
    least in ``payload``.

    Rows without a point within ``tolerance`` (inclusive) are dropped, like rows whose time or one of whose keys is null.
    Points without a time are left out. ``rows`` must not have columns of the names in ``time`` and ``payload``."""
    point = F.struct(F.col(time).alias("t"), *payload)
    left = rows.select(*keys, F.col(at).cast("double").alias("_t"), F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("_row"))
    right = points.select(*keys, F.col(time).cast("double").alias("_t"), point.alias("_point")).filter(F.col("_t").isNotNull())
    both = left.filter(F.col("_t").isNotNull()).unionByName(right, allowMissingColumns=True)
    both = both.withColumn("_slice", F.floor(F.col("_t") / slice_width))
    inside, place = Window.partitionBy(*keys, "_slice"), [*keys, "_slice"]
    carried = lambda order: F.last("_point", True).over(inside.orderBy(order, F.col("_row").isNotNull(), F.col("_point").desc()).rowsBetween(Window.unboundedPreceding, 0))
    merged = both.withColumns({"_back": carried(F.col("_t").asc()), "_ahead": carried(F.col("_t").desc())}).filter("_row is not null")

    # the first and the last point of each slice, of the least payload each
    ends = both.groupBy(*place).agg(F.min("_point").alias("_first"), F.min(F.when(F.col("_point").isNotNull(), F.struct((-F.col("_t")).alias("n"), "_point"))).alias("_last"))
    over = Window.partitionBy(*keys).orderBy("_slice")
    handed = ends.select(
        *(F.col(c).alias(f"_k_{c}") for c in place),
        F.last("_last._point", True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first("_first", True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
    )
    met = merged.join(handed, [F.col(c) == F.col(f"_k_{c}") for c in place])
    back, ahead = F.coalesce("_back", "_before"), F.coalesce("_ahead", "_after")
    behind, before = F.col("_t") - back["t"], ahead["t"] - F.col("_t")
    takes_back: Column = ahead.isNull() | (behind < before if later_wins else behind <= before)
    best = F.when(back.isNotNull() & takes_back, back).otherwise(ahead)
    out = met.select(F.col("_row"), best.alias("_best"), F.abs(F.col("_t") - best["t"]).alias("away")).filter("_best is not null")
    if tolerance is not None:
        out = out.filter(F.col("away") <= tolerance)
    return out.select("_row.*", F.col("_best.t").alias(time), *(F.col(f"_best.{c}").alias(c) for c in payload), "away")
