"""Regional daily series and their means over tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

# --- fixed values: slugs whose series have other names
SPECIAL_SERIES = {
    "dadra_and_nagar_haveli": ["dadra-and-nagar-haveli-and-daman-and-diu"],
    "daman_and_diu": ["dadra-and-nagar-haveli-and-daman-and-diu"],
    "nct_of_delhi": ["delhi"],
    "jammu_and_kashmir": ["jammu-and-kashmir", "ladakh"],
}
# ---
#: Regions of one table of means.
MAX_REGIONS = 10_000


def alias_map(slugs: DataFrame, metadata: DataFrame, special: dict[str, list[str]] = SPECIAL_SERIES) -> DataFrame:
    """(slug, series): special slugs map to given series, others to their name with '-' for '_'; unknown series are ignored."""
    named = slugs.sparkSession.createDataFrame([(s, x) for s, ids in special.items() for x in ids], "slug string, series string")
    plain = slugs.join(named, "slug", "left_anti").select("slug", F.translate("slug", "_", "-").alias("series"))
    return slugs.join(named, "slug").unionByName(plain).join(metadata.select("series"), "series", "left_semi").select("slug", "series")


def combine(series: DataFrame, members: DataFrame) -> DataFrame:
    """Weighted mean per slug and day over the series that have data. series: series, d, value; members: slug, series, weight."""
    some = series.filter(F.col("value").isNotNull()).join(members, "series")
    return some.groupBy("slug", "d").agg((F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("value"))


def _day(rows: DataFrame, column: str = "d") -> Column:
    """A day as a number: dates count from 1970."""
    return F.unix_date(column) if isinstance(rows.schema[column].dataType, DateType) else F.col(column).cast("long")


def day_spans(track_days: DataFrame, key: str = "track_id") -> DataFrame:
    """(key, first, last): maximal runs of consecutive days that a track touches; nulls are no days."""
    days = track_days.select(key, _day(track_days).alias("day")).filter("day is not null").distinct()
    run = F.col("day") - F.row_number().over(Window.partitionBy(key).orderBy("day"))
    return days.withColumn("run", run).groupBy(key, "run").agg(F.min("day").alias("first"), F.max("day").alias("last")).drop("run")


def prefix_sums(daily: DataFrame) -> DataFrame:
    """day, and for all regions in order (slug, sum and number of values up to that day); from the day before the first one on.

    A row a day, of at most ``MAX_REGIONS`` regions. Missing values count for nothing."""
    rows = daily.select("slug", _day(daily).alias("day"), F.col("value").cast("double").alias("value")).filter("day is not null")
    ends = rows.agg(F.min("day").alias("low"), F.max("day").alias("high"))
    slugs = rows.select("slug").distinct()
    grid = slugs.crossJoin(F.broadcast(ends)).select("slug", F.explode(F.sequence(F.col("low") - 1, "high")).alias("day"))  # ends are one row
    w = Window.partitionBy("slug").orderBy("day")  # as many rows as days
    known = F.col("value").isNotNull() & ~F.isnan("value")
    filled = grid.join(rows, ["slug", "day"], "left")
    up = filled.select("slug", "day", F.sum(F.when(known, F.col("value")).otherwise(0.0)).over(w).alias("s"), F.sum(known.cast("long")).over(w).alias("n"))
    listed = up.groupBy("day").agg(F.array_sort(F.collect_list(F.struct("slug", "s", "n"))).alias("up"))
    some = F.when(F.size("up") <= MAX_REGIONS, F.col("up")).otherwise(F.raise_error(F.lit("too many regions")).cast(listed.schema["up"].dataType))
    return listed.select("day", some.alias("up"))


def event_region_mean(track_days: DataFrame, daily: DataFrame, key: str = "track_id") -> DataFrame:
    """Mean of a region's value over the distinct days a track touches, half-even integer, with the number of days; -1 where
    no day has a value. Days are numbers or dates; ``daily`` has a row a region and day.

    Days are put together into spans, and a span's sum is the difference of two prefix sums: two look-ups a span for all
    regions at once, however many days it has. Sums are of doubles, so a mean may differ in its last binary digits from one
    that adds its days alone."""
    spans, sums = day_spans(track_days, key), prefix_sums(daily)
    ends = sums.agg(F.min("day").alias("low"), F.max("day").alias("high"))
    kept = spans.crossJoin(F.broadcast(ends)).select(  # ends are one row
        key, (F.col("last") - F.col("first") + 1).alias("days"), *(F.greatest("low", F.least("high", d)).alias(c) for c, d in (("before", F.col("first") - 1), ("upto", F.col("last"))))
    )
    at = lambda c: sums.select(F.col("day").alias(c), F.col("up").alias(f"{c}_sums"))
    met = kept.join(at("upto"), "upto").join(at("before"), "before")
    parts = F.zip_with("upto_sums", "before_sums", lambda x, y: F.struct(x["slug"].alias("slug"), (x["s"] - y["s"]).alias("s"), (x["n"] - y["n"]).alias("n")))
    out = met.select(key, "days", F.explode(parts).alias("p")).groupBy(key, F.col("p.slug").alias("slug")).agg(F.sum("days").alias("n_days"), F.sum("p.s").alias("s"), F.sum("p.n").alias("n"))
    return out.select(key, "slug", "n_days", F.when(F.col("n") > 0, F.rint(F.col("s") / F.col("n")).cast("long")).otherwise(-1).alias("mean"))


def top_region(means: DataFrame, key: str = "track_id") -> DataFrame:
    """The region with the highest mean of 0 or more (lowest slug on ties); null and -1 without one."""
    best = F.min(F.when(F.col("mean") >= 0, F.struct((-F.col("mean")).alias("m"), "slug")))
    return means.groupBy(key).agg(best.alias("b")).select(key, F.col("b.slug").alias("slug"), F.coalesce(-F.col("b.m"), F.lit(-1)).alias("mean"))


def cohort_region_mean(means: DataFrame, cohort: DataFrame, key: str = "track_id") -> DataFrame:
    """Mean by region over a cohort weighted by days, in tenths; system days and tracks. Highest first."""
    rows = means.join(cohort.select(key), key, "left_semi").filter("mean >= 0").withColumn("days", F.greatest(F.lit(1), F.col("n_days")))
    out = rows.groupBy("slug").agg((F.sum(F.col("mean") * F.col("days")) / F.sum("days") / 10).alias("value"), F.sum("days").alias("system_days"), F.count("*").alias("n_tracks"))
    return out.orderBy(F.desc("value"), "slug")
