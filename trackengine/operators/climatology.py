"""Climatology of a cohort: yearly, monthly and decadal counts, zero-filled over complete years."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def complete_years(years: DataFrame, first_year: int, first_month: int, last_year: int, months: tuple[int, ...]) -> DataFrame:
    """Years (column ``year``) that the catalogue covers whole: after its first year, and that one too if no chosen month
    lies before the first covered one; none after ``last_year``."""
    first_ok = min(months) >= first_month
    return years.filter((F.col("year") <= last_year) & ((F.col("year") > first_year) | ((F.col("year") == first_year) & F.lit(first_ok))))


def year_table(tracks: DataFrame, low: int, high: int) -> DataFrame:
    return tracks.sparkSession.range(low, high + 1).select(F.col("id").alias("year"))


def annual_counts(tracks: DataFrame, years: DataFrame) -> DataFrame:
    counts = tracks.groupBy(F.col("start_year").alias("year")).agg(F.count("*").alias("n"))
    return years.join(counts, "year", "left").select("year", F.coalesce("n", F.lit(0)).alias("n"))


def monthly_counts(tracks: DataFrame, mode: str = "genesis") -> DataFrame:
    """12 rows: genesis month, peak month, or one for each month that a track touches."""
    if mode == "active":
        months = F.filter(F.sequence(F.lit(1), F.lit(12)), lambda m: F.col("month_mask").bitwiseAND(F.call_function("shiftleft", F.lit(1), m - 1)) != 0)
        rows = tracks.select(F.explode(months).alias("month"))
    else:
        rows = tracks.select(F.col("start_month" if mode == "genesis" else "peak_month").alias("month"))
    counts = rows.groupBy("month").agg(F.count("*").alias("n"))
    grid = tracks.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    return grid.join(counts, "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("n"))


def decade_classes(tracks: DataFrame, years: DataFrame, classes: tuple[int, ...] = (1, 2, 3, 4, 5, 6)) -> DataFrame:
    """Counts of each class in a decade divided by its complete years (1 at least), a column a class."""
    exposure = years.groupBy((F.floor(F.col("year") / 10) * 10).alias("decade")).agg(F.greatest(F.count("*"), F.lit(1)).alias("years"))
    inside = tracks.join(years, tracks["start_year"] == years["year"], "left_semi")
    counts = inside.groupBy((F.floor(F.col("start_year") / 10) * 10).alias("decade")).pivot("category", list(classes)).agg(F.count(F.lit(1)))
    out = exposure.join(counts, "decade", "left")
    return out.select("decade", *((F.coalesce(F.col(str(c)), F.lit(0)) / F.col("years")).alias(f"class_{c}") for c in classes))
