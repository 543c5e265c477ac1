"""Densities and visible points of any months and any cohort, from aggregates that are made once.

``density_bitmaps`` passes over the points once: for each grid cell and each set of months that a sample needs (one month, or
the two at the ends of a step) it keeps the bitmap of the tracks that were there. Months and cohorts are then chosen by
filtering, uniting and intersecting bitmaps. A bitmap is cut into words of 64 tracks and only words with a track have a row, so
a few tracks of a cell never cost a bitmap of all, and words are united by hash. Tracks are known by whole numbers, dense
numbers in the order of genesis make fewest words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _month_bit(time: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), F.month(time) - 1)


def _word(number: str) -> Column:
    return F.shiftright(F.col(number).cast("long"), 6)


def _bit(number: str) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col(number), F.lit(64)).cast("int"))


def months_mask(months: tuple[int, ...]) -> int:
    return sum(1 << (m - 1) for m in set(months))


def density_bitmaps(stepped: DataFrame, number: str = "track_no", cell: float = 0.5, parent: str = "track_id", clamp: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(cell_x, cell_y, months, word, bits): the tracks that were in a cell, of samples that need exactly these months.

    Samples are those of ``spatial.track_density``: a step needs the months of both its ends; where these differ, its end also
    stands alone, for month sets that lack the beginning."""
    w = Window.partitionBy(parent).orderBy("idx")
    rows = stepped.withColumns({"lat0": F.lag("lat").over(w), "lon0": F.lag("lon").over(w), "m0": F.lag(_month_bit(F.col("time"))).over(w), "m1": _month_bit(F.col("time"))})
    n = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(F.col("lat") - F.col("lat0")), F.abs(F.col("lon") - F.col("lon0"))) / cell)).cast("int")
    rows = rows.withColumn("n", n).withColumn("both", F.col("m0").bitwiseOR(F.col("m1")))
    alone = F.array(F.struct(F.lit(None).cast("int").alias("k"), F.col("m1").alias("months")))
    across = F.transform(F.sequence(F.lit(0), "n"), lambda k: F.struct(k.alias("k"), F.col("both").alias("months")))
    joined = F.coalesce(F.col("within_segment") & F.col("m0").isNotNull() & F.col("n").isNotNull(), F.lit(False))
    samples = F.when(~joined, alone).when(F.col("m0") == F.col("m1"), across).otherwise(F.concat(across, alone))
    each = rows.select(number, "lat0", "lon0", "lat", "lon", "n", F.explode(samples).alias("s"))
    share = F.col("s.k") / F.col("n")
    x, y = (F.floor(F.coalesce(F.col(a) + (F.col(b) - F.col(a)) * share, F.col(b)) / cell).cast("long") for a, b in (("lon0", "lon"), ("lat0", "lat")))
    if clamp:
        x, y = (F.greatest(F.lit(lo), F.least(F.lit(hi), v)) for v, lo, hi in ((x, clamp[0], clamp[1]), (y, clamp[2], clamp[3])))
    placed = each.select(x.alias("cell_x"), y.alias("cell_y"), F.col("s.months").alias("months"), _word(number).alias("word"), _bit(number).alias("bit"))
    return placed.groupBy("cell_x", "cell_y", "months", "word").agg(F.bit_or("bit").alias("bits"))


def cohort_bitmap(tracks: DataFrame, number: str = "track_no") -> DataFrame:
    """(word, bits) of a cohort's tracks."""
    return tracks.select(_word(number).alias("word"), _bit(number).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def density_of(bitmaps: DataFrame, months: tuple[int, ...] | None = None, cohort: DataFrame | None = None) -> DataFrame:
    """Distinct tracks in each cell, of some months and of a cohort's bitmap; points are not read. Cells without any have no row."""
    place = ["cell_x", "cell_y", "word"]
    if months is not None:
        bitmaps = bitmaps.filter(F.col("months").bitwiseAND(F.lit(~months_mask(months))) == 0)
    united = bitmaps.groupBy(*place).agg(F.bit_or("bits").alias("bits"))
    if cohort is not None:
        met = united.join(cohort.select("word", F.col("bits").alias("chosen")), "word")
        united = met.withColumn("bits", F.col("bits").bitwiseAND(F.col("chosen")))
    return united.groupBy("cell_x", "cell_y").agg(F.sum(F.bit_count("bits")).alias("n_tracks")).filter("n_tracks > 0")


def month_summaries(points: DataFrame, key: str = "track_id") -> DataFrame:
    """(key, month): the number of points of a track in a month, and their bounds."""
    bounds = (f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max)))
    return points.groupBy(key, F.month("time").alias("month")).agg(F.count("*").alias("n_points"), *bounds)


def visible(summaries: DataFrame, months: tuple[int, ...] | None = None, cohort: DataFrame | None = None, key: str = "track_id") -> DataFrame:
    """One row: visible points of some months and a cohort, and their bounds, from ``month_summaries``."""
    if months is not None:
        summaries = summaries.filter(F.col("month").isin(*months))
    if cohort is not None:
        summaries = summaries.join(cohort.select(key), key, "left_semi")
    bounds = (f(f"{n}_{c}").alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max)))
    return summaries.agg(F.coalesce(F.sum("n_points"), F.lit(0)).alias("n_points"), *bounds)
