"""Verification tables: match tiers, shared storms, separations, grades, and identity across releases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackengine.functions.columns import grade_class

# --- fixed values
SEPARATION_BINS = (0, 50, 100, 150, 200, 300, 500)
# ---


def confidence_counts(tracks: DataFrame) -> DataFrame:
    """Tiers, credible matches with a name, and the share of high ones among all tracks in percent."""
    tier = F.col("confidence")
    return tracks.agg(
        F.count_if(tier == "high").alias("high"),
        F.count_if(tier == "medium").alias("medium"),
        F.count_if(tier.isin("high", "medium") & (F.coalesce("display", F.lit("")) != "")).alias("named"),
        (100.0 * F.count_if(tier == "high") / F.count("*")).alias("high_share"),
    )


def multi_event_storms(matches: DataFrame) -> DataFrame:
    return matches.groupBy("sid").agg(F.count("*").alias("n_tracks")).filter("n_tracks > 1")


def histogram(rows: DataFrame, column: str, bounds: tuple[float, ...] = SEPARATION_BINS) -> DataFrame:
    """Counts of left-closed bins (the last one open), zero-filled."""
    lows = F.array(*(F.lit(float(b)) for b in bounds))
    binned = rows.filter(F.col(column) >= bounds[0]).groupBy(F.array_max(F.filter(lows, lambda b: b <= F.col(column))).alias("low")).agg(F.count("*").alias("n"))
    grid = rows.sparkSession.createDataFrame([(float(b),) for b in bounds], "low double")
    return grid.join(binned, "low", "left").select("low", F.coalesce("n", F.lit(0)).alias("n"))


def grade_matrix(tracks: DataFrame) -> DataFrame:
    """6 x 6 counts of class against official grade; other grades are left out."""
    counted = tracks.select("category", grade_class(F.col("grade")).alias("grade")).filter(F.col("grade").isNotNull()).groupBy("category", "grade").agg(F.count("*").alias("n"))
    grid = tracks.sparkSession.createDataFrame([(c, g) for c in range(1, 7) for g in range(1, 7)], "category int, grade int")
    return grid.join(counted, ["category", "grade"], "left").select("category", "grade", F.coalesce("n", F.lit(0)).alias("n"))


def fragments(matches: DataFrame, k: int = 60) -> DataFrame:
    """Storms with several tracks: the tracks, best tier and range of median distances; the k largest."""
    tier = F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "medium", 1).otherwise(2)
    out = matches.groupBy("sid").agg(
        F.array_sort(F.collect_list("track_id")).alias("tracks"),
        F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), F.min(tier) + 1).alias("best_tier"),
        F.min("median_km").alias("min_km"),
        F.max("median_km").alias("max_km"),
        F.count("*").alias("n"),
    )
    return out.filter("n > 1").orderBy(F.desc("n"), "sid").limit(k)


def identity_crosswalk(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Per old identity: observed uids, how many the new release has, retention, successors and the main one (most hits,
    lowest id on ties). Both have ``uid`` and ``key``."""
    hits = old.select(F.col(key).alias("old"), "uid").join(new.select(F.col(key).alias("new"), "uid"), "uid").groupBy("old", "new").agg(F.count("*").alias("hits"))
    main = hits.groupBy("old").agg(F.sum("hits").alias("hits"), F.count("*").alias("successors"), F.min(F.struct((-F.col("hits")).alias("h"), "new"))["new"].alias("primary"))
    counts = old.groupBy(F.col(key).alias("old")).agg(F.count("*").alias("n_uid"))
    out = counts.join(main, "old", "left")
    return out.select("old", "n_uid", F.coalesce("hits", F.lit(0)).alias("hits"), (F.coalesce("hits", F.lit(0)) / F.col("n_uid")).alias("retention"), F.coalesce("successors", F.lit(0)).alias("successors"), "primary")


def disposition(old: DataFrame, published: DataFrame, rejected: DataFrame) -> DataFrame:
    """Unpublished uids inside and outside explicitly rejected segments."""
    gone = old.select("uid").join(published.select("uid"), "uid", "left_anti")
    marked = gone.join(rejected.select("uid", F.lit(True).alias("in_rejected")).distinct(), "uid", "left")
    return marked.agg(F.count_if(F.col("in_rejected")).alias("inside"), F.count_if(F.col("in_rejected").isNull()).alias("outside"))


def compare_releases(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two one-row metric tables side by side, one row a metric."""
    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(*(F.col(c).cast("double").alias(c) for c in df.columns)).unpivot([], df.columns, "metric", name)

    return long(old, "old_value").join(long(new, "new_value"), "metric").withColumn("change", F.col("new_value") - F.col("old_value"))
