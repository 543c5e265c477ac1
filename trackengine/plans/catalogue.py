"""All registered queries over tracks, and the flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackengine.operators import kinematics, ranks, summary
from trackengine.plans import fixtures, match_queries, release_queries, system_queries, track_queries  # noqa: F401
from trackengine.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "strongest_tracks"]


def strongest_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve tracks of the highest wind percentile, with their motion."""
    points = fixtures.fixes(spark, sf_dir)
    peaks = summary.peaks(points).select("track_id", F.col("peak_wind").alias("metric"))
    rows = summary.endpoints(points).join(kinematics.motion(kinematics.steps(points)), "track_id").join(ranks.percentile_rank(peaks, "metric"), "track_id")
    return ranks.top(rows, ranks.listing_order("strongest", "track_id"))
