"""The track catalogue: parquet files of which only some columns are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: the columns that a build reads, with their types, and what rows are ordered by
COLUMNS = {
    "track_id": "long",
    "event_id": "long",
    "continuity_parent_track_id": "long",
    "continuity_segment_number": "int",
    "time": "timestamp",
    "lon": "double",
    "lat": "double",
    "position_source": "string",
    "candidate_diagnostics_available": "boolean",
    "imd_category": "int",
    "max_vort_smoothed": "double",
    "precip_24hr": "double",
    "max_wind": "double",
    "min_mslp": "double",
    "pressure_deficit_hpa": "double",
    "q850_mean_gkg": "double",
    "rh850_mean_pct": "double",
    "t850_mean_k": "double",
    "passes_mature_physics": "double",
}
ORDER = ("continuity_parent_track_id", "time", "track_id")
# ---


def read_catalogue(spark: SparkSession, paths: str | list[str], columns: list[str] | None = None) -> DataFrame:
    """The named columns (all of ``COLUMNS`` unless given) and ``month``, in the types of ``COLUMNS``; times are UTC.

    Other columns of the files are not read. A named column that the files lack fails the read."""
    names = list(columns or COLUMNS)
    found = spark.read.parquet(*([paths] if isinstance(paths, str) else paths)).select(*names)
    found = found.select(*(F.col(c).cast(COLUMNS[c]).alias(c) if c in COLUMNS else F.col(c) for c in names))
    return found.withColumn("month", F.month("time")) if "time" in names else found


def by_parent(catalogue: DataFrame) -> DataFrame:
    """A parent's rows in one task, in the catalogue's order; nothing is sorted as a whole."""
    return catalogue.repartition(ORDER[0]).sortWithinPartitions(*ORDER)
