"""A catalogue laid out for the jobs that read it: partitioned by the year in which a parent begins, bucketed by parent and
sorted by parent and time inside buckets.

A parent lies whole in one partition and one bucket, also where it lasts over New Year. So a filter on years reads these
years' folders only, a semi join with a cohort prunes folders at run time, and windows, aggregates and joins by parent
stand on the scan without a shuffle; over one year, where a bucket is one file, without a sort either."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackengine.sources.catalogue import ORDER

YEAR = "start_year"


@contextmanager
def sorted_scans(spark: SparkSession) -> Iterator[None]:
    """Plans made inside rely on the order of rows in a bucket of one file."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write_layout(points: DataFrame, path: str, buckets: int | None = None, order: tuple[str, ...] = ORDER) -> None:
    """Writes ``points`` below ``path``; ``order`` is the parent, the time and what breaks ties. Buckets are the shuffle
    partitions unless given. Points whose parent or time is null have no place in a track and are refused."""
    spark, (parent, time, *_) = points.sparkSession, order
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = F.col(parent).isNotNull() & F.col(time).isNotNull()
    checked = points.withColumn(parent, F.when(known, F.col(parent)).otherwise(F.raise_error(F.lit("a point without parent or time")).cast(points.schema[parent].dataType)))
    begins = checked.groupBy(parent).agg(F.year(F.min(time)).alias(YEAR))
    name = f"layout_{uuid.uuid4().hex}"
    placed = checked.join(begins, parent).repartition(buckets, parent)
    placed.write.partitionBy(YEAR).bucketBy(buckets, parent).sortBy(*order).option("path", f"{path}/points").format("parquet").saveAsTable(name)
    spark.sql(f"drop table {name}")  # the files stay
    said = {"buckets": buckets, "order": list(order), "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema)}
    spark.createDataFrame([(json.dumps(said),)], "value string").coalesce(1).write.text(f"{path}/layout")


def open_layout(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """The points of a layout, of which Spark knows partitions, buckets and order. They are registered in the session's catalog
    under ``name``, a new one unless given; dropping that table leaves the files."""
    said = json.loads(spark.read.text(f"{path}/layout").first()[0])
    name, by = name or f"layout_{uuid.uuid4().hex}", ", ".join(f"`{c}`" for c in said["order"])
    spark.sql(f"create table {name} ({said['schema']}) using parquet partitioned by ({YEAR}) clustered by (`{said['order'][0]}`) sorted by ({by}) into {said['buckets']} buckets location '{path}/points'")
    spark.sql(f"alter table {name} recover partitions")
    return spark.table(name)


def of_years(points: DataFrame, low: int, high: int) -> DataFrame:
    """Points of parents that begin in these years; other years' folders are not read."""
    return points.filter(F.col(YEAR).between(low, high))


def of_cohort(points: DataFrame, cohort: DataFrame, parent: str = ORDER[0]) -> DataFrame:
    """Points of a cohort's parents; ``cohort`` has the parent and ``start_year``, by which folders are pruned at run time."""
    return points.join(cohort.select(parent, YEAR), [YEAR, parent], "left_semi")
