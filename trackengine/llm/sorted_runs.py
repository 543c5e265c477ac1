"""Sorted immutable runs: a log-structured table in a folder of the shared file system.

A run holds one row a key: how often the key occurred (``n``) and, where that is once, where. It is a parquet table
bucketed and sorted by its keys and never changes. All runs have the same number of buckets, so runs are joined by
merging bucket with bucket: neither a shuffle nor a sort stands over a run. Newer runs are merged into older ones of a
similar size (``RATIO``), so there are as many runs as the logarithm of the keys, and a key is rewritten as often.

Tables are registered in Spark's catalog only while they are resolved; what lasts are the files.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackengine.llm.common import delete_path, names_in

#: Two neighbouring runs are merged if the older one has less than so many times the rows of the newer one.
RATIO = 2


@contextmanager
def sorted_scans(spark: SparkSession) -> Iterator[None]:
    """Lets Spark rely on the order of rows inside buckets of one file."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write_bucketed(rows: DataFrame, path: str, keys: list[str], buckets: int) -> None:
    """One file a bucket, if ``rows`` are partitioned by the keys into as many parts."""
    name = f"run_{uuid.uuid4().hex}"
    rows.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).format("parquet").saveAsTable(name)
    rows.sparkSession.sql(f"drop table {name}")


def read_bucketed(spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int) -> DataFrame:
    name, by = f"run_{uuid.uuid4().hex}", ", ".join(f"`{k}`" for k in keys)
    spark.sql(f"create table {name} ({schema}) using parquet clustered by ({by}) sorted by ({by}) into {buckets} buckets location '{path}'")
    out = spark.table(name)
    spark.sql(f"drop table {name}")
    return out


class SortedRuns:
    """``keys`` and ``places`` are columns as DDL, such as ``{"hash": "long"}``; a place counts only where n is 1."""

    def __init__(self, spark: SparkSession, path: str, keys: dict[str, str], places: dict[str, str], buckets: int, runs: list[tuple[str, int]] | None = None):
        self.spark, self.path, self.keys, self.places, self.buckets = spark, path, list(keys), list(places), buckets
        self.schema = ", ".join(f"`{c}` {kind}" for c, kind in (keys | {"n": "long"} | places).items())
        self.runs: list[tuple[str, int]] = list(runs or [])  # name and rows, the oldest first

    def read(self, name: str) -> DataFrame:
        return read_bucketed(self.spark, f"{self.path}/{name}", self.schema, self.keys, self.buckets)

    def _write(self, rows: DataFrame) -> tuple[str, int]:
        name = f"run-{uuid.uuid4().hex}"
        write_bucketed(rows.select(*self.keys, "n", *self.places), f"{self.path}/{name}", self.keys, self.buckets)
        return name, self.read(name).count()

    def add(self, occurrences: DataFrame) -> str:
        """Stores the keys of ``occurrences`` (keys and places, one row an occurrence) as a new run and returns its name."""
        counted = occurrences.groupBy(*self.keys).agg(F.count("*").alias("n"), *(F.min(c).alias(c) for c in self.places))
        if int(self.spark.conf.get("spark.sql.shuffle.partitions")) != self.buckets:
            counted = counted.repartition(self.buckets, *self.keys)
        self.runs.append(self._write(counted))
        return self.runs[-1][0]

    def met(self, name: str) -> DataFrame:
        """A run merge-joined with all earlier ones: its columns, ``seen`` (earlier occurrences) and the earlier places, as ``old_*``."""
        earlier = [r for r, _ in self.runs[: [r for r, _ in self.runs].index(name)]]
        out, seen = self.read(name), F.lit(0).cast("long")
        for k, old in enumerate(earlier):
            out = out.join(self.read(old).select(*self.keys, F.col("n").alias(f"n_{k}"), *(F.col(c).alias(f"{c}_{k}") for c in self.places)), self.keys, "left")
            seen += F.coalesce(F.col(f"n_{k}"), F.lit(0))
        first = lambda c: F.coalesce(F.lit(None), *(F.col(f"{c}_{k}") for k in range(len(earlier))))
        return out.select(*self.keys, "n", *self.places, seen.alias("seen"), *(first(c).alias(f"old_{c}") for c in self.places))

    def totals(self) -> DataFrame:
        """Every key once, with its occurrences in all runs and the place that its oldest run gives."""
        out = None
        for k, (name, _) in enumerate(self.runs):
            one, n = self.read(name), F.col("n")
            for j, (other, _) in enumerate(self.runs):
                if j < k:  # the older run gives the key
                    one = one.join(self.read(other), self.keys, "left_anti")
                elif j > k:
                    one = one.join(self.read(other).select(*self.keys, F.col("n").alias(f"n_{j}")), self.keys, "left")
                    n += F.coalesce(F.col(f"n_{j}"), F.lit(0))
            one = one.select(*self.keys, n.alias("n"), *self.places)
            out = one if out is None else out.unionByName(one)
        return out

    def compact(self, ratio: int = RATIO) -> None:
        """Merges neighbouring runs of similar size, the newest first. The files of merged ones stay."""
        while len(self.runs) > 1 and self.runs[-2][1] < ratio * self.runs[-1][1]:
            (old, _), (new, _) = self.runs[-2:]
            right = self.read(new).select(*self.keys, F.col("n").alias("n_new"), *(F.col(c).alias(f"{c}_new") for c in self.places))
            both = self.read(old).join(right, self.keys, "full")
            n = F.coalesce("n", F.lit(0)) + F.coalesce("n_new", F.lit(0))
            merged = both.select(*self.keys, n.alias("n"), *(F.coalesce(c, f"{c}_new").alias(c) for c in self.places))
            self.runs[-2:] = [self._write(merged)]

    def clean(self) -> None:
        """Deletes merged and abandoned runs; for after the list of runs is stored."""
        for name in set(names_in(self.spark, self.path)) - {name for name, _ in self.runs}:
            delete_path(self.spark, f"{self.path}/{name}")
