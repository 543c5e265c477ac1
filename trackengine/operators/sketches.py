"""Distinct counts of a growing catalogue: a sketch a partition, kept beside the data and united on demand.

A sketch (HyperLogLog) of a few kilobytes stands for the identities of one partition. The count over any partitions is that of
the united sketches; a new partition adds its own sketch, and only its rows are read. Exact counts stay there on demand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackengine.sources import scratch

#: Base-2 logarithm of a sketch's registers: a relative standard error of 1.04 / sqrt(2 ** LOG2_REGISTERS), some 1.6 %.
LOG2_REGISTERS = 12


def relative_error(deviations: float = 3.0) -> float:
    return deviations * 1.04 / 2 ** (LOG2_REGISTERS / 2)


def sketch(rows: DataFrame, partition: str, columns: list[str]) -> DataFrame:
    """(partition, rows, a sketch of each column's values); nulls don't count."""
    made = (F.hll_sketch_agg(F.col(c).cast("string"), F.lit(LOG2_REGISTERS)).alias(c) for c in columns)
    return rows.groupBy(F.col(partition).alias("partition")).agg(F.count("*").alias("rows"), *made)


def add(spark: SparkSession, path: str, rows: DataFrame, partition: str, columns: list[str]) -> None:
    """Writes the sketches of the partitions that ``rows`` holds, each in its own folder; those that were there are replaced."""
    made = sketch(rows, partition, columns).withColumn("of", F.col("partition"))
    made.repartition("of").write.partitionBy("of").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def forget(spark: SparkSession, path: str, partition: object) -> None:
    """Takes a partition out of all counts."""
    scratch.delete_path(spark, f"{path}/of={partition}")


def distinct_counts(spark: SparkSession, path: str, columns: list[str], partitions: list | None = None) -> DataFrame:
    """One row: rows, and the approximate number of distinct values of each column, over all or some partitions."""
    read = spark.read.parquet(path)
    if partitions is not None:
        read = read.filter(F.col("partition").isin(partitions))
    united = (F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in columns)
    return read.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), *united)


def exact_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.agg(F.count("*").alias("rows"), *(F.count_distinct(c).alias(c) for c in columns))


def count_gate(approximate: DataFrame, exact: DataFrame, columns: list[str], deviations: float = 3.0) -> DataFrame:
    """(column, exact, within): whether each approximate count is as near to the exact one as sketches promise. Both have one row."""
    names = [c.alias(n) for n, c in ((f"{k}_{c}", d[c]) for k, d in (("a", approximate), ("e", exact)) for c in columns)]
    both = approximate.crossJoin(exact).select(*names)  # one row each
    entries = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"e_{c}").alias("exact"), (F.abs(F.col(f"a_{c}") - F.col(f"e_{c}")) <= F.ceil(F.col(f"e_{c}") * relative_error(deviations))).alias("within")) for c in columns))
    return both.select(F.explode(entries).alias("r")).select("r.*")
