"""Percentile ranks over releases: counts of values in ranges, to which a release's changes are merged.

The values are dealt to fixed ranges; a folder holds, for each range, how often each of its values occurs, as a run a release,
and the range's total. A release writes its changes, rows that came and rows that went, as a new run of the ranges that it
touches; no other range is read or written. The rank of a value follows from the totals of the ranges before its own and
the counts inside it, so ranking some values reads their ranges and the totals. Runs are merged when there are many.

A change counts once it is listed in the last state, so one that fails changes nothing."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackengine.sources import scratch

#: Runs that are merged into one.
MOST_RUNS = 6


@dataclass
class OrderRuns:
    spark: SparkSession
    path: str
    state: dict

    @classmethod
    def create(cls, values: DataFrame, path: str, column: str, ranges: int | None = None) -> OrderRuns:
        """A new folder of the values of a column; nulls and NaN have no rank. Ranges, the shuffle partitions unless given, hold
        as many values at first; they can't be changed later."""
        spark = values.sparkSession
        ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
        known = cls._known(values, column)
        bounds = known.agg(F.percentile_approx("v", [k / ranges for k in range(1, ranges)], 100 * ranges)).first()[0] if ranges > 1 else None
        out = cls(spark, path, {"bounds": sorted(set(bounds or [])), "runs": [], "release": -1})
        out._add(known.withColumn("n", F.lit(1)))
        return out

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> OrderRuns:
        states = scratch.names_in(spark, f"{path}/states")
        if not states:
            raise ValueError(f"no runs in {path}")
        return cls(spark, path, json.loads(spark.read.text(f"{path}/states/{states[-1]}").first()[0]))

    @staticmethod
    def _known(values: DataFrame, column: str) -> DataFrame:
        v = F.col(column).cast("double")
        return values.select((v + F.lit(0.0)).alias("v")).filter("v is not null and not isnan(v)")

    def _range(self, value: Column) -> Column:
        bounds = self.state["bounds"]
        return F.size(F.filter(F.array(*(F.lit(float(b)) for b in bounds)), lambda b: b <= value)) if bounds else F.lit(0)

    def _add(self, changes: DataFrame) -> None:
        """``changes``: v and n, which is negative for values that went."""
        runs, name = self.state["runs"], f"run-{uuid.uuid4().hex}"
        counted = changes.groupBy(self._range(F.col("v")).alias("range"), "v").agg(F.sum("n").alias("n")).filter("n <> 0")
        self._write(counted, name)
        runs = [*runs, name]
        if len(runs) > MOST_RUNS:
            merged = f"run-{uuid.uuid4().hex}"
            self._write(self._counts(runs), merged)
            runs = [merged]
        state = {"bounds": self.state["bounds"], "runs": runs, "release": self.state["release"] + 1}
        staged = f"{self.path}/staged-{uuid.uuid4().hex}"
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.text(staged)
        scratch.rename_path(self.spark, staged, f"{self.path}/states/{state['release']:09d}")
        self.state = state

    def _write(self, counts: DataFrame, name: str) -> None:
        counts.repartition("range").sortWithinPartitions("range", "v").write.partitionBy("range").parquet(f"{self.path}/runs/{name}")
        made = self._read("runs", [name])
        made.groupBy("range").agg(F.sum("n").alias("n")).coalesce(1).write.parquet(f"{self.path}/totals/{name}")

    def _read(self, kind: str, runs: list[str]) -> DataFrame:
        schema = "v double, n long, range int" if kind == "runs" else "range int, n long"
        out = None
        for r in runs:  # MOST_RUNS at most
            one = self.spark.read.schema(schema).parquet(f"{self.path}/{kind}/{r}")
            out = one if out is None else out.unionByName(one)
        return out

    def _counts(self, runs: list[str] | None = None, ranges: list[int] | None = None) -> DataFrame:
        rows = self._read("runs", runs or self.state["runs"])
        if ranges is not None:
            rows = rows.filter(F.col("range").isin(ranges))
        return rows.groupBy("range", "v").agg(F.sum("n").alias("n")).filter("n <> 0")

    def apply(self, came: DataFrame, went: DataFrame, column: str) -> None:
        """A release: rows whose values came, and rows whose values went."""
        self._add(self._known(came, column).withColumn("n", F.lit(1)).unionByName(self._known(went, column).withColumn("n", F.lit(-1))))

    def totals(self) -> DataFrame:
        """(range, n, less, total): values in a range, in all ranges before it, and in all. A row a range."""
        rows = self._read("totals", self.state["runs"]).groupBy("range").agg(F.sum("n").alias("n"))
        whole = Window.partitionBy(F.lit(0))  # a row a range
        return rows.select("range", "n", F.coalesce(F.sum("n").over(whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("less"), F.sum("n").over(whole).alias("total"))

    def ranks(self, ascending: bool = True, ranges: list[int] | None = None) -> DataFrame:
        """v and its percentile rank (``ranks.percentile_rank``), of all values or those in some ranges."""
        w = Window.partitionBy("range").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
        inside = self._counts(ranges=ranges).withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
        met = inside.join(F.broadcast(self.totals().select("range", "less", "total")), "range")  # a row a range
        less = F.col("less") + F.col("before")
        less = less if ascending else F.col("total") - less - F.col("n")
        return met.select("v", F.rint(F.lit(100.0) * (less + (F.col("n") + 1) / F.lit(2.0)) / F.col("total")).cast("int").alias("pct"))

    def rank_rows(self, rows: DataFrame, column: str, out: str, ascending: bool = True) -> DataFrame:
        """``rows`` with the percentile rank of their values; 0 where there is none or the value is not known here. Reads the
        ranges of these values only."""
        touched = [r["r"] for r in self._known(rows, column).select(self._range(F.col("v")).alias("r")).distinct().collect()]  # at most as many as ranges
        found = self.ranks(ascending, touched)
        return rows.join(found, (F.col(column).cast("double") + F.lit(0.0)) == found["v"], "left").drop("v").withColumn(out, F.coalesce("pct", F.lit(0))).drop("pct")
