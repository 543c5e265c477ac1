"""Ranks, labels and neighbours.

What counts rows in an order, over a table or inside a group, never puts a table or group into one task: rows are dealt into
ranges of the order by Spark's range partitioning, written down, counted up inside each range, and offset by the totals of
the ranges before it (``running``). There are as many ranges as shuffle partitions, so they grow with the cluster's setting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackengine.functions.columns import CLASS_CODES, lookup
from trackengine.sources import scratch


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Join condition that takes nulls for equal; ``right`` has the columns with ``_r`` behind."""
    out = F.lit(True)
    for n in names:
        out &= left[n].eqNullSafe(right[f"{n}_r"])
    return out


def _with_r(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.withColumnsRenamed({n: f"{n}_r" for n in names})


def running(rows: DataFrame, group: list[str], order: list[Column], amount: Column, out: str, total: str) -> DataFrame:
    """Adds the sum of ``amount`` over the rows before in the order, and over all rows, inside each group; ``order`` must tell
    the rows of a group apart."""
    spark = rows.sparkSession
    # range partitioning samples its input: what that comes from is computed once
    first, path = (scratch.new_path(spark, name) for name in ("rows", "ranges"))
    rows = rows.withColumn("_amount", amount)
    rows.write.parquet(first)
    ranged = spark.read.schema(rows.schema).parquet(first).repartitionByRange(*(F.asc(c) for c in group), *order).withColumn("_range", F.spark_partition_id())
    ranged.write.parquet(path)
    ranged = spark.read.schema(ranged.schema).parquet(path)
    at = [*group, "_range"]
    sums = ranged.groupBy(*at).agg(F.sum("_amount").alias("_sum"))  # a row a range, and one more for each group
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*at, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"), F.sum("_sum").over(whole).alias(total))
    inside = Window.partitionBy(*at).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    counted = ranged.withColumn("_inside", F.coalesce(F.sum("_amount").over(inside), F.lit(0)))
    sums = _with_r(sums, at)
    return counted.join(sums, _same(counted, sums, at)).withColumn(out, F.col("_offset") + F.col("_inside")).drop("_amount", "_range", "_inside", "_offset", *(f"{n}_r" for n in at))


def _distinct_counts(rows: DataFrame, group: list[str], column: str, ascending: bool = True) -> DataFrame:
    """Each value of a group once: ``v``, how often it occurs (``n``), rows ``less`` than it, and the group's ``total``."""
    counts = rows.groupBy(*group, F.col(column).alias("v")).agg(F.count("*").alias("n"))
    return running(counts, group, [F.asc("v") if ascending else F.desc("v")], F.col("n"), "less", "total")


def _average_rank() -> Column:
    """Percentile (rank / n * 100) of a value's average rank, half-even."""
    return F.rint(F.lit(100.0) * (F.col("less") + (F.col("n") + 1) / F.lit(2.0)) / F.col("total")).cast("int")


def percentile_rank(rows: DataFrame, column: str, ascending: bool = True, out: str | None = None) -> DataFrame:
    """Tie-averaged percentile rank of a column over all rows, half-even integer; null ranks 0."""
    out = out or f"{column}_pct"
    counts = _distinct_counts(rows.filter(F.col(column).isNotNull()), [], column, ascending)
    ranks = counts.select("v", _average_rank().alias("rank_value"))
    return rows.join(ranks, rows[column] == ranks["v"], "left").drop("v").withColumn(out, F.coalesce("rank_value", F.lit(0))).drop("rank_value")


def percentile_rank_by(rows: DataFrame, group: str, column: str, out: str) -> DataFrame:
    """The same inside each group, over values of 0 and more; others get -1."""
    counts = _distinct_counts(rows.filter(F.col(column) >= 0), [group], column)
    ranks = _with_r(counts.select(group, "v", _average_rank().alias("rank_value")), [group])
    met = rows.join(ranks, _same(rows, ranks, [group]) & (rows[column] == ranks["v"]), "left")
    return met.withColumn(out, F.coalesce("rank_value", F.lit(-1))).drop("v", "rank_value", f"{group}_r")


def quantiles(rows: DataFrame, group: list[str], column: str, at: dict[str, float], moments: bool = False) -> DataFrame:
    """Exact quantiles of a column inside each group, linear between neighbours, from counts of its values; nulls don't count.
    With ``moments`` also the mean and n, the number of values."""
    counts = _distinct_counts(rows.filter(F.col(column).isNotNull()), group, column)
    holds = lambda place: (F.col("less") <= place) & (place < F.col("less") + F.col("n"))
    found, out = [], []
    for name, q in at.items():
        place = (F.col("total") - 1) * F.lit(q)
        found += [F.max(F.when(holds(F.floor(place)), F.col("v"))).alias(f"{name}_low"), F.max(F.when(holds(F.ceil(place)), F.col("v"))).alias(f"{name}_high"), F.max(place - F.floor(place)).alias(f"{name}_part")]
        low, high, part = (F.col(f"{name}_{c}").cast("double") for c in ("low", "high", "part"))
        out.append((low * (1 - part) + high * part).alias(name))
    if moments:
        found += [(F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"), F.sum("n").alias("n")]
        out += [F.col("mean"), F.col("n")]
    return counts.groupBy(*group).agg(*found).select(*group, *out)


def fallback_labels(systems: DataFrame, key: str = "id") -> DataFrame:
    """``CODE YYYY NN``: a running number inside year and class, by start and id; 2 digits at least."""
    placed = running(systems, ["start_year", "category"], [F.asc("start_hour"), F.asc(key)], F.lit(1).cast("long"), "_before", "_all")
    text = (F.col("_before") + 1).cast("string")
    padded = F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)
    return placed.withColumn("label", F.concat_ws(" ", lookup(F.col("category"), CLASS_CODES), F.col("start_year"), padded)).drop("_before", "_all")


def catalogue_parts(matches: DataFrame, key: str = "track_id") -> DataFrame:
    """Index and count of the tracks matched to one storm, by start and id."""
    w = Window.partitionBy("sid")
    return matches.withColumns({"part_index": F.row_number().over(w.orderBy("start_hour", key)), "part_count": F.count("*").over(w)})


def best_candidates(candidates: DataFrame, key: str = "track_id") -> DataFrame:
    """Best candidate by (score, median_km, sid) with its margin over the runner-up; null margin if it is alone."""
    w = Window.partitionBy(key).orderBy("score", "median_km", "sid")
    ranked = candidates.withColumns({"place": F.row_number().over(w), "margin": F.lead("score").over(w) - F.col("score")})
    return ranked.filter("place = 1").drop("place")


def neighbours(rows: DataFrame, order: list[Column], key: str, group: list[str]) -> DataFrame:
    """Previous and next key in the given order inside a group, wrapping round at its ends: rows are numbered and joined with
    the numbers beside them."""
    placed = running(rows, group, order, F.lit(1).cast("long"), "_place", "_all").select(key, *group, "_place", "_all")
    at = [*group, "_place"]
    beside = lambda step, name: _with_r(placed.select(*group, F.pmod(F.col("_place") + step, F.col("_all")).alias("_place"), F.col(key).alias(name)), at)
    for step, name in ((1, "previous"), (-1, "next")):
        other = beside(step, name)
        placed = placed.join(other, _same(placed, other, at)).drop(*(f"{n}_r" for n in at))
    return placed.select(key, *group, "previous", "next")


def listing_order(name: str, key: str = "id", metric: str = "metric", percentile: str = "metric_pct") -> list[Column]:
    """One of the six listing orders; the id is always the last key."""
    tier = lookup(F.col("confidence"), {"high": 0, "medium": 1, "low": 2})
    orders = {
        "newest": [F.desc("start_hour")],
        "oldest": [F.asc("start_hour")],
        "longest": [F.desc("duration_hours")],
        "farthest": [F.desc("distance_km")],
        "match": [F.coalesce(tier, F.lit(3)).asc(), F.desc(percentile)],
        "strongest": [F.desc(percentile), F.desc(metric)],
    }
    return [*orders[name], F.asc(key)]


def top(rows: DataFrame, order: list[Column], k: int = 12) -> DataFrame:
    """The first k rows: each task keeps k, nothing is sorted as a whole."""
    return rows.orderBy(*order).limit(k)


def rank_listing(rows: DataFrame, metric: str, largest: bool = True, k: int = 50, key: str = "id") -> DataFrame:
    """The k most extreme rows with an ordinal rank; only k rows meet in the ranking window."""
    order = [F.desc(metric) if largest else F.asc(metric), F.asc(key)]
    few = rows.filter(F.col(metric).isNotNull()).orderBy(*order).limit(k)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
