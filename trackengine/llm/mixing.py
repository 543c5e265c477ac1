"""Mixing sources to target weights.

Every document gets a hash-random key. The key space of each source is cut into equal ranges (keys are uniform, so the
ranges are even), each range is sorted by a window, and range totals give the offset of each range: a distributed
prefix sum of sizes. Sources are numbered in their order the same way, so no table of them reaches the driver. A source's budget takes whole epochs first, then documents in key order, and is cut exactly: the
last document gives the words that are still missing. Only ids and sizes are sorted; texts stay where they are.

Edge cases: a null or empty text has size 0 and gives nothing. A null source is a source of its own and sorts last.
Ties of keys go by doc_id and then by size; equal rows
at the cut share what is missing evenly, rounded down. An empty table gives no row. A source of
size 0 has target 0. Columns with clashing names are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackengine.llm.common import SPACE_WORD, Workspace

#: Weights by the sources' order, repeating.
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
#: Rows of a key range, and the least number of ranges a source has.
RANGE_ROWS, LEAST_RANGES = 50_000, 256
#: Sources whose table, some 100 bytes each, is broadcast.
BROADCAST_SOURCES = 10_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def _numbered(per_source: DataFrame) -> DataFrame:
    """Adds ``sid``, the source's number in code point order (null last): sorted ranges, and the ranges' totals as offsets."""
    ordered = per_source.repartitionByRange(F.col("source").isNull(), F.col("source")).sortWithinPartitions(F.col("source").isNull(), F.col("source"))
    at = F.monotonically_increasing_id()  # the range in the upper bits, the place in it in the lower 33
    work = Workspace(per_source.sparkSession, "mixing-sources")
    placed = work.write(ordered.withColumn("at", at).select("*", F.shiftright("at", 33).alias("range")).withColumn("at", F.col("at").bitwiseAND((1 << 33) - 1)), "placed")
    totals = placed.groupBy("range").agg(F.count("*").alias("rows"))  # a row a range
    before = F.sum("rows").over(Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = totals.select("range", F.coalesce(before, F.lit(0)).alias("start"))
    return placed.join(F.broadcast(starts), "range").withColumn("sid", F.col("start") + F.col("at")).drop("range", "start", "at")


def _level(sources: DataFrame, most: float) -> tuple[float, int]:
    """What one unit of weight gets, and the number of sources: shares of the sum of sizes stop at ``most`` times a source's size, the rest is reshared.

    Sources are capped in rounds, as the level rises; each round is one aggregation."""
    capped, known = (0.0, 0), None
    total, weight, count = (x or 0 for x in sources.agg(F.sum("source_size"), F.sum("weight"), F.count("*")).first())
    while capped != known and weight > capped[1]:
        known, level = capped, (total - capped[0]) / (weight - capped[1])
        over = sources.filter(F.lit(level) * F.col("weight") > most * F.col("source_size"))
        size, of = over.agg(F.sum("source_size"), F.sum("weight")).first()
        capped = (most * (size or 0), of or 0)
    return (level if weight else 0.0), count


def cuts(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MAX_EPOCHS) -> DataFrame:
    """Per source: its size, target, whole epochs, and the place in key order where its budget ends.

    ``sizes`` has doc_id, source and size. Only a few sums reach the driver, however many sources there are."""
    work = Workspace(sizes.sparkSession, "mixing-cuts")
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    weight = F.element_at(F.lit(list(weights)), (F.pmod("sid", F.lit(len(weights))) + 1).cast("int"))
    sources = work.write(_numbered(per_source).withColumn("weight", weight), "sources")
    level, n_sources = _level(sources, most)
    goal = F.least(F.lit(level) * F.col("weight"), most * F.col("source_size")).cast("double")
    words = F.rint("target").cast("long")
    plan = sources.withColumn("target", goal).select(
        "sid",
        F.col("source").alias("p_source"),
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long").alias("epochs"),
        F.when(F.col("source_size") > 0, words % F.col("source_size")).otherwise(0).cast("long").alias("rest"),
        F.greatest(F.lit(LEAST_RANGES), F.ceil(F.col("n") / RANGE_ROWS)).cast("long").alias("ranges"),
    )
    rows = _keyed(sizes).join(_small(plan.select("sid", "p_source", "rest", "ranges"), n_sources), F.col("source").eqNullSafe(F.col("p_source")))
    rows = rows.withColumn("range", F.floor(F.col("key") / 2.0**60 * F.col("ranges")).cast("long"))
    rows = rows.groupBy("sid", "rest", "range", "key", "doc_id", "size").agg(F.count("*").alias("alike"))
    amount = F.col("size") * F.col("alike")
    by_range = rows.groupBy("sid", "range").agg(F.sum(amount).alias("range_size"))
    before = Window.partitionBy("sid").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_range.select("sid", "range", F.coalesce(F.sum("range_size").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("sid", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("prefix", F.coalesce(F.sum(amount).over(inside), F.lit(0))).join(offsets, ["sid", "range"])
    start = F.col("offset") + F.col("prefix")
    last = placed.filter((start < F.col("rest")) & (start + amount >= F.col("rest")))
    # equal rows at the cut share what is missing evenly
    last = last.select("sid", F.col("key").alias("cut_key"), F.col("doc_id").alias("cut_id"), F.col("size").alias("cut_size"), F.floor((F.col("rest") - start) / F.col("alike")).alias("cut_taken"))
    return _small(work.write(plan.drop("rest", "ranges").join(last, "sid", "left").drop("sid"), "cuts"), n_sources)


def _small(of: DataFrame, rows: int) -> DataFrame:
    """Broadcasts a table of sources while they are few; else Spark joins by shuffle and splits the rows of a large source."""
    return F.broadcast(of) if rows <= BROADCAST_SOURCES else of


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds a hash-random key of 60 bits."""
    text = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size"))
    return rows.withColumn("key", F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long"))


def apply_cuts(docs: DataFrame, cut: DataFrame) -> DataFrame:
    """Adds source_size, target and taken to ``docs``, which has doc_id, source and size; no document is shuffled
    while the sources are few enough for Spark to broadcast."""
    rows = _keyed(docs).join(cut, F.col("source").eqNullSafe(F.col("p_source")))
    # nulls come first in the windows of cuts(); so do they here
    place = lambda key, id_, size: F.struct(key.alias("k"), id_.isNotNull().alias("some"), id_.alias("id"), size.alias("s"))
    here, end = place(F.col("key"), F.col("doc_id"), F.col("size")), place(F.col("cut_key"), F.col("cut_id"), F.col("cut_size"))
    part = F.when(F.col("cut_key").isNull(), 0).when(here < end, F.col("size")).when(here.eqNullSafe(end), F.col("cut_taken")).otherwise(0)
    rows = rows.withColumn("taken", (F.col("epochs") * F.col("size") + part).cast("long"))
    return rows.drop("key", "p_source", "epochs", "cut_key", "cut_id", "cut_size", "cut_taken")


def mix(docs: DataFrame, size: Column | None = None, weights: tuple[float, ...] = WEIGHTS, most: float = MAX_EPOCHS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: how much of each document the mix takes, repeats counted.

    ``size`` counts a document's tokens (words by default); texts are read once."""
    size = n_words(F.col("text")) if size is None else size
    sizes = Workspace(docs.sparkSession, "mixing").write(docs.select("doc_id", "source", size.alias("size")), "sizes")
    return apply_cuts(sizes, cuts(sizes, weights, most)).select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MAX_EPOCHS) -> DataFrame:
    """The documents that the mix takes, with their columns, ``mix_size`` (words) and ``mix_taken`` (words taken, repeats counted)."""
    sizes = Workspace(docs.sparkSession, "mixing").write(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "source", n_words(F.col("text")).alias("size"))
    out = apply_cuts(whole, cuts(sizes, weights, most)).filter("taken > 0")
    return out.select("row.*", F.col("size").alias("mix_size"), F.col("taken").alias("mix_taken"))
