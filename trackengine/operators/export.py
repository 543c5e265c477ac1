"""Exports: path strings, tables, GeoJSON, query recipes and nested documents, all as Spark jobs."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# --- fixed values: path precision, and what stands before the version in a catalogue's file name
PRECISION = 10_000
NAME_PREFIX = "lps_"
# ---


def _chunks(value: Column) -> Column:
    """A signed integer as text: zig-zag, then five bits a character, lowest first, 63 added, 32 more while bits follow."""
    zigzag = F.when(value < 0, -2 * value - 1).otherwise(2 * value)
    n = F.greatest(F.lit(1), F.ceil(F.length(F.bin(zigzag)) / 5).cast("int"))
    part = lambda k: F.call_function("shiftright", zigzag, k * 5).bitwiseAND(31)
    return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.chr(part(k) + 63 + F.when(k < n - 1, 32).otherwise(0))), "")


def encode_paths(points: DataFrame, key: str = "track_id", order: str = "time", precision: int = PRECISION) -> DataFrame:
    """One path string a track: latitude then longitude differences of consecutive points."""
    w = Window.partitionBy(key).orderBy(order)
    fixed = points.select(key, order, *(F.rint(F.col(c) * precision).cast("long").alias(c) for c in ("lat", "lon")))
    step = [(F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0))).alias(f"d_{c}") for c in ("lat", "lon")]
    text = fixed.select(key, order, *step).select(key, order, F.concat(_chunks(F.col("d_lat")), _chunks(F.col("d_lon"))).alias("s"))
    return text.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "s"))), lambda x: x["s"]), "").alias("path"))


def decode_paths(paths: DataFrame, key: str = "track_id", precision: int = PRECISION) -> DataFrame:
    """(key, idx, lat, lon): the inverse of ``encode_paths``."""
    codes = F.transform(F.filter(F.split("path", ""), lambda c: c != ""), lambda c: F.ascii(c) - 63)
    start = F.struct(F.lit(0).cast("long").alias("v"), F.lit(0).alias("shift"), F.expr("cast(array() as array<bigint>)").alias("out"))

    def take(s: Column, c: Column) -> Column:
        v = s["v"] + F.call_function("shiftleft", c.bitwiseAND(31).cast("long"), s["shift"])
        signed = F.when(v % 2 == 1, -(v + 1) / 2).otherwise(v / 2).cast("long")
        more = c >= 32
        return F.struct(
            F.when(more, v).otherwise(0).cast("long").alias("v"), F.when(more, s["shift"] + 5).otherwise(0).alias("shift"), F.when(more, s["out"]).otherwise(F.concat(s["out"], F.array(signed))).alias("out")
        )

    deltas = F.aggregate(codes, start, take, lambda s: s["out"])
    flat = paths.select(key, F.posexplode(deltas).alias("k", "d")).select(key, F.floor(F.col("k") / 2).cast("int").alias("idx"), (F.col("k") % 2).alias("axis"), "d")
    pairs = flat.groupBy(key, "idx").agg(F.sum(F.when(F.col("axis") == 0, F.col("d"))).alias("d_lat"), F.sum(F.when(F.col("axis") == 1, F.col("d"))).alias("d_lon"))
    w = Window.partitionBy(key).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return pairs.select(key, "idx", (F.sum("d_lat").over(w) / precision).alias("lat"), (F.sum("d_lon").over(w) / precision).alias("lon"))


def write_table(rows: DataFrame, columns: list[str], path: str) -> None:
    """CSV with a header and every value quoted."""
    rows.select(*columns).write.csv(path, header=True, quoteAll=True)


def fixes_table(points: DataFrame, cohort: DataFrame, columns: list[str], key: str = "track_id") -> DataFrame:
    """A row an hour of the chosen tracks, with its support as text."""
    # a task's tracks are hashed, the hours, which are many more, are not sorted
    chosen = points.join(cohort.select(key).hint("shuffle_hash"), key, "left_semi")
    return chosen.select(key, *columns, F.when(F.col("observed"), "observed_support").otherwise("interpolated").alias("support"))


def geojson(pieces: DataFrame, properties: DataFrame, key: str = "track_id") -> DataFrame:
    """One Feature a track as a line of JSON: a MultiLineString of its pieces, and its properties."""
    lines = pieces.groupBy(key, "piece").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "lon", "lat"))), lambda p: F.array(F.bround(p["lon"], 4), F.bround(p["lat"], 4))).alias("line"))
    multi = lines.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("piece", "line"))), lambda x: x["line"]).alias("coordinates"))
    named = properties.select(key, F.struct(*properties.columns).alias("properties"))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("MultiLineString").alias("type"), "coordinates").alias("geometry"), "properties"))
    return multi.join(named, key).select(key, feature.alias("value"))


def query_recipe(cohort: DataFrame, filters: dict, source_hash: str, key: str = "track_id") -> DataFrame:
    """The filters, the source's hash, and the ids as rows of JSON lines: a head line, then one line an id, so that a cohort
    of any size is written in parallel."""
    spark = cohort.sparkSession
    head = spark.createDataFrame([(json.dumps({"filters": filters, "source_sha256": source_hash}, sort_keys=True),)], "value string")
    return head.unionByName(cohort.select(F.to_json(F.struct(F.col(key).alias("id"))).alias("value")))


def catalogue_version(name: Column, explicit: str | None = None) -> Column:
    """The first version, such as ``v1.2.3``, that directly follows ``NAME_PREFIX`` in the file name of a path, or the explicit
    one, its ``v`` added if it lacks. A name without a version fails the query."""
    if explicit:
        return F.lit("v" + explicit.removeprefix("v"))
    after = F.slice(F.split(F.substring_index(name, "/", -1), NAME_PREFIX), 2, 1_000)
    found = F.filter(F.transform(after, lambda part: F.regexp_extract(part, "^v[0-9]+([.][0-9]+)+", 0)), lambda v: v != "")
    return F.when(F.size(found) > 0, F.get(found, F.lit(0))).otherwise(F.raise_error(F.concat(F.lit("no catalogue version in the name "), name)).cast("string"))


def write_documents(nested: DataFrame, path: str, partition: str | None = None) -> None:
    """Compressed JSON lines, one nested document a track."""
    writer = nested.write.option("compression", "gzip")
    (writer.partitionBy(partition) if partition else writer).json(path)


def read_documents(spark: SparkSession, paths: list[str], schema: str | None = None, lines: bool = False) -> DataFrame:
    """Nested JSON documents: a document a file, of any number of lines, or a document a line."""
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema else reader).json(paths)
