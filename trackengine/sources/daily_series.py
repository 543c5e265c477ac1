"""Regional daily series packed as base64 of little-endian 16-bit integers, one string a region and year.

Two files hold them: JSON lines, one a region and year, which any number of tasks write and read; and the published payload,
one JSON text in a wrapper, which one task has to read as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values
MISSING = 65535
PREFIX, SUFFIX = r"^\s*window\.\w+\s*=\s*", r";\s*$"
# ---
_SHAPE = "regions struct<dailyLengths:map<string,int>,dailyMeanByYear:map<string,map<string,string>>>"


def read_payload(spark: SparkSession, path: str) -> DataFrame:
    """region, year, packed and declared length from a payload file: JSON after a fixed prefix and before a fixed suffix."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace(F.regexp_replace("value", PREFIX, ""), SUFFIX, "").alias("json"))
    parsed = text.select(F.from_json("json", _SHAPE).alias("p")).select("p.regions.*")
    per_region = parsed.select("dailyLengths", F.explode("dailyMeanByYear").alias("region", "years"))
    return per_region.select("region", F.explode("years").alias("year", "packed"), "dailyLengths").select("region", F.col("year").cast("int").alias("year"), "packed", F.try_element_at("dailyLengths", "year").alias("declared"))


def unpack(rows: DataFrame) -> DataFrame:
    """region, date and value, a row a day; 65535 is null. Each pair of bytes is read low byte first."""
    hexed = F.hex(F.unbase64("packed"))
    values = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(hexed) / 4 - 1).cast("int")),
        lambda k: F.conv(F.concat(F.substring(hexed, k * 4 + 3, F.lit(2)), F.substring(hexed, k * 4 + 1, F.lit(2))), 16, 10).cast("int"),
    )
    days = rows.select("region", "year", "declared", values.alias("v")).select("region", "year", "declared", F.posexplode("v").alias("k", "value"))
    return days.select("region", F.date_add(F.make_date("year", F.lit(1), F.lit(1)), F.col("k")).alias("date"), F.when(F.col("value") != MISSING, F.col("value")).alias("value"))


def bad_lengths(rows: DataFrame, days: dict[int, int]) -> DataFrame:
    """Region-years whose number of values isn't the declared one or isn't the year's number of days."""
    want = F.create_map(*(F.lit(x) for pair in days.items() for x in pair))[F.col("year")]
    return rows.filter(~(F.octet_length(F.unbase64("packed")) / 2).eqNullSafe(F.col("declared").cast("double")) | ~F.col("declared").eqNullSafe(want))


def missing_years(rows: DataFrame, low: int, high: int) -> DataFrame:
    """(region, year) without a series."""
    grid = rows.select("region").distinct().withColumn("year", F.explode(F.sequence(F.lit(low), F.lit(high))))
    return grid.join(rows.select("region", "year"), ["region", "year"], "left_anti")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same columns from JSON lines."""
    return spark.read.schema("region string, year int, packed string, declared int").json(path)


def checked(rows: DataFrame, days: dict[int, int]) -> DataFrame:
    """All values of read rows; fails if a length is wrong or a year is missing."""
    if not bad_lengths(rows, days).isEmpty():
        raise ValueError("a regional series has a wrong length")
    if not missing_years(rows, min(days), max(days)).isEmpty():
        raise ValueError("a regional series lacks a year")
    return unpack(rows)


def decode(spark: SparkSession, path: str, days: dict[int, int]) -> DataFrame:
    """All values of a payload file, checked."""
    return checked(read_payload(spark, path), days)


def pack(values: DataFrame, region: str, year: str, day: str, value: str, days: dict[int, int]) -> DataFrame:
    """region, year, packed and declared length from long rows: days of a year count from 1; a row a region and year."""
    n_days = F.create_map(*(F.lit(x) for pair in days.items() for x in pair))[F.col(year)]
    at = values.groupBy(F.col(region).cast("string").alias("region"), F.col(year).cast("int").alias("year")).agg(F.map_from_entries(F.collect_list(F.struct(day, value))).alias("m"), F.first(n_days).alias("declared"))
    byte = lambda v: F.concat(F.lpad(F.hex(v % 256), 2, "0"), F.lpad(F.hex(F.floor(v / 256)), 2, "0"))
    packed = F.base64(F.unhex(F.array_join(F.transform(F.sequence(F.lit(1), F.col("declared")), lambda k: byte(F.coalesce(F.try_element_at("m", k), F.lit(MISSING)))), "")))
    return at.select("region", "year", packed.alias("packed"), "declared")


def payload(rows: DataFrame) -> DataFrame:
    """Packed rows as the published payload's text, one row in all: for the few regions and years that a browser loads."""
    years = rows.groupBy("region").agg(F.map_from_entries(F.collect_list(F.struct(F.col("year").cast("string").alias("k"), "packed"))).alias("v"))
    lengths = rows.select(F.col("year").cast("string").alias("k"), "declared").distinct().agg(F.map_from_entries(F.collect_list(F.struct("k", "declared"))).alias("dailyLengths"))
    one = years.agg(F.map_from_entries(F.collect_list(F.struct("region", "v"))).alias("dailyMeanByYear")).crossJoin(lengths)  # one row each
    body = F.to_json(F.struct(F.struct("dailyLengths", "dailyMeanByYear").alias("regions")))
    return one.select(F.concat(F.lit("window.RAIN = "), body, F.lit(";")).alias("value"))
