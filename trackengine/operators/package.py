"""Exports as packages: parts whose names hold their digests, and a manifest that is written last.

Parts are written by Spark tasks into a new folder, read back and digested there, moved to names that hold the digest, and
listed in a manifest with their sizes. Readers take what the last manifest lists, so a write that fails, or a task that runs
twice, changes nothing that they see."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackengine.sources import digests, scratch

#: Digits of the digest in a name. Fixed value.
DIGITS = 12
_MANIFEST = "name string, part string, sha256 string, n_lines long, raw_bytes long, packed_bytes long"


def write_package(lines: DataFrame, path: str, part: str, order: list[str], stem: str = "part") -> DataFrame:
    """Writes ``lines`` (part, order, value: one text without line ends a row) as one packed file a part, and returns the
    manifest. Runs jobs. A part is one file: choose parts as large as one task should write. Equal rows make equal digests."""
    spark, staged = lines.sparkSession, f"{path}/staged-{uuid.uuid4().hex}"
    try:
        placed = lines.withColumn("_part", F.col(part).cast("string")).repartition("_part").sortWithinPartitions("_part", *order)
        placed.select("_part", "value").write.partitionBy("_part").option("compression", "gzip").text(staged)
        found = digests.content_digests(spark, staged).withColumn("part", F.regexp_extract("file", "/_part=([^/]*)/", 1))
        name = F.concat_ws(".", F.lit(stem), F.url_decode("part"), F.left("sha256", F.lit(DIGITS)), F.lit("txt.gz"))
        manifest = found.select("file", name.alias("name"), F.url_decode("part").alias("part"), "sha256", "n_lines", F.col("n_bytes").alias("raw_bytes"), F.col("packed").alias("packed_bytes"))
        rows = manifest.filter("sha256 is not null").collect()  # a row a file
        there = set(scratch.names_in(spark, f"{path}/parts"))
        for r in rows:
            if r["name"] not in there:  # else the same content is there already
                scratch.rename_path(spark, r["file"], f"{path}/parts/{r['name']}")
        listed = spark.createDataFrame([tuple(r)[1:] for r in rows], _MANIFEST)
        listed.coalesce(1).write.json(f"{staged}/manifest")
        scratch.rename_path(spark, f"{staged}/manifest", f"{path}/manifests/{len(_generations(spark, path)):09d}")
    finally:
        scratch.delete_path(spark, staged)
    return read_manifest(spark, path)


def _generations(spark: SparkSession, path: str) -> list[str]:
    return scratch.names_in(spark, f"{path}/manifests")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """name, part, sha256, n_lines, raw_bytes and packed_bytes of the parts of the last finished write."""
    done = _generations(spark, path)
    if not done:
        raise ValueError(f"no package in {path}")
    return spark.read.schema(_MANIFEST).json(f"{path}/manifests/{done[-1]}")


def read_package(spark: SparkSession, path: str) -> DataFrame:
    """The lines of the listed parts, as ``value``; no others."""
    names = [r["name"] for r in read_manifest(spark, path).select("name").collect()]  # a row a file
    if not names:
        return spark.createDataFrame([], "value string")
    return spark.read.option("lineSep", "\n").text([f"{path}/parts/{n}" for n in names])


def verify_package(spark: SparkSession, path: str) -> DataFrame:
    """The manifest and ``passed``: whether the file is there, of the listed sizes and digest, and named by it."""
    listed = read_manifest(spark, path)
    found = digests.content_digests(spark, f"{path}/parts").select(F.url_decode(F.substring_index("file", "/", -1)).alias("name"), F.struct("sha256", "n_lines", "n_bytes", "packed").alias("found"))
    same = (F.col("found.sha256") == F.col("sha256")) & (F.col("found.n_lines") == F.col("n_lines")) & (F.col("found.n_bytes") == F.col("raw_bytes")) & (F.col("found.packed") == F.col("packed_bytes"))
    named = F.col("name").contains(F.concat(F.lit("."), F.left("sha256", F.lit(DIGITS)), F.lit(".")))
    return listed.join(found, "name", "left").withColumn("passed", F.coalesce(same & named, F.lit(False))).drop("found")


def prune_package(spark: SparkSession, path: str) -> None:
    """Deletes parts and manifests that only earlier writes list; not while someone still reads them."""
    kept = {r["name"] for r in read_manifest(spark, path).select("name").collect()}
    for name in set(scratch.names_in(spark, f"{path}/parts")) - kept:
        scratch.delete_path(spark, f"{path}/parts/{name}")
    for old in _generations(spark, path)[:-1]:
        scratch.delete_path(spark, f"{path}/manifests/{old}")
