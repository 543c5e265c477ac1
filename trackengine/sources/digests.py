"""SHA-256 digests of files, taken line by line as Spark reads them: no file is ever held as a whole.

A file's lines are brought together in order by its path and their blocks' offsets, so one task digests a file, since a
digest is a sequence, while any number of tasks read it. Memory holds a batch of lines, however long the file is."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: file names that Spark's text source decompresses, and the mark that it leaves out
PACKED = (".gz", ".bz2", ".deflate", ".lz4", ".snappy", ".zst")
BYTE_ORDER_MARK = b"\xef\xbb\xbf"
# ---


def _lines(spark: SparkSession, path: str, names: str | None = None, damaged: bool = False) -> DataFrame:
    """file, size, and each line's bytes, those of a file together and in order."""
    reader = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").option("ignoreCorruptFiles", str(damaged).lower())
    text = (reader.option("pathGlobFilter", names) if names else reader).text(path)
    rows = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("line"))
    return rows.repartition("file").sortWithinPartitions("file", "block", "at").select("file", "size", "line")


def _streamed(rows: DataFrame, packed: bool) -> DataFrame:
    """file, sha256, the number of lines and bytes. Of packed files the content is digested, every line with its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, size, plain, marked, n_bytes, n_lines = None, 0, None, None, 0, 0

        def done() -> pa.RecordBatch:
            digest, total = plain, n_bytes
            if packed:
                digest.update(b"\n")
                total += 1
            else:  # what the text source doesn't say: a mark at the beginning, an end after the last line
                rest = size - n_bytes
                if rest not in (0, 1, 3, 4):
                    raise ValueError(f"{now} has {size} bytes, but {n_bytes} were read")
                digest, total = marked if rest >= 3 else plain, size
                if rest in (1, 4):
                    digest.update(b"\n")
            return pa.RecordBatch.from_pydict({"file": [now], "sha256": [digest.hexdigest()], "n_lines": [n_lines], "n_bytes": [total]})

        for batch in batches:
            for file, whole, line in zip(*(batch.column(c).to_pylist() for c in ("file", "size", "line")), strict=True):
                if file != now:
                    if now is not None:
                        yield done()
                    now, size, plain, marked, n_bytes, n_lines = file, whole, hashlib.sha256(), hashlib.sha256(BYTE_ORDER_MARK), len(line), 1
                else:
                    line = b"\n" + line
                    n_bytes, n_lines = n_bytes + len(line), n_lines + 1
                plain.update(line)
                if not packed:
                    marked.update(line)
        if now is not None:
            yield done()

    return rows.mapInArrow(run, "file string, sha256 string, n_lines long, n_bytes long")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path and SHA-256 of the bytes of each file below a path, of any size; an empty file has no row, as Spark lists none.

    Files that Spark would decompress are read as one row each, which holds up to 2 GB."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("_metadata.file_path").alias("file"))  # names only
    is_packed = F.lit(False)
    for suffix in PACKED:
        is_packed |= F.col("path").endswith(suffix)
    plain = listed.filter(~is_packed).join(_streamed(_lines(spark, path).filter(~F.lower("file").rlike(f"({'|'.join(PACKED)})$".replace(".", r"\."))), False), "file", "left")
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(is_packed).select("path", F.sha2("content", 256).alias("sha256"))
    return plain.select("path", "sha256").unionByName(whole)


def content_digests(spark: SparkSession, path: str, names: str | None = None) -> DataFrame:
    """file, SHA-256 of the unpacked lines, their number and bytes, and ``packed``, the file's size. A damaged file gives the
    digest of what could be read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    listed = (listed.option("pathGlobFilter", names) if names else listed).load(path).select(F.col("_metadata.file_path").alias("file"), F.col("length").alias("packed"))
    return listed.join(_streamed(_lines(spark, path, names, True), True), "file", "left")
