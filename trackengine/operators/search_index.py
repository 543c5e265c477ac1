"""Substring search over many texts: an index of trigrams.

Texts are dealt into blocks of rows that follow one another. A trigram's posting is one row for a block: the places in it, as
two bytes each, of the texts that have the trigram. Postings are written in folders by a hash of the trigram and sorted by it,
so that a search reads the postings of a few trigrams. It takes the rarest trigrams of what is sought, intersects their places
block by block inside tasks, so that places become rows only where all of them meet, and looks into these texts alone. What is
shorter than a trigram is looked for in all texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of postings, and how many trigrams of a search are used at most.
FOLDERS, RAREST = 16, 3
#: Texts of a block are 2 to this power: 16 at most, as places have two bytes.
BLOCK_BITS = 16
#: Bytes of texts whose trigrams a task holds at once, and how many trigrams are asked for by name; more are joined.
BYTES, FEW = 8_000_000, 200
#: Highest number of a trigram and text.
MOST = 2**63 - 1


def _folder(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(FOLDERS)).cast("int")


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters."""
    at = F.when(F.length(text) >= 3, F.sequence(F.lit(1), F.length(text) - 2)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda k: F.substring(text, k, F.lit(3))))


def _trigram_places(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray] | None:
    """The trigrams of some texts, where the texts of each begin and the last ones end, and the texts' numbers, those of a
    trigram in order. None where the texts have too many different characters for one number a trigram and text, which one text
    alone never has."""
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), "<u4")
    # characters by their numbers among those that occur, so that a trigram and a text are one small number, which is sorted once
    letters = np.flatnonzero(np.bincount(codes, minlength=1)) if len(codes) else np.zeros(0, np.int64)
    number = np.zeros(int(letters[-1]) + 1 if len(letters) else 1, np.int64)
    number[letters] = np.arange(len(letters))
    codes, n, many = number[codes], max(len(sizes), 1), len(letters)
    if many**3 * n > MOST:
        return None
    first = np.ones(len(codes), bool)
    stop = np.cumsum(sizes)
    for back in (1, 2):  # the last two characters of a text begin none
        first[stop[sizes >= back] - back] = False
    owner = np.repeat(np.arange(len(sizes)), sizes)[first]
    begins = np.flatnonzero(first)
    pairs = np.sort(((codes[begins] * many + codes[begins + 1]) * many + codes[begins + 2]) * n + owner)
    fresh = np.ones(len(pairs), bool)
    fresh[1:] = pairs[1:] != pairs[:-1]
    gram, text = np.divmod(pairs[fresh], n)
    edges = np.flatnonzero(np.diff(gram, prepend=-1))
    names = ["".join(chr(letters[g // many**e % many]) for e in (2, 1, 0)) for g in gram[edges].tolist()]
    return names, np.append(edges, len(gram)), text


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, block, places) of batches of (row, text); a gram may have several rows of a block, in any order of places."""

    def of_block(block: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        found = _trigram_places(rows["text"].combine_chunks())
        if found is None:
            half = rows.num_rows // 2
            yield from of_block(block, rows.slice(0, half))
            yield from of_block(block, rows.slice(half))
            return
        names, edges, text = found
        if names:
            places = (rows["row"].to_numpy() & ((1 << BLOCK_BITS) - 1)).astype("<u2")[text].tobytes()
            offsets = pa.py_buffer((2 * edges).astype("<i4").tobytes())
            packed = pa.Array.from_buffers(pa.binary(), len(names), [None, offsets, pa.py_buffer(places)])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.full(len(names), block)), packed], ["gram", "block", "places"])

    def out(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        of = rows["row"].to_numpy() >> BLOCK_BITS
        for block in np.unique(of).tolist():
            yield from of_block(block, rows.filter(pa.array(of == block)))

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        step = max(1, BYTES * batch.num_rows // max(batch.nbytes, 1))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            held.append(part)
            size += part.nbytes
            if size >= BYTES:
                yield from out(held)
                held, size = [], 0
    if held:
        yield from out(held)


def _meet(postings: pa.Table, sought: pa.Table) -> pa.Table:
    """(sought, row) of one block: the rows that all trigrams of a sought text have in common."""
    found: dict[str, list[np.ndarray]] = {}
    for gram, places in zip(postings["gram"].to_pylist(), postings["places"].to_pylist()):
        found.setdefault(gram, []).append(np.frombuffer(places, "<u2"))
    at = {gram: parts[0] if len(parts) == 1 else np.concatenate(parts) for gram, parts in found.items()}
    marks: dict[str, np.ndarray] = {}
    numbers, rows = [], []
    asked = sought["grams"].to_pylist()
    if not at:
        asked = []
    for k, grams in enumerate(asked):
        if any(g not in at for g in grams):
            continue
        rare, *others = sorted(grams, key=lambda g: len(at[g]))
        both = at[rare]
        for g in others:
            if g not in marks:
                if len(marks) >= 2_000:
                    marks.clear()
                marks[g] = np.zeros(1 << BLOCK_BITS, bool)
                marks[g][at[g]] = True
            both = both[marks[g][both]]
        if len(both):
            numbers.append(np.full(len(both), k))
            rows.append(both)
    if not rows:
        return pa.table({"sought": pa.array([], pa.string()), "row": pa.array([], pa.int64())})
    block = sought["block"][0].as_py()
    return pa.table({"sought": sought["sought"].take(pa.array(np.concatenate(numbers))), "row": pa.array((block << BLOCK_BITS) + np.concatenate(rows).astype(np.int64))})


@dataclass(frozen=True)
class TrigramIndex:
    spark: SparkSession
    path: str

    @classmethod
    def build(cls, rows: DataFrame, path: str, key: str, text: str) -> TrigramIndex:
        """Writes the index of ``rows`` (a key and a text each) below ``path``. Rows without a key or text can't be found."""
        spark = rows.sparkSession
        kept = rows.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
        kept.withColumn("row", F.monotonically_increasing_id()).write.parquet(f"{path}/texts")
        grams = spark.read.parquet(f"{path}/texts").select("row", "text").mapInArrow(_postings, "gram string, block long, places binary").withColumn("folder", _folder(F.col("gram")))
        # a frequent trigram's postings are split by the block's hash; its parts are small files of one folder
        placed = grams.repartition("folder", F.pmod(F.xxhash64("block"), F.lit(4))).sortWithinPartitions("folder", "gram")
        placed.write.partitionBy("folder").parquet(f"{path}/postings")
        counts = spark.read.parquet(f"{path}/postings").groupBy("folder", "gram").agg((F.sum(F.octet_length("places")) / 2).cast("long").alias("n"))
        counts.repartition("folder").sortWithinPartitions("folder", "gram").write.partitionBy("folder").parquet(f"{path}/counts")
        return cls(spark, path)

    def _read(self, name: str, grams: list[str]) -> DataFrame:
        """The rows of some trigrams; other folders are not read."""
        rows = self.spark.read.parquet(f"{self.path}/{name}")
        asked = self.spark.createDataFrame([(g,) for g in grams], "gram string").select(_folder(F.col("gram")).alias("f")).distinct()
        folders = [r["f"] for r in asked.collect()]  # at most FOLDERS
        return rows.filter(F.col("folder").isin(folders) & F.col("gram").isin(grams))

    def _rows_of(self, name: str, grams: DataFrame) -> DataFrame:
        """``_read`` of a few trigrams; of many, a join."""
        grams = grams.select("gram").distinct()
        few = [r["gram"] for r in grams.limit(FEW + 1).collect()]  # at most FEW + 1
        if len(few) <= FEW:
            return self._read(name, few)
        return self.spark.read.parquet(f"{self.path}/{name}").join(grams.withColumn("folder", _folder(F.col("gram"))), ["folder", "gram"], "left_semi")

    def _sought(self, sought: list[str] | DataFrame) -> DataFrame:
        """Distinct texts to look for. A DataFrame's first column has them."""
        frame = self.spark.createDataFrame([(s,) for s in sought], "sought string") if isinstance(sought, list) else sought.select(sought[sought.columns[0]].alias("sought"))
        return frame.filter("sought is not null").distinct()

    def _met(self, sought: DataFrame) -> DataFrame:
        """(sought, row) of the texts that have the rarest trigrams of each sought text of three characters or more."""
        own = sought.filter(F.length("sought") >= 3).select("sought", F.explode(trigrams(F.col("sought"))).alias("gram"))
        counted = own.join(self._rows_of("counts", own).select("gram", "n"), "gram", "left")
        rarest = counted.groupBy("sought").agg(F.every(F.col("n").isNotNull()).alias("all"), F.sort_array(F.collect_list(F.struct("n", "gram"))).alias("by"))
        rarest = rarest.filter("all").select("sought", F.slice("by", 1, RAREST)["gram"].alias("grams"))
        places = self._rows_of("postings", rarest.select(F.explode("grams").alias("gram"))).select("block", "gram", "places")
        blocks = self.spark.read.parquet(f"{self.path}/texts").select(F.shiftright("row", BLOCK_BITS).alias("block")).distinct()
        # what is sought goes to each block, as whole strings: a row a block and sought text
        each = rarest.crossJoin(blocks).select("block", "sought", "grams")
        return places.groupBy("block").cogroup(each.groupBy("block")).applyInArrow(_meet, "sought string, row long")

    def candidates(self, sought: list[str] | DataFrame) -> DataFrame:
        """(sought, key) of the texts that have the rarest trigrams of each sought text of three characters or more."""
        return self._met(self._sought(sought)).join(self.spark.read.parquet(f"{self.path}/texts").select("row", "key"), "row").select("sought", "key")

    def find(self, sought: list[str] | DataFrame) -> DataFrame:
        """(sought, key): the texts that contain a sought text. An empty one is in every text."""
        texts = self.spark.read.parquet(f"{self.path}/texts")
        asked = self._sought(sought)
        found = self._met(asked).join(texts, "row").filter(F.contains("text", "sought")).select("sought", "key")
        short = texts.join(F.broadcast(asked.filter(F.length("sought") < 3)), F.contains("text", "sought"))  # of one or two characters
        return found.unionByName(short.select("sought", "key"))
