"""Substring dedup with a log-structured fingerprint index.

Fingerprints are hashes of ``SEED``-word windows, winnowed: of the seeds inside every ``window`` consecutive words the
one with the least hash is taken, so two equal windows always hold an equal fingerprint at the same place, and about
2 in 25 positions are stored (Schleimer et al., 2003).

``FingerprintIndex`` is a folder that can be opened again. It keeps three sets of sorted immutable runs
(``sorted_runs``): of documents' digests, of fingerprints, and of the hashes of opened windows, beside the delivered
documents, bucketed by row. ``deliver`` takes a batch:

1. The batch's fingerprints become a run, which is merge-joined with the earlier runs. A fingerprint that occurs twice in
   the batch or once before is repeated. Where history holds it once, the run names that one document, which is opened
   too; where history holds it more often, its documents were opened before.
2. Verification: each window whose own fingerprint, its least seed, is repeated is hashed as a whole with 128 bits (two
   independent hashes of its words' bytes) and goes into the runs of windows. A window is formed once, in the delivery
   that repeats its fingerprint. Windows whose own fingerprint occurs once can't repeat and are never formed.
3. Runs of similar size are merged, and documents, ``FAN`` tables at a time; the new state is written last, and a delivery
   that fails takes back what it wrote, so it leaves the index as it was.

No delivery reads historical texts but those of the documents that it opens, and no historical run is shuffled.
``result`` removes the words that repeated windows cover, for all that was delivered.

Edge cases: null, empty and wordless texts, and texts of fewer words than a window, keep all they have. Repeated rows
repeat each other. Windows never reach across documents. A null doc_id is an id like any other: rows are told apart by a
number made when they are written down. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import copy
import hashlib
import json
import uuid
from collections.abc import Iterable
from functools import reduce
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackengine.llm.common import HASHES, SECOND_HASHES, Workspace, create_file, delete_path, map_batches, names_in, ngrams, slices, space_words, texts
from trackengine.llm.sorted_runs import SortedRuns, read_bucketed, sorted_scans, write_bucketed

WINDOW, SEED = 35, 12
#: Tables of documents that are written as one.
FAN = 8
_SECOND = 0xC2B2AE3D27D4EB4F


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each ``width`` consecutive values, by doubling."""
    block, reach = values, 1
    while reach * 2 <= width:
        block, reach = pick(block[:-reach], block[reach:]), reach * 2
    rest = width - reach
    return pick(block[: len(block) - rest], block[rest:]) if rest else block


def _inside(sizes: np.ndarray, width: int) -> np.ndarray:
    """For texts of so many words one after the other: whether the ``width`` words from a place on are of one text."""
    total = int(sizes.sum())
    ends = np.repeat(np.cumsum(sizes), sizes)
    return (np.arange(total) + width <= ends)[: max(0, total - width + 1)]


def _least_seeds(hashes: np.ndarray, sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The seeds at each word of texts one after the other, each window's own fingerprint, which is the least of its seeds,
    and which windows are of one text."""
    size = min(SEED, window)
    seeds = ngrams(hashes, size)
    inside = _inside(sizes, window)
    return seeds, _slide(seeds, window - size + 1, np.minimum) if len(inside) else np.empty(0, np.uint64), inside


def fingerprints(hashes: np.ndarray, sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the fingerprints of texts one after the other: the seeds that are the least of some window."""
    seeds, least, inside = _least_seeds(hashes, sizes, window)
    if not inside.any():
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    span = window - min(SEED, window) + 1
    none = np.zeros(span - 1, np.uint64)
    at = np.flatnonzero(_slide(np.concatenate([none, np.where(inside, least, np.uint64(0)), none]), span, np.maximum) == seeds)
    return at, seeds[at]


def candidate_windows(hashes: np.ndarray, sizes: np.ndarray, window: int, repeated: np.ndarray) -> np.ndarray:
    """Starts of the windows of texts one after the other whose own fingerprint is among ``repeated``."""
    _, least, inside = _least_seeds(hashes, sizes, window)
    return np.flatnonzero(np.isin(least, repeated) & inside)


def _words(batch: pa.RecordBatch) -> tuple[list[list[bytes]], list[bytes], np.ndarray, np.ndarray]:
    """Words of each text, of all texts one after the other, how many each has, and where each begins."""
    each = [space_words(t) for t in texts(batch)]
    sizes = np.fromiter(map(len, each), np.int64, len(each))
    return each, [w for words in each for w in words], sizes, np.cumsum(sizes) - sizes


def _marks(batch: pa.RecordBatch) -> np.ndarray:
    """Repeated fingerprints of the texts of a batch. One that a text has is a mark of that text too, or else new for one text alone."""
    return batch.column("marks").flatten().to_numpy(zero_copy_only=False).view(np.uint64)


def find_fingerprints(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, text, n_words, a digest of the words, and the fingerprints' hashes, one row a document."""

    def make():
        def each(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
            return map(prints_of, slices(batch))

        def prints_of(batch: pa.RecordBatch) -> pa.RecordBatch:
            words, together, sizes, starts = _words(batch)
            at, found = fingerprints(HASHES.of(together), sizes, window)
            cuts = np.append(np.searchsorted(at, starts), len(at)).astype(np.int32)
            digests = [hashlib.sha256(b" ".join(w)).hexdigest() for w in words]
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text"), pa.array(sizes), pa.array(digests, pa.string()), pa.ListArray.from_arrays(pa.array(cuts), pa.array(found.view(np.int64)))],
                ["doc_id", "text", "n_words", "words_sha256", "hashes"],
            )

        return each

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), make, f"doc_id {kind}, text string, n_words long, words_sha256 string, hashes array<long>")


def find_windows(opened: DataFrame, window: int) -> DataFrame:
    """w1, w2 (a 128-bit hash), delivery, row and start of each candidate window; ``marks`` are a text's repeated fingerprints."""

    def make():
        def each(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
            return map(windows_of, slices(batch))

        def windows_of(batch: pa.RecordBatch) -> pa.RecordBatch:
            _, together, sizes, begin = _words(batch)
            hashes = HASHES.of(together)
            at = candidate_windows(hashes, sizes, window, _marks(batch))
            text = np.searchsorted(begin, at, "right") - 1
            w1, w2 = ngrams(hashes, window), ngrams(SECOND_HASHES.of(together), window, _SECOND)
            delivery, rows = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("delivery", "row"))
            columns = w1[at].view(np.int64), w2[at].view(np.int64), delivery[text], rows[text], (at - begin[text]).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["w1", "w2", "delivery", "row", "start"])

        return each

    return map_batches(opened.select("delivery", "row", "text", "marks"), make, "w1 long, w2 long, delivery int, row long, start int")


def _remove(marked: DataFrame, window: int) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by one space; ``single`` are the candidates that don't repeat, or null."""

    def make():
        def each(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
            return map(removed_of, slices(batch))

        def removed_of(batch: pa.RecordBatch) -> pa.RecordBatch:
            words, together, sizes, begin = _words(batch)
            at = candidate_windows(HASHES.of(together), sizes, window, _marks(batch))
            single = batch.column("single")
            of = np.repeat(begin, pc.fill_null(pc.list_value_length(single), 0).to_numpy(zero_copy_only=False))
            at = at[~np.isin(at, of + single.flatten().to_numpy(zero_copy_only=False))]
            edge = np.zeros(len(together) + 1, np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + window, -1)
            stays = np.cumsum(edge[:-1]) == 0
            kept = [b" ".join(compress(w, stays[b : b + len(w)].tolist())) for w, b in zip(words, begin, strict=True)]
            gone = sizes - np.diff(np.append(0, np.cumsum(stays))[np.append(begin, len(together))])
            digests = [hashlib.sha256(t).hexdigest() for t in kept]
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"), pa.array(gone), pa.array(digests, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

        return each

    kind = marked.schema["doc_id"].dataType.simpleString()
    return map_batches(marked.select("doc_id", "n_words", "text", "marks", "single"), make, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept_text string")


class FingerprintIndex:
    """Historical fingerprints, windows and documents in a folder of the shared file system.

    One delivery works on an index at a time: it claims its number by a file that only one can create. What it writes
    counts once its state is stored, as the last step. A delivery that fails takes back all that it wrote and its claim, so
    it can be made again on the same object or a reopened one; after a driver that was lost, ``recover`` does the same."""

    def __init__(self, spark: SparkSession, path: str, state: dict):
        self.spark, self.path = spark, path
        self._load(state)

    def _load(self, state: dict) -> None:
        self.state, self.window, self.buckets = state, state["window"], state["buckets"]
        place = {"delivery": "int", "row": "long"}
        runs = lambda name, keys, places: SortedRuns(self.spark, f"{self.path}/{name}", keys, places, self.buckets, [tuple(r) for r in state["runs"].get(name, [])])
        self.copies = runs("copies", {"words_sha256": "string"}, place)
        self.prints = runs("prints", {"hash": "long"}, place)
        self.windows = runs("windows", {"w1": "long", "w2": "long"}, place | {"start": "int"})
        self.marks = runs("marks", place | {"hash": "long"}, {})
        self.tables: list[tuple[str, int, int]] = [tuple(t) for t in state["documents"]]  # name, first and last delivery

    @classmethod
    def create(cls, spark: SparkSession, path: str, id_kind: str, window: int = WINDOW, buckets: int | None = None) -> FingerprintIndex:
        """A new index. Buckets, the session's shuffle partitions unless given, should fit the history to come: they can't be changed."""
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        index = cls(spark, path, {"window": window, "buckets": buckets, "id_kind": id_kind, "deliveries": 0, "runs": {}, "documents": []})
        index._store()
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FingerprintIndex:
        """The index as its last finished delivery left it."""
        return cls(spark, path, cls._last_state(spark, path))

    @staticmethod
    def _last_state(spark: SparkSession, path: str) -> dict:
        done = [s for s in names_in(spark, path) if s.startswith("state-") and "_SUCCESS" in names_in(spark, f"{path}/{s}")]
        if not done:
            raise ValueError(f"no index in {path}")
        return json.loads(spark.read.text(f"{path}/{max(done)}").first()[0])

    def _runs(self) -> dict[str, SortedRuns]:
        return {name: getattr(self, name) for name in ("copies", "prints", "windows", "marks")}

    def _store(self) -> None:
        self.state["runs"] = {name: runs.runs for name, runs in self._runs().items()}
        self.state["documents"] = self.tables
        text = self.spark.createDataFrame([(json.dumps(self.state),)], "value string")
        text.coalesce(1).write.mode("overwrite").text(f"{self.path}/state-{self.state['deliveries']:09d}")

    def _sweep(self) -> None:
        """Deletes what the state doesn't name: merged and abandoned tables, and all states but the last two."""
        for runs in self._runs().values():
            runs.clean()
        known = {t for t, _, _ in self.tables}
        for other in set(names_in(self.spark, f"{self.path}/documents")) - known:
            delete_path(self.spark, f"{self.path}/documents/{other}")
        for state in [s for s in names_in(self.spark, self.path) if s.startswith("state-") and s <= f"state-{self.state['deliveries']:09d}"][:-2]:
            delete_path(self.spark, f"{self.path}/{state}")

    def _claim(self) -> str:
        return f"{self.path}/claim-{self.state['deliveries']:09d}"

    def recover(self) -> None:
        """Takes back a delivery whose driver was lost. Not while another one may still be running."""
        self._load(self._last_state(self.spark, self.path))
        self._sweep()
        delete_path(self.spark, self._claim())

    def _table(self, name: str) -> DataFrame:
        schema = f"delivery int, `row` long, doc_id {self.state['id_kind']}, text string, n_words long, words_sha256 string, hashes array<long>"
        return read_bucketed(self.spark, f"{self.path}/documents/{name}", schema, ["delivery", "row"], self.buckets)

    def _write_table(self, rows: DataFrame) -> str:
        name = f"documents-{uuid.uuid4().hex}"
        write_bucketed(rows.repartition(self.buckets, "delivery", "row"), f"{self.path}/documents/{name}", ["delivery", "row"], self.buckets)
        return name

    def documents(self, deliveries: list[int] | None = None) -> list[DataFrame]:
        """delivery, row, doc_id, text, n_words, words_sha256 and hashes, bucketed and sorted by delivery and row; a few tables,
        since ``FAN`` of them that follow each other are written as one."""
        if deliveries is None:
            return [self._table(name) for name, _, _ in self.tables]
        wanted = [(name, [d for d in deliveries if first <= d <= last]) for name, first, last in self.tables]
        return [self._table(name).filter(F.col("delivery").isin(some)) for name, some in wanted if some]

    def _compact_documents(self) -> None:
        """A document is rewritten as often as the logarithm of the deliveries to the base ``FAN``."""
        spans = lambda t: t[2] - t[1] + 1
        while len(self.tables) >= FAN and spans(self.tables[-FAN]) <= FAN * spans(self.tables[-1]):
            merged = self.tables[-FAN:]
            name = self._write_table(reduce(DataFrame.unionByName, [self._table(t) for t, _, _ in merged]))
            self.tables[-FAN:] = [(name, merged[0][1], merged[-1][2])]

    def deliver(self, docs: DataFrame) -> int:
        """Adds a batch (doc_id, text) and returns its number. Raises RuntimeError while another delivery works on the index."""
        self._load(self._last_state(self.spark, self.path))
        before, claim = copy.deepcopy(self.state), self._claim()
        if not create_file(self.spark, claim):
            raise RuntimeError(f"{claim} exists: another delivery works on the index, or was lost (see recover)")
        work = Workspace(self.spark, "substring-dedup")
        try:
            if self._last_state(self.spark, self.path)["deliveries"] != before["deliveries"]:
                raise RuntimeError("another delivery was finished meanwhile")
            k = self._deliver(docs, work)
            self.state["deliveries"] = k + 1
            self._store()
        except BaseException:
            delete_path(self.spark, f"{self.path}/state-{before['deliveries'] + 1:09d}")
            self._load(before)
            self._sweep()
            raise
        finally:
            delete_path(self.spark, claim)
            delete_path(self.spark, work.path)
        self._sweep()
        return k

    def _deliver(self, docs: DataFrame, work: Workspace) -> int:
        k = self.state["deliveries"]
        with sorted_scans(self.spark):
            rows = find_fingerprints(docs, self.window).withColumn("row", F.monotonically_increasing_id()).withColumn("delivery", F.lit(k))
            name = self._write_table(rows.select("delivery", "row", "doc_id", "text", "n_words", "words_sha256", "hashes"))
            self.tables.append((name, k, k))
            own, here = self._table(name), F.lit(k).alias("delivery")

            # Documents of the same words repeat as a whole; the first one stands for all from here on.
            long = own.filter(F.col("n_words") >= self.window).select("words_sha256", here, "row")
            met = self.copies.met(self.copies.add(long)).filter("n > 1 or seen > 0")
            again = work.write(met.select("words_sha256", F.when(F.col("seen") == 0, F.col("row")).alias("rep")), "copies")
            others = own.select("row", "words_sha256").join(again, "words_sha256").filter("rep is null or rep <> row").select("row")

            spots = own.select(F.explode("hashes").alias("hash"), here, "row")
            met = self.prints.met(self.prints.add(spots)).filter("n > 1 or seen > 0")
            met = work.write(met.select("hash", "seen", "old_delivery", "old_row"), "repeated")
            marks = spots.join(met.select("hash"), "hash").select(here, "row", "hash").join(others, "row", "left_anti")
            woken = met.filter("seen = 1").select(F.col("old_delivery").alias("delivery"), F.col("old_row").alias("row"), "hash")
            marks = work.write(marks.select("delivery", "row", "hash").unionByName(woken).distinct(), "marks")
            self.marks.add(marks)

            marks = marks.groupBy("delivery", "row").agg(F.collect_list("hash").alias("marks"))
            met_in = [r[0] for r in marks.select("delivery").distinct().collect()]  # one number a delivery
            formed = [find_windows(own.limit(0).withColumn("marks", F.lit(None).cast("array<long>")), self.window)]
            formed += [find_windows(d.select("delivery", "row", "text").join(marks, ["delivery", "row"]), self.window) for d in self.documents(met_in)]
            self.windows.add(reduce(DataFrame.unionByName, formed))
            for runs in self._runs().values():
                runs.compact()
            self._compact_documents()
        return k

    def result(self, deliveries: list[int] | None = None) -> DataFrame:
        """doc_id, n_words, n_removed, kept_sha256 and kept_text (null where nothing is removed) of all or some deliveries,
        judged by all that was delivered. What it reads is not deleted before the next delivery."""
        work, out = Workspace(self.spark, "substring-dedup"), None
        if not self.state["deliveries"]:
            return self.spark.createDataFrame([], f"doc_id {self.state['id_kind']}, n_words long, n_removed long, kept_sha256 string, kept_text string")
        empty, place = F.sha2(F.lit("").cast("binary"), 256), ["delivery", "row"]
        with sorted_scans(self.spark):
            single = work.write(self.windows.totals().filter("n = 1").groupBy(*place).agg(F.collect_list("start").alias("single")), "single")
            copied = work.write(self.copies.totals().filter("n > 1").select("words_sha256"), "copied")
            marks = work.write(self.marks.totals().groupBy(*place).agg(F.collect_list("hash").alias("marks")), "marks")
            for t, rows in enumerate(self.documents(deliveries)):
                whole = work.write(rows.select(*place, "words_sha256").join(copied, "words_sha256").select(*place), f"whole-{t}")
                marked = rows.select(*place, "doc_id", "n_words", "text").join(marks, place).join(whole, place, "left_anti").join(single, place, "left")
                rest = rows.select(*place, "doc_id", "n_words", "words_sha256").join(whole.withColumn("whole", F.lit(True)), place, "left")
                rest = rest.join(marks.select(*place, F.lit(True).alias("marked")), place, "left").filter("whole or marked is null")
                rest = rest.select(
                    "doc_id",
                    "n_words",
                    F.when(F.col("whole"), F.col("n_words")).otherwise(0).alias("n_removed"),
                    F.when(F.col("whole"), empty).otherwise(F.col("words_sha256")).alias("kept_sha256"),
                    F.when(F.col("whole"), "").alias("kept_text"),
                )
                found = _remove(marked, self.window).withColumn("kept_text", F.when(F.col("n_removed") > 0, F.col("kept_text"))).unionByName(rest)
                out = found if out is None else out.unionByName(found)
        return out


def dedup_substrings(docs: DataFrame, window: int = WINDOW, batches: int = 2) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text (the kept words, joined by one space; null where nothing was removed).

    The input is delivered to a new index in ``batches`` parts, as over time; the result doesn't depend on them."""
    spark = docs.sparkSession
    index = FingerprintIndex.create(spark, Workspace(spark, "fingerprint-index").path, docs.schema["doc_id"].dataType.simpleString(), window)
    docs = docs.select("doc_id", "text")
    for k in range(batches):
        index.deliver(docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)) == k))
    return index.result()
