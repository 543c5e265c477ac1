"""Helpers shared by the training-data operators: tables, shared scratch space, words and n-gram hashes.

Words come in two kinds. ``space_words`` splits on ASCII white space only (0x20, 0x09-0x0D); ``alnum_words`` keeps
ASCII letters and digits and every non-ASCII character. Both work on UTF-8 bytes: no byte of a multi-byte character is
a separator, so splitting bytes equals splitting code points, and ``bytes.lower`` changes A-Z alone.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Java and RE2 form of a word between ASCII white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
#: Entries that a worker's word-to-hash cache may hold before it starts afresh.
CACHE_ENTRIES = 250_000
#: Bytes of text that numpy works on at a time.
SLICE = 500_000
_SEPARATORS = bytes(c for c in range(128) if not (48 <= c <= 57 or 97 <= c <= 122))
_ALNUM_TABLE = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))
_MULTIPLIER = 0x9E3779B97F4A7C15
_FINISH = np.uint64(0xD6E8FEB86659FD93)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder; only where none is set and Spark runs in one process, as in tests, a new local one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete_path(spark: SparkSession, path: str) -> None:
    at, files = _file_system(spark, path)
    files.delete(at, True)


def create_file(spark: SparkSession, path: str) -> bool:
    """Creates an empty file; False if there is one, also if another process creates it at the same time."""
    at, files = _file_system(spark, path)
    return files.createNewFile(at)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder; none if it does not exist."""
    at, files = _file_system(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(at)) if files.exists(at) else []


class Workspace:
    """A new folder below the shared scratch folder for the tables that one job writes to cut its lineage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def remove(self, name: str) -> None:
        """Deletes a table that nothing reads any more."""
        delete_path(self.spark, f"{self.path}/{name}")


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]], schema: str | StructType) -> DataFrame:
    """Runs ``make()`` once a task and what it returns on each Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            yield from each(batch)
        pa.default_memory_pool().release_unused()  # workers live on between tasks

    return df.mapInArrow(run, schema)


def filter_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list[bool]]]) -> DataFrame:
    """The rows for which ``make()``'s function, called with batches of bounded size, gives true; no other copy is made."""

    def filtered():
        keep = make()
        return lambda batch: (piece.filter(pa.array(keep(piece), pa.bool_())) for piece in slices(batch, most=SLICE))

    return map_batches(df, filtered, df.schema)


def whole_rows(docs: DataFrame) -> DataFrame:
    """Each row as one struct named doc_id beside its text: operators that carry an id through then carry the row,
    whatever its columns are called. ``select("doc_id.*")`` unfolds it."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc_id"), "text")


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """A text column as UTF-8 bytes, not decoded."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def slices(batch: pa.RecordBatch, name: str = "text", most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that a piece holds about ``most`` bytes of text, or one row: numpy memory stays bounded."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + most, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def space_words(text: bytes | None) -> list[bytes]:
    return text.split() if text else []


def lower_words(text: bytes | None) -> list[bytes]:
    """``space_words`` with A-Z in lower case."""
    return text.lower().split() if text else []


def alnum_words(text: bytes | None) -> list[bytes]:
    return text.lower().translate(_ALNUM_TABLE).split() if text else []


class WordHashes(dict):
    """64-bit hashes of words, kept while a worker sees the same words again."""

    def __init__(self, seed: int = 0):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: Live as long as the Python worker, over many tasks; the second is independent of the first.
HASHES, SECOND_HASHES = WordHashes(), WordHashes(0x5EED)


def finish(values: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values; one to one."""
    values = values ^ (values >> np.uint64(32))
    values = values * _FINISH
    return values ^ (values >> np.uint64(29))


def ngrams(hashes: np.ndarray, n: int, multiplier: int = _MULTIPLIER) -> np.ndarray:
    """A 64-bit hash of each n consecutive word hashes; empty if there are fewer. Doubles widths, so it takes log n steps."""
    if n < 1 or len(hashes) < n:
        return np.empty(0, np.uint64)
    width, power, block = 1, multiplier, hashes
    out, out_width = None, 0
    rest = n
    while rest:
        if rest & 1:
            if out is None:
                out, out_width = block, width
            else:
                # out covers out_width words from i; block continues after them
                m = len(hashes) - (out_width + width) + 1
                out = out[:m] * np.uint64(power) + block[out_width : out_width + m]
                out_width += width
        rest >>= 1
        if rest:
            m = len(hashes) - 2 * width + 1
            block = block[:m] * np.uint64(power) + block[width : width + m]
            width, power = width * 2, power * power % 2**64
    return finish(out)


def shingle_set(words: list[bytes], n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; fewer words than n make one shingle, no word makes none."""
    if not words:
        return np.empty(0, np.uint64)
    hashes = HASHES.of(words)
    return np.unique(ngrams(hashes, min(n, len(words))))


def crc_mod(column: Column, divisor: int) -> Column:
    return F.crc32(column.cast("string").cast("binary")) % divisor


def hash_fraction(column: Column, fraction: float, seed: int) -> Column:
    """True for about this fraction of keys, the same ones in every run."""
    return F.pmod(F.xxhash64(F.lit(seed), column), F.lit(1_000_000)) < F.lit(int(round(fraction * 1_000_000)))
