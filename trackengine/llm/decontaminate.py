"""Benchmark decontamination: prefix-filtered set join of document shingles with benchmark windows.

Every benchmark item is cut into windows of ``window`` words (an item of fewer words is one window). The 3-word
shingles of the windows are ordered by rarity over the whole corpus; for exact containment a window's necessary prefix
is its one rarest shingle. Documents meet a window only through that shingle; the position must leave room for the
whole window (length and position bounds); the window's words are then compared exactly.

While the benchmark has at most ``BROADCAST_WORDS`` words in ``BROADCAST_BYTES``, its index is broadcast and documents are
read in place, with no shuffle. A larger benchmark takes the same steps by shuffle joins (``join_windows``).

Edge cases: null, empty and wordless texts have no words and no hit; such items have no window. Items of equal text
are all reported; equal item ids count once; a null item id is reported as an empty string. Repeated documents are
judged one by one. Only ``doc_id``/``text`` and ``item_id``/``text`` are read, so further columns may have any name.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from trackengine.llm.common import HASHES, Workspace, alnum_words, filter_batches, map_batches, ngrams, slices, texts, whole_rows

WINDOW, SHINGLE = 10, 3
#: Words of the largest benchmark whose index is broadcast (at most some 180 bytes a word in each worker).
BROADCAST_WORDS = 500_000
#: Bytes of all texts with a word and their ids in such a benchmark.
BROADCAST_BYTES = 32 << 20
#: Candidate windows of a document that are compared at a time (those of one place together).
CANDIDATES = 100_000
OUT = "array<struct<start:int,`end`:int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _shingles(words: np.ndarray, size: int, base: int) -> np.ndarray:
    """Exact integer keys of the ``size``-word shingles of word numbers; -1 where a word has no number."""
    if len(words) < size:
        return np.empty(0, np.int64)
    m = len(words) - size + 1
    key, known = words[:m].copy(), words[:m] >= 0
    for k in range(1, size):
        key = key * base + words[k : k + m]
        known &= words[k : k + m] >= 0
    return np.where(known, key, -1)


def _runs(at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows ``which`` of a table whose row k lies at ``at[k]`` to ``at[k + 1]``: the positions of all their entries,
    and for each the place in ``which`` that it belongs to."""
    sizes = at[which + 1] - at[which]
    owner = np.repeat(np.arange(len(which)), sizes)
    return np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + at[which][owner], owner


class Index:
    """Windows of a benchmark, found by their rarest shingle.

    The items' words stand in one flat array of word numbers. A window is a place and a length in it, the first of equal
    windows; its items, and the windows of a shingle, are rows of offsets and entries."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        items = [(item, words) for item, words in items if words]
        self.number: dict[bytes, int] = {}
        self.words = np.fromiter((self.number.setdefault(w, len(self.number)) for _, words in items for w in words), np.int32)
        self.base = len(self.number) + 1
        self.names = sorted({item for item, _ in items})
        named = {item: k for k, item in enumerate(self.names)}
        item = np.fromiter((named[i] for i, _ in items), np.int64, len(items))
        sizes = np.fromiter((len(words) for _, words in items), np.int64, len(items))

        # every place where a window begins, and the windows of each length told apart
        item_of = np.repeat(np.arange(len(items)), np.maximum(sizes - window, 0) + 1)
        first = np.cumsum(np.maximum(sizes - window, 0) + 1) - np.maximum(sizes - window, 0) - 1
        at = (np.cumsum(sizes) - sizes)[item_of] + np.arange(len(item_of)) - first[item_of]
        lengths = np.minimum(sizes, window)[item_of]
        starts, taken, pairs, known = [], [], [], 0
        for length in np.unique(lengths).tolist():
            chosen = np.flatnonzero(lengths == length)
            _, begins, same = np.unique(self._names_of(at[chosen], length), return_index=True, return_inverse=True)
            starts.append(at[chosen][begins])
            taken.append(np.full(len(begins), length))
            pairs.append((known + same) * len(self.names) + item[item_of[chosen]])
            known += len(begins)
        none = [np.empty(0, np.int64)]
        self.start = np.concatenate(none + starts).astype(np.int32)
        self.length = np.concatenate(none + taken).astype(np.int32)
        owned = np.unique(np.concatenate(none + pairs))
        self.owner = (owned % max(1, len(self.names))).astype(np.int32)
        self.owner_at = np.searchsorted(owned, np.arange(known + 1) * len(self.names))

        #: of windows, by shingle size (smaller than SHINGLE only for items that short)
        self.sizes = np.unique(np.minimum(SHINGLE, self.length)).tolist()
        self.keys = {s: np.unique(np.concatenate([self._keys_of(*group) for group in self._groups(s)])) for s in self.sizes}
        self.prefix_keys: dict[int, np.ndarray] = {}
        self.prefix_at: dict[int, np.ndarray] = {}
        self.prefix_window: dict[int, np.ndarray] = {}
        self.prefix_offset: dict[int, np.ndarray] = {}

    def _names_of(self, at: np.ndarray, length: int) -> np.ndarray:
        """Numbers of the ``length`` words from each place, equal just where the words are: numbers of 1, 2, 4, ... words are
        made of pairs of numbers of half as many; two that overlap make any other length."""
        names, span = self.words.astype(np.int64), 1
        paired = lambda a, b: a * (int(b.max(initial=0)) + 1) + b
        while 2 * span <= length:
            names = np.unique(paired(names, np.append(names[span:], np.zeros(span, np.int64))), return_inverse=True)[1]
            span *= 2
        return paired(names[at], names[at + length - span])

    def _groups(self, size: int) -> list[tuple[np.ndarray, int, int]]:
        """Windows of each length that has shingles of the size: their numbers, how many shingles they have, the size."""
        lengths = np.unique(self.length).tolist()
        return [(np.flatnonzero(self.length == n), n - size + 1, size) for n in lengths if min(SHINGLE, n) == size]

    def _keys_of(self, windows: np.ndarray, count: int, size: int) -> np.ndarray:
        """Keys of the shingles of windows of one length, a row each."""
        places = self.start[windows].astype(np.int64)[:, None] + np.arange(count)
        key = self.words[places].astype(np.int64)
        for k in range(1, size):
            key = key * self.base + self.words[places + k]
        return key.ravel()

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))

    @staticmethod
    def places(keys: np.ndarray, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose key is among the sorted ``sought``, and which one it is."""
        at = np.flatnonzero(keys >= 0)
        found = np.minimum(np.searchsorted(sought, keys[at]), len(sought) - 1)
        same = sought[found] == keys[at] if len(sought) else np.zeros(len(at), bool)
        return at[same], found[same]

    def order(self, frequency: dict[int, np.ndarray]) -> None:
        """Picks each window's rarest shingle (ties: the smaller key, then the first place). Keys are not needed after that."""
        for size in self.sizes:
            keys = self.keys[size]
            order = np.lexsort((keys, frequency[size]))
            rank = np.empty(len(keys), np.int64)
            rank[order] = np.arange(len(keys))
            chosen = []
            for windows, count, _ in self._groups(size):
                ranks = rank[np.searchsorted(keys, self._keys_of(windows, count, size))].reshape(-1, count)
                offset = ranks.argmin(axis=1)
                chosen.append((windows, offset, order[ranks[np.arange(len(windows)), offset]]))
            windows, offset, key = (np.concatenate(x) for x in zip(*chosen, strict=True))
            by_key = np.argsort(key, kind="stable")
            used = np.unique(key)
            self.prefix_keys[size] = keys[used]
            self.prefix_at[size] = np.append(np.searchsorted(key[by_key], used), len(key))
            self.prefix_window[size], self.prefix_offset[size] = windows[by_key].astype(np.int32), offset[by_key].astype(np.int32)
        self.keys = {}

    def hits(self, words: list[bytes]) -> tuple[list[dict[str, int]], list[str]]:
        """Ranges of hit words and the items whose windows occur."""
        doc = self.numbers(words)
        edges, found = None, []
        for size in self.sizes:
            at, key = self.places(_shingles(doc, size, self.base), self.prefix_keys[size])
            if not len(at):
                continue
            made = np.cumsum(self.prefix_at[size][key + 1] - self.prefix_at[size][key])
            cuts = np.searchsorted(made, np.arange(CANDIDATES, made[-1], CANDIDATES), "right")
            for places, keys in zip(np.split(at, cuts), np.split(key, cuts), strict=True) if len(cuts) else [(at, key)]:
                entries, owner = _runs(self.prefix_at[size], keys)
                window, start = self.prefix_window[size][entries], places[owner] - self.prefix_offset[size][entries]
                length = self.length[window]
                inside = (start >= 0) & (start + length <= len(doc))
                window, start, length = window[inside], start[inside], length[inside]
                for n in set(length.tolist()):
                    of = length == n
                    alike = (doc[start[of][:, None] + np.arange(n)] == self.words[self.start[window[of]][:, None] + np.arange(n)]).all(1)
                    if alike.any():
                        edges = np.zeros(len(doc) + 1, np.int64) if edges is None else edges
                        np.add.at(edges, start[of][alike], 1)
                        np.add.at(edges, start[of][alike] + n, -1)
                        found.append(np.unique(window[of][alike]))
        if edges is None:
            return [], []
        edge = np.diff((np.cumsum(edges) > 0).astype(np.int8), prepend=0)
        items = np.unique(self.owner[_runs(self.owner_at, np.unique(np.concatenate(found)))[0]])
        spans = [{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]
        return spans, [self.names[k] for k in items]


def _frequencies(docs: DataFrame, index: Index) -> dict[int, np.ndarray]:
    """In how many documents each benchmark shingle occurs, over the whole corpus."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def counted(batches):
        index = shared.value
        sums = {s: np.zeros(len(index.keys[s]), np.int64) for s in index.sizes}
        for batch in batches:
            for text in texts(batch):
                doc = index.numbers(alnum_words(text))
                for s in index.sizes:
                    sums[s][np.unique(Index.places(_shingles(doc, s, index.base), index.keys[s])[1])] += 1
        for s in index.sizes:
            at = np.flatnonzero(sums[s])
            yield pa.RecordBatch.from_pydict({"size": pa.array([s] * len(at), pa.int32()), "at": pa.array(at, pa.int64()), "n": pa.array(sums[s][at], pa.int64())})

    out = {s: np.zeros(len(index.keys[s]), np.int64) for s in index.sizes}
    rows = docs.select("text").mapInArrow(counted, "size int, at long, n long").groupBy("size", "at").agg(F.sum("n").alias("n"))
    for r in rows.collect():  # one row for each shingle of a benchmark that is small enough to broadcast
        out[r["size"]][r["at"]] = r["n"]
    shared.unpersist()
    return out


def _fits(items: DataFrame, words: int) -> bool:
    """Whether the items, all with a word, may be collected and broadcast."""

    def make():
        return lambda batch: [pa.RecordBatch.from_pydict({"n": pa.array([len(alnum_words(t)) for t in texts(batch)], pa.int64()), "bytes": pa.array([len(t) for t in texts(batch)], pa.int64())})]

    sizes = map_batches(items.select("text"), make, "n long, bytes long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    ids = items.agg(F.coalesce(F.sum(F.octet_length("item_id")), F.lit(0))).first()[0]
    return (found := sizes.first())["n"] <= words and found["bytes"] + ids <= BROADCAST_BYTES


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """doc_id, n_words, ``spans`` (ranges of hit words, end exclusive) and ``items`` (ids, as strings, whose windows occur)."""
    docs, items = docs.select("doc_id", "text"), _items(benchmark)
    shared = _shared_index(docs, items, window, broadcast_words)
    if shared is None:
        return join_windows(docs, items, window)

    def make():
        def each(batch: pa.RecordBatch):
            for piece in slices(batch):
                yield hits_of(piece)

        def hits_of(batch: pa.RecordBatch) -> pa.RecordBatch:
            words = [alnum_words(t) for t in texts(batch)]
            found = [shared.value.hits(w) for w in words]
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(w) for w in words], pa.int64()), pa.array([s for s, _ in found], _SPANS), pa.array([i for _, i in found], pa.list_(pa.string()))],
                ["doc_id", "n_words", "spans", "items"],
            )

        return each

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs, make, f"doc_id {kind}, n_words long, spans {OUT}, items array<string>")


def _items(benchmark: DataFrame) -> DataFrame:
    """Ids as strings and texts of the items that have a word."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    return items.filter(F.col("text").rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"))


def _shared_index(docs: DataFrame, items: DataFrame, window: int, broadcast_words: int) -> Broadcast | None:
    """The benchmark's index on every executor, or None if it is too large for that."""
    if not _fits(items, broadcast_words):
        return None
    index = Index([(r["item_id"], alnum_words(r["text"].encode() if r["text"] else None)) for r in items.collect()], window)
    index.order(_frequencies(docs, index))
    return docs.sparkSession.sparkContext.broadcast(index)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """The documents without any hit word; their columns stay as they are."""
    items = _items(benchmark)
    shared = _shared_index(docs, items, window, broadcast_words)
    if shared is None:
        return join_windows(whole_rows(docs), items, window).filter(F.size("items") == 0).select("doc_id.*")

    def make():
        return lambda batch: [not shared.value.hits(alnum_words(t))[1] for t in texts(batch)]

    return filter_batches(docs, make)


def _keys(hashes: np.ndarray, size: int) -> np.ndarray:
    """64-bit keys of the ``size``-word shingles of word hashes; sizes have keys of their own."""
    return (ngrams(hashes, size) ^ np.uint64(size * 0x9E3779B97F4A7C15 % 2**64)).view(np.int64)


def _doc_shingles(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """row, place and key of every shingle of the sizes asked for."""

    def make():
        def each(batch: pa.RecordBatch):
            for piece in slices(batch):
                out: list[list[np.ndarray]] = [[np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.int64)]]
                for row, text in zip(piece.column("row").to_pylist(), texts(piece), strict=True):
                    hashes = HASHES.of(alnum_words(text))
                    for size in sizes:
                        keys = _keys(hashes, size)
                        out[0].append(np.full(len(keys), row, np.int64))
                        out[1].append(np.arange(len(keys), dtype=np.int32))
                        out[2].append(keys)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["row", "place", "key"])

        return each

    return map_batches(rows.select("row", "text"), make, "row long, place int, key long")


def _window_shingles(windows: DataFrame) -> DataFrame:
    """id, and offset, size and key of each shingle of a window."""

    def make():
        def each(batch: pa.RecordBatch):
            at, offsets, sizes, keys = [], [], [], []
            for k, words in enumerate(batch.column("window").to_pylist()):
                size = min(SHINGLE, len(words))
                found = _keys(HASHES.of([w.encode() for w in words]), size).tolist()
                at += [k] * len(found)
                offsets += range(len(found))
                sizes += [size] * len(found)
                keys += found
            ids = batch.column("id").take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(offsets, pa.int32()), pa.array(sizes, pa.int32()), pa.array(keys, pa.int64())], ["id", "offset", "size", "key"])

        return each

    return map_batches(windows.select("id", "window"), make, "id long, offset int, size int, key long")


def _verified(met: DataFrame) -> DataFrame:
    """row, spans and windows' ids of documents whose ``found`` (start, id, window) hold windows word by word."""

    def make():
        def each(batch: pa.RecordBatch):
            for piece in slices(batch):
                out = []
                for row, text, found in zip(piece.column("row").to_pylist(), texts(piece), piece.column("found").to_pylist(), strict=True):
                    words, ids = alnum_words(text), set()
                    hit = np.zeros(len(words) + 2, np.int8)
                    for f in found:
                        start, window = f["start"], [w.encode() for w in f["window"]]
                        if words[start : start + len(window)] == window:
                            hit[start + 1 : start + len(window) + 1] = 1
                            ids.add(f["id"])
                    if ids:
                        edge = np.diff(hit)
                        out.append((row, [{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)], list(ids)))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], _SPANS), pa.array([r[2] for r in out], pa.list_(pa.int64()))], ["row", "spans", "ids"])

        return each

    return map_batches(met.select("row", "text", "found"), make, f"row long, spans {OUT}, ids array<long>")


def join_windows(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The same result by shuffle joins, for a benchmark of any size.

    Shingles are 64-bit keys. Those of documents meet the benchmark's keys first, so that only what both have goes on; a
    document's text is joined once, with all its candidate windows. Windows go by ids; the items of those that occur are joined
    last. A row number made once and written down tells repeated documents apart."""
    spark = docs.sparkSession
    work = Workspace(spark, "decontaminate")

    def numbered():
        def each(batch: pa.RecordBatch):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(alnum_words(t)) for t in texts(batch)], pa.int64())], [*batch.schema.names, "n_words"])

        return each

    schema = StructType([*docs.select("doc_id", "text").schema.fields, StructField("n_words", LongType())])
    rows = work.write(map_batches(docs.select("doc_id", "text"), numbered, schema).withColumn("row", F.monotonically_increasing_id()), "rows")

    def tokens():
        def each(batch: pa.RecordBatch):
            words = [[w.decode() for w in alnum_words(t)] for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(words, pa.list_(pa.string()))], ["item_id", "words"])

        return each

    starts = F.expr(f"sequence(0, greatest(0, size(words) - {window}))")
    cut = map_batches(items, tokens, "item_id string, words array<string>").select("item_id", F.explode(F.transform(starts, lambda k: F.slice("words", k + 1, window))).alias("window"))
    cut = work.write(cut, "cut")
    windows = work.write(cut.select("window").distinct().withColumn("id", F.monotonically_increasing_id()), "windows")
    places = work.write(_window_shingles(windows), "places")
    sizes = [r[0] for r in places.select("size").distinct().collect()]  # at most SHINGLE of them
    shared = work.write(_doc_shingles(rows, sizes).join(places.select("key").distinct(), "key", "left_semi"), "shared")
    seen = shared.groupBy("key", "row").agg(F.first("place")).groupBy("key").agg(F.count("*").alias("df"))
    rarest = places.join(seen, "key", "left").groupBy("id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "key", "offset")).alias("first"))
    prefix = work.write(rarest.filter("first.df > 0").select("first.key", "first.offset", "id").join(windows, "id"), "prefix")
    met = shared.join(prefix, "key").select("row", (F.col("place") - F.col("offset")).alias("start"), "id", "window").filter("start >= 0")
    found = work.write(met.groupBy("row").agg(F.collect_list(F.struct("start", "id", "window")).alias("found")), "found")
    verified = work.write(_verified(rows.select("row", "text").join(found, "row")), "verified")
    owners = work.write(cut.join(windows, "window").select("id", "item_id").distinct(), "owners")
    occurring = verified.select("row", F.explode("ids").alias("id")).join(owners, "id").select("row", "item_id").distinct()
    named = work.write(occurring.groupBy("row").agg(F.array_sort(F.collect_list("item_id")).alias("items")), "named")
    hits = verified.select("row", "spans").join(named, "row")
    out = rows.join(hits, "row", "left")
    return out.select("doc_id", "n_words", F.coalesce("spans", F.expr(f"cast(array() as {OUT})")).alias("spans"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))
