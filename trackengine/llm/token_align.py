"""Alignment of two tokenizers: which tokens of A and B cover the same bytes of a text, and how often ids meet.

Both tokenizers cut the same bytes, a space and the text. Tokens and bytes make incidence matrices, kept as compressed
sparse rows (``Csr``) of numpy arrays. Gustavson's row product A·Bᵀ (``gustavson``) gives the overlap links: how many bytes
an A token shares with a B token. Where an A token and the last B token that it overlaps end together, both sequences are
cut into groups; the products of the token-group incidence matrices give the shared-group links. Rows are multiplied in
blocks of bounded size, and equal ids of a group are added up first, so that a group of very many tokens needs no product
of its tokens.

How often two ids are linked is counted over all documents by Spark. Frequent id pairs, at most ``HEAD``, go to every task;
rarer ones are joined with the few documents that hold them. Both ways give the same counts.

Edge cases: a text that is null or empty, or whose tokens do not spell a space and the text (a text that holds U+2581
itself), has no tokens, only zeros. Texts are taken whole, in slices of a bounded number of bytes or one text. Rows with the
same or no ``doc_id`` are documents of their own. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from trackengine.llm.common import SLICE, Workspace, map_batches, slices

#: Pairs of ids whose counts every task gets; 16 bytes each.
HEAD = 2_000_000
#: Entries that a row product forms at a time.
BLOCK = 2_000_000
#: The split of byte-level BPE before merging. Fixed value.
BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass
class Csr:
    """Row r has the columns ``indices[indptr[r]:indptr[r + 1]]`` with the values of ``data`` (None: all 1)."""

    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray | None = None


def _summed(keys: np.ndarray, values: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their values."""
    if len(keys) > 1 and (keys[1:] < keys[:-1]).any():
        if values is None:
            keys = np.sort(keys)
        else:
            order = np.argsort(keys, kind="stable")
            keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    if values is None:
        return keys[first], np.diff(np.append(first, len(keys)))
    return keys[first], np.add.reduceat(values, first) if len(first) else values


def gustavson(left: Csr, right: Csr, n_columns: int, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The product's entries (rows, columns, values), in order; row by row, as many rows at a time as ``block`` entries allow.

    A row of the product is the sum of those rows of ``right`` that the row of ``left`` names. One row alone may form more
    entries than a block: its entries are then added up piece by piece."""
    spread = right.indptr[left.indices + 1] - right.indptr[left.indices]
    formed = np.concatenate(([0], np.cumsum(spread)))
    n_rows, row = len(left.indptr) - 1, 0
    owner = np.repeat(np.arange(n_rows), np.diff(left.indptr))
    while row < n_rows:
        end = max(row + 1, int(np.searchsorted(formed[left.indptr], formed[left.indptr[row]] + block, "right")) - 1)
        keys, values = np.empty(0, np.int64), np.empty(0, np.int64)
        at, stop = int(left.indptr[row]), int(left.indptr[end])
        while at < stop:
            to = min(stop, max(at + 1, int(np.searchsorted(formed, formed[at] + block, "right")) - 1))
            n = spread[at:to]
            inside = np.arange(formed[to] - formed[at]) - np.repeat(formed[at:to] - formed[at], n) + np.repeat(right.indptr[left.indices[at:to]], n)
            new = np.repeat(owner[at:to], n) * n_columns + right.indices[inside]
            weights = None
            if left.data is not None or right.data is not None:
                weights = np.ones(len(new), np.int64) if left.data is None else np.repeat(left.data[at:to], n)
                weights = weights if right.data is None else weights * right.data[inside]
            new, weights = _summed(new, weights)
            keys, values = (new, weights) if not len(keys) else _summed(np.concatenate((keys, new)), np.concatenate((values, weights)))
            at = to
        yield keys // n_columns, keys % n_columns, values
        row = end


def _byte_level() -> dict[str, int]:
    """The byte that each character of byte-level BPE stands for: printable ones themselves, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteLevelTokenizer:
    """A byte-level BPE tokenizer from a ``tokenizers`` file; strings of special tokens in a text are plain text.

    Where the file is plain byte-level BPE whose merges are in the order of ids, ``tiktoken`` encodes with its entries as
    ranks, which gives the same ids faster (a test holds both against each other); else, and for a text that its pattern
    engine refuses, the ``tokenizers`` library encodes."""

    def __init__(self, text: str):
        self.whole = Tokenizer.from_str(text)
        self.whole.encode_special_tokens = True
        found, to_byte = json.loads(text), _byte_level()
        special = {x["content"] for x in found.get("added_tokens", [])}
        vocabulary = self.whole.get_vocab()
        self.size = max(vocabulary.values()) + 1
        self.bytes: list[bytes] = [b""] * self.size
        for piece, k in vocabulary.items():
            self.bytes[k] = piece.encode() if piece in special else bytes(to_byte[c] for c in piece)
        self.fast = self._ranked(found, special)

    def _ranked(self, found: dict, special: set[str]) -> tiktoken.Encoding | None:
        model, before = found["model"], found.get("pre_tokenizer") or {}
        plain = model.get("type", "BPE") == "BPE" and not found.get("normalizer") and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        plain = plain and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model.get("merges", [])]
        if not plain or made != sorted(made) or len(made) + 256 != len(model["vocab"].keys() - special):
            return None
        ranks = {self.bytes[k]: k for piece, k in model["vocab"].items() if piece not in special}
        return tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL_SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.fast is not None:
            try:
                return self.fast.encode_ordinary(text)
            except Exception:  # the pattern engine's stack, on a very long run
                pass
        return self.whole.encode(text, add_special_tokens=False).ids


class PieceTokenizer:
    """A SentencePiece model, which adds the space before the text itself."""

    def __init__(self, model: bytes):
        self.whole = SentencePieceProcessor(model_proto=model)
        self.size = self.whole.get_piece_size()
        self.bytes = [self._spelled(k) for k in range(self.size)]

    def _spelled(self, k: int) -> bytes:
        piece = self.whole.id_to_piece(k)
        return bytes([int(piece[3:5], 16)]) if self.whole.is_byte(k) else piece.replace("▁", " ").encode()

    def encode(self, text: str) -> list[int]:
        return self.whole.encode(text, num_threads=1)


@dataclass
class Aligner:
    """Two tokenizers, as the contents of their files; made ready once a Python worker."""

    a_file: str
    b_file: bytes

    @staticmethod
    def load(a_path: str, b_path: str) -> Aligner:
        """Reads the files where this is called, on the driver; tasks get their contents."""
        with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
            return Aligner(a.read(), b.read())

    def ready(self) -> Ready:
        key = hashlib.sha256(self.a_file.encode() + self.b_file).digest()
        if key not in _READY:
            _READY.clear()
            _READY[key] = Ready(ByteLevelTokenizer(self.a_file), PieceTokenizer(self.b_file))
        return _READY[key]


@dataclass
class Aligned:
    """The documents of a slice one after the other: token ids, the group of each token, the document of each group."""

    a: np.ndarray
    b: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    a_ends: np.ndarray  # places after the last token of each document
    b_ends: np.ndarray
    group_ends: np.ndarray
    overlap: Csr


class Ready:
    def __init__(self, a: ByteLevelTokenizer, b: PieceTokenizer):
        self.a, self.b = a, b
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t.bytes], np.int64) for t in (a, b))
        most = max(a.size, b.size)
        # the text of an id with each of the four separators that may follow it
        self.shown = [f"{k}{end}".encode() for end in (",", "|", ",", ";") for k in range(most)]
        self.most = most

    def tokens(self, text: str | None) -> tuple[list[int], list[int]]:
        if not text:
            return [], []
        spaced, a, b = f" {text}".encode(), self.a.encode(f" {text}"), self.b.encode(text)
        if b"".join(map(self.a.bytes.__getitem__, a)) != spaced or b"".join(map(self.b.bytes.__getitem__, b)) != spaced:
            return [], []
        return a, b

    def align(self, texts: list[str | None]) -> Aligned:
        """The end of a document is an end of both sequences, so documents are aligned side by side in one matrix."""
        pairs = [self.tokens(t) for t in texts]
        a, b = (np.array([k for p in pairs for k in p[side]], np.int64) for side in (0, 1))
        a_ends, b_ends = (np.cumsum([len(p[side]) for p in pairs]).astype(np.int64) for side in (0, 1))
        a_stops, b_stops = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        n_bytes = int(a_stops[-1]) if len(a) else 0
        by_byte = Csr(np.concatenate(([0], a_stops)), np.arange(n_bytes))
        byte_owner = Csr(np.arange(n_bytes + 1), np.repeat(np.arange(len(b)), self.b_sizes[b]))
        rows, columns, shared = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (list(x) for x in zip(*gustavson(by_byte, byte_owner, max(1, len(b))), strict=True))) if len(a) else (np.empty(0, np.int64),) * 3
        overlap = Csr(np.searchsorted(rows, np.arange(len(a) + 1)), columns, shared)
        together = a_stops == b_stops[columns[overlap.indptr[1:] - 1]] if len(a) else np.empty(0, bool)
        a_group = np.cumsum(together) - together
        b_group = np.empty(len(b), np.int64)
        b_group[columns] = a_group[rows]  # tokens that overlap are in one group
        upto = np.concatenate(([0], np.cumsum(together)))
        return Aligned(a, b, a_group, b_group, a_ends, b_ends, upto[a_ends], overlap)

    def links(self, x: Aligned) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, id pair, number of linked occurrences) in order; the pair is A's id times B's vocabulary plus B's id."""
        n_groups = int(x.group_ends[-1]) if len(x.group_ends) else 0
        a_keys, a_counts = _summed(x.a_group * self.a.size + x.a, None)
        b_keys, b_counts = _summed(x.b_group * self.b.size + x.b, None)
        groups_of_b = Csr(np.searchsorted(b_keys, np.arange(n_groups + 1) * self.b.size), b_keys % self.b.size, b_counts)
        in_group = Csr(np.arange(len(a_keys) + 1), a_keys // self.a.size, a_counts)
        doc_of = np.searchsorted(x.group_ends, a_keys // self.a.size, "right")
        pair_space = self.a.size * self.b.size
        keys, values, held = [], [], 0
        for rows, columns, found in gustavson(in_group, groups_of_b, self.b.size):
            one = _summed(doc_of[rows] * pair_space + (a_keys[rows] % self.a.size) * self.b.size + columns, found)
            keys, values, held = [*keys, one[0]], [*values, one[1]], held + len(one[0])
            if len(keys) > 1 and held > 2 * BLOCK:
                one = _summed(np.concatenate(keys), np.concatenate(values))
                keys, values, held = [one[0]], [one[1]], 0
        if not keys:
            return (np.empty(0, np.int64),) * 3
        all_keys, all_values = _summed(np.concatenate(keys), np.concatenate(values)) if len(keys) > 1 else (keys[0], values[0])
        return all_keys // pair_space, all_keys % pair_space, all_values

    def written(self, x: Aligned) -> list[bytes]:
        """Each document's groups as ``a1,a2|b1;a3|b2,b3``."""
        n_groups = int(x.group_ends[-1]) if len(x.group_ends) else 0
        a_last = np.append(x.a_group[1:] != x.a_group[:-1], True) if len(x.a) else np.empty(0, bool)
        b_last = np.append(x.b_group[1:] != x.b_group[:-1], True) if len(x.b) else np.empty(0, bool)
        a_before = np.searchsorted(x.a_group, np.arange(n_groups + 1))
        b_before = np.searchsorted(x.b_group, np.arange(n_groups + 1))
        shown = np.empty(len(x.a) + len(x.b), np.int64)
        shown[np.arange(len(x.a)) + b_before[x.a_group]] = x.a + self.most * a_last
        shown[np.arange(len(x.b)) + a_before[x.b_group + 1]] = x.b + self.most * (2 + b_last)
        ends, out, begin, spelled = x.a_ends + x.b_ends, [], 0, self.shown
        for end in ends:
            out.append(b"".join([spelled[k] for k in shown[begin:end].tolist()])[:-1])
            begin = end
        return out


_READY: dict[bytes, Ready] = {}


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def alignments(docs: DataFrame, aligner: Aligner) -> DataFrame:
    """One row a document: the ids of both tokenizers, the group of each token, and the overlap links by A token.

    ``overlaps`` are (a, b, bytes): places of tokens, and the number of bytes that both cover."""
    kinds = [pa.list_(pa.int32())] * 4

    def make():
        ready = aligner.ready()

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for piece in slices(batch, most=SLICE):
                x = ready.align(piece.column("text").to_pylist())
                a_at, b_at, g_at = (np.concatenate(([0], e)) for e in (x.a_ends, x.b_ends, x.group_ends))
                cut = lambda values, at, base: [values[at[k] : at[k + 1]] - base[k] for k in range(piece.num_rows)]
                zero = np.zeros(piece.num_rows, np.int64)
                columns = [cut(x.a, a_at, zero), cut(x.b, b_at, zero), cut(x.a_group, a_at, g_at), cut(x.b_group, b_at, g_at)]
                rows = np.repeat(np.arange(len(x.a)), np.diff(x.overlap.indptr))
                at = x.overlap.indptr[a_at]
                fields = [pa.array(v.astype(np.int32)) for v in (rows - np.repeat(a_at[:-1], np.diff(at)), x.overlap.indices - np.repeat(b_at[:-1], np.diff(at)), x.overlap.data)]
                overlaps = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.StructArray.from_arrays(fields, ["a", "b", "bytes"]))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *(pa.array([v.astype(np.int32) for v in c], k) for c, k in zip(columns, kinds, strict=True)), overlaps], ["doc_id", "a_ids", "b_ids", "a_groups", "b_groups", "overlaps"])

        return each

    return map_batches(_texts(docs), make, "doc_id long, a_ids array<int>, b_ids array<int>, a_groups array<int>, b_groups array<int>, overlaps array<struct<a:int,b:int,bytes:int>>")


def _linked(docs: DataFrame, aligner: Aligner, wide: bool) -> DataFrame:
    """One row a document: sizes, digest of the groups, and its linked id pairs with the number of linked occurrences."""
    kind = np.int64 if wide else np.int32

    def make():
        ready = aligner.ready()

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for piece in slices(batch, most=SLICE):
                x = ready.align(piece.column("text").to_pylist())
                doc, pair, times = ready.links(x)
                at = np.searchsorted(doc, np.arange(piece.num_rows + 1))
                n_links = np.diff(np.concatenate(([0], np.cumsum(times)))[at])
                sizes = [np.diff(np.concatenate(([0], e))) for e in (x.a_ends, x.b_ends, x.group_ends)]
                digests = [hashlib.sha256(w).hexdigest() if w else "" for w in ready.written(x)]
                lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(v)) for v in (pair.astype(kind), times.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *(pa.array(v) for v in (*sizes, n_links)), pa.array(digests), *lists], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

        return each

    pairs = "array<long>" if wide else "array<int>"
    return map_batches(_texts(docs), make, f"doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs {pairs}, times array<long>")


def _level(counts: DataFrame, head: int) -> int:
    """The least power of two so that at most ``head`` pairs are counted that often or more."""
    by_level = {r["level"]: r["n"] for r in counts.groupBy(F.floor(F.log2("n") + 1e-9).cast("int").alias("level")).agg(F.count("*").alias("n")).collect()}
    held, level = 0, 64
    while level > 0 and held + by_level.get(level - 1, 0) <= head:
        level -= 1
        held += by_level.get(level, 0)
    return 2**level


def align(docs: DataFrame, aligner: Aligner, head: int = HEAD) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each document. Runs jobs.

    A pair of ids counts in how many documents it is linked. ``n_best`` are the links whose count is their A id's highest,
    ``count_sum`` is the sum of counts over links."""
    spark = docs.sparkSession
    work, ready = Workspace(spark, "token-align"), aligner.ready()
    width, n_ids = ready.b.size, ready.a.size
    wide = width * n_ids >= 2**31
    linked = work.write(_linked(docs, aligner, wide).withColumn("row", F.monotonically_increasing_id()), "linked")
    exploded = linked.select(F.explode("pairs").alias("pair"))
    counts = work.write(exploded.groupBy("pair").agg(F.count("*").alias("n")), "counts")
    # as many rows as A has ids at most
    best_rows = counts.groupBy(F.floor(F.col("pair") / width).cast("int").alias("a")).agg(F.max("n").alias("n")).toArrow()
    best = np.zeros(n_ids, np.int64)
    best[best_rows.column("a").to_numpy()] = best_rows.column("n").to_numpy()
    least = _level(counts, head)
    frequent = counts.filter(F.col("n") >= least).toArrow()  # at most ``head`` rows
    order = np.argsort(frequent.column("pair").to_numpy(), kind="stable")
    sent = spark.sparkContext.broadcast((frequent.column("pair").to_numpy()[order].astype(np.int64), frequent.column("n").to_numpy()[order], best))

    def looked_up(batch: pa.RecordBatch):
        keys, n, most = sent.value
        pairs = batch.column("pairs")
        values, times = pairs.flatten().to_numpy().astype(np.int64), batch.column("times").flatten().to_numpy()
        at = np.concatenate(([0], np.cumsum(np.diff(pairs.offsets.to_numpy()))))
        place = np.searchsorted(keys, values)
        known = place < len(keys)
        known[known] = keys[place[known]] == values[known]
        found = np.zeros(len(values), np.int64)
        found[known] = n[place[known]]
        return values, times, at, known, found, most[values // width]

    def head_sums():
        def each(batch: pa.RecordBatch):
            _, times, at, known, found, most = looked_up(batch)
            summed = [np.diff(np.concatenate(([0], np.cumsum(v)))[at]) for v in (times * (known & (found == most)), times * found)]
            kept = [batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "row")]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(v) for v in summed)], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "row", "n_best", "count_sum"])

        return each

    def rare():
        def each(batch: pa.RecordBatch):
            values, times, at, known, _, most = looked_up(batch)
            owner, left = np.repeat(batch.column("row").to_numpy(), np.diff(at)), ~known
            yield pa.RecordBatch.from_arrays([pa.array(v[left]) for v in (owner, values, times, most)], ["row", "pair", "times", "most"])

        return each

    out = map_batches(linked, head_sums, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, row long, n_best long, count_sum long")
    if least > 1:
        left = map_batches(linked.select("row", "pairs", "times"), rare, "row long, pair long, times long, most long")
        tail = counts.filter(F.col("n") < least).select(F.col("pair").cast("long").alias("pair"), "n")
        more = left.join(tail, "pair").groupBy("row").agg(F.sum(F.when(F.col("n") == F.col("most"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more_sum"))
        out = out.join(more, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))})
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
