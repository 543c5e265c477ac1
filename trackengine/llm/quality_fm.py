"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum (v_if x_i)^2)): pairwise interactions of rank
``RANK`` in time linear in the number of features. Features are the distinct hashed words of the lower-cased text
(log counts, unit length), binned structure statistics of the text, and binned metadata (``n_chars`` against the text).

``fit`` mixes parameters: labelled rows are dealt by a hash of doc_id into a fixed number of shards of bounded size;
every round each shard runs a few epochs of AdaGrad from the shared parameters inside a Spark task, and the results are
averaged. Parameters have a fixed size. Nothing but parameters reaches the driver.

Edge cases: a null or empty text has no word and is scored by its statistics alone. Labels that are null or not 0 or 1,
and labels without a document, teach nothing; without labels every score is 0.5. A null or absent n_chars is a feature of
its own. Repeated rows are scored each for itself. An id teaches once, whatever its rows and labels: of several texts the
one of the least hash, and nothing if its labels differ. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackengine.llm.common import HASHES, Workspace, crc_mod, hash_fraction, map_batches, slices, space_words, texts

WORD_BITS, RANK, BINS = 14, 4, 16
#: Bound of the labelled rows that the model is fitted on: about so many, picked by a hash of doc_id.
MAX_TRAIN_ROWS = 24_000
SHARDS, SHARD_ROWS, ROUNDS, BATCH, RATE, DECAY = 12, 500, 4, 64, 0.1, 1e-5
#: Epochs of a shard in a round: so many rows seen, within bounds.
ROWS_SEEN, EPOCHS = 8_000, (3, 40)
STATISTICS = 12
WIDTH = (1 << WORD_BITS) + STATISTICS * BINS
_UPPER, _DIGITS, _SYMBOLS, _STOPS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b".,;:!?"


@dataclass(frozen=True)
class Model:
    w0: float
    w: np.ndarray
    v: np.ndarray


def _statistics(text: bytes, counts: Counter, n_chars: int | None) -> list[int]:
    """Bin numbers of the structure statistics and metadata; each statistic has ``BINS`` bins of its own."""
    words, size = counts.total(), max(1, len(text))
    points = len(text) - np.count_nonzero(np.frombuffer(text, np.uint8) & 0xC0 == 0x80)  # code points, as n_chars counts
    lines = [x for x in text.split(b"\n") if x.strip()]
    log = lambda x: min(BINS - 1, int(np.log2(x + 1)))
    share = lambda x: min(BINS - 1, int(x * BINS))
    fine = lambda x: min(BINS - 1, int(x * BINS * 4))
    has = lambda which: size - len(text.translate(None, which)) if text else 0
    length = len(text) - sum((text.count(c) for c in (b" ", b"\n")), 0)
    stats = (
        log(words),
        min(BINS - 1, int(length / max(1, words))),
        share(has(_UPPER) / size),
        fine(has(_DIGITS) / size),
        share(has(_SYMBOLS) / max(1, words)),
        share(has(_STOPS) / max(1, words)),
        share(len(counts) / max(1, words)),
        share(counts.most_common(1)[0][1] / words) if words else 0,
        share(1 - len(set(lines)) / max(1, len(lines))),
        log(len(lines)),
        share(sum(n for w, n in counts.items() if n > 2) / max(1, words)),
        BINS - 1 if n_chars is None else log(abs(n_chars - points)),
    )
    return [(1 << WORD_BITS) + k * BINS + b for k, b in enumerate(stats)]


def features(text: bytes | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    counts = Counter(space_words(text))
    low: Counter = Counter()
    for w, n in counts.items():
        low[HASHES[w.lower()] >> (64 - WORD_BITS)] += n
    index = np.fromiter(low, np.int32, len(low))
    value = np.log1p(np.fromiter(low.values(), np.float32, len(low)))
    value /= max(1e-6, float(np.sqrt((value * value).sum())))
    extra = _statistics(text or b"", counts, n_chars)
    return np.concatenate([index, np.array(extra, np.int32)]), np.concatenate([value, np.full(STATISTICS, 0.5, np.float32)]).astype(np.float32)


def _forward(m: Model, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores before the sigmoid, and the factor sums, of documents that begin at ``starts``."""
    vx = m.v[index] * value[:, None]
    sums = np.add.reduceat(vx, starts, axis=0)
    squares = np.add.reduceat(vx * vx, starts, axis=0)
    return m.w0 + np.add.reduceat(m.w[index] * value, starts) + 0.5 * (sums * sums - squares).sum(1), sums


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def start(seed: int = 8) -> Model:
    return Model(0.0, np.zeros(WIDTH, np.float32), np.random.default_rng(seed).normal(0, 0.05, (WIDTH, RANK)).astype(np.float32))


def train_shard(model: Model, rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int) -> Model:
    """A few epochs of AdaGrad over one shard's rows, in an order fixed by the seed."""
    w0, w, v = model.w0, model.w.copy(), model.v.copy()
    g0, gw, gv = 1.0, np.ones(WIDTH, np.float32), np.ones((WIDTH, RANK), np.float32)
    order = np.random.default_rng(seed)
    for _ in range(max(EPOCHS[0], min(EPOCHS[1], ROWS_SEEN // max(1, len(rows))))):
        shuffled = order.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            batch = [rows[k] for k in shuffled[at : at + BATCH]]
            index, value = np.concatenate([r[0] for r in batch]), np.concatenate([r[1] for r in batch])
            sizes = np.array([len(r[0]) for r in batch])
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            score, sums = _forward(Model(w0, w, v), index, value, starts)
            error = np.repeat((_sigmoid(score) - np.array([r[2] for r in batch])) / len(batch), sizes).astype(np.float32)
            used, place = np.unique(index, return_inverse=True)
            d_w = np.bincount(place, error * value, len(used)).astype(np.float32) + DECAY * w[used]
            inner = (error * value)[:, None] * (np.repeat(sums, sizes, axis=0) - v[index] * value[:, None])
            d_v = np.stack([np.bincount(place, inner[:, f], len(used)) for f in range(RANK)], 1).astype(np.float32) + DECAY * v[used]
            d_0 = float((_sigmoid(score) - np.array([r[2] for r in batch])).mean())
            g0 += d_0 * d_0
            w0 -= RATE * d_0 / np.sqrt(g0)
            gw[used] += d_w * d_w * BATCH
            w[used] -= RATE * BATCH**0.5 * d_w / np.sqrt(gw[used])
            gv[used] += d_v * d_v * BATCH
            v[used] -= RATE * BATCH**0.5 * d_v / np.sqrt(gv[used])
    return Model(w0, w, v)


def _local(shared: Broadcast, step: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "y", "i"])
        data = [(np.frombuffer(i, np.int32), np.frombuffer(x, np.float32), int(y)) for i, x, y in zip(group["i"], group["x"], group["y"], strict=True)]
        m = train_shard(shared.value, data, 1000 * step + int(group["shard"].iloc[0]))
        return pd.DataFrame({"shard": group["shard"][:1], "n": [len(data)], "w0": [float(m.w0)], "w": [m.w.tobytes()], "v": [m.v.tobytes()]})

    return run


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS, rounds: int = ROUNDS) -> Model:
    """Fits on about ``max_rows`` labelled documents."""
    spark = docs.sparkSession
    marked = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"), F.max("quality").alias("most"))
    marked = marked.filter("y = most").select("doc_id", "y")
    total = marked.count()
    if total > max_rows:
        few = hash_fraction(F.col("doc_id"), max_rows / total, 8)
        marked, docs = marked.filter(few), docs.filter(few)
    size = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    # one text an id, so that labels bound the rows
    one = F.min_by(F.struct("text", size.alias("n_chars")), F.struct(F.xxhash64("text"), size)).alias("d")
    rows = docs.join(marked, "doc_id", "left_semi").groupBy("doc_id").agg(one).join(marked, "doc_id").select("doc_id", "d.text", "d.n_chars", "y")

    def make():
        def each(batch: pa.RecordBatch):
            found = [features(t, n) for t, n in zip(texts(batch), batch.column("n_chars").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.string()), batch.column("shard"), pa.array([i.tobytes() for i, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary()), batch.column("y")],
                ["doc_id", "shard", "i", "x", "y"],
            )

        return each

    shard = F.pmod(F.xxhash64(F.lit(88), "doc_id"), F.lit(max(1, min(SHARDS, total // SHARD_ROWS)))).cast("int")
    work = Workspace(spark, "quality-fm")
    ready = work.write(map_batches(rows.select("doc_id", "text", "n_chars", "y", shard.alias("shard")), make, "doc_id string, shard int, i binary, x binary, y int"), "features")
    model = start()
    for step in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        found = sorted(ready.groupBy("shard").applyInPandas(_local(shared, step), "shard int, n long, w0 double, w binary, v binary").collect())
        if not found:
            break
        share = np.array([r["n"] for r in found], np.float64) / sum(r["n"] for r in found)
        model = Model(
            float(sum(s * r["w0"] for s, r in zip(share, found, strict=True))),
            sum(s * np.frombuffer(r["w"], np.float32) for s, r in zip(share, found, strict=True)).astype(np.float32),
            sum(s * np.frombuffer(r["v"], np.float32).reshape(WIDTH, RANK) for s, r in zip(share, found, strict=True)).astype(np.float32),
        )
        shared.unpersist()
    else:
        return model
    return Model(0.0, np.zeros(WIDTH, np.float32), np.zeros((WIDTH, RANK), np.float32))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score, the probability of quality 1, of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    size = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")

    def make():
        def each(batch: pa.RecordBatch):
            for piece in slices(batch):
                found = [features(t, n) for t, n in zip(texts(piece), piece.column("n_chars").to_pylist(), strict=True)]
                starts = np.concatenate(([0], np.cumsum([len(i) for i, _ in found])[:-1]))
                out = _sigmoid(_forward(shared.value, np.concatenate([i for i, _ in found]), np.concatenate([v for _, v in found]), starts)[0])
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(out.astype(np.float64))], ["doc_id", "score"])

        return each

    source = docs.select("doc_id", "text", size.alias("n_chars"))
    return map_batches(source, make, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from labels of rows whose crc32(doc_id) mod 3 is not 1 and scores every document."""
    model = fit(docs, labels.filter(crc_mod(F.col("doc_id"), 3) != 1))
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
