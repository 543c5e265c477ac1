"""Language identification: multinomial naive Bayes over hashed character n-grams.

``fit`` counts hashed 1- to 3-grams of letters by language as a Spark aggregation and returns a small model: a matrix
of log-probabilities of fixed size (buckets x languages). ``predict`` broadcasts it and scores batches in numpy.

Edge cases: a null, empty or letterless text gets ``und`` and score 0. Rows whose language or text is null teach
nothing. Without any training row every text is ``und`` with score 0. Repeated rows are scored each for itself, and on
equal scores the language that sorts first wins. Other columns are ignored by the scorer. A long text is counted piece by
piece, so memory holds the text and one piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackengine.llm.common import crc_mod, filter_batches, hash_fraction, map_batches, slices

BUCKET_BITS = 14
ORDERS = (1, 2, 3)
#: Bound of the labelled rows that the model is fitted on: about so many, picked by a hash of doc_id.
MAX_TRAIN_ROWS = 50_000
#: Tasks that count n-grams of training rows.
COUNT_TASKS = 32
#: Characters of a text that are hashed at a time, and from which on a text is scored by its counts.
PIECE, LONG = 1 << 18, 1 << 14
_BLOCK = 1024
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_letters: np.ndarray | None = None


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    log_prob: np.ndarray  # buckets x languages, float32
    prior: np.ndarray


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def _codes(text: str, after_letter: bool = False) -> np.ndarray:
    """Lower-cased letters as code points, each run of other characters as one blank, none in front unless a letter stood there."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letter_table()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    if after_letter and len(keep):
        keep[0] = True
    return np.where(letter, points, np.uint32(32))[keep]


def _hashes(codes: np.ndarray, old: int = 0) -> np.ndarray:
    """Bucket numbers of all n-grams that don't end within the first ``old`` codes."""
    shift, parts = np.uint32(32 - BUCKET_BITS), []
    for order in ORDERS:
        part = codes[max(0, old - order + 1) :]
        if len(part) >= order:
            h = np.full(len(part) - order + 1, order * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
            for k in range(order):
                h = (h ^ part[k : k + len(h)]) * _FACTORS[k]
                h ^= h >> np.uint32(15)
            parts.append((h * np.uint32(0x165667B1)) >> shift)
    return np.concatenate(parts) if parts else np.empty(0, np.uint32)


def _pieces(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of a text's n-grams, some ``PIECE`` characters at a time."""
    last, after_letter = np.empty(0, np.uint32), False
    for at in range(0, len(text), PIECE):
        piece = text[at : at + PIECE]
        new = _codes(piece, after_letter)
        after_letter = piece[-1].lower()[-1].isalpha()
        codes = np.concatenate([last, new]) if len(last) else new
        yield _hashes(codes, len(last))
        last = codes[-(ORDERS[-1] - 1) :]


def bucket_counts(text: str) -> np.ndarray:
    """How often each bucket's n-grams occur in a text; memory doesn't grow with the text."""
    out = np.zeros(1 << BUCKET_BITS, np.int64)
    for hashes in _pieces(text):
        out += np.bincount(hashes, minlength=len(out))
    return out


def fit(docs: DataFrame, max_rows: int = MAX_TRAIN_ROWS, smoothing: float = 0.5) -> Model:
    """Fits on rows with text and lang, on about ``max_rows`` of them if there are more. Only counts reach the driver."""
    rows = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    total = rows.count()
    if total > max_rows:
        rows = rows.filter(hash_fraction(F.col("doc_id"), max_rows / total, 7))

    def counted(batches):
        sums: dict[str, np.ndarray] = {}
        docs_of: dict[str, int] = {}
        for batch in batches:
            for piece in slices(batch):
                for lang, text in zip(piece.column("lang").to_pylist(), piece.column("text").to_pylist(), strict=True):
                    counts = bucket_counts(text)
                    if counts.any():
                        sums[lang] = sums.get(lang, 0) + counts
                        docs_of[lang] = docs_of.get(lang, 0) + 1
        for lang, s in sums.items():
            cut = s.reshape(-1, _BLOCK)
            yield pa.RecordBatch.from_pydict(
                {"lang": [lang] * len(cut), "block": list(range(len(cut))), "counts": [c.tobytes() for c in cut], "docs": [docs_of[lang]] * len(cut)},
                schema=pa.schema([("lang", pa.string()), ("block", pa.int32()), ("counts", pa.binary()), ("docs", pa.int64())]),
            )

    def added(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, np.int64) for c in group["counts"])
        return pd.DataFrame({"lang": group["lang"][:1], "block": group["block"][:1], "counts": [total.tobytes()], "docs": [group["docs"].sum()]})

    schema = "lang string, block int, counts binary, docs long"
    # a fixed number of tasks counts, so that only so many partial counts of a language and block meet
    rows = rows.select("lang", "text").repartition(COUNT_TASKS, F.xxhash64("doc_id", "text"))
    found = rows.mapInArrow(counted, schema).groupBy("lang", "block").applyInPandas(added, schema).collect()
    languages = tuple(sorted({r["lang"] for r in found}))
    counts, docs_of = np.zeros((1 << BUCKET_BITS, len(languages))), np.ones(len(languages))
    for r in found:
        k = languages.index(r["lang"])
        counts[r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK, k] = np.frombuffer(r["counts"], np.int64)
        docs_of[k] = r["docs"]
    smoothed = counts + smoothing
    return Model(languages, np.log(smoothed / smoothed.sum(0)).astype(np.float32) if languages else counts.astype(np.float32), np.log(docs_of / docs_of.sum()))


def _logs(text: str, model: Model) -> np.ndarray | None:
    """Log-probability of the text for each language; None without a letter."""
    if len(text) > LONG:
        counts = bucket_counts(text)
        return counts @ model.log_prob.astype(np.float64) if counts.any() else None
    hashes = _hashes(_codes(text))
    return model.log_prob[hashes].sum(0, dtype=np.float64) if len(hashes) else None


def _score(texts: list[str | None], model: Model) -> tuple[list[str], list[float]]:
    lang, score = ["und"] * len(texts), [0.0] * len(texts)
    for i, text in enumerate(texts):
        logs = _logs(text, model) if text and model.languages else None
        if logs is not None:
            logs += model.prior
            best = int(logs.argmax())
            lang[i], score[i] = model.languages[best], float(1 / np.exp(logs - logs[best]).sum())
    return lang, score


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, ``lang_pred`` and ``score`` (posterior of the prediction); reads text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def each(batch: pa.RecordBatch):
            for piece in slices(batch):
                lang, score = _score(piece.column("text").to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

        return each

    source = docs.select("doc_id", "text")
    return map_batches(source, make, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 5) -> DataFrame:
    """Learns from the rows whose crc32(doc_id) mod ``folds`` is not 0 and predicts every row."""
    model = fit(docs.filter(crc_mod(F.col("doc_id"), folds) != 0))
    out = predict(docs, model)
    return out.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), folds) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """The documents with a known language and a score of at least ``min_score``; their columns stay as they are.

    The model learns from every row with a lang; where no row has one, nothing can be learned and every document with
    a letter stays."""
    model = fit(docs)
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def keep(batch: pa.RecordBatch) -> list[bool]:
            lang, score = _score(batch.column("text").to_pylist(), shared.value)
            return [x != "und" and s >= min_score for x, s in zip(lang, score, strict=True)]

        return keep

    return filter_batches(docs, make)
