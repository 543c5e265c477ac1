"""Token counts: count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates every vocabulary piece that occurs in a word; a dynamic program over the word's
characters carries the best score and the number of pieces, nothing else. Ties go as in public unigram tokenizers: a
later candidate replaces an earlier one only if its score is strictly higher, and candidates come by start, so the
longest piece that ends at a place wins. A character that no piece covers costs the lowest score less ``UNKNOWN_PENALTY``;
with byte fallback it counts one token a UTF-8 byte, else a run of such characters counts as one.

Text is normalised as such tokenizers do: blanks become U+2581 and one is put in front unless one is there. No piece reaches across the
start of a run of U+2581 (checked when a vocabulary is loaded), so a text's count is the sum over its words, and counts of
words that were seen before are taken from a bounded cache.

Edge cases: a null or empty text has no token. White space other than a blank is an ordinary character. Repeated rows
are counted each for itself. Only the id and text columns are read.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass
from functools import cached_property

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from trackengine.llm.common import CACHE_ENTRIES, map_batches

BLANK = "▁"
UNKNOWN_PENALTY = 10.0
DEFAULT_VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
_WORD = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")
_BYTE_PIECE = re.compile(r"<0x[0-9A-F]{2}>")


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with scores; ``byte_fallback`` tells that all 256 byte pieces exist."""

    pieces: tuple[tuple[str, float], ...]
    byte_fallback: bool

    def __post_init__(self):
        bad = [p for p, _ in self.pieces if BLANK in p.lstrip(BLANK)]
        if bad:
            raise ValueError(f"pieces reach across words: {bad[:3]}")

    @cached_property
    def unknown(self) -> float:
        return min(s for _, s in self.pieces) - UNKNOWN_PENALTY

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for piece, score in self.pieces:
            out.add_word(piece, (len(piece), score))
        out.make_automaton()
        return out

    @cached_property
    def counts(self) -> dict[str, tuple[int, int]]:
        return {}

    def __getstate__(self):
        return {"pieces": self.pieces, "byte_fallback": self.byte_fallback}

    def __setstate__(self, state):
        for k, v in state.items():
            object.__setattr__(self, k, v)

    @cached_property
    def singles(self) -> frozenset[str]:
        return frozenset(p for p, _ in self.pieces if len(p) == 1)

    def _word(self, word: str) -> tuple[int, int]:
        """Tokens of a word, and how many of its characters no piece covers."""
        if not self.singles.issuperset(word):
            return self._word_with_unknown(word)
        best, pieces = [-math.inf] * (len(word) + 1), [0] * (len(word) + 1)
        best[0] = 0.0
        for last, (length, score) in self.automaton.iter(word):  # by end, at one end the longest first
            start = last + 1 - length
            score += best[start]
            if score > best[last + 1]:
                best[last + 1], pieces[last + 1] = score, pieces[start] + 1
        return pieces[-1], 0

    def _word_with_unknown(self, word: str) -> tuple[int, int]:
        n = len(word)
        best, pieces, lost, open_ = [-math.inf] * (n + 1), [0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        best[0] = 0.0
        matches: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for last, match in self.automaton.iter(word):
            matches[last].append(match)
        for end in range(1, n + 1):
            for length, score in matches[end - 1]:
                start = end - length
                if best[start] + score > best[end]:
                    best[end], pieces[end], lost[end], open_[end] = best[start] + score, pieces[start] + 1, lost[start], False
            if word[end - 1] not in self.singles and best[end - 1] + self.unknown > best[end]:
                more = len(word[end - 1].encode()) if self.byte_fallback else 0 if open_[end - 1] else 1
                best[end], pieces[end], lost[end], open_[end] = best[end - 1] + self.unknown, pieces[end - 1] + more, lost[end - 1] + 1, True
        return pieces[n], lost[n]

    def count(self, text: str | None) -> tuple[int, int]:
        if not text:
            return 0, 0
        total = unknown = 0
        counts = self.counts
        text = text.replace(" ", BLANK)
        for word in _WORD.findall(text if text[0] == BLANK else BLANK + text):
            found = counts.get(word)
            if found is None:
                found = self._word(word)
                if len(word) <= 64:
                    if len(counts) >= CACHE_ENTRIES:
                        counts.clear()
                    counts[word] = found
            total += found[0]
            unknown += found[1]
        return total, unknown


def load(path: str = DEFAULT_VOCABULARY, rank_scores: bool = False) -> Vocabulary:
    """A unigram vocabulary from a ``tokenizers`` JSON file of that kind, or from a sentencepiece model.

    A sentencepiece unigram model has log-probabilities, which are taken as they are. A model of another kind has only an
    order of its pieces and is refused unless ``rank_scores`` asks for scores from it: piece r of that order then gets
    Zipf's log-probability, -ln(r + 2) - ln(ln(n)). Pieces that reach across words are refused. A model's own table of
    normalisations is not applied."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        if model.get("type") != "Unigram":
            raise ValueError("not a unigram vocabulary")
        pieces = [(p, s) for k, (p, s) in enumerate(model["vocab"]) if k != model.get("unk_id")]
        fallback = bool(model.get("byte_fallback"))
        return Vocabulary(tuple((p, s) for p, s in pieces if not (fallback and _BYTE_PIECE.fullmatch(p))), fallback)
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [k for k in range(model.vocab_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))]
    pieces = [(model.id_to_piece(k), model.get_score(k)) for k in ids]
    if rank_scores:
        total = math.log(math.log(len(pieces)))
        pieces = [(p, -math.log(r + 2) - total) for r, (p, _) in enumerate(sorted(pieces, key=lambda x: -x[1]))]
    elif all(score == int(score) for _, score in pieces):
        raise ValueError("the model has an order of its pieces, not log-probabilities")
    return Vocabulary(tuple(pieces), any(model.is_byte(k) for k in range(model.vocab_size())))


def count_tokens(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, n_unknown (characters outside the vocabulary) and n_chars of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        count = shared.value.count

        def each(batch: pa.RecordBatch):
            rows = batch.column(1).to_pylist()
            found = [count(t) for t in rows]
            out = [[n for n, _ in found], [u for _, u in found], [len(t) if t else 0 for t in rows]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in out)], [key, "n_tokens", "n_unknown", "n_chars"])

        return each

    source = docs.select(key, text)
    return map_batches(source, make, f"`{key}` {source.schema[key].dataType.simpleString()}, n_tokens long, n_unknown long, n_chars long")
