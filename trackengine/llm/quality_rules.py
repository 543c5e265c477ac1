"""Quality rules as a learned decision list, in DataFrame functions only.

``features`` turns a text into statistics. ``learn`` runs sequential covering over labelled statistics: a rule is a
conjunction of thresholds on them; it is grown condition by condition by information gain on two thirds of the labelled
rows, pruned from its end by its precision on the other third, and kept if it is precise enough; the rows that it
covers are then set aside and the next rule is learned from the rest. Each step is one Spark aggregation over the
labelled statistics, and only its candidates' counts reach the driver. The list is emitted as an ordered ``CASE``: the
first rule that holds decides, and a document that no rule covers is kept.

Edge cases: a null text has no words and all statistics 0, and so fails the base rule. Without labels of both kinds no
rule is learned and the base rule decides alone. Thresholds are quantiles and middles between them; ties go to the
earlier statistic and its middle threshold, so that reruns agree. Repeated label rows count each. Labels without a document teach nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackengine.llm.common import Workspace, hash_fraction

SPACES = r"[\x20\x09-\x0D]+"
#: Bound of the labelled rows that rules are learned from: about so many, picked by a hash of doc_id.
MAX_TRAIN_ROWS = 20_000
MAX_RULES, MAX_CONDITIONS, THRESHOLDS = 8, 3, 16
LEAST_PRECISION, LEAST_COVER = 0.9, 5
#: Statistics that conditions may use: ratios to words or characters and a few sizes.
STATISTICS = ("n_words", "word_length", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "distinct_ratio", "lines_ratio", "punctuation_ratio", "digit_ratio")


def _let(value: Column, body) -> Column:
    """Evaluates ``value`` once and hands it to ``body``, which may use it inside other lambdas."""
    return F.transform(F.array(value), body)[0]


def _chars(text: Column, which: str) -> Column:
    """Characters of a class in a text."""
    return F.regexp_count(text, F.lit(f"[{which}]")).cast("long")


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more.

    64-bit hashes of the windows are sorted first; a text without two equal ones has none. Else windows are sorted as a
    whole with their place, so that equal ones are neighbours; the places of those that repeat are sorted again, and each
    covers three words or as many as there are to the next."""
    n = F.size(words) - 2
    hashes = F.sort_array(F.transform(F.sequence(F.lit(1), n), lambda k: F.xxhash64(F.get(words, k - 1), F.get(words, k), F.get(words, k + 1))))
    some = _let(hashes, lambda h: F.exists(F.zip_with(h, F.slice(h, 2, F.size(h)), lambda x, y: x == y), lambda same: F.coalesce(same, F.lit(False))))
    windows = F.sort_array(F.arrays_zip(F.slice(words, 1, n), F.slice(words, 2, n), F.slice(words, 3, n), F.sequence(F.lit(0), n - 1)))
    same = lambda x, y: (x["2"] == y["2"]) & (x["1"] == y["1"]) & (x["0"] == y["0"])
    places = lambda s: F.sort_array(
        F.array_distinct(F.flatten(F.array_compact(F.zip_with(s, F.slice(s, 2, F.size(s)), lambda x, y: F.when(same(x, y), F.array(x["3"], y["3"]))))))
    )
    covered = F.aggregate(
        _let(windows, places),
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda done, k: F.struct((done["n"] + F.least(F.lit(3), k - done["last"])).alias("n"), k.alias("last")),
        lambda done: done["n"],
    )
    return F.when(F.size(words) < 3, 0).when(~some, 0).otherwise(covered).cast("long")


def base_statistics(docs: DataFrame) -> DataFrame:
    """The given columns and the statistics of ``text``, all long; the words' array lives inside one projection only."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(" \t\x0b\f\r")) != "")
    counted = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct")))
    line_counts = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return docs.withColumn("_w", counted).withColumn("_l", line_counts).withColumns(
        {
            "n_words": F.col("_w.n_words"),
            "word_chars": F.length(text) - _chars(text, r"\x20\x09-\x0D"),
            "n_symbols": _chars(text, r"#*$%&|<>"),
            "n_dup_lines": F.col("_l.n_dup_lines"),
            "n_repeat_words": F.col("_w.n_repeat_words"),
            "n_distinct": F.col("_w.n_distinct"),
            "n_lines": F.col("_l.n_lines"),
            "n_upper": _chars(text, r"A-Z"),
            "n_punctuation": _chars(text, r".,;:!?"),
            "n_digits": _chars(text, r"0-9"),
        }
    ).drop("_w", "_l")


def ratios() -> dict[str, Column]:
    """``STATISTICS`` from the counts of ``base_statistics``."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"),
        "word_length": F.col("word_chars") / words,
        "symbol_ratio": F.col("n_symbols") / words,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_ratio": F.col("n_repeat_words") / words,
        "upper_ratio": F.col("n_upper") / chars,
        "distinct_ratio": F.col("n_distinct") / words,
        "lines_ratio": F.col("n_lines") / words,
        "punctuation_ratio": F.col("n_punctuation") / words,
        "digit_ratio": F.col("n_digits") / chars,
    }


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: float

    def column(self, of: dict[str, Column] | None = None) -> Column:
        value = (of or {}).get(self.statistic, F.col(self.statistic))
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)


Rule = tuple[Condition, ...]


def _all(rule: Rule, of: dict[str, Column] | None = None) -> Column:
    out = F.lit(True)
    for c in rule:
        out &= c.column(of)
    return out


def _gain(bad: int, good: int, bad0: int, good0: int) -> float:
    """FOIL's information gain of a condition that leaves bad and good rows of bad0 and good0."""
    return bad * (math.log2(bad / (bad + good)) - math.log2(bad0 / (bad0 + good0))) if bad else -math.inf


def _counts(rows: DataFrame, where: list[Column]) -> list[tuple[int, int]]:
    """Bad and good rows for each predicate, in one aggregation."""
    picked = [F.count_if(w & (F.col("y") == k)) for w in where for k in (0, 1)]
    got = rows.agg(*(c.alias(f"c{k}") for k, c in enumerate(picked))).first()
    return [(got[2 * k], got[2 * k + 1]) for k in range(len(where))]


def _bin(value: Column, thresholds: list[float]) -> Column:
    """How many thresholds lie below the value."""
    return F.size(F.filter(F.lit(thresholds), lambda t: t < value))


def _candidate_counts(rows: DataFrame, spots: dict[str, list[float]]) -> dict[Condition, tuple[int, int]]:
    """Bad and good rows of every candidate condition, from one histogram of the statistics' bins."""
    bins = [F.struct(F.lit(s).alias("s"), _bin(F.col(s), t).alias("b")) for s, t in spots.items() if t]
    counts = {s: [[0, 0] for _ in range(len(t) + 1)] for s, t in spots.items()}
    if bins:
        of_bins = rows.select("y", F.explode(F.array(*bins)).alias("at")).groupBy("at.s", "at.b")
        for r in of_bins.agg(F.count_if(F.col("y") == 0).alias("bad"), F.count_if(F.col("y") == 1).alias("good")).collect():
            counts[r["s"]][r["b"]] = [r["bad"], r["good"]]
    out = {}
    for s, t in spots.items():
        for k, threshold in enumerate(t):
            for above in (False, True):
                part = counts[s][k + 1 :] if above else counts[s][: k + 1]
                out[Condition(s, above, threshold)] = (sum(n for n, _ in part), sum(n for _, n in part))
    return out


def _thresholds(labelled: DataFrame) -> dict[str, list[float]]:
    """Quantiles of each statistic over all, bad and good rows, and the middles between neighbours of them."""
    at = [k / THRESHOLDS for k in range(THRESHOLDS + 1)]
    rows = {"all": F.lit(True), "bad": F.col("y") == 0, "good": F.col("y") == 1}
    found = labelled.agg(*(F.percentile(F.when(w, F.col(s)), at).alias(f"{s}_{n}") for s in STATISTICS for n, w in rows.items())).first()
    out = {}
    for s in STATISTICS:
        values = sorted({v for n in rows for v in found[f"{s}_{n}"] or []})
        out[s] = sorted({*values, *((a + b) / 2 for a, b in zip(values, values[1:], strict=False))})
    return out


def _middle_best(gains: dict[Condition, float]) -> Condition | None:
    """The condition of highest gain; of equal ones on one statistic the middle threshold, which lies between the kinds."""
    best = max(gains, key=lambda c: gains[c], default=None)
    if best is None:
        return None
    alike = [c for c in gains if gains[c] == gains[best] and (c.statistic, c.above) == (best.statistic, best.above)]
    return sorted(alike, key=lambda c: c.threshold)[len(alike) // 2]


def learn(labelled: DataFrame) -> list[Rule]:
    """Rules for bad rows from ``STATISTICS`` columns, ``y`` (1 good, 0 bad) and ``fold`` (0: prune, else grow).

    A grown rule that isn't precise enough is no rule, but what it covers is set aside too, so that the next one starts
    from other rows; ``MAX_RULES`` are tried."""
    spots = _thresholds(labelled)
    tried: list[Rule] = []
    rules: list[Rule] = []
    while len(tried) < MAX_RULES:
        rest, open_ = F.lit(True), F.lit(True)
        for r in rules:
            rest &= ~_all(r)
        for r in tried:
            open_ &= ~_all(r)
        growing = labelled.filter(open_ & (F.col("fold") != 0))
        ((bad, good),) = _counts(growing, [F.lit(True)])
        rule: Rule = ()
        while bad >= LEAST_COVER and good and len(rule) < MAX_CONDITIONS:
            counts = _candidate_counts(growing.filter(_all(rule)), spots)
            gains = {c: _gain(*n, bad, good) for c, n in counts.items() if n[0] >= LEAST_COVER}
            best = _middle_best(gains)
            if best is None or gains[best] <= 0:
                break
            rule, (bad, good) = (*rule, best), counts[best]
        if not rule:
            break
        cuts = [rule[:k] for k in range(len(rule), 0, -1)]
        pruned = _counts(labelled.filter(rest), [w & _all(c) for c in cuts for w in (F.col("fold") == 0, F.lit(True))])
        worth = [(b - g) / (b + g) if b + g else -1.0 for b, g in pruned[::2]]
        best_cut = max(range(len(cuts)), key=lambda k: (worth[k], k))
        bad, good = pruned[2 * best_cut + 1]
        if bad >= LEAST_COVER and bad >= LEAST_PRECISION * (bad + good):
            rules.append(cuts[best_cut])
            tried.append(cuts[best_cut])
        else:
            tried.append(rule)
    return rules


def verdict(rules: list[Rule], of: dict[str, Column]) -> Column:
    """The ordered list as one conditional expression: true keeps the document."""
    out = None
    for rule in rules:
        out = F.when(_all(rule, of), False) if out is None else out.when(_all(rule, of), False)
    return F.lit(True) if out is None else out.otherwise(True)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def labelled_statistics(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """Statistics, ``y`` and ``fold`` of about ``max_rows`` labelled documents that pass the base rule, written down once.

    Statistics are taken before the join, so that numbers are shuffled and not texts."""
    marked = labels.filter(F.col("quality").isin(0, 1)).select(F.col("doc_id"), F.col("quality").alias("y"))
    total = marked.count()
    docs = docs.select("doc_id", "text")
    if total > max_rows:
        few = hash_fraction(F.col("doc_id"), max_rows / total, 5)
        marked, docs = marked.filter(few), docs.filter(few)
    rows = base_statistics(docs).drop("text").join(marked, "doc_id").withColumn("base_failed", base_failed())
    fold = F.pmod(F.xxhash64(F.lit(55), "doc_id"), F.lit(3)).alias("fold")
    return Workspace(docs.sparkSession, "quality-rules").write(rows.select("y", fold, "base_failed", *(c.alias(n) for n, c in ratios().items())), "labelled").filter(~F.col("base_failed"))


def apply_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base statistics, base_failed and kept, by rules learned from ``labels``."""
    rules = learn(labelled_statistics(docs, labels))
    out = base_statistics(docs.select("doc_id", "text")).withColumn("base_failed", base_failed())
    kept = ~F.col("base_failed") & verdict(rules, ratios())
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))
