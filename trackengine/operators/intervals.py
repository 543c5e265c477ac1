"""Overlaps of intervals by a sweep: pairs come out one by one as the later start of the two is passed.

Intervals are dealt to ranges of their start; the bounds of ranges are quantiles of the starts, so ranges hold as much. An
interval that is still open where its range ends is carried into each further range that it reaches, and only there. A
task sorts its range by start and goes through it in blocks: a new interval meets the open ones of the other side, which
are a run of them in order of their ends, and new ones, a run in order of their starts. So what is formed is what
overlaps, and a task holds a block and the open intervals.

This is Arrow and numpy inside tasks: native joins would test all pairs of a range, or copy intervals into short buckets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pairs that a task forms at a time.
BLOCK = 500_000


def range_bounds(starts: DataFrame, column: str, ranges: int) -> list[float]:
    """At most ``ranges - 1`` bounds between ranges of about as many starts."""
    if ranges < 2:
        return []
    found = starts.agg(F.percentile_approx(column, [k / ranges for k in range(1, ranges)], 100 * ranges)).first()[0]
    return sorted({float(x) for x in found or []})


def _range_of(value: Column, bounds: list[float]) -> Column:
    return F.size(F.filter(F.array(*(F.lit(b) for b in bounds)), lambda b: b <= value)) if bounds else F.lit(0)


def dealt(intervals: DataFrame, start: str, end: str, bounds: list[float]) -> DataFrame:
    """``intervals`` with ``_range``, once for the range of the start and once, ``_carried``, for each further one that is reached.
    Intervals without a start or an end, and those that end before they start, are left out."""
    ok = intervals.filter(F.col(start) <= F.col(end))
    first = _range_of(F.col(start), bounds)
    out = ok.withColumn("_first", first).withColumn("_range", F.explode(F.sequence("_first", _range_of(F.col(end), bounds))))
    return out.withColumn("_carried", F.col("_range") > F.col("_first")).drop("_first")


class _Side:
    """New intervals of a block and open ones before it: starts, ends, and rows of numbers."""

    def __init__(self, width: int):
        self.open = np.empty((0, width))

    def take(self, block: np.ndarray, since: float) -> None:
        """``block`` becomes open; what ended before ``since`` is let go."""
        both = np.concatenate((self.open, block))
        self.open = both[both[:, 1] >= since]


def _runs(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) for each i and j from low[i] up to high[i], in pieces."""
    n = np.maximum(0, high - low)
    formed = np.concatenate(([0], np.cumsum(n)))
    k = 0
    while k < len(n):
        to = max(k + 1, int(np.searchsorted(formed, formed[k] + BLOCK, "right")) - 1)
        for begin in range(0, int(n[k]) if to == k + 1 else 1, BLOCK):  # one interval may overlap more than a block
            some = n[k:to] if to > k + 1 else np.array([min(BLOCK, n[k] - begin)])
            i = np.repeat(np.arange(k, to), some)
            j = np.arange(len(i)) - np.repeat(np.cumsum(some) - some, some) + np.repeat(low[k:to], some) + begin
            if len(i):
                yield i, j
        k = to


def _pairs(new: np.ndarray, others_new: np.ndarray, others_open: np.ndarray, strict: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of ``new`` with rows of the other side that started before and are open: at its start too, unless ``strict``."""
    by_end = others_open[np.argsort(others_open[:, 1], kind="stable")]
    for i, j in _runs(np.searchsorted(by_end[:, 1], new[:, 0], "left"), np.full(len(new), len(by_end))):
        yield new[i], by_end[j]
    # new ones of the other side, in order of start: those from their start to their end hold a run of ``new``
    low = np.searchsorted(new[:, 0], others_new[:, 0], "right" if strict else "left")
    high = np.searchsorted(new[:, 0], others_new[:, 1], "right")
    for i, j in _runs(low, high):
        yield new[j], others_new[i]


def overlaps(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], carry: tuple[list[str], list[str]], near: list[tuple[str, str, str, str, float]] = (), ranges: int | None = None) -> DataFrame:
    """Pairs of a left and a right interval that have a moment in common, ends included: the columns that ``carry`` names of
    the left and the right side, whose names must differ.

    ``near`` are further conditions on boxes, tested before pairs leave the task: (left low, left high, right low, right
    high, reach) keeps pairs whose boxes are at most ``reach`` apart. A pair with a null there is dropped. Spans and boxes
    are numbers. Runs a job to find the bounds of ``ranges`` (the shuffle partitions unless given)."""
    spark = left.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    starts = left.select(F.col(left_span[0]).cast("double").alias("s")).unionByName(right.select(F.col(right_span[0]).cast("double").alias("s")))
    bounds = range_bounds(starts, "s", ranges)
    double = lambda c, name: F.col(c).cast("double").alias(name)

    def side(df: DataFrame, span: tuple[str, str], box: list[tuple[str, str]], columns: list[str], is_left: bool) -> DataFrame:
        numbers = [double(span[0], "s"), double(span[1], "e"), *(double(c, f"b{k}_{n}") for k, b in enumerate(box) for n, c in zip(("low", "high"), b, strict=True))]
        own = F.struct(*(F.col(c) for c in columns)).alias("_l" if is_left else "_r")
        return dealt(df.select(*numbers, own), "s", "e", bounds).withColumn("_left", F.lit(is_left))

    boxes = [f"b{k}_{n}" for k in range(len(near)) for n in ("low", "high")]
    both = side(left, left_span, [n[:2] for n in near], carry[0], True).unionByName(side(right, right_span, [n[2:4] for n in near], carry[1], False), allowMissingColumns=True)
    placed = both.repartition(ranges, "_range").sortWithinPartitions("_range", ~F.col("_carried"), "s")
    reach = [n[4] for n in near]
    out_type = placed.select("_l.*", "_r.*").schema

    def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, kept, now, held = None, None, None, 0
        for batch in batches:
            flags = batch.column("_range").to_numpy()
            cuts = np.flatnonzero(np.append(True, flags[1:] != flags[:-1]))
            for begin, end in zip(cuts, np.append(cuts[1:], len(flags)), strict=True):
                piece = batch.slice(begin, end - begin)
                if now != flags[begin]:
                    sides, kept, now, held = (_Side(3 + len(boxes)), _Side(3 + len(boxes))), ([], []), flags[begin], 0
                is_left, carried = (piece.column(c).to_numpy(zero_copy_only=False) for c in ("_left", "_carried"))
                rows = np.column_stack([piece.column(c).to_numpy(zero_copy_only=False) for c in ("s", "e")] + [held + np.arange(piece.num_rows, dtype=float)] + [piece.column(c).to_numpy(zero_copy_only=False) for c in boxes])
                held += piece.num_rows
                for k, own in enumerate(("_l", "_r")):
                    kept[k].append((int(rows[0, 2]), piece.column(own)))
                new = [rows[(is_left == wanted) & ~carried] for wanted in (True, False)]
                for k in (0, 1):  # carried ones are open from the beginning
                    sides[k].open = np.concatenate((sides[k].open, rows[(is_left == (k == 0)) & carried]))
                for k in (0, 1):
                    for a, b in _pairs(new[k], new[1 - k], sides[1 - k].open, strict=k == 0):
                        x, y = (a, b) if k == 0 else (b, a)
                        good = np.ones(len(x), bool)
                        for n, r in enumerate(reach):
                            low, high = 3 + 2 * n, 4 + 2 * n
                            good &= (y[:, low] - x[:, high] <= r) & (x[:, low] - y[:, high] <= r)
                        if good.any():
                            columns = [c for q, z in enumerate((x, y)) for c in _taken(kept[q], z[good, 2].astype(np.int64)).flatten()]
                            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([(f.name, c.type) for f, c in zip(out_type, columns, strict=True)]))
                if len(rows):
                    for k in (0, 1):
                        sides[k].take(new[k], rows[-1, 0] if not carried[-1] else -np.inf)
                        kept[k][:] = _needed(kept[k], sides[k].open[:, 2].astype(np.int64))

    return placed.select("_range", "_carried", "_left", "s", "e", *boxes, "_l", "_r").mapInArrow(swept, out_type)


def _taken(kept: list[tuple[int, pa.StructArray]], places: np.ndarray) -> pa.StructArray:
    """The rows of the given places; ``kept`` has pieces and the place of each one's first row, or an array of places."""
    offsets = np.concatenate([p if isinstance(p, np.ndarray) else p + np.arange(len(c)) for p, c in kept])
    whole = pa.concat_arrays([c for _, c in kept])
    return whole.take(pa.array(np.searchsorted(offsets, places)))


def _needed(kept: list[tuple[int, pa.StructArray]], places: np.ndarray) -> list[tuple[np.ndarray, pa.StructArray]]:
    """Only the rows that are still open."""
    places = np.sort(places)
    return [(places, _taken(kept, places))]
