"""As-of merges, interval sweeps and the catalogue's layout against plain Python, and their plans."""

import random

import pytest
from pyspark.sql import functions as F

from trackengine.operators import asof, intervals, kinematics
from trackengine.sources import layout


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def nearest(rows, points, tolerance, later):
    out = []
    for key, t, name in rows:
        if key is None or t is None:
            continue
        found = [p for p in points if p[0] == key and p[1] is not None]
        if found:
            best = min(found, key=lambda p: (abs(p[1] - t), -p[1] if later else p[1], p[2]))
            if tolerance is None or abs(best[1] - t) <= tolerance:
                out.append((key, t, name, best[1], best[2], abs(best[1] - t)))
    return sorted(map(str, out))


@pytest.mark.parametrize(("tolerance", "later", "width"), [(3.0, False, 240.0), (3.0, True, 5.0), (720.0, False, 7.0), (None, True, 1.0), (0.0, False, 1000.0)])
def test_nearest_in_time(spark, tolerance, later, width):
    draw = random.Random(int(width))
    rows = [(draw.choice([1, 2, 3, None]), draw.choice([None, *(float(x) for x in range(-60, 60))]), f"r{k}") for k in range(300)]
    points = [(draw.choice([1, 2, 4, None]), draw.choice([None, *(x / 2 for x in range(-100, 60, 3))]), draw.randint(0, 3)) for k in range(90)]
    left = spark.createDataFrame(rows, "k int, t double, name string").repartition(3)
    right = spark.createDataFrame(points, "k int, p double, v int").repartition(3)
    out = asof.nearest_in_time(left, right, ["k"], "t", "p", ["v"], tolerance, later, width)
    assert out.columns == ["k", "t", "name", "p", "v", "away"]
    assert sorted(str(tuple(r)) for r in out.collect()) == nearest(rows, points, tolerance, later)
    assert asof.nearest_in_time(left, right.limit(0), ["k"], "t", "p", ["v"]).collect() == []


def test_merge_copies_no_row(spark):
    """The tolerance changes one filter, and nothing multiplies rows: no Generate, no join of points with rows."""
    left = spark.range(1000).selectExpr("id % 3 as k", "cast(id as double) as t")
    right = spark.range(2000).selectExpr("id % 3 as k", "cast(id as double) as p", "id as v")
    plans = [plan_of(asof.nearest_in_time(left, right, ["k"], "t", "p", ["v"], tolerance)) for tolerance in (3.0, 720.0)]
    for plan in plans:
        assert "Generate" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    assert len({"".join(c for c in p if not c.isdigit()).count("Exchange") for p in plans}) == 1
    merged = asof.nearest_in_time(left, right, ["k"], "t", "p", ["v"], 720.0)
    assert merged.count() == 1000


def overlapping(left, right, reach):
    out = []
    for a in left:
        for b in right:
            if None in a[1:3] or None in b[1:3] or a[1] > a[2] or b[1] > b[2] or a[2] < b[1] or b[2] < a[1]:
                continue
            if reach is not None and (None in a[3:] or None in b[3:] or b[3] - a[4] > reach or a[3] - b[4] > reach):
                continue
            out.append((a[0], a[1], b[0]))
    return sorted(map(str, out))


@pytest.mark.parametrize(("ranges", "reach", "rows"), [(1, None, 10_000), (5, 4.0, 10_000), (16, None, 7), (40, 0.0, 1)])
def test_overlaps(spark, ranges, reach, rows):
    draw = random.Random(ranges)

    def some(n, first):
        out = []
        for k in range(n):
            start = draw.choice([None, *(float(x) for x in range(100))])
            length = draw.choice([-1.0, 0.0, 1.0, 2.0, 5.0, 90.0])  # some end before they start, some are open all the time
            low = draw.choice([None, 0.0, 10.0, 20.0])
            out.append((first + k, start, None if start is None or draw.random() < 0.05 else start + length, low, None if low is None else low + 5))
        return out

    left, right = some(150, 0), some(120, 1000)
    frames = [spark.createDataFrame(x, f"{n}_id long, {n}_s double, {n}_e double, {n}_low double, {n}_high double").repartition(3) for n, x in (("a", left), ("b", right))]
    near = [("a_low", "a_high", "b_low", "b_high", reach)] if reach is not None else []
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        out = intervals.overlaps(*frames, ("a_s", "a_e"), ("b_s", "b_e"), (["a_id", "a_s"], ["b_id"]), near, ranges)
        assert out.columns == ["a_id", "a_s", "b_id"]
        assert sorted(str(tuple(r)) for r in out.collect()) == overlapping(left, right, reach)
    finally:
        spark.conf.set(name, before)
    assert intervals.overlaps(frames[0].limit(0), frames[1], ("a_s", "a_e"), ("b_s", "b_e"), (["a_id"], ["b_id"]), near, ranges).collect() == []


def test_long_intervals_are_carried_only_where_they_are_open(spark):
    rows = [(k, float(k), k + 2.5) for k in range(400)] + [(1000 + k, float(k), 399.0) for k in range(0, 40, 10)]
    frame = spark.createDataFrame(rows, "id long, s double, e double")
    bounds = intervals.range_bounds(frame, "s", 8)
    assert len(bounds) == 7
    dealt = intervals.dealt(frame, "s", "e", bounds)
    spans = sum(sum(b <= e for b in bounds) - sum(b <= s for b in bounds) + 1 for _, s, e in rows)
    assert dealt.count() == spans <= len(rows) + 7 * (4 + 3)  # four long ones, and those across an edge
    assert dealt.filter(~F.col("_carried")).count() == len(rows)


def test_one_interval_meets_more_than_a_block(monkeypatch):
    import numpy as np

    monkeypatch.setattr(intervals, "BLOCK", 10)
    pairs = [(int(i), int(j)) for a, b in intervals._runs(np.array([0, 5, 7, 3]), np.array([47, 5, 9, 6])) for i, j in zip(a, b, strict=True)]
    assert pairs == [(0, j) for j in range(47)] + [(2, 7), (2, 8), (3, 3), (3, 4), (3, 5)]


# --- layout
ORDER = ("continuity_parent_track_id", "time", "track_id")


@pytest.fixture(scope="module")
def points(spark, tmp_path_factory):
    """Tracks that begin in 2020 to 2023, some over New Year."""
    rows = spark.range(2400).selectExpr("id % 60 as continuity_parent_track_id", "id % 60 * 10 + cast(id > 1200 as int) as track_id", "make_timestamp_ntz(cast(2020 + id % 4 as int), 12, 31, 0, 0, 0) + make_dt_interval(0, cast(floor(id / 60) as int)) as time", "cast(id % 11 as double) as lat", "cast(id % 13 as double) as lon")
    path = f"file://{tmp_path_factory.mktemp('layout')}/c"
    layout.write_layout(rows, path, buckets=3)
    with layout.sorted_scans(spark):
        yield rows, layout.open_layout(spark, path), path


def test_layout_keeps_rows_and_years(spark, points):
    rows, read, _ = points
    assert sorted(map(str, read.select(rows.columns).collect())) == sorted(map(str, rows.collect()))
    assert {r["start_year"] for r in read.select("start_year").distinct().collect()} == {2020, 2021, 2022, 2023}
    assert read.filter(F.year("time") != F.col("start_year")).count() > 0
    with pytest.raises(Exception, match="without parent"):
        layout.write_layout(rows.withColumn("time", F.when(F.col("track_id") != 0, F.col("time"))), f"{points[2]}-2")


def test_windows_stand_on_the_scan(spark, points):
    _, read, _ = points
    parent = ORDER[0]
    for df, sorts in ((layout.of_years(read, 2021, 2021), False), (read, True)):
        stepped = kinematics.steps(df, parent, "track_id")
        for made in (stepped, kinematics.motion(stepped, parent), kinematics.breaks(stepped, parent), kinematics.run_lengths(df, F.month("time"), parent)):
            plan = plan_of(made)
            assert "Exchange" not in plan, plan
            assert ("Sort [" in plan) == sorts, plan
    assert str(kinematics.motion(kinematics.steps(read, parent), parent).count()) == "60"


def test_filters_prune_folders(spark, points):
    _, read, _ = points
    plan = plan_of(layout.of_years(read, 2022, 2023))
    assert "PartitionFilters: [isnotnull(start_year" in plan and "start_year#" in plan.split("PartitionFilters")[1][:200]
    strong = read.groupBy("start_year", ORDER[0]).agg(F.max("lat").alias("top")).filter("start_year = 2021 and top > 3")
    plan = plan_of(layout.of_cohort(read, strong))
    assert "dynamicpruning" in plan or "PartitionFilters: [isnotnull(start_year" in plan and "2021" in plan
    got = layout.of_cohort(read, strong)
    assert {r["start_year"] for r in got.select("start_year").distinct().collect()} == {2021}


def test_cohort_of_another_table_prunes_at_run_time(spark, points, tmp_path):
    _, read, _ = points
    few = read.select("start_year", ORDER[0]).distinct().withColumn("rest", F.col(ORDER[0]) % 20)
    few.write.parquet(f"{tmp_path}/few")
    named = spark.read.parquet(f"{tmp_path}/few").filter("rest = 1")
    out = layout.of_cohort(read, named)
    assert "dynamicpruning" in plan_of(out)
    assert out.select(ORDER[0]).distinct().count() == 3
