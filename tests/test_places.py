"""Covers of polygons, bitmaps of months and region means against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from trackengine.operators import bitmaps, cover, regions, spatial


def ring(cx, cy, radius, n, seed):
    draw = random.Random(seed)
    corners = [(cx + radius * draw.uniform(0.5, 1.0) * math.cos(2 * math.pi * k / n) + 1e-4, cy + radius * draw.uniform(0.5, 1.0) * math.sin(2 * math.pi * k / n) + 1e-4) for k in range(n)]
    return list(zip(corners, corners[1:] + corners[:1], strict=True))


SHAPES = {
    1: ring(70.0, 20.0, 14.0, 400, 1) + ring(70.0, 20.0, 4.0, 60, 2) + ring(70.0, 20.0, 1.0, 9, 3),  # a hole with an island
    2: ring(95.0, 5.0, 3.0, 50, 4) + ring(105.0, 12.0, 2.0, 40, 5),  # two islands
    3: ring(-3.0, -2.0, 0.05, 12, 6),  # less than a cell
    4: [((60.0, 0.0), (80.0, 0.0)), ((80.0, 0.0), (80.0, 30.0)), ((80.0, 30.0), (60.0, 30.0)), ((60.0, 30.0), (60.0, 0.0))],  # along cells
}


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(r, *a, *b) for r, shape in SHAPES.items() for a, b in shape], "region long, x1 double, y1 double, x2 double, y2 double")


def inside(shape, x, y):
    return sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / ((b[1] - a[1]) or 1e-9) + a[0] for a, b in shape) % 2 == 1


def test_cover_finds_the_points_inside(spark, edges):
    draw = random.Random(7)
    points = [(k, draw.uniform(50, 110), draw.uniform(-10, 36)) for k in range(3_000)] + [(10_000 + k, draw.uniform(-3.1, -2.9), draw.uniform(-2.1, -1.9)) for k in range(200)] + [(20_000, None, 1.0), (20_001, 1.0, None)]
    frame = spark.createDataFrame(points, "id long, lon double, lat double")
    made = cover.cover(edges)
    got = cover.points_in_cover(frame, made, "id").collect()
    want = sorted((k, r) for k, x, y in points if x is not None and y is not None for r, shape in SHAPES.items() if inside(shape, x, y))
    assert sorted(map(tuple, got)) == want and len(want) > 500
    assert sorted(map(tuple, spatial.points_in_polygons(frame, edges, "id").collect())) == want
    tests = cover.border_meetings(frame, made, "id").count()
    all_edges = frame.filter("lat is not null and lon is not null").count() * edges.count()
    assert tests * 100 < all_edges  # and a fraction of what whole rows of boxes meet
    boxes = edges.groupBy("region").agg(F.min("x1").alias("a"), F.max("x1").alias("b")).join(edges, "region")
    rows = frame.join(boxes, (F.floor("lat").between(F.floor(F.least("y1", "y2")), F.floor(F.greatest("y1", "y2")))) & F.floor("lon").between(F.floor("a"), F.floor("b"))).count()
    assert tests * 10 < rows
    cover.drop(made)


def test_cover_of_no_edges(spark, edges):
    made = cover.cover(edges.limit(0), levels=3)
    assert cover.points_in_cover(spark.createDataFrame([(1, 1.0, 1.0)], "id long, lon double, lat double"), made, "id").collect() == []


def test_region_means_of_spans(spark):
    draw = random.Random(8)
    daily = [(f"s{s}", d, draw.choice([None, float("nan"), float(draw.randrange(50)), float(draw.randrange(50))])) for s in range(4) for d in range(-5, 60) if draw.random() < 0.7]
    days = [(t, draw.choice([None, *range(-20, 80)])) for t in range(6) for _ in range(draw.randrange(1, 60))] + [(9, 500), (9, 501)]
    out = regions.event_region_mean(spark.createDataFrame(days, "track_id long, d int"), spark.createDataFrame(daily, "slug string, d int, value double")).collect()
    want = []
    for t in sorted({t for t, d in days if d is not None}):
        own = {d for k, d in days if k == t and d is not None}
        for s in sorted({s for s, _, _ in daily}):
            values = [v for k, d, v in daily if k == s and d in own and v is not None and v == v]
            want.append((t, s, len(own), round(sum(values) / len(values)) if values else -1))
    assert sorted(map(tuple, out)) == want
    spans = regions.day_spans(spark.createDataFrame(days, "track_id long, d int"))
    assert sorted(map(tuple, spans.filter("track_id = 9").collect())) == [(9, 500, 501)]


def test_region_means_by_date(spark):
    days = spark.sql("select 1 as track_id, explode(sequence(date'2023-12-30', date'2024-01-02')) as d")
    daily = spark.sql("select 's' as slug, explode(sequence(date'2023-12-31', date'2024-03-01')) as d, 4.0D as value")
    assert [tuple(r) for r in regions.event_region_mean(days, daily).collect()] == [(1, "s", 4, 4)]


def test_bitmaps_of_many_tracks(spark):
    """Tracks beyond one bitmap, and a cell that only a cohort's tracks touch."""
    rows = spark.range(0, 90_000, 30).selectExpr("id as track_no", "id as track_id", "0 as idx", "cast(id % 3 as double) as lat", "0.1D as lon", "make_timestamp_ntz(2024, cast(id % 4 + 1 as int), 1, 0, 0, 0) as time", "cast(null as boolean) as within_segment")
    made = bitmaps.density_bitmaps(rows)
    few = bitmaps.cohort_bitmap(rows.filter("lat = 2 and track_no > 40000"))
    for months, cohort, test in (((1, 3), None, "month(time) in (1, 3)"), (None, few, "lat = 2 and track_no > 40000"), ((2,), few, "lat = 2 and track_no > 40000 and month(time) = 2"), ((12,), None, "false")):
        want = {(0, int(r["lat"] * 2)): r["count"] for r in rows.filter(test).groupBy("lat").count().collect()}
        got = {(r["cell_x"], r["cell_y"]): r["n_tracks"] for r in bitmaps.density_of(made, months, cohort).collect()}
        assert got == want


def test_bitmaps_of_far_apart_tracks(spark):
    """Tracks of one cell whose numbers are far apart, also negative, take a few bytes each, and no bitmap is sorted."""
    rows = spark.range(-500, 500).selectExpr("id * 32768 + 63 as track_no", "id as track_id", "0 as idx", "0.1D as lat", "0.1D as lon", "timestamp_ntz '2024-01-01' as time", "cast(null as boolean) as within_segment")
    made = bitmaps.density_bitmaps(rows)
    assert made.selectExpr("sum(octet_length(cast(bits as string))) as n").first()["n"] <= 1_000 * 64
    few = bitmaps.cohort_bitmap(rows.filter("track_no < 0"))
    for out, n in ((bitmaps.density_of(made, (1,)), 1_000), (bitmaps.density_of(made, None, few), 500)):
        assert [tuple(r) for r in out.collect()] == [(0, 0, n)]
        assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
