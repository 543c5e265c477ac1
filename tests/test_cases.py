"""Hand-made cases: rounding, ties, runs, nearest times, match limits, names, paths, gaps, persistence, density, edges."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackengine.functions import columns as fc
from trackengine.operators import climatology, cohort, export, gaps, gates, kinematics, matching, ranks, regions, spatial, strength, summary
from trackengine.sources import best_tracks, catalogue, daily_series


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def track(spark, rows, extra=""):
    """rows: (track_id, hour, lat, lon, ...)"""
    names = ["track_id", "h", "lat", "lon", *extra.split()]
    kinds = "track_id long, h long, lat double, lon double" + "".join(f", {c} {'boolean' if c == 'observed' else 'int' if c == 'category' else 'double'}" for c in names[4:])
    return spark.createDataFrame(rows, kinds).withColumn("time", F.expr("timestampadd(HOUR, cast(h as int), timestamp_ntz '2024-01-01 00:00:00')"))


@pytest.mark.parametrize(("x", "want"), [(2.5, 2), (3.5, 4), (-2.5, -2), (None, -7), (float("nan"), -7), (float("inf"), -7)])
def test_scaled_is_half_even(spark, x, want):
    assert value(spark, fc.scaled(F.lit(x).cast("double"), 1, -7)) == want


def test_half_up_and_peak_class(spark):
    assert [value(spark, fc.half_up(F.lit(x))) for x in (2.5, -2.5)] == [3, -2]
    assert [value(spark, fc.peak_class(F.lit(x).cast("int"))) for x in (None, 0, 4, 7)] == [1, 1, 4, 6]


def test_haversine(spark):
    assert abs(value(spark, fc.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))) - 20015.11) < 0.1
    assert value(spark, fc.haversine_km(F.lit(1.0), F.lit(2.0), F.lit(1.0), F.lit(2.0))) == 0


@pytest.mark.parametrize(
    ("name", "want"), [("UNNAMED", ""), ("invest", ""), ("kyaar", "Kyarr"), ("FANI:FANI-GU", "Fani"), ("A:UNNAMED:B", "A / B"), (None, ""), (" x-ray ", "X-Ray"), ("new york:NEW YORK", "New York")]
)
def test_display_name(spark, name, want):
    assert value(spark, fc.display_name(F.lit(name).cast("string"))) == want


def test_percentile_rank(spark):
    def ranks_of(values, **kw):
        df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
        return [r["v_pct"] for r in ranks.percentile_rank(df, "v", **kw).orderBy("k").collect()]

    assert ranks_of([1.0, 2.0, 2.0, 3.0]) == [25, 62, 62, 100]
    assert ranks_of([1.0, 2.0, 2.0, 3.0], ascending=False) == [100, 62, 62, 25]
    assert ranks_of([5.0, 5.0]) == [75, 75]
    assert ranks_of([1.0]) == [100]
    assert ranks_of([None, 4.0]) == [0, 100]
    assert ranks_of([]) == []
    many = [float(k * 37 % 1000) for k in range(3000)]
    order = sorted(many)
    want = [round(100 * (order.index(v) + 2) / 3000) for v in many]
    assert ranks_of(many) == want


def test_first_extreme(spark):
    t = track(spark, [(1, 0, 0.0, 0.0, 3.0), (1, 800, 0.0, 0.0, 9.0), (1, 1600, 0.0, 0.0, 9.0), (2, 800, 0.0, 0.0, None), (2, 2300, 0.0, 0.0, None)], "wind")
    got = {r["track_id"]: r["m"] for r in t.groupBy("track_id").agg(fc.first_extreme(F.col("wind"), F.col("time"), F.month("time")).alias("m")).collect()}
    assert got == {1: 2, 2: 2}


def test_runs(spark):
    t = track(spark, [(1, k, 0.0, 0.0, o) for k, o in enumerate([False, True, True, False, False, True, False])] + [(2, 0, 0.0, 0.0, True), (3, 0, 0.0, 0.0, False)], "observed")
    runs = sorted((r["track_id"], r["start"], r["end"]) for r in kinematics.missing_runs(t, F.col("observed")).collect())
    assert runs == [(1, 0, 0), (1, 3, 4), (1, 6, 6), (3, 0, 0)]
    longest = {r["track_id"]: r["max_missing_run_hours"] for r in kinematics.max_missing_run(t, F.col("observed")).collect()}
    assert longest == {1: 2, 2: 0, 3: 1}
    back = kinematics.expand_runs(kinematics.run_lengths(t, F.col("observed")))
    assert back.count() == 9


def test_single_point_track(spark):
    s = kinematics.steps(track(spark, [(1, 5, 1.0, 2.0)]))
    m = kinematics.motion(s).first()
    assert (m["distance_km"], m["max_speed_ms"], m["max_gap_hours"]) == (0, 0, 0)
    assert kinematics.typical_step(s).first()["typical_step"] == 1
    assert kinematics.split_path(s).count() == 0


def storm(spark, rows):
    return spark.createDataFrame(rows, "sid string, h double, lat double, lon double, name string, basin string").withColumn("time", F.expr("timestampadd(MINUTE, cast(h*60 as int), timestamp_ntz '2024-01-01 00:00:00')"))


def test_nearest_time_ties_and_limits(spark):
    points = track(spark, [(1, 0, 0.0, 0.0), (1, 2, 0.0, 1.0), (1, 10, 0.0, 2.0)])
    fixes = storm(spark, [("S", 1.0, 0.0, 0.0, "N", "B"), ("S", 5.0, 0.0, 1.0, "N", "B"), ("S", 5.02, 0.0, 1.0, "N", "B"), ("S", 7.0, 0.0, 2.0, "N", "B")])
    pairs = spark.createDataFrame([(1, "S", 0.0 + 473352, 10.0 + 473352)], "track_id long, sid string, t_start double, t_end double")
    got = {round(r["f_hour"] - 473352, 2): r["km"] for r in matching.nearest_points(pairs, points, fixes).collect()}
    assert got[1.0] == 0  # midway: the earlier point
    assert got[5.0] == 0 and got[7.0] == 0  # three hours away counts
    assert 5.02 not in got  # a little more does not


def test_confidence_limits(spark):
    tier = lambda *x: value(spark, matching.confidence(*(F.lit(v).cast("double") for v in x)))
    assert tier(120, 220, 4, 12, 25) == "high" and tier(120, 220, 4, 12, None) == "high"
    assert tier(120, 220, 4, 12, 24.9) == "medium" and tier(200, 320, 3, 6, 15) == "medium"
    assert tier(200.1, 320, 3, 6, 15) == "low" and tier(100, 200, 3, 6, 14.9) == "low"


def test_match_needs_three_fixes_and_six_hours(spark):
    points = track(spark, [(1, k, 10.0, 80.0) for k in range(20)])
    make = lambda hours: storm(spark, [("S", float(h), 10.0, 80.0, "N", "B") for h in hours])
    assert matching.match_tracks(points, make([0, 3, 6])).count() == 1
    assert matching.match_tracks(points, make([0, 3, 5])).count() == 0
    assert matching.match_tracks(points, make([0, 6])).count() == 0


def test_storm_headers_and_dedupe(spark):
    fixes = storm(spark, [("S", 0.0, 1.0, 1.0, "", ""), ("S", 1.0, 2.0, 2.0, "B", "NI"), ("S", 2.0, 3.0, 3.0, "C", "WP"), ("T", 0.0, 1.0, 1.0, "X", "NI")])
    (h,) = best_tracks.storm_headers(fixes).collect()
    assert (h["sid"], h["name"], h["basin"], h["n_fixes"]) == ("S", "B", "NI", 3)
    twice = spark.createDataFrame([("S", 0, 1, "b"), ("S", 0, 0, "a")], "sid string, time int, file_rank int, row_rank string")
    assert best_tracks.dedupe_fixes(twice).first()["row_rank"] == "a"


def test_polyline_example(spark):
    pts = spark.createDataFrame([(1, 0, 38.5, -120.2), (1, 1, 40.7, -120.95), (1, 2, 43.252, -126.453)], "track_id long, time int, lat double, lon double")
    path = export.encode_paths(pts, precision=100_000)
    assert path.first()["path"] == "_p~iF~ps|U_ulLnnqC_mqNvxq`@"
    back = sorted((r["idx"], round(r["lat"], 5), round(r["lon"], 5)) for r in export.decode_paths(path, precision=100_000).collect())
    assert back == [(0, 38.5, -120.2), (1, 40.7, -120.95), (2, 43.252, -126.453)]


def decision(spark, missing, supported, speed=5.0):
    rows = [(1, 1, missing, speed, 0, k + 1, s) for k, s in enumerate(supported)]
    filled = spark.createDataFrame(rows, "track_id long, block int, missing long, speed_ms double, h0 long, k long, supported boolean")
    return gaps.gap_decision(filled).first()["keep"]


def spread(n, good):
    """n hours, ``good`` of them supported, evenly spread."""
    return [(k + 1) * good // n > k * good // n for k in range(n)]


def test_gap_rules(spark):
    assert decision(spark, 3, [False] * 3, 19.9)
    assert not decision(spark, 3, [False] * 3, 20.1)
    assert decision(spark, 3, [True, True, False], 20.1)
    assert decision(spark, 6, [False] * 6)
    assert not decision(spark, 7, spread(7, 4)) and decision(spark, 7, spread(7, 5))
    assert decision(spark, 11, spread(11, 8)) and not decision(spark, 11, spread(11, 7))
    assert not decision(spark, 12, spread(12, 8)) and decision(spark, 12, spread(12, 9))
    assert decision(spark, 24, [True] * 20 + [False] * 4) and not decision(spark, 24, [True] * 19 + [False] * 5)


def test_fill_and_resegment(spark):
    t = track(spark, [(1, 0, 0.0, 0.0, 1.0, 1.0), (1, 4, 4.0, 8.0, 5.0, 1.0), (1, 5, 4.0, 8.0, 5.0, 1.0)], "vort deficit")
    blocks = gaps.gap_blocks(t)
    rows = gaps.fill_hourly(blocks).orderBy("k").collect()
    assert [(r["k"], r["lat"], r["lon"], r["vort"]) for r in rows] == [(1, 1.0, 2.0, 2.0), (2, 2.0, 4.0, 3.0), (3, 3.0, 6.0, 4.0)]
    reject = blocks.select("track_id", "h0", F.lit(False).alias("keep"))
    assert [r["segment"] for r in gaps.resegment(t, reject).orderBy("h").collect()] == [0, 1, 1]


def test_persistent_class(spark):
    def run(classes, width=6):
        rows = [(1, k, 0.0, 0.0, c, c is not None) for k, c in enumerate(classes)]
        t = track(spark, rows, "category observed").withColumn("hour", F.col("h"))
        return [r["persistent"] for r in strength.persistent_class(t, width).orderBy("h").collect()]

    assert run([1, 3, 3, 3, 3, 3, 1]) == [1] * 7  # five hours
    assert run([1, 3, 3, 3, 3, 3, 3, 1]) == [1, 3, 3, 3, 3, 3, 3, 1]
    assert run([3, 3, 3, None, 3, 3, 3]) == [1, 1, 1, None, 1, 1, 1]


def test_density(spark):
    t = kinematics.steps(track(spark, [(1, 0, 0.1, 0.1), (1, 1, 0.1, 1.4)]))
    got = sorted((r["cell_x"], r["cell_y"], r["n_tracks"]) for r in spatial.track_density(t).collect())
    assert got == [(0, 0, 1), (1, 0, 1), (2, 0, 1)]
    t = kinematics.steps(track(spark, [(1, 743, 0.1, 0.1), (1, 744, 0.1, 1.4)]))  # from January into February
    assert sorted((r["cell_x"], r["cell_y"]) for r in spatial.track_density(t, months=(2,)).collect()) == [(2, 0)]


def test_polygon_with_a_hole(spark):
    ring = lambda h: [(1, -h, -h, h, -h), (1, h, -h, h, h), (1, h, h, -h, h), (1, -h, h, -h, -h)]
    edges = spark.createDataFrame([tuple(float(v) if k else v for k, v in enumerate(e)) for e in ring(4.3) + ring(1.3)], "region int, x1 double, y1 double, x2 double, y2 double")
    pts = spark.createDataFrame([(1, 0.2, 0.2), (2, 2.2, 0.2), (3, 5.0, 0.2), (4, -4.2, -4.2)], "id int, lon double, lat double")
    assert sorted(r["id"] for r in spatial.points_in_polygons(pts, edges, "id").collect()) == [2, 4]


def test_nearest_track_is_strictly_inside(spark):
    s = spatial.segments(kinematics.steps(track(spark, [(1, 0, 0.0, 0.0), (1, 1, 0.0, 3.0), (2, 0, 5.0, 0.0), (2, 1, 5.0, 3.0)])))
    q = spark.createDataFrame([(1, 1.5, 1.0), (2, 1.5, 0.5), (3, 9.0, 9.0)], "q int, lon double, lat double")
    got = {r["q"]: (r["track_id"], r["distance"]) for r in spatial.nearest_track(q, s, 1.0, "q").collect()}
    assert got == {2: (1, 0.5)}


def test_smart_search(spark):
    rows = spark.createDataFrame([(1939, 1990, 175320, 175330, "CS 1990 01", "S1"), (12, 1939, 0, 9, "D 1939 01", None)], "id long, start_year long, start_hour long, end_hour long, label string, sid string")
    found = lambda text: sorted(r["id"] for r in rows.filter(cohort.smart_search(text)).collect())
    assert found("1939") == [1939] and found("1990") == [1939]  # too early for a year: an id
    assert found("parent event #12") == found("event12") == found(" ID 12 ") == [12] and found("") == [12, 1939]
    assert found("1990-01-01") == [1939] and found("1990-13-45") == [] and found("cs 1990") == [1939] and found("lps 12") == [12]


def test_complete_years(spark):
    years = spark.range(1995, 2002).select(F.col("id").alias("year"))
    got = lambda months: sorted(r["year"] for r in climatology.complete_years(years, 1995, 3, 2000, months).collect())
    assert got((3, 6)) == list(range(1995, 2001)) and got((2, 6)) == list(range(1996, 2001))


def test_quality_flags(spark):
    rows = [(25, 30.1, 721, 8001, 0.4, 2), (12, 29.5, 10, 10, 0.75, 1), (36, 29.5, 10, 10, 0.5, 3), (37, 29.5, 10, 10, 0.5, 3)]
    df = spark.createDataFrame([(a, float(b), c, d, float(e), f) for a, b, c, d, e, f in rows], "max_missing_run_hours long, max_speed_ms double, duration_hours long, distance_km long, observed_fraction double, n_segments long")
    assert [(r["qc_flags"], r["qc_severity"]) for r in summary.quality(df).collect()] == [(63, 2), (0, 0), (33, 1), (33, 2)]


def test_gates(spark):
    good = gates.null_gate(spark.range(3), ["id"])
    gates.enforce(good)
    bad = gates.null_gate(spark.createDataFrame([(None,)], "id int"), ["id"])
    with pytest.raises(ValueError, match="id"):
        gates.enforce(good.unionByName(bad))
    assert gates.summary(good.unionByName(bad)).first()["status"] == "fail"


def test_daily_series_refuses_wrong_lengths(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 3, 300)], "r string, d int, v int")
    packed = daily_series.pack(rows.withColumn("y", F.lit(2024)), "r", "y", "d", "v", {2024: 4})
    daily_series.payload(packed).write.text(f"{tmp_path}/x")
    packed.write.json(f"{tmp_path}/lines")
    assert sorted(daily_series.read_lines(spark, f"{tmp_path}/lines").collect()) == sorted(daily_series.read_payload(spark, f"{tmp_path}/x").select("region", "year", "packed", "declared").collect())
    got = [r["value"] for r in daily_series.decode(spark, f"{tmp_path}/x", {2024: 4}).orderBy("date").collect()]
    assert got == [5, None, 300, None]
    with pytest.raises(ValueError, match="length"):
        daily_series.decode(spark, f"{tmp_path}/x", {2024: 5})
    with pytest.raises(ValueError, match="year"):
        daily_series.decode(spark, f"{tmp_path}/x", {2024: 4, 2025: 4})


def test_top_region(spark):
    df = spark.createDataFrame([(1, "b", 5), (1, "a", 5), (1, "c", -1), (2, "a", -1)], "track_id int, slug string, mean int")
    assert {r["track_id"]: (r["slug"], r["mean"]) for r in regions.top_region(df).collect()} == {1: ("a", 5), 2: (None, -1)}


def test_catalogue_version(spark):
    assert value(spark, export.catalogue_version(F.lit("lps_v1.2.3_core.parquet"))) == "v1.2.3"
    assert value(spark, export.catalogue_version(F.lit("x"), "5.1")) == value(spark, export.catalogue_version(F.lit("x"), "v5.1")) == "v5.1"
    for name in ("lps_v5.4.2-era5-1940.parquet", "a/lps_b/lps_v5.4.2.parquet", "lps_v5.4.2"):
        assert value(spark, export.catalogue_version(F.lit(name))) == "v5.4.2"
    for name in ("x", "lps_1.2.parquet", "lps_v1_core", "lps_v1..2"):
        with pytest.raises(Exception, match="no catalogue version"):
            value(spark, export.catalogue_version(F.lit(name)))


def test_release_documents_by_path(spark, tmp_path):
    docs = {
        "manifest": {"schema": "m-1", "catalogue": {"sha256": "ab"}},
        "metadata": {"version": "1.2.3", "sha256": "ab", "qa": {"all_release_gates_passed": True}},
        "qa": {"status": "pass"},
        "audit": {"status": "pass"},
        "amendment": {"scientific_change": False, "catalogue_changed": False},
        "crosswalk": {"schema": "x-1", "catalogue_version": "v1.2.3"},
    }
    faults = {
        "manifest_schema": ("manifest", {"schema": "m-0"}),
        "metadata_version": ("metadata", {"version": "1.2.4"}),
        "metadata_gates": ("metadata", {"qa": {"all_release_gates_passed": False}}),
        "qa_status": ("qa", {"status": "open"}),
        "audit_status": ("audit", {"status": None}),
        "amendment_changes": ("amendment", {"catalogue_changed": True}),
        "crosswalk_schema": ("crosswalk", {"schema": "x-0"}),
        "crosswalk_version": ("crosswalk", {"catalogue_version": "v1.2.2"}),
        "digests_differ": ("metadata", {"sha256": "cd"}),
    }
    schemas = {
        "manifest": "schema string, catalogue struct<sha256:string>",
        "metadata": "version string, sha256 string, qa struct<all_release_gates_passed:boolean>",
        "qa": "status string",
        "audit": "status string",
        "amendment": "scientific_change boolean, catalogue_changed boolean",
        "crosswalk": "schema string, catalogue_version string",
    }

    def failed(changed, name):
        (tmp_path / name).mkdir()
        for d, content in changed.items():
            (tmp_path / name / f"{d}.json").write_text(json.dumps(content, indent=2))
        read = [export.read_documents(spark, [f"{tmp_path}/{name}/{d}.json"], schemas[d]) for d in docs]
        return [r["check"] for r in gates.published_gate(*read, {"manifest": "m-1", "crosswalk": "x-1"}, "v1.2.3").filter("not passed").collect()]

    assert failed(docs, "good") == []
    for check, (d, change) in faults.items():
        assert failed({**docs, d: docs[d] | change}, check) == [check]


def test_catalogue_columns(spark, tmp_path):
    rows = spark.sql("select 7L as track_id, timestamp'2001-02-28 23:00:00' as time, 1 as lat, 'x' as other union all select 7L, timestamp'2001-03-01 00:00:00', 2, 'y'")
    rows.write.parquet(f"{tmp_path}/c")
    got = catalogue.read_catalogue(spark, f"{tmp_path}/c", ["time", "lat", "track_id"])
    assert got.columns == ["time", "lat", "track_id", "month"] and sorted((r["month"], r["lat"]) for r in got.collect()) == [(2, 1.0), (3, 2.0)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "other" not in plan.split("ReadSchema")[1]
    with pytest.raises(Exception, match="event_id"):
        catalogue.read_catalogue(spark, f"{tmp_path}/c")


def test_ranks_of_groups_and_nulls(spark):
    """Numbers, ranks, neighbours and quantiles against plain Python, with null groups, ties and a group of most rows."""
    import random

    draw = random.Random(3)
    rows = [(k, None if k % 11 == 0 else "a" if k % 5 else "b", float(draw.randrange(-3, 30)) if k % 13 else None) for k in range(400)]
    df = spark.createDataFrame(rows, "id long, g string, x double")
    of = {}
    for k, g, x in rows:
        of.setdefault(g, []).append((k, x))
    got = {r["id"]: r["p"] for r in ranks.percentile_rank_by(df, "g", "x", "p").collect()}
    for g, members in of.items():
        valid = sorted(x for _, x in members if x is not None and x >= 0)
        for k, x in members:
            want = -1 if x is None or x < 0 else round(100.0 * (sum(v < x for v in valid) + (valid.count(x) + 1) / 2) / len(valid))
            assert got[k] == want
    for r in ranks.neighbours(df, [F.desc_nulls_last("x"), F.asc("id")], "id", ["g"]).collect():
        order = [k for k, x in sorted(of[r["g"]], key=lambda m: (m[1] is None, -(m[1] or 0), m[0]))]
        at = order.index(r["id"])
        assert (r["previous"], r["next"]) == (order[at - 1], order[(at + 1) % len(order)])
    for r in ranks.quantiles(df, ["g"], "x", {"q1": 0.25, "median": 0.5, "top": 1.0}).collect():
        values = sorted(x for _, x in of[r["g"]] if x is not None)
        assert r["top"] == values[-1]
        for q, name in ((0.25, "q1"), (0.5, "median")):
            place = q * (len(values) - 1)
            low = values[int(place)]
            assert abs(r[name] - (low + (values[min(int(place) + 1, len(values) - 1)] - low) * (place % 1))) < 1e-9


def test_gap_decision_sorts_no_filled_rows(spark):
    """Runs over the edges of what one number holds and hours of unknown support, as counted by hand; no row of an hour is sorted."""
    rng, rows, want = np.random.default_rng(5), [], {}
    for block in range(60):
        n = int(rng.choice([1, 4, 29, 30, 31, 59, 60, 95]))
        marks = [{0: False, 1: True, 2: None}[int(v)] for v in rng.choice(3, n, p=[0.75, 0.15, 0.1])]
        rows += [(1, block, k + 1, n, 7, 1.0, m) for k, m in enumerate(marks)]
        run = longest = 0
        for m in marks:
            run = 0 if m else run + (m is False)
            longest = max(longest, run)
        want[block] = (sum(m is True for m in marks), longest)
    filled = spark.createDataFrame(rows, "track_id long, block long, k long, missing long, h0 long, speed_ms double, supported boolean").repartition(3)
    out = gaps.gap_decision(filled)
    assert {r["block"]: (r["n_supported"], r["longest_bad"]) for r in out.collect()} == want
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "Window" not in plan and "Sort" not in plan.replace("SortAggregate", "Sort").replace("sort_array", "")


def test_filled_rows_are_not_sorted_for_joins(spark):
    """Rows of hours meet blocks and tracks by hash; a persistent class sorts its hours once."""
    filled = spark.range(20).selectExpr("id % 4 as track_id", "id % 2 as block", "id as k", "id as hour", "true as observed", "1 as category", "1.0 as lat", "id as audit_id", "'linear' as method", "1 as missing")
    blocks = spark.range(8).selectExpr("id % 4 as track_id", "id % 2 as block", "id % 3 > 0 as keep", "id as longest_bad").distinct()
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    joined = gaps.kept_rows(filled, blocks), gates.gap_contract(filled, blocks, ("linear",), ["lat"], 4), export.fixes_table(filled, blocks, ["hour"])
    assert all("ShuffledHashJoin" in plan(df) for df in joined)
    executed = strength.persistent_class(filled)._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Sort [") == 1
