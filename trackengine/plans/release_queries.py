"""Queries over gates, release checks, persistent intensity and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackengine.functions import columns as fc
from trackengine.operators import export, gaps, gates, kinematics, package, ranks, regions, release, strength, summary, verify
from trackengine.plans import fixtures
from trackengine.plans.match_queries import MATCH, headers, matches
from trackengine.plans.registry import query
from trackengine.plans.system_queries import _DAILY, _MEANS, _MEMBERS, _RAIN, _daily, labelled_systems
from trackengine.plans.track_queries import FIX, GAPS, SYS, filled, full_series, hav, r, segmented, stepped, steps_sql, systems
from trackengine.sources import catalogue, digests, layout, scratch


def _gate(name: str, value: str, expected: str = "0") -> str:
    return f"select '{name}' as \"check\", ({value}) = ({expected}) as passed, cast({value} as bigint) as value, cast({expected} as bigint) as expected"


# --- a catalogue with faults, so that every gate has something to find
def faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full series with a published catalogue's columns; each rule is broken by some rows."""
    hour, observed = F.rint(fc.epoch_hours(F.col("time"))).cast("long"), F.col("observed")
    return full_series(spark, sf_dir).withColumns(
        {
            "parent_id": F.col("track_id") + F.when(F.col("track_id") % 50 == 0, 1).otherwise(0),
            "event_id": F.col("track_id") - F.when(F.col("track_id") % 70 == 0, 1).otherwise(0),
            "candidate_diagnostics_available": observed & (hour % 97 != 0),
            "position_source": F.when(observed, "observed").otherwise("interpolated"),
            "category": F.when(observed & (hour % 61 != 0), F.col("category")).when(~observed & (hour % 59 == 0), 1),
            "lat": F.when(hour % 83 != 0, F.col("lat")),
        }
    )


_FAULTY = f"""{GAPS}, faulty as (select *, track_id + case when track_id % 50 = 0 then 1 else 0 end as parent_id, track_id - case when track_id % 70 = 0 then 1 else 0 end as event_id, observed and h % 97 <> 0 as flagged,
  case when observed and h % 61 <> 0 then category when not observed and h % 59 = 0 then 1 end as class from full_)"""
_HOURS = "(select count(*) from (select distinct user_id, date_trunc('hour', ts) from events))"
_BLOCKS = "(select count(*) from (select distinct user_id, floor((day(ts)-1)/6) from events))"


@query(
    f"with {_FAULTY} "
    + " union all ".join(
        [
            _gate("rows", "(select count(*) from full_)", _HOURS),
            _gate("tracks", "(select count(distinct track_id) from full_)", _BLOCKS),
            _gate("parents", "(select count(distinct parent_id) from faulty)", _BLOCKS),
            _gate("observed", "(select count(*) from fixes)", _HOURS),
            _gate("identity_misaligned", "(select count(*) from faulty where track_id <> parent_id or track_id <> event_id)"),
            _gate("flag_mismatch", "(select count(*) from faulty where observed <> flagged)"),
            _gate("observed_without_class", "(select count(*) from faulty where observed and class is null)"),
            _gate("interpolated_with_class", "(select count(*) from faulty where not observed and class is not null)"),
            _gate("null_lat", "(select count(*) from full_ where h % 83 = 0)"),
            _gate("null_wind", "(select count(*) from filled)"),
        ]
    )
)
def q03_q11_row_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against a release document that is written from the raw events: observed hours and tracks. Its number of rows leaves out
    what gaps add."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    counted = events.agg(F.count_distinct("user_id", F.date_trunc("hour", "ts")).alias("rows"), F.count_distinct("user_id", F.floor((F.dayofmonth("ts") - 1) / 6)).alias("tracks"))
    path = scratch.new_path(spark, "manifest")
    counted.select("rows", "tracks", F.col("tracks").alias("parents"), F.col("rows").alias("observed")).write.json(path)
    expected = export.read_documents(spark, [path], "rows long, tracks long, parents long, observed long", lines=True).first().asDict()
    return gates.row_gates(faulty(spark, sf_dir), expected, ["lat", "wind"])


_TWICE = "twice as (select * from fixes union all select * from fixes where event_id % 40 = 0)"
_DUP = "(select count(*) from (select {} from twice group by all having count(*) > 1))"
_MIXED = """mixed as (select user_id, time, track_id*10 + case when user_id % 4 = 0 and h % 3 = 0 then 1 else 0 end as seg from fixes),
changed as (select user_id, seg, lag(seg) over (partition by user_id order by time, seg) as before from mixed),
inter as (select user_id, count(*) filter (seg <> before) as changes, count(distinct seg) as segments from changed group by 1)"""


@query(
    f"with {FIX}, {_TWICE}, {_MIXED} {_gate('duplicate_track_time', _DUP.format('track_id, time'))} union all {_gate('duplicate_parent_time', _DUP.format('user_id, time'))} "
    f"union all {_gate('interleaved_segments', '(select count(*) from inter where changes + 1 <> segments)')}"
)
def q06_q07_q12_identity_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some fixes stand twice; a quarter of the parents have two segments by turns."""
    points = fixtures.fixes(spark, sf_dir)
    twice = points.unionByName(points.filter("event_id % 40 = 0"))
    out = gates.duplicate_gate(twice, ["track_id", "time"], "duplicate_track_time")
    out = out.unionByName(gates.duplicate_gate(twice, ["user_id", "time"], "duplicate_parent_time"))
    hour = F.rint(fc.epoch_hours(F.col("time"))).cast("long")
    mixed = points.withColumn("track_id", F.col("track_id") * 10 + F.when((F.col("user_id") % 4 == 0) & (hour % 3 == 0), 1).otherwise(0))
    return out.unionByName(gates.interleaving_gate(kinematics.steps(mixed, "user_id"), "user_id"))


@query(f"with {FIX} {_gate('misaligned_series', '(select count(distinct track_id) from fixes where track_id % 9 = 0)')}")
def q13_series_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ninth of the tracks lack the last value of one series."""
    series = summary.detail_series(fixtures.fixes(spark, sf_dir), ("wind", "category", "lat"))
    short = series.withColumn("lat", F.when(F.col("track_id") % 9 == 0, F.slice("lat", 1, F.size("lat") - 1)).otherwise(F.col("lat")))
    return gates.alignment_gate(short, ["wind", "category", "lat"])


@query(f"with {_RAIN}, g as (select n_nationkey as region, unnest(range(1, 32)) as d from nation) select g.region, cast(g.d as bigint) as d from g anti join rain on rain.region = g.region and rain.d = g.d and rain.rain is not null")
def q14_region_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of January that a region's series lacks."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("region"))
    grid = nation.withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(31))))
    return grid.join(fixtures.region_rain(spark, sf_dir).filter("rain is not null").select("region", "d"), ["region", "d"], "left_anti").select("region", F.col("d").cast("long").alias("d"))


@query(
    f"""with {MATCH}, {_RAIN}, {_MEMBERS}, {_DAILY}, {_MEANS}, n as (select m.*, name from matches m join heads using (sid)), twice as (select event_id from fixes union all select event_id from fixes where event_id % 45 = 0)
select (select count(distinct user_id) from fixes) as tracks, (select count(distinct track_id) from fixes) as segments, (select count(*) from twice) as rows, (select count(*) from twice where event_id % 9 <> 0) as observed_rows, (select count(*) from twice where event_id % 9 = 0) as posterior_rows,
(select count(*) from fixes where event_id % 45 = 0) as duplicates, (select cast(sum(n) as bigint) from (select count(distinct track_id) - 1 as n from fixes group by user_id)) as splits, (select count(*) from matches) as matched,
(select count(*) from n where confidence <> 'low' and name <> 'UNNAMED') as named, (select count(distinct slug) from means) as regions, (select count(distinct track_id) from means where mean >= 0) as tracks_with_rain"""
)
def q15_scoreboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = fixtures.fixes(spark, sf_dir).withColumn("observed", F.col("event_id") % 9 != 0)
    points = points.unionByName(points.filter("event_id % 45 = 0"))
    names = headers(spark, sf_dir).select("sid", fc.display_name(F.col("name")).alias("display"))
    tracks = points.groupBy("user_id").agg((F.count_distinct("track_id") - 1).alias("break_count"))
    means = regions.event_region_mean(points.select("track_id", F.dayofmonth("time").alias("d")), _daily(spark, sf_dir))
    return gates.scoreboard(points, tracks, matches(spark, sf_dir).join(names, "sid"), means, "track_id", "user_id")


@query(f"with {FIX} {_gate('publication_splits', '(select cast(sum(n) as bigint) from (select count(distinct track_id) - 1 as n from fixes group by user_id) z)')}")
def q16_no_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.splits_gate(fixtures.fixes(spark, sf_dir).groupBy("user_id").agg((F.count_distinct("track_id") - 1).alias("break_count")))


_FAULTS = {"schema": 13, "version": 11, "status": 7, "incomplete_spans": 19, "non_hourly_steps": 5, "scientific_change": 17}


@query("with k as (select o_custkey as k from orders) " + " union all ".join(_gate(n, f"(select count(*) from k where k % {m} = 0)") for n, m in _FAULTS.items()))
def r06_q02_release_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes one document an order into two folders, as JSON lines, reads them by path and checks them; some fail each check."""
    bad = lambda name: F.col("k") % _FAULTS[name] == 0
    docs = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("k")).select(
        F.when(bad("schema"), "release/0").otherwise("release/1").alias("schema"),
        F.when(bad("version"), None).otherwise("1.2.3").alias("version"),
        F.when(bad("status"), "open").otherwise("pass").alias("status"),
        F.struct((~bad("incomplete_spans")).alias("complete_hourly_spans"), F.when(bad("non_hourly_steps"), 1).otherwise(0).alias("non_hourly_steps")).alias("continuity"),
        bad("scientific_change").alias("scientific_change"),
        "k",
    )
    paths = [scratch.new_path(spark, "documents") for _ in range(2)]
    for n, path in enumerate(paths):
        docs.filter(F.col("k") % 2 == n).drop("k").write.json(path)
    schema = "schema string, version string, status string, continuity struct<complete_hourly_spans:boolean,non_hourly_steps:int>, scientific_change boolean"
    return gates.document_gate(export.read_documents(spark, paths, schema, lines=True), "release/1", "1.2.3")


_PUBLISHED = {
    "manifest_schema": "0", "metadata_version": "0", "metadata_gates": "0", "qa_status": "0", "audit_status": "(select cast(count(*) > 0 as int) from orders where o_custkey % 2 = 0)",
    "amendment_changes": "(select cast(count(*) > count(distinct o_custkey) as int) from orders)", "crosswalk_schema": "0", "crosswalk_version": "1", "digests_differ": "(select cast(count(*) <> count(distinct o_custkey) as int) from orders)",
}


@query(" union all ".join(_gate(n, v) for n, v in _PUBLISHED.items()))
def q02_published_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes a release's six documents, made from all orders, each into a folder of its own, reads them by path and holds them together."""
    facts = spark.read.parquet(f"{sf_dir}/orders.parquet").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("m"), F.count_if(F.col("o_custkey") % 2 == 0).alias("even"))
    digest = lambda c: F.sha2(F.col(c).cast("string"), 256).alias("sha256")
    documents = {
        "manifest": [F.lit("m-1").alias("schema"), F.struct(F.col("n").alias("rows"), digest("n")).alias("catalogue")],
        "metadata": [F.lit("1.2.3").alias("version"), F.struct((F.col("n") > 0).alias("all_release_gates_passed")).alias("qa"), digest("m")],
        "qa": [F.when(F.col("n") >= F.col("m"), "pass").otherwise("fail").alias("status")],
        "audit": [F.when(F.col("even") == 0, "pass").otherwise("open").alias("status")],
        "amendment": [F.lit(False).alias("scientific_change"), (F.col("n") > F.col("m")).alias("catalogue_changed")],
        "crosswalk": [F.lit("x-1").alias("schema"), F.lit("v1.2.2").alias("catalogue_version")],
    }
    read = []
    for name, columns in documents.items():
        path, rows = scratch.new_path(spark, name), facts.select(*columns)
        rows.coalesce(1).write.json(path)
        read.append(export.read_documents(spark, [path], ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)))
    return gates.published_gate(*read, {"manifest": "m-1", "crosswalk": "x-1"}, "v1.2.3")


_LINE = "c_custkey || ':' || c_nationkey"


@query(
    f"""with f as (select c_custkey // 1000 as file, sha256(string_agg({_LINE} || chr(10), '' order by c_custkey)) as sha256 from customer group by 1)
select file, sha256, file % 3 <> 1 as passed from f"""
)
def q01_file_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes files of 1,000 customers and holds their bytes against digests that are published beside them, one in three wrong."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.floor(F.col("c_custkey") / 1000).alias("file"), "c_custkey", F.concat_ws(":", "c_custkey", "c_nationkey").alias("value"))
    text = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "value"))), lambda x: x["value"]), "\n"), F.lit("\n"))
    digest = F.when(F.col("file") % 3 != 1, F.sha2(F.col("text").cast("binary"), 256)).otherwise("0")
    published = rows.groupBy("file").agg(text.alias("text")).select("file", digest.alias("published"))
    path = scratch.new_path(spark, "files")
    rows.repartition("file").sortWithinPartitions("file", "c_custkey").select("file", "value").write.partitionBy("file").text(path)
    found = digests.file_digests(spark, path).withColumn("file", F.regexp_extract("path", "file=([0-9]+)", 1).cast("long"))
    return found.join(published, "file").select("file", "sha256", (F.col("sha256") == F.col("published")).alias("passed"))


# --- the catalogue
@query(f"with {GAPS} select track_id, h as hour, cast(month(time) as bigint) as month, {r('lat', 9)} as lat, observed from (select *, make_timestamp(h*3600000000) as time from full_) z")
def r01_read_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the full series with more columns than are asked for and reads a few of them."""
    rows = full_series(spark, sf_dir)
    path = scratch.new_path(spark, "catalogue")
    rows.select("track_id", F.col("track_id").alias("event_id"), F.col("track_id").alias("continuity_parent_track_id"), F.col("time").cast("timestamp").alias("time"), "lat", "lon", F.col("wind").alias("max_wind"), F.col("observed").alias("candidate_diagnostics_available"), F.col("precip").alias("unused")).write.parquet(path)
    read = catalogue.by_parent(catalogue.read_catalogue(spark, path, ["track_id", "continuity_parent_track_id", "time", "lat", "candidate_diagnostics_available"]))
    hour = F.rint(fc.epoch_hours(F.col("time"))).cast("long")
    return read.select("track_id", hour.alias("hour"), F.col("month").cast("long").alias("month"), F.bround("lat", 9).alias("lat"), F.col("candidate_diagnostics_available").alias("observed"))


# --- the catalogue's layout: fixes of four years
_YEARS = f"{FIX}, y as (select *, h + cast(epoch(make_timestamp(2024 + track_id % 4, 1, 1, 0, 0, 0)) - epoch(make_timestamp(2024, 1, 1, 0, 0, 0)) as bigint) // 3600 as yh from fixes)"


def _of_four_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layout of fixes whose tracks are dealt to the years 2024 to 2027."""
    time = F.expr("time + make_dt_interval(datediff(make_date(cast(2024 + track_id % 4 as int), 1, 1), date'2024-01-01'))")
    path = scratch.new_path(spark, "layout")
    layout.write_layout(fixtures.fixes(spark, sf_dir).withColumn("time", time), path, order=("track_id", "time", "event_id"))
    return layout.open_layout(spark, path)


@query(
    f"""with {_YEARS}, c as (select track_id from y group by 1 having max(wind) > 20)
select track_id, yh as hour, row_number() over w - 1 as idx, cast(yh - lag(yh) over w as double) as step_hours, {r(hav("(lag(lat) over w)", "(lag(lon) over w)", "lat", "lon"))} as step_km
from y where track_id % 4 in (1, 2) and track_id in (select track_id from c) window w as (partition by track_id order by yh)"""
)
def r01_f01_layout_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of the strong tracks of two years, over a catalogue that is partitioned by year and bucketed by track."""
    points = _of_four_years(spark, sf_dir)
    with layout.sorted_scans(spark):
        strong = points.groupBy("start_year", "track_id").agg(F.max("wind").alias("w")).filter("w > 20")
        rows = kinematics.steps(layout.of_cohort(layout.of_years(points, 2025, 2026), strong, "track_id"))
    hour = F.rint(fc.epoch_hours(F.col("time"))).cast("long")
    return rows.select("track_id", hour.alias("hour"), F.col("idx").cast("long").alias("idx"), "step_hours", F.bround("step_km", 4).alias("step_km"))


# --- release checks
@query(f"with {GAPS}, s as (select *, h - lag(h) over (partition by track_id order by h) as step from full_), p as (select track_id, count(*) as n, max(h)-min(h)+1 as span, count(*) filter (step <> 1) as odd from s group by 1), x as (select count(*) filter (n <> span) as a, sum(odd) as b from p) select 'incomplete_axes' as \"check\", a = 0 as passed, a as value, 0 as expected from x union all select 'non_hourly_steps', b = 0, cast(b as bigint), 0 from x")
def d10_hourly_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.hourly_axis_gate(full_series(spark, sf_dir))


@query(
    f"""with {steps_sql()}, a as (select *, case when within_segment then abs(speed_ms*3.6e0 - lag(speed_ms*3.6e0) over (partition by track_id order by idx))/step_hours end as acc, (event_id % 130)*1e0 as res from steps)
select {r('max(speed_ms)')} as max_speed_ms, count(*) filter (speed_ms > 20) as n_fast, max(res) as max_residual_km, count(*) filter (res > 125) as n_far, {r('max(acc)')} as max_acceleration from a"""
)
def d11_kinematic_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = release.kinematic_caps(stepped(spark, sf_dir), (F.col("event_id") % 130).cast("double"))
    return out.withColumns({c: F.bround(c, 4) for c in ("max_speed_ms", "max_acceleration")})


_EFF = f"eff as (select track_id, case when sum(step_km) > 0 then {hav('arg_min(lat, idx)', 'arg_min(lon, idx)', 'arg_max(lat, idx)', 'arg_max(lon, idx)')}/sum(step_km) end as e from steps group by 1)"


@query(f"with {steps_sql()}, {_EFF} select count(*) as n, count(*) filter (e < 0.1) as n_low, {r('count(*) filter (e < 0.1)/cast(count(*) as double)', 6)} as rate from eff")
def d12_path_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return release.low_tail(release.path_efficiency(stepped(spark, sf_dir))).withColumn("rate", F.bround("rate", 6))


@query(f"with {GAPS} {_gate('lat', '(select count(*) from full_ where h % 83 = 0)')} union all {_gate('wind', '(select count(*) from filled)')} union all {_gate('category', '(select count(*) from filled)')}")
def d13_required_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.rint(fc.epoch_hours(F.col("time"))).cast("long")
    rows = full_series(spark, sf_dir).withColumn("lat", F.when(hour % 83 != 0, F.col("lat")))
    return gates.null_gate(rows, ["lat", "wind", "category"])


_UID = "case when event_id % 30 = 0 then null when event_id % 31 = 0 then event_id + 1 else event_id end"


@query(
    f"""with {FIX}, u as (select {_UID} as uid from fixes) {_gate('null_uid', '(select count(*) from u where uid is null)')}
union all {_gate('duplicate_uid', '(select count(*) from (select uid from u where uid is not null group by 1 having count(*) > 1))')}"""
)
def d14_unique_uid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some observed rows lack a uid, some have that of the next one."""
    return gates.uid_gate(full_series(spark, sf_dir).withColumn("uid", F.expr(_UID)), "uid", F.col("observed"))


_TRAIL = f"{FIX}, tr as (select *, sum(precip) over w as ts, count(precip) over w as vh, min(h) over (partition by track_id) as h0 from (select track_id, h, nullif(precip, 7) - 1 as precip from fixes) z window w as (partition by track_id order by h range between 23 preceding and current row))"


def _precip(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.rint(fc.epoch_hours(F.col("time"))).cast("long").alias("hour")
    return fixtures.fixes(spark, sf_dir).select("track_id", hour, (F.when(F.col("precip") != 7, F.col("precip")) - 1).alias("precip"))


@query(f"with {_TRAIL} select track_id, h as hour, {r('ts')} as trailing_sum, vh as valid_hours from tr")
def d16_trailing_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = release.trailing_sum(_precip(spark, sf_dir), "precip")
    return out.select("track_id", "hour", F.bround("trailing_sum", 4).alias("trailing_sum"), "valid_hours")


@query(
    f"""with {_TRAIL}, c as (select *, lag(precip) over w > 1 and lead(precip) over w > 1 and precip < lag(precip) over w*0.1e0 and precip < lead(precip) over w*0.1e0 as c1,
lag(ts) over w > 1 and lead(ts) over w > 1 and ts < lag(ts) over w*0.1e0 and ts < lead(ts) over w*0.1e0 as c24 from tr window w as (partition by track_id order by h))
select count(*) filter (precip is null) as n_null, count(*) filter (precip < 0) as n_negative, count(*) filter (h - h0 >= 23 and vh < 24) as n_incomplete, count(*) filter (c1) as n_collapse_1h, count(*) filter (c24) as n_collapse_24h from c"""
)
def d15_precipitation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return release.precipitation_checks(_precip(spark, sf_dir))


@query(f"with {FIX} select {r('avg(case when lat > 30 then 1.0 else 0.0 end)', 6)} as outside_fraction from fixes")
def d17_outside_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return release.outside_fraction(fixtures.fixes(spark, sf_dir), F.col("lat") > 30).withColumn("outside_fraction", F.bround("outside_fraction", 6))


# --- two releases
_NEW = """nb as (select *, sum(case when h - lag_ > 12 then 1 else 0 end) over (partition by track_id order by h) as blk from (select *, lag(h) over (partition by track_id order by h) as lag_ from fixes) z),
new_ as (select case when event_id % 11 = 0 then -1 - event_id else event_id end as uid, track_id*1000 + blk as nid from nb)"""


def new_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.rint(fc.epoch_hours(F.col("time"))).cast("long")
    w = ranks.Window.partitionBy("track_id").orderBy("time")
    rows = fixtures.fixes(spark, sf_dir).withColumn("cut", F.coalesce((hour - F.lag(hour).over(w) > 12).cast("int"), F.lit(0)))
    rows = rows.withColumn("nid", F.col("track_id") * 1000 + F.sum("cut").over(w.rowsBetween(ranks.Window.unboundedPreceding, 0)))
    return rows.select(F.when(F.col("event_id") % 11 == 0, -1 - F.col("event_id")).otherwise(F.col("event_id")).alias("uid"), "nid")  # some rows have a new uid


@query(
    f"""with {FIX}, {_NEW}, hits as (select track_id as old, nid, count(*) as hits from fixes join new_ on uid = event_id group by 1, 2),
m as (select old, sum(hits) as hits, count(*) as successors, arg_min(nid, (-hits, nid)) as p from hits group by 1), c as (select track_id as old, count(*) as n_uid from fixes group by 1)
select c.old, n_uid, cast(coalesce(hits, 0) as bigint) as hits, {r('coalesce(hits, 0)/cast(n_uid as double)', 6)} as retention, coalesce(successors, 0) as successors, cast(p as bigint) as "primary" from c left join m using (old)"""
)
def d18_identity_crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = fixtures.fixes(spark, sf_dir).select(F.col("event_id").alias("uid"), F.col("track_id").alias("id"))
    new = new_release(spark, sf_dir).withColumnRenamed("nid", "id")
    return verify.identity_crosswalk(old, new, "id").withColumn("retention", F.bround("retention", 6))


@query(
    f"""with {GAPS}, {_NEW}, st as (select track_id, segment, max(h)-min(h) >= 30 and count(*) >= 6 as ok from seg group by 1, 2), gone as (select f.event_id as uid from fixes f anti join new_ on uid = f.event_id)
select count(*) filter (not ok) as inside, count(*) filter (ok) as outside from gone join seg on seg.event_id = gone.uid join st on st.track_id = seg.track_id and st.segment = seg.segment"""
)
def v06_disposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segmented(spark, sf_dir)
    judged = strength.strength(rows.withColumn("good", F.lit(True)), ["track_id", "segment"], 30, 6, 0)
    rejected = rows.join(judged.filter(~F.col("passed")), ["track_id", "segment"], "left_semi").select(F.col("event_id").alias("uid"))
    old = fixtures.fixes(spark, sf_dir).select(F.col("event_id").alias("uid"))
    return verify.disposition(old, new_release(spark, sf_dir), rejected)


@query(
    f"""with {FIX}, {_NEW}, m as (select 'rows' as metric, cast((select count(*) from fixes) as double) as old_value, cast((select count(*) from new_) as double) as new_value
union all select 'tracks', (select count(distinct track_id) from fixes), (select count(distinct nid) from new_)) select metric, old_value, new_value, new_value - old_value as change from m"""
)
def d19_release_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    measure = lambda df, key: df.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("tracks"))
    return verify.compare_releases(measure(fixtures.fixes(spark, sf_dir), "track_id"), measure(new_release(spark, sf_dir), "nid"))


_STAGES = {
    "blocks": ("(select count(*) from decided)", "(select count(*) from decided where keep)", "(select count(*) from decided where not keep)"),
    "rows": ("(select count(*) from filled)", "(select count(*) from g where keep)", "(select count(*) from g where not keep)"),
    "published": ("(select count(*) from filled)", "(select count(*) from g where keep and k % 90 <> 7)", "(select count(*) from g where not keep)"),
}
_RECON = f"with {GAPS}, g as (select f.k, d.keep from filled f join decided d on d.track_id = f.track_id and d.block = f.block) " + " union all ".join(
    f"select '{n}' as stage, {i} as inputs, {a} as selected, {b} as rejected, {i} = {a} + {b} as passed" for n, (i, a, b) in _STAGES.items()
)


@query(_RECON)
def d20_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filled(spark, sf_dir)
    judged = gaps.gap_decision(rows)
    kept = gaps.kept_rows(rows, judged)
    dropped = gaps.rows_of_blocks(rows, judged.filter(~F.col("keep")))
    return release.reconcile({"blocks": (judged, judged.filter("keep"), judged.filter(~F.col("keep"))), "rows": (rows, kept, dropped), "published": (rows, kept.filter("k % 90 <> 7"), dropped)})


@query(f"with {GAPS}, n as (select count(*) as c from filled) select case when c > 0 then 1 else 3 end as passed, 3 as total, case when c > 0 then 'fail' else 'pass' end as status from n")
def d21_check_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.summary(gates.null_gate(full_series(spark, sf_dir), ["lat", "wind", "category"]))


@query(f"with {FIX} select user_id, count(distinct track_id) as n_events from fixes group by 1")
def d22_family_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return release.families(fixtures.fixes(spark, sf_dir), "user_id")


@query(
    f"""with {GAPS}, j as (select f.*, d.keep, d.longest_bad from filled f join decided d on d.track_id = f.track_id and d.block = f.block), x as (select count(*) filter (k % 50 = 0) as a, count(*) filter (k % 40 = 0) as m, count(*) filter (not keep) as r, count(*) filter (longest_bad > 4 and missing > 6) as l, count(*) filter (k % 60 = 7) as n from j)
select 'without_audit_id' as "check", a = 0 as passed, a as value, 0 as expected from x union all select 'method_not_allowed', m = 0, m, 0 from x union all select 'incomplete_fields', n = 0, n, 0 from x union all select 'in_rejected_block', r = 0, r, 0 from x union all select 'long_unsupported_run', l = 0, l, 0 from x"""
)
def d23_gap_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filled(spark, sf_dir)
    marked = rows.withColumns({"audit_id": F.when(F.col("k") % 50 != 0, F.col("block")), "method": F.when(F.col("k") % 40 == 0, "guess").otherwise("linear"), "vort": F.when(F.col("k") % 60 != 7, F.col("vort"))})
    return gates.gap_contract(marked, gaps.gap_decision(rows), ("linear",), ["lat", "lon", "vort", "deficit"], gaps.RUN_H)


# --- persistent class at its published width of six hours, over hourly series of long observed runs
_W = strength.PERSISTENCE_H
_LONG = "long_ as (select track_id, h, coalesce(category, 1 + (h // 4) % 5) as category, h % 29 <> 0 as observed from full_)"
_PERSIST = f"""{_LONG}, pr as (select *, h - row_number() over (partition by track_id order by h) as run from long_ where observed),
lo as (select *, case when count(*) over a = {_W} then min(category) over a end as low from pr window a as (partition by track_id, run order by h rows between current row and {_W - 1} following)),
pc as (select *, greatest(1, coalesce(max(low) over (partition by track_id, run order by h rows between {_W - 1} preceding and current row), 1)) as persistent from lo)"""


def _persistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.rint(fc.epoch_hours(F.col("time"))).cast("long")
    rows = full_series(spark, sf_dir).withColumn("hour", hour).withColumn("observed", F.col("hour") % 29 != 0)
    category = F.when(F.col("observed"), F.coalesce("category", (1 + F.floor(F.col("hour") / 4) % 5).cast("int")))
    return strength.persistent_class(rows.withColumn("category", category))


@query(f"with {GAPS}, {_PERSIST} select track_id, h as hour, cast(persistent as bigint) as persistent from pc union all select track_id, h, null from long_ where not observed")
def d08_persistent_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _persistent(spark, sf_dir).select("track_id", "hour", F.col("persistent").cast("long").alias("persistent"))


@query(
    f"""with {GAPS}, {_PERSIST}, l as (select 'category' as measure, track_id, category as class from pc union all select 'persistent', track_id, persistent from pc),
g as (select m.measure, c.class from (select distinct measure from l) m, (select unnest(range(1, 8)) as class) c), t as (select measure, track_id, max(class) as class from l group by 1, 2)
select g.measure, g.class, (select count(*) from l where l.measure = g.measure and l.class = g.class) as n_points, (select count(*) from t where t.measure = g.measure and t.class = g.class) as n_tracks from g"""
)
def d09_class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strength.class_distribution(_persistent(spark, sf_dir), ["category", "persistent"]).select("measure", F.col("class").cast("long").alias("class"), "n_points", "n_tracks")


# --- exports
@query(f"with {FIX} select track_id, row_number() over (partition by track_id order by h) - 1 as idx, {r('lat')} as lat, {r('lon')} as lon from fixes")
def e01_e02_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every track's path and decodes it again."""
    out = export.decode_paths(export.encode_paths(fixtures.fixes(spark, sf_dir)))
    return out.select("track_id", F.col("idx").cast("long").alias("idx"), F.bround("lat", 4).alias("lat"), F.bround("lon", 4).alias("lon"))


@query(
    f"""with {SYS}, m as (select *, month(start_date) as m from systems) select id, category, case category when 1 then 'L' when 2 then 'D' when 3 then 'DD' when 4 then 'CS' when 5 then 'SCS' else 'VSCS' end as code,
case category when 1 then 'Low' when 2 then 'Depression' when 3 then 'Deep Depression' when 4 then 'Cyclonic Storm' else 'Severe Cyclonic Storm' end as label,
case when m = 12 then 'ond,djf' when m <= 2 then 'djf' when m <= 5 then 'mam' when m <= 9 then 'jjas' else 'ond' end as seasons from m"""
)
def e06_class_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    category = F.col("category")
    return systems(spark, sf_dir).select(
        "id", "category", fc.lookup(category, fc.CLASS_CODES).alias("code"), fc.lookup(category, fc.CLASS_LABELS).alias("label"), F.array_join(fc.seasons(F.month("start_date")), ",").alias("seasons")
    )


@query(f"with {SYS} select cast(id as varchar) as id, cast(category as varchar) as category, cast(start_hour as varchar) as start_hour from systems where category in (2, 5)")
def e07_summary_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes a cohort's summary as CSV and reads it back."""
    path = scratch.new_path(spark, "summary")
    export.write_table(labelled_systems(spark, sf_dir).filter("category in (2, 5)"), ["id", "category", "start_hour"], path)
    return spark.read.csv(path, header=True)


@query(f"with {GAPS} select track_id, h as hour, {r('lat', 9)} as lat, case when observed then 'observed_support' else 'interpolated' end as support from full_ where track_id in (select track_id from fixes group by 1 having max(wind) > 20)")
def e08_fixes_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = full_series(spark, sf_dir).withColumn("hour", F.rint(fc.epoch_hours(F.col("time"))).cast("long"))
    few = points.groupBy("track_id").agg(F.max("wind").alias("w")).filter("w > 20")
    return export.fixes_table(points, few, ["hour", "lat"]).withColumn("lat", F.bround("lat", 9))


@query(f"with {FIX}, n as (select user_id, track_id, count(*) as n from fixes group by 1, 2 having count(*) >= 2) select user_id, 'MultiLineString' as kind, count(*) as n_lines, cast(sum(n) as bigint) as n_points from n group by 1")
def e09_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features as JSON lines, read back as numbers of lines and points."""
    points = stepped(spark, sf_dir, "user_id")
    lines = export.geojson(kinematics.split_path(points, "user_id"), points.groupBy("user_id").agg(F.count("*").alias("n")), "user_id")
    shape = "type string, geometry struct<type:string,coordinates:array<array<array<double>>>>"
    read = lines.select("user_id", F.from_json("value", shape).alias("f"))
    c = F.col("f.geometry.coordinates")
    return read.select("user_id", F.col("f.geometry.type").alias("kind"), F.size(c).cast("long").alias("n_lines"), F.size(F.flatten(c)).cast("long").alias("n_points"))


@query(f"with {SYS} select '{{\"filters\": {{\"classes\": [5]}}, \"source_sha256\": \"00\"}}' as value union all select '{{\"id\":' || id || '}}' from systems where category = 5")
def e10_query_recipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    few = systems(spark, sf_dir).filter("category = 5").select(F.col("id").alias("track_id"))
    return export.query_recipe(few, {"classes": [5]}, "00")


@query("select s_suppkey, 'v' || s_suppkey || '.' || (s_nationkey % 7) || case when s_suppkey % 2 = 0 then '.1' else '' end as version from supplier")
def e11_catalogue_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.concat(F.lit("lps_v"), F.concat_ws(".", "s_suppkey", F.col("s_nationkey") % 7, F.when(F.col("s_suppkey") % 2 == 0, "1")))
    shapes = [("lps_data/", "-era5.parquet"), ("lps_v9.9/", "_core.parquet"), ("", "_lps_core.parquet"), ("a/old_lps_x_", "..2_lps_v8.8.parquet"), ("lps_v/lps_vx_", "")]
    name = F.get(F.array(*(F.concat(F.lit(before), number, F.lit(after)) for before, after in shapes)), F.col("s_suppkey") % len(shapes))
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", export.catalogue_version(name).alias("version"))


@query(f"with {FIX} select track_id, count(*) as n, {r('max(wind)')} as top from fixes group by 1")
def e12_nested_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes one nested document a track and reads them back."""
    path = scratch.new_path(spark, "documents")
    export.write_documents(summary.detail_series(fixtures.fixes(spark, sf_dir), ("wind", "category")), path)
    read = spark.read.schema("track_id long, wind array<double>, category array<int>").json(path)
    return read.select("track_id", F.size("wind").cast("long").alias("n"), F.bround(F.array_max("wind"), 4).alias("top"))


@query(
    f"""with {FIX}, t as (select track_id, '{{"track_id":' || track_id || ',"hour":[' || string_agg(h, ',' order by h) || '],"category":[' || string_agg(category, ',' order by h) || ']}}' as line from fixes group by 1)
select cast(track_id % 7 as varchar) as part, sha256(string_agg(line || chr(10), '' order by track_id)) as sha256, count(*) as n_lines, cast(sum(length(line) + 1) as bigint) as raw_bytes, true as passed from t group by 1"""
)
def e12_q01_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document a track in parts that are named by their digests, with a manifest; written twice, and held against it."""
    hour = F.rint(fc.epoch_hours(F.col("time"))).cast("long")
    nested = fixtures.fixes(spark, sf_dir).groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct(hour.alias("hour"), "category"))).alias("s"))
    lines = nested.select("track_id", (F.col("track_id") % 7).alias("part"), F.to_json(F.struct("track_id", F.col("s.hour").alias("hour"), F.col("s.category").alias("category"))).alias("value"))
    path = scratch.new_path(spark, "package")
    package.write_package(lines.filter("track_id % 2 = 0"), path, "part", ["track_id"], "tracks")
    package.write_package(lines, path, "part", ["track_id"], "tracks")
    package.prune_package(spark, path)
    return package.verify_package(spark, path).select("part", "sha256", "n_lines", "raw_bytes", "passed")


@query(f"with {FIX} select event_id, {r('wind*10', 0)}/10 as wind from fixes")
def e13_unscale(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = summary.scaled_columns(fixtures.fixes(spark, sf_dir), {"wind": 10}, "event_id")
    return stored.select("event_id", fc.unscaled(F.col("wind"), 10, -1).alias("wind"))
