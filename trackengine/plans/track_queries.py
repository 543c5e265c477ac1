"""Queries over tracks: motion, runs, summaries, ranks and gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackengine.functions.columns import epoch_hours
from trackengine.operators import gaps, kinematics, order_runs, ranks, strength, summary
from trackengine.plans import fixtures
from trackengine.plans.registry import query
from trackengine.sources import scratch


def hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"least(1.0, power(sin(radians({lat2}-({lat1}))/2),2)+cos(radians({lat1}))*cos(radians({lat2}))*power(sin(radians({lon2}-({lon1}))/2),2))"
    return f"(2*6371.0088*atan2(sqrt({a}), sqrt(1-{a})))"


H = "cast(round_even(epoch(time)/3600.0, 0) as bigint)"
FIX = f"fixes as (select *, {H} as h from ({fixtures.FIXES}) f0)"


def steps_sql(parent: str = "track_id") -> str:
    w = f"over (partition by {parent} order by time, track_id)"
    return f"""{FIX}, st as (select *, row_number() {w} - 1 as idx, cast(h - lag(h) {w} as double) as step_hours,
  {hav(f'(lag(lat) {w})', f'(lag(lon) {w})', 'lat', 'lon')} as step_km, lag(track_id) {w} = track_id as within_segment from fixes),
steps as (select *, case when within_segment and step_hours > 0 then step_km*1000/(step_hours*3600) end as speed_ms from st)"""


def r(x: str, n: int = 4) -> str:
    return f"round_even({x}, {n})"


def hour():
    return F.rint(epoch_hours(F.col("time"))).cast("long")


def stepped(spark: SparkSession, sf_dir: str, parent: str = "track_id") -> DataFrame:
    return kinematics.steps(fixtures.fixes(spark, sf_dir), parent)


@query(f"with {steps_sql('user_id')} select user_id, track_id, idx, h as hour, step_hours, {r('step_km')} as step_km, within_segment, {r('speed_ms')} as speed_ms from steps")
def k01_k05_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stepped(spark, sf_dir, "user_id").select(
        "user_id", "track_id", F.col("idx").cast("long"), hour().alias("hour"), "step_hours", F.bround("step_km", 4).alias("step_km"), "within_segment", F.bround("speed_ms", 4).alias("speed_ms")
    )


@query(f"with {steps_sql('user_id')} select user_id, idx, {r('step_hours', 1)} as gap_hours, 999 as marker from steps where not within_segment")
def k06_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kinematics.breaks(stepped(spark, sf_dir, "user_id"), "user_id")


@query(
    f"with {steps_sql('user_id')} select user_id, cast({r('coalesce(sum(step_km) filter (within_segment), 0)', 0)} as bigint) as distance_km, {r('coalesce(max(speed_ms), 0)')} as max_speed_ms, coalesce(max(step_hours), 0) as max_gap_hours from steps group by user_id"
)
def k07_k08_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kinematics.motion(stepped(spark, sf_dir, "user_id"), "user_id")
    return out.withColumn("max_speed_ms", F.bround("max_speed_ms", 4))


# --- gaps; ``full`` is the fixes and the interpolated hours
GAPS = f"""{FIX}, pairs as (select track_id, lag(h) over w as h0, h as h1, lag(lat) over w as lat0, lat as lat1, lag(lon) over w as lon0, lon as lon1,
  lag(vort) over w as vort0, vort as vort1, lag(deficit) over w as deficit0, deficit as deficit1 from fixes window w as (partition by track_id order by time)),
blocks as (select *, row_number() over (partition by track_id order by h0) as block, h1 - h0 - 1 as missing, {hav('lat0', 'lon0', 'lat1', 'lon1')}*1000/((h1-h0)*3600) as speed_ms from pairs where h1 - h0 > 1),
ks as (select *, unnest(range(1, missing + 1)) as k from blocks),
filled as (select track_id, block, missing, speed_ms, h0, k, h0 + k as h, lat0+(lat1-lat0)*(k/cast(missing+1 as double)) as lat, lon0+(lon1-lon0)*(k/cast(missing+1 as double)) as lon,
  vort0+(vort1-vort0)*(k/cast(missing+1 as double)) as vort, deficit0+(deficit1-deficit0)*(k/cast(missing+1 as double)) as deficit,
  (h0*31 + k*17) % 300 as vort_km, (h0*13 + k*29) % 300 as mslp_km from ks),
sup as (select *, (vort >= 5 and vort_km <= 225) or (deficit >= 4 and mslp_km <= 250) as supported from filled),
bad as (select *, sum(cast(supported as int)) over (partition by track_id, block order by k) as ok from sup),
bad2 as (select track_id, block, ok, count(*) filter (not supported) as run from bad group by 1, 2, 3),
judged as (select s.track_id, s.block, any_value(missing) as missing, any_value(h0) as h0, any_value(speed_ms) as speed_ms, count(*) filter (supported) as n_supported, any_value(b.longest) as longest_bad
  from sup s join (select track_id, block, max(run) as longest from bad2 group by 1, 2) b on b.track_id = s.track_id and b.block = s.block group by 1, 2),
decided as (select *, case when missing <= 6 and speed_ms <= 20 then true when missing <= 11 then n_supported/cast(missing as double) >= 0.65 and longest_bad <= 4
  else n_supported/cast(missing as double) >= 0.75 and longest_bad <= 4 end as keep from judged),
seg as (select f.*, coalesce(sum(case when d.keep = false then 1 else 0 end) over (partition by f.track_id order by f.h rows between unbounded preceding and 1 preceding), 0) as segment
  from fixes f left join decided d on d.track_id = f.track_id and d.h0 = f.h),
full_ as materialized (select track_id, h, lat, lon, true as observed, wind, category from fixes union all select track_id, h, lat, lon, false, null, null from filled)"""


def filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gaps.fill_hourly(gaps.gap_blocks(fixtures.fixes(spark, sf_dir)))
    vort_km, mslp_km = (F.col("h0") * 31 + F.col("k") * 17) % 300, (F.col("h0") * 13 + F.col("k") * 29) % 300
    return rows.withColumn("supported", gaps.supported_hour(vort_km, mslp_km))


def full_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes and interpolated hours as points with ``observed``."""
    points = fixtures.fixes(spark, sf_dir)
    extra = gaps.fill_hourly(gaps.gap_blocks(points)).select("track_id", F.expr("timestampadd(HOUR, cast(hour as int), timestamp_ntz '1970-01-01 00:00:00')").alias("time"), "lat", "lon", F.lit(False).alias("observed"))
    return points.withColumn("time", F.col("time").cast("timestamp_ntz")).withColumn("observed", F.lit(True)).unionByName(extra, allowMissingColumns=True)


def segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.resegment(fixtures.fixes(spark, sf_dir), gaps.gap_decision(filled(spark, sf_dir)))


@query(f"with {GAPS} select track_id, block, h0, h1, missing, {r('speed_ms')} as speed_ms from blocks")
def d01_gap_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.gap_blocks(fixtures.fixes(spark, sf_dir)).select("track_id", F.col("block").cast("long"), "h0", "h1", "missing", F.bround("speed_ms", 4).alias("speed_ms"))


@query(f"with {GAPS} select track_id, block, k, h as hour, {r('lat', 9)} as lat, {r('lon', 9)} as lon, {r('vort', 9)} as vort, {r('deficit', 9)} as deficit, supported from sup")
def d02_d03_fill_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filled(spark, sf_dir).select("track_id", F.col("block").cast("long"), "k", "hour", *(F.bround(c, 9).alias(c) for c in ("lat", "lon", "vort", "deficit")), "supported")


@query(f"with {GAPS} select track_id, block, missing, n_supported, longest_bad, keep from decided")
def d04_gap_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.gap_decision(filled(spark, sf_dir)).select("track_id", F.col("block").cast("long"), "missing", "n_supported", "longest_bad", "keep")


@query(f"with {GAPS} select track_id, cast(segment as bigint) as segment, count(*) as n, min(h) as first_hour, max(h) as last_hour from seg group by 1, 2")
def d05_resegment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segmented(spark, sf_dir)
    return rows.groupBy("track_id", "segment").agg(F.count("*").alias("n"), F.min("hour").alias("first_hour"), F.max("hour").alias("last_hour"))


_STRONG = """qual as (select *, deficit >= 3.495224e0 and vort >= 7.036606e0 and category >= 1 and lon between 65 and 100 and lat between 0 and 32 as good from seg),
strong as (select track_id, segment, max(h) - min(h) as hours, count(*) as n, count(*) filter (good) as n_good from qual group by 1, 2)"""


@query(f"with {GAPS}, {_STRONG} select track_id, cast(segment as bigint) as segment, hours, n, n_good, hours >= 30 and n >= 6 and n_good >= 1 as passed from strong")
def d06_d07_strength_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segmented(spark, sf_dir).withColumn("good", strength.qualifying(["deficit", "vort", "category", "lon", "lat"]))
    out = strength.strength(rows, ["track_id", "segment"], min_hours=30, min_observed=6, min_qualifying=1)
    return out.select("track_id", "segment", "hours", F.col("n_observed").alias("n"), F.col("n_qualifying").alias("n_good"), "passed")


_ISLANDS = "row_number() over (partition by track_id order by h) - 1 as idx"
_RUNS = f"""rn as (select *, {_ISLANDS} from full_),
isl as (select *, idx - row_number() over (partition by track_id, observed order by h) as g from rn),
runs as (select track_id, min(idx) as "start", max(idx) as "end" from isl where not observed group by track_id, g)"""


@query(f'with {GAPS}, {_RUNS} select track_id, "start" as run_start, "end" as run_end from runs')
def k09_missing_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kinematics.missing_runs(full_series(spark, sf_dir), F.col("observed"))
    return out.select("track_id", F.col("start").cast("long").alias("run_start"), F.col("end").cast("long").alias("run_end"))


@query(f'with {GAPS}, {_RUNS} select f.track_id, coalesce(max("end" - "start" + 1), 0) as max_missing_run_hours from (select distinct track_id from full_) f left join runs using (track_id) group by 1')
def k10_max_missing_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kinematics.max_missing_run(full_series(spark, sf_dir), F.col("observed"))
    return out.withColumn("max_missing_run_hours", F.col("max_missing_run_hours").cast("long"))


@query(
    f"""with {FIX}, a as (select *, {_ISLANDS} from fixes), b as (select *, idx - row_number() over (partition by track_id, category order by h) as g from a)
select track_id, min(idx) as run_start, max(idx) as run_end, category as value from b group by track_id, category, g"""
)
def k11_run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kinematics.run_lengths(fixtures.fixes(spark, sf_dir), F.col("category"))
    return out.select("track_id", F.col("start").cast("long").alias("run_start"), F.col("end").cast("long").alias("run_end"), "value")


@query(f"with {FIX} select track_id, {_ISLANDS}, category as value from fixes")
def k12_expand_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kinematics.expand_runs(kinematics.run_lengths(fixtures.fixes(spark, sf_dir), F.col("category")))
    return out.withColumn("idx", F.col("idx").cast("long"))


@query(f"with {FIX} select track_id, h as abs_hour, h - min(h) over (partition by track_id) as hour from fixes")
def k13_hours_since_genesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kinematics.hours_since_genesis(fixtures.fixes(spark, sf_dir))
    return out.select("track_id", F.rint(epoch_hours(F.col("time"))).cast("long").alias("abs_hour"), F.col("hour").cast("long").alias("hour"))


@query(f"with {steps_sql()} select track_id, coalesce(quantile_cont(step_hours, 0.5) filter (step_hours > 0), 1) as typical_step from steps group by 1")
def k14_typical_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kinematics.typical_step(stepped(spark, sf_dir))


@query(
    f"""with {steps_sql('user_id')}, b as (select *, sum(case when within_segment = false then 1 else 0 end) over (partition by user_id order by idx) as brk from steps),
v as (select * from b where category <> 3), n as (select *, case when h - lag(h) over w > 6 or lag(brk) over w <> brk then 1 else 0 end as fresh from v window w as (partition by user_id order by idx))
select user_id, idx, {r('wind')} as value, cast(sum(fresh) over (partition by user_id order by idx) as bigint) as piece from n"""
)
def k15_line_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kinematics.line_groups(stepped(spark, sf_dir, "user_id"), F.when(F.col("category") != 3, F.col("wind")), "user_id")
    return out.select("user_id", F.col("idx").cast("long"), F.bround("value", 4).alias("value"), "piece")


@query(
    f"""with {steps_sql('user_id')}, m as (select *, max(idx) over (partition by user_id) as last_, day(time) < 0 or month(time) in (1, 3) as inside from steps),
l as (select *, case when within_segment = false or not coalesce(lag(inside) over (partition by user_id order by idx), true) then 1 else 0 end as fresh from m),
g as (select *, sum(fresh) over (partition by user_id order by idx) as line from l)
select user_id, idx, cast(line as bigint) as line, {r('lat')} as lat, {r('lon')} as lon from g where inside and (idx % 3 = 0 or idx = last_)"""
)
def k16_thin_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kinematics.thin_path(stepped(spark, sf_dir, "user_id"), 3, "user_id", (1, 3))
    return out.select("user_id", F.col("idx").cast("long"), "line", F.bround("lat", 4).alias("lat"), F.bround("lon", 4).alias("lon"))


@query(f"with {steps_sql('user_id')}, n as (select user_id, idx, cast(ceil(count(*) over p / 10.0) as bigint) as stride, max(idx) over p as last_ from steps window p as (partition by user_id)) select user_id, idx from n where idx % stride = 0 or idx = last_")
def k17_stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kinematics.stride_sample(stepped(spark, sf_dir, "user_id"), "user_id", 10).select("user_id", F.col("idx").cast("long"))


@query(
    f"""with {steps_sql('user_id')}, p as (select *, sum(case when within_segment = false then 1 else 0 end) over (partition by user_id order by idx) as piece from steps),
n as (select *, count(*) over (partition by user_id, piece) as size_ from p) select user_id, cast(piece as bigint) as piece, idx, {r('lat')} as lat, {r('lon')} as lon from n where size_ >= 2"""
)
def k18_split_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kinematics.split_path(stepped(spark, sf_dir, "user_id"), "user_id")
    return out.select("user_id", "piece", F.col("idx").cast("long"), F.bround("lat", 4).alias("lat"), F.bround("lon", 4).alias("lon"))


# --- summaries
_PEAKS = ", ".join(f"max({m}) as peak_{m}, month(arg_min(time, (-{m}, time))) as month_{m}" for m in summary.LARGEST) + ", min(mslp) as peak_mslp, month(arg_min(time, (mslp, time))) as month_mslp"


@query(f"with {FIX} select track_id, {_PEAKS} from fixes group by 1")
def a02_a03_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = summary.peaks(fixtures.fixes(spark, sf_dir))
    return out.select("track_id", *(F.col(c).cast("long") if c.startswith("month") else F.col(c) for c in out.columns[1:]))


_ENDS = "select track_id, min(h) as start_hour, max(h) as end_hour, year(min(time)) as start_year, max(h) - min(h) as duration_hours, arg_min(lat, h) as genesis_lat, arg_min(lon, h) as genesis_lon, arg_max(lat, h) as lysis_lat, arg_max(lon, h) as lysis_lon from fixes group by 1"


@query(f"with {FIX}, e as ({_ENDS}) select * exclude (start_year), cast(start_year as bigint) as start_year from e")
def a04_a07_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.endpoints(fixtures.fixes(spark, sf_dir)).withColumn("start_year", F.col("start_year").cast("long"))


_SUPPORT = """select track_id, count(*) as n_rows, count(*) filter (observed) as n_observed, round_even(count(*) filter (observed)/cast(count(*) as double), 4) as observed_fraction,
  cast(least(6, greatest(1, coalesce(max(category) filter (observed), 1))) as bigint) as peak_class, round_even(min(lon), 4) as min_lon, round_even(max(lat), 4) as max_lat from full_ group by 1"""


@query(f"with {GAPS} {_SUPPORT}")
def a06_a08_a09_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = summary.support(full_series(spark, sf_dir))
    return out.select("track_id", "n_rows", "n_observed", F.bround("observed_fraction", 4).alias("observed_fraction"), F.col("peak_class").cast("long").alias("peak_class"), "min_lon", "max_lat")


@query(f"with {FIX} select user_id, cast(bit_or(1 << (month(time) - 1)) as bigint) as month_mask, count(distinct track_id) as n_segments from fixes group by 1")
def a05_month_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = summary.support(fixtures.fixes(spark, sf_dir).withColumn("observed", F.lit(True)), "user_id", "track_id")
    return out.select("user_id", F.col("month_mask").cast("long").alias("month_mask"), "n_segments")


_WHOLE = f"""{GAPS}, {_RUNS}, w as (select user_id, track_id, h, lat, lon, observed from (select cast(floor(track_id/100) as bigint) as user_id, * from full_) z),
ws as (select *, h - lag(h) over o as dh, {hav('(lag(lat) over o)', '(lag(lon) over o)', 'lat', 'lon')} as km, lag(track_id) over o = track_id as ins from w window o as (partition by user_id order by h, track_id)),
wi as (select *, row_number() over (partition by user_id order by h) as i from w), wg as (select *, i - row_number() over (partition by user_id, observed order by h) as g from wi),
wr as (select user_id, max(n) as run from (select user_id, g, count(*) as n from wg where not observed group by 1, 2) q group by 1),
wa as (select user_id, cast(max(h) - min(h) as bigint) as duration_hours, count(distinct track_id) as n_segments, avg(cast(observed as double)) as obs,
  cast(round_even(coalesce(sum(km) filter (ins), 0), 0) as bigint) as distance_km, coalesce(max(km*1000/(dh*3600)) filter (ins and dh > 0), 0) as speed, coalesce(max(dh), 0) as gap from ws group by 1),
wq as (select wa.*, coalesce(run, 0) as run from wa left join wr using (user_id)),
wf as (select *, (case when run > 24 then 1 else 0 end) + (case when speed > 30 then 2 else 0 end) + (case when duration_hours > 720 then 4 else 0 end) + (case when distance_km > 8000 then 8 else 0 end)
  + (case when obs < 0.5 then 16 else 0 end) + (case when n_segments > 1 then 32 else 0 end) as flags,
  case when n_segments <= 1 and obs >= 0.75 and run <= 12 and speed <= 29.5 then 0 when n_segments <= 3 and obs >= 0.5 and run <= 36 and speed <= 29.5 then 1 else 2 end as severity from wq)"""


def _user_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return full_series(spark, sf_dir).withColumn("user_id", F.floor(F.col("track_id") / 100).cast("long"))


@query(
    f"with {_WHOLE} select user_id, duration_hours, n_segments, distance_km, {r('speed')} as max_speed_ms, cast(run as bigint) as max_missing_run_hours, cast(flags as bigint) as qc_flags, cast(severity as bigint) as qc_severity from wf"
)
def a01_a10_a11_track_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = summary.track_summary(_user_series(spark, sf_dir), "user_id", "track_id")
    return out.select(
        "user_id", "duration_hours", "n_segments", "distance_km", F.bround("max_speed_ms", 4).alias("max_speed_ms"), *(F.col(c).cast("long").alias(c) for c in ("max_missing_run_hours", "qc_flags", "qc_severity"))
    )


@query(
    f"with {_WHOLE} select user_id, {r('cast(gap as double)', 1)} as max_gap_h, {r('speed', 1)} as max_speed_ms, cast({r('obs*100', 0)} as bigint) as coverage_pct, cast(flags as bigint) as flags, cast(severity as bigint) as severity, n_segments - 1 as break_count from wf"
)
def a12_qc_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = summary.qc_record(summary.track_summary(_user_series(spark, sf_dir), "user_id", "track_id"), "user_id")
    return out.select("user_id", "max_gap_h", "max_speed_ms", *(F.col(c).cast("long").alias(c) for c in ("coverage_pct", "flags", "severity")), "break_count")


@query(
    f"with {GAPS} select min(h) as first_hour, max(h) as last_hour, min(lat) as min_lat, max(lat) as max_lat, min(lon) as min_lon, max(lon) as max_lon, count(*) as n_rows, count(*) filter (observed) as n_observed, count(*) filter (not observed) as n_posterior, count(distinct track_id) as n_tracks from full_"
)
def a13_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.coverage(full_series(spark, sf_dir))


@query(f"with {FIX} select event_id, cast(coalesce({r('wind*10', 0)}, -1) as bigint) as wind, cast(coalesce({r('lat*10000', 0)}, -1) as bigint) as lat, cast(coalesce({r('nullif(category, 3)*1000', 0)}, -1) as bigint) as category from fixes")
def a14_scaled_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.fixes(spark, sf_dir).withColumn("category", F.when(F.col("category") != 3, F.col("category")))
    out = summary.scaled_columns(rows, {"wind": 10, "lat": 10000, "category": 1000}, "event_id")
    return out.select("event_id", *(F.col(c).cast("long").alias(c) for c in ("wind", "lat", "category")))


@query(f"with {FIX} select track_id, {_ISLANDS}, wind, cast(least(category, 6) as bigint) as category from fixes")
def a15_detail_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = summary.detail_series(fixtures.fixes(spark, sf_dir), ("wind", "category"))
    flat = nested.select("track_id", F.posexplode(F.arrays_zip("wind", "category")).alias("idx", "p"))
    return flat.select("track_id", F.col("idx").cast("long").alias("idx"), "p.wind", F.col("p.category").cast("long").alias("category"))


# --- ranks
def pct_sql(v: str, rows: str, over: str = "") -> str:
    return f"cast({r(f'100.0*(rank() over ({over} order by {v}) + (count(*) over (partition by {rows}) - 1)/2.0)/count(*) over ({over})', 0)} as bigint)"


@query(
    f"with {FIX}, p as (select track_id, max(wind) as wind, min(mslp) as mslp from fixes group by 1) select track_id, {pct_sql('wind', 'wind')} as wind_pct, {pct_sql('-mslp', 'mslp')} as mslp_pct from p"
)
def w01_percentile_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = summary.peaks(fixtures.fixes(spark, sf_dir)).select("track_id", F.col("peak_wind").alias("wind"), F.col("peak_mslp").alias("mslp"))
    out = ranks.percentile_rank(ranks.percentile_rank(p, "wind"), "mslp", ascending=False)
    return out.select("track_id", F.col("wind_pct").cast("long").alias("wind_pct"), F.col("mslp_pct").cast("long").alias("mslp_pct"))


SYS = f"systems as (select *, cast(year(start_date) as bigint) as start_year, cast(epoch(cast(start_date as timestamp))/3600 as bigint) as start_hour from ({fixtures.SYSTEMS}) s0)"


def systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.systems(spark, sf_dir).withColumns({"start_year": F.year("start_date").cast("long"), "start_hour": F.date_diff("start_date", F.lit("1970-01-01").cast("date")).cast("long") * 24})


@query(
    f"with {SYS}, l as (select *, row_number() over (partition by start_year, category order by start_hour, id) as n from systems) select id, concat_ws(' ', case category when 1 then 'L' when 2 then 'D' when 3 then 'DD' when 4 then 'CS' when 5 then 'SCS' else 'VSCS' end, start_year, case when n < 10 then '0' || n else '' || n end) as label from l"
)
def w03_fallback_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.fallback_labels(systems(spark, sf_dir)).select("id", "label")


@query(
    f"""with {SYS}, n as (select id, start_year, category, lag(id) over w as p, lead(id) over w as x, last_value(id) over (w rows between unbounded preceding and unbounded following) as l, first_value(id) over (w rows between unbounded preceding and unbounded following) as f
from systems window w as (partition by start_year, category order by metric desc, id)) select id, start_year, category, coalesce(p, l) as previous, coalesce(x, f) as next from n"""
)
def w06_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.neighbours(systems(spark, sf_dir), [F.desc("metric"), F.asc("id")], "id", ["start_year", "category"])


_TOP = f"""{SYS}, t as (select id, start_hour, dur_days*24 as duration_hours, metric, case id % 4 when 0 then 'high' when 1 then 'medium' when 2 then 'low' end as confidence,
  {pct_sql('metric', 'metric')} as metric_pct from systems)"""
_TOP_ORDERS = {
    "newest": "start_hour desc",
    "oldest": "start_hour",
    "longest": "duration_hours desc",
    "farthest": "metric desc",
    "match": "coalesce(case confidence when 'high' then 0 when 'medium' then 1 when 'low' then 2 end, 3), metric_pct desc",
    "strongest": "metric_pct desc, metric desc",
}


@query(f"with {_TOP} " + " union all ".join(f"select '{n}' as listing, id, place from (select id, row_number() over (order by {o}, id) as place from t) where place <= 12" for n, o in _TOP_ORDERS.items()))
def w07_top_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranks.percentile_rank(systems(spark, sf_dir), "metric")
    confidence = F.when(F.col("id") % 4 == 0, "high").when(F.col("id") % 4 == 1, "medium").when(F.col("id") % 4 == 2, "low")
    rows = rows.select("id", "start_hour", (F.col("dur_days") * 24).alias("duration_hours"), "metric", F.col("metric").alias("distance_km"), "metric_pct", confidence.alias("confidence"))
    out = None
    for name in _TOP_ORDERS:
        order = ranks.listing_order(name)
        few = ranks.top(rows, order)
        w = F.row_number().over(ranks.Window.partitionBy(F.lit(name)).orderBy(*order))
        one = few.select(F.lit(name).alias("listing"), "id", w.cast("long").alias("place"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"with {SYS} select id, metric, row_number() over (order by metric desc, id) as rank from systems qualify rank <= 50")
def w08_rank_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.rank_listing(systems(spark, sf_dir), "metric").select("id", "metric", F.col("rank").cast("long").alias("rank"))


@query(
    f"""with {SYS}, kept as (select id, case when id % 9 = 2 then metric * 0.5e0 else metric end as metric from systems where id % 7 <> 3),
p as (select id, metric, rank() over (order by metric) as k, count(*) over (partition by metric) as ties, count(*) over () as n from kept)
select id, cast(round_even(100.0*(k + (ties - 1)/cast(2 as double))/n, 0) as bigint) as metric_pct from p"""
)
def w01_ranks_after_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks after three releases that add, remove and change systems, from runs of counts."""
    rows = systems(spark, sf_dir).select("id", "metric")
    half = F.when(F.col("id") % 9 == 2, F.col("metric") * F.lit(0.5)).otherwise(F.col("metric"))
    first = rows.filter("id % 4 <> 0")
    runs = order_runs.OrderRuns.create(first, scratch.new_path(spark, "order"), "metric")
    runs.apply(rows.filter("id % 4 = 0"), rows.filter("id % 4 <> 0 and id % 7 = 3"), "metric")
    runs.apply(rows.limit(0), rows.filter("id % 4 = 0 and id % 7 = 3"), "metric")
    kept = rows.filter("id % 7 <> 3")
    changed = kept.filter("id % 9 = 2")
    runs.apply(changed.withColumn("metric", half), changed, "metric")
    return runs.rank_rows(kept.withColumn("metric", half), "metric", "metric_pct").select("id", F.col("metric_pct").cast("long").alias("metric_pct"))
