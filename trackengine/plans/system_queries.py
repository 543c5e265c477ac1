"""Queries over places, cohorts, climatology, composites and regional series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackengine.functions import columns as fc
from trackengine.operators import bitmaps, climatology, cohort, composites, cover, kinematics, ranks, regions, search_index, sketches, spatial, summary
from trackengine.plans import fixtures
from trackengine.plans.registry import query
from trackengine.plans.track_queries import FIX, SYS, pct_sql, r, stepped, steps_sql, systems
from trackengine.sources import daily_series, scratch

# --- places
_IN = f"""{FIX}, c as ({fixtures.CENTRES}), hits as (select event_id, track_id, region from fixes join c on abs(lon - cx)/5 + abs(lat - cy)/2.5 < 1)"""


@query(f"with {_IN} select event_id, region from hits")
def s01_points_in_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.points_in_polygons(fixtures.fixes(spark, sf_dir), fixtures.edges(spark, sf_dir), "event_id")


@query(f"with {_IN} select event_id, region from hits")
def s01_points_in_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same points by a hierarchical cover of the regions."""
    made = cover.cover(fixtures.edges(spark, sf_dir))
    return cover.points_in_cover(fixtures.fixes(spark, sf_dir), made, "event_id")


_STARTS = "starts as (select track_id, arg_min(event_id, h) as event_id, arg_min(lat, h) as lat, arg_min(lon, h) as lon, min(h) as start_hour from fixes group by 1)"


def starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.min(F.struct("time", "event_id", "lat", "lon")).alias("f")
    return fixtures.fixes(spark, sf_dir).groupBy("track_id").agg(first).select("track_id", "f.event_id", "f.lat", "f.lon")


@query(
    f"""with {_IN}, {_STARTS}, m as (select s.track_id, lat, lon, coalesce(bool_or(region < 10), false) as land, coalesce(bool_or(region >= 10), false) as sea from starts s left join hits using (event_id) group by 1, 2, 3)
select track_id, case when land then 'india' when sea and lat between 0 and 30 and lon between 77.5 and 100 then 'bob' when sea and lat between 0 and 30 and lon >= 45 and lon < 77.5 then 'arabian' else 'other' end as genesis_region from m"""
)
def s02_f08_genesis_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = fixtures.edges(spark, sf_dir)
    return spatial.genesis_region(starts(spark, sf_dir), edges.filter("region < 10"), edges.filter("region >= 10"), "track_id")


@query(f"with {_IN} select distinct track_id, region from hits")
def s03_f09_crosses_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.crosses_region(fixtures.fixes(spark, sf_dir), fixtures.edges(spark, sf_dir), "track_id", "event_id")


@query(f"with {FIX} select track_id from fixes group by 1 having max(lon) >= 70 and min(lon) <= 80 and max(lat) >= 10 and min(lat) <= 20")
def s04_bbox_intersects(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = fixtures.fixes(spark, sf_dir).groupBy("track_id").agg(*(f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))))
    return bounds.filter(spatial.bbox_intersects(70, 80, 10, 20)).select("track_id")


@query(
    f"""with {steps_sql()}, j as (select *, lag(lat) over w as lat0, lag(lon) over w as lon0 from steps window w as (partition by track_id order by idx)),
n as (select *, case when lat0 is null then 0 else greatest(1, cast(ceil(greatest(abs(lat-lat0), abs(lon-lon0))/0.5e0) as bigint)) end as n from j),
k as (select *, unnest(range(0, n + 1)) as k from n),
c as (select distinct track_id, cast(floor((case when n > 0 then lon0+(lon-lon0)*(k/cast(n as double)) else lon end)/0.5e0) as bigint) as cell_x, cast(floor((case when n > 0 then lat0+(lat-lat0)*(k/cast(n as double)) else lat end)/0.5e0) as bigint) as cell_y from k)
select cell_x, cell_y, count(*) as n_tracks from c group by 1, 2"""
)
def s05_track_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.track_density(stepped(spark, sf_dir))


#: Sets of months that densities are asked for.
_MONTH_SETS = ((1,), (2, 3), (1, 2), (3, 4, 5), tuple(range(1, 13)))
_SHIFTED = f"""{steps_sql()}, sh as (select *, cast(month(make_timestamp((h + 672*(track_id % 5))*3600000000)) as int) as m1 from steps),
sj as (select *, lag(lat) over w as lat0, lag(lon) over w as lon0, lag(m1) over w as m0 from sh window w as (partition by track_id order by idx)),
ms as (select unnest([{', '.join(f"'{','.join(map(str, m))}'" for m in _MONTH_SETS)}]) as months, unnest([{', '.join(str(list(m)) for m in _MONTH_SETS)}]) as ml)"""


def _shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of tracks that begin in January to May; some last over the end of a month."""
    later = F.expr("time + make_dt_interval(cast(28 * (track_id % 5) as int))")
    return stepped(spark, sf_dir).withColumn("time", later).withColumn("track_no", F.col("track_id"))


@query(
    f"""with {_SHIFTED}, n as (select months, sj.*, case when lat0 is null or not list_contains(ml, m0) then 0 else greatest(1, cast(ceil(greatest(abs(lat-lat0), abs(lon-lon0))/0.5e0) as bigint)) end as n from sj join ms on list_contains(ml, m1)),
k as (select *, unnest(range(0, n + 1)) as k from n), few as (select track_id from fixes group by 1 having max(wind) > 15),
c as (select distinct months, track_id, cast(floor((case when n > 0 then lon0+(lon-lon0)*(k/cast(n as double)) else lon end)/0.5e0) as bigint) as cell_x, cast(floor((case when n > 0 then lat0+(lat-lat0)*(k/cast(n as double)) else lat end)/0.5e0) as bigint) as cell_y from k)
select months, 'all' as cohort, cell_x, cell_y, count(*) as n_tracks from c group by 1, 3, 4
union all select months, 'strong', cell_x, cell_y, count(*) from c where track_id in (select track_id from few) group by 1, 3, 4"""
)
def s05_density_of_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Densities of five sets of months and two cohorts, from bitmaps of one pass over the points."""
    points, path, out = _shifted(spark, sf_dir), scratch.new_path(spark, "bitmaps"), None
    bitmaps.density_bitmaps(points).write.parquet(path)
    made = spark.read.parquet(path)
    few = bitmaps.cohort_bitmap(points.groupBy("track_no").agg(F.max("wind").alias("w")).filter("w > 15"))
    for months in _MONTH_SETS:
        for name, cohort in (("all", None), ("strong", few)):
            one = bitmaps.density_of(made, months, cohort).select(F.lit(",".join(map(str, months))).alias("months"), F.lit(name).alias("cohort"), "cell_x", "cell_y", "n_tracks")
            out = one if out is None else out.unionByName(one)
    return out


@query(
    f"""with {_SHIFTED} select months, count(*) as n_points, min(lon) as min_lon, max(lon) as max_lon, min(lat) as min_lat, max(lat) as max_lat
from sj join ms on list_contains(ml, m1) where track_id in (select track_id from fixes group by 1 having max(wind) > 15) group by 1"""
)
def s08_s09_visible_of_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible points and their bounds for each set of months, from one summary a track and month."""
    points, path, out = _shifted(spark, sf_dir), scratch.new_path(spark, "months"), None
    bitmaps.month_summaries(points).write.parquet(path)
    few = points.groupBy("track_id").agg(F.max("wind").alias("w")).filter("w > 15")
    for months in _MONTH_SETS:
        one = bitmaps.visible(spark.read.parquet(path), months, few).select(F.lit(",".join(map(str, months))).alias("months"), "n_points", "min_lon", "max_lon", "min_lat", "max_lat")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"with {FIX}, {_STARTS} select cast(floor(lon/0.5e0) as bigint) as cell_x, cast(floor(lat/0.5e0) as bigint) as cell_y, count(*) as n from starts group by 1, 2")
def s06_genesis_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.genesis_grid(starts(spark, sf_dir))


@query(
    f"""with {steps_sql()}, g as (select track_id, idx as seg, lag(lon) over w as ax, lag(lat) over w as ay, lon as bx, lat as by_ from steps window w as (partition by track_id order by idx)),
s as (select * from g where ax is not null), q as (select n_nationkey as q, cast(60.03 as double) + n_nationkey*1.5e0 as qx, cast(6.01 as double) + n_nationkey%20 as qy from nation),
t as (select *, greatest(0.0, least(1.0, ((qx-ax)*(bx-ax)+(qy-ay)*(by_-ay))/((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)))) as t from q, s where abs(qx - ax) < 20 and abs(qy - ay) < 20),
d as (select q, track_id, seg, sqrt(power(ax+t*(bx-ax)-qx, 2)+power(ay+t*(by_-ay)-qy, 2)) as d from t),
b as (select q, min((d, track_id, seg)) as m from d where d < 1.5 group by 1) select q as query, m[2] as track_id, m[3] as seg, {r('m[1]', 6)} as distance from b"""
)
def s07_nearest_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("cast(n_nationkey as bigint) as query", "60.03D + n_nationkey*1.5D as lon", "6.01D + n_nationkey%20 as lat")
    out = spatial.nearest_track(asked, spatial.segments(stepped(spark, sf_dir)), 1.5, "query")
    return out.select("query", "track_id", F.col("seg").cast("long").alias("seg"), F.bround("distance", 6).alias("distance"))


@query(f"with {FIX} select min(lon) as min_lon, max(lon) as max_lon, min(lat) as min_lat, max(lat) as max_lat, count(*) as n_points from fixes where track_id in (select track_id from fixes group by 1 having max(wind) > 12) and month(time) in (1, 2)")
def s08_s09_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = fixtures.fixes(spark, sf_dir)
    few = points.groupBy("track_id").agg(F.max("wind").alias("w")).filter("w > 12")
    return spatial.visible(points, few, (1, 2))


@query(f"with {FIX} select track_id, arg_min(lat, h) as genesis_lat, arg_min(lon, h) as genesis_lon, arg_max(lat, h) as lysis_lat, arg_max(lon, h) as lysis_lon from fixes group by 1")
def s10_end_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.endpoints(fixtures.fixes(spark, sf_dir)).select("track_id", "genesis_lat", "genesis_lon", "lysis_lat", "lysis_lon")


# --- cohorts
_COHORT = f"""{SYS}, base as (select *, start_hour + dur_days*24 as end_hour, cast(month(start_date) as int) as start_month, case when dur_days % 5 = 4 then cast(month(start_date + cast(dur_days as int)) as int) else cast(month(start_date) as int) end as peak_month,
  {pct_sql('metric', 'metric')} as metric_pct, id % 3 as qc_severity, case id % 4 when 0 then 'high' when 1 then 'medium' when 2 then 'low' end as confidence, case when id % 8 = 0 then 'NAME' || id when id % 8 = 1 then '' end as name,
  case when id % 4 < 3 then 'S' || (id % 50) end as sid from systems),
masked as (select *, (select cast(bit_or(1 << (m - 1)) as bigint) from (select unnest(range(0, datediff('month', start_date, start_date + cast(dur_days as int)) + 1)) as k), lateral (select ((start_month - 1 + k) % 12) + 1 as m)) as month_mask from base),
labelled as (select m.*, concat_ws(' ', case category when 1 then 'L' when 2 then 'D' when 3 then 'DD' when 4 then 'CS' when 5 then 'SCS' else 'VSCS' end, start_year, case when n < 10 then '0' || n else '' || n end) as label from masked m
  join (select id, row_number() over (partition by start_year, category order by start_hour, id) as n from systems) z using (id))"""


def labelled_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Systems with all that the filters look at."""
    end = F.expr("date_add(start_date, dur_days)")
    months = F.expr("transform(sequence(0, cast(months_between(trunc(date_add(start_date, dur_days), 'MM'), trunc(start_date, 'MM')) as int)), k -> (month(start_date) - 1 + k) % 12)")
    rows = systems(spark, sf_dir).withColumns(
        {
            "end_hour": F.col("start_hour") + F.col("dur_days") * 24,
            "duration_hours": F.col("dur_days") * 24,
            "distance_km": F.col("metric"),
            "start_month": F.month("start_date"),
            "peak_month": F.when(F.col("dur_days") % 5 == 4, F.month(end)).otherwise(F.month("start_date")),
            "month_mask": F.aggregate(months, F.lit(0), lambda a, k: a.bitwiseOR(F.call_function("shiftleft", F.lit(1), k))),
            "qc_severity": F.col("id") % 3,
            "confidence": F.when(F.col("id") % 4 == 0, "high").when(F.col("id") % 4 == 1, "medium").when(F.col("id") % 4 == 2, "low"),
            "name": F.when(F.col("id") % 8 == 0, F.concat(F.lit("NAME"), "id")).when(F.col("id") % 8 == 1, ""),
            "sid": F.when(F.col("id") % 4 < 3, F.concat(F.lit("S"), F.col("id") % 50)),
        }
    )
    return ranks.fallback_labels(ranks.percentile_rank(rows, "metric"))


_CASES: dict[str, tuple[cohort.Filters, str]] = {
    "years": (cohort.Filters(years=(1996, 1998)), "start_year between 1996 and 1998"),
    "days": (cohort.Filters(days=("1997-03-01", "1997-03-10")), "end_hour >= epoch(timestamp '1997-03-01')/3600 and start_hour < epoch(timestamp '1997-03-11')/3600"),
    "months_active": (cohort.Filters(months=(1, 7)), "month_mask & 65 <> 0"),
    "months_genesis": (cohort.Filters(months=(1, 7), month_mode="genesis"), "start_month in (1, 7)"),
    "months_peak": (cohort.Filters(months=(1, 7), month_mode="peak"), "peak_month in (1, 7)"),
    "classes": (cohort.Filters(classes=(2, 5)), "category in (2, 5)"),
    "percentile": (cohort.Filters(percentiles=(("metric_pct", 90),)), "metric_pct >= 90"),
    "unmatched": (cohort.Filters(match="unmatched"), "confidence is null"),
    "high": (cohort.Filters(match="high"), "confidence = 'high'"),
    "credible": (cohort.Filters(match="credible"), "confidence in ('high', 'medium')"),
    "named": (cohort.Filters(match="named"), "confidence in ('high', 'medium') and name <> ''"),
    "good": (cohort.Filters(quality="good"), "qc_severity = 0"),
    "usable": (cohort.Filters(quality="usable"), "qc_severity <= 1"),
    "flagged": (cohort.Filters(quality="flagged"), "qc_severity = 2"),
    "search_date": (cohort.Filters(search="1998-08-02"), "end_hour >= epoch(timestamp '1998-08-02')/3600 and start_hour < epoch(timestamp '1998-08-03')/3600"),
    "search_year": (cohort.Filters(search=" 1999 "), "start_year = 1999"),
    "search_id": (cohort.Filters(search="Event #77"), "id = 77"),
    "search_text": (cohort.Filters(search="SCS 1997 1"), "contains(lower(label), 'scs 1997 1')"),
    "search_sid": (cohort.Filters(search="s49"), "contains(lower(sid), 's49')"),
    "all": (
        cohort.Filters(years=(1995, 1999), months=(6, 7, 8, 9), classes=(1, 2, 3), percentiles=(("metric_pct", 50),), match="credible", quality="usable"),
        "start_year between 1995 and 1999 and month_mask & 480 <> 0 and category in (1, 2, 3) and metric_pct >= 50 and confidence in ('high', 'medium') and qc_severity <= 1",
    ),
}


@query(f"with {_COHORT} " + " union all ".join(f"select '{n}' as filter, id from labelled where {w}" for n, (_, w) in _CASES.items()))
def f01_f12_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, out = labelled_systems(spark, sf_dir), None
    for name, (filters, _) in _CASES.items():
        one = cohort.cohort(rows, filters).select(F.lit(name).alias("filter"), "id")
        out = one if out is None else out.unionByName(one)
    return out


_PLACES = f"""{_IN}, {_STARTS}, m as (select s.track_id, lat, lon, coalesce(bool_or(region < 10), false) as land, coalesce(bool_or(region >= 10), false) as sea from starts s left join hits using (event_id) group by 1, 2, 3),
born as (select track_id, case when land then 'india' when sea and lat between 0 and 30 and lon between 77.5 and 100 then 'bob' when sea and lat between 0 and 30 and lon >= 45 and lon < 77.5 then 'arabian' else 'other' end as genesis_region from m)"""
_PLACE_CASES: dict[str, tuple[cohort.Filters, str]] = {
    **{f"born_{x}": (cohort.Filters(region=x), f"genesis_region = '{x}'") for x in ("india", "bob", "arabian", "other")},
    **{f"crosses_{k}": (cohort.Filters(crossing=k), f"track_id in (select track_id from hits where region = {k})") for k in (0, 7, 12)},
    "born_and_crosses": (cohort.Filters(region="india", crossing=6), "genesis_region = 'india' and track_id in (select track_id from hits where region = 6)"),
}


@query(f"with {_PLACES} " + " union all ".join(f"select '{n}' as filter, track_id from born where {w}" for n, (_, w) in _PLACE_CASES.items()))
def f08_f09_place_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohorts by the region of genesis and by a region that is crossed."""
    paths = [scratch.new_path(spark, name) for name in ("genesis", "crossings")]
    for path, rows in zip(paths, (s02_f08_genesis_region(spark, sf_dir), s03_f09_crosses_region(spark, sf_dir)), strict=True):
        rows.write.parquet(path)  # every case reads them
    (tracks, crossings), out = (spark.read.parquet(path) for path in paths), None
    for name, (filters, _) in _PLACE_CASES.items():
        one = cohort.cohort(tracks, filters, crossings, "track_id").select(F.lit(name).alias("filter"), "track_id")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"with {_COHORT} select min(metric) as threshold from labelled where metric_pct >= 95")
def f13_physical_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.physical_threshold(labelled_systems(spark, sf_dir), "metric", "metric_pct", 95)


@query(
    f"with {_COHORT} select count(*) as n, quantile_cont(cast(dur_days*24 as double), 0.5) as median_duration, {r('quantile_cont(metric, 0.5)')} as median_path, {r('quantile_cont(metric, 0.5)')} as median_metric, count(*) filter (name <> '') as named from labelled where category = 4"
)
def f14_cohort_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cohort.facts(cohort.cohort(labelled_systems(spark, sf_dir), cohort.Filters(classes=(4,))))
    return out.withColumns({c: F.bround(c, 4) for c in ("median_path", "median_metric")})


_RPCT = f"cast({r('100.0*(rank() over (partition by category order by metric) + (count(*) over (partition by category, metric) - 1)/2.0)/count(*) over (partition by category)', 0)} as bigint)"


@query(f"with {SYS}, p as (select id, {_RPCT} as region_pct from systems) select id, region_pct from p where region_pct >= 80")
def f15_w02_region_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranks.percentile_rank_by(systems(spark, sf_dir), "category", "metric", "region_pct")
    return cohort.cohort(rows, cohort.Filters(region_percentile=80)).select("id", F.col("region_pct").cast("long").alias("region_pct"))


# --- climatology
_YEARS = "years as (select unnest(range(1995, 2002)) as year)"


@query(f"with {SYS}, {_YEARS} select year, count(id) as n from years left join systems on start_year = year where year <= 2000 and year > 1995 group by 1")
def c01_c02_annual_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = climatology.complete_years(climatology.year_table(systems(spark, sf_dir), 1995, 2001), 1995, 3, 2000, (1, 6))
    return climatology.annual_counts(systems(spark, sf_dir), years)


@query(
    f"""with {_COHORT}, m as (select cast(unnest(range(1, 13)) as int) as month)
select 'genesis' as mode, month, count(id) as n from m left join labelled on start_month = month group by 2 union all select 'peak', month, count(id) from m left join labelled on peak_month = month group by 2
union all select 'active', month, count(id) from m left join labelled on month_mask & (1 << (month - 1)) <> 0 group by 2"""
)
def c03_monthly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, out = labelled_systems(spark, sf_dir), None
    for mode in ("genesis", "peak", "active"):
        one = climatology.monthly_counts(rows, mode).select(F.lit(mode).alias("mode"), "month", "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    f"""with {SYS}, e as (select cast(floor(year/10.0)*10 as bigint) as decade, count(*) as years from (select unnest(range(1995, 2001)) as year) group by 1)
select decade, """
    + ", ".join(f"{r(f'count(id) filter (category = {c})/cast(any_value(years) as double)')} as class_{c}" for c in range(1, 7))
    + " from e left join systems on start_year between 1995 and 2000 and cast(floor(start_year/10.0)*10 as bigint) = decade group by 1"
)
def c04_decade_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = climatology.decade_classes(systems(spark, sf_dir), climatology.year_table(systems(spark, sf_dir), 1995, 2000))
    return out.select("decade", *(F.bround(c, 4).alias(c) for c in out.columns[1:]))


# --- composites
METRICS = ["wind", "deficit", "mslp", "precip", "vort", "lat", "lon"]
_HOURS = f"{FIX}, hs as (select *, h - min(h) over (partition by track_id) as hour, max(h) over (partition by track_id) - min(h) over (partition by track_id) as last_ from fixes)"
_LIFE = """, bins as (select *, cast(floor(hour/cast(greatest(1, last_) as double)*24 + 0.5e0) as bigint) as bin from hs),
long_ as (unpivot (select track_id, bin, wind, deficit, mslp, precip, vort, lat, lon from bins) on wind, deficit, mslp, precip, vort, lat, lon into name metric value value),
pt as (select metric, track_id, bin, avg(value) as value from long_ group by 1, 2, 3)"""
_SPREAD = f"{r('quantile_cont(value, 0.25)', 8)} as q1, {r('quantile_cont(value, 0.5)', 8)} as median, {r('quantile_cont(value, 0.75)', 8)} as q3, {r('avg(value)', 8)} as mean, count(*) as n"


def _hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kinematics.hours_since_genesis(fixtures.fixes(spark, sf_dir))


def _rounded(out: DataFrame) -> DataFrame:
    return out.select(*(F.bround(c, 8).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))


@query(f"with {_HOURS}{_LIFE} select metric, bin, {_SPREAD} from pt group by 1, 2")
def c05_c06_life_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(composites.life_cycle(_hours(spark, sf_dir), METRICS))


@query(
    f"""with {_HOURS}, pk as (select track_id, arg_min(hour, (-wind, hour)) as ph from hs group by 1), b as (select h.track_id, cast(floor((hour - ph + 72)/6.0e0 + 0.5e0) as bigint) as bin, wind as value from hs h join pk using (track_id)),
pt as (select track_id, bin, avg(value) as value from b where bin between 0 and 24 group by 1, 2) select 'wind' as metric, bin, {_SPREAD} from pt group by 2"""
)
def c07_peak_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(composites.peak_aligned(_hours(spark, sf_dir), "wind"))


@query(
    f"""with {_HOURS}{_LIFE}, few as (select track_id from fixes group by 1 having max(category) >= 4), mine as (select metric, bin, {_SPREAD} from pt where track_id in (select track_id from few) group by 1, 2)
select mine.*, all_mean from mine join (select metric, bin, {r('avg(value)', 8)} as all_mean from pt group by 1, 2) using (metric, bin)"""
)
def c08_cohort_against_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _hours(spark, sf_dir)
    few = points.groupBy("track_id").agg(F.max("category").alias("c")).filter("c >= 4")
    return _rounded(composites.cohort_against_all(points, few, METRICS))


_EXTREMES = {"wind": ("max(wind)", True), "vort": ("max(vort)", True), "mslp": ("min(mslp)", False), "deficit": ("max(deficit)", True), "precip": ("max(precip)", True), "duration": ("max(h)-min(h)", True)}


@query(
    f"with {FIX} "
    + " union all ".join(
        f"select * from (select '{n}' as metric, track_id, cast(v as double) as value, row_number() over (order by v {'desc' if big else ''}, track_id) as rank from (select track_id, {e} as v from fixes group by 1) where v is not null qualify rank <= 3)" for n, (e, big) in _EXTREMES.items()
    )
)
def c09_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = fc.epoch_hours(F.col("time"))
    rows = fixtures.fixes(spark, sf_dir).groupBy("track_id").agg(
        F.max("wind").alias("wind"), F.max("vort").alias("vort"), F.min("mslp").alias("mslp"), F.max("deficit").alias("deficit"), F.max("precip").alias("precip"), (F.max(hours) - F.min(hours)).alias("duration")
    )
    out = None
    for name, (_, largest) in _EXTREMES.items():
        few = ranks.rank_listing(rows, name, largest, 3, "track_id").select(F.lit(name).alias("metric"), "track_id", F.col(name).cast("double").alias("value"), F.col("rank").cast("long").alias("rank"))
        out = few if out is None else out.unionByName(few)
    return out


@query(f"with {FIX} select track_id, count(*) as n_hours, min(wind) as low, max(wind) as high, max(precip) as peak_other from fixes group by 1")
def c10_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composites.evolution(fixtures.fixes(spark, sf_dir), "wind", "precip")


@query(
    f"with {_HOURS}, t as (select unnest([0, 24, 50, 100]) as target), b as (select track_id, target, min((abs(hour - target), -hour, wind)) as m from hs, t group by 1, 2) select track_id, cast(target as bigint) as target, cast(-m[2] as bigint) as hour, m[3] as value from b"
)
def c11_value_at_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _hours(spark, sf_dir)
    targets = points.select("track_id").distinct().withColumn("target", F.explode(F.array(*(F.lit(k) for k in (0, 24, 50, 100)))))
    out = composites.value_at_hour(points, targets, "wind")
    return out.select("track_id", F.col("target").cast("long").alias("target"), F.col("hour").cast("long").alias("hour"), "value")


#: What the labels of systems are searched for, besides each system's own label of one in 300.
_SOUGHT = ("scs 1997 1", "vscs", "l 1995", "s49", "lps 77", "1998-08-02", "99 10", "zzz", "7", "", "d 2001 3", "event", " ", "dd 1996 12", "1996-02-29", "track 150", "0")
_TEXTS = """sought as (select unnest([{0}]) as sought union select lower(label) from labelled where id % 300 = 7),
texts as (select id, lower(concat_ws(' ', {1}, cast(start_date as varchar), cast(start_year as varchar), label, sid)) as text from labelled)""".format(
    ", ".join(f"'{s}'" for s in _SOUGHT), ", ".join(f"'{n}' || id" for n in cohort.ID_NAMES)
)


@query(f"with {_COHORT}, {_TEXTS} select sought, id from sought join texts on contains(text, sought)")
def f10_f11_trigram_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substring search by an index of trigrams, short texts by a scan."""
    rows = labelled_systems(spark, sf_dir)
    index = search_index.TrigramIndex.build(rows.select("id", cohort.search_text().alias("text")), scratch.new_path(spark, "trigrams"), "id", "text")
    sought = spark.createDataFrame([(s,) for s in _SOUGHT], "sought string").unionByName(rows.filter("id % 300 = 7").select(F.lower("label").alias("sought")))
    return index.find(sought).select("sought", F.col("key").alias("id"))


@query(
    """with y as (select o_orderkey, o_custkey, year(cast(o_orderdate as date)) as year from orders), e as (select count(distinct o_orderkey) as a, count(distinct o_custkey) as b from y)
select 'o_orderkey' as "column", a as exact, true as within from e union all select 'o_custkey', b, true from e"""
)
def q04_q15_distinct_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct counts from sketches of years, the last one added later, against exact ones."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    path, columns = scratch.new_path(spark, "sketches"), ["o_orderkey", "o_custkey"]
    last = F.col("year") >= 1998
    sketches.add(spark, path, orders.filter(~last), "year", columns)
    sketches.add(spark, path, orders.filter(last), "year", columns)
    return sketches.count_gate(sketches.distinct_counts(spark, path, columns), sketches.exact_counts(orders, columns), columns)


# --- regional series
_RAIN = f"rain as ({fixtures.REGION_RAIN})"
_MEMBERS = "members as (select 's_' || cast(floor(n_nationkey/2) as int) as slug, n_nationkey as series, 1 + n_nationkey%4 as weight from nation)"
_DAILY = "daily as (select slug, d, sum(rain*weight)/sum(weight) as value from rain join members on series = region where rain is not null group by 1, 2)"
_MEANS = f"""days as (select distinct track_id, cast(day(time) as int) as d from fixes), nd as (select track_id, count(*) as n_days from days group by 1),
mv as (select track_id, slug, cast({r('avg(value)', 0)} as bigint) as mean from days join daily using (d) group by 1, 2),
means as (select nd.track_id, s.slug, n_days, coalesce(mean, -1) as mean from nd, (select distinct slug from daily) s left join mv on mv.track_id = nd.track_id and mv.slug = s.slug)"""


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return nation.selectExpr("concat('s_', cast(floor(n_nationkey/2) as int)) as slug", "n_nationkey as series", "1 + n_nationkey%4 as weight")


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.combine(fixtures.region_rain(spark, sf_dir).select(F.col("region").alias("series"), "d", F.col("rain").alias("value")), _members(spark, sf_dir))


_SERIES = """series as (select c_nationkey as region, year(o_orderdate) as year, dayofyear(o_orderdate) as d, round_even(avg(cast(o_totalprice as double))/1000, 0) as v
from orders join customer on o_custkey = c_custkey group by 1, 2, 3)"""


@query(f"with {_SERIES} select cast(region as bigint) as region, cast(year as bigint) as year, cast(d as bigint) as d, cast(v as bigint) as value from series")
def r05_daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes regional series of all years of the orders as base64 of little-endian integers, a line a region and year, and decodes them."""
    orders, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("region"), F.year("o_orderdate").alias("year"), F.dayofyear("o_orderdate").alias("d"))
    rows = rows.agg(F.rint(F.avg(F.col("o_totalprice").cast("double")) / 1000).cast("int").alias("v"))
    days = {y: 366 if y % 4 == 0 else 365 for y in range(1990, 2010)}
    path = scratch.new_path(spark, "daily")
    daily_series.pack(rows, "region", "year", "d", "v", days).write.json(path)
    read = daily_series.read_lines(spark, path)
    if not daily_series.bad_lengths(read, days).isEmpty():
        raise ValueError("a regional series has a wrong length")
    out = daily_series.unpack(read)
    date = F.col("date")
    return out.filter(F.col("value").isNotNull()).select(F.col("region").cast("long").alias("region"), F.year(date).cast("long").alias("year"), F.dayofyear(date).cast("long").alias("d"), F.col("value").cast("long").alias("value"))


_ALIASES = {"north_coast": ["0", "3"], "south_hills": ["7"], "far_sea": ["99999999"], "two_lakes": ["4", "5"]}


@query(
    """with special(slug, series) as (values ('north_coast','0'),('north_coast','3'),('south_hills','7'),('far_sea','99999999'),('two_lakes','4'),('two_lakes','5')),
slugs as (select distinct slug from special union select 'area_' || s_suppkey from supplier),
meta as (select cast(s_suppkey as varchar) as series from supplier union select 'area-' || s_suppkey from supplier where s_suppkey % 3 <> 0)
select s.slug, x.series from slugs s join (select slug, series from special union all select slug, replace(slug, '_', '-') from slugs where slug not in (select slug from special)) x using (slug)
where x.series in (select series from meta)"""
)
def g01_alias_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("k"))
    special = spark.createDataFrame([(s,) for s in _ALIASES], "slug string")
    slugs = key.select(F.concat(F.lit("area_"), "k").alias("slug")).unionByName(special).distinct()
    meta = key.select(F.col("k").alias("series")).unionByName(key.filter("cast(k as long) % 3 <> 0").select(F.concat(F.lit("area-"), "k").alias("series"))).distinct()
    return regions.alias_map(slugs, meta, _ALIASES)


@query(f"with {_RAIN}, {_MEMBERS}, {_DAILY} select slug, d, {r('value')} as value from daily")
def g02_combine_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _daily(spark, sf_dir).withColumn("value", F.bround("value", 4))


def _means(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = fixtures.fixes(spark, sf_dir).select("track_id", F.dayofmonth("time").alias("d"))
    return regions.event_region_mean(days, _daily(spark, sf_dir))


@query(f"with {FIX}, {_RAIN}, {_MEMBERS}, {_DAILY}, {_MEANS} select track_id, slug, n_days, mean from means")
def g03_event_region_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _means(spark, sf_dir)


@query(
    f"with {FIX}, {_RAIN}, {_MEMBERS}, {_DAILY}, {_MEANS}, b as (select track_id, min((-mean, slug)) filter (mean >= 0) as m from means group by 1) select track_id, m[2] as slug, coalesce(-m[1], -1) as mean from b"
)
def g04_top_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.top_region(_means(spark, sf_dir))


@query(
    f"""with {FIX}, {_RAIN}, {_MEMBERS}, {_DAILY}, {_MEANS}, few as (select track_id from fixes group by 1 having max(category) >= 4)
select slug, {r('sum(mean*greatest(1, n_days))/cast(sum(greatest(1, n_days)) as double)/10')} as value, cast(sum(greatest(1, n_days)) as bigint) as system_days, count(*) as n_tracks from means where mean >= 0 and track_id in (select track_id from few) group by 1"""
)
def g05_g06_cohort_region_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    few = fixtures.fixes(spark, sf_dir).groupBy("track_id").agg(F.max("category").alias("c")).filter("c >= 4")
    return regions.cohort_region_mean(_means(spark, sf_dir), few).withColumn("value", F.bround("value", 4))
