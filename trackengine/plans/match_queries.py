"""Queries over reference storms and matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackengine.functions import columns as fc
from trackengine.operators import matching, verify
from trackengine.plans import fixtures
from trackengine.plans.registry import query
from trackengine.plans.track_queries import FIX, hav, r
from trackengine.sources import best_tracks, scratch

_STORM = f"sf as (select *, cast(round_even(epoch(time)/3600.0, 0) as bigint) as fh from ({fixtures.STORM_FIXES}) s0)"
_HEAD = """heads as (select sid, arg_min(name, time) as name, arg_min(basin, time) as basin, count(*) as n_fixes, min(fh) as s0, max(fh) as s1, year(min(time)) as sy0, year(max(time)) as sy1,
  min(lat) as a0, max(lat) as a1, min(lon) as o0, max(lon) as o1 from sf group by 1 having count(*) >= 2)"""
MATCH = f"""{FIX}, {_STORM}, {_HEAD},
spans as (select track_id, min(h) as t0, max(h) as t1, min(lat) as ta0, max(lat) as ta1, min(lon) as to0, max(lon) as to1 from fixes group by 1 having count(*) >= 3),
pairs as (select track_id, sid, t0, t1 from spans, heads where s1 >= t0 and s0 <= t1 and a0 - ta1 <= 4 and ta0 - a1 <= 4 and o0 - to1 <= 4 and to0 - o1 <= 4),
near as (select p.track_id, p.sid, f.fh, min((abs(x.h - f.fh), x.h)) as best from pairs p join sf f on f.sid = p.sid and f.fh between p.t0 and p.t1
  join fixes x on x.track_id = p.track_id and abs(x.h - f.fh) <= 3 group by 1, 2, 3),
km as (select n.track_id, n.sid, n.fh, n.best[1] as away, {hav('f.lat', 'f.lon', 'x.lat', 'x.lon')} as km from near n join sf f on f.sid = n.sid and f.fh = n.fh join fixes x on x.track_id = n.track_id and x.h = n.best[2]),
stats as (select track_id, sid, quantile_cont(km, 0.5) as med, quantile_cont(km, 0.9) as p90, count(*) as overlap, max(fh) - min(fh) as hours from km group by 1, 2),
scored as (select track_id, sid, {r('med', 1)} as median_km, {r('p90', 1)} as p90_km, overlap, cast(hours as double) as overlap_hours, {r('med + 0.35e0*p90 - least(60.0, 0.55e0*hours)', 1)} as score
  from stats where overlap >= 3 and hours >= 6 and med <= 225 and p90 <= 350),
placed as (select *, row_number() over w as place, {r('lead(score) over w - score', 1)} as margin from scored window w as (partition by track_id order by score, median_km, sid)),
best as (select * exclude (place), case when median_km <= 120 and p90_km <= 220 and overlap >= 4 and overlap_hours >= 12 and (margin is null or margin >= 25) then 'high'
  when median_km <= 200 and p90_km <= 320 and overlap >= 3 and overlap_hours >= 6 and (margin is null or margin >= 15) then 'medium' else 'low' end as confidence from placed where place = 1),
matches as (select b.*, row_number() over (partition by sid order by t0, b.track_id) as part_index, count(*) over (partition by sid) as part_count from best b join spans s on s.track_id = b.track_id)"""


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match_tracks(fixtures.fixes(spark, sf_dir), fixtures.storm_fixes(spark, sf_dir))


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_tracks.storm_headers(fixtures.storm_fixes(spark, sf_dir))


@query(f"with {_STORM} select sid, basin, name, fh as hour, lat, lon from sf where lat between -15 and 55 and lon between 35 and 155")
def r02_r03_best_tracks_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the storms' fixes as two CSV files with a line of units, the second a copy, and reads them back."""
    rows = fixtures.storm_fixes(spark, sf_dir).select(
        F.col("sid").alias("SID"), F.lit("2024").alias("SEASON"), F.col("basin").alias("BASIN"), F.col("name").alias("NAME"), F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("ISO_TIME"), F.col("lat").cast("string").alias("LAT"), F.col("lon").cast("string").alias("LON")
    )
    units = spark.createDataFrame([(" ", "Year", " ", " ", " ", "degrees_north", "degrees_east")], rows.schema)
    paths = [scratch.new_path(spark, "best-tracks") for _ in range(2)]
    units.unionByName(rows).write.csv(paths[0], header=True)
    rows.withColumn("LAT", F.lit("0")).write.csv(paths[1], header=True)
    read = best_tracks.dedupe_fixes(best_tracks.read_best_tracks(spark, paths))
    return read.filter("file_rank = 0").select("sid", "basin", "name", F.rint(fc.epoch_hours(F.col("time"))).cast("long").alias("hour"), "lat", "lon")


@query(f"with {_STORM}, {_HEAD} select sid, name, basin, n_fixes, s0 as start_hour, s1 as end_hour, {r('a0')} as min_lat, {r('a1')} as max_lat, {r('o0')} as min_lon, {r('o1')} as max_lon from heads")
def r04_storm_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = lambda c: F.rint(fc.epoch_hours(F.col(c))).cast("long")
    bounds = [F.bround(c, 4).alias(c) for c in ("min_lat", "max_lat", "min_lon", "max_lon")]
    return headers(spark, sf_dir).select("sid", "name", "basin", "n_fixes", h("start_time").alias("start_hour"), h("end_time").alias("end_hour"), *bounds)


@query(f"with {MATCH} select track_id, sid from pairs")
def j01_j04_candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.candidate_pairs(matching.track_spans(fixtures.fixes(spark, sf_dir)), headers(spark, sf_dir)).select("track_id", "sid")


@query(f"with {MATCH} select track_id, sid, fh as fix_hour, cast(away as double) as away, {r('km', 2)} as km from km")
def j05_j06_nearest_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = matching.track_points(fixtures.fixes(spark, sf_dir), fixtures.storm_fixes(spark, sf_dir))
    return out.select("track_id", "sid", F.rint("f_hour").cast("long").alias("fix_hour"), "away", F.bround("km", 2).alias("km"))


@query(f"with {MATCH} select track_id, sid, median_km, p90_km, overlap, overlap_hours, score from scored")
def j07_j08_separations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.track_separations(fixtures.fixes(spark, sf_dir), fixtures.storm_fixes(spark, sf_dir))


@query(f"with {MATCH} select track_id, sid, median_km, p90_km, overlap, overlap_hours, score, margin, confidence, part_index, part_count from matches")
def j09_j10_j14_w04_w05_match_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = matches(spark, sf_dir)
    return out.select("track_id", "sid", "median_km", "p90_km", "overlap", "overlap_hours", "score", "margin", "confidence", F.col("part_index").cast("long").alias("part_index"), "part_count")


_NAME = """case when regexp_replace(split_part(name, ':', 1), '-GU$', '') in ('', 'UNNAMED') then '' else
  array_to_string(list_transform(string_split(regexp_replace(split_part(name, ':', 1), '-GU$', ''), ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') end"""


@query(f"with {MATCH} select sid, {_NAME} as display, n_fixes from heads where sid in (select sid from matches)")
def j11_e03_matched_storms(spark: SparkSession, sf_dir: str) -> DataFrame:
    storms = matching.matched_storms(headers(spark, sf_dir), matches(spark, sf_dir))
    return storms.select("sid", fc.display_name(F.col("name")).alias("display"), "n_fixes")


@query(f"with {MATCH} select s.track_id, m.sid, m.confidence from spans s left join matches m using (track_id)")
def j12_attach_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = matching.track_spans(fixtures.fixes(spark, sf_dir))
    return matching.attach_matches(spans, matches(spark, sf_dir)).select("track_id", "sid", "confidence")


@query(
    f"""with {MATCH}, n as (select m.*, {_NAME} as display from matches m join heads using (sid)) select (select count(*) from spans) as tracks, (select count(*) from heads) as storms, count(*) as matched,
count(*) filter (confidence = 'high') as high, count(*) filter (confidence = 'medium') as medium, count(*) filter (confidence = 'low') as low, count(*) filter (confidence <> 'low' and display <> '') as named from n"""
)
def j13_match_scoreboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    storms = headers(spark, sf_dir)
    names = storms.select("sid", fc.display_name(F.col("name")).alias("display"))
    return matching.match_scoreboard(matching.track_spans(fixtures.fixes(spark, sf_dir)), storms, matches(spark, sf_dir), names)


@query(
    f"""with {MATCH}, n as (select m.track_id, m.confidence, m.part_index, m.part_count, {_NAME} as display from matches m join heads using (sid))
select track_id, confidence <> 'low' as credible, case when confidence <> 'low' and display <> '' then display end as official_name,
coalesce(case when confidence <> 'low' and display <> '' then 'Cyclone ' || upper(display) || case when part_count > 1 then ' · catalogue part ' || part_index || '/' || part_count else '' end end, 'Track ' || track_id) as label from n"""
)
def e04_e05_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = headers(spark, sf_dir).select("sid", fc.display_name(F.col("name")).alias("display"))
    rows = matches(spark, sf_dir).join(names, "sid")
    official = fc.official_name(F.col("display"), F.col("confidence"))
    return rows.select(
        "track_id", fc.credible(F.col("confidence")).alias("credible"), official.alias("official_name"), fc.system_label(official, F.col("part_index"), F.col("part_count"), F.concat(F.lit("Track "), "track_id")).alias("label")
    )


@query(
    f"""with {MATCH}, n as (select m.*, {_NAME} as display from matches m join heads using (sid)) select count(*) filter (confidence = 'high') as high, count(*) filter (confidence = 'medium') as medium,
count(*) filter (confidence <> 'low' and display <> '') as named, {r("100.0*count(*) filter (confidence = 'high')/(select count(*) from spans)", 2)} as high_share from n"""
)
def v01_confidence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = headers(spark, sf_dir).select("sid", fc.display_name(F.col("name")).alias("display"))
    tracks = matching.attach_matches(matching.track_spans(fixtures.fixes(spark, sf_dir)), matches(spark, sf_dir)).join(names, "sid", "left")
    return verify.confidence_counts(tracks).withColumn("high_share", F.bround("high_share", 2))


@query(f"with {MATCH} select sid, count(*) as n_tracks from matches group by 1 having count(*) > 1")
def v02_multi_event_storms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.multi_event_storms(matches(spark, sf_dir))


@query(
    f"""with {MATCH}, e as (select unnest([0, 50, 100, 150, 200, 300, 500]) as low), x as (select median_km, (select max(low) from e where low <= median_km) as low from matches)
select cast(e.low as double) as low, count(x.low) as n from e left join x on x.low = e.low group by 1"""
)
def v03_separation_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.histogram(matches(spark, sf_dir), "median_km").select("low", "n")


@query(
    f"""with {MATCH} select sid, array_to_string(list(track_id order by track_id), ',') as tracks, case min(case confidence when 'high' then 0 when 'medium' then 1 else 2 end) when 0 then 'high' when 1 then 'medium' else 'low' end as best_tier,
min(median_km) as min_km, max(median_km) as max_km, count(*) as n from matches group by 1 having count(*) > 1 order by n desc, sid limit 60"""
)
def v05_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.fragments(matches(spark, sf_dir)).withColumn("tracks", F.array_join("tracks", ","))


_GRADE = "case when track_id % 7 = 0 then 'LOW' when track_id % 7 = 1 then 'DEP' when track_id % 7 = 2 then 'dd' when track_id % 7 = 3 then 'CS' when track_id % 7 = 4 then 'SCS' when track_id % 7 = 5 then 'ESCS' else 'X' end"


@query(
    f"""with {FIX}, t as (select track_id, max(category) as category from fixes group by 1), g as (select category, case {_GRADE} when 'LOW' then 1 when 'DEP' then 2 when 'dd' then 3 when 'CS' then 4 when 'SCS' then 5 when 'ESCS' then 6 end as grade from t),
c as (select * from (select unnest(range(1, 7)) as category), (select unnest(range(1, 7)) as grade)) select c.category, c.grade, count(g.grade) as n from c left join g on g.category = c.category and g.grade = c.grade group by 1, 2"""
)
def v04_grade_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = fixtures.fixes(spark, sf_dir).groupBy("track_id").agg(F.max("category").alias("category")).withColumn("grade", F.expr(_GRADE))
    return verify.grade_matrix(tracks).select(F.col("category").cast("long").alias("category"), F.col("grade").cast("long").alias("grade"), "n")
