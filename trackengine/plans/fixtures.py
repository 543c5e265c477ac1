"""Track-shaped views of the driver's tables. The SQL text is the same for Spark and for the comparison engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_POINT = """user_id*100 + cast(floor((day(ts)-1)/6) as bigint) as track_id, user_id,
             date_trunc('hour', ts) as time, event_id,
             cast(5 as double) + user_id%23 + cast(0.05 as double)*((day(ts)-1)%6*24+hour(ts)) + (event_id*7919%100)/cast(100 as double) as lat,
             cast(55 as double) + user_id*7%50 + cast(0.08 as double)*((day(ts)-1)%6*24+hour(ts)) + (event_id*104729%100)/cast(100 as double) as lon,
             cast(5 as double) + value/20 as wind, value/10 as deficit, cast(1010 as double) - value/8 as mslp, cast(2 as double) + value/12 as vort,
             cast(regexp_extract(props, '([0-9]+)', 1) as double) as precip,
             case event_type when 'view' then 1 when 'click' then 2 when 'signup' then 3 when 'purchase' then 4 else 5 end as category,
             row_number() over (partition by user_id, date_trunc('hour', ts) order by ts, event_id) as rn"""

#: Hourly points: one track is one user and block of six days; the first event of an hour counts.
FIXES = f"""select track_id, user_id, time, event_id, lat, lon, wind, deficit, mslp, precip, vort, category
from (select {_POINT}
      from events) q
where rn = 1"""

#: Reference tracks of all users, with names: those of a third moved a little, the others out of a match's reach.
STORM_FIXES = f"""select sid, basin, name, time, lat + (event_id%50)/cast(30 as double) + case when user_id%3=1 then 4 else 0 end as lat,
  lon - (event_id%40)/cast(45 as double) + case when user_id%3=2 then 5 else 0 end as lon
from (select concat('S', lpad(cast(user_id as varchar(10)), 5, '0')) as sid,
             case when user_id%2=0 then 'NI' else 'WP' end as basin,
             case when user_id%9=0 then 'UNNAMED' when user_id%9=3 then concat(n_name, ':', n_name, '-GU') else n_name end as name,
             {_POINT}
      from events join nation on n_nationkey = user_id%25) q
where rn = 1"""

_CX = "cast(60.00371 as double) + (n_nationkey%5)*12"
_CY = "cast(5.00173 as double) + cast(floor(n_nationkey/5) as int)*6"

#: 25 diamonds as edges; no vertex lies on the points' lattice.
EDGES = f"""select region, name, x1, y1, x2, y2 from (
  select n_nationkey as region, n_name as name, {_CX} - 5 as x1, {_CY} as y1, {_CX} as x2, {_CY} - 2.5e0 as y2 from nation
  union all select n_nationkey, n_name, {_CX}, {_CY} - 2.5e0, {_CX} + 5, {_CY} from nation
  union all select n_nationkey, n_name, {_CX} + 5, {_CY}, {_CX}, {_CY} + 2.5e0 from nation
  union all select n_nationkey, n_name, {_CX}, {_CY} + 2.5e0, {_CX} - 5, {_CY} from nation) e"""

#: The diamonds' centres, for a closed form.
CENTRES = f"select n_nationkey as region, {_CX} as cx, {_CY} as cy from nation"

#: Systems of several years with a class, a metric and a duration.
SYSTEMS = """select o_orderkey as id, cast(o_orderdate as date) as start_date, cast(substr(o_orderpriority,1,1) as int) as category,
  cast(o_totalprice as double) as metric, cast(o_custkey%60 as int) as dur_days from orders"""

#: Daily regional series; some days have no value.
REGION_RAIN = """select c_nationkey as region, cast(day(o_orderdate) as int) as d,
  case when max((c_nationkey + day(o_orderdate))%7) = 0 then null else avg(cast(o_totalprice as double))/10000 end as rain
from orders join customer on o_custkey = c_custkey group by 1, 2"""

_TABLES = ("events", "nation", "orders", "customer")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Runs one of the texts above over the parquet tables that it names."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES if f" {t}" in sql}
    for t in used:
        sql = sql.replace(f"from {t}", f"from {{{t}}}").replace(f"join {t}", f"join {{{t}}}")
    return spark.sql(sql, **used)


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, FIXES)


def storm_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, STORM_FIXES)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, EDGES)


def systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, SYSTEMS)


def region_rain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, REGION_RAIN)
