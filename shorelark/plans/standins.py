"""Stand-in tables derived from the driver tables.

Each derivation is one SQL text read by Spark and, with the marked differences replaced, by DuckDB,
so both sides of a comparison start from the same rows. Figures come from whole numbers divided by
powers of ten, which makes them equal to the last bit.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)

ZONE = "case {0} when 0 then 'click' when 1 then 'error' when 2 then 'purchase' when 3 then 'signup' else 'view' end"

STANDINS: dict[str, str] = {}

STANDINS["cal_events"] = """
select o_orderkey as ord, o_orderpriority as source,
  case o_custkey % 5 when 0 then 'Reef Dive ' when 1 then 'Wreck Dive ' when 2 then 'Cave Trip ' when 3 then 'Night Dive '
    else 'Gear Hire ' end || cast(o_custkey % 97 as string)
    || case when o_orderstatus <> 'P' then '' when o_orderkey % 2 = 0 then ' (sold out)' else '  (Sold Out) ' end as title,
  case when o_orderkey % 3 = 0 then cast(d as string)
    else cast(d as string) || 'T' || lpad(cast(6 + o_orderkey % 18 as string), 2, '0') || ':'
      || lpad(cast((o_orderkey % 4) * 15 as string), 2, '0') || '+10:00' end as start_at,
  case when o_orderkey % 2 = 0 then null else cast(d + cast(o_orderkey % 41 - 3 as int) as string) end as end_at,
  o_orderkey % 3 = 0 as all_day,
  case when o_orderkey % 7 = 0 then null
    else 'https://example.org/e/' || cast(o_custkey % 50 as string) || '?q=' || cast(o_orderkey as string) end as url,
  case when o_custkey % 4 = 0 then null else 'Bay ' || cast(o_custkey % 13 as string) end as location,
  case when o_orderkey % 5 = 0 then null else 'From $' || cast(cast(floor(o_totalprice) as bigint) as string) end as description
from (select *, cast(o_orderdate as date) as d from {orders}) o
"""

STANDINS["listing_text"] = """
select o_orderkey as ord,
  'Trip ' || cast(o_custkey % 50 as string)
    || case o_orderkey % 5 when 0 then ' 10/7/2026' when 1 then ' -July-26' when 2 then ' Aug 2026' when 3 then ' 2027' else '' end
    || case when o_orderkey % 11 = 0 then ' 2026' else '' end as dated,
  case o_orderkey % 4 when 0 then 'Saturday Morning - ' when 1 then 'SUNDAY ' when 2 then 'Tuesday' else '' end
    || case when o_orderkey % 9 = 0 then '' else 'Double   Dive ' || cast(o_orderkey % 30 as string) end as weekly,
  case o_orderkey % 7
    when 0 then cast(1 + o_orderkey % 12 as string) || ':' || lpad(cast(o_custkey % 60 as string), 2, '0') || ' AM'
    when 1 then cast(1 + o_orderkey % 12 as string) || '.' || lpad(cast(o_custkey % 60 as string), 2, '0') || ' p.m.'
    when 2 then lpad(cast(o_orderkey % 24 as string), 2, '0') || ':' || lpad(cast(o_custkey % 60 as string), 2, '0')
    when 3 then cast(13 + o_orderkey % 14 as string) || ':00 PM'
    when 4 then cast(o_orderkey % 30 as string) || ':30'
    when 5 then 'All day' else null end as clock,
  'Boat ' || cast(o_custkey % 9 as string) || case o_orderkey % 4
    when 0 then ' (' || cast(1 + o_orderkey % 11 as string) || 'pm-' || cast(1 + o_custkey % 11 as string) || '.30pm)'
    when 1 then ' Departing ' || cast(1 + o_orderkey % 12 as string) || '30pm Jetty'
    when 2 then ' 8am or 2pm' else '' end as item_name,
  'Deep Dive ' || cast(o_custkey % 20 as string)
    || case o_orderkey % 3 when 0 then ' - Sydney - Alexandria' when 1 then ' -sydney - MANLY ' else '' end as placed,
  case o_orderkey % 3 when 0 then 'Start Time: ' || lpad(cast(o_orderkey % 24 as string), 2, '0') || ':15 ' else 'Soon ' end
    || case o_orderkey % 4 when 0 then '$ ' when 1 then '$' else 'free ' end || cast(o_custkey % 1000 as string) || '.00' as info,
  case o_orderkey % 5 when 0 then '$0' when 1 then '$0.00' when 2 then '' else '$' || cast(o_custkey % 90 as string) end as price,
  case o_orderkey % 4 when 0 then '/shop/item?q=' || cast(o_custkey as string) || '#x'
    when 1 then 'https://shop.example.org/a/b?PHPSESSID=9&preferredDate=1998-0' || cast(1 + o_orderkey % 9 as string)
      || '-1' || cast(o_custkey % 10 as string) || '&iframe=true&preferredTime=9%3A00+AM'
    when 2 then 'item/' || cast(o_custkey % 30 as string) else null end as href,
  cast(o_custkey % 4 as int) as places_left, o_orderstatus = 'P' as sold_flag, cast(o_orderdate as date) as day
from {orders}
"""

STANDINS["zone_hours"] = """
select s.zone, s.idx,
  '2024-01-' || lpad(cast(1 + cast(floor(s.idx / 24.0) as int) as string), 2, '0') || 'T'
    || lpad(cast(s.idx % 24 as string), 2, '0') || ':00' as ts,
  cast(c % 3000 as double) / 1000 as swell_h, cast(u % 360 as double) as swell_dir, cast(4 + e % 13 as double) as swell_per,
  case when n % 3 = 0 then null else cast(c % 900 as double) / 1000 end as swell2_h,
  cast((u * 7) % 360 as double) as swell2_dir, cast(5 + e % 9 as double) as swell2_per,
  cast(c % 1700 as double) / 1000 as chop_h, cast((u * 3) % 360 as double) as chop_dir,
  cast(c % 4000 as double) / 1000 as wave_h, 15 + cast(c % 800 as double) / 100 as sst,
  cast((c * 13) % 2000 as double) / 1000 - 1 as sea_level,
  case when n % 5 = 0 then null else cast(e % 50 as double) / 10 end as current, cast((e * 5) % 360 as double) as current_dir,
  case when n % 4 = 0 then cast(c % 120 as double) / 10 when n is not null then 0.0e0 else null end as precip,
  cast(c % 320 as double) / 10 as wind,
  case when n % 11 = 0 then null else cast((u * 11) % 360 as double) end as wind_dir,
  cast(c % 450 as double) / 10 as gust, 10 + cast(u % 200 as double) / 10 as temp, cast(e % 101 as double) as cloud
from (select zone, @SPINE(744) as idx from (select distinct event_type as zone from {events}) z) s
left join (
  select event_type as zone, (day(ts) - 1) * 24 + hour(ts) as idx, count(*) as n,
    cast(sum(cast(round(value * 100) as bigint)) as bigint) as c, cast(sum(user_id) as bigint) as u,
    cast(sum(event_id) as bigint) as e
  from {events} group by event_type, (day(ts) - 1) * 24 + hour(ts)
) h on s.zone = h.zone and s.idx = h.idx
where not (s.zone in (select min(event_type) from {events}) and s.idx % 29 in (4, 5, 17)) and not (s.zone in (select max(event_type) from {events}) and s.idx % 41 = 10)
"""

STANDINS["sites"] = f"""
select s_suppkey as site_id, s_suppkey as pos, s_name as name, 'A' || cast(s_nationkey as string) as area,
  case s_nationkey % 4 when 0 then 'Sydney Harbour' when 1 then 'Botany Bay' when 2 then 'Eastern Suburbs' else 'Elsewhere' end as region,
  -37 + cast((s_suppkey * 37) % 900 as double) / 100 as lat, 149 + cast((s_suppkey * 53) % 500 as double) / 100 as lng,
  case when s_suppkey % 3 = 0 then 'boat' else 'shore' end as type, s_suppkey % 6 = 0 as wreck,
  case when s_suppkey % 17 = 0 then 'unknown'
    else cast(5 + s_suppkey % 20 as string) || '–' || cast(10 + s_suppkey % 40 as string) || ' m' end as depth,
  case s_suppkey % 3 when 0 then 'Open Water' when 1 then 'Advanced' else 'Deep / Tech' end as level_name,
  case when s_suppkey % 3 = 0 then 'view' else {ZONE.format('s_suppkey % 5')} end as marine_zone,
  {ZONE.format('s_nationkey % 5')} as weather_zone,
  @ARR({', '.join(f"cast((s_suppkey * 7 + {i * 13}) % 100 as double) / case when s_suppkey % 4 = 0 then 400 else 100 end" for i in range(8))}) as exposure,
  0.8e0 + cast(s_suppkey % 5 as double) / 10 as swell_tol, cast(6 + s_suppkey % 15 as double) as base_vis,
  cast(s_suppkey % 11 as double) / 10 as runoff,
  case s_suppkey % 6 when 0 then 'ocean' when 1 then 'harbour' when 2 then 'botany' when 3 then 'hacking' when 4 then 'elsewhere'
    else null end as water_body,
  case s_suppkey % 4 when 0 then 'incoming' when 1 then 'high' when 2 then 'low' else null end as tide_pref,
  s_suppkey % 7 = 0 as tide_critical, s_suppkey % 5 = 0 as current_note, s_suppkey % 8 = 0 as approx,
  @ARR('H' || cast(s_suppkey % 3 as string), 'Rays', 'Kelp', 'Wall', 'Night') as highlights
from {{supplier}}
"""

STANDINS["areas"] = f"""
select 'A' || cast(n_nationkey as string) as area, 'Area ' || n_name as label,
  case when n_nationkey = 4 then 'nowhere' else {ZONE.format('n_nationkey % 5')} end as tide_zone
from {{nation}}
"""

STANDINS["daily"] = """
select '2024-01-' || lpad(cast(d as string), 2, '0') as date,
  case when d % 9 = 0 then null else '2024-01-' || lpad(cast(d as string), 2, '0') || 'T0' || cast(5 + n % 2 as string) || ':'
    || lpad(cast(n % 3 * 20 as string), 2, '0') end as sunrise,
  case when d % 9 = 0 then null else '2024-01-' || lpad(cast(d as string), 2, '0') || 'T' || cast(18 + n % 3 as string) || ':25' end as sunset
from (select day(ts) as d, count(*) as n from {events} group by day(ts)) x
"""

STANDINS["discharge"] = """
select 'river' || cast(river as string) as river, river as river_ord, day_idx,
  case when n % 10 = 0 then null else cast(c % 90000 as double) / 1000 end as q
from (
  select cast(o_custkey % 25 as int) as river, cast(datediff(@UNIT cast(o_orderdate as date)) % 38 as int) as day_idx,
    count(*) as n, cast(sum(cast(round(o_totalprice) as bigint)) as bigint) as c
  from {orders} group by 1, 2
) x
"""

STANDINS["affects"] = """
select 'river' || cast(n_nationkey as string) as river,
  case n_nationkey % 5 when 0 then 'ocean' when 1 then 'harbour' when 2 then 'botany' when 3 then 'elsewhere' else 'byron' end as body
from {nation}
"""

STANDINS["classes"] = """
select lpad(cast(l_orderkey as string), 14, '0') || '-' || cast(l_linenumber as string) || '-'
    || lpad(cast(l_partkey as string), 12, '0') || '-' || lpad(cast(l_suppkey as string), 12, '0') || '-'
    || cast(cast(l_quantity as int) as string) || '-' || cast(cast(floor(l_extendedprice) as bigint) as string) as ord,
  cast(l_orderkey as string) as cid,
  case p_size % 14 when 0 then 'Cave Diver ' || cast(1 + p_size % 11 as string) when 1 then 'CCR Technical Diver 2'
    when 2 then 'Deep Primer' when 3 then 'Drysuit Primer ' || cast(p_size % 5 as string) when 4 then 'First Aid Instructor'
    when 5 then 'Technical Diver 3' when 6 then 'Scientific Diver' when 7 then 'Open Water Diver' when 8 then 'Tech Clinic'
    when 9 then 'Oxygen Refresher' when 10 then 'CCR Cave' when 11 then 'Acme Performance Diver' when 12 then 'ITC Acme Fundamentals'
    else 'Basic Fundamentals' end as course,
  case when l_linenumber = 7 then null else cast(l_shipdate as date) end as iso,
  case when l_linenumber % 3 = 0 then upper(p_name) || ',   ' || p_brand else p_name || ', ' || p_brand end as location,
  case when l_linenumber = 5 then null else s_name end as instructor
from {lineitem} l join {part} p on l_partkey = p_partkey join {supplier} s on l_suppkey = s_suppkey
"""

STANDINS["lookup"] = """
select loc, -40 + cast(k % 1200 as double) / 16 as lat, cast(k % 300 as double) - 150 as lng
from (select lower(p_name || ', ' || p_brand) as loc, min(p_partkey) as k from {part} group by 1) x
where k % 10 <> 0
"""

STANDINS["geo_cache"] = """
select p_partkey as ord,
  case when p_partkey % 4 = 0 then upper(p_name) else p_name end || ', ' || p_brand || ', '
    || case p_partkey % 6 when 0 then 'Germany' when 1 then 'USA' when 2 then 'Bonaire' when 3 then 'Atlantis' when 4 then 'Japan'
      else 'Netherlands' end as loc,
  case when p_partkey % 7 = 0 then null else -40 + cast((p_partkey * 37) % 800000 as double) / 10000.0e0 + 0.0000049e0 end as lat,
  case when p_partkey % 7 = 0 then null else -100 + cast((p_partkey * 53) % 2000000 as double) / 10000.0e0 end as lng,
  p_partkey % 13 = 0 as approx
from {part}
"""

STANDINS["pages_index"] = """
select page_id as ord, 'iOS ' || cast(page_id % 40 as string) || case when page_id % 3 = 0 then ' and iPadOS ' || cast(page_id % 40 as string) else '' end as name,
  cast(1 + page_id % 28 as string) || ' Jan ' || cast(2015 + page_id % 9 as string) as date, url
from {pages}
"""


def _spark_text(sql: str) -> str:
    sql = re.sub(r"@SPINE\((\d+)\)", lambda m: f"explode(sequence(0, {int(m[1]) - 1}))", sql)
    sql = re.sub(r"datediff\(@UNIT ([^%]+)\) %", r"datediff(\1, date'1995-01-01') %", sql)
    return sql.replace("@ARR(", "array(")


def _duck_text(sql: str) -> str:
    sql = re.sub(r"@SPINE\((\d+)\)", lambda m: f"cast(unnest(range({m[1]})) as int)", sql)
    sql = re.sub(r"datediff\(@UNIT ([^%]+)\) %", r"datediff('day', date '1995-01-01', \1) %", sql)
    sql = sql.replace("@ARR(", "list_value(")
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def standin(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = STANDINS[name]
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(_spark_text(sql), **used)


def sql_with(names: list[str], body: str) -> str:
    """A DuckDB query over the named stand-ins."""
    ctes = ", ".join(f"{n} as ({_duck_text(STANDINS[n]).strip()})" for n in names)
    body = body.strip()
    if body.startswith("with recursive "):
        return f"with recursive {ctes}, {body[15:]}"
    return f"with {ctes}, {body[5:]}" if body.startswith("with ") else f"with {ctes} {body}"
