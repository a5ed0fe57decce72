"""Conditions: event tables as hourly zone feeds, suppliers as sites."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from shorelark.functions import conditions as fx
from shorelark.functions.conditions import COMPASS, RatingParams
from shorelark.operators import conditions as cd
from shorelark.operators.scale import top_per_key
from shorelark.plans.registry import query as register
from shorelark.plans.standins import standin, table

CLOCK = cd.Clock(today_idx=240, now_idx=249)
P = RatingParams()
MARINE = [
    "zone", "idx", "ts", "swell_h", "swell_dir", "swell_per", "swell2_h", "swell2_dir", "swell2_per", "chop_h", "chop_dir",
    "wave_h", "sst", "sea_level", "current", "current_dir",
]
WEATHER = ["zone", "idx", "ts", "precip", "wind", "wind_dir", "gust", "temp", "cloud"]


def marine(spark, sf):
    return standin(spark, sf, "zone_hours").select(*MARINE)


def weather(spark, sf):
    return standin(spark, sf, "zone_hours").select(*WEATHER)


def sites(spark, sf):
    return standin(spark, sf, "sites")


def daily(spark, sf):
    return standin(spark, sf, "daily")


def flood(spark, sf):
    return cd.flood_ratios(standin(spark, sf, "discharge"), standin(spark, sf, "affects"))


def scored(spark, sf):
    return cd.score_site_hours(
        sites(spark, sf), marine(spark, sf), weather(spark, sf), flood(spark, sf), daily(spark, sf), CLOCK, P
    )


def ratings(spark, sf):
    return cd.best_windows(scored(spark, sf), CLOCK, P)


NUDGE = 3.7e-10  # moves figures that end exactly on a half off the rounding edge, on both sides alike


def query(name, sql=None, standins=None):
    if sql is not None:
        sql = re.sub(r"round\((\w+), 6\)", rf"round(\1 + {NUDGE}, 6)", sql)
    return register(name, sql, standins)


def rounded(df, *keep, digits=6):
    """Doubles rounded so that both engines print the same figure; the named columns stay as they are."""
    return df.select(*[
        F.round(F.col(c) + NUDGE, digits).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes
    ])


# ---- the same chain in SQL ------------------------------------------------

def sec(deg: str) -> str:
    x = f"((({deg}) % 360.0 + 360.0) % 360.0) / 45.0"
    i = f"cast(floor({x}) as int)"
    f = f"({x} - floor({x}))"
    return f"case when {deg} is null then mean_exposure else exposure[{i} % 8 + 1] * (1 - {f}) + exposure[({i} + 1) % 8 + 1] * {f} end"


def dpf(per: str) -> str:
    reach = f"case when {per} is null then 20.0 else {per} * {per} / 4.0 end"
    return f"(0.8e0 + 0.6e0 * greatest(0.0e0, least(1.0e0, 1 - mean_depth / greatest({reach}, 1.0))))"


def swf(deg: str, per: str) -> str:
    wrap = f"least(0.35e0, greatest(0.0e0, ({per} - 11) * 0.06e0))"
    return f"(case when max_exposure >= 0.3 and {per} is not null then greatest({sec(deg)}, {wrap}) else {sec(deg)} end * {dpf(per)})"


def energy(h: str, deg: str, per: str) -> str:
    e = f"case when {per} is null then 1.0 else greatest({per}, 3.0) / 10.0 end"
    return f"case when {h} is null then 0.0e0 else ({h} * {swf(deg, per)}) * ({h} * {swf(deg, per)}) * ({e}) end"


THRESHOLD = "case body " + " ".join(f"when '{b}' then {mm}e0" for b, mm in P.rain_threshold.items()) + " else 55.0e0 end"
MONTHLY = "case month " + " ".join(f"when {i + 1} then {v}e0" for i, v in enumerate(P.monthly)) + " else 1.0e0 end"

SITE_SQL = f"""
prep as (select *, {THRESHOLD} as rain_threshold, case when mean_depth >= 18 then 0.30e0 else 0.55e0 end as turbidity_coef from (
  select *, coalesce(water_body, 'ocean') as body, list_max(exposure) as max_exposure,
    (exposure[1] + exposure[2] + exposure[3] + exposure[4] + exposure[5] + exposure[6] + exposure[7] + exposure[8]) / 8 as mean_exposure,
    coalesce((cast(list_extract(nums, 1) as double) + cast(list_extract(nums, -1) as double)) / 2, 12.0) as mean_depth
  from (select *, regexp_extract_all(depth, '[0-9]+(?:[.][0-9]+)?') as nums from sites) s1) s2)
"""

ZONE_SQL = """
feats as (select a.zone, a.idx, coalesce(sum(coalesce(b.precip, 0) * exp(-(a.idx - 1 - b.idx) / 30.0e0)), 0.0e0) as rain_mm,
    count(*) filter (where b.idx >= a.idx - 72 and b.wind_dir > 150 and b.wind_dir < 250 and b.wind > 12) as upwell_h
  from zone_hours a left join zone_hours b on b.zone = a.zone and b.idx between a.idx - 96 and a.idx - 1 group by a.zone, a.idx)
"""

FLOOD_SQL = """
quiet as (select river, river_ord, greatest(h[cast(floor(len(h) * 0.25) as int) + 1], 0.5) as baseline from (
    select river, river_ord, list_sort(list(q) filter (where day_idx < 31 and q is not null)) as h from discharge group by river, river_ord) x where len(h) >= 10),
flood as (select body, day, ratio from (
    select f.body, g.day, d.q / b.baseline as ratio, row_number() over (partition by f.body, g.day order by b.river_ord desc) as rn
    from quiet b join affects f on f.river = b.river, (select cast(unnest(range(7)) as int) as day) g left join discharge d on d.river = b.river and d.day_idx = 31 + g.day) y where rn = 1)
"""

HOURS_SQL = f"""
hours as (select s.*, m.idx, m.ts, m.swell_h, m.swell_dir, m.swell_per, m.swell2_h, m.swell2_dir, m.swell2_per, m.chop_h, m.chop_dir, m.wave_h, m.sst,
    m.sea_level, m.current, m.current_dir, w.precip, w.wind, w.wind_dir, w.gust, w.temp, w.cloud, f.rain_mm, f.upwell_h,
    cast(floor((m.idx - 240) / 24.0) as int) as day, cast(substr(m.ts, 6, 2) as int) as month
  from prep s join zone_hours m on m.zone = s.marine_zone join zone_hours w on w.zone = s.weather_zone and w.idx = m.idx
    join feats f on f.zone = w.zone and f.idx = w.idx where m.idx between 192 and 407),
effects as (select *, case when swell_h is null then null else sqrt({energy('swell_h', 'swell_dir', 'swell_per')} + {energy('swell2_h', 'swell2_dir', 'swell2_per')}
      + {energy('chop_h', 'chop_dir', '5.0e0')}) end as eff_sea,
    wind * (0.35e0 + 0.65e0 * ({sec('wind_dir')})) as eff_wind, wind * ({sec('wind_dir')}) as onshore from hours),
turbid as (select *, coalesce(avg(eff_sea) over (partition by site_id order by idx range between 48 preceding and 1 preceding), eff_sea, 0) as turbidity from effects),
seen as (select t.*, base_vis * ({MONTHLY}) * case when t.body = 'ocean' then 1 + 0.15e0 * greatest(0.0e0, least(1.0e0, upwell_h / 48.0e0)) else 1.0e0 end
      / (1 + turbidity_coef * turbidity) / (1 + 0.085e0 * runoff * greatest(0.0e0, rain_mm - rain_threshold))
      * case when ratio > 3 then 1 - 0.85e0 * greatest(0.0e0, least(1.0e0, (ratio - 3) / 12.0e0)) else 1.0e0 end as est_vis
  from turbid t left join flood fl on fl.body = t.body and fl.day = greatest(0, least(6, t.day)) where idx >= 240),
parts as (select *, type = 'boat' as boat, case when eff_sea is null or eff_wind is null then null when eff_sea >= 1.7e0 * swell_tol then 0.0e0 when eff_sea <= 0.25 then 10.0e0
      else 10 * (1.7e0 * swell_tol - eff_sea) / (1.7e0 * swell_tol - 0.25e0) end as sea,
    case when eff_sea is null or eff_wind is null then null else least(
      case when eff_wind <= 8 then 10.0e0 when eff_wind >= 26 then 0.0e0 else 10 * (26 - eff_wind) / 18.0e0 end,
      case when type = 'boat' then least(case when wind > 18 then 4.0e0 else 10.0e0 end,
          case when wind > 15 and not coalesce(wind_dir > 235 and wind_dir < 340, false) then 2.0e0
            when wind > 10 and not coalesce(wind_dir > 235 and wind_dir < 340, false) then 6.0e0 else 10.0e0 end)
        when max_exposure >= 0.3 and wind_dir is not null and onshore > 14 then 1.0e0
        when max_exposure >= 0.3 and wind_dir is not null and onshore > 10 then 3.0e0 else 10.0e0 end) end as wind_part,
    case when eff_sea is null or eff_wind is null then null else 10 * pow(greatest(0.0e0, least(1.0e0, est_vis / base_vis)), 1.25e0) end as vis from seen),
scored as (select *, sea <= 0 as blown, case when sea is not null then greatest(0.0e0, least(10.0e0, 0.45e0 * sea + 0.20e0 * wind_part + 0.35e0 * vis,
      case when sea <= 0 then 1.0e0 when sea < 2 then 3.5e0 else 10.0e0 end, case when wind_part <= 0 then 3.0e0 else 10.0e0 end,
      case when boat and chop_h > 1.1 then 3.5e0 else 10.0e0 end,
      case when boat and current > 3.5 then 3.5e0 when boat and current > 2.5 then 6.0e0 else 10.0e0 end)) end as score from parts)
"""

DAY_SQL = """
lit as (select s.*, s.idx - 240 - 24 * s.day as hour, coalesce(rise, 7) as rise, coalesce(setting, 17) as setting, s.ts[:10] as date from scored s left join (
    select date, cast(sunrise[12:13] as int) + case when cast(sunrise[15:16] as int) > 0 then 1 else 0 end as rise, cast(sunset[12:13] as int) as setting from daily) d
    on d.date = s.ts[:10]),
starts as (select distinct site_id, day, date, hour as s from lit where hour <= greatest(rise, setting - 3)
    and hour >= case when day = 0 then greatest(rise, least(9, greatest(rise, setting - 3))) else rise end),
cand as (select t.site_id, t.day, t.date, t.s, avg(score) as score, bool_or(blown) as blown, avg(sea) as sea, avg(wind_part) as wind_part, avg(vis) as vis,
    avg(eff_sea) as eff_sea, avg(eff_wind) as eff_wind, avg(est_vis) as est_vis
  from starts t join scored h on h.site_id = t.site_id and h.idx between 240 + 24 * t.day + t.s and 240 + 24 * t.day + t.s + 2 and h.score is not null group by all),
best as (select * from (select *, row_number() over (partition by site_id, day order by round(score, 9) desc, s) as rn from cand) x where rn = 1),
swells as (select * from (select site_id, day, swell_h as swell_max, swell_dir, swell_per, row_number() over (partition by site_id, day order by swell_h desc, idx) as rn
    from lit where hour between rise and setting and swell_h is not null) x where rn = 1),
sums as (select site_id, day, avg(wind) filter (where hour between rise and setting) as wind_mean, sum(coalesce(precip, 0)) as rain,
    sum(sin(radians(coalesce(wind_dir, 0)))) filter (where hour between rise and setting and wind is not null) as ue,
    sum(cos(radians(coalesce(wind_dir, 0)))) filter (where hour between rise and setting and wind is not null) as un from lit group by all),
rated as (select b.site_id, b.day, b.date, b.score, b.blown, b.s as start_h, b.s + 3 as end_h, b.sea, b.wind_part, b.vis, b.eff_sea, b.eff_wind, b.est_vis,
    swell_max, swell_dir, swell_per, wind_mean, (degrees(atan2(ue, un)) + 360) % 360 as wind_dir, rain,
    case when b.score >= 7 then 'good' when b.score >= 5 then 'fair' when b.score >= 3 then 'poor' else 'nogo' end as level,
    case when b.score >= 7 then 'Good' when b.score >= 5 then 'Fair' when b.score >= 3 then 'Poor' when b.blown then 'Blown out' else 'No-go' end as label
  from best b left join swells w using (site_id, day) left join sums u using (site_id, day))
"""

CHAIN = ["zone_hours", "sites", "daily", "discharge", "affects"]


def chain(name, body):
    return query(name, f"with {SITE_SQL}, {ZONE_SQL}, {FLOOD_SQL}, {HOURS_SQL}, {DAY_SQL} {body}", CHAIN)


def site_query(name, body):
    return query(name, f"with {SITE_SQL} {body}", ["sites"])


# ---- expressions ----------------------------------------------------------

@query(
    "sc37_compass_points",
    "select event_id, case when deg is null then '-' else ["
    + ", ".join(f"'{c}'" for c in COMPASS)
    + """][cast(floor(((deg % 360.0 + 360.0) % 360.0) / 22.5 + 0.5) as int) % 16 + 1] end as point
       from (select event_id, case when event_id % 9 = 0 then null else cast(user_id * 13 % 1440 as double) / 2 - 360 end as deg from events) x""",
)
def sc37(spark, sf):
    deg = F.when(F.col("event_id") % 9 != 0, (F.col("user_id") * 13 % 1440).cast("double") / 2 - 360)
    return table(spark, sf, "events").select("event_id", fx.compass_point(deg).alias("point"))


@site_query(
    "sc38_sector_factor",
    f"select site_id, d as deg, round({sec('d')}, 6) as factor from prep, (select unnest([0.0e0, 22.5e0, 44.0e0, 200.5e0, 337.5e0, 359.0e0, -30.0e0, 725.0e0, null]) as d) v",
)
def sc38(spark, sf):
    degs = F.array(*[F.lit(d) for d in (0.0, 22.5, 44.0, 200.5, 337.5, 359.0, -30.0, 725.0)], F.lit(None).cast("double"))
    rows = cd.prepare_sites(sites(spark, sf)).select("site_id", "exposure", "mean_exposure", F.explode(degs).alias("deg"))
    return rows.select("site_id", "deg", F.round(fx.sector_factor(F.col("deg"), F.col("exposure"), F.col("mean_exposure")), 6).alias("factor"))


@query(
    "sc39_mean_of_known",
    """select zone, idx, round(list_avg(list_filter([swell_h, swell2_h, chop_h, current], lambda x: x is not null)), 6) as mean from zone_hours""",
    ["zone_hours"],
)
def sc39(spark, sf):
    values = F.array("swell_h", "swell2_h", "chop_h", "current")
    return standin(spark, sf, "zone_hours").select("zone", "idx", F.round(fx.mean_of_known(values), 6).alias("mean"))


@site_query(
    "sc40_depth_period_factor",
    f"select site_id, t as period, round({dpf('t')}, 6) as factor from prep, (select unnest([0.5e0, 5.0e0, 9.0e0, 14.0e0, 20.0e0, null]) as t) v",
)
def sc40(spark, sf):
    periods = F.array(*[F.lit(t) for t in (0.5, 5.0, 9.0, 14.0, 20.0)], F.lit(None).cast("double"))
    rows = cd.prepare_sites(sites(spark, sf)).select("site_id", "mean_depth", F.explode(periods).alias("period"))
    return rows.select("site_id", "period", F.round(fx.depth_period_factor(F.col("mean_depth"), F.col("period")), 6).alias("factor"))


@site_query("sc41_mean_depth", "select site_id, depth, mean_depth from prep")
def sc41(spark, sf):
    return sites(spark, sf).select("site_id", "depth", fx.mean_depth(F.col("depth")).alias("mean_depth"))


@query(
    "sc42_score_bands",
    """select event_id, case when s is null then null when s >= 7 then 'good' when s >= 5 then 'fair' when s >= 3 then 'poor' else 'nogo' end as level,
         case when s is null then null when s >= 7 then 'Good' when s >= 5 then 'Fair' when s >= 3 then 'Poor' when b then 'Blown out' else 'No-go' end as label
       from (select event_id, case when event_id % 50 = 0 then null else cast(user_id * 7 % 101 as double) / 10 end as s, event_id % 2 = 0 as b from events) x""",
)
def sc42(spark, sf):
    score = F.when(F.col("event_id") % 50 != 0, (F.col("user_id") * 7 % 101).cast("double") / 10)
    return table(spark, sf, "events").select(
        "event_id", fx.band_key(score).alias("level"), fx.band_label(score, F.col("event_id") % 2 == 0).alias("label")
    )


def site_effects(spark, sf):
    hours = cd.site_hours(sites(spark, sf), marine(spark, sf), weather(spark, sf), None, None, CLOCK, 192, 408, P)
    return cd.with_effects(hours, P)


@chain("sc43_swell_factor", f"select site_id, idx, round({swf('swell_dir', 'swell_per')}, 6) as factor from hours")
def sc43(spark, sf):
    hours = cd.site_hours(sites(spark, sf), marine(spark, sf), weather(spark, sf), None, None, CLOCK, 192, 408, P)
    factor = fx.swell_factor(F.col("swell_dir"), F.col("swell_per"), cd.site_columns(), P)
    return hours.select("site_id", "idx", F.round(factor, 6).alias("factor"))


@chain("sc44_effective_sea", "select site_id, idx, round(eff_sea, 6) as eff_sea from effects")
def sc44(spark, sf):
    return rounded(site_effects(spark, sf).select("site_id", "idx", "eff_sea"))


@chain("sc45_effective_wind", "select site_id, idx, round(eff_wind, 6) as eff_wind from effects")
def sc45(spark, sf):
    return rounded(site_effects(spark, sf).select("site_id", "idx", "eff_wind"))


@chain("sc46_hour_scores", "select site_id, idx, round(sea, 6) as sea, round(wind_part, 6) as wind_part, round(vis, 6) as vis, round(score, 6) as score, blown from scored")
def sc46(spark, sf):
    return rounded(scored(spark, sf).select("site_id", "idx", "sea", "wind_part", "vis", "score", "blown"))


@chain("sc47_visibility", "select site_id, idx, round(est_vis, 6) as est_vis from seen")
def sc47(spark, sf):
    return rounded(scored(spark, sf).select("site_id", "idx", "est_vis"))


@query(
    "sc48_daylight_hours",
    """select zone, idx, coalesce(cast(sunrise[12:13] as int) + case when cast(sunrise[15:16] as int) > 0 then 1 else 0 end, 7) as rise,
         coalesce(cast(sunset[12:13] as int), 17) as "set" from zone_hours z left join daily d on d.date = z.ts[:10]""",
    ["zone_hours", "daily"],
)
def sc48(spark, sf):
    return cd.daylight(weather(spark, sf), daily(spark, sf)).select("zone", "idx", "rise", "set")


@query(
    "sc49_quality_scale",
    """select doc_id, case p when 'Unlikely' then 9.0e0 when 'Possible' then 5.0e0 when 'Likely' then 2.0e0 else 5.0e0 end as pollution,
         case when q is not null then case q when 'Good' then 9.0e0 when 'Fair' then 5.5e0 when 'Poor' then 2.5e0 else 5.0e0 end end as quality
       from (select doc_id, ['Unlikely', 'Possible', 'Likely', 'Other'][doc_id % 4 + 1] as p, [null, 'Good', 'Fair', 'Poor', 'Bad'][doc_id % 5 + 1] as q from documents) x""",
)
def sc49(spark, sf):
    words = F.array(*[F.lit(w) for w in ("Unlikely", "Possible", "Likely", "Other")])
    grades = F.array(F.lit(None).cast("string"), *[F.lit(w) for w in ("Good", "Fair", "Poor", "Bad")])
    return table(spark, sf, "documents").select(
        "doc_id", fx.quality_scale(F.get(words, (F.col("doc_id") % 4).cast("int")), fx.POLLUTION_SCALE).alias("pollution"),
        fx.quality_scale(F.get(grades, (F.col("doc_id") % 5).cast("int")), fx.QUALITY_SCALE).alias("quality"),
    )


_DAY_WEATHER = """
select zone, min(temp) filter (where h < 24) as temp_min, cast(min(h) filter (where h < 24 and temp = lo) as int) as temp_min_hour, max(temp) filter (where h < 24) as temp_max,
  cast(min(h) filter (where h < 24 and temp = hi) as int) as temp_max_hour, coalesce(sum(precip) filter (where h < 24), 0) as rain_today, coalesce(sum(precip) filter (where h >= 24), 0) as rain_next
from (select zone, idx - 240 as h, temp, precip, min(temp) filter (where idx < 264) over (partition by zone) as lo, max(temp) filter (where idx < 264) over (partition by zone) as hi
  from zone_hours where idx between 240 and 311) x group by zone
"""


@query(
    "sc50_drying_class",
    f"""select zone, case when rain_today < 1 and rain_next < 2 then 'easy' when rain_today < 3 and rain_next < 10 then 'fair'
          when rain_today < 10 and rain_next < 25 then 'slow' else 'grim' end as drying from ({_DAY_WEATHER}) y""",
    ["zone_hours"],
)
def sc50(spark, sf):
    return cd.day_weather(weather(spark, sf), 240).select("zone", "drying")


@query(
    "sc52_chart_extents",
    """select zone, round(greatest(5.0e0, ceil(coalesce(max(wind), 0) * 1.12e0 / 5) * 5), 6) as top, round(min(sea_level) - greatest(0.4e0, max(sea_level) - min(sea_level)) * 0.15e0, 6) as lo,
         round(max(sea_level) + greatest(0.4e0, max(sea_level) - min(sea_level)) * 0.15e0, 6) as hi from zone_hours group by zone""",
    ["zone_hours"],
)
def sc52(spark, sf):
    series = standin(spark, sf, "zone_hours")
    both = cd.chart_extents(series, ["zone"], "wind", 5.0).join(cd.tide_extents(series, ["zone"]), "zone")
    return rounded(both.select("zone", "top", "lo", "hi"))


@chain("sc53_window_passed", "select site_id, day, end_h, day = 0 and end_h <= 9 as passed from rated")
def sc53(spark, sf):
    rows = ratings(spark, sf)
    return rows.select("site_id", "day", F.col("end_h"), fx.window_passed(F.col("day"), F.col("end_h"), F.lit(CLOCK.now_hour)).alias("passed"))


SEASONAL_SQL = """
seasonal as (select 'Tag ' || cast(g as varchar) as tag, g as tag_ord, case when g % 2 = 0 then [1, 12] else [6] end as months, list(s order by s) as site_ids
  from (select cast(floor(s_suppkey / 20.0) as bigint) as g, s_suppkey as s from supplier union all select cast(floor(s_suppkey / 30.0) as bigint) + 100000, s_suppkey from supplier where s_suppkey % 2 = 0) x group by g),
tagged as (select site_id, tag, tag_ord from sites join (select tag, tag_ord, unnest(site_ids) as sid from seasonal where list_contains(months, 1)) t on t.sid = site_id)
"""


def seasonal(spark, sf):
    k = F.col("s_suppkey")
    first = table(spark, sf, "supplier").select(F.floor(k / 20).alias("tag_ord"), k.alias("s"))
    second = table(spark, sf, "supplier").filter(k % 2 == 0).select((F.floor(k / 30) + 100000).alias("tag_ord"), k.alias("s"))
    # twenty or thirty sites per tag, whatever the number of sites
    return first.unionByName(second).groupBy("tag_ord").agg(F.collect_list("s").alias("site_ids")).select(
        F.concat(F.lit("Tag "), F.col("tag_ord").cast("string")).alias("tag"), "tag_ord",
        F.when(F.col("tag_ord") % 2 == 0, F.array(F.lit(1), F.lit(12))).otherwise(F.array(F.lit(6))).alias("months"), "site_ids",
    )


@query(
    "sc55_site_tags",
    f"""with {SEASONAL_SQL} select site_id, array_to_string(list_concat(list_concat(list_concat(case when wreck then ['Shipwreck'] else [] end, coalesce((select list('In season: ' || tag order by tag_ord) from tagged t where t.site_id = s.site_id), [])),
          list_filter([case when site_id % 3 = 0 then 'Pollution likely today' end, case when tide_critical then 'Slack tide only' end,
            case when current_note then 'Tidal current, plan the tide' end, case when approx then 'Approx. location' end], lambda x: x is not null)), highlights[:4]), ';') as tags
        from sites s""",
    ["sites"],
)
def sc55(spark, sf):
    rows = sites(spark, sf)
    quality = rows.select("site_id", F.when(F.col("site_id") % 3 == 0, "Likely").otherwise("Unlikely").alias("pollution"))
    tags = cd.tag_lists(rows, cd.seasonal_tags(rows, seasonal(spark, sf), 1), quality)
    return tags.select("site_id", F.array_join("tags", ";").alias("tags"))


@query(
    "fl06_site_filter",
    """select 'boat' as kind, site_id, label from sites join areas using (area) where type = 'boat' and not wreck
       union all select 'wreck', site_id, label from sites join areas using (area) where wreck and area = 'A1'
       union all select 'text', site_id, label from sites join areas using (area) where type = 'shore' and contains(lower(name || ' ' || region || ' ' || label), 'botany')
       union all select 'label', site_id, label from sites join areas using (area) where contains(lower(name || ' ' || region || ' ' || label), 'area nation_3')""",
    ["sites", "areas"],
)
def fl06(spark, sf):
    s, a = sites(spark, sf), standin(spark, sf, "areas")
    picks = [
        ("boat", cd.filter_sites(s, a, kind="boat")), ("wreck", cd.filter_sites(s, a, "A1", "wreck")),
        ("text", cd.filter_sites(s, a, kind="shore", text=" Botany")), ("label", cd.filter_sites(s, a, text="AREA NATION_3")),
    ]
    out = None
    for kind, rows in picks:
        rows = rows.select(F.lit(kind).alias("kind"), "site_id", "label")
        out = rows if out is None else out.unionByName(rows)
    return out


# ---- joins ----------------------------------------------------------------

@chain("jn06_site_hours", "select h.site_id, h.idx, ts, swell_h, wind, round(rain_mm, 6) as rain_mm, round(ratio, 6) as flood_ratio from hours h left join flood fl on fl.body = h.body and fl.day = greatest(0, least(6, h.day))")
def jn06(spark, sf):
    hours = cd.site_hours(
        sites(spark, sf), marine(spark, sf), weather(spark, sf), flood(spark, sf), None, CLOCK, 192, 408, P, salts=3
    )
    return rounded(hours.select("site_id", "idx", "ts", "swell_h", "wind", "rain_mm", "flood_ratio"))


_MONITORS = """
mon as (select c_custkey as monitor_id, c_custkey as ord, -37 + cast(((c_custkey % 100) * 37) % 900 as double) / 100 + cast((c_custkey * 7) % 41 - 20 as double) / 1000 as lat,
  149 + cast(((c_custkey % 100) * 53) % 500 as double) / 100 + cast((c_custkey * 11) % 53 - 26 as double) / 1000 as lng from customer)
"""


def monitors(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        k.alias("monitor_id"), k.alias("ord"),
        (-37 + ((k % 100) * 37 % 900).cast("double") / 100 + (k * 7 % 41 - 20).cast("double") / 1000).alias("lat"),
        (149 + ((k % 100) * 53 % 500).cast("double") / 100 + (k * 11 % 53 - 26).cast("double") / 1000).alias("lng"),
    )


@query(
    "jn07_nearest_monitor",
    f"""with {_MONITORS} select site_id, monitor_id, round(d, 6) as distance_km from (select site_id, monitor_id, d, row_number() over (partition by site_id order by d, ord) as rn
          from (select site_id, monitor_id, ord, sqrt(((m.lat - s.lat) * 111.0e0) * ((m.lat - s.lat) * 111.0e0) + ((m.lng - s.lng) * 92.0e0) * ((m.lng - s.lng) * 92.0e0)) as d from sites s, mon m) x where d < 2.5) y where rn = 1""",
    ["sites"],
)
def jn07(spark, sf):
    return rounded(cd.nearest_monitor(sites(spark, sf), monitors(spark, sf)))


@query("jn08_seasonal_tags", f"with {SEASONAL_SQL} select site_id, tag, tag_ord from tagged", ["sites"])
def jn08(spark, sf):
    rows = sites(spark, sf)
    return cd.seasonal_tags(rows, seasonal(spark, sf), 1)


# ---- aggregates -----------------------------------------------------------

@query("ag17_day_weather", f"select zone, temp_min, temp_min_hour, temp_max, temp_max_hour, round(rain_today, 6) as rain_today, round(rain_next, 6) as rain_next from ({_DAY_WEATHER}) y", ["zone_hours"])
def ag17(spark, sf):
    return rounded(cd.day_weather(weather(spark, sf), 240).drop("drying"), "temp_min", "temp_max")


@chain("ag18_daylight_summary", "select site_id, day, swell_max, swell_dir, swell_per, round(wind_mean, 6) as wind_mean, round(wind_dir, 6) as wind_dir, round(rain, 6) as rain from rated")
def ag18(spark, sf):
    return rounded(ratings(spark, sf).select("site_id", "day", "swell_max", "swell_dir", "swell_per", "wind_mean", "wind_dir", "rain"))


@query(
    "ag19_water_temperature",
    """select area, lo, hi, zones, case when hi - lo < 0.5 then (lo + hi) / 2 end as single from (select area, min(sst) as lo, max(sst) as hi, count(*) as zones
         from (select distinct area, marine_zone from sites) s join zone_hours z on z.zone = s.marine_zone and z.idx = 249 and sst is not null group by area) x""",
    ["sites", "zone_hours"],
)
def ag19(spark, sf):
    return cd.water_temperature(sites(spark, sf), marine(spark, sf), CLOCK.now_idx)


@chain(
    "ag20_best_day",
    """select day, round(mean, 6) as mean from (select day, avg(score) as mean from (select day, score, row_number() over (partition by day order by score desc) as rn, count(*) over (partition by day) as n from rated) x
         where rn <= greatest(5, floor(n / 2.0)) group by day) y order by mean desc, day limit 1""",
)
def ag20(spark, sf):
    return rounded(cd.best_day(ratings(spark, sf)))


@chain(
    "ag21_area_best_day",
    """select area, day, round(mean, 6) as mean, rn = 1 as best from (select *, row_number() over (partition by area order by mean desc, day) as rn from (select area, day, avg(score) as mean
         from (select s.area, r.day, r.score, row_number() over (partition by s.area, r.day order by r.score desc) as k from rated r join sites s using (site_id)) x where k <= 5 group by area, day) y) z""",
)
def ag21(spark, sf):
    return rounded(cd.area_day_means(ratings(spark, sf), sites(spark, sf)))


@query(
    "ag22_modal_weather_zone",
    """select area, weather_zone, n from (select *, row_number() over (partition by area order by n desc, last) as rn from (select area, weather_zone, count(*) as n, max(pos) as last from sites group by all) x) y where rn = 1""",
    ["sites"],
)
def ag22(spark, sf):
    return cd.modal_weather_zone(sites(spark, sf), "pos")


@query("ag23_area_counts", "select area, count(*) as total, count(*) filter (where type = 'shore') as shown from sites group by 1", ["sites"])
def ag23(spark, sf):
    return cd.area_counts(sites(spark, sf), F.col("type") == "shore")


@query("ag24_flood_ratios", f"with {FLOOD_SQL} select body, day, round(ratio, 6) as ratio from flood", ["discharge", "affects"])
def ag24(spark, sf):
    return rounded(flood(spark, sf))


@query("ag25_rain_three_days", "select zone, round(sum(coalesce(precip, 0)), 6) as rain from zone_hours where idx between 177 and 248 group by 1", ["zone_hours"])
def ag25(spark, sf):
    return rounded(cd.rain_total(weather(spark, sf), CLOCK.now_idx, 72))


@query(
    "ag26_feed_freshness",
    """select min(f) as fetched_s, bool_or(s) as stale, 1706659200 - min(f) >= 1800 as due from (select event_type, cast(max(epoch_us(ts) // 1000000) as bigint) as f, count(*) % 2 = 0 as s from events group by 1) x""",
)
def ag26(spark, sf):
    fetches = table(spark, sf, "events").groupBy("event_type").agg(
        F.max(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("fetched_s"), (F.count(F.lit(1)) % 2 == 0).alias("stale")
    )
    return cd.feed_freshness(fetches, 1706659200)


# ---- windows --------------------------------------------------------------

@query("wn04_rain_memory", f"with {ZONE_SQL} select zone, idx, round(rain_mm, 6) as rain_mm from feats", ["zone_hours"])
def wn04(spark, sf):
    return rounded(cd.rain_memory(weather(spark, sf)).select("zone", "idx", "rain_mm"))


@query("wn05_upwelling_hours", f"with {ZONE_SQL} select zone, idx, upwell_h from feats", ["zone_hours"])
def wn05(spark, sf):
    return cd.upwelling(weather(spark, sf)).select("zone", "idx", "upwell_h")


@chain("wn06_turbidity", "select site_id, idx, round(turbidity, 6) as turbidity from turbid")
def wn06(spark, sf):
    return rounded(cd.with_turbidity(site_effects(spark, sf), P).select("site_id", "idx", "turbidity"))


_RATED = ["score", "sea", "wind_part", "vis", "eff_sea", "eff_wind", "est_vis"]


@chain(
    "wn07_best_windows",
    "select site_id, day, date, blown, start_h, end_h, level, label, " + ", ".join(f"round({c}, 6) as {c}" for c in _RATED) + " from rated",
)
def wn07(spark, sf):
    return rounded(ratings(spark, sf).select("site_id", "day", "date", "blown", "start_h", "end_h", "level", "label", *_RATED))


def _turns(lo: int, n: int) -> str:
    return f"""(select zone, idx, ts, sea_level as height, case when sea_level >= p and sea_level > q then 'High' when sea_level <= p and sea_level < q then 'Low' end as kind
      from (select *, max(sea_level) over (partition by zone order by idx range between 1 preceding and 1 preceding) as p, max(sea_level) over (partition by zone order by idx range between 1 following and 1 following) as q,
        max(case when idx = {lo} then sea_level end) over (partition by zone) as at0 from zone_hours) x
      where at0 is not null and idx between {max(1, lo - 1)} and {lo + n - 1} and p is not null and q is not null and sea_level is not null
        and ((sea_level >= p and sea_level > q) or (sea_level <= p and sea_level < q)))"""


@query("wn08_tide_turns", f"select zone, idx, ts, kind, height from {_turns(249, 38)} t", ["zone_hours"])
def wn08(spark, sf):
    return cd.tide_turns(marine(spark, sf), CLOCK.now_idx, 38)


@query(
    "wn09_day_tides",
    f"""select area, zone, idx, ts, kind, height, place from (select *, row_number() over (partition by zone order by idx) as place from {_turns(264, 24)} t where ts[:10] = '2024-01-12') u
        join (select area, case when tide_zone = 'nowhere' then 'view' else tide_zone end as zone from areas) a using (zone) where place <= 4""",
    ["zone_hours", "areas"],
)
def wn09(spark, sf):
    return cd.day_tides(standin(spark, sf, "areas"), marine(spark, sf), 264, "view").select(
        "area", "zone", "idx", "ts", "kind", "height", F.col("place").cast("bigint").alias("place")
    )


@query(
    "wn10_tide_trend",
    f"""select site_id, rising, next_kind, next_ts, case when tide_pref = 'incoming' and rising then 'favoured (rising) tide now' when tide_pref = 'incoming' then 'better on the rising tide'
          when tide_pref = 'high' then 'best around high water' when tide_pref = 'low' then 'best near low water' end as note
        from sites s join (select zone, max(sea_level) filter (where idx = 250) >= max(sea_level) filter (where idx = 249) as rising from zone_hours group by zone having max(sea_level) filter (where idx = 250) is not null) t
          on t.zone = s.marine_zone join (select zone, arg_min(kind, idx) as next_kind, arg_min(ts, idx) as next_ts from {_turns(249, 38)} u group by zone) n on n.zone = s.marine_zone""",
    ["sites", "zone_hours"],
)
def wn10(spark, sf):
    return cd.tide_trend(sites(spark, sf), marine(spark, sf), CLOCK)


def list_rows(spark, sf):
    k = F.col("site_id")
    return sites(spark, sf).withColumn("score", F.when(k % 13 != 0, (k * 31 % 97).cast("double") / 10)).withColumn(
        "eff_sea", F.when(k % 7 != 0, (k * 17 % 53).cast("double") / 10)).withColumn("eff_wind", (k * 19 % 71).cast("double") / 2).withColumn(
        "est_vis", (k * 23 % 61).cast("double") / 4)


@query(
    "wn12_best_per_cell",
    """with r as (select *, case when site_id % 13 <> 0 then cast(site_id * 31 % 97 as double) / 10 end as score from sites)
       select 6 as zoom, site_id, score from (select *, row_number() over (partition by floor(lat / 0.3e0 + 0.5), floor(lng / 0.3e0 + 0.5) order by coalesce(score, -1) desc, pos) as rn from r) x where rn = 1 or site_id % 29 = 0
       union all select 8, site_id, score from (select *, row_number() over (partition by floor(lat / 0.15e0 + 0.5), floor(lng / 0.15e0 + 0.5) order by coalesce(score, -1) desc, pos) as rn from r) x where rn = 1 or site_id % 29 = 0
       union all select 9, site_id, score from r""",
    ["sites"],
)
def wn12(spark, sf):
    out = None
    for zoom in (6, 8, 9):
        rows = cd.thin_sites(list_rows(spark, sf), zoom, "pos", F.col("site_id") % 29 == 0).select(F.lit(zoom).alias("zoom"), "site_id", "score")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "wn13_series_peak",
    "select zone, peak, idx from (select zone, wind as peak, idx, row_number() over (partition by zone order by wind desc, idx) as rn from zone_hours where wind is not null) x where rn = 1",
    ["zone_hours"],
)
def wn13(spark, sf):
    return cd.series_peak(weather(spark, sf), ["zone"], "wind")


@query(
    "wn14_series_slices",
    """select 'next' as part, zone, idx, wind as value from zone_hours where idx between 249 and 296
       union all select 'tide', zone, idx, sea_level from zone_hours where idx between 247 and 284""",
    ["zone_hours"],
)
def wn14(spark, sf):
    rows = standin(spark, sf, "zone_hours")
    ahead = cd.series_slice(rows, 249, 48).select(F.lit("next").alias("part"), "zone", "idx", F.col("wind").alias("value"))
    return ahead.unionByName(cd.series_slice(rows, 247, 38).select(F.lit("tide").alias("part"), "zone", "idx", F.col("sea_level").alias("value")))


@query(
    "wn15_current_index",
    """select least(coalesce(min(case when ts = '2024-01-11T00:00' then idx end), least(72, max(idx))), max(idx)) as today_idx, least(min(case when ts = '2024-01-11T00:00' then idx end) + 9, max(idx)) as now_idx from zone_hours
       union all select 72, 81 from (select 1 from zone_hours limit 1) x
       union all select max(idx) - 23, max(idx) - 3 from zone_hours""",
    ["zone_hours"],
)
def wn15(spark, sf):
    axis = marine(spark, sf).select("idx", "ts").distinct()
    found = cd.clock_frame(axis, "2024-01-11", 9)
    return found.unionByName(cd.clock_frame(axis, "2031-01-01", 9)).unionByName(cd.clock_frame(axis, "2024-01-31", 20))


@chain(
    "wn16_observation_now",
    """select site_id, swell_h, swell_dir, swell_per, wave_h, sst, wind, wind_dir, gust, current, current_dir, temp, cloud,
         round(coalesce((select sum(coalesce(precip, 0)) from zone_hours z where z.zone = s.weather_zone and z.idx between 177 and 248), 0), 6) as rain72, round(score, 6) as score,
         case when score is null then null when score >= 7 then 'good' when score >= 5 then 'fair' when score >= 3 then 'poor' else 'nogo' end as level,
         case when score is null then null when score >= 7 then 'Good' when score >= 5 then 'Fair' when score >= 3 then 'Poor' when blown then 'Blown out' else 'No-go' end as label
       from scored s where idx = 249""",
)
def wn16(spark, sf):
    return rounded(cd.observation_now(scored(spark, sf), weather(spark, sf), CLOCK))


# ---- orders ---------------------------------------------------------------

_LIST = """
with r as (select *, case when site_id % 13 <> 0 then cast(site_id * 31 % 97 as double) / 10 end as score, case when site_id % 7 <> 0 then cast(site_id * 17 % 53 as double) / 10 end as eff_sea,
  cast(site_id * 19 % 71 as double) / 2 as eff_wind, cast(site_id * 23 % 61 as double) / 4 as est_vis from sites)
"""


_SORTS = {
    "score": "coalesce(score, -1) {down}, pos {up}", "sea": "coalesce(eff_sea, 99) {up}, pos {up}", "wind": "coalesce(eff_wind, 999) {up}, pos {up}",
    "vis": "coalesce(est_vis, -1) {down}, pos {up}", "name": "name {up}, pos {up}",
    "level": "case level_name when 'Open Water' then 0 when 'Advanced' then 1 else 2 end {up}, coalesce(score, -1) {down}, pos {up}",
    "region": "coalesce(list_position(['A0', 'A1', 'A2', 'A3'], area) - 1, 99) {up}, @REGION {up}, lat {down}, pos {up}",
}
_REGION = "coalesce(list_position([" + ", ".join(f"'{r}'" for r in cd.REGION_ORDER) + "], region) - 1, -1)"


def _sorted(key: str, reverse: bool) -> str:
    up, down = ("desc", "asc") if reverse else ("asc", "desc")
    order = _SORTS[key].format(up=up, down=down).replace("@REGION", _REGION)
    return f"""select '{key}' as "order", {str(reverse).lower()} as reverse, site_id, row_number() over (order by {order}) as place from r"""


@query("so04_site_sorts", _LIST + " union all ".join(_sorted(key, reverse) for key in _SORTS for reverse in (False, True)), ["sites"])
def so04(spark, sf):
    orders = [(key, reverse) for key in _SORTS for reverse in (False, True)]
    return cd.site_places(list_rows(spark, sf), orders, "site_id", "pos", ["A0", "A1", "A2", "A3"])


@query("so05_favourites_first", _LIST + "select site_id, site_id % 10 = 3 as favourite, coalesce(score, -1) as score_key from r", ["sites"])
def so05(spark, sf):
    rows = cd.order_sites(list_rows(spark, sf), "score", "pos", favourite=F.col("site_id") % 10 == 3)
    return rows.select("site_id", (F.col("site_id") % 10 == 3).alias("favourite"), F.coalesce("score", F.lit(-1.0)).alias("score_key"))


@query(
    "so08_top_sites",
    _LIST + "select area, site_id, place from (select area, site_id, row_number() over (partition by area order by coalesce(score, -1) desc, site_id) as place from r) x where place <= 5",
    ["sites"],
)
def so08(spark, sf):
    top = top_per_key(list_rows(spark, sf), ["area"], [F.desc(F.coalesce("score", F.lit(-1.0))), F.asc("site_id")], 5, "place")
    return top.select("area", "site_id", F.col("place").cast("bigint").alias("place"))
