"""Hourly zone feeds to site scores, day ratings, tides and rankings.

Feeds are long tables: marine (zone, idx, ts, swell_h, swell_dir, swell_per, swell2_h, swell2_dir,
swell2_per, chop_h, chop_dir, wave_h, sst, sea_level, current, current_dir) and weather (zone, idx,
precip, wind, wind_dir, gust, temp, cloud). ``idx`` counts hours from the start of the feed; hours may
be missing. ``ts`` is the local hour as text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shorelark.functions import conditions as fx
from shorelark.functions.conditions import RatingParams, SiteColumns
from shorelark.operators.scale import global_position, mean_of_top, nearest_within, top_per_key
from shorelark.session import shuffle_partitions

PAST_DAYS = 3  # fixed value: days of history at the start of a feed
FORECAST_DAYS = 7  # fixed value
TTL_MINUTES = 30  # fixed value: age after which a feed is fetched again
BLOCK_HOURS = 720  # hours of a zone's series that one task looks back over
SITE_PARTS = 32  # parts that the sites of a zone combination are dealt to


@dataclass(frozen=True)
class Clock:
    """Where a run stands on the hourly axis."""

    today_idx: int
    now_idx: int

    @property
    def now_hour(self) -> int:
        return self.now_idx - self.today_idx


def clock_frame(axis: DataFrame, date: str, hour: int) -> DataFrame:
    """Index of today's midnight (with a fallback) and of the current hour, clamped to the axis."""
    spans = axis.agg(
        F.max("idx").alias("_last"),
        F.min(F.when(F.col("ts") == f"{date}T00:00", F.col("idx"))).alias("_found"),
    )
    today = F.coalesce("_found", F.least(F.lit(PAST_DAYS * 24), F.col("_last")))
    return spans.select(today.alias("today_idx"), F.least(today + hour, F.col("_last")).alias("now_idx"))


def read_clock(axis: DataFrame, date: str, hour: int) -> Clock:
    row = clock_frame(axis, date, hour).first()
    return Clock(int(row.today_idx), int(row.now_idx))


# ---- zone series ----------------------------------------------------------

def looking_back(series: DataFrame, back: int, **columns: Callable[[WindowSpec], Column]) -> DataFrame:
    """Columns over the hours before each hour of a zone, by hour and not by row, so missing hours shift nothing.

    A zone is split into blocks of BLOCK_HOURS; the last ``back`` hours of a block are context of the next one, so a long
    series is never in one task. ``_block`` is there for the columns and dropped afterwards.
    """
    own, reach = (F.floor(h / BLOCK_HOURS) for h in (F.col("idx"), F.col("idx") + back))
    blocks = series.withColumn("_block", F.explode(F.sequence(own, reach)))
    hours = W.partitionBy("zone", "_block").orderBy("idx")
    seen = blocks.withColumns({name: column(hours) for name, column in columns.items()})
    return seen.filter(F.col("_block") == own).drop("_block")


def _rain(p: RatingParams) -> Callable[[WindowSpec], Column]:
    # weights relative to the block's start: one sum over the frame, whatever its length
    since = (F.col("idx") - F.col("_block") * BLOCK_HOURS) / F.lit(p.rain_decay_h)
    weighted = F.coalesce("precip", F.lit(0.0)) * F.exp(since)
    return lambda hours: F.coalesce(F.sum(weighted).over(hours.rangeBetween(-p.rain_hours, -1)), F.lit(0.0)) * F.exp(1 / F.lit(p.rain_decay_h) - since)


def _southerly(p: RatingParams) -> Callable[[WindowSpec], Column]:
    southerly = (F.col("wind_dir") > 150) & (F.col("wind_dir") < 250) & (F.col("wind") > 12)
    return lambda hours: F.count_if(southerly).over(hours.rangeBetween(-p.upwell_hours, -1))


def rain_memory(weather: DataFrame, p: RatingParams = RatingParams()) -> DataFrame:
    """Decayed rain of the hours before each hour."""
    return looking_back(weather, p.rain_hours, rain_mm=_rain(p))


def upwelling(weather: DataFrame, p: RatingParams = RatingParams()) -> DataFrame:
    """Hours of sustained southerly wind in the look-back before each hour."""
    return looking_back(weather, p.upwell_hours, upwell_h=_southerly(p))


def zone_features(weather: DataFrame, p: RatingParams = RatingParams()) -> DataFrame:
    return looking_back(weather, max(p.rain_hours, p.upwell_hours), rain_mm=_rain(p), upwell_h=_southerly(p))


def flood_ratios(discharge: DataFrame, affects: DataFrame, past: int = 31, ahead: int = FORECAST_DAYS) -> DataFrame:
    """Discharge of the coming days over a quiet baseline, per receiving water body.

    ``discharge``: river, river_ord, day_idx, q; ``affects``: river, body. A river is one short series.
    """
    history = F.array_sort(F.collect_list(F.when(F.col("day_idx") < past, F.col("q"))))
    base = discharge.groupBy("river", "river_ord").agg(history.alias("_h")).filter(F.size("_h") >= 10).select(
        "river", "river_ord",
        F.greatest(F.get("_h", F.floor(F.size("_h") * 0.25).cast("int")), F.lit(0.5)).alias("baseline"),
    )
    coming = discharge.filter(F.col("day_idx").between(past, past + ahead - 1))
    days = base.withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(ahead - 1))))
    rated = days.join(
        coming.select("river", (F.col("day_idx") - past).alias("day"), "q"), ["river", "day"], "left"
    ).select("river", "river_ord", "day", (F.col("q") / F.col("baseline")).alias("ratio"))
    bodies = rated.join(affects, "river")
    # the last river that reports for a body speaks for all of its days
    return bodies.groupBy("body", "day").agg(F.max_by("ratio", "river_ord").alias("ratio"))


# ---- site hours -----------------------------------------------------------

def prepare_sites(sites: DataFrame, p: RatingParams = RatingParams()) -> DataFrame:
    """Per-site constants, derived once before the hours fan out."""
    first = sites.withColumns({
        "body": F.coalesce("water_body", F.lit("ocean")), "mean_depth": fx.mean_depth(F.col("depth")),
        "max_exposure": F.array_max("exposure"), "mean_exposure": fx.mean_of_known(F.col("exposure")),
        "tolerance": F.when(F.coalesce("swell_tol", F.lit(0.0)) == 0, 1.0).otherwise(F.col("swell_tol")),
        "boat": F.col("type") == "boat",
    })
    return first.withColumns({
        "rain_threshold": fx.rain_threshold(F.col("body"), p),
        "turbidity_coef": F.when(F.col("mean_depth") >= 18, p.turbidity_deep).otherwise(p.turbidity),
    })


SITE_FIELDS = [
    "site_id", "marine_zone", "weather_zone", "exposure", "mean_exposure", "max_exposure", "mean_depth",
    "tolerance", "base_vis", "runoff", "body", "rain_threshold", "turbidity_coef", "boat",
]


def zone_feed(
    pairs: DataFrame, marine: DataFrame, weather: DataFrame, flood: DataFrame | None, daily: DataFrame | None,
    clock: Clock, hours: Column, p: RatingParams = RatingParams(),
) -> DataFrame:
    """One row per hour for every (marine zone, weather zone, water body) in use.

    Hours before today read the flood ratio of today, late ones the last day's; a date without a sun
    record has daylight from 7 to 17.
    """
    left = marine.filter(hours).withColumnRenamed("zone", "marine_zone")
    right = zone_features(weather, p).filter(hours).drop("ts").withColumnRenamed("zone", "weather_zone")
    feed = pairs.join(left, "marine_zone").join(right, ["weather_zone", "idx"]).withColumn(
        "day", F.floor((F.col("idx") - clock.today_idx) / 24).cast("int")
    )
    if flood is None:
        feed = feed.withColumn("flood_ratio", F.lit(None).cast("double"))
    else:
        last = flood.groupBy("body").agg(F.max("day").alias("_last"))
        feed = feed.join(last, "body", "left").withColumn("_fday", F.greatest(F.lit(0), F.least("_last", "day")))
        ratios = flood.select("body", F.col("day").alias("_fday"), F.col("ratio").alias("flood_ratio"))
        feed = feed.join(ratios, ["body", "_fday"], "left").drop("_fday", "_last")
    if daily is not None:
        feed = daylight(feed, daily)
    return feed


def site_hours(
    sites: DataFrame, marine: DataFrame, weather: DataFrame, flood: DataFrame | None, daily: DataFrame | None,
    clock: Clock, lo: int, hi: int, p: RatingParams = RatingParams(), salts: int = SITE_PARTS,
) -> DataFrame:
    """Every site with the hours ``lo`` to ``hi`` of its marine and weather zone.

    All small tables meet first, once per combination of zones in use, so sites fan out in a single
    join. Sites of one combination are spread over salts and its (short) series is repeated per salt:
    a zone that serves a third of all sites never lands in one task, no side has to fit a broadcast,
    and the window steps that follow reuse the partitioning because their key contains this one.
    """
    prepared = prepare_sites(sites, p).select(*SITE_FIELDS)
    pairs = prepared.select("marine_zone", "weather_zone", "body").distinct()
    hours = (F.col("idx") >= lo) & (F.col("idx") < hi)
    feed = zone_feed(pairs, marine, weather, flood, daily, clock, hours, p)
    salted = prepared.withColumn("salt", F.pmod(F.xxhash64("site_id"), F.lit(salts)).cast("int"))
    spread = feed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # a fixed number of partitions: adaptive coalescing would size them by the small inputs, not by the fan-out
    n, keys = shuffle_partitions(sites.sparkSession), ["marine_zone", "weather_zone", "body", "salt"]
    return salted.repartition(n, *keys).join(spread.repartition(n, *keys), keys)


# contains the join key, so no further shuffle; the site leads because sorting compares it first
SITE_KEY = ["site_id", "salt", "marine_zone", "weather_zone", "body"]


def site_order() -> WindowSpec:
    """Hours of a site in order."""
    return W.partitionBy(*SITE_KEY).orderBy("idx")


def site_columns() -> SiteColumns:
    return SiteColumns(F.col("exposure"), F.col("mean_exposure"), F.col("max_exposure"), F.col("mean_depth"))


def with_effects(hours: DataFrame, p: RatingParams = RatingParams()) -> DataFrame:
    """Effective sea and wind of each site hour, and the sea state of the hours before it."""
    site = site_columns()
    sea = fx.effective_sea(
        (F.col("swell_h"), F.col("swell_dir"), F.col("swell_per")),
        (F.col("swell2_h"), F.col("swell2_dir"), F.col("swell2_per")),
        (F.col("chop_h"), F.col("chop_dir")), site, p,
    )
    facing = fx.sector_factor(F.col("wind_dir"), F.col("exposure"), F.col("mean_exposure"))
    return hours.withColumns({
        "eff_sea": sea, "eff_wind": fx.effective_wind(F.col("wind"), F.col("wind_dir"), site), "onshore": F.col("wind") * facing
    })


def with_turbidity(hours: DataFrame, p: RatingParams = RatingParams()) -> DataFrame:
    """Mean known sea state of the look-back hours; the hour itself, or calm, without any."""
    back = F.avg("eff_sea").over(site_order().rangeBetween(-p.turbidity_hours, -1))
    return hours.withColumn("turbidity", F.coalesce(back, "eff_sea", F.lit(0.0)))


def with_visibility(hours: DataFrame, p: RatingParams = RatingParams()) -> DataFrame:
    month = F.substring("ts", 6, 2).cast("int")
    return hours.withColumn(
        "est_vis",
        fx.estimated_visibility(
            F.col("base_vis"), month, F.col("body"), F.col("upwell_h"), F.col("turbidity_coef"), F.col("turbidity"),
            F.col("runoff"), F.col("rain_mm"), F.col("rain_threshold"), F.col("flood_ratio"), p,
        ),
    )


def with_scores(hours: DataFrame, p: RatingParams = RatingParams()) -> DataFrame:
    """Part scores and total per site hour; null where sea or wind is unknown."""
    known = F.col("eff_sea").isNotNull() & F.col("eff_wind").isNotNull()
    wind = fx.wind_score(
        F.col("eff_wind"), F.col("wind"), F.col("wind_dir"), F.col("boat"), F.col("onshore"), F.col("max_exposure"), p
    )
    parts = hours.withColumns({
        "sea": F.when(known, fx.sea_score(F.col("eff_sea"), F.col("tolerance"), p)), "wind_part": F.when(known, wind),
        "vis": F.when(known, fx.visibility_score(F.col("est_vis"), F.col("base_vis"))),
    })
    total = fx.total_score(
        F.col("sea"), F.col("wind_part"), F.col("vis"), F.col("boat"), F.col("chop_h"), F.col("current"), p
    )
    return parts.withColumns({"score": total, "blown": F.col("sea") <= 0})


def score_site_hours(
    sites: DataFrame, marine: DataFrame, weather: DataFrame, flood: DataFrame | None, daily: DataFrame | None,
    clock: Clock, p: RatingParams = RatingParams(), salts: int = SITE_PARTS,
) -> DataFrame:
    """The whole chain from feeds to scored hours, limited to the hours a rating reads."""
    hours = site_hours(
        sites, marine, weather, flood, daily, clock, clock.today_idx - p.turbidity_hours,
        clock.today_idx + 24 * p.days, p, salts,
    )
    hours = with_turbidity(with_effects(hours, p), p).filter(F.col("idx") >= clock.today_idx)
    return with_scores(with_visibility(hours, p), p)


# ---- days -----------------------------------------------------------------

def daylight(hours: DataFrame, daily: DataFrame) -> DataFrame:
    """First and last daylight hour per date; 7 and 17 for a date without a record."""
    rise_h = F.substring("sunrise", 12, 2).cast("int") + F.when(F.substring("sunrise", 15, 2).cast("int") > 0, 1).otherwise(0)
    sun = daily.select("date", rise_h.alias("_rise"), F.substring("sunset", 12, 2).cast("int").alias("_set"))
    return (
        hours.withColumn("date", F.substring("ts", 1, 10)).join(sun, "date", "left")
        .withColumn("rise", F.coalesce("_rise", F.lit(7))).withColumn("set", F.coalesce("_set", F.lit(17)))
        .drop("_rise", "_set")
    )


PARTS = ["sea", "wind_part", "vis", "eff_sea", "eff_wind", "est_vis"]


def best_windows(scored: DataFrame, clock: Clock, p: RatingParams = RatingParams()) -> DataFrame:
    """Best run of hours per site and day, with the day's display figures.

    The highest mean wins, then the earliest start. Means that agree to nine decimals are equal: the same hours added in
    another order differ in the last bits.

    Windows and the day summary are keyed by supersets of the join key, so scored hours are neither
    shuffled nor sorted again.
    """
    n = p.window_hours
    order = site_order()
    pack = F.when(F.col("score").isNotNull(), F.struct("score", *PARTS, "blown"))
    hours = scored.withColumns({
        "hour": (F.col("idx") - clock.today_idx) - F.col("day") * 24, "_0": pack,
    })
    # the hours of a window side by side: one look-ahead per hour for all figures at once
    ahead = hours.withColumns({f"_lead{k}": F.lead(F.struct("idx", "_0"), k).over(order) for k in range(1, n)})
    # with missing hours the k-th hour ahead is among the next k rows, or nowhere
    counted = ahead.withColumns({
        f"_{k}": F.coalesce(*[F.when(F.col(f"_lead{j}.idx") == F.col("idx") + k, F.col(f"_lead{j}._0")) for j in range(1, k + 1)])
        for k in range(1, n)
    }).drop(*[f"_lead{k}" for k in range(1, n)])

    def over_window(c: str) -> Column:
        total = F.coalesce(F.col(f"_0.{c}"), F.lit(0.0))
        for k in range(1, n):
            total = total + F.coalesce(F.col(f"_{k}.{c}"), F.lit(0.0))
        return total

    found, blown = F.lit(0), F.lit(False)
    for k in range(n):
        found = found + F.col(f"_{k}").isNotNull().cast("int")
        blown = blown | F.coalesce(F.col(f"_{k}.blown"), F.lit(False))
    windows = counted.withColumns({
        "_n": found, "_blown": blown, **{f"_w_{c}": F.try_divide(over_window(c), found) for c in ["score", *PARTS]}
    })
    last = F.greatest(F.col("rise"), F.col("set") - n)
    first = F.when(F.col("day") == 0, F.greatest(F.col("rise"), F.least(F.lit(clock.now_hour), last))).otherwise(F.col("rise"))
    startable = F.col("hour").between(first, last) & (F.col("_n") > 0)
    in_light = F.col("hour").between(F.col("rise"), F.col("set"))
    swell_known = in_light & F.col("swell_h").isNotNull()
    wind_known = in_light & F.col("wind").isNotNull()
    rad = F.radians(F.coalesce("wind_dir", F.lit(0.0)))
    best = F.max_by(
        F.struct("hour", "_w_score", "_blown", *[f"_w_{c}" for c in PARTS]),
        F.when(startable, F.struct(F.round("_w_score", 9), -F.col("hour"))),
    )
    swell = F.max_by(
        F.struct("swell_h", "swell_dir", "swell_per"), F.when(swell_known, F.struct(F.col("swell_h"), -F.col("hour")))
    )
    rated = windows.groupBy(*SITE_KEY, "day").agg(
        F.min("date").alias("date"), best.alias("_b"), F.count_if(startable).alias("_starts"), swell.alias("_s"),
        F.count_if(swell_known).alias("_swells"),
        F.avg(F.when(wind_known, F.col("wind"))).alias("wind_mean"),
        F.sum(F.when(wind_known, F.sin(rad))).alias("_ue"), F.sum(F.when(wind_known, F.cos(rad))).alias("_un"),
        F.sum(F.coalesce("precip", F.lit(0.0))).alias("rain"),
    ).filter(F.col("_starts") > 0)
    direction = F.pmod(F.degrees(F.atan2("_ue", "_un")) + 360, F.lit(360.0))
    return rated.select(
        "site_id", "day", "date", F.col("_b._w_score").alias("score"), F.col("_b._blown").alias("blown"),
        F.col("_b.hour").alias("start_h"), (F.col("_b.hour") + n).alias("end_h"),
        *[F.col(f"_b._w_{c}").alias(c) for c in PARTS],
        F.when(F.col("_swells") > 0, F.col("_s.swell_h")).alias("swell_max"),
        F.when(F.col("_swells") > 0, F.col("_s.swell_dir")).alias("swell_dir"),
        F.when(F.col("_swells") > 0, F.col("_s.swell_per")).alias("swell_per"),
        "wind_mean", direction.alias("wind_dir"), "rain",
    ).withColumn("level", fx.band_key(F.col("score"))).withColumn("label", fx.band_label(F.col("score"), F.col("blown")))


def rate_days(
    sites: DataFrame, marine: DataFrame, weather: DataFrame, flood: DataFrame | None, daily: DataFrame, clock: Clock,
    p: RatingParams = RatingParams(),
) -> DataFrame:
    return best_windows(score_site_hours(sites, marine, weather, flood, daily, clock, p), clock, p)


def best_day(ratings: DataFrame) -> DataFrame:
    """The day whose better half of sites scores highest on average (at least five sites)."""
    wanted = F.greatest(F.lit(5), F.floor(F.col("n") / 2))
    means = mean_of_top(ratings, ["day"], "score", wanted, 0.0, 10.0)
    return means.agg(F.max_by(F.struct("day", "mean"), F.struct(F.col("mean"), -F.col("day"))).alias("_b")).select(
        "_b.day", "_b.mean"
    )


def area_day_means(ratings: DataFrame, sites: DataFrame, k: int = 5) -> DataFrame:
    """Mean of the best sites per area and day, with the area's best day marked."""
    tagged = ratings.select("site_id", "day", "score").join(sites.select("site_id", "area"), "site_id")
    top = top_per_key(tagged, ["area", "day"], [F.desc("score"), F.asc("site_id")], k)
    means = top.groupBy("area", "day").agg(F.avg("score").alias("mean"))
    best = means.groupBy("area").agg(F.max_by("day", F.struct(F.col("mean"), -F.col("day"))).alias("_best"))
    return means.join(best, "area").withColumn("best", F.col("day") == F.col("_best")).drop("_best")


# ---- summaries of feeds ---------------------------------------------------

def observation_now(scored: DataFrame, weather: DataFrame, clock: Clock) -> DataFrame:
    """What each site sees this hour, with its score, band and the rain of three days."""
    rain = rain_total(weather, clock.now_idx, 72).withColumnRenamed("zone", "weather_zone")
    now = scored.filter(F.col("idx") == clock.now_idx).withColumn("level", fx.band_key(F.col("score"))).withColumn(
        "label", fx.band_label(F.col("score"), F.col("blown"))
    )
    return now.join(rain, "weather_zone", "left").select(
        "site_id", "swell_h", "swell_dir", "swell_per", "wave_h", "sst", "wind", "wind_dir", "gust", "current",
        "current_dir", "temp", "cloud", F.coalesce("rain", F.lit(0.0)).alias("rain72"), "score", "level", "label",
    )


def rain_total(weather: DataFrame, now_idx: int, hours: int) -> DataFrame:
    span = weather.filter(F.col("idx").between(now_idx - hours, now_idx - 1))
    return span.groupBy("zone").agg(F.sum(F.coalesce("precip", F.lit(0.0))).alias("rain"))


def day_weather(weather: DataFrame, base_idx: int) -> DataFrame:
    """Coldest and warmest hour of a day, its rain and that of the two days after."""
    span = weather.filter(F.col("idx").between(base_idx, base_idx + 71)).withColumn("hour", F.col("idx") - base_idx)
    today = F.col("hour") < 24
    temp = today & F.col("temp").isNotNull()
    rain = F.coalesce("precip", F.lit(0.0))
    out = span.groupBy("zone").agg(
        F.min(F.when(temp, F.col("temp"))).alias("temp_min"),
        F.min_by("hour", F.when(temp, F.struct("temp", "hour"))).alias("_lo"),
        F.max(F.when(temp, F.col("temp"))).alias("temp_max"),
        F.max_by("hour", F.when(temp, F.struct(F.col("temp"), -F.col("hour")))).alias("_hi"),
        F.sum(F.when(today, rain).otherwise(0.0)).alias("rain_today"),
        F.sum(F.when(today, 0.0).otherwise(rain)).alias("rain_next"),
    )
    return out.select(
        "zone", "temp_min", F.when(F.col("temp_min").isNotNull(), F.col("_lo")).alias("temp_min_hour"), "temp_max",
        F.when(F.col("temp_max").isNotNull(), F.col("_hi")).alias("temp_max_hour"), "rain_today", "rain_next",
        fx.drying_class(F.col("rain_today"), F.col("rain_next")).alias("drying"),
    )


def water_temperature(sites: DataFrame, marine: DataFrame, now_idx: int) -> DataFrame:
    """Range over the distinct zones of an area; one mean figure when the spread is small."""
    zones = sites.select("area", F.col("marine_zone").alias("zone")).distinct()
    now = marine.filter((F.col("idx") == now_idx) & F.col("sst").isNotNull()).select("zone", "sst")
    out = zones.join(now, "zone").groupBy("area").agg(
        F.min("sst").alias("lo"), F.max("sst").alias("hi"), F.count(F.lit(1)).alias("zones")
    )
    return out.withColumn("single", F.when(F.col("hi") - F.col("lo") < 0.5, (F.col("lo") + F.col("hi")) / 2))


def modal_weather_zone(sites: DataFrame, ordinal: str) -> DataFrame:
    """Most used weather zone per area; among equals the one that got there first."""
    counts = sites.groupBy("area", "weather_zone").agg(F.count(F.lit(1)).alias("n"), F.max(ordinal).alias("_last"))
    return counts.groupBy("area").agg(
        F.min_by(F.struct("weather_zone", "n"), F.struct(-F.col("n"), F.col("_last"))).alias("_b")
    ).select("area", "_b.weather_zone", "_b.n")


def area_counts(sites: DataFrame, shown: Column) -> DataFrame:
    return sites.groupBy("area").agg(F.count(F.lit(1)).alias("total"), F.count_if(shown).alias("shown"))


def feed_freshness(fetches: DataFrame, now_s: int, ttl_minutes: int = TTL_MINUTES) -> DataFrame:
    """Oldest fetch of the feeds in use, whether any is a stale copy and whether it is time to fetch again."""
    return fetches.agg(F.min("fetched_s").alias("fetched_s"), F.bool_or("stale").alias("stale")).withColumn(
        "due", F.lit(now_s) - F.col("fetched_s") >= ttl_minutes * 60
    )


# ---- tides and series -----------------------------------------------------

def tide_turns(marine: DataFrame, from_idx: int, hours: int) -> DataFrame:
    """High and low water between an hour and a horizon, for zones with a level at that hour."""
    order = W.partitionBy("zone").orderBy("idx")
    level = F.col("sea_level")
    near = marine.filter(F.col("idx").between(max(1, from_idx - 1) - 1, from_idx + hours)).select("zone", "idx", "ts", "sea_level")
    seen = (
        near.withColumns({"_p": F.lag(F.struct("idx", "sea_level")).over(order), "_n": F.lead(F.struct("idx", "sea_level")).over(order)})
        .withColumn("_prev", F.when(F.col("_p.idx") == F.col("idx") - 1, F.col("_p.sea_level")))
        .withColumn("_next", F.when(F.col("_n.idx") == F.col("idx") + 1, F.col("_n.sea_level")))
        .withColumn("_at", F.max(F.when(F.col("idx") == from_idx, level)).over(W.partitionBy("zone")))
    )
    kind = F.when((level >= F.col("_prev")) & (level > F.col("_next")), "High").when(
        (level <= F.col("_prev")) & (level < F.col("_next")), "Low"
    )
    return seen.filter(
        F.col("_at").isNotNull() & F.col("idx").between(max(1, from_idx - 1), from_idx + hours - 1)
    ).withColumn("kind", kind).filter(F.col("kind").isNotNull()).select("zone", "idx", "ts", "kind", F.col("sea_level").alias("height"))


def day_tides(areas: DataFrame, marine: DataFrame, base_idx: int, fallback_zone: str, k: int = 4) -> DataFrame:
    """First turns of one day for each area's tide zone; an unknown zone falls back to a known one."""
    known = marine.select("zone").distinct().withColumn("_known", F.lit(True))
    zoned = areas.select("area", F.col("tide_zone").alias("zone")).join(known, "zone", "left").select(
        "area", F.when(F.col("_known"), F.col("zone")).otherwise(fallback_zone).alias("zone")
    )
    date = marine.filter(F.col("idx") == base_idx).select("zone", F.substring("ts", 1, 10).alias("_date"))
    turns = tide_turns(marine, max(1, base_idx), 24).join(date, "zone").filter(F.substring("ts", 1, 10) == F.col("_date"))
    first = top_per_key(turns.drop("_date"), ["zone"], [F.asc("idx")], k, "place")
    return zoned.join(first, "zone")


def tide_trend(sites: DataFrame, marine: DataFrame, clock: Clock, hours: int = 38) -> DataFrame:
    """Rising or falling now, the next turn and the note for the site's preferred tide."""
    now, after = F.col("idx") == clock.now_idx, F.col("idx") == clock.now_idx + 1
    trend = marine.filter(now | after).groupBy("zone").agg(
        F.max(F.when(now, F.col("sea_level"))).alias("_now"), F.max(F.when(after, F.col("sea_level"))).alias("_next")
    ).filter(F.col("_next").isNotNull()).select("zone", (F.col("_next") >= F.col("_now")).alias("rising"))
    turn = tide_turns(marine, clock.now_idx, hours).groupBy("zone").agg(F.min_by(F.struct("kind", "ts"), "idx").alias("_t"))
    note = (
        F.when((F.col("tide_pref") == "incoming") & F.col("rising"), "favoured (rising) tide now")
        .when(F.col("tide_pref") == "incoming", "better on the rising tide")
        .when(F.col("tide_pref") == "high", "best around high water")
        .when(F.col("tide_pref") == "low", "best near low water")
    )
    return (
        sites.select("site_id", "tide_pref", F.col("marine_zone").alias("zone")).join(trend, "zone").join(turn, "zone")
        .select("site_id", "rising", F.col("_t.kind").alias("next_kind"), F.col("_t.ts").alias("next_ts"), note.alias("note"))
    )


def series_slice(series: DataFrame, start_idx: int, hours: int) -> DataFrame:
    return series.filter(F.col("idx").between(max(0, start_idx), start_idx + hours - 1))


def series_peak(series: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Largest value and its place, the first one on ties."""
    seen = F.when(F.col(value).isNotNull(), F.struct(F.col(value), -F.col("idx")))
    return series.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.max(value).alias("peak"), F.max_by("idx", seen).alias("idx")
    )


def chart_extents(series: DataFrame, keys: list[str], value: str, step: float) -> DataFrame:
    return series.groupBy(*keys).agg(fx.chart_top(F.max(value), step).alias("top"))


def tide_extents(series: DataFrame, keys: list[str], value: str = "sea_level") -> DataFrame:
    out = series.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")).filter(F.col("_lo").isNotNull())
    lo, hi = fx.tide_range(F.col("_lo"), F.col("_hi"))
    return out.select(*keys, lo.alias("lo"), hi.alias("hi"))


# ---- sites ----------------------------------------------------------------

def filter_sites(sites: DataFrame, areas: DataFrame, area: str = "all", kind: str = "all", text: str = "") -> DataFrame:
    """Area, kind (boat leaves wrecks out, wreck is its own kind) and text over name, region and area label."""
    wreck = F.coalesce("wreck", F.lit(False))
    out = sites.join(areas.select("area", "label"), "area", "left")
    if area != "all":
        out = out.filter(F.col("area") == area)
    if kind == "shore":
        out = out.filter(F.col("type") == "shore")
    elif kind == "boat":
        out = out.filter((F.col("type") == "boat") & ~wreck)
    elif kind == "wreck":
        out = out.filter(wreck)
    if text.strip():
        hay = F.lower(F.concat_ws(" ", "name", "region", F.coalesce("label", F.lit(""))))
        out = out.filter(hay.contains(text.strip().lower()))
    return out


def nearest_monitor(sites: DataFrame, monitors: DataFrame, radius_km: float = 2.5) -> DataFrame:
    """Nearest water-quality monitor per site; ``monitors``: monitor_id, ord, lat, lng."""
    return nearest_within(sites, monitors, "site_id", "monitor_id", "ord", radius_km)


def seasonal_tags(sites: DataFrame, seasonal: DataFrame, month: int) -> DataFrame:
    """Tags of the month for each listed site; ``seasonal``: tag, tag_ord, months, site_ids."""
    now = seasonal.filter(F.array_contains("months", month)).select("tag", "tag_ord", F.explode("site_ids").alias("site_id"))
    return sites.select("site_id").join(now, "site_id")


def tag_lists(sites: DataFrame, tags: DataFrame, quality: DataFrame) -> DataFrame:
    """All tags of a site in display order. ``quality``: site_id, pollution."""
    seasonal = tags.groupBy("site_id").agg(
        F.transform(F.array_sort(F.collect_set(F.struct("tag_ord", "tag"))), lambda s: s["tag"]).alias("_seasonal")
    )
    joined = sites.join(seasonal, "site_id", "left").join(quality.select("site_id", "pollution"), "site_id", "left")
    return joined.select("site_id", fx.site_tags(
        F.col("wreck"), F.col("_seasonal"), F.col("pollution"), F.col("tide_critical"), F.col("current_note"),
        F.col("approx"), F.col("highlights"),
    ).alias("tags"))


def thin_sites(rated: DataFrame, zoom: int, ordinal: str, keep: Column) -> DataFrame:
    """Best site per grid cell at low zoom, the first one on ties; kept sites always stay."""
    if zoom > 8:
        return rated
    size = 0.3 if zoom <= 6 else 0.15
    cell = [fx.half_up(F.col(c) / size).alias(f"_cell_{c}") for c in ("lat", "lng")]
    score = F.coalesce("score", F.lit(-1.0))
    best = rated.groupBy(*cell).agg(F.min_by("site_id", F.struct(-score, F.col(ordinal))).alias("site_id"))
    exempt = rated.filter(keep).select("site_id")
    return rated.join(best.select("site_id").union(exempt).distinct(), "site_id", "left_semi")


REGION_ORDER = (  # fixed values: curated order of regions inside their area, north first
    "Pittwater & Broken Bay", "Manly & Northern Beaches", "Sydney Harbour", "Eastern Suburbs", "Botany Bay",
    "Cronulla & Port Hacking", "Royal National Park",
)
LEVEL_ORDER = ("Open Water", "Advanced", "Deep / Tech")  # fixed values


def _position(c: Column, names: tuple[str, ...] | list[str], missing: int) -> Column:
    place = F.array_position(F.lit(list(names)), c).cast("int") - 1
    return F.when(place >= 0, place).otherwise(missing)


def site_sort_keys(key: str, area_order: list[str] | None = None, regions: tuple[str, ...] = REGION_ORDER) -> list[tuple[Column, bool]]:
    """Sort columns with their direction (True is ascending); unknown values go last."""
    score = F.coalesce("score", F.lit(-1.0))
    if key == "name":
        return [(F.collate(F.col("name"), "UNICODE"), True)]
    if key == "region":
        return [(_position(F.col("area"), area_order or [], 99), True), (_position(F.col("region"), regions, -1), True), (F.col("lat"), False)]
    if key == "sea":
        return [(F.coalesce("eff_sea", F.lit(99.0)), True)]
    if key == "wind":
        return [(F.coalesce("eff_wind", F.lit(999.0)), True)]
    if key == "vis":
        return [(F.coalesce("est_vis", F.lit(-1.0)), False)]
    if key == "level":
        return [(_position(F.col("level_name"), LEVEL_ORDER, 99), True), (score, False)]
    return [(score, False)]


def order_sites(
    rated: DataFrame, key: str, ordinal: str, reverse: bool = False, favourite: Column | None = None,
    area_order: list[str] | None = None,
) -> DataFrame:
    """A site list in the chosen order; favourites lead, keeping that order among themselves."""
    keys = [*site_sort_keys(key, area_order), (F.col(ordinal), True)]
    order = [c.asc() if up != reverse else c.desc() for c, up in keys]
    lead = [F.desc(F.coalesce(favourite, F.lit(False)))] if favourite is not None else []
    return rated.orderBy(*lead, *order)


def site_places(
    rated: DataFrame, orders: list[tuple[str, bool]], site_id: str, ordinal: str, area_order: list[str] | None = None, out: str = "place"
) -> DataFrame:
    """(order, reverse, site_id, place) of every site in every asked order (key, reverse), from 1; one sort serves all of them.

    Sort keys travel as figures that rise in the wanted direction; only the name, which is compared by its collation, comes
    as text, in a column for each direction.
    """
    rows = None
    for key, reverse in orders:
        keys = [*site_sort_keys(key, area_order), (F.col(ordinal), True)]
        text = keys.pop(0)[0] if key == "name" else F.lit(None).cast("string")
        figures = [F.coalesce(c.cast("double") if up != reverse else -c.cast("double"), F.lit(float("inf"))) for c, up in keys]
        blank = F.lit(None).cast("string")
        part = rated.select(
            F.lit(key).alias("order"), F.lit(reverse).alias("reverse"), site_id, F.collate(blank if reverse else text, "UNICODE").alias("_up"),
            F.collate(text if reverse else blank, "UNICODE").alias("_down"),
            *[(figures[i] if i < len(figures) else F.lit(0.0)).alias(f"_n{i}") for i in range(4)],
        )
        rows = part if rows is None else rows.unionByName(part)
    group = [F.col("order"), F.col("reverse")]
    placed = global_position(rows, [*group, F.col("_up").asc(), F.col("_down").desc(), *[F.col(f"_n{i}").asc() for i in range(4)]], "_at")
    first = placed.groupBy("order", "reverse").agg((F.min("_at") - 1).alias("_before"))
    return placed.join(first, ["order", "reverse"]).select("order", "reverse", site_id, (F.col("_at") - F.col("_before")).alias(out))
