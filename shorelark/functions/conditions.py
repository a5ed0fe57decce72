"""Scoring expressions for sites under hourly marine and weather series."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the sixteen compass points
COMPASS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")

# fixed values: score bands, best first (lowest score, key, label)
BANDS = ((7.0, "good", "Good"), (5.0, "fair", "Fair"), (3.0, "poor", "Poor"), (-math.inf, "nogo", "No-go"))


@dataclass(frozen=True)
class RatingParams:
    """Fixed values of the rating model; override a field to tune."""

    weight_sea: float = 0.45
    weight_wind: float = 0.20
    weight_vis: float = 0.35
    sea_perfect: float = 0.25
    blowout_base: float = 1.7
    wrap_start_s: float = 11.0
    wrap_per_s: float = 0.06
    wrap_max: float = 0.35
    wind_calm: float = 8.0
    wind_blown_out: float = 26.0
    turbidity: float = 0.55
    turbidity_deep: float = 0.30
    turbidity_hours: int = 48
    rain: float = 0.085
    rain_decay_h: float = 30.0
    rain_hours: int = 96
    upwell_hours: int = 72
    upwell_boost: float = 0.15
    window_hours: int = 3
    days: int = 7
    monthly: tuple[float, ...] = (0.72, 0.97, 0.93, 1.03, 1.10, 1.11, 1.10, 1.11, 1.07, 0.84, 0.81, 0.96)
    rain_threshold: dict[str, float] = field(
        default_factory=lambda: {
            "ocean": 55.0, "harbour": 30.0, "botany": 20.0, "hacking": 15.0, "hawkesbury": 25.0,
            "byron": 40.0, "macleay": 18.0, "portstephens": 32.0, "lakemac": 28.0, "newcastle": 45.0,
            "jervisbay": 42.0, "shoalhaven": 45.0, "batemans": 38.0, "tathra": 35.0, "merimbula": 28.0,
        }
    )


def half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), c))


def known(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c)


def compass_point(deg: Column) -> Column:
    step = half_up(F.pmod(deg, F.lit(360.0)) / 22.5).cast("int") % 16
    return F.when(known(deg), F.element_at(F.lit(list(COMPASS)), step + 1)).otherwise("-")


def mean_of_known(values: Column) -> Column:
    kept = F.filter(values, known)
    total = F.aggregate(kept, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(kept) > 0, total / F.size(kept))


def sector_factor(deg: Column, sectors: Column, mean: Column | None = None) -> Column:
    """Linear between eight 45-degree sectors; no direction takes their mean."""
    x = F.pmod(deg, F.lit(360.0)) / 45
    low = F.floor(x).cast("int")
    part = x - F.floor(x)
    lower, upper = F.element_at(sectors, low % 8 + 1), F.element_at(sectors, (low + 1) % 8 + 1)
    return F.when(known(deg), lower * (1 - part) + upper * part).otherwise(
        mean if mean is not None else mean_of_known(sectors)
    )


def depth_period_factor(depth: Column, period: Column) -> Column:
    reach = F.when(known(period), period * period / 4).otherwise(20.0)
    return 0.8 + 0.6 * clamp(1 - depth / F.greatest(reach, F.lit(1.0)), 0, 1)


def mean_depth(text: Column) -> Column:
    """Mean of the first and last number in the text, 12 when there is none."""
    numbers = F.regexp_extract_all(text, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))
    first, last = F.try_element_at(numbers, F.lit(1)), F.try_element_at(numbers, F.lit(-1))
    return F.coalesce((first.cast("double") + last.cast("double")) / 2, F.lit(12.0))


def band_key(score: Column) -> Column:
    out = F.lit(BANDS[-1][1])
    for low, key, _ in reversed(BANDS[:-1]):
        out = F.when(score >= low, key).otherwise(out)
    return F.when(score.isNotNull(), out)


def band_label(score: Column, blown: Column) -> Column:
    out = F.when(blown, "Blown out").otherwise(BANDS[-1][2])
    for low, _, label in reversed(BANDS[:-1]):
        out = F.when(score >= low, label).otherwise(out)
    return F.when(score.isNotNull(), out)


def swell_factor(direction: Column, period: Column, site: SiteColumns, p: RatingParams) -> Column:
    """Exposure with the long-period refraction floor, times the depth factor."""
    plain = sector_factor(direction, site.exposure, site.mean_exposure)
    floor = F.least(F.lit(p.wrap_max), F.greatest(F.lit(0.0), (period - p.wrap_start_s) * p.wrap_per_s))
    wrapped = F.when((site.max_exposure >= 0.3) & period.isNotNull(), F.greatest(plain, floor)).otherwise(plain)
    return wrapped * depth_period_factor(site.mean_depth, period)


def period_energy(period: Column) -> Column:
    return F.when(known(period), F.greatest(period, F.lit(3.0)) / 10).otherwise(1.0)


@dataclass(frozen=True)
class SiteColumns:
    """The site columns the scoring expressions read."""

    exposure: Column
    mean_exposure: Column
    max_exposure: Column
    mean_depth: Column


def _energy(height: Column, direction: Column, period: Column, site: SiteColumns, p: RatingParams) -> Column:
    a = height * swell_factor(direction, period, site, p)
    return F.when(height.isNotNull(), a * a * period_energy(period)).otherwise(0.0)


def effective_sea(
    swell: tuple[Column, Column, Column],
    second: tuple[Column, Column, Column],
    chop: tuple[Column, Column],
    site: SiteColumns,
    p: RatingParams,
) -> Column:
    """Root of summed site energy of both swells and five-second wind chop; null without swell."""
    total = (
        _energy(*swell, site, p)
        + _energy(*second, site, p)
        + _energy(chop[0], chop[1], F.lit(5.0), site, p)
    )
    return F.when(swell[0].isNotNull(), F.sqrt(total))


def effective_wind(speed: Column, direction: Column, site: SiteColumns) -> Column:
    return speed * (0.35 + 0.65 * sector_factor(direction, site.exposure, site.mean_exposure))


def monthly_factor(month: Column, p: RatingParams) -> Column:
    return F.coalesce(F.try_element_at(F.lit(list(p.monthly)), month), F.lit(1.0))


def rain_threshold(water_body: Column, p: RatingParams) -> Column:
    out = F.lit(p.rain_threshold["ocean"])
    for body, mm in p.rain_threshold.items():
        out = F.when(water_body == body, F.lit(mm)).otherwise(out)
    return out


def estimated_visibility(
    base: Column, month: Column, water_body: Column, upwell_hours: Column, turbidity_coef: Column,
    turbidity: Column, runoff: Column, rain_mm: Column, threshold: Column, flood_ratio: Column, p: RatingParams,
) -> Column:
    boost = F.when(water_body == "ocean", 1 + p.upwell_boost * clamp(upwell_hours / 48, 0, 1)).otherwise(1.0)
    excess = F.greatest(F.lit(0.0), rain_mm - threshold)
    flood = F.when(flood_ratio > 3, 1 - 0.85 * clamp((flood_ratio - 3) / 12, 0, 1)).otherwise(1.0)
    clear = base * monthly_factor(month, p) * boost / (1 + turbidity_coef * turbidity)
    return clear / (1 + p.rain * runoff * excess) * flood


def sea_score(eff_sea: Column, tolerance: Column, p: RatingParams) -> Column:
    top = p.blowout_base * tolerance
    return (
        F.when(eff_sea >= top, 0.0).when(eff_sea <= p.sea_perfect, 10.0)
        .otherwise(10 * (top - eff_sea) / (top - p.sea_perfect))
    )


def wind_score(
    eff_wind: Column, speed: Column, direction: Column, boat: Column, onshore: Column, max_exposure: Column,
    p: RatingParams,
) -> Column:
    """Ramp of effective wind, then the ceilings for boats and for exposed shore entries."""
    ramp = (
        F.when(eff_wind <= p.wind_calm, 10.0).when(eff_wind >= p.wind_blown_out, 0.0)
        .otherwise(10 * (p.wind_blown_out - eff_wind) / (p.wind_blown_out - p.wind_calm))
    )
    offshore = F.coalesce((direction > 235) & (direction < 340), F.lit(False))
    any_dir = F.when(speed > 18, 4.0).otherwise(10.0)
    by_dir = F.when((speed > 15) & ~offshore, 2.0).when((speed > 10) & ~offshore, 6.0).otherwise(10.0)
    boat_cap = F.least(any_dir, by_dir)
    shore_cap = F.when((max_exposure >= 0.3) & direction.isNotNull() & (onshore > 14), 1.0).when(
        (max_exposure >= 0.3) & direction.isNotNull() & (onshore > 10), 3.0
    ).otherwise(10.0)
    return F.least(ramp, F.when(boat, boat_cap).otherwise(shore_cap))


def visibility_score(vis: Column, base: Column) -> Column:
    return 10 * F.pow(clamp(vis / base, 0, 1), F.lit(1.25))


def total_score(
    sea: Column, wind: Column, vis: Column, boat: Column, chop_height: Column, current: Column, p: RatingParams
) -> Column:
    """Weighted blend under the ceilings; a null sea or wind part leaves the hour unscored."""
    blend = p.weight_sea * sea + p.weight_wind * wind + p.weight_vis * vis
    sea_cap = F.when(sea <= 0, 1.0).when(sea < 2, 3.5).otherwise(10.0)
    wind_cap = F.when(wind <= 0, 3.0).otherwise(10.0)
    chop_cap = F.when(boat & (chop_height > 1.1), 3.5).otherwise(10.0)
    current_cap = F.when(boat & (current > 3.5), 3.5).when(boat & (current > 2.5), 6.0).otherwise(10.0)
    capped = F.least(blend, sea_cap, wind_cap, chop_cap, current_cap)
    return F.when(sea.isNotNull() & wind.isNotNull(), clamp(capped, 0, 10))


# fixed values: meter positions of the two water-quality texts
POLLUTION_SCALE = {"Unlikely": 9.0, "Possible": 5.0, "Likely": 2.0}
QUALITY_SCALE = {"Good": 9.0, "Fair": 5.5, "Poor": 2.5}


def quality_scale(text: Column, scale: dict[str, float]) -> Column:
    out = F.lit(5.0)
    for word, value in scale.items():
        out = F.when(text == word, value).otherwise(out)
    return F.when(text.isNotNull(), out)


def drying_class(today_mm: Column, next_mm: Column) -> Column:
    return (
        F.when((today_mm < 1) & (next_mm < 2), "easy").when((today_mm < 3) & (next_mm < 10), "fair")
        .when((today_mm < 10) & (next_mm < 25), "slow").otherwise("grim")
    )


def count_size(n: Column) -> Column:
    return F.when(n < 10, "small").when(n < 100, "medium").otherwise("large")


def chart_top(peak: Column, step: float) -> Column:
    """Axis end: the peak plus 12 %, rounded up to a whole step, at least one step."""
    top = F.ceil(F.greatest(F.coalesce(peak, F.lit(0.0)), F.lit(0.0)) * 1.12 / step) * step
    return F.greatest(F.lit(float(step)), top)


def tide_range(lo: Column, hi: Column) -> tuple[Column, Column]:
    span = F.greatest(F.lit(0.4), hi - lo)
    return lo - span * 0.15, hi + span * 0.15


def window_passed(day: Column, end_h: Column, now_h: Column) -> Column:
    return (day == 0) & (end_h <= now_h)


def fixed_decimals(v: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", v)


def number_text(v: Column) -> Column:
    """One decimal below 9.95, none from there on."""
    tenth = half_up(v * 10) / 10
    return (
        F.when(v.isNull(), "-").when(v >= 9.95, half_up(tenth).cast("string"))
        .otherwise(fixed_decimals(tenth, 1))
    )


def metres_text(v: Column) -> Column:
    return F.when(v.isNull(), "-").otherwise(F.concat(fixed_decimals(v, 1), F.lit(" m")))


def knots_text(v: Column) -> Column:
    return F.when(v.isNull(), "-").otherwise(F.concat(half_up(v).cast("string"), F.lit(" kn")))


def visibility_text(v: Column) -> Column:
    body = F.when(v < 3, fixed_decimals(v, 1)).otherwise(half_up(v).cast("string"))
    return F.when(v.isNull(), "-").otherwise(F.concat(F.lit("~"), body, F.lit(" m")))


def site_tags(
    wreck: Column, seasonal: Column, pollution: Column, slack_only: Column, current_note: Column,
    approximate: Column, highlights: Column,
) -> Column:
    """Tags in display order: wreck, seasonal ones, warnings, then the first four highlights."""
    def flag(condition: Column, text: str) -> Column:
        return F.when(F.coalesce(condition, F.lit(False)), F.lit(text))

    empty = F.array().cast("array<string>")
    tags = F.concat(
        F.array(flag(wreck, "Shipwreck")),
        F.transform(F.coalesce(seasonal, empty), lambda t: F.concat(F.lit("In season: "), t)),
        F.array(
            flag(pollution == "Likely", "Pollution likely today"),
            flag(slack_only, "Slack tide only"),
            flag(current_note, "Tidal current, plan the tide"),
            flag(approximate, "Approx. location"),
        ),
        F.slice(F.coalesce(highlights, empty), 1, 4),
    )
    return F.filter(tags, lambda t: t.isNotNull())
