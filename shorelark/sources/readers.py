"""Landed files to tables: documents, hourly feeds, payload maps, several sources as one."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shorelark.functions import times as tm
from shorelark.session import cut_lineage

EVENT_SCHEMA = (
    "source string, title string, start string, end string, all_day boolean, url string, "
    "location string, description string"
)
CLASS_SCHEMA = (
    "cid string, course string, date string, iso string, location string, instructor string, instructor_id string"
)
GATHERING = 8  # sources computed side by side
EVENT_COLUMNS = [part.split()[0] for part in EVENT_SCHEMA.split(", ")]


class EmptyDocument(ValueError):
    """A document without the part it must have."""


def read_document(spark: SparkSession, path: str, required: str, item_schema: str, extra: str = "", lines: bool = False) -> DataFrame:
    """JSON documents, one to a file or one to a line; their required arrays as rows. No row at all is an error."""
    schema = f"{required} array<struct<{_colons(item_schema)}>>" + (f", {extra}" if extra else "")
    doc = spark.read.schema(schema).option("multiLine", not lines).json(path)
    rows = doc.select(F.inline(required))
    if rows.isEmpty():
        raise EmptyDocument(f"{path}: no {required}")
    return rows


def _colons(ddl: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (part.split(None, 1) for part in ddl.split(", ")))


# ---- hourly feeds ---------------------------------------------------------

# fixed values: feed variable -> column
MARINE_VARIABLES = {
    "wave_height": "wave_h", "swell_wave_height": "swell_h", "swell_wave_direction": "swell_dir",
    "swell_wave_period": "swell_per", "secondary_swell_wave_height": "swell2_h",
    "secondary_swell_wave_direction": "swell2_dir", "secondary_swell_wave_period": "swell2_per",
    "wind_wave_height": "chop_h", "wind_wave_direction": "chop_dir", "sea_surface_temperature": "sst",
    "sea_level_height_msl": "sea_level", "ocean_current_velocity": "current", "ocean_current_direction": "current_dir",
}
WEATHER_VARIABLES = {
    "precipitation": "precip", "wind_speed_10m": "wind", "wind_direction_10m": "wind_dir",
    "wind_gusts_10m": "gust", "temperature_2m": "temp", "cloud_cover": "cloud",
}


def zone_answers(polls: DataFrame, payload: str, ordinal: str = "zone_ord") -> DataFrame:
    """An answer that holds the zones of a request (one zone may come bare) to one row per poll and zone."""
    listed = F.when(F.col(payload).rlike(r"^\s*\{"), F.concat(F.lit("["), F.col(payload), F.lit("]"))).otherwise(F.col(payload))
    return polls.select("poll_id", F.posexplode(F.from_json(listed, "array<string>")).alias(ordinal, payload))


def _hour_number(text: Column) -> Column:
    """Hours of a wall time since 1970; null if it isn't one."""
    day, hour = F.substring(text, 1, 10).try_cast("date"), F.substring(text, 12, 2).try_cast("int")
    return F.unix_date(day) * 24 + hour


def first_hours(answers: DataFrame, payload: str) -> DataFrame:
    """(poll_id, first): the earliest hour that any zone of a poll reports."""
    times = F.from_json(payload, "struct<hourly: struct<time: array<string>>>")["hourly"]["time"]
    return answers.groupBy("poll_id").agg(F.min(F.array_min(times)).alias("first"))


def hourly_feed(answers: DataFrame, payload: str, variables: dict[str, str], first: DataFrame, zones: DataFrame) -> DataFrame:
    """One row per poll, zone and hour. ``answers``: poll_id, zone_ord and the JSON of that zone; ``zones``: zone_ord, zone.

    ``idx`` is the number of hours since ``first`` (poll_id, first), told from the time and not from the place in the arrays:
    a missing hour shifts nothing. Earlier hours and times that are none are left out; a time that occurs twice counts once,
    the first one. A variable that is absent is null throughout.
    """
    fields = ", ".join(["time: array<string>", *[f"{v}: array<double>" for v in variables]])
    hourly = F.from_json(payload, f"struct<hourly: struct<{fields}>>")["hourly"]
    # an absent variable is padded with nulls, it must not empty the zone
    empty = {"time": F.array().cast("array<string>")}
    arrays = [F.coalesce(F.col("_h")[n], empty.get(n, F.array().cast("array<double>"))).alias(n) for n in ["time", *variables]]
    times = F.col("_h.time")
    once = F.filter(F.arrays_zip(*arrays), lambda v, i: F.array_position(times, v["time"]) == i + 1)
    rows = answers.select("poll_id", "zone_ord", hourly.alias("_h")).select("poll_id", "zone_ord", F.explode(once).alias("_v"))
    idx = (_hour_number(F.col("_v.time")) - _hour_number(F.col("first"))).cast("int").alias("idx")
    numbered = rows.join(first, "poll_id").select(
        "poll_id", "zone_ord", idx, F.col("_v.time").alias("ts"), *[F.col(f"_v.{v}").alias(c) for v, c in variables.items()]
    )
    return numbered.filter(F.col("idx") >= 0).join(zones, "zone_ord").drop("zone_ord")


def marine_feed(marine: DataFrame, zones: DataFrame) -> DataFrame:
    """``marine``: poll_id, zone_ord, marine (JSON of one zone)."""
    return hourly_feed(marine, "marine", MARINE_VARIABLES, first_hours(marine, "marine"), zones)


def weather_feed(weather: DataFrame, marine: DataFrame, zones: DataFrame) -> DataFrame:
    """Weather hours numbered from the first hour of the marine answers of the same poll."""
    return hourly_feed(weather, "weather", WEATHER_VARIABLES, first_hours(marine, "marine"), zones).drop("ts")


def zone_hours(marine: DataFrame, weather: DataFrame) -> DataFrame:
    """Both feeds side by side: the hours of the marine feed, with nulls where the weather feed lacks the hour."""
    return marine.join(weather, ["poll_id", "zone", "idx"], "left")


def daily_feed(weather: DataFrame) -> DataFrame:
    """Sun times and rain per date, as the first zone reports them."""
    schema = "struct<daily: struct<time: array<string>, sunrise: array<string>, sunset: array<string>, precipitation_sum: array<double>>>"
    d = F.from_json("weather", schema)["daily"]
    texts, figures = F.array().cast("array<string>"), F.array().cast("array<double>")
    zipped = F.arrays_zip(
        d["time"].alias("date"), F.coalesce(d["sunrise"], texts).alias("sunrise"), F.coalesce(d["sunset"], texts).alias("sunset"),
        F.coalesce(d["precipitation_sum"], figures).alias("precip_sum"),
    )
    return weather.filter("zone_ord = 0").select("poll_id", F.inline(zipped))


def river_feed(flood: DataFrame, rivers: DataFrame) -> DataFrame:
    """Daily discharge per river. ``flood``: poll_id, river_ord, flood (JSON of one river); ``rivers``: river_ord, river."""
    q = F.from_json("flood", "struct<daily: struct<river_discharge: array<double>>>")["daily"]["river_discharge"]
    return flood.select("poll_id", "river_ord", F.posexplode(q).alias("day_idx", "q")).join(rivers, "river_ord")


def monitor_features(docs: DataFrame, payload: str = "payload") -> DataFrame:
    """GeoJSON-like features as rows; those without coordinates or properties are left out."""
    schema = (
        "struct<features: array<struct<geometry: struct<coordinates: array<double>>, "
        "properties: struct<siteName: string, pollutionForecast: string, latestResult: string>>>>"
    )
    rows = docs.select(F.posexplode(F.from_json(payload, schema)["features"]).alias("ord", "_f"))
    c = F.col("_f.geometry.coordinates")
    return rows.filter(c.isNotNull() & F.col("_f.properties").isNotNull()).select(
        "ord", F.get(c, 1).alias("lat"), F.get(c, 0).alias("lng"), F.col("_f.properties.siteName").alias("site_name"),
        F.col("_f.properties.pollutionForecast").alias("pollution"), F.col("_f.properties.latestResult").alias("latest"),
    )


# ---- payload maps ---------------------------------------------------------

def day_snippets(docs: DataFrame, payload: str) -> DataFrame:
    """``{"MM-DD-YYYY": [snippet, ...]}`` to one row per snippet."""
    days = F.from_json(F.get_json_object(payload, "$.monthlyAvailability"), "map<string,array<string>>")
    keys = [c for c in docs.columns if c != payload]
    rows = docs.select(*keys, F.explode_outer(days).alias("day_key", "_s")).filter(F.col("day_key").isNotNull())
    return rows.select(
        *keys, "day_key", F.posexplode("_s").alias("snippet_pos", "snippet")
    )


def available_days(docs: DataFrame, payload: str, month: str | None = None) -> DataFrame:
    """``{"YYYYMMDD": 0 or 1}`` to the available days: all, or those of the asked month; its grid spills over its ends."""
    days = F.from_json(F.get_json_object(payload, "$.calendar_data"), "map<string,int>")
    keys = [c for c in docs.columns if c != payload]
    day = F.try_to_timestamp(F.col("_k"), F.lit("yyyyMMdd")).cast("date")
    found = (
        docs.select(*keys, F.explode_outer(days).alias("_k", "_v"))
        .filter((F.col("_v") != 0) & F.col("_k").rlike("^[0-9]{8}$"))
        .select(*keys, day.alias("day"))
    )
    return found if month is None else found.filter(tm.month_key(F.col("day")) == F.col(month))


# ---- several sources as one -----------------------------------------------

@dataclass(frozen=True)
class Source:
    """A registered source: how it is shown and how its events are made from landed files."""

    id: str
    name: str
    short: str
    url: str
    fetch: Callable[[SparkSession], DataFrame]


def gather(spark: SparkSession, sources: list[Source]) -> tuple[DataFrame, list[tuple]]:
    """Union of all sources in registry order. A source that fails adds no rows, only its error.

    Each source is computed on its own into a checkpoint, so a failure at run time stays with it; the sources' jobs run
    side by side.
    """
    def computed(source: Source) -> DataFrame | PySparkException | Py4JError:
        try:
            events = source.fetch(spark)
            missing = [F.lit(None).cast("string").alias(c) for c in EVENT_COLUMNS if c not in events.columns]
            return cut_lineage(events.withColumn("source", F.lit(source.id)).select("*", *missing).select(*EVENT_COLUMNS))
        except (PySparkException, Py4JError) as failure:  # one broken source must not sink the rest
            return failure

    union = spark.createDataFrame([], EVENT_SCHEMA)
    status = []
    with ThreadPoolExecutor(max_workers=GATHERING) as pool:
        found = list(pool.map(computed, sources))
    for place, (source, events) in enumerate(zip(sources, found, strict=True)):
        failed = isinstance(events, Exception)
        status.append((place, source.id, source.name, source.short, source.url, "error" if failed else "ok", _reason(events) if failed else None))
        union = union if failed else union.unionByName(events)
    return union, status


def _reason(failure: Exception) -> str:
    first = (str(failure).strip().splitlines() or [""])[0]
    return f"{type(failure).__name__}: {first}"


def status_table(events: DataFrame, status: list[tuple], lo: str, hi: str) -> DataFrame:
    """Registry rows with fetched and kept counts."""
    rows = events.sparkSession.createDataFrame(
        status, "place int, id string, name string, short string, url string, status string, error string"
    )
    kept = F.substring("start", 1, 10).between(lo, hi)
    counts = events.groupBy(F.col("source").alias("id")).agg(
        F.count(F.lit(1)).alias("fetched"), F.count_if(kept).alias("event_count")
    )
    return rows.join(counts, "id", "left").fillna(0, ["fetched", "event_count"])
