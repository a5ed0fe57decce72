"""Date and time expressions. Everything local is Sydney time, whatever the session zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shorelark.functions.text import let

ZONE = "Australia/Sydney"
DATE_ONLY = r"^\d{4}-\d{2}-\d{2}$"

# fixed value: month names as the schedule spells them
MONTHS = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)


def two(c: Column) -> Column:
    """At least two digits; longer numbers stay whole."""
    digits = c.cast("string")
    return F.when(F.length(digits) < 2, F.concat(F.lit("0"), digits)).otherwise(digits)


TWELVE_HOUR = r"(?U)^\s*(\d{1,2})[:.](\d{2})\s*([AaPp])\.?[Mm]\.?\s*$"
PLAIN_HOUR = r"(?U)^\s*(\d{1,2}):(\d{2})\s*$"


def clock_minutes(text: Column) -> Column:
    """'9:00 AM', '9.30 p.m.', '18:30' as minutes of the day; null when not a time."""
    def read(t: Column) -> Column:
        def part(pattern: str, group: int) -> Column:
            return none_unless_digits(F.regexp_extract(t, pattern, group))

        half = F.lower(F.regexp_extract(t, TWELVE_HOUR, 3))
        pattern_hour = F.when(half != "", part(TWELVE_HOUR, 1)).otherwise(part(PLAIN_HOUR, 1))
        pattern_minute = F.when(half != "", part(TWELVE_HOUR, 2)).otherwise(part(PLAIN_HOUR, 2))
        return F.struct(half.alias("half"), pattern_hour.alias("h"), pattern_minute.alias("m"))

    def minutes(v: Column) -> Column:
        h, half = v["h"], v["half"]
        hour = (
            F.when((half == "p") & (h < 12), h + 12).when((half == "a") & (h == 12), F.lit(0)).otherwise(h)
        )
        return F.when((hour < 24) & (v["m"] < 60), hour * 60 + v["m"])

    return let(let(text, read), minutes)


def none_unless_digits(c: Column) -> Column:
    """Digits as a number; the empty text of a failed match is null without a failing cast."""
    return F.when(c != "", c).try_cast("int")


NAME_TIME = r"(?i)\b(\d{1,2})[.:]?(\d{2})?\s*([ap])\.?m\b"


def name_times(name: Column) -> tuple[Column, Column]:
    """Times inside an item name: the first is the start, a second one after a dash the end."""
    def minutes(token: Column) -> Column:
        h = none_unless_digits(F.regexp_extract(token, NAME_TIME, 1))
        m = F.coalesce(none_unless_digits(F.regexp_extract(token, NAME_TIME, 2)), F.lit(0))
        half = F.lower(F.regexp_extract(token, NAME_TIME, 3))
        hour = F.when((half == "p") & (h != 12), h + 12).when((half == "a") & (h == 12), F.lit(0)).otherwise(h)
        return F.when((h <= 12) & (m <= 59), hour * 60 + m)

    def both(tokens: Column) -> Column:
        first = F.get(tokens, 0)
        after = F.substr(name, F.instr(name, first) + F.length(first))
        ranged = after.rlike(r"(?i)^\s*[-–]\s*\d{1,2}[.:]?(?:\d{2})?\s*[ap]\.?m\b")
        return F.struct(minutes(first).alias("start"), F.when(ranged, minutes(F.get(tokens, 1))).alias("end"))

    found = let(F.regexp_extract_all(name, F.lit(NAME_TIME), F.lit(0)), both)
    return found["start"], F.when(found["start"].isNotNull(), found["end"])


def sydney_iso(day: Column, minutes: Column) -> Column:
    """Date text, or local minute text with its offset when a time is known.

    The wall time is kept as written; a time in the spring gap gets the offset before the change and
    a repeated time the first one.
    """
    def text(v: Column) -> Column:
        hour, minute = F.floor(v["m"] / 60).cast("int"), (v["m"] % 60).cast("int")
        local = F.make_timestamp_ntz(F.year(v["d"]), F.month(v["d"]), F.dayofmonth(v["d"]), hour, minute, F.lit(0))

        def stamped(at: Column) -> Column:
            utc = F.convert_timezone(F.lit(ZONE), F.lit("UTC"), at)
            utc_minutes = F.unix_date(utc.cast("date")) * 1440 + F.hour(utc) * 60 + F.minute(utc)
            offset_h = F.round((F.unix_date(v["d"]) * 1440 + v["m"] - utc_minutes) / 60)
            return F.concat(
                v["d"].cast("string"), F.lit("T"), two(hour), F.lit(":"), two(minute), F.lit("+"),
                two(offset_h.cast("int")), F.lit(":00"),
            )

        return F.when(v["m"].isNull(), v["d"].cast("string")).otherwise(let(local, stamped))

    return let(F.struct(day.alias("d"), minutes.alias("m")), text)


def _local_seconds(ts: Column) -> Column:
    return F.unix_seconds(F.from_utc_timestamp(ts, ZONE))


def sydney_day(ts: Column) -> Column:
    """Calendar day of an instant in Sydney."""
    return F.date_from_unix_date(F.floor(_local_seconds(ts) / 86400).cast("int"))


def sydney_minutes(ts: Column) -> Column:
    return F.floor(F.pmod(_local_seconds(ts), F.lit(86400)) / 60).cast("int")


def _instant(iso: Column) -> Column:
    """Minute texts with an offset first, any longer ISO form otherwise."""
    return F.coalesce(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd'T'HH:mmXXX")), F.try_to_timestamp(iso))


def event_day(iso: Column) -> Column:
    """Date text passes through, a timestamp gives its Sydney day, anything else null."""
    return F.when(iso.rlike(DATE_ONLY), iso.try_cast("date")).otherwise(sydney_day(_instant(iso)))


def event_minutes(iso: Column) -> Column:
    return F.when(~iso.rlike(DATE_ONLY), sydney_minutes(_instant(iso)))


def epoch_event_times(start_s: Column, end_s: Column, all_day: Column) -> tuple[Column, Column]:
    """Start and end text of an event given in epoch seconds; midnight ends are exclusive."""
    start_ts, end_ts = F.timestamp_seconds(start_s), F.timestamp_seconds(end_s)
    start_day, end_day = sydney_day(start_ts), sydney_day(end_ts)
    last_day = F.when(sydney_minutes(end_ts) == 0, F.date_sub(end_day, 1)).otherwise(end_day)
    after = end_s > start_s
    start = F.when(all_day, start_day.cast("string")).otherwise(sydney_iso_instant(start_ts))
    end = F.when(all_day & after & (last_day > start_day), last_day.cast("string")).when(
        ~all_day & after, sydney_iso_instant(end_ts)
    )
    return start, end


def sydney_iso_instant(ts: Column) -> Column:
    """Local minute text of an instant with the offset in force at that instant."""
    minutes = sydney_minutes(ts)
    offset_h = F.round((_local_seconds(ts) - F.unix_seconds(ts)) / 3600).cast("int")
    return F.concat(
        sydney_day(ts).cast("string"), F.lit("T"), two(F.floor(minutes / 60).cast("int")), F.lit(":"),
        two(minutes % 60), F.lit("+"), two(offset_h), F.lit(":00"),
    )


def overnight_end(day: Column, start_min: Column, end_min: Column) -> Column:
    """An end not after the start belongs to the next day."""
    end_day = F.when(end_min > start_min, day).otherwise(F.date_add(day, 1))
    return F.when(start_min.isNotNull() & end_min.isNotNull(), sydney_iso(end_day, end_min))


# ---- dates in words -------------------------------------------------------

def long_date_iso(text: Column) -> Column:
    """'July 5, 2026' anywhere in the text as ISO text; unknown month names give null."""
    pattern = r"(?U)([A-Za-z]+)\s+(\d+),?\s+(\d{4})"

    def read(t: Column) -> Column:
        month = F.array_position(F.lit(list(MONTHS)), F.lower(F.regexp_extract(t, pattern, 1)))
        day = none_unless_digits(F.regexp_extract(t, pattern, 2))
        return F.struct(F.regexp_extract(t, pattern, 3).alias("y"), month.alias("m"), day.alias("d"))

    return let(let(text, read), lambda v: F.when(v["m"] > 0, F.concat_ws("-", v["y"], two(v["m"]), two(v["d"]))))


def day_from(text: Column, *formats: str) -> Column:
    """First format that fits, else null."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("date") for f in formats])


RELEASE_DATE = r"(?U)^\d{1,2} [A-Z][a-z]{2,8} \d{4}$"


def release_day(text: Column) -> Column:
    return F.when(text.rlike(RELEASE_DATE), day_from(text, "d MMM yyyy", "d MMMM yyyy"))


# ---- calendar arithmetic --------------------------------------------------

def month_key(day: Column) -> Column:
    return F.substring(day.cast("string"), 1, 7)


def shift_month(key: Column, n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return month_key(F.add_months(F.concat(key, F.lit("-01")).cast("date"), n))


def days_between(a: Column, b: Column) -> Column:
    return F.datediff(b, a)


# ---- labels ---------------------------------------------------------------

def _half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def _minutes_since(then: Column, now: Column) -> Column:
    return F.greatest(F.lit(0), _half_up((F.unix_micros(now) - F.unix_micros(then)) / 6e7))


def age_label(then: Column, now: Column) -> Column:
    """'just now', '5 minutes ago', '3 hours ago' below two days, then days."""
    minutes = _minutes_since(then, now)
    hours = _half_up(minutes / 60)
    days = _half_up(hours / 24)

    def ago(n: Column, unit: str) -> Column:
        return F.concat(n.cast("string"), F.when(n == 1, f" {unit}").otherwise(f" {unit}s"), F.lit(" ago"))

    return (
        F.when(minutes < 1, "just now").when(minutes < 60, ago(minutes, "minute"))
        .when(hours < 48, ago(hours, "hour")).otherwise(ago(days, "day"))
    )


def relative_label(then: Column, now: Column) -> Column:
    """As above in the calendar's wording: 'this minute', 'yesterday'."""
    minutes = _minutes_since(then, now)
    hours, days = _half_up(minutes / 60), _half_up(minutes / 1440)

    def ago(n: Column, unit: str) -> Column:
        return F.concat(n.cast("string"), F.when(n == 1, f" {unit}").otherwise(f" {unit}s"), F.lit(" ago"))

    return (
        F.when(minutes == 0, "this minute").when(minutes < 60, ago(minutes, "minute"))
        .when(minutes < 2880, ago(hours, "hour"))
        .when(days == 1, "yesterday").otherwise(ago(days, "day"))
    )


def clock_label(minutes: Column) -> Column:
    """'9:05 am'."""
    hour = F.floor(minutes / 60).cast("int")
    twelve = F.when(hour % 12 == 0, 12).otherwise(hour % 12)
    return F.concat(twelve.cast("string"), F.lit(":"), two((minutes % 60).cast("int")), F.when(hour < 12, " am").otherwise(" pm"))


def hour_label(hour: Column) -> Column:
    """'9am'."""
    twelve = F.when(hour % 12 == 0, 12).otherwise(hour % 12).cast("int")
    return F.concat(twelve.cast("string"), F.when(hour < 12, "am").otherwise("pm"))


def chip_time(iso: Column) -> Column:
    """'9 am' on the hour, else '9:05 am'."""
    return F.replace(clock_label(event_minutes(iso)), F.lit(":00 "), F.lit(" "))


def when_label(start: Column, end: Column, all_day: Column) -> Column:
    facts = F.struct(
        event_day(start).alias("s"), event_day(end).alias("e"), clock_label(event_minutes(start)).alias("at"),
        F.when(end.isNotNull() & ~end.rlike(DATE_ONLY), clock_label(event_minutes(end))).alias("until"),
    )

    def label(v: Column) -> Column:
        s, e = v["s"], F.coalesce(v["e"], v["s"])
        long_s, short_s, short_e = F.date_format(s, "EEEE d MMMM"), F.date_format(s, "EEE d MMM"), F.date_format(e, "EEE d MMM")
        tail = (
            F.when(end.isNull(), F.lit(""))
            .when(e == s, F.coalesce(F.concat(F.lit(" – "), v["until"]), F.lit("")))
            .otherwise(F.concat(F.lit(" – "), short_e, F.coalesce(F.concat(F.lit(" "), v["until"]), F.lit(""))))
        )
        timed = F.concat(long_s, F.lit(" · "), F.coalesce(v["at"], F.lit("")), tail)
        whole = F.when(e != s, F.concat(short_s, F.lit(" – "), short_e)).otherwise(F.concat(long_s, F.lit(" · all day")))
        return F.when(all_day, whole).otherwise(timed)

    return let(facts, label)
