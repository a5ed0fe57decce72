"""Text and time expressions over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shorelark.functions import text as tx
from shorelark.functions import times as tm
from shorelark.plans.registry import query
from shorelark.plans.standins import standin, table

# what a Unicode-aware \s matches, spelt out for an engine whose \s is ASCII only
WS = r"[\s\x0b\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def sql_strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def sql_collapse(c: str) -> str:
    return sql_strip(f"regexp_replace({c}, '{WS}+', ' ', 'g')")


def sql_entities(c: str) -> str:
    for name, char in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("lt", "<"), ("gt", ">")):
        c = f"replace({c}, '&{name};', '{char}')"
    return f"regexp_replace({c}, '&amp;?', '&', 'g')"


@query(
    "sc01_clean_text",
    f"""select doc_id, nullif({sql_strip(f"regexp_replace(regexp_replace(replace(text, chr(160), ' '), '[ \\t\\r\\f]+', ' ', 'g'), '{WS}*\\n{WS}*', chr(10), 'g')")}, '') as cleaned
    from documents""",
)
def sc01(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.clean_text(F.col("text")).alias("cleaned"))


@query(
    "sc02_html_to_line",
    f"select page_id, {sql_collapse(sql_entities('''regexp_replace(html, '<[^>]+>', ' ', 'g')'''))} as line from pages",
)
def sc02(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.html_to_line(F.col("html")).alias("line"))


@query(
    "sc03_canonical_key",
    f"select p_partkey, lower({sql_collapse('''('  ' || upper(p_name) || chr(9) || '  ' || p_brand || ' ')''')}) as loc from part",
)
def sc03(spark, sf):
    raw = F.concat(F.lit("  "), F.upper("p_name"), F.lit("\t  "), F.col("p_brand"), F.lit(" "))
    return table(spark, sf, "part").select("p_partkey", tx.canonical(raw).alias("loc"))


@query(
    "sc04_name_case",
    """select p_partkey, array_to_string(list_transform(range(1, len(s) + 1), lambda i:
         case when i = 1 or s[i - 1] in (' ', '-', '''') then upper(s[i]) else s[i] end), '') as name
       from (select p_partkey, lower(p_name || '-O''' || p_type) as s from part) x""",
)
def sc04(spark, sf):
    raw = F.concat("p_name", F.lit("-O'"), F.col("p_type"))
    return table(spark, sf, "part").select("p_partkey", tx.name_case(raw).alias("name"))


@query(
    "sc05_normal_title",
    "select ord, trim(regexp_replace(title, '(?i)\\s*\\(sold out\\)\\s*$', '')) as title from cal_events", ["cal_events"],
)
def sc05(spark, sf):
    return standin(spark, sf, "cal_events").select("ord", tx.normal_title(F.col("title")).alias("title"))


@query(
    "sc06_sold_out",
    """select ord, out_text, out_places, out_flag,
         dated || case when out_places or out_flag then ' (sold out)' else '' end as title
       from (select ord, dated, regexp_matches('x ' || weekly || case when ord % 2 = 0 then ' ( SOLD out )' else '' end,
           '(?i)\\(\\s*sold\\s*out\\s*\\)') as out_text, places_left = 0 as out_places, sold_flag as out_flag from listing_text) x""",
    ["listing_text"],
)
def sc06(spark, sf):
    df = standin(spark, sf, "listing_text")
    text = F.concat(F.lit("x "), "weekly", F.when(F.col("ord") % 2 == 0, " ( SOLD out )").otherwise(""))
    out = tx.is_sold_out(places=F.col("places_left"), flag=F.col("sold_flag"))
    return df.select(
        "ord", tx.is_sold_out(text).alias("out_text"), tx.is_sold_out(places=F.col("places_left")).alias("out_places"),
        tx.is_sold_out(flag=F.col("sold_flag")).alias("out_flag"), tx.with_sold_out(F.col("dated"), out).alias("title"),
    )


_TRAIL = (
    r"(?i)(?:\s*[-–]?\s*\d{1,2}/\d{1,2}/\d{2,4}|\s*[-–]?\s*(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
    r"[a-z]*\.?\s*[-–]?\s*\d{2,4}|\s+20\d{2})\s*$"
)


@query(
    "sc07_trailing_dates",
    f"""select ord, trim(regexp_replace(trim(regexp_replace(dated, '{_TRAIL}', ''), ' -–·'), '{_TRAIL}', ''), ' -–·') as title
        from listing_text""",
    ["listing_text"],
)
def sc07(spark, sf):
    return standin(spark, sf, "listing_text").select("ord", tx.drop_trailing_dates(F.col("dated")).alias("title"))


@query(
    "sc08_weekday_prefix",
    r"""select ord, coalesce(nullif(regexp_replace(trim(regexp_replace(weekly,
          '(?i)^(mon|tues|wednes|thurs|fri|satur|sun)day(\s+(morning|afternoon|evening|night))?\s*[-–—]*\s*', ''), ' -–—/·'),
          '\s{2,}', ' ', 'g'), ''), weekly) as title from listing_text""",
    ["listing_text"],
)
def sc08(spark, sf):
    return standin(spark, sf, "listing_text").select("ord", tx.drop_weekday(F.col("weekly")).alias("title"))


@query(
    "sc09_location_suffix",
    r"""select ord, trim(regexp_replace(placed, '(?i)\s*-\s*Sydney\s*-\s*(Alexandria|Manly)\s*$', '')) as title,
          'Shop ' || upper(l[1]) || lower(l[2:]) as location
        from (select ord, placed, nullif(regexp_extract(placed, '(?i)\s*-\s*Sydney\s*-\s*(Alexandria|Manly)\s*$', 1), '') as l
              from listing_text) x""",
    ["listing_text"],
)
def sc09(spark, sf):
    title, location = tx.split_location(F.col("placed"), tx.LOCATION_SUFFIX, "Shop ")
    return standin(spark, sf, "listing_text").select("ord", title.alias("title"), location.alias("location"))


@query(
    "sc10_time_and_price",
    r"""select ord, nullif(regexp_extract(info, '(?i)Start\s*Time:\s*(\d{1,2}:\d{2})', 1), '') as start_time,
          '$' || nullif(regexp_extract(info, '\$\s*([\d,]+(?:\.\d{2})?)', 1), '') as price,
          case when not regexp_matches(price, '^\$0(\.00)?$') then nullif(price, '') end as shown_price
        from listing_text""",
    ["listing_text"],
)
def sc10(spark, sf):
    return standin(spark, sf, "listing_text").select(
        "ord", tx.start_time_text(F.col("info")).alias("start_time"), tx.price_text(F.col("info")).alias("price"),
        tx.nonzero_price(F.col("price")).alias("shown_price"),
    )


_T12 = r"^\s*(\d{1,2})[:.](\d{2})\s*([AaPp])\.?[Mm]\.?\s*$"
_T24 = r"^\s*(\d{1,2}):(\d{2})\s*$"
CLOCK_SQL = f"""
case when regexp_matches(clock, '{_T12}') then
    case when h12 > 12 then case when h12 < 24 and m12 < 60 then h12 * 60 + m12 end
      else (h12 % 12 + case when ap = 'p' then 12 else 0 end) * 60 + m12 end
  when h24 < 24 and m24 < 60 then h24 * 60 + m24 end"""


@query(
    "sc11_clock_minutes",
    f"""select ord, {CLOCK_SQL} as minutes from (select ord, clock,
          try_cast(regexp_extract(clock, '{_T12}', 1) as int) as h12, try_cast(regexp_extract(clock, '{_T12}', 2) as int) as m12,
          lower(regexp_extract(clock, '{_T12}', 3)) as ap, try_cast(regexp_extract(clock, '{_T24}', 1) as int) as h24,
          try_cast(regexp_extract(clock, '{_T24}', 2) as int) as m24 from listing_text) x""",
    ["listing_text"],
)
def sc11(spark, sf):
    return standin(spark, sf, "listing_text").select("ord", tm.clock_minutes(F.col("clock")).alias("minutes"))


@query(
    "sc12_name_times",
    r"""select ord, case when h1 <= 12 and m1 <= 59 then (h1 % 12 + case when p1 = 'p' then 12 else 0 end) * 60 + m1 end as start_min,
          case when h1 <= 12 and m1 <= 59 and rng and h2 <= 12 and m2 <= 59
            then (h2 % 12 + case when p2 = 'p' then 12 else 0 end) * 60 + m2 end as end_min
        from (select ord, try_cast(regexp_extract(item_name, '{T}', 1) as int) as h1, coalesce(try_cast(regexp_extract(item_name, '{T}', 2) as int), 0) as m1,
            lower(regexp_extract(item_name, '{T}', 3)) as p1, try_cast(regexp_extract(item_name, '{U}', 1) as int) as h2,
            coalesce(try_cast(regexp_extract(item_name, '{U}', 2) as int), 0) as m2, lower(regexp_extract(item_name, '{U}', 3)) as p2,
            regexp_matches(item_name, '{U}') as rng from listing_text) b""".replace("{T}", r"(?i)\b(\d{1,2})[.:]?(\d{2})?\s*([ap])\.?m\b")
    .replace("{U}", r"(?i)m\s*[-–]\s*(\d{1,2})[.:]?(\d{2})?\s*([ap])\.?m\b"),
    ["listing_text"],
)
def sc12(spark, sf):
    start, end = tm.name_times(F.col("item_name"))
    return standin(spark, sf, "listing_text").select("ord", start.alias("start_min"), end.alias("end_min"))


@query(
    "sc13_join_parts",
    r"""select ord, nullif(array_to_string(list_filter([
            case when not regexp_matches(price, '^\$0(\.00)?$') then nullif(price, '') end,
            case when not contains(lower(weekly), lower('dive ' || cast(ord % 3 as varchar))) then 'dive ' || cast(ord % 3 as varchar) end,
            nullif(trim(info), '')], lambda x: x is not null), ' · '), '') as description from listing_text""",
    ["listing_text"],
)
def sc13(spark, sf):
    group = F.concat(F.lit("dive "), (F.col("ord") % 3).cast("string"))
    part = F.when(~F.lower("weekly").contains(F.lower(group)), group)
    return standin(spark, sf, "listing_text").select(
        "ord", tx.join_parts(tx.nonzero_price(F.col("price")), part, tx.strip(F.col("info"))).alias("description")
    )


@query(
    "sc14_description_fallback",
    f"""select page_id, coalesce(case when page_id % 3 = 0 then 'Short ' || cast(page_id as varchar) end,
          case when page_id % 3 = 1 then nullif({sql_collapse(sql_entities('''regexp_replace(html, '<[^>]+>', ' ', 'g')'''))}, '') end) as description
        from pages""",
)
def sc14(spark, sf):
    from shorelark.sources.listings import description_of

    third = F.col("page_id") % 3
    short = F.when(third == 0, F.concat(F.lit("  Short  "), F.col("page_id").cast("string")))
    long = F.when(third == 1, F.col("html")).otherwise(F.lit(""))
    return table(spark, sf, "pages").select("page_id", description_of(short, F.lit(""), long).alias("description"))


@query(
    "sc15_ellipsis",
    f"""select doc_id, case when length(text) > 700 then regexp_replace(text[:699], '{WS}+$', '') || '…' else text end as shown,
          regexp_replace(text || ' ... (Read More) ', '{WS}*\\.{{3}}{WS}*\\(Read More\\){WS}*$', '…')[:400] as summary from documents""",
)
def sc15(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", tx.ellipsis_after(F.col("text"), 700).alias("shown"),
        tx.summary_text(F.concat("text", F.lit(" ... (Read More) "))).alias("summary"),
    )


@query(
    "sc16_clean_url",
    r"""select ord, regexp_replace(case when regexp_matches(href, '^[a-z]+:') then href when starts_with(href, '/') then 'https://s.example.org' || href
            else 'https://s.example.org/' || href end, '[?#].*$', '') as bare,
          case when href is not null then 'https://w.example.org' || case when regexp_matches(href, '^https') then '/a/b' else regexp_replace(href, '[?#].*$', '') end
            || case when contains(href, 'q=') then '?' || regexp_extract(href, 'q=[0-9]+', 0)
               when contains(href, 'preferredDate') then '?' || regexp_extract(href, 'preferredDate=[-0-9]+', 0) || '&preferredTime=9%3A00+AM' else '' end end as rebased
        from listing_text""",
    ["listing_text"],
)
def sc16(spark, sf):
    return standin(spark, sf, "listing_text").select(
        "ord", tx.drop_query(tx.absolute_url(F.col("href"), "https://s.example.org/")).alias("bare"),
        tx.rebase_without(F.col("href"), "https://w.example.org", ["PHPSESSID", "iframe"]).alias("rebased"),
    )


@query(
    "sc17_query_value",
    r"""select ord, nullif(regexp_extract(href, '[?&]preferredDate=([^&#]*)', 1), '') as preferred_date,
          case when contains(href, 'preferredTime=') then '9:00 AM' end as preferred_time from listing_text""",
    ["listing_text"],
)
def sc17(spark, sf):
    return standin(spark, sf, "listing_text").select(
        "ord", tx.query_value(F.col("href"), "preferredDate").alias("preferred_date"),
        tx.query_value(F.col("href"), "preferredTime").alias("preferred_time"),
    )


@query(
    "sc18_deep_link",
    """select ord, 'https://example.org/d?cid=' || case when ord % 4 <> 0 then cast(ord as varchar) end as link,
         'https://example.org/p/?date=' || strftime(day, '%Y-%m-%d') || '#' || cast(ord as varchar) || '@book@' as booking from listing_text""",
    ["listing_text"],
)
def sc18(spark, sf):
    return standin(spark, sf, "listing_text").select(
        "ord", tx.deep_link("https://example.org/d?cid=", F.when(F.col("ord") % 4 != 0, F.col("ord"))).alias("link"),
        F.concat(F.lit("https://example.org/p/?date="), F.col("day").cast("string"), F.lit("#"), F.col("ord").cast("string"), F.lit("@book@")).alias("booking"),
    )


@query(
    "sc19_event_id",
    """select ord, source || '-' || substr(sha1(source || '|' || title || '|' || start_at || '|' || coalesce(url, '')), 1, 12) as id
       from cal_events""",
    ["cal_events"],
)
def sc19(spark, sf):
    return standin(spark, sf, "cal_events").select(
        "ord", tx.event_id(F.col("source"), F.col("title"), F.col("start_at"), F.col("url")).alias("id")
    )


# offset of a wall time: the daylight one where the time exists under it, so a repeated hour takes the first
OFFSET_SQL = "case when timezone('Australia/Sydney', timezone('UTC', {0} - interval 11 hour)) = {0} then '11' else '10' end"


@query(
    "sc20_local_iso",
    f"""select ord, case when ord % 5 = 0 then strftime(day, '%Y-%m-%d') else strftime(local, '%Y-%m-%dT%H:%M') || '+'
           || {OFFSET_SQL.format('local')} || ':00' end as iso
       from (select ord, day, day + to_minutes(cast((4 + ord % 20) * 60 + ord % 60 as bigint)) as local from listing_text) x""",
    ["listing_text"],
)
def sc20(spark, sf):
    minutes = F.when(F.col("ord") % 5 != 0, ((4 + F.col("ord") % 20) * 60 + F.col("ord") % 60).cast("int"))
    return standin(spark, sf, "listing_text").select("ord", tm.sydney_iso(F.col("day"), minutes).alias("iso"))


_LOCAL = "timezone('Australia/Sydney', to_timestamp(cast({0} as bigint)))"
_ISO = (
    "strftime({0}, '%Y-%m-%dT%H:%M') || '+' || lpad(cast(date_diff('hour', timezone('UTC', to_timestamp(cast({1} as bigint))), {0}) as varchar), 2, '0') || ':00'"
)


@query(
    "sc21_epoch_times",
    f"""select ord, case when ad then strftime(ls, '%Y-%m-%d') else {_ISO.format('ls', 's')} end as start_at,
          case when e > s and ad then case when ed > cast(ls as date) then strftime(ed, '%Y-%m-%d') end
               when e > s then {_ISO.format('le', 'e')} end as end_at
        from (select *, cast(le as date) - case when hour(le) = 0 and minute(le) = 0 then 1 else 0 end as ed from (
          select *, {_LOCAL.format('s')} as ls, {_LOCAL.format('e')} as le from (
            select o_orderkey as ord, o_orderkey % 3 = 0 as ad,
              epoch(o_orderdate)::bigint + (o_orderkey % 24) * 3600 as s,
              case when o_orderkey % 4 <> 0 then epoch(o_orderdate)::bigint + (o_orderkey % 7) * 86400 + (13 + o_orderkey % 2) * 3600 end as e
            from orders) a) b) c""",
)
def sc21(spark, sf):
    day_s = F.unix_date(F.col("o_orderdate").cast("date")) * F.lit(86400).cast("bigint")
    k = F.col("o_orderkey")
    start, end = tm.epoch_event_times(
        day_s + (k % 24) * 3600, F.when(k % 4 != 0, day_s + (k % 7) * 86400 + (13 + k % 2) * 3600), k % 3 == 0
    )
    return table(spark, sf, "orders").select(k.alias("ord"), start.alias("start_at"), end.alias("end_at"))


@query(
    "sc22_overnight_end",
    f"""select ord, strftime(local, '%Y-%m-%dT%H:%M') || '+' || {OFFSET_SQL.format('local')} || ':00' as end_at
       from (select ord, day + to_days(cast(case when em > sm then 0 else 1 end as int)) + to_minutes(em) as local
         from (select ord, day, cast(1200 + ord % 200 as bigint) as sm, cast(900 + ord % 540 as bigint) as em from listing_text) a) b""",
    ["listing_text"],
)
def sc22(spark, sf):
    start, end = (1200 + F.col("ord") % 200).cast("int"), (900 + F.col("ord") % 540).cast("int")
    return standin(spark, sf, "listing_text").select("ord", tm.overnight_end(F.col("day"), start, end).alias("end_at"))


@query(
    "sc23_written_dates",
    """select ord, strftime(day, '%Y-%m-%d') as long_date, case when ord % 6 <> 0 then strftime(day, '%Y-%m-%d') end as short_date
       from listing_text""",
    ["listing_text"],
)
def sc23(spark, sf):
    day, form = F.col("day"), F.col("ord") % 6
    long_text = F.concat(F.lit("Starts "), F.date_format(day, "MMMM d, yyyy"), F.lit(" (Sat)"))
    short_text = (
        F.when(form == 0, "31 Feb 2020").when(form == 1, F.date_format(day, "d MMM yyyy"))
        .when(form == 2, F.date_format(day, "dd-MMM-yyyy")).when(form == 3, F.upper(F.date_format(day, "d MMM yyyy")))
        .otherwise(F.date_format(day, "MM-dd-yyyy"))
    )
    return standin(spark, sf, "listing_text").select(
        "ord", tm.long_date_iso(long_text).alias("long_date"),
        tm.day_from(short_text, "d MMM yyyy", "d-MMM-yyyy", "MM-dd-yyyy").cast("string").alias("short_date"),
    )


EVENT_DAY_SQL = (
    "case when length({0}) = 10 then cast({0} as date) else cast(timezone('Australia/Sydney', cast({0} as timestamptz)) as date) end"
)


@query(
    "sc24_event_day",
    f"select ord, strftime({EVENT_DAY_SQL.format('start_at')}, '%Y-%m-%d') as start_day, strftime({EVENT_DAY_SQL.format('end_at')}, '%Y-%m-%d') as end_day from cal_events",
    ["cal_events"],
)
def sc24(spark, sf):
    return standin(spark, sf, "cal_events").select(
        "ord", tm.event_day(F.col("start_at")).cast("string").alias("start_day"),
        tm.event_day(F.col("end_at")).cast("string").alias("end_day"),
    )


@query(
    "sc25_date_arithmetic",
    """select ord, strftime(day + cast(ord % 400 as int), '%Y-%m-%d') as later, cast(date_diff('day', date '1996-06-30', day) as bigint) as days,
         strftime(day, '%Y-%m') as month, strftime(date_trunc('month', day) + to_months(cast(ord % 30 - 14 as int)), '%Y-%m') as shifted
       from listing_text""",
    ["listing_text"],
)
def sc25(spark, sf):
    k = F.col("ord")
    return standin(spark, sf, "listing_text").select(
        "ord", F.date_add("day", (k % 400).cast("int")).cast("string").alias("later"),
        tm.days_between(F.lit("1996-06-30").cast("date"), F.col("day")).cast("bigint").alias("days"),
        tm.month_key(F.col("day")).alias("month"),
        tm.shift_month(tm.month_key(F.col("day")), (k % 30 - 14).cast("int")).alias("shifted"),
    )


def _ago(n: str, unit: str) -> str:
    return f"cast({n} as bigint)::varchar || case when {n} = 1 then ' {unit}' else ' {unit}s' end || ' ago'"


@query(
    "sc26_age_labels",
    f"""select event_id, case when m < 1 then 'just now' when m < 60 then {_ago('m', 'minute')} when floor(m / 60.0 + 0.5) < 48 then {_ago('floor(m / 60.0 + 0.5)', 'hour')}
          else {_ago('floor(floor(m / 60.0 + 0.5) / 24 + 0.5)', 'day')} end as age,
        case when m = 0 then 'this minute' when m < 60 then {_ago('m', 'minute')} when m < 2880 then {_ago('floor(m / 60.0 + 0.5)', 'hour')}
          when floor(m / 1440.0 + 0.5) = 1 then 'yesterday' else {_ago('floor(m / 1440.0 + 0.5)', 'day')} end as relative
        from (select event_id, greatest(0, floor(date_diff('microsecond', ts, timestamp '2024-01-12 00:00:00') / 60000000.0 + 0.5)) as m from events) x""",
)
def sc26(spark, sf):
    then, now = F.col("ts").cast("timestamp"), F.lit("2024-01-12 00:00:00").cast("timestamp_ntz").cast("timestamp")
    return table(spark, sf, "events").select(
        "event_id", tm.age_label(then, now).alias("age"), tm.relative_label(then, now).alias("relative")
    )


_CLOCK = "regexp_replace(strftime({0}, '%I:%M'), '^0', '') || case when hour({0}) < 12 then ' am' else ' pm' end"
_SDAY = "strftime({0}, '%a') || ' ' || cast(day({0}) as varchar) || ' ' || strftime({0}, '%b')"
_LDAY = "strftime({0}, '%A') || ' ' || cast(day({0}) as varchar) || ' ' || strftime({0}, '%B')"


@query(
    "sc27_when_label",
    f"""select ord, case when all_day and e <> s then {_SDAY.format('s')} || ' – ' || {_SDAY.format('e')}
            when all_day then {_LDAY.format('s')} || ' · all day'
            else {_LDAY.format('s')} || ' · ' || {_CLOCK.format('st')} || case when end_at is null or e = s then '' else ' – ' || {_SDAY.format('e')} end end as label,
          replace({_CLOCK.format('st')}, ':00 ', ' ') as chip
        from (select *, coalesce(cast(end_at as date), s) as e from (
          select *, {EVENT_DAY_SQL.format('start_at')} as s,
            case when not all_day then timezone('Australia/Sydney', cast(start_at as timestamptz)) end as st from cal_events) a) b""",
    ["cal_events"],
)
def sc27(spark, sf):
    return standin(spark, sf, "cal_events").select(
        "ord", tm.when_label(F.col("start_at"), F.col("end_at"), F.col("all_day")).alias("label"),
        tm.chip_time(F.col("start_at")).alias("chip"),
    )


_SKIP = (
    "length(name) not between 2 and 80 or regexp_matches(name, '^[0-9]') or name in ("
    + ", ".join(f"'{n}'" for n in tx.SKIP_EXACT) + ") or " + " or ".join(f"starts_with(name, '{n}')" for n in tx.SKIP_PREFIXES)
)


@query(
    "sc28_skip_names",
    f"""select doc_id, name, {_SKIP} as skip, {_SKIP.replace('name', 'text')} as skip_text from (select doc_id, text, case doc_id % 9 when 0 then 'Impact' when 1 then 'iOS ' || source when 2 then cast(doc_id as varchar) || ' x'
          when 3 then 'About ' || lang when 4 then 'k' when 5 then source || '''s ' || lang else source || ' ' || lang end as name from documents) x""",
)
def sc28(spark, sf):
    k = F.col("doc_id")
    name = (
        F.when(k % 9 == 0, "Impact").when(k % 9 == 1, F.concat(F.lit("iOS "), "source"))
        .when(k % 9 == 2, F.concat(k.cast("string"), F.lit(" x"))).when(k % 9 == 3, F.concat(F.lit("About "), "lang"))
        .when(k % 9 == 4, "k").when(k % 9 == 5, F.concat("source", F.lit("'s "), "lang"))
        .otherwise(F.concat_ws(" ", "source", "lang"))
    )
    return table(spark, sf, "documents").select("doc_id", name.alias("name"), tx.is_skip_name(F.col("text")).alias("skip_text")).withColumn(
        "skip", tx.is_skip_name(F.col("name"))
    )


@query(
    "sc29_combine_impact",
    """select doc_id, coalesce(i || '. ' || d, i, d, 'Security issue addressed') as description from (
         select doc_id, nullif(rtrim(trim(case when doc_id % 3 = 0 then '' else source || '... ' end), '.'), '') as i,
           nullif(rtrim(trim(case when doc_id % 2 = 0 then null else ' ' || lang || '.' end), '.'), '') as d from documents) x""",
)
def sc29(spark, sf):
    k = F.col("doc_id")
    impact = F.when(k % 3 == 0, "").otherwise(F.concat("source", F.lit("... ")))
    description = F.when(k % 2 != 0, F.concat(F.lit(" "), "lang", F.lit(".")))
    return table(spark, sf, "documents").select("doc_id", tx.combine_impact(impact, description).alias("description"))


_BLOCK = """case page_id % 4 when 0 then '<p>Impact: ' || t || '</p><p>Description: ' || u || '</p>CVE-2020-1 '
  when 1 then 'Impact: ' || t || '. Available for: x' when 2 then '<p>An issue may be ' || u || '</p>' else '<p>' || lower(t) || '</p>' end"""


def _nodots(c: str) -> str:
    return f"nullif(rtrim({sql_strip(c)}, '.'), '')"


def _nodots_twice(c: str) -> str:
    return _nodots(_nodots(c))


@query(
    "sc30_impact_text",
    f"""select page_id, case when i is null and d is null and s is not null then s else coalesce(i || '. ' || d, i, d, 'Security issue addressed') end as description
        from (select page_id, {_nodots_twice("regexp_extract(b, 'Impact:\\s*(.+?)(?:\\s*Description:|\\s*CVE-|\\s*Available for|\\s*Entry|\\s*$)', 1)")} as i,
          {_nodots_twice("regexp_extract(b, 'Description:\\s*(.+?)(?:\\s*CVE-|\\s*Entry|\\s*$)', 1)")} as d,
          {_nodots("regexp_extract(b, '(?:^|[.] )([A-Z][^.]*(?:may|could|might|can|able to|addressed|issue|vulnerability|problem|flaw)[^.]*)', 1)")} as s
        from (select page_id, {sql_collapse(f"regexp_replace({_BLOCK}, '<[^>]+>', ' ', 'g')")} as b
          from (select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as t, array_to_string(regexp_extract_all(html, '<p>([^<]+)</p>', 1), ' ') as u from pages) x) y) z""",
)
def sc30(spark, sf):
    df = table(spark, sf, "pages").select(
        "page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("t"), F.array_join(F.regexp_extract_all("html", F.lit("<p>([^<]+)</p>"), F.lit(1)), " ").alias("u")
    )
    return df.select("page_id", tx.impact_and_description(F.expr(_BLOCK)).alias("description"))


@query(
    "sc31_ordered_ids",
    """select doc_id, array_to_string(list_transform(list_filter(list_zip(l, range(1, len(l) + 1)), lambda p: list_position(l, p[1]) = p[2]), lambda p: p[1]), ',') as ids
       from (select doc_id, regexp_extract_all(text, '[0-9]{3}-[0-9]{4}|th[a-z]tion') as l from documents) x""",
)
def sc31(spark, sf):
    ids = tx.ids_in(F.col("text"), "[0-9]{3}-[0-9]{4}|th[a-z]tion")
    return table(spark, sf, "documents").select("doc_id", F.array_join(ids, ",").alias("ids"))


@query(
    "sc32_platform",
    """select ord, case when starts_with(n, 'iOS ') or starts_with(n, 'iPadOS ') then 'ios' when starts_with(n, 'macOS ') then 'macos' end as os,
         replace(n, ' and iPadOS', ' / iPadOS') as name
       from (select ord, case ord % 4 when 0 then 'macOS ' || cast(ord % 9 as varchar) when 1 then 'iPadOS ' || cast(ord % 7 as varchar)
         when 2 then 'tvOS 1' else name end as n from pages_index) x""",
    ["pages_index"],
)
def sc32(spark, sf):
    k = F.col("ord")
    name = (
        F.when(k % 4 == 0, F.concat(F.lit("macOS "), (k % 9).cast("string")))
        .when(k % 4 == 1, F.concat(F.lit("iPadOS "), (k % 7).cast("string"))).when(k % 4 == 2, "tvOS 1").otherwise(F.col("name"))
    )
    return standin(spark, sf, "pages_index").select("ord", tx.platform_of(name).alias("os"), tx.platform_name(name).alias("name"))


@query("sc33_strip_comments", "select page_id, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') as html from pages")
def sc33(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.strip_comments(F.col("html")).alias("html"))


@query(
    "sc54_display_numbers",
    """select ord, case when v >= 9.95 then cast(cast(floor(floor(v * 10 + 0.5) / 10 + 0.5) as bigint) as varchar)
           else printf('%.1f', floor(v * 10 + 0.5) / 10) end as one_decimal,
         cast(cast(floor(v + 0.5) as bigint) as varchar) || ' kn' as knots,
         '~' || case when v < 3 then printf('%.1f', floor(v * 10 + 0.5) / 10) else cast(cast(floor(v + 0.5) as bigint) as varchar) end || ' m' as vis,
         cast(case when h % 12 = 0 then 12 else h % 12 end as varchar) || case when h < 12 then 'am' else 'pm' end as hour
       from (select o_orderkey as ord, cast(cast(round(o_totalprice * 100) as bigint) % 2000 as double) / 100 + 0.001e0 as v, cast(o_orderkey % 24 as int) as h from orders) x""",
)
def sc54(spark, sf):
    from shorelark.functions import conditions as fx

    v = (F.round(F.col("o_totalprice") * 100).cast("bigint") % 2000).cast("double") / 100 + 0.001
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("ord"), fx.number_text(v).alias("one_decimal"), fx.knots_text(v).alias("knots"),
        fx.visibility_text(v).alias("vis"), tm.hour_label((F.col("o_orderkey") % 24).cast("int")).alias("hour"),
    )
