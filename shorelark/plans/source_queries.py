"""Readers, normalisers and sinks over pages and payloads built from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from shorelark.functions import times as tm
from shorelark.plans.calendar_queries import HI, LO, events
from shorelark.plans.conditions_queries import marine, weather
from shorelark.plans.registry import query
from shorelark.plans.standins import standin, table
from shorelark.plans.text_queries import _T12, _T24, CLOCK_SQL, OFFSET_SQL
from shorelark.session import parameter_frame, scratch_path
from shorelark.sources import listings as ls
from shorelark.sources import readers as rd
from shorelark.sources import sinks

SHOP = ls.Origin("https://s.example.org/calendar", "https://s.example.org")
_AT = "({d} + to_minutes(cast({m} as bigint)))"
ISO = (
    "case when {m} is null then strftime({d}, '%Y-%m-%d') else strftime(" + _AT + ", '%Y-%m-%dT%H:%M') || '+' || "
    + OFFSET_SQL.replace("{0}", _AT) + " || ':00' end"
)
CLOCKED = f"""clocked as (select *, {CLOCK_SQL} as minutes from (select *, try_cast(regexp_extract(clock, '{_T12}', 1) as int) as h12, try_cast(regexp_extract(clock, '{_T12}', 2) as int) as m12,
  lower(regexp_extract(clock, '{_T12}', 3)) as ap, try_cast(regexp_extract(clock, '{_T24}', 1) as int) as h24, try_cast(regexp_extract(clock, '{_T24}', 2) as int) as m24 from listing_text) x)"""


@query(
    "io01_source_union",
    f"""select source as id, 'ok' as status, count(*) as fetched, count(*) filter (where start_at[:10] between '{LO}' and '{HI}') as event_count from cal_events group by 1
        union all select 'broken', 'error', 0, 0 union all select 'bad-columns', 'error', 0, 0""",
    ["cal_events"],
)
def io01(spark, sf):
    def of(priority):
        return lambda s: events(s, sf).filter(F.col("source") == priority)

    names = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    sources = [
        *[rd.Source(n, n.title(), n[:1], f"https://s{n[:1]}.example.org", of(n)) for n in names],
        rd.Source("broken", "Broken", "B", "https://b.example.org", lambda s: events(s, sf).withColumn("title", F.raise_error(F.lit("gone")).cast("string"))),
        rd.Source("bad-columns", "Bad", "C", "https://c.example.org", lambda s: events(s, sf).select("no_such_column")),
    ]
    union, status = rd.gather(spark, sources)
    return rd.status_table(union, status, LO, HI).select("id", "status", "fetched", "event_count")


@query("io02_document", "select cast(p_partkey as varchar) as cid, p_name as course, p_brand as location, p_type as instructor from part")
def io02(spark, sf):
    k = F.col("p_partkey")
    item = F.struct(k.cast("string").alias("cid"), F.col("p_name").alias("course"), F.col("p_brand").alias("location"), F.col("p_type").alias("instructor"))
    # documents of two hundred classes each
    docs = table(spark, sf, "part").groupBy(F.floor(k / 200).alias("doc")).agg(F.collect_list(item).alias("classes"))
    path = scratch_path(spark, "schedule")
    docs.select(F.lit("2024-01-01T00:00:00Z").alias("updated"), "classes").write.json(path)
    return rd.read_document(spark, path, "classes", rd.CLASS_SCHEMA, "updated string", lines=True).select("cid", "course", "location", "instructor")


def _answers(rows, variables, payload, before):
    """What the poll of each day lands: one JSON answer per zone, with parallel arrays in hour order, up to the day after it."""
    day = F.floor(F.col("idx") / 24).cast("int")
    polls = rows.withColumn("poll_id", F.explode(F.sequence(day - 1, day + before)))
    cols = [F.col(c).alias(v) for v, c in variables.items()]
    per_zone = polls.groupBy("poll_id", "zone").agg(F.array_sort(F.collect_list(F.struct("idx", F.col("ts").alias("time"), *cols))).alias("h"))
    hourly = F.struct(*[F.col(f"h.{n}").alias(n) for n in ["time", *variables]])
    return per_zone.select("poll_id", "zone", F.to_json(F.struct(hourly.alias("hourly"))).alias(payload))


def _zones(spark):
    # the registry is a parameter: zone i of an answer is the i-th name
    names = ("click", "error", "purchase", "signup", "view")
    return parameter_frame(spark, list(enumerate(names)), "zone_ord int, zone string")


@query(
    "io03_hourly_feed",
    """with day as (select zone, idx, unnest(generate_series(idx // 24 - 1, idx // 24)) as poll, ts, swell_h, sea_level, current, precip, wind_dir, temp from zone_hours where idx % 17 <> 3),
         starts as (select poll, min(idx) as first from day group by poll)
       select cast(poll as int) as poll_id, zone, cast(idx - first as int) as idx, ts, swell_h, sea_level, current,
         case when idx % 19 <> 7 then precip end as precip, case when idx % 19 <> 7 then wind_dir end as wind_dir, case when idx % 19 <> 7 then temp end as temp
       from day join starts using (poll)""", ["zone_hours"],
)
def io03(spark, sf):
    """Polls of every day; the marine answer starts a day after the weather answer, and each lacks hours that the other has."""
    zones = _zones(spark)
    m = _answers(marine(spark, sf).filter("idx % 17 <> 3"), rd.MARINE_VARIABLES, "marine", 0).join(zones, "zone").drop("zone")
    w = _answers(weather(spark, sf).filter("idx % 19 <> 7"), rd.WEATHER_VARIABLES, "weather", 1).join(zones, "zone").drop("zone")
    found = rd.zone_hours(rd.marine_feed(m, zones), rd.weather_feed(w, m, zones))
    return found.select("poll_id", "zone", "idx", "ts", "swell_h", "sea_level", "current", "precip", "wind_dir", "temp")


def _snippet_docs(spark, sf):
    rows = standin(spark, sf, "listing_text")
    link = F.concat(F.lit('<a href="'), F.coalesce(F.replace("href", F.lit("&"), F.lit("&amp;")), F.lit("")), F.lit('"><strong>'), F.coalesce("clock", F.lit("")),
                    F.lit("</strong> "), "dated", F.when(F.col("sold_flag"), " - (Sold Out)").otherwise(""), F.lit("</a>"))
    html = F.concat(F.lit("<div>"), F.when(F.col("ord") % 13 != 0, link).otherwise("no link"), F.lit("<!--"), F.col("ord").cast("string"), F.lit("--></div>"))
    keyed = rows.select(F.floor(F.col("ord") / 10).alias("customer"), F.date_format("day", "MM-dd-yyyy").alias("k"), "ord", html.alias("html"))
    days = keyed.groupBy("customer", "k").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "html"))), lambda s: s["html"]).alias("v"))
    docs = days.groupBy("customer").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    return docs.select("customer", F.to_json(F.struct(F.col("m").alias("monthlyAvailability"))).alias("payload"))


def _snippets(spark, sf):
    rows = rd.day_snippets(_snippet_docs(spark, sf), "payload")
    return rows.withColumn("ord", F.regexp_extract("snippet", r"<!--(\d+)-->", 1).cast("bigint"))


@query(
    "io04_day_snippets",
    "select cast(floor(ord / 10.0) as bigint) as customer, strftime(day, '%m-%d-%Y') as day_key, ord, row_number() over (partition by floor(ord / 10.0), day order by ord) - 1 as snippet_pos from listing_text",
    ["listing_text"],
)
def io04(spark, sf):
    return _snippets(spark, sf).select("customer", "day_key", "ord", F.col("snippet_pos").cast("bigint").alias("snippet_pos"))


def _availability(spark, sf):
    rows = table(spark, sf, "orders").select(F.floor(F.col("o_orderkey") / 10).alias("id"), F.date_format("o_orderdate", "yyyyMMdd").alias("k"), (F.col("o_orderkey") % 5 != 0).cast("int").alias("v"))
    days = rows.groupBy("id", "k").agg(F.max("v").alias("v"))
    odd = days.select("id", F.lit("2024-1").alias("k"), F.lit(1).alias("v")).distinct()
    docs = days.unionByName(odd).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    return docs.select("id", F.to_json(F.struct(F.col("m").alias("calendar_data"))).alias("payload"))


@query(
    "io05_available_days",
    """select distinct id, strftime(o_orderdate, '%Y-%m-%d') as day from (select cast(floor(o_orderkey / 10.0) as bigint) as id, * from orders) x
       where o_orderkey % 5 <> 0 and strftime(o_orderdate, '%Y-%m') = '199' || cast(5 + id % 4 as varchar) || '-0' || cast(1 + id % 9 as varchar)""",
)
def io05(spark, sf):
    docs = _availability(spark, sf).select(
        "id", "payload", F.concat(F.lit("199"), (5 + F.col("id") % 4).cast("string"), F.lit("-0"), (1 + F.col("id") % 9).cast("string")).alias("month")
    )
    return rd.available_days(docs, "payload", "month").select("id", F.col("day").cast("string").alias("day"))


@query(
    "io07_event_documents",
    """select ord, '{"id":"' || source || '-' || substr(sha1(source || '|' || title || '|' || start_at || '|' || coalesce(url, '')), 1, 12) || '","source":"' || source || '","title":"' || title || '","start":"' || start_at || '","all_day":' || cast(all_day as varchar)
         || coalesce(',"end":"' || end_at || '"', '') || coalesce(',"url":"' || url || '"', '') || coalesce(',"location":"' || location || '"', '') || coalesce(',"description":"' || description || '"', '') || '}' as json from cal_events""",
    ["cal_events"],
)
def io07(spark, sf):
    return sinks.event_documents(events(spark, sf), "ord").select("ord", "json")


_STORE = f"""
rows as (select ord, day, places_left, dated, weekly, minutes, case when price in ('', '$0', '$0.00') then null else price end as p, href from clocked where ord % 17 <> 0),
named as (select *, nullif(trim(regexp_replace(trim(regexp_replace(dated, '{{TRAIL}}', ''), ' -–·'), '{{TRAIL}}', ''), ' -–·'), '') as special,
  case when trim(weekly) = '' then 'Dive event' else regexp_replace(trim(weekly), ' +', ' ', 'g') end as grp from rows)
"""


@query(
    "io12_storefront_events",
    f"""with {CLOCKED}, {_STORE} select ord, title || case when places_left = 0 then ' (sold out)' else '' end as title, {ISO.format(m='sm', d='day')} as start_at,
          case when ord % 3 = 1 then strftime(day + 2, '%Y-%m-%d') end as end_at, sm is null as all_day,
          case when ord % 5 = 0 then 'https://s.example.org/calendar' else 'https://s.example.org/p/' || cast(ord as varchar) end as url,
          nullif(array_to_string(list_filter([p, case when ord % 4 <> 0 and not contains(lower(special), lower(grp)) then grp end, case when ord % 4 = 0 then null else 'nice & easy' end], lambda x: x is not null), ' · '), '') as description
        from (select *, case when ord % 4 <> 0 then special else grp end as title, case when regexp_matches(clock12, '(?i)^\\d{{1,2}}:\\d{{2}}\\s*[AP]\\.?M\\.?$') then minutes end as sm
          from (select n.*, c.clock as clock12 from named n join clocked c using (ord)) z) y"""
    .replace("{TRAIL}", r"(?i)(?:\s*[-–]?\s*\d{1,2}/\d{1,2}/\d{2,4}|\s*[-–]?\s*(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s*[-–]?\s*\d{2,4}|\s+20\d{2})\s*$"),
    ["listing_text"],
)
def io12(spark, sf):
    rows = standin(spark, sf, "listing_text")
    k, day = F.col("ord"), F.date_format("day", "d MMM yyyy")
    start = F.when(k % 17 == 0, "soon").otherwise(day)
    end = F.when(k % 3 == 0, "n/a").when(k % 3 == 1, F.date_format(F.date_add("day", 2), "d MMM yyyy")).otherwise(F.date_format(F.date_sub("day", 1), "d MMM yyyy"))
    link = F.when(k % 5 != 0, F.concat(F.lit('<a class="b" href="/p/'), k.cast("string"), F.lit('?q=7">book</a>'))).otherwise("")

    def td(c):
        return F.concat(F.lit("<td>"), c, F.lit("</td>"))

    note = F.when(k % 4 == 0, "").otherwise(F.concat(F.lit('<p style="font-style: italic">'), "dated", F.lit(": nice &amp; easy</p>")))
    html = F.concat(
        F.lit('<table><tr class="main-row">'), td(F.lit("x")), td(start), td(end), td(F.concat(F.lit("<b> "), "weekly", F.lit("</b>"))), td(F.lit("")),
        td(F.col("places_left").cast("string")), td(F.col("price")), td(link), F.lit('</tr><tr class="expand-row"><td><span>Start date: '), day,
        F.lit(" "), F.coalesce("clock", F.lit("")), F.lit("</span>"), note, F.lit("</td></tr></table>"),
    )
    main = ls.storefront_rows(rows.select("ord", html.alias("html")))
    return ls.storefront_events(main, SHOP).select("ord", "title", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "all_day", "url", "description")


@query(
    "io13_api_events",
    f"""select ord, dated || case when sold_flag then ' (sold out)' else '' end as title, strftime(day, '%Y-%m-%d') as start_at, cast(null as varchar) as end_at, true as all_day,
          coalesce(href, 'https://s.example.org/calendar') as url, case when places_left = 0 then null else 'Bay ' || cast(places_left as varchar) end as location,
          case ord % 3 when 0 then 'Short & sweet' when 1 then 'Long text here' end as description
        from listing_text where ord % 17 <> 0 and ord % 19 <> 0""",
    ["listing_text"],
)
def io13(spark, sf):
    rows = standin(spark, sf, "listing_text")
    k = F.col("ord")
    start_s = F.unix_date("day") * F.lit(86400).cast("bigint")
    record = F.struct(
        k.cast("string").alias("id"), F.when(k % 17 == 0, "  ").otherwise(F.concat(F.lit(" "), "dated")).alias("summary"),
        F.when(k % 19 != 0, start_s).alias("utcStartTime"), F.lit(True).alias("isAllDayEvent"), F.col("sold_flag").alias("soldOut"),
        F.col("href").alias("url"), F.when(F.col("places_left") != 0, F.concat(F.lit("Bay \t "), F.col("places_left").cast("string"))).alias("venueName"),
        F.when(k % 3 == 0, "Short & sweet").otherwise("").alias("shortDescription"),
        F.when(k % 3 == 1, "<p>Long <b>text</b></p>here").otherwise("").alias("description"),
    )
    docs = rows.select(k.alias("doc"), F.to_json(F.struct(F.array(record).alias("events"))).alias("payload"))
    recs = ls.api_records(docs).withColumn("ord", F.col("doc")).drop("doc")
    return ls.api_events(recs, SHOP).select("ord", "title", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "all_day", "url", "location", "description")


@query(
    "io14_grid_events",
    f"""with {CLOCKED} select ord, regexp_replace(trim(dated, ' -–·'), '^$', '') || case when sold_flag then ' (sold out)' else '' end as title, {ISO.format(m='coalesce(pm, minutes)', d='dd')} as start_at, coalesce(pm, minutes) is null as all_day
        from (select *, case when contains(href, 'preferredTime') then 540 end as pm, coalesce(try_cast(nullif(regexp_extract(href, 'preferredDate=([-0-9]*)', 1), '') as date), day) as dd from clocked where ord % 13 <> 0) x""",
    ["listing_text"],
)
def io14(spark, sf):
    rows = ls.grid_events(_snippets(spark, sf), SHOP)
    return rows.select("ord", "title", F.col("start").alias("start_at"), "all_day")


@query("io15_listing_items")
def io15(spark, sf):
    rows = standin(spark, sf, "listing_text").withColumn("page", F.floor(F.col("ord") / 30))
    k = F.col("ord")
    header = F.when(k % 4 == 1, F.concat(F.lit('<div class="sticky-header">Sat '), F.date_format("day", "dd-MMM-yyyy"), F.lit("</div>"))).otherwise("")
    booking = F.when(k % 6 != 0, F.concat(F.lit('<a href="BookSchedule.asp?ScheduleID='), (k % 900).cast("string"), F.lit('">Book</a>'))).otherwise("")
    block = F.concat(
        F.lit('<div class="post-item x">'), header, F.lit('<div class="post-title"><h3><a href="Item.asp?id='), (k % 40).cast("string"), F.lit('">'), "placed", F.lit("</a></h3></div>"),
        F.lit('<div class="post-info">'), "info", F.lit('</div><div class="post-description">A dive <a>more</a> Learn More</div>'), booking, F.lit("</div>"),
    )
    pages = rows.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", block.alias("b")))), lambda s: s["b"]), "").alias("html"))
    items = ls.listing_items(pages.select(F.lit("s").alias("source"), "page", "html"))
    return ls.listing_events(items, SHOP, "Shop ", "2003-01-01").select("page", "pos", "title", F.col("start").alias("start_at"), "all_day", "location", "description", "url")


_WEEKDAY = r"(?i)^(mon|tues|wednes|thurs|fri|satur|sun)day(\s+(morning|afternoon|evening|night))?\s*[-–—]*\s*"
_TOKEN = r"(?i)\b(\d{1,2})[.:]?(\d{2})?\s*([ap])\.?m\b"
_RANGE = r"(?i)m\s*[-–]\s*(\d{1,2})[.:]?(\d{2})?\s*([ap])\.?m\b"


def _token_minutes(pattern):
    h, m = f"try_cast(regexp_extract(name, '{pattern}', 1) as int)", f"coalesce(try_cast(regexp_extract(name, '{pattern}', 2) as int), 0)"
    half = f"lower(regexp_extract(name, '{pattern}', 3))"
    return f"case when {h} <= 12 and {m} <= 59 then ({h} % 12 + case when {half} = 'p' then 12 else 0 end) * 60 + {m} end"


@query(
    "io16_availability_events",
    rf"""with raw as (select cast(floor(ord / 10.0) as bigint) as id, *, row_number() over (partition by floor(ord / 10.0) order by ord) as rn from listing_text),
        named as (select id, trim(regexp_replace(weekly || ' ' || item_name, ' +', ' ', 'g')) as name, nullif(price, '') as price from raw where rn = 1),
        items as (select id, coalesce(nullif(regexp_replace(trim(regexp_replace(name, '{_WEEKDAY}', ''), ' -–—/·'), '\s{{2,}}', ' ', 'g'), ''), name) as title,
          {_token_minutes(_TOKEN)} as sm, {_token_minutes(_RANGE)} as em, array_to_string(list_filter([price, 'Nice trip…'], lambda x: x is not null), ' · ') as description from named),
        days as (select distinct cast(floor(o_orderkey / 10.0) as bigint) as id, cast(o_orderdate as date) as day from orders where o_orderkey % 5 <> 0),
        timed as (select i.id, d.day, title, {ISO.format(m='sm', d='day')} as start_at,
          case when sm is not null and em is not null then {ISO.format(m='em', d='(day + case when em > sm then 0 else 1 end)')} end as end_at, sm is null as all_day,
          'https://p.example.org/?date=' || strftime(day, '%Y-%m-%d') || '#' || cast(i.id as varchar) || '@book@' as url, description from items i join days d using (id))
        select id, title, start_at, end_at, all_day, url, description from (select *, row_number() over (partition by title, start_at order by id, day) as rn from timed) x where rn = 1""",
    ["listing_text"],
)
def io16(spark, sf):
    from shorelark.operators.calendar import last_by_id
    from shorelark.operators.scale import first_by

    # one item per ten orders, shown in two categories
    rows = standin(spark, sf, "listing_text").withColumn("item", F.floor(F.col("ord") / 10))
    rows = first_by(rows.select("item", "ord", "weekly", "item_name", "price"), ["item"], ["ord"])
    inventory = rows.withColumn("category", F.explode(F.array((F.col("item") % 7), F.col("item") % 7 + 7))).select(
        "category",
        F.concat(
            F.lit('<div class="cf-item-data" id="cf-item-data-'), F.col("item").cast("string"), F.lit('"><h2>'), F.concat_ws(" ", "weekly", "item_name"),
            F.lit('</h2><div class="cf-price"><strong><span>'), "price", F.lit('</span></strong></div><div id="cf-item-summary-'), F.col("item").cast("string"),
            F.lit('">Nice trip ... (Read More)</div></div>'),
        ).alias("html"),
    )
    items = ls.inventory_items(inventory)
    unique = last_by_id(items.select("id", F.col("category").alias("ord"), "name", "price", "summary"), "ord")
    days = rd.available_days(_availability(spark, sf), "payload")
    out = ls.availability_events(unique.withColumn("place", F.col("id")), days, "https://p.example.org/", 2557)
    return out.select("id", "title", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "all_day", "url", "description")


@query(
    "fl08_row_validity",
    """select p_partkey as id, p_name as name from part where p_partkey not in (7, 12, 17, 21, 22, 63, 74)
       and not regexp_matches(p_name || case when p_partkey % 9 = 0 then ' Gift Hire' else '' end, '(?i)gift|hire|retail|sales|package|rebreather|commercial|charters')""",
)
def fl08(spark, sf):
    k = F.col("p_partkey")
    rows = table(spark, sf, "part").select(k.alias("id"), F.col("p_name").alias("plain"), F.concat("p_name", F.when(k % 9 == 0, " Gift Hire").otherwise("")).alias("name"))
    return ls.allowed_categories(rows).select("id", F.col("plain").alias("name"))
