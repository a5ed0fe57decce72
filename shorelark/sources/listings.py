"""Listing pages and payloads of several kinds to the one event model.

Every normaliser is a single projection with filters. ``ord`` is the arrival order, kept so that
first-wins rules stay exact however the rows are partitioned.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shorelark.functions import text as tx
from shorelark.functions import times as tm
from shorelark.operators.scale import computed_once, first_by, forward_fill, greedy_two_key_dedupe
from shorelark.session import cut_lineage

FALLBACK_TITLE = "Dive event"  # fixed value: title of a storefront row that has none
ON_DEMAND_DENSITY = 0.85  # fixed value: share of window days above which an item is stock, not schedule
DENIED_CATEGORIES = (7, 12, 17, 21, 22, 63, 74)  # fixed values
DENIED_NAMES = r"(?i)gift|hire|retail|sales|package|rebreather|commercial|charters"  # fixed value


@dataclass(frozen=True)
class Origin:
    """Where a listing comes from: fallback link and the base of relative ones."""

    url: str
    base: str


def _attribute(html: Column, name: str) -> Column:
    quoted = F.regexp_extract(html, rf"(?is)<a\b[^>]*\b{name}\s*=\s*[\"']([^\"']*)[\"']", 1)
    return tx.none_if_empty(tx.decode_entities(quoted))


def _text(html: Column) -> Column:
    return tx.none_if_empty(tx.html_to_line(html))


# ---- storefront tables ----------------------------------------------------

def storefront_rows(pages: DataFrame, html: str = "html") -> DataFrame:
    """Main rows, numbered by their place among all rows, with the first detail row that follows them.

    A detail row closes the run of rows before it, so the number of its run leads a row to its detail: no row looks through
    the others.
    """
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>.*?</tr>"), F.lit(0))
    rows = F.transform(rows, lambda r, i: F.struct(
        i.alias("pos"), r.alias("html"), F.regexp_extract(r, r"(?is)^<tr([^>]*)>", 1).alias("head")
    ))

    def is_detail(row: Column) -> Column:
        return row["head"].contains("expand-row")

    def numbered(pack: Column) -> Column:
        marks = F.array_join(F.transform(pack["rows"], lambda r: F.when(is_detail(r), "d").otherwise("-")), "")
        runs = F.flatten(F.transform(F.split(marks, "(?<=d)"), lambda run, k: F.array_repeat(k, F.length(run))))
        details = F.filter(pack["rows"], is_detail)
        return F.transform(F.array(F.struct(pack["rows"].alias("rows"), runs.alias("runs"), details.alias("details"))), with_detail)

    def with_detail(pack: Column) -> Column:
        # a main row that is a detail row too looks for the next one
        in_run = F.zip_with(pack["rows"], pack["runs"], lambda r, k: F.struct(r.alias("row"), (k + is_detail(r).cast("int")).alias("run")))
        mains = F.filter(in_run, lambda m: m["row"]["head"].contains("main-row"))
        return F.transform(mains, lambda m: F.struct(
            m["row"]["pos"].alias("pos"), F.regexp_extract_all(m["row"]["html"], F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1)).alias("cells"),
            F.get(pack["details"], m["run"])["html"].alias("expand"),
        ))

    packed = F.flatten(F.flatten(F.transform(F.array(F.struct(rows.alias("rows"))), numbered)))
    keys = [c for c in pages.columns if c != html]
    return pages.select(*keys, F.inline_outer(packed)).filter(F.col("pos").isNotNull())


def storefront_events(rows: DataFrame, origin: Origin, ordinal: str = "ord") -> DataFrame:
    """Rows of eight or more cells: start, end, group, places left, price and link by position."""
    def cell(i: int) -> Column:
        return F.get("cells", i - 1)

    # three steps, so that no text is derived more than once
    plain = rows.filter(F.size("cells") >= 8).select(
        ordinal, *[tx.html_to_line(cell(i)).alias(f"_c{i}") for i in (2, 3, 4, 6, 7)],
        tx.clean_text(tx.decode_entities(F.regexp_replace("expand", r"<[^>]+>", "\n"))).alias("_detail"),
        _text(F.regexp_extract("expand", r"(?is)<p[^>]*style=[\"'][^\"']*italic[^\"']*[\"'][^>]*>(.*?)</p>", 1)).alias("_note"),
        _attribute(cell(8), "href").alias("_href"),
    )
    clock = F.regexp_extract(
        "_detail", r"(?iU)Start date:\s*\d{1,2}\s+[A-Za-z]{3}\s+\d{4}(?:\s+(\d{1,2}:\d{2}\s*[AP]\.?M\.?))?", 1
    )
    base = plain.select(
        ordinal, tm.day_from(F.col("_c2"), "d MMM yyyy").alias("_start"), tm.day_from(F.col("_c3"), "d MMM yyyy").alias("_end"),
        F.coalesce(tx.none_if_empty(F.col("_c4")), F.lit(FALLBACK_TITLE)).alias("_group"),
        F.col("_c6").try_cast("int").alias("_left"), tx.nonzero_price(F.col("_c7")).alias("_price"),
        tx.drop_query(tx.absolute_url(F.col("_href"), origin.base)).alias("_url"),
        tm.clock_minutes(clock).alias("_min"), "_note",
    ).filter(F.col("_start").isNotNull())
    head = F.regexp_extract("_note", r"(?s)^([^:]*)", 1)
    special = tx.none_if_empty(tx.drop_trailing_dates(head))
    blurb = F.when(F.col("_special").isNotNull(), tx.clean_text(F.regexp_extract("_note", r"(?s)^[^:]*:(.*)$", 1))).otherwise(F.col("_note"))
    named = base.withColumn("_special", special).withColumn("_blurb", blurb)
    group_part = F.when(
        F.col("_special").isNotNull() & ~F.lower("_special").contains(F.lower("_group")), F.col("_group")
    )
    return named.select(
        ordinal,
        tx.with_sold_out(F.coalesce("_special", "_group"), tx.is_sold_out(places=F.col("_left"))).alias("title"),
        tm.sydney_iso(F.col("_start"), F.col("_min")).alias("start"),
        F.when(F.col("_end") > F.col("_start"), F.col("_end").cast("string")).alias("end"),
        F.col("_min").isNull().alias("all_day"), F.coalesce("_url", F.lit(origin.url)).alias("url"),
        tx.join_parts(F.col("_price"), group_part, F.col("_blurb")).alias("description"),
    )


def storefront_listing(rows: DataFrame, origin: Origin, ordinal: str = "ord") -> DataFrame:
    return first_by(storefront_events(rows, origin, ordinal), ["title", "start"], [ordinal])


# ---- event interface ------------------------------------------------------

API_SCHEMA = (
    "id string, uuid string, summary string, utcStartTime bigint, utcEndTime bigint, isAllDayEvent boolean, "
    "soldOut boolean, url string, venueName string, shortDescription string, description string, longDescription string"
)


def api_records(docs: DataFrame, payload: str = "payload") -> DataFrame:
    """``{"events": [...]}`` to one row per record."""
    item = ", ".join(f"{n}: {k}" for n, k in (p.split() for p in API_SCHEMA.split(", ")))
    keys = [c for c in docs.columns if c != payload]
    parsed = F.from_json(payload, f"struct<events: array<struct<{item}>>>")["events"]
    rows = docs.select(*keys, F.posexplode_outer(parsed).alias("ord", "_e")).filter(F.col("ord").isNotNull())
    return rows.select(*keys, "ord", "_e.*")


def description_of(short: Column, html: Column, long_html: Column) -> Column:
    """The short text, else the long one without its tags, else nothing."""
    source = F.coalesce(tx.none_if_empty(html), tx.none_if_empty(long_html))
    return F.coalesce(tx.clean_text(short), tx.none_if_empty(tx.html_to_line(source)))


def api_events(records: DataFrame, origin: Origin) -> DataFrame:
    title = tx.clean_text(F.col("summary"))
    all_day = F.coalesce("isAllDayEvent", F.lit(False))
    start, end = tm.epoch_event_times(F.col("utcStartTime"), F.col("utcEndTime"), all_day)
    valid = records.filter(title.isNotNull() & (F.coalesce("utcStartTime", F.lit(0)) != 0))
    return valid.select(
        "ord", tx.with_sold_out(title, tx.is_sold_out(flag=F.col("soldOut"))).alias("title"), start.alias("start"),
        end.alias("end"), all_day.alias("all_day"),
        F.coalesce(tx.none_if_empty(F.col("url")), F.lit(origin.url)).alias("url"),
        tx.clean_text(F.col("venueName")).alias("location"),
        description_of(F.col("shortDescription"), F.col("description"), F.col("longDescription")).alias("description"),
    )


# ---- month grids ----------------------------------------------------------

def grid_events(snippets: DataFrame, origin: Origin, ordinal: str = "ord") -> DataFrame:
    """The first link of a snippet: its text is the title, its query the preferred date and time."""
    anchor = F.regexp_extract("snippet", r"(?is)<a\b[^>]*>.*?</a>", 0)
    anchors = computed_once(snippets, ordinal, "day_key", anchor.alias("_anchor")).filter("_anchor <> ''")
    href = _attribute(F.col("_anchor"), "href")
    shown = F.coalesce(_text(F.regexp_extract("_anchor", r"(?is)<strong[^>]*>(.*?)</strong>", 1)), F.lit(""))
    full = F.coalesce(_text(F.col("_anchor")), F.lit(""))
    base = computed_once(anchors, ordinal, "day_key", href.alias("_href"), shown.alias("_shown"), full.alias("_full"))
    at = F.instr(F.col("_full"), F.col("_shown"))
    rest = F.when(
        (F.col("_shown") != "") & (at > 0),
        F.concat(F.substr("_full", F.lit(1), at - 1), F.substr("_full", at + F.length("_shown"))),
    ).otherwise(F.col("_full"))
    title = tx.none_if_empty(tx.strip(F.regexp_replace(rest, tx.SOLD_OUT, ""), " -–·" + tx.NBSP))
    day = F.coalesce(
        tm.day_from(tx.query_value(F.col("_href"), "preferredDate"), "yyyy-MM-dd"), tm.day_from(F.col("day_key"), "MM-dd-yyyy")
    )
    minutes = F.coalesce(tm.clock_minutes(tx.query_value(F.col("_href"), "preferredTime")), tm.clock_minutes(F.col("_shown")))
    parts = computed_once(
        base, ordinal, title.alias("_title"), tx.is_sold_out(F.col("_full")).alias("_sold"), day.alias("_day"), minutes.alias("_min"),
        tx.rebase_without(F.replace(F.col("_href"), F.lit(" "), F.lit("+")), origin.base, ["PHPSESSID", "iframe"]).alias("url"),
    ).filter(F.col("_title").isNotNull() & F.col("_day").isNotNull())
    return parts.select(
        ordinal, tx.with_sold_out(F.col("_title"), F.col("_sold")).alias("title"),
        tm.sydney_iso(F.col("_day"), F.col("_min")).alias("start"), F.lit(None).cast("string").alias("end"),
        F.col("_min").isNull().alias("all_day"), "url",
    )


def grid_listing(snippets: DataFrame, origin: Origin, ordinal: str = "ord") -> DataFrame:
    return first_by(grid_events(snippets, origin, ordinal), ["title", "start"], [ordinal])


# ---- paged listings -------------------------------------------------------

def _element(html: Column, opening: str) -> Column:
    """What is inside the div that the pattern opens, nested divs included; all that follows if it is never closed."""
    pieces = F.split(F.regexp_extract(html, rf"(?is){opening}(.*)$", 1), r"(?i)(?=<div\b|</div\s*>)")
    step = lambda p: F.when(p.rlike(r"(?i)^</div"), -1).when(p.rlike(r"(?i)^<div"), 1).otherwise(0)

    def walk(acc: Column, p: Column) -> Column:
        depth = acc["depth"] + F.when(acc["depth"] > 0, step(p)).otherwise(0)
        return F.struct(depth.alias("depth"), (acc["n"] + (depth > 0).cast("int")).alias("n"))

    def inside(all_: Column) -> Column:
        start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n"))
        return F.array_join(F.slice(all_, F.lit(1), F.aggregate(all_, start, walk)["n"]), "")

    return tx.let(pieces, inside)


def _inner(html: Column, css: str) -> Column:
    return _element(html, rf"<div[^>]*class=[\"'][^\"']*\b{css}\b[^\"']*[\"'][^>]*>")


def listing_items(pages: DataFrame, html: str = "html") -> DataFrame:
    """Item blocks of each page in order. ``pages``: source, page, html."""
    blocks = F.slice(F.split(html, r"(?is)<div[^>]*class=[\"'][^\"']*\bpost-item\b[^\"']*[\"'][^>]*>"), 2, 2**31 - 1)
    items = pages.select(*[c for c in pages.columns if c != html], F.posexplode_outer(blocks).alias("pos", "_b")).filter(
        F.col("pos").isNotNull()
    )
    keys = [c for c in items.columns if c != "_b"]
    title = F.regexp_extract(_inner(F.col("_b"), "post-title"), r"(?is)<a\b[^>]*>.*?</a>", 0)
    description = F.regexp_replace(
        F.regexp_replace(_inner(F.col("_b"), "post-description"), r"(?is)<a\b[^>]*>.*?</a>", ""),
        r"(?is)<[^>]*post-read-more[^>]*>.*?</[a-z]+>", "",
    )
    booking = F.regexp_extract("_b", r"(?is)<a\b[^>]*href=[\"']([^\"']*BookSchedule\.asp[^\"']*)[\"']", 1)
    parts = computed_once(
        items, *keys, _inner(F.col("_b"), "sticky-header").alias("_header"), title.alias("_title"),
        _inner(F.col("_b"), "post-info").alias("_info"), description.alias("_description"), booking.alias("_booking"),
    )
    return computed_once(
        parts, *keys, tx.html_to_line(F.col("_header")).alias("header"), _text(F.col("_title")).alias("title"),
        _attribute(F.col("_title"), "href").alias("href"), tx.html_to_line(F.col("_info")).alias("info"),
        _text(F.col("_description")).alias("description"),
        tx.query_value(tx.decode_entities(F.col("_booking")), "ScheduleID").alias("schedule_id"),
    )


def listing_events(items: DataFrame, origin: Origin, location_prefix: str, window_end: str) -> DataFrame:
    """Dated items of a listing; the date header of an item holds for those after it, over page ends.

    Pages are parsed once: the items land in a checkpoint, as the carried dates and the rule on repeats read them several times.
    """
    own_day = tm.day_from(F.regexp_extract("header", r"(\d{1,2}-[A-Za-z]{3}-\d{4})", 1), "d-MMM-yyyy")
    stamped = cut_lineage(items.withColumn("_own_day", own_day).drop("header"))
    dated = forward_fill(stamped, "source", "page", "pos", "_own_day", "_day").filter(
        F.col("_day").isNotNull() & (F.col("_day") <= F.lit(window_end).cast("date")) & F.col("title").isNotNull()
    )
    dated = computed_once(dated, *[c for c in dated.columns if c != "title"], tx.clean_text(F.col("title")).alias("title"))
    title, location = tx.split_location(F.col("title"), tx.LOCATION_SUFFIX, location_prefix)
    call = F.regexp_replace("description", r"(?iU)\s*(Learn More|Check Availability)\s*$", "")
    product = tx.absolute_url(F.coalesce("href", F.lit("")), origin.base)
    rows = computed_once(
        dated, "source", "page", "pos", title.alias("title"), location.alias("location"), "_day",
        tm.clock_minutes(tx.start_time_text(F.col("info"))).alias("_min"), product.alias("url"),
        tx.join_parts(tx.price_text(F.col("info")), tx.strip(call)).alias("description"), "schedule_id",
    )
    shown = F.concat_ws("|", F.col("source"), F.col("title"), F.col("_day").cast("string"), F.coalesce(F.col("_min").cast("string"), F.lit("-")))
    booked = F.when(F.col("schedule_id").isNotNull(), F.concat_ws("#", "source", "schedule_id"))
    keyed = rows.withColumn("_a", F.coalesce(booked, shown)).withColumn(
        "_b", F.concat_ws("|", shown, F.col("url"))
    ).withColumn("_ord", F.struct("source", "page", "pos"))
    kept = greedy_two_key_dedupe(cut_lineage(keyed), "_a", "_b", "_ord")
    return kept.select(
        "source", "page", "pos", "title", tm.sydney_iso(F.col("_day"), F.col("_min")).alias("start"),
        F.lit(None).cast("string").alias("end"), F.col("_min").isNull().alias("all_day"), "url", "location", "description",
    )


# ---- availability items ---------------------------------------------------

def inventory_items(pages: DataFrame, html: str = "html") -> DataFrame:
    """Item blocks of inventory pages: id, name, price, summary; private and nameless items are left out."""
    blocks = F.filter(
        F.split(html, r"(?i)(?=<div[^>]*id=[\"']cf-item-data-)"), lambda b: b.rlike(r"(?i)^<div[^>]*id=[\"']cf-item-data-")
    )
    items = pages.select(*[c for c in pages.columns if c != html], F.posexplode_outer(blocks).alias("pos", "_b")).filter(
        F.col("pos").isNotNull()
    )
    number = F.regexp_extract("_b", r"id=[\"']cf-item-data-(\d+)[\"']", 1).try_cast("bigint")
    name = _text(F.regexp_extract("_b", r"(?is)<h2[^>]*>(.*?)</h2>", 1))
    price = _text(F.regexp_extract("_b", r"(?is)class=[\"'][^\"']*cf-price[^\"']*[\"'].*?<strong[^>]*>.*?<span[^>]*>(.*?)</span>", 1))
    summary = tx.summary_text(_text(_element(F.col("_b"), r"id=[\"']cf-item-summary-\d+[\"'][^>]*>")))
    return computed_once(
        items, *[c for c in items.columns if c != "_b"], number.alias("id"), name.alias("name"), price.alias("price"), summary.alias("summary")
    ).filter(F.col("id").isNotNull() & F.col("name").isNotNull() & ~F.lower("name").startswith("private"))


def allowed_categories(categories: DataFrame) -> DataFrame:
    """Categories that hold dated trips."""
    return categories.filter(~F.col("id").isin(*DENIED_CATEGORIES) & ~F.coalesce("name", F.lit("")).rlike(DENIED_NAMES))


def scheduled_items(days: DataFrame, window_days: int, density: float = ON_DEMAND_DENSITY) -> DataFrame:
    """Items that are not simply available all the time."""
    counts = days.groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
    return counts.filter(F.col("_n") <= window_days * density).select("id")


def availability_events(items: DataFrame, days: DataFrame, portal: str, window_days: int) -> DataFrame:
    """One event per item and available day. ``items``: id, place, name, price, summary; ``days``: id, day, read twice from a checkpoint."""
    days = cut_lineage(days)
    start, end = tm.name_times(F.col("name"))
    described = computed_once(
        items, "id", "place", tx.drop_weekday(F.col("name")).alias("title"), start.alias("_start"), end.alias("_end"),
        tx.join_parts(F.col("price"), F.col("summary")).alias("description"),
    )
    open_days = days.join(scheduled_items(days, window_days), "id", "left_semi").select("id", "day").distinct()
    rows = computed_once(
        open_days.join(described, "id"), "id", "place", "day", "title", tm.sydney_iso(F.col("day"), F.col("_start")).alias("start"),
        tm.overnight_end(F.col("day"), F.col("_start"), F.col("_end")).alias("end"), F.col("_start").isNull().alias("all_day"),
        F.concat(F.lit(f"{portal}?date="), F.col("day").cast("string"), F.lit("#"), F.col("id").cast("string"), F.lit("@book@")).alias("url"),
        "description",
    )
    return first_by(rows, ["title", "start"], ["place", "day"])
