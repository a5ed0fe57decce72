"""Calendar operators over orders as events."""

from __future__ import annotations

from pyspark.sql import functions as F

from shorelark.functions import times as tm
from shorelark.operators import calendar as cal
from shorelark.operators.scale import forward_fill, greedy_two_key_dedupe
from shorelark.plans.registry import query
from shorelark.plans.standins import standin, table
from shorelark.plans.text_queries import EVENT_DAY_SQL

PAIRS = [("1-URGENT", "Gear Hire 4"), ("2-HIGH", "Reef Dive 5"), ("5-LOW", "Wreck Dive 6"), ("5-LOW", "No Such Trip")]
RULES = [("*", "hire 1[0-9]$"), ("3-MEDIUM", "^night"), ("4-NOT SPECIFIED", "([a-z"), ("2-HIGH", "cave|wreck"), ("*", "(?<kind>reef) dive 2[0-9]$"), ("1-URGENT", r"\p{L}+ hire 2"), ("*", "(?P<x>a)")]
#: The same for the SQL side's dialect; rules that the engine rejects are missing.
SQL_RULES = {"(?<kind>reef) dive 2[0-9]$": "(reef) dive 2[0-9]$", "([a-z": None, "(?P<x>a)": None}
MONTH = "1997-03"

NORM = "trim(regexp_replace(title, '(?i)\\s*\\(sold out\\)\\s*$', ''))"
PAIR_VALUES = ", ".join(f"('{s}', '{t}')" for s, t in PAIRS)
VALID_RULES = [(s, p, SQL_RULES.get(p, p)) for s, p in RULES if SQL_RULES.get(p, p)]
RULE_VALUES = ", ".join(f"({i}, '{s}', '{p}', '{x}')" for i, (s, p, x) in enumerate(VALID_RULES))

DAYS_SQL = f"""
ev as (select *, {EVENT_DAY_SQL.format('start_at')} as s, {NORM} as nt from cal_events),
span as (select *, least(greatest(coalesce(cast(end_at as date), s), s), s + 30) as e from ev),
entries as (select * exclude (e, i), s + cast(i as int) as day, i > 0 as cont, cast(e - s + 1 as bigint) as span_days
  from (select *, unnest(range(cast(e - s + 1 as bigint))) as i from span) x),
hidden as (select * from (values {PAIR_VALUES}) v(hs, ht)),
rules as (select * from (values {RULE_VALUES}) v(ri, rs, rp, rx)),
shown_ev as (select * from ev where not exists (select 1 from hidden where hs = source and ht = nt)
  and not exists (select 1 from rules where (rs = '*' or rs = source) and regexp_matches(nt, '(?i)' || rx))),
shown as (select * from entries where not exists (select 1 from hidden where hs = source and ht = nt)
  and not exists (select 1 from rules where (rs = '*' or rs = source) and regexp_matches(nt, '(?i)' || rx)))
"""


def events(spark, sf):
    return standin(spark, sf, "cal_events").withColumnRenamed("start_at", "start").withColumnRenamed("end_at", "end")


def entries(spark, sf):
    return cal.explode_days(events(spark, sf))


def shown_events(spark, sf):
    return cal.hide(events(spark, sf), PAIRS, RULES)


def day(c="day"):
    return F.col(c).cast("string").alias(c)


def calendar(name, body):
    return query(name, f"with {DAYS_SQL} {body}", ["cal_events"])


@calendar("se04_explode_days", "select ord, strftime(day, '%Y-%m-%d') as day, cont, span_days from entries")
def se04(spark, sf):
    return entries(spark, sf).select("ord", day(), "cont", F.col("span_days").cast("bigint").alias("span_days"))


@calendar(
    "ag01_source_month_counts",
    "select source, strftime(day, '%Y-%m') as month, count(*) as n from shown where not cont group by all",
)
def ag01(spark, sf):
    return cal.source_month_counts(cal.explode_days(shown_events(spark, sf)))


@calendar(
    "ag02_hidden_pair_counts",
    "select hs as source, ht as title, (select count(*) from ev where source = hs and nt = ht) as n from hidden",
)
def ag02(spark, sf):
    return cal.hidden_pair_counts(events(spark, sf), PAIRS)


@calendar(
    "ag03_hidden_rule_counts",
    "select rs as source, rp as pattern, (select count(*) from ev where (rs = '*' or rs = source) and regexp_matches(nt, '(?i)' || rx)) as n from rules",
)
def ag03(spark, sf):
    return cal.hidden_rule_counts(events(spark, sf), RULES)


LO, HI = "1996-01-01", "1999-12-31"


@calendar(
    "ag04_source_status",
    f"""select source, count(*) as fetched, count(*) filter (where start_at[:10] between '{LO}' and '{HI}') as event_count,
          count(*) filter (where not start_at[:10] between '{LO}' and '{HI}') as outside from ev group by all""",
)
def ag04(spark, sf):
    return cal.source_status(events(spark, sf), LO, HI)


@calendar(
    "ag27_month_bounds",
    "select least(min(strftime(day, '%Y-%m')), '1994-12') as min_month, greatest(max(strftime(day, '%Y-%m')), '1995-01') as max_month from entries",
)
def ag27(spark, sf):
    return cal.month_bounds(entries(spark, sf), "1994-12-15")


@calendar("fl01_date_window", f"select ord, source, title, start_at from cal_events where start_at[:10] between '{LO}' and '{HI}'")
def fl01(spark, sf):
    return cal.within_window(events(spark, sf), LO, HI).select("ord", "source", "title", F.col("start").alias("start_at"))


@calendar(
    "fl02_text_search",
    "select ord, title, location, description from cal_events where contains(lower(title || ' ' || coalesce(location, '') || ' ' || coalesce(description, '')), 'bay 1')",
)
def fl02(spark, sf):
    return cal.contains_text(events(spark, sf), " Bay 1").select("ord", "title", "location", "description")


@calendar(
    "fl03_source_subset",
    """select ord, source, false as all_sources from cal_events where source in ('1-URGENT', '5-LOW')
       union all select ord, source, true from cal_events""",
)
def fl03(spark, sf):
    some = cal.of_sources(events(spark, sf), ["1-URGENT", "5-LOW"]).select("ord", "source", F.lit(False).alias("all_sources"))
    return some.unionByName(cal.of_sources(events(spark, sf), []).select("ord", "source", F.lit(True).alias("all_sources")))


@calendar(
    "fl11_month_state",
    f"""select m as month, exists (select 1 from entries where strftime(day, '%Y-%m') = m) as has_any,
          exists (select 1 from shown where strftime(day, '%Y-%m') = m and source = '1-URGENT') as has_shown,
          case when not exists (select 1 from entries where strftime(day, '%Y-%m') = m) then 'none found'
            when not exists (select 1 from shown where strftime(day, '%Y-%m') = m and source = '1-URGENT') then 'none match' else 'listed' end as state
        from (values ('{MONTH}'), ('2030-01')) v(m)""",
)
def fl11(spark, sf):
    all_entries = entries(spark, sf)
    shown = all_entries.filter(F.col("source") == "1-URGENT")
    return cal.month_state(all_entries, shown, MONTH).unionByName(cal.month_state(all_entries, shown, "2030-01"))


@calendar("jn03_exact_hides", "select ord, source, title from ev where not exists (select 1 from hidden where hs = source and ht = nt)")
def jn03(spark, sf):
    return cal.hide_exact(events(spark, sf), PAIRS).select("ord", "source", "title")


@calendar(
    "jn04_pattern_hides",
    "select ord, source, title from ev where not exists (select 1 from rules where (rs = '*' or rs = source) and regexp_matches(nt, '(?i)' || rx))",
)
def jn04(spark, sf):
    return cal.hide_by_rule(events(spark, sf), RULES).select("ord", "source", "title")


@calendar(
    "jn13_days_with_entries",
    f"""select strftime(g.day, '%Y-%m-%d') as day, ord, cont from (select cast(unnest(generate_series(date '1994-12-26', date '1995-02-05', interval 1 day)) as date) as day) g
        left join entries on entries.day = g.day""",
)
def jn13(spark, sf):
    return cal.on_spine(cal.month_grid(spark, "1995-01"), entries(spark, sf)).select(day(), "ord", "cont")


@calendar(
    "se03_calendar_spine",
    f"""select strftime(d, '%Y-%m-%d') as day, strftime(d, '%Y-%m') = m as in_month, m as month from (select m, unnest(generate_series(f - cast(isodow(f) - 1 as int), l + cast(7 - isodow(l) as int), interval 1 day)) as d
        from (select distinct strftime(s, '%Y-%m') as m, cast(date_trunc('month', s) as date) as f, last_day(s) as l from ev) x) y""",
)
def se03(spark, sf):
    first = F.trunc("start_day", "month")
    last = F.last_day(first)
    months = (
        events(spark, sf).select(tm.event_day(F.col("start")).alias("start_day"))
        .select(first.alias("f"), last.alias("l")).distinct()
    )
    grid = months.select(
        tm.month_key(F.col("f")).alias("month"),
        F.explode(F.sequence(F.date_sub("f", F.weekday("f")), F.date_add("l", 6 - F.weekday("l")))).alias("day"),
    )
    return grid.select(day(), (tm.month_key(F.col("day")) == F.col("month")).alias("in_month"), "month")


@calendar(
    "se05_agenda",
    f"select strftime(day, '%Y-%m-%d') as day, ord, title, span_days from shown where not cont and strftime(day, '%Y-%m') = '{MONTH}'",
)
def se05(spark, sf):
    return cal.agenda(cal.explode_days(shown_events(spark, sf)), MONTH).select(
        day(), "ord", "title", F.col("span_days").cast("bigint").alias("span_days")
    )


_TKEY = "case when all_day then '' else strftime(timezone('Australia/Sydney', cast(start_at as timestamptz)), '%Y-%m-%dT%H:%M') end"


@calendar(
    "wn11_day_cells",
    f"""select strftime(day, '%Y-%m-%d') as day, ord, place, more from (select *, n - case when n <= 5 then n else 4 end as more from (
          select day, ord, row_number() over (partition by day order by {_TKEY}, lower(title), title, ord) as place, count(*) over (partition by day) as n from entries) x) y
        where place <= n - more""",
)
def wn11(spark, sf):
    return cal.day_cells(entries(spark, sf), "ord").select(day(), "ord", F.col("place").cast("bigint").alias("place"), "more")


@calendar(
    "so01_event_order",
    "select ord, start_at, row_number() over (order by start_at[:10], not all_day, start_at, ord) as place from cal_events",
)
def so01(spark, sf):
    return cal.event_places(events(spark, sf), "ord").select("ord", F.col("start").alias("start_at"), "place")


@calendar(
    "so02_day_order",
    f"select strftime(day, '%Y-%m-%d') as day, ord, {_TKEY} as time_key from entries",
)
def so02(spark, sf):
    return cal.day_order(entries(spark, sf)).select(day(), "ord", "time_key")


@calendar(
    "dd01_first_listing",
    "select * exclude (rn) from (select title, start_at, ord, source, row_number() over (partition by title, start_at order by ord) as rn from cal_events) x where rn = 1",
)
def dd01(spark, sf):
    return cal.first_listing(events(spark, sf), "ord").select("title", F.col("start").alias("start_at"), "ord", "source")


@query(
    "dd02_first_by_id",
    """select ord, summary from (select ord, summary, row_number() over (partition by coalesce(nullif(id, ''), uuid) order by ord) as rn
       from (select o_orderkey as ord, case when o_custkey % 3 = 0 then '' when o_custkey % 3 = 1 then null else 'c' || cast(o_custkey as varchar) end as id,
         'u' || cast(o_custkey % 40 as varchar) as uuid, o_orderpriority as summary from orders) x) y where rn = 1""",
)
def dd02(spark, sf):
    k = F.col("o_custkey")
    records = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("ord"), F.when(k % 3 == 0, "").when(k % 3 == 2, F.concat(F.lit("c"), k.cast("string"))).alias("id"),
        F.concat(F.lit("u"), (k % 40).cast("string")).alias("uuid"), F.col("o_orderpriority").alias("summary"),
    )
    return cal.first_by_id(records, "ord").select("ord", "summary")


@query(
    "dd03_last_by_id",
    """select id, status, place from (select o_custkey as id, o_orderstatus as status, min(o_orderkey) over (partition by o_custkey) as place,
         row_number() over (partition by o_custkey order by o_orderkey desc) as rn from orders) x where rn = 1""",
)
def dd03(spark, sf):
    items = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("ord"), F.col("o_orderstatus").alias("status"))
    return cal.last_by_id(items, "ord").select("id", "status", "place")


@query(
    "dd04_two_key_dedupe",
    """with recursive rows as (
         select min(o_orderkey) as ord, o_custkey as booking, strftime(o_orderdate, '%Y-%m-%d') || '|' || o_orderpriority as shown from orders group by 2, 3),
       rounds(ord, booking, shown, kept) as (
         select *, null::boolean from rows
         union all
         select ord, booking, shown, case when head then true end from (
           select *, bool_or(head) over (partition by booking) or bool_or(head) over (partition by shown) as taken from (
             select *, ord = min(ord) over (partition by booking) and ord = min(ord) over (partition by shown) as head from rounds where kept is null) x) y
         where head or not taken)
       select ord, booking, shown from rounds where kept""",
)
def dd04(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("ord"), F.col("o_custkey").alias("booking"),
        F.concat_ws("|", F.col("o_orderdate").cast("date").cast("string"), F.col("o_orderpriority")).alias("shown"),
    )
    return greedy_two_key_dedupe(rows, "booking", "shown", "ord")


@query(
    "dd05_item_days",
    "select distinct o_custkey as item, strftime(o_orderdate, '%Y-%m-%d') as day from orders",
)
def dd05(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("item"), F.col("o_orderdate").cast("date").cast("string").alias("day")
    ).distinct()


@query(
    "wn01_header_carry",
    """select conv_id, turn, last_value(own ignore nulls) over (partition by source order by conv_id, turn rows between unbounded preceding and current row) as header
       from (select conv_id, turn, conv_id % 3 as source, case when role = 'user' and length(text) % 4 = 0 then text end as own from conversations) x""",
)
def wn01(spark, sf):
    turns = table(spark, sf, "conversations").select(
        "conv_id", "turn", (F.col("conv_id") % 3).alias("source"),
        F.when((F.col("role") == "user") & (F.length("text") % 4 == 0), F.col("text")).alias("own"),
    )
    return forward_fill(turns, "source", "conv_id", "turn", "own", "header", pages_per_block=16).select("conv_id", "turn", "header")


@query(
    "fl10_on_demand_density",
    "select o_custkey as item, count(*) as days from orders group by item having count(*) <= 12 * 0.85",
)
def fl10(spark, sf):
    from shorelark.sources.listings import scheduled_items

    days = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"))
    kept = days.join(scheduled_items(days, 12), "id", "left_semi")
    return kept.groupBy(F.col("id").alias("item")).agg(F.count(F.lit(1)).alias("days"))
