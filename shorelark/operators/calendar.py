"""Calendar operators over the event model.

Events: source, title, start, end, all_day, url, location, description (start and end are text).
Entries: one row per event and day, with day, cont (not the first day) and span_days.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shorelark.functions import text as tx
from shorelark.functions import times as tm
from shorelark.operators.scale import first_by, global_position, top_per_key
from shorelark.session import parameter_frame

MAX_SPAN_DAYS = 30  # fixed value: days shown after the first one
CHIPS = 4  # fixed value: entries shown in a crowded day cell


# ---- entries and spines ---------------------------------------------------

def explode_days(events: DataFrame) -> DataFrame:
    """One row per event and covered day; an end before the start counts as one day."""
    first, last = F.col("_first"), F.col("_last")
    dated = events.withColumns({
        "_first": tm.event_day(F.col("start")), "_last": tm.event_day(F.col("end")), "_clock": tm.event_minutes(F.col("start"))
    }).filter(first.isNotNull())
    clock = F.concat(
        first.cast("string"), F.lit("T"), tm.two(F.floor(F.col("_clock") / 60).cast("int")), F.lit(":"), tm.two(F.col("_clock") % 60)
    )
    # the order within a day is settled per event, before the days multiply it
    return (
        dated.withColumns({
            "_last": F.least(F.greatest(F.coalesce(last, first), first), F.date_add(first, MAX_SPAN_DAYS)),
            "time_key": F.when(F.col("all_day"), "").otherwise(clock),
        })
        .select(
            *events.columns, "time_key",
            (F.datediff("_last", "_first") + 1).alias("span_days"),
            F.posexplode(F.sequence("_first", "_last")).alias("_i", "day"),
        )
        .withColumn("cont", F.col("_i") > 0).drop("_i")
    )


def month_grid(spark: SparkSession, month: str) -> DataFrame:
    """Monday-start weeks that cover a 'YYYY-MM' month."""
    first = f"date'{month}-01'"
    return spark.range(1).select(
        F.explode(F.expr(
            f"sequence(date_sub({first}, weekday({first})), "
            f"date_add(last_day({first}), 6 - weekday(last_day({first}))))"
        )).alias("day")
    ).withColumn("in_month", tm.month_key(F.col("day")) == month)


def window_months(spark: SparkSession, today: str, ahead: int = 4) -> DataFrame:
    """The months of a gathering window with its first and last day."""
    first = F.trunc(F.lit(today).cast("date"), "month")
    return spark.range(1).select(
        F.explode(F.sequence(first, F.add_months(first, ahead), F.expr("interval 1 month"))).alias("first_day")
    ).select(
        tm.month_key(F.col("first_day")).alias("month"), "first_day", F.last_day("first_day").alias("last_day")
    )


def on_spine(days: DataFrame, entries: DataFrame) -> DataFrame:
    """Every day of a spine with its entries; days without any appear once, with nulls.

    Written as a union so that a crowded day is never gathered for an outer join.
    """
    hit = entries.join(days.select("day"), "day", "left_semi")
    filled = hit.select("day").distinct()
    empty = days.select("day").join(filled, "day", "left_anti")
    return hit.unionByName(empty, allowMissingColumns=True)


# ---- filters --------------------------------------------------------------

def within_window(events: DataFrame, lo: str, hi: str) -> DataFrame:
    return events.filter(F.substring("start", 1, 10).between(lo, hi))


def contains_text(events: DataFrame, query: str) -> DataFrame:
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("title", "location", "description")]))
    return events.filter(hay.contains(query.strip().lower())) if query.strip() else events


def of_sources(events: DataFrame, enabled: Iterable[str]) -> DataFrame:
    """An empty selection means all sources."""
    ids = list(enabled)
    return events.filter(F.col("source").isin(ids)) if ids else events


def month_state(entries: DataFrame, shown: DataFrame, month: str) -> DataFrame:
    """Whether a month has entries at all and whether any of them is shown."""
    def any_in(df: DataFrame, name: str) -> DataFrame:
        return df.filter(tm.month_key(F.col("day")) == month).agg((F.count(F.lit(1)) > 0).alias(name))

    both = any_in(entries, "has_any").withColumn("_k", F.lit(1)).join(
        any_in(shown, "has_shown").withColumn("_k", F.lit(1)), "_k"
    )
    return both.select(
        F.lit(month).alias("month"), "has_any", "has_shown",
        F.when(~F.col("has_any"), "none found").when(~F.col("has_shown"), "none match").otherwise("listed").alias("state"),
    )


# ---- hides ----------------------------------------------------------------

#: Rules with a literal up to this number are one predicate; more are looked up by a piece of their literal.
DIRECT_RULES = 50
#: Rules that are tried in one plan.
TRIED = 200


def valid_rules(spark: SparkSession, rules: Iterable[tuple[str, str]]) -> list[tuple[str, str]]:
    """Rules whose pattern the engine that runs it accepts; the others are reported and dropped. Rules are tried many at
    a time, and only a failure is searched for by halves."""
    def tried(part: list[tuple[str, str]]) -> list[tuple[str, str]]:
        try:
            # constants: the optimizer runs them, so a bad one fails the plan and no task
            spark.range(1).select(F.array(*[F.lit("x").rlike(f"(?i){p}") for _, p in part])).collect()
        except PySparkException as e:
            if len(part) == 1:
                warnings.warn(f"hide rule {part[0][1]!r} of {part[0][0]!r} is dropped: {str(e)[:80]}", stacklevel=3)
                return []
            return tried(part[: len(part) // 2]) + tried(part[len(part) // 2:])
        return part

    rules = list(rules)
    return [r for at in range(0, len(rules), TRIED) for r in tried(rules[at:at + TRIED])]


def required_literal(pattern: str) -> str:
    """The longest text that every match of a pattern holds, in lower case; empty where that can't be told at a glance."""
    if re.search(r"[|()\[\]{}#]|\\[^bBdDwWsS.$^*+?\-]", pattern):
        return ""
    pieces, at = [""], 0
    while at < len(pattern):
        c, at = pattern[at], at + 1
        if c == "\\":
            c, at = pattern[at:at + 1], at + 1
            literal = c in ".$^*+?-"
        else:
            literal = c not in ".^$*+?"
        if at < len(pattern) and pattern[at] in "*?":
            literal = False
        pieces[-1] += c if literal else ""
        if not literal or pattern[at:at + 1] == "+":
            pieces.append("")
    return max(pieces, key=len).lower()


def rule_matches(titles: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(source, _t, rule): titles with the numbers of the rules they match, for rules that have a literal of three characters.

    A rule waits at the first three characters of its literal; a title comes to each three that it holds, and the pattern
    runs only where the whole literal is found.
    """
    rows = [(i, s, p, required_literal(p)) for i, (s, p) in enumerate(rules)]
    waiting = parameter_frame(titles.sparkSession, [(*r, r[3][:3]) for r in rows], "rule int, rs string, pattern string, literal string, gram string")
    low = F.lower("_t")
    starts = F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(1)))
    grams = F.array_distinct(F.transform(starts, lambda i: F.substr(low, i, F.lit(3))))
    met = titles.withColumn("gram", F.explode(grams)).join(waiting, "gram").filter("rs = '*' or rs = source")
    return met.filter(F.contains(low, "literal") & F.rlike("_t", F.concat(F.lit("(?i)"), "pattern"))).select("source", "_t", "rule")


def _by_literal(rules: list[tuple[str, str]]) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """Rules to be looked up, and rules to be run on every title."""
    told = [r for r in rules if len(required_literal(r[1])) >= 3]
    return (told, [r for r in rules if len(required_literal(r[1])) < 3]) if len(told) > DIRECT_RULES else ([], rules)


def rule_hit(source: str, pattern: str) -> Column:
    title = tx.normal_title(F.col("title"))
    match = title.rlike(f"(?i){pattern}")
    return match if source == "*" else (F.col("source") == source) & match


def hide_exact(events: DataFrame, pairs: Iterable[tuple[str, str]]) -> DataFrame:
    """Drop events whose (source, normalised title) is on the list."""
    rows = list(pairs)
    if not rows:
        return events
    hidden = parameter_frame(events.sparkSession, rows, "source string, _t string")
    return (
        events.withColumn("_t", tx.normal_title(F.col("title")))
        .join(hidden, ["source", "_t"], "left_anti").drop("_t")
    )


def hide_by_rule(events: DataFrame, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """Drop events that any rule matches: few rules are one predicate, many are looked up by their literals."""
    told, direct = _by_literal(valid_rules(events.sparkSession, rules))
    for source, pattern in direct:
        events = events.filter(~F.coalesce(rule_hit(source, pattern), F.lit(False)))
    if not told:
        return events
    named = events.withColumn("_t", tx.normal_title(F.col("title")))
    hidden = rule_matches(named.select("source", "_t").distinct(), told).select("source", "_t").distinct()
    return named.join(hidden, ["source", "_t"], "left_anti").select(events.columns)


def hide(events: DataFrame, pairs: Iterable[tuple[str, str]], rules: Iterable[tuple[str, str]]) -> DataFrame:
    """Cheap exact hides first, patterns on what is left."""
    return hide_by_rule(hide_exact(events, pairs), rules)


def hidden_pair_counts(events: DataFrame, pairs: Iterable[tuple[str, str]]) -> DataFrame:
    listed = parameter_frame(events.sparkSession, list(pairs), "source string, title string")
    counts = (
        events.select("source", tx.normal_title(F.col("title")).alias("title"))
        .join(listed, ["source", "title"], "left_semi")
        .groupBy("source", "title").agg(F.count(F.lit(1)).alias("n"))
    )
    return listed.join(counts, ["source", "title"], "left").select(
        "source", "title", F.coalesce("n", F.lit(0)).alias("n")
    )


def hidden_rule_counts(events: DataFrame, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """Events per rule: few rules in one pass over the events, many by their literals."""
    spark = events.sparkSession
    told, direct = _by_literal(valid_rules(spark, rules))
    out = spark.createDataFrame([], "source string, pattern string, n bigint")
    if direct:
        one = events.agg(*[F.count_if(rule_hit(s, p)).alias(f"_{i}") for i, (s, p) in enumerate(direct)])
        rows = F.array(*[
            F.struct(F.lit(s).alias("source"), F.lit(p).alias("pattern"), F.col(f"_{i}").alias("n"))
            for i, (s, p) in enumerate(direct)
        ])
        out = one.select(F.inline(rows))
    if told:
        titles = events.groupBy("source", tx.normal_title(F.col("title")).alias("_t")).agg(F.count(F.lit(1)).alias("n"))
        counts = rule_matches(titles.select("source", "_t"), told).join(titles, ["source", "_t"]).groupBy("rule").agg(F.sum("n").alias("n"))
        listed = parameter_frame(spark, [(i, s, p) for i, (s, p) in enumerate(told)], "rule int, source string, pattern string")
        out = out.unionByName(listed.join(counts, "rule", "left").select("source", "pattern", F.coalesce("n", F.lit(0)).alias("n")))
    return out


# ---- counts and orders ----------------------------------------------------

def source_month_counts(entries: DataFrame) -> DataFrame:
    """Events that start in each month, per source (hides are applied before)."""
    return (
        entries.filter(~F.col("cont")).groupBy("source", tm.month_key(F.col("day")).alias("month"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def source_status(fetched: DataFrame, lo: str, hi: str) -> DataFrame:
    """Fetched and kept events per source."""
    kept = F.substring("start", 1, 10).between(lo, hi)
    return fetched.groupBy("source").agg(
        F.count(F.lit(1)).alias("fetched"), F.count_if(kept).alias("event_count")
    ).withColumn("outside", F.col("fetched") - F.col("event_count"))


def month_bounds(entries: DataFrame, today: str) -> DataFrame:
    """First and last month to offer: the data's, widened to this month and the next."""
    current = today[:7]
    following = tm.shift_month(F.lit(current), 1)
    month = tm.month_key(F.col("day"))
    return entries.agg(
        F.least(F.min(month), F.lit(current)).alias("min_month"),
        F.greatest(F.max(month), following).alias("max_month"),
    )


def clamp_month(month: Column, lo: Column, hi: Column) -> Column:
    return F.least(F.greatest(month, lo), hi)


def event_order_keys() -> list[Column]:
    """Day, all-day events first, then the start text."""
    return [F.substring("start", 1, 10).asc(), (~F.col("all_day")).asc(), F.col("start").asc()]


def event_order(events: DataFrame) -> DataFrame:
    return events.orderBy(*event_order_keys())


def event_places(events: DataFrame, tie: str, out: str = "place") -> DataFrame:
    """Events with their place in the calendar's order, from 1; ``tie`` orders events that are equal in it."""
    return global_position(events, [*event_order_keys(), F.col(tie).asc()], out)


def day_order_keys() -> list[Column]:
    """Within a day: all-day first, then start day and time, then title."""
    return [F.col("time_key").asc(), F.collate(F.col("title"), "UNICODE").asc()]


def day_order(entries: DataFrame) -> DataFrame:
    return entries.orderBy("day", *day_order_keys())


def agenda(entries: DataFrame, month: str) -> DataFrame:
    """Events listed on their first day only, for one month."""
    rows = entries.filter(~F.col("cont") & (tm.month_key(F.col("day")) == month))
    return day_order(rows)


def day_cells(entries: DataFrame, tie: str, chips: int = CHIPS) -> DataFrame:
    """Entries shown in each day cell with the number left out.

    Up to ``chips + 1`` entries are all shown, otherwise ``chips``. Counting and ranking are separate
    so that only the leading rows of a crowded day travel.
    """
    counts = entries.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    top = top_per_key(entries, ["day"], [*day_order_keys(), F.col(tie).asc()], chips + 1, "place")
    shown = F.when(F.col("n") <= chips + 1, F.col("n")).otherwise(F.lit(chips))
    return (
        top.join(counts, "day").withColumn("more", F.col("n") - shown).filter(F.col("place") <= shown)
    )


# ---- de-duplication -------------------------------------------------------

def first_listing(events: DataFrame, ordinal: str) -> DataFrame:
    """First of the events with one title and start."""
    return first_by(events, ["title", "start"], [ordinal])


def first_by_id(records: DataFrame, ordinal: str) -> DataFrame:
    """First record per id, the uuid standing in for a missing id."""
    keyed = records.withColumn("_id", F.coalesce(F.nullif(F.col("id"), F.lit("")), F.col("uuid")))
    return first_by(keyed, ["_id"], [ordinal]).drop("_id")


def last_by_id(items: DataFrame, ordinal: str) -> DataFrame:
    """Last version per id, in the place of the first one."""
    place = F.min(ordinal).alias("place")
    rest = [c for c in items.columns if c not in ("id", ordinal)]
    return items.groupBy("id").agg(F.max_by(F.struct(*rest), ordinal).alias("_row"), place).select(
        "id", *[F.col(f"_row.{c}").alias(c) for c in rest], "place"
    )
