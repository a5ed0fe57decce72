"""Schedules tied to places: families, facets, location repair and coordinates."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain, groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shorelark.functions import text as tx
from shorelark.operators.scale import COMPONENT_ROWS, components_of, first_by, global_position, settled_in_order
from shorelark.session import cut_lineage, parameter_frame

# fixed values: country names an address may end in, with their ISO codes
COUNTRIES = {
    "germany": "de", "united states": "us", "usa": "us", "mexico": "mx", "méxico": "mx", "italy": "it",
    "philippines": "ph", "china": "cn", "norway": "no", "netherlands": "nl", "canada": "ca", "france": "fr",
    "spain": "es", "egypt": "eg", "croatia": "hr", "poland": "pl", "switzerland": "ch", "indonesia": "id",
    "hungary": "hu", "korea (south)": "kr", "south korea": "kr", "russia": "ru", "japan": "jp", "greece": "gr",
    "austria": "at", "bonaire": "bq", "cyprus": "cy", "monaco": "mc", "taiwan": "tw", "united kingdom": "gb",
    "uk": "gb", "malaysia": "my", "thailand": "th", "portugal": "pt", "finland": "fi", "sweden": "se",
    "singapore": "sg", "malta": "mt", "australia": "au", "morocco": "ma", "albania": "al", "belgium": "be",
    "kuwait": "kw", "uae": "ae", "united arab emirates": "ae", "ireland": "ie", "denmark": "dk",
    "iceland": "is", "turkey": "tr", "israel": "il", "brazil": "br", "slovenia": "si", "czechia": "cz",
    "new zealand": "nz", "south africa": "za",
}
ALTERNATES = {"bq": ["nl", "bq"], "nl": ["nl", "bq"]}  # fixed values: territories that answer for each other

# fixed values: course families in display order
FAMILIES = (
    "Recreational", "Fundamentals", "Primers", "Specialty", "Cave", "Technical", "CCR",
    "Instructor Training", "First Aid",
)

# fixed values: titles whose family the wording rules would miss or misread; {brand} is the agency name
# some titles carry
TITLE_FAMILY = {
    "Discover Diving": "Recreational", "Scuba Diver": "Recreational", "Scuba Diver Upgrade to OW": "Recreational",
    "Open Water Diver": "Recreational", "Advanced Open Water Diver": "Recreational",
    "Master Diver": "Recreational", "Recreational Dive Leader": "Recreational",
    "{brand} Performance Diver": "Recreational",
    "DPV Diver 1": "Specialty", "Documentation Diver": "Specialty", "Photogrammetry Diver": "Specialty",
    "Scientific Diver": "Specialty", "Gas Blender": "Specialty",
    "CCR Cave": "Cave",
    "Core Module": "Instructor Training", "Apprentice Project: Cave 2": "Instructor Training",
    "Apprentice Project: Tech 2": "Instructor Training", "ITC Rec 1 / Fundamentals": "Instructor Training",
    "ITC {brand} Fundamentals": "Instructor Training", "ITC Technical Diver 1": "Instructor Training",
    "ITC Cave Diver 1": "Instructor Training",
}

# fixed values: wording rules in order of precedence, on the lower-cased title
WORDING_FAMILY = (
    (("ccr", "pscr"), "CCR"), (("cave",), "Cave"), (("technical diver", "tech "), "Technical"),
    (("fundamentals",), "Fundamentals"), (("primer",), "Primers"),
    (("itc", "instructor", "apprentice"), "Instructor Training"), (("first aid", "bls", "oxygen"), "First Aid"),
)
DEFAULT_FAMILY = "Specialty"


def course_family(title: Column, brand: str) -> Column:
    """Family of a title of the agency ``brand``: exact titles first, then the wording rules, then the default family."""
    by_title: dict[str, list[str]] = {}
    for name, family in TITLE_FAMILY.items():
        by_title.setdefault(family, []).append(name.replace("{brand}", brand))
    out = F.lit(DEFAULT_FAMILY)
    lower = F.lower(title)
    for words, family in reversed(WORDING_FAMILY):
        hit = lower.contains(words[0])
        for word in words[1:]:
            hit = hit | lower.contains(word)
        out = F.when(hit, family).otherwise(out)
    for family, names in by_title.items():
        out = F.when(title.isin(names), family).otherwise(out)
    return out


# ---- addresses ------------------------------------------------------------

def address_parts(loc: Column, keep_empty: bool = False) -> Column:
    parts = F.transform(F.split(loc, ","), lambda p: tx.strip(p))
    return parts if keep_empty else F.filter(parts, lambda p: p != "")


def country_of(loc: Column) -> Column:
    """ISO code of the last address part, null when unknown."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(COUNTRIES.items())])
    return F.try_element_at(table, F.lower(F.element_at(address_parts(loc, keep_empty=True), -1)))


def accepts_country(expected: Column, got: Column) -> Column:
    """Whether a found country is the expected one or an allowed alternate."""
    table = F.create_map(*[
        x for k, v in ALTERNATES.items() for x in (F.lit(k), F.lit(v))
    ])
    return F.array_contains(F.coalesce(F.try_element_at(table, expected), F.array(expected)), got)


def fallback_queries(loc: Column) -> Column:
    """Ordered distinct queries: the whole address, then ever coarser parts of it."""
    parts = address_parts(loc)
    n = F.size(parts)
    first, last = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(-1))
    before_last = F.try_element_at(parts, F.lit(-2))
    pair = F.lit(", ")
    outer = F.when(n >= 3, F.array(F.concat(first, pair, last), F.concat(before_last, pair, last)))
    ends = F.when(n >= 2, F.array(first, last))
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.array(loc), F.coalesce(outer, empty), F.coalesce(ends, empty)))


# ---- lookups --------------------------------------------------------------

def export_lookup(cache: DataFrame, ordinal: str) -> DataFrame:
    """Located entries under their canonical key, five decimals, the later entry winning a collision."""
    located = cache.filter(F.col("lat").isNotNull()).select(
        tx.canonical(F.col("loc")).alias("loc"), F.round("lat", 5).alias("lat"), F.round("lng", 5).alias("lng"), ordinal
    )
    return first_by(located, ["loc"], [ordinal], latest=True).drop(ordinal)


def overlay(bundled: DataFrame, learned: DataFrame) -> DataFrame:
    """Bundled lookup with learned entries on top."""
    both = bundled.withColumn("_rank", F.lit(0)).unionByName(learned.withColumn("_rank", F.lit(1)))
    return both.groupBy("loc").agg(F.max_by(F.struct("lat", "lng"), "_rank").alias("_p")).select(
        "loc", F.col("_p.lat").alias("lat"), F.col("_p.lng").alias("lng")
    )


def with_coordinates(classes: DataFrame, lookup: DataFrame) -> DataFrame:
    """Coordinates by canonical location; unplaced classes keep nulls.

    The lookup has one row per location, so a popular location only widens the class side, which
    adaptive skew handling splits; a small lookup is broadcast by its measured size.
    """
    keyed = classes.withColumn("_loc", tx.canonical(F.col("location")))
    return keyed.join(lookup.withColumnRenamed("loc", "_loc"), "_loc", "left").drop("_loc").withColumn(
        "placed", F.col("lat").isNotNull()
    )


# ---- class filters --------------------------------------------------------

def current_classes(classes: DataFrame, today: str) -> DataFrame:
    """From today on; undated classes stay."""
    return classes.filter(F.col("iso").isNull() | (F.col("iso") >= F.lit(today).cast("date")))


def filter_classes(
    classes: DataFrame, courses: list[str] | None = None, instructors: list[str] | None = None, text: str = "",
    since: str | None = None, until: str | None = None,
) -> DataFrame:
    """The selection; a null instructor and a null date are never excluded."""
    if courses is not None:
        classes = classes.filter(F.col("course").isin(courses))
    if instructors is not None:
        named = F.coalesce(F.col("instructor"), F.lit("")) != ""
        classes = classes.filter(~named | F.col("instructor").isin(instructors))
    if since:
        classes = classes.filter(F.col("iso").isNull() | (F.col("iso") >= F.lit(since).cast("date")))
    if until:
        classes = classes.filter(F.col("iso").isNull() | (F.col("iso") <= F.lit(until).cast("date")))
    if text.strip():
        hay = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("course", "location", "instructor")]))
        classes = classes.filter(hay.contains(text.strip().lower()))
    return classes


def find_instructors(counts: DataFrame, text: str) -> DataFrame:
    return counts.filter(F.lower("instructor").contains(text.strip().lower()))


# ---- facets ---------------------------------------------------------------

def place_summary(placed: DataFrame) -> DataFrame:
    """Classes per coordinate with their date range. The classes themselves stay rows, keyed by place."""
    return placed.groupBy("lat", "lng").agg(
        F.count(F.lit(1)).alias("n"), F.min("iso").alias("first_iso"), F.max("iso").alias("last_iso")
    )


def family_facets(placed: DataFrame) -> DataFrame:
    """Counts per family and course, with the family subtotal as a row without course."""
    by_course = placed.groupBy("family", "course").agg(F.count(F.lit(1)).alias("n"))
    return by_course.groupingSets([["family", "course"], ["family"]], "family", "course").agg(F.sum("n").alias("n"))


def instructor_counts(placed: DataFrame) -> DataFrame:
    named = placed.filter(F.coalesce(F.col("instructor"), F.lit("")) != "")
    return named.groupBy("instructor").agg(F.count(F.lit(1)).alias("n"))


def dominant_family(placed: DataFrame, ordinal: str) -> DataFrame:
    """Most frequent family per place, the one seen first winning a tie."""
    counts = placed.groupBy("lat", "lng", "family").agg(F.count(F.lit(1)).alias("n"), F.min(ordinal).alias("_first"))
    best = F.min_by(F.struct("family", "n"), F.struct(-F.col("n"), F.col("_first")))
    return counts.groupBy("lat", "lng").agg(best.alias("_b")).select(
        "lat", "lng", F.col("_b.family").alias("family"), F.col("_b.n").alias("n")
    )


def selection_state(placed: DataFrame, active: list[str]) -> DataFrame:
    """Per family: none, some or all of its courses selected."""
    courses = placed.select("family", "course").distinct()
    return courses.groupBy("family").agg(
        F.count(F.lit(1)).alias("courses"), F.count_if(F.col("course").isin(active)).alias("on")
    ).withColumn("state", F.when(F.col("on") == 0, "off").when(F.col("on") < F.col("courses"), "partial").otherwise("all"))


def cell_totals(places: DataFrame, cell_deg: float) -> DataFrame:
    """Class counts summed per grid cell, as a cluster badge shows them."""
    cell = [F.floor(F.col(c) / cell_deg).alias(f"cell_{c}") for c in ("lat", "lng")]
    return places.groupBy(*cell).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("places"))


def date_bounds(classes: DataFrame, today: str) -> DataFrame:
    """First and last date, and today clamped between them."""
    day = F.lit(today).cast("date")
    return classes.agg(F.min("iso").alias("min_iso"), F.max("iso").alias("max_iso")).withColumn(
        "from_iso", F.when(F.col("min_iso").isNotNull(), F.greatest("min_iso", F.least(day, F.col("max_iso"))))
    )


def padded_bounds(places: DataFrame, pad: float = 0.12) -> DataFrame:
    box = places.agg(*[f(c).alias(f"{n}_{c}") for c in ("lat", "lng") for f, n in ((F.min, "min"), (F.max, "max"))])

    def side(c: str, sign: int) -> Column:
        edge = F.col(f"max_{c}") if sign > 0 else F.col(f"min_{c}")
        return edge + sign * pad * (F.col(f"max_{c}") - F.col(f"min_{c}"))

    return box.select(
        side("lat", -1).alias("south"), side("lng", -1).alias("west"), side("lat", 1).alias("north"), side("lng", 1).alias("east")
    )


def unplaced_summary(placed: DataFrame) -> DataFrame:
    """Distinct locations, classes without coordinates and distinct spellings missing."""
    return placed.agg(
        F.count_distinct(tx.canonical(F.col("location"))).alias("locations"),
        F.count_if(~F.col("placed")).alias("unplaced_classes"),
        F.count_distinct(F.when(~F.col("placed"), F.col("location"))).alias("unplaced_spellings"),
    )


def lookup_queue(placed: DataFrame, ordinal: str) -> DataFrame:
    """All unknown locations in order of appearance, first spelling kept."""
    unknown = placed.filter(~F.col("placed")).select(
        tx.canonical(F.col("location")).alias("loc"), "location", ordinal
    )
    return first_by(unknown, ["loc"], [ordinal]).orderBy(ordinal)


def first_spelling(df: DataFrame, column: str, ordinal: str) -> DataFrame:
    keyed = df.select(tx.canonical(F.col(column)).alias("loc"), column, ordinal)
    return first_by(keyed, ["loc"], [ordinal])


def world_copies(points: DataFrame, centre_lng: float = 0.0) -> DataFrame:
    """Each point one world west, in place and one world east of the viewed copy."""
    k = int((centre_lng / 360 + 0.5) // 1)
    offsets = F.array(*[F.lit((k + i) * 360) for i in (-1, 0, 1)])
    return points.withColumn("offset", F.explode(offsets)).withColumn("copy_lng", F.col("lng") + F.col("offset"))


def class_order_keys() -> list[Column]:
    """Date (undated last), course, location, instructor."""
    return [F.col("iso").asc_nulls_last(), *[F.col(c).asc() for c in ("course", "location", "instructor")]]


def class_order(classes: DataFrame) -> DataFrame:
    return classes.orderBy(*class_order_keys())


def class_places(classes: DataFrame, tie: str, out: str = "place") -> DataFrame:
    """Classes with their place in the list, from 1; ``tie`` orders classes that are equal in it."""
    return global_position(classes, [*class_order_keys(), F.col(tie).asc()], out)


def natural_key(c: Column) -> Column:
    """Sort key with the length in front of each digit run, so 'Cave 2' precedes 'Cave 10'."""
    pieces = F.regexp_extract_all(F.lower(c), F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))

    def key(p: Column) -> Column:
        return F.concat(F.lpad(F.length(p).cast("string"), 6, "0"), p)

    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike("^[0-9]"), key(F.regexp_replace(p, "^0+(?=.)", ""))).otherwise(p)), "")


# ---- resolving locations --------------------------------------------------

def missing_locations(locs: DataFrame, cache: DataFrame) -> DataFrame:
    """Locations that are unknown or whose last try failed."""
    return locs.join(cache.filter(F.col("lat").isNotNull()).select("loc"), "loc", "left_anti")


def _city_and_tail(df: DataFrame) -> DataFrame:
    parts = address_parts(F.col("loc"), keep_empty=True)
    return df.withColumn("_parts", parts).withColumn("city", F.element_at("_parts", 1)).withColumn(
        "tail", F.array_join(F.slice("_parts", 2, F.size("_parts")), ", ")
    ).filter(F.size("_parts") >= 2).drop("_parts")


PIECES = 3  # one more than the edits a match may have
EDITS = 2


def _piece(length: Column, number: Column) -> tuple[Column, Column]:
    """Start (from 0) and size of a piece of a word of the given length."""
    start = F.floor(length * number / PIECES).cast("int")
    return start, F.floor(length * (number + 1) / PIECES).cast("int") - start


def typo_edges(todo: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs of a location and a known one with the same tail and a city one or two edits away.

    Of three pieces of the known city two edits leave one whole, moved by at most two places. So cities meet on
    a piece of an assumed length of the known one: a fixed number of keys for each, however long they are.
    """
    numbers = F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1)))
    left = _city_and_tail(todo.select("loc").distinct()).withColumn("_len", F.length("city")).filter(F.col("_len") >= 5)
    left = left.withColumn("_maxd", F.when(F.col("_len") <= 8, 1).otherwise(EDITS))
    left = left.withColumn("_known", F.explode(F.sequence(F.col("_len") - EDITS, F.col("_len") + EDITS)))
    left = left.withColumn("_j", numbers).withColumn("_shift", F.explode(F.sequence(F.lit(-EDITS), F.lit(EDITS))))
    start, size = _piece(F.col("_known"), F.col("_j"))
    left = left.withColumns({"_at": start + F.col("_shift"), "_size": size}).filter("_at >= 0 and _at + _size <= _len")
    left = left.select("loc", "city", "tail", "_maxd", "_known", "_j", F.substr("city", F.col("_at") + 1, F.col("_size")).alias("_v")).distinct()
    right = _city_and_tail(known.select("loc").distinct()).withColumn("_known", F.length("city")).withColumn("_j", numbers)
    start, size = _piece(F.col("_known"), F.col("_j"))
    right = right.select(F.col("loc").alias("known_loc"), F.col("city").alias("known_city"), "tail", "_known", "_j", F.substr("city", start + 1, size).alias("_v"))
    near = left.join(right, ["tail", "_known", "_j", "_v"]).filter(F.col("city") != F.col("known_city"))
    distance = F.when(
        F.col("_maxd") == 1, F.levenshtein("city", "known_city", 1)
    ).otherwise(F.levenshtein("city", "known_city", EDITS))
    return near.select("loc", "known_loc", distance.alias("d")).filter(F.col("d") > 0).distinct()


def pick_typo(edges: DataFrame, located: DataFrame) -> DataFrame:
    """The nearest known spelling, if all nearest ones share one coordinate; smallest key wins."""
    facts = located.filter(F.col("lat").isNotNull() & ~F.coalesce(F.col("approx"), F.lit(False)))
    joined = edges.join(facts.select(F.col("loc").alias("known_loc"), "lat", "lng"), "known_loc")
    by_distance = joined.groupBy("loc", "d").agg(
        F.min("known_loc").alias("alias_of"), F.min(F.struct("lat", "lng")).alias("_lo"),
        F.max(F.struct("lat", "lng")).alias("_hi"),
    )
    nearest = by_distance.groupBy("loc").agg(F.min_by(F.struct("alias_of", "_lo", "_hi"), "d").alias("_n"), F.min("d").alias("d"))
    return nearest.filter(F.col("_n._lo") == F.col("_n._hi")).select(
        "loc", F.col("_n.alias_of").alias("alias_of"), "d", F.col("_n._lo.lat").alias("lat"), F.col("_n._lo.lng").alias("lng")
    )


def typo_match(todo: DataFrame, cache: DataFrame) -> DataFrame:
    """Misspelt locations repaired from the cache alone."""
    return pick_typo(typo_edges(todo, cache.filter(F.col("lat").isNotNull())), cache)


def geocode(todo: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """First fallback query with a gazetteer hit in the expected country."""
    asked = todo.select("loc", country_of(F.col("loc")).alias("expected"), F.posexplode(fallback_queries(F.col("loc"))).alias("pos", "query"))
    hits = asked.join(gazetteer.select("query", "lat", "lng", "display", "country"), "query").filter(
        F.col("expected").isNull() | F.col("country").isNull() | accepts_country(F.col("expected"), F.col("country"))
    )
    best = hits.groupBy("loc").agg(
        F.min_by(F.struct("expected", "query", "lat", "lng", "display", "country"), "pos").alias("_h")
    )
    city = F.lower(tx.strip(F.element_at(F.split("loc", ","), 1)))
    return best.select(
        "loc", "_h.expected", F.col("_h.query").alias("matched_query"), "_h.lat", "_h.lng", "_h.display", "_h.country"
    ).withColumn("approx", ~F.lower("matched_query").contains(city))


def coordinate_key(lat: Column, lng: Column) -> Column:
    return F.concat_ws(",", lat.cast("string"), lng.cast("string"))


def check_country(found: DataFrame, reverse: DataFrame) -> DataFrame:
    """Second look: the country at the coordinate must agree with the one the address names."""
    rev = reverse.select(F.col("key").alias("_key"), F.col("country").alias("got"))
    keyed = found.withColumn("_key", coordinate_key(F.col("lat"), F.col("lng")))
    both = F.col("expected").isNotNull() & F.col("got").isNotNull()
    return (
        keyed.join(rev, "_key", "left").drop("_key")
        .withColumn("rejected", both & ~accepts_country(F.col("expected"), F.col("got")))
        .withColumn("verified", both & ~F.col("rejected"))
    )


def _repaired_in_order(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Locations of one component in the order of their keys: (loc, known_loc, d, lo_lat, lo_lng, hi_lat, hi_lng, new, lat, lng, approx).

    Of each location come its direct answer (no known_loc), the summary of its old neighbours per distance (lo and hi are the
    least and the greatest of their coordinates), and its new neighbours, which sort before it. Yields the repaired ones.
    """
    facts: dict[str, tuple | None] = {}
    for loc, own in groupby(rows, key=lambda r: r[0]):
        direct, near = None, []
        for _, known, d, lo_lat, lo_lng, hi_lat, hi_lng, new, lat, lng, approx in own:
            if known is None:
                direct = None if lat is None or approx else (lat, lng)
            elif not new:
                near.append((d, known, (lo_lat, lo_lng), (hi_lat, hi_lng)))
            elif facts.get(known):
                near.append((d, known, facts[known], facts[known]))
        least = min((d for d, *_ in near), default=None)
        near = [n for n in near if n[0] == least]
        facts[loc] = direct
        if near and min(n[2] for n in near) == max(n[3] for n in near):
            facts[loc] = near[0][2]
            yield loc, min(n[1] for n in near), *near[0][2]


def resolve_locations(
    todo: DataFrame, cache: DataFrame, gazetteer: DataFrame, reverse: DataFrame, most: int = COMPONENT_ROWS
) -> DataFrame:
    """Coordinates for new locations: typo repair first, gazetteer otherwise, failures as null rows.

    A location may be repaired from one that sorts before it and was itself just resolved, so the answer is that of a run in
    the order of keys. New locations that are near each other form components; those of at most ``most`` rows are settled in
    order by one task each. In larger ones a location is settled once all those before it are: each round touches only what
    is still open.
    """
    todo = cut_lineage(todo.select("loc").distinct())
    good = cache.filter(F.col("lat").isNotNull()).select("loc", "lat", "lng", "approx")
    checked = check_country(geocode(todo, gazetteer), reverse).filter(~F.col("rejected"))
    direct = cut_lineage(checked.select("loc", "lat", "lng", "approx", "verified", "matched_query", "display", "country"))
    found = direct.select("loc", "lat", "lng", F.coalesce("approx", F.lit(False)).alias("approx"))
    fresh = cut_lineage(typo_edges(todo, todo).filter(F.col("known_loc") < F.col("loc")))
    facts = good.filter(~F.coalesce(F.col("approx"), F.lit(False))).select(F.col("loc").alias("known_loc"), "lat", "lng")
    old = cut_lineage(
        typo_edges(todo, good).join(facts, "known_loc").groupBy("loc", "d").agg(
            F.min("known_loc").alias("known_loc"), F.min(F.struct("lat", "lng")).alias("lo"), F.max(F.struct("lat", "lng")).alias("hi"))
    )
    names = {n: F.col(c) for n, c in (("lo_lat", "lo.lat"), ("lo_lng", "lo.lng"), ("hi_lat", "hi.lat"), ("hi_lng", "hi.lng"))}
    parts = [
        old.select("loc", "known_loc", "d", *[c.alias(n) for n, c in names.items()], F.lit(False).alias("new")), fresh.withColumn("new", F.lit(True)),
        found.select("loc", "lat", "lng", "approx"),
    ]
    rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    # only locations with a neighbour can be repaired or repair another
    rows = rows.join(old.select("loc").union(fresh.select("loc")).union(fresh.select("known_loc")).distinct(), "loc", "left_semi")
    rows = rows.select("loc", "known_loc", "d", *names, "new", "lat", "lng", "approx")
    roots = components_of(fresh.select(F.col("loc").alias("u"), F.col("known_loc").alias("v")))
    small, giant = settled_in_order(
        rows, roots, "loc", ["loc", "known_loc", "new"], _repaired_in_order, "loc string, alias_of string, lat double, lng double", most
    )
    repaired = cut_lineage(small)
    giant = cut_lineage(giant)
    if not giant.isEmpty():
        repaired = repaired.unionAll(_repaired_by_rounds(giant))
    alone = todo.join(repaired.select("loc"), "loc", "left_anti").join(direct, "loc", "left")
    return repaired.withColumn("approx", F.lit(False)).unionByName(alone, allowMissingColumns=True).withColumn(
        "status",
        F.when(F.col("alias_of").isNotNull(), "alias").when(F.col("lat").isNotNull(), "located").otherwise("failed"),
    )


def _repaired_by_rounds(rows: DataFrame) -> DataFrame:
    """Repairs of rows as ``_repaired_in_order`` takes them: a location is settled when no location before it is open."""
    direct = rows.filter("known_loc is null").select("loc", "lat", "lng", "approx")
    near = rows.filter("known_loc is not null")
    open_ = cut_lineage(rows.select("loc").distinct())
    settled: list[DataFrame] = []
    repaired: list[DataFrame] = []
    while not open_.isEmpty():
        waiting = near.filter("new").join(open_.withColumnRenamed("loc", "known_loc"), "known_loc", "left_semi").select("loc").distinct()
        now = cut_lineage(open_.join(waiting, "loc", "left_anti"))
        ask = near.join(now, "loc", "left_semi")
        known = ask.filter("not new").select("loc", "known_loc", "d", F.struct("lo_lat", "lo_lng").alias("lo"), F.struct("hi_lat", "hi_lng").alias("hi"))
        if settled:
            state = reduce(DataFrame.unionAll, settled).select(F.col("loc").alias("known_loc"), F.struct(F.col("lat").alias("lo_lat"), F.col("lng").alias("lo_lng")).alias("lo"))
            state = state.withColumn("hi", F.struct(F.col("lo.lo_lat").alias("hi_lat"), F.col("lo.lo_lng").alias("hi_lng")))
            known = known.unionByName(ask.filter("new").select("loc", "known_loc", "d").join(state, "known_loc"))
        by_distance = known.groupBy("loc", "d").agg(F.min("known_loc").alias("alias_of"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        nearest = by_distance.groupBy("loc").agg(F.min_by(F.struct("alias_of", "lo", "hi"), "d").alias("n"))
        same = (F.col("n.lo.lo_lat") == F.col("n.hi.hi_lat")) & (F.col("n.lo.lo_lng") == F.col("n.hi.hi_lng"))
        done = cut_lineage(nearest.filter(same).select("loc", "n.alias_of", F.col("n.lo.lo_lat").alias("lat"), F.col("n.lo.lo_lng").alias("lng")))
        repaired.append(done)
        plain = direct.join(now, "loc", "left_semi").join(done.select("loc"), "loc", "left_anti").filter("lat is not null and not approx")
        settled.append(cut_lineage(done.select("loc", "lat", "lng").unionAll(plain.select("loc", "lat", "lng"))))
        open_ = cut_lineage(open_.join(now, "loc", "left_anti"))
    return reduce(DataFrame.unionAll, repaired)


def merge_cache(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """Append-only merge: located entries stay as they are, failed ones take the new try, new ones are added."""
    good = cache.filter(F.col("lat").isNotNull())
    newer = fresh.join(good.select("loc"), "loc", "left_anti")
    stale = cache.filter(F.col("lat").isNull()).join(newer.select("loc"), "loc", "left_anti")
    return good.unionByName(stale).unionByName(newer, allowMissingColumns=True)


def audit(cache: DataFrame, reverse: DataFrame) -> DataFrame:
    """Every located entry with ok, mismatch or unknown country."""
    found = cache.filter(F.col("lat").isNotNull()).withColumn("expected", country_of(F.col("loc")))
    rev = reverse.select(F.col("key").alias("_key"), F.col("country").alias("got"))
    joined = found.withColumn("_key", coordinate_key(F.col("lat"), F.col("lng"))).join(rev, "_key", "left").drop("_key")
    bad = F.col("got").isNotNull() & ~accepts_country(F.col("expected"), F.col("got"))
    return joined.withColumn(
        "status", F.when(F.col("expected").isNull(), "unknown").when(bad, "mismatch").otherwise("ok")
    )


def audit_counts(audited: DataFrame) -> DataFrame:
    return audited.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def unresolved(cache: DataFrame) -> DataFrame:
    return cache.filter(F.col("lat").isNull()).select("loc")


def changed_rows(old: DataFrame, new: DataFrame, buckets: int = 4096) -> DataFrame:
    """Rows whose number differs between two snapshots; empty means unchanged.

    Rows fall into buckets by their hash. A bucket's count and two sums of hashes don't depend on order; where both
    snapshots agree in them nothing has changed. Only rows of the other buckets are compared, by signed counts that combine
    before the shuffle: equal snapshots shuffle sums alone.
    """
    cols = new.columns
    both = old.select(*cols).withColumn("_n", F.lit(-1)).unionByName(new.withColumn("_n", F.lit(1)))
    # a null leaves a hash as it is, so which columns are null is hashed as well
    parts = [*[F.col(c) for c in cols], *[F.col(c).isNull() for c in cols]]
    both = both.withColumns({"_h": F.xxhash64(*parts), "_g": F.xxhash64(F.lit(1), *parts)}).withColumn("_bucket", F.pmod("_h", F.lit(buckets)))
    signed = [F.sum((F.col(h).cast("decimal(20,0)") * F.col("_n")).cast("decimal(38,0)")).alias(h) for h in ("_h", "_g")]
    sums = both.groupBy("_bucket").agg(F.sum("_n").alias("_n"), *signed)
    differing = sums.filter("_n <> 0 or _h <> 0 or _g <> 0").select("_bucket")  # a row for each bucket at most
    rest = both.join(F.broadcast(differing), "_bucket", "left_semi")
    return rest.groupBy(*cols).agg(F.sum("_n").alias("delta")).filter(F.col("delta") != 0)


def snapshot_changed(old: DataFrame, new: DataFrame) -> bool:
    return not changed_rows(old, new).isEmpty()
