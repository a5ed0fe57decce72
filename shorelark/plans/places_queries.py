"""Place operators over line items as classes and parts as locations."""

from __future__ import annotations

from pyspark.sql import functions as F

from shorelark.functions import conditions as fx
from shorelark.functions import text as tx
from shorelark.operators import places as pl
from shorelark.plans.registry import query
from shorelark.plans.standins import standin, table

TODAY = "1998-06-01"
CANON = "lower(trim(regexp_replace({0}, '\\s+', ' ', 'g')))"

FAMILY = """case when course = 'CCR Cave' then 'Cave' when course in ('Scientific Diver') then 'Specialty' when course in ('Open Water Diver', 'Acme Performance Diver') then 'Recreational' when course = 'ITC Acme Fundamentals' then 'Instructor Training'
  when contains(lower(course), 'ccr') or contains(lower(course), 'pscr') then 'CCR' when contains(lower(course), 'cave') then 'Cave'
  when contains(lower(course), 'technical diver') or contains(lower(course), 'tech ') then 'Technical'
  when contains(lower(course), 'fundamentals') then 'Fundamentals' when contains(lower(course), 'primer') then 'Primers'
  when contains(lower(course), 'itc') or contains(lower(course), 'instructor') or contains(lower(course), 'apprentice') then 'Instructor Training'
  when contains(lower(course), 'first aid') or contains(lower(course), 'bls') or contains(lower(course), 'oxygen') then 'First Aid' else 'Specialty' end"""

PLACED_SQL = f"""
placed as (select c.*, {FAMILY} as family, {CANON.format('location')} as cloc, k.lat, k.lng, k.lat is not null as placed
  from classes c left join lookup k on k.loc = {CANON.format('location')})
"""


def classes(spark, sf):
    return standin(spark, sf, "classes").withColumn("family", pl.course_family(F.col("course"), "Acme"))


def all_classes(spark, sf):
    return pl.with_coordinates(classes(spark, sf), standin(spark, sf, "lookup"))


def placed(spark, sf):
    return all_classes(spark, sf).filter("placed")


def places(name, body):
    return query(name, f"with {PLACED_SQL} {body}", ["classes", "lookup"])


def iso(c="iso"):
    return F.col(c).cast("string").alias(c)


@places("sc34_course_family", "select ord, course, family from placed")
def sc34(spark, sf):
    return classes(spark, sf).select("ord", "course", "family")


_C2 = "case lower(trim(list_last(string_split({0}, ',')))) " + " ".join(f"when '{k}' then '{v}'" for k, v in pl.COUNTRIES.items()) + " end"


@query("sc35_address_country", f"select ord, loc, {_C2.format('loc')} as country from geo_cache", ["geo_cache"])
def sc35(spark, sf):
    return standin(spark, sf, "geo_cache").select("ord", "loc", pl.country_of(F.col("loc")).alias("country"))


@query(
    "sc36_fallback_queries",
    """select ord, q, cast(i - 1 as int) as pos from (select ord, l, unnest(l) as q, unnest(range(1, len(l) + 1)) as i
         from (select ord, list_filter(list_transform(range(1, len(a) + 1), lambda i: case when list_position(a, a[i]) = i then a[i] end), lambda x: x is not null) as l
           from (select ord, case when len(p) >= 3 then [loc, p[1] || ', ' || p[-1], p[-2] || ', ' || p[-1], p[1], p[-1]] when len(p) = 2 then [loc, p[1], p[-1]] else [loc] end as a
             from (select ord, loc, list_filter(list_transform(string_split(loc, ','), lambda s: trim(s)), lambda s: s <> '') as p
               from (select ord, case ord % 3 when 0 then loc when 1 then regexp_extract(loc, '^[^,]*, ([^,]*), ', 1) else regexp_extract(loc, '^(.*), [^,]*$', 1) || ',' end as loc from geo_cache) v) w) x) y) z""",
    ["geo_cache"],
)
def sc36(spark, sf):
    k = F.col("ord") % 3
    loc = (
        F.when(k == 0, F.col("loc")).when(k == 1, F.regexp_extract("loc", "^[^,]*, ([^,]*), ", 1))
        .otherwise(F.concat(F.regexp_extract("loc", "^(.*), [^,]*$", 1), F.lit(",")))
    )
    return standin(spark, sf, "geo_cache").select("ord", F.posexplode(pl.fallback_queries(loc)).alias("pos", "q"))


@places("sc51_count_size", "select lat, lng, count(*) as n, case when count(*) < 10 then 'small' when count(*) < 100 then 'medium' else 'large' end as size from placed where placed group by lat, lng")
def sc51(spark, sf):
    return pl.place_summary(placed(spark, sf)).select("lat", "lng", "n", fx.count_size(F.col("n")).alias("size"))


@query(
    "io08_lookup_export",
    f"""select loc, lat, lng from (select {CANON.format('loc')} as loc, round(lat, 5) as lat, round(lng, 5) as lng,
          row_number() over (partition by {CANON.format('loc')} order by ord desc) as rn from geo_cache where lat is not null) x where rn = 1""",
    ["geo_cache"],
)
def io08(spark, sf):
    return pl.export_lookup(standin(spark, sf, "geo_cache"), "ord")


@query(
    "io11_overlay",
    """select coalesce(l.loc, b.loc) as loc, case when l.loc is not null then l.lat else b.lat end as lat, case when l.loc is not null then l.lng else b.lng end as lng
       from lookup b full join (select loc || case when lng > 100 then ' new' else '' end as loc, lat + 1 as lat, lng from lookup where lng > 0) l on l.loc = b.loc""",
    ["lookup"],
)
def io11(spark, sf):
    bundled = standin(spark, sf, "lookup")
    learned = bundled.filter("lng > 0").select(
        F.concat("loc", F.when(F.col("lng") > 100, " new").otherwise("")).alias("loc"), (F.col("lat") + 1).alias("lat"), "lng"
    )
    return pl.overlay(bundled, learned)


# the chosen instructors: every third one of the first thousand
CHOSEN = [f"Supplier#{i:09d}" for i in range(1, 1000, 3)]
_FILTER = """course in ('Cave Diver 3', 'Deep Primer', 'Tech Clinic')
  and (instructor is null or (cast(right(instructor, 9) as int) % 3 = 1 and cast(right(instructor, 9) as int) < 1000))
  and contains(lower(course || ' ' || location || ' ' || coalesce(instructor, '')), 'ring') and (iso is null or iso >= date '1997-01-01') and (iso is null or iso <= date '1999-06-30')"""


@places("fl04_class_filter", f"select ord, course, location, instructor, strftime(iso, '%Y-%m-%d') as iso from placed where {_FILTER}")
def fl04(spark, sf):
    return pl.filter_classes(
        classes(spark, sf), ["Cave Diver 3", "Deep Primer", "Tech Clinic"], CHOSEN, "Ring", "1997-01-01", "1999-06-30"
    ).select("ord", "course", "location", "instructor", iso())


@places("fl05_current_classes", f"select ord, strftime(iso, '%Y-%m-%d') as iso from placed where iso is null or iso >= date '{TODAY}'")
def fl05(spark, sf):
    return pl.current_classes(classes(spark, sf), TODAY).select("ord", iso())


@places("fl07_instructor_search", "select instructor, count(*) as n from placed where placed and contains(lower(instructor), '00004') group by 1")
def fl07(spark, sf):
    return pl.find_instructors(pl.instructor_counts(placed(spark, sf)), "00004 ")


@query(
    "jn02_missing_locations",
    f"""select loc from (select distinct lower(p_name || ', ' || p_brand) as loc from part) x where loc not in (select loc from lookup where lng < 100 and lat is not null)""",
    ["lookup"],
)
def jn02(spark, sf):
    locs = table(spark, sf, "part").select(F.lower(F.concat("p_name", F.lit(", "), "p_brand")).alias("loc")).distinct()
    cache = standin(spark, sf, "lookup").withColumn("lat", F.when(F.col("lng") < 100, F.col("lat")))
    return pl.missing_locations(locs, cache)


@places("jn05_class_coordinates", "select ord, location, lat, lng, placed from placed")
def jn05(spark, sf):
    return all_classes(spark, sf).select("ord", "location", "lat", "lng", "placed")


@places("jn14_world_copies", "select lat, lng, n, o as \"offset\", lng + o as copy_lng from (select lat, lng, count(*) as n from placed where placed group by all) x, (values (0), (360), (720)) v(o)")
def jn14(spark, sf):
    points = pl.place_summary(placed(spark, sf)).select("lat", "lng", "n")
    return pl.world_copies(points, 300.0)


@places("ag05_classes_per_place", "select lat, lng, count(*) as n, strftime(min(iso), '%Y-%m-%d') as first_iso, strftime(max(iso), '%Y-%m-%d') as last_iso from placed where placed group by lat, lng")
def ag05(spark, sf):
    return pl.place_summary(placed(spark, sf)).select("lat", "lng", "n", iso("first_iso"), iso("last_iso"))


@places("ag06_family_facets", "select family, course, count(*) as n from placed where placed group by grouping sets ((family, course), (family))")
def ag06(spark, sf):
    return pl.family_facets(placed(spark, sf))


@places("ag07_instructor_counts", "select instructor, count(*) as n from placed where placed and instructor is not null group by 1")
def ag07(spark, sf):
    return pl.instructor_counts(placed(spark, sf))


@places(
    "ag08_dominant_family",
    """select lat, lng, family, n from (select *, row_number() over (partition by lat, lng order by n desc, f) as rn
         from (select lat, lng, family, count(*) as n, min(ord) as f from placed where placed group by lat, lng, family) x) y where rn = 1""",
)
def ag08(spark, sf):
    return pl.dominant_family(placed(spark, sf), "ord")


_ACTIVE = ["Cave Diver 1", "Cave Diver 2", "Tech Clinic", "Deep Primer", "First Aid Instructor"]


@places(
    "ag09_selection_state",
    f"""select family, courses, on_n as "on", case when on_n = 0 then 'off' when on_n < courses then 'partial' else 'all' end as state
        from (select family, count(*) as courses, count(*) filter (where course in ({', '.join(f"'{a}'" for a in _ACTIVE)})) as on_n
          from (select distinct family, course from placed where placed) x group by family) y""",
)
def ag09(spark, sf):
    return pl.selection_state(placed(spark, sf), _ACTIVE)


@places(
    "ag10_cell_totals",
    "select cast(floor(lat / 7.5) as bigint) as cell_lat, cast(floor(lng / 7.5) as bigint) as cell_lng, cast(sum(n) as bigint) as n, count(*) as places from (select lat, lng, count(*) as n from placed where placed group by all) x group by 1, 2",
)
def ag10(spark, sf):
    return pl.cell_totals(pl.place_summary(placed(spark, sf)), 7.5)


@places(
    "ag11_date_bounds",
    f"select strftime(min(iso), '%Y-%m-%d') as min_iso, strftime(max(iso), '%Y-%m-%d') as max_iso, strftime(greatest(min(iso), least(date '{TODAY}', max(iso))), '%Y-%m-%d') as from_iso from placed",
)
def ag11(spark, sf):
    return pl.date_bounds(classes(spark, sf), TODAY).select(iso("min_iso"), iso("max_iso"), iso("from_iso"))


@places(
    "ag12_padded_bounds",
    """select round(min(lat) - 0.12e0 * (max(lat) - min(lat)), 6) as south, round(min(lng) - 0.12e0 * (max(lng) - min(lng)), 6) as west,
         round(max(lat) + 0.12e0 * (max(lat) - min(lat)), 6) as north, round(max(lng) + 0.12e0 * (max(lng) - min(lng)), 6) as east from placed where placed""",
)
def ag12(spark, sf):
    box = pl.padded_bounds(pl.place_summary(placed(spark, sf)))
    return box.select(*[F.round(c, 6).alias(c) for c in box.columns])


@places(
    "ag13_unplaced",
    "select count(distinct cloc) as locations, count(*) filter (where not placed) as unplaced_classes, count(distinct case when not placed then location end) as unplaced_spellings from placed",
)
def ag13(spark, sf):
    return pl.unplaced_summary(all_classes(spark, sf))


@places(
    "ag13_lookup_queue",
    "select loc, ord, location from (select cloc as loc, ord, location, row_number() over (partition by cloc order by ord) as rn from placed where not placed) x where rn = 1",
)
def ag13_queue(spark, sf):
    return pl.lookup_queue(all_classes(spark, sf), "ord").select("loc", "ord", "location")


@places(
    "dd06_first_spelling",
    "select loc, location, ord from (select cloc as loc, location, ord, row_number() over (partition by cloc order by ord) as rn from placed) x where rn = 1",
)
def dd06(spark, sf):
    return pl.first_spelling(classes(spark, sf), "location", "ord").select("loc", "location", "ord")


@places(
    "so03_class_order",
    """select ord, strftime(iso, '%Y-%m-%d') as iso, course, location, instructor,
         row_number() over (order by iso nulls last, course, location, instructor nulls first, ord) as place from placed""",
)
def so03(spark, sf):
    return pl.class_places(classes(spark, sf), "ord").select("ord", iso(), "course", "location", "instructor", "place")


@places(
    "so06_natural_order",
    r"""select course, n, regexp_extract(c, '^[^0-9]*', 0) || case when regexp_matches(c, '[0-9]') then lpad(cast(length(regexp_extract(c, '0*([0-9]+)', 1)) as varchar), 6, '0') || regexp_extract(c, '0*([0-9]+)', 1) else '' end
          || regexp_extract(c, '^[^0-9]*[0-9]+(.*)$', 1) as sort_key
        from (select course, lower(course) as c, count(*) as n from placed group by course) x""",
)
def so06(spark, sf):
    counts = classes(spark, sf).groupBy("course").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("sort_key", pl.natural_key(F.col("course"))).orderBy("sort_key")


# ---- resolving ------------------------------------------------------------

CACHE_SQL = """
cache as (select loc, lat, lng, approx from (select lower(loc) as loc, lat, lng, approx, row_number() over (partition by lower(loc) order by ord) as rn from geo_cache) x where rn = 1),
todo as (select distinct loc from (select case ord % 5 when 0 then substr(loc, 2) when 1 then substr(loc, 1, 3) || substr(loc, 5)
    when 2 then substr(loc, 1, 2) || 'x' || substr(loc, 3) when 3 then substr(loc, 1, 1) || 'qq' || substr(loc, 4) else loc || ' zone' end as loc, ord
  from (select lower(loc) as loc, min(ord) as ord from geo_cache group by 1) y) z)
"""
CITY = "trim(string_split({0}, ',')[1])"
TAIL = "array_to_string(list_transform(string_split({0}, ',')[2:], lambda s: trim(s)), ', ')"


def cache(spark, sf):
    from shorelark.operators.scale import first_by

    rows = standin(spark, sf, "geo_cache").withColumn("loc", F.lower("loc"))
    return first_by(rows, ["loc"], ["ord"]).drop("ord")


def todo(spark, sf):
    loc, k = F.col("loc"), F.col("ord") % 5
    rows = standin(spark, sf, "geo_cache").groupBy(F.lower("loc").alias("loc")).agg(F.min("ord").alias("ord"))
    wrong = (
        F.when(k == 0, F.substr(loc, F.lit(2))).when(k == 1, F.concat(F.substring(loc, 1, 3), F.substr(loc, F.lit(5))))
        .when(k == 2, F.concat(F.substring(loc, 1, 2), F.lit("x"), F.substr(loc, F.lit(3))))
        .when(k == 3, F.concat(F.substring(loc, 1, 1), F.lit("qq"), F.substr(loc, F.lit(4)))).otherwise(F.concat(loc, F.lit(" zone")))
    )
    return rows.select(wrong.alias("loc")).distinct()


@query(
    "jn09_typo_match",
    f"""with {CACHE_SQL},
        t as (select loc, {CITY.format('loc')} as city, {TAIL.format('loc')} as tail from todo where length({CITY.format('loc')}) >= 5 and contains(loc, ',')),
        k as (select loc, {CITY.format('loc')} as city, {TAIL.format('loc')} as tail, lat, lng from cache where lat is not null and not approx and contains(loc, ',')),
        pairs as (select t.loc, k.loc as known, levenshtein(t.city, k.city) as d, k.lat, k.lng, case when length(t.city) <= 8 then 1 else 2 end as maxd
          from t join k on t.tail = k.tail and t.city <> k.city and t.loc <> k.loc),
        near as (select * from (select *, min(d) over (partition by loc) as m from pairs where d <= maxd) x where d = m)
      select loc, min(known) as alias_of, cast(min(d) as int) as d, min(lat) as lat, min(lng) as lng from near group by loc having count(distinct (lat, lng)) = 1""",
    ["geo_cache"],
)
def jn09(spark, sf):
    return pl.typo_match(todo(spark, sf), cache(spark, sf)).select("loc", "alias_of", "d", "lat", "lng")


GAZ_SQL = """
gaz as (select q as query, cast(40 + n_nationkey as double) / 8 as lat, cast(n_nationkey as double) * 2 as lng, 'Found ' || q as display, c as country
  from (select n_nationkey, lower('brand#' || cast(n_nationkey as varchar)) || ', germany' as q, case when n_nationkey % 4 = 0 then 'fr' else 'de' end as c from nation
        union all select n_nationkey, 'brand#' || cast(n_nationkey as varchar) || ', bonaire', case when n_nationkey % 3 = 0 then 'ni' else 'nl' end from nation
        union all select 90, 'germany', 'de' union all select 91, 'japan', null union all select 92, 'atlantis', 'zz' union all select 93, 'bonaire', 'bq') x)
"""


def gazetteer(spark, sf):
    nation = table(spark, sf, "nation").select("n_nationkey")
    k = F.col("n_nationkey")
    brand = F.concat(F.lit("brand#"), k.cast("string"))
    german = nation.select(k, F.concat(brand, F.lit(", germany")).alias("query"), F.when(k % 4 == 0, "fr").otherwise("de").alias("country"))
    bonaire = nation.select(k, F.concat(brand, F.lit(", bonaire")).alias("query"), F.when(k % 3 == 0, "ni").otherwise("nl").alias("country"))
    tails = spark.createDataFrame(
        [(90, "germany", "de"), (91, "japan", None), (92, "atlantis", "zz"), (93, "bonaire", "bq")], "n_nationkey int, query string, country string"
    )
    return german.unionByName(bonaire).unionByName(tails).select(
        "query", ((40 + k).cast("double") / 8).alias("lat"), (k.cast("double") * 2).alias("lng"), F.concat(F.lit("Found "), "query").alias("display"), "country"
    )


_OK = "(expected is null or g.country is null or g.country = expected or (expected in ('bq', 'nl') and g.country in ('bq', 'nl')))"
GEOCODE_SQL = f"""
asked as (select loc, expected, unnest(a) as query, unnest(range(len(a))) as pos from (select loc, {_C2.format('loc')} as expected,
  case when len(p) >= 3 then [loc, p[1] || ', ' || p[-1], p[-2] || ', ' || p[-1], p[1], p[-1]] when len(p) = 2 then [loc, p[1], p[-1]] else [loc] end as a
  from (select loc, list_filter(list_transform(string_split(loc, ','), lambda s: trim(s)), lambda s: s <> '') as p from todo) x) y),
found as (select loc, expected, query as matched_query, lat, lng, country, not contains(query, {CITY.format('loc')}) as approx from (
  select a.*, g.lat, g.lng, g.country, row_number() over (partition by loc order by pos) as rn from asked a join gaz g on g.query = a.query where {_OK}) z where rn = 1)
"""


@query(
    "jn10_gazetteer",
    f"with {CACHE_SQL}, {GAZ_SQL}, {GEOCODE_SQL} select loc, expected, matched_query, lat, lng, country, approx from found", ["geo_cache"],
)
def jn10(spark, sf):
    return pl.geocode(todo(spark, sf), gazetteer(spark, sf)).drop("display")


REVERSE_SQL = """
reverse as (select cast(cast(40 + k as double) / 8 as varchar) || ',' || cast(cast(k as double) * 2 as varchar) as key,
  case when k % 5 = 0 then null when k % 7 = 0 then 'xx' when k = 93 then 'nl' else 'de' end as country
  from (select n_nationkey as k from nation union all select unnest([90, 91, 93])) x)
"""


def reverse_cache(spark, sf):
    k = F.col("n_nationkey")
    rows = table(spark, sf, "nation").select("n_nationkey").unionByName(spark.createDataFrame([(90,), (91,), (93,)], "n_nationkey int"))
    return rows.select(
        pl.coordinate_key((40 + k).cast("double") / 8, k.cast("double") * 2).alias("key"),
        F.when(k % 5 == 0, F.lit(None)).when(k % 7 == 0, "xx").when(k == 93, "nl").otherwise("de").alias("country"),
    )


@query(
    "jn11_country_check",
    f"""with {CACHE_SQL}, {GAZ_SQL}, {GEOCODE_SQL}, {REVERSE_SQL}
        select loc, expected, got, coalesce(expected is not null and got is not null and not (got = expected or (expected in ('bq', 'nl') and got in ('bq', 'nl'))), false) as rejected,
          coalesce(expected is not null and got is not null and (got = expected or (expected in ('bq', 'nl') and got in ('bq', 'nl'))), false) as verified
        from (select f.loc, f.expected, r.country as got from found f left join reverse r on r.key = cast(f.lat as varchar) || ',' || cast(f.lng as varchar)) x""",
    ["geo_cache"],
)
def jn11(spark, sf):
    found = pl.geocode(todo(spark, sf), gazetteer(spark, sf))
    return pl.check_country(found, reverse_cache(spark, sf)).select("loc", "expected", "got", "rejected", "verified")


_ROUNDS = 12  # of the SQL, which derives every repair again from the round before; more than any chain of repairs here has

RESOLVE_SQL = f"""
with recursive {CACHE_SQL}, {GAZ_SQL}, {GEOCODE_SQL}, {REVERSE_SQL},
  direct as (select f.loc, f.lat, f.lng, f.approx from found f left join reverse r on r.key = cast(f.lat as varchar) || ',' || cast(f.lng as varchar)
    where not coalesce(expected is not null and r.country is not null and not (r.country = expected or (expected in ('bq', 'nl') and r.country in ('bq', 'nl'))), false)),
  t as (select loc, {CITY.format('loc')} as city, {TAIL.format('loc')} as tail from todo where length({CITY.format('loc')}) >= 5 and contains(loc, ',')),
  k as (select loc, lat, lng, false as new, {CITY.format('loc')} as city, {TAIL.format('loc')} as tail from cache where lat is not null and not approx and contains(loc, ',')
    union all select loc, null, null, true, {CITY.format('loc')}, {TAIL.format('loc')} from todo where contains(loc, ',')),
  edges as (select * from (select t.loc, k.loc as known, k.lat, k.lng, k.new, levenshtein(t.city, k.city) as d, case when length(t.city) <= 8 then 1 else 2 end as most
    from t join k on t.tail = k.tail and t.city <> k.city and (not k.new or k.loc < t.loc)) x where d <= most),
  asks as (
    select loc, case when new then known else loc end as via, known as alias_of, d, lat, lng, new, false as own, false as approx from edges
    union all select t.loc, t.loc, null, 99, d.lat, d.lng, false, true, d.approx from todo t left join direct d on t.loc = d.loc),
  state(k, loc, alias_of, lat, lng, approx) as (
    select 0, loc, null::varchar, lat, lng, approx from asks where own
    union all
    select any_value(k) + 1, loc, case when count(distinct (lat, lng)) filter (where near) = 1 then min(alias_of) filter (where near) end,
      case when count(distinct (lat, lng)) filter (where near) = 1 then min(lat) filter (where near) else min(lat) filter (where own) end,
      case when count(distinct (lat, lng)) filter (where near) = 1 then min(lng) filter (where near) else min(lng) filter (where own) end,
      case when count(distinct (lat, lng)) filter (where near) = 1 then false else bool_or(approx) filter (where own) end
    from (select *, not own and d = min(d) filter (where not own) over (partition by loc) as near from (
      select s.k, a.loc, a.alias_of, a.d, case when a.new then s.lat else a.lat end as lat, case when a.new then s.lng else a.lng end as lng, a.own, a.approx
      from asks a join state s on s.loc = a.via where s.k < {_ROUNDS} and (not a.new or (s.lat is not null and not s.approx))) x) y
    group by loc)
select loc, case when alias_of is not null then 'alias' when lat is not null then 'located' else 'failed' end as status, alias_of, lat, lng, approx
from state where k = {_ROUNDS}
"""


@query("jn09_resolve_locations", RESOLVE_SQL, ["geo_cache"])
def resolve(spark, sf):
    return pl.resolve_locations(todo(spark, sf), cache(spark, sf), gazetteer(spark, sf), reverse_cache(spark, sf)).select(
        "loc", "status", "alias_of", "lat", "lng", "approx"
    )


_AUDIT = """
with rev as (select cast(lat as varchar) || ',' || cast(lng as varchar) as key, case when ord % 4 = 0 then 'de' when ord % 4 = 1 then 'nl' when ord % 4 = 2 then 'us' end as got
    from geo_cache where lat is not null and ord % 3 = 0),
  judged as (select g.loc, {c2} as expected, got from geo_cache g left join rev on key = cast(lat as varchar) || ',' || cast(lng as varchar) where lat is not null),
  status as (select *, case when expected is null then 'unknown' when got is not null and not (got = expected or (expected in ('bq', 'nl') and got in ('bq', 'nl'))) then 'mismatch' else 'ok' end as status from judged)
""".replace("{c2}", _C2.format("g.loc"))


def audited(spark, sf):
    rows = standin(spark, sf, "geo_cache")
    k = F.col("ord") % 4
    rev = rows.filter(F.col("lat").isNotNull() & (F.col("ord") % 3 == 0)).select(
        pl.coordinate_key(F.col("lat"), F.col("lng")).alias("key"), F.when(k == 0, "de").when(k == 1, "nl").when(k == 2, "us").alias("country")
    )
    return pl.audit(rows, rev)


@query("ag14_coordinate_audit", _AUDIT + "select status, count(*) as n from status group by 1", ["geo_cache"])
def ag14(spark, sf):
    return pl.audit_counts(audited(spark, sf))


@query("ag14_mismatches", _AUDIT + "select loc, expected, got from status where status = 'mismatch'", ["geo_cache"])
def ag14_list(spark, sf):
    return audited(spark, sf).filter("status = 'mismatch'").select("loc", "expected", "got")


@query("ag14_unresolved", "select loc from geo_cache where lat is null", ["geo_cache"])
def ag14_unresolved(spark, sf):
    return pl.unresolved(standin(spark, sf, "geo_cache"))


@places(
    "se01_changed_rows",
    """select course, location, cast(sum(d) as bigint) as delta from (select course, location, 1 as d from placed where iso >= date '1996-01-01' or iso is null
       union all select course, location, -1 from placed where iso < date '1997-01-01' or iso is null) x group by all having sum(d) <> 0""",
)
def se01(spark, sf):
    rows = classes(spark, sf)
    old = rows.filter("iso < date'1997-01-01' or iso is null").select("course", "location")
    return pl.changed_rows(old, rows.filter("iso >= date'1996-01-01' or iso is null").select("course", "location"))


@query(
    "se02_merge_cache",
    """with cache as (select loc, case when lng > 50 then null else lat end as lat, lng from lookup where lng < 100),
         fresh as (select loc, lat + 5 as lat, lng from lookup where lng > -50)
       select loc, lat, lng from cache where lat is not null union all
       select loc, lat, lng from cache where lat is null and loc not in (select loc from fresh) union all
       select loc, lat, lng from fresh where loc not in (select loc from cache where lat is not null)""",
    ["lookup"],
)
def se02(spark, sf):
    rows = standin(spark, sf, "lookup")
    known = rows.filter("lng < 100").select("loc", F.when(F.col("lng") <= 50, F.col("lat")).alias("lat"), "lng")
    return pl.merge_cache(known, rows.filter("lng > -50").select("loc", (F.col("lat") + 5).alias("lat"), "lng"))
