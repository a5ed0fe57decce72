"""Advisory parsing and search over the page table, brought into the three known layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from shorelark.functions import text as tx
from shorelark.operators import findings as fd
from shorelark.plans.registry import query
from shorelark.plans.standins import standin, table
from shorelark.plans.text_queries import _SKIP, _nodots, _nodots_twice, sql_collapse, sql_strip
from shorelark.session import cut_lineage, scratch_path

IDS = "th[a-z]{1,3}tion"
LAYOUT = fd.Layout(identifier=IDS)

# a third of the pages per layout, made from the headings and paragraphs they have
VARIANT = """case page_id % 3 when 0 then replace(replace(html, '<b>', '<h3>'), '<br>', '</h3>')
  when 1 then replace(html, '<br>', '</b></p>')
  else replace(replace(replace(html, '<br>', '</b>'), '<p>', '<div>'), '</p>', '</div>') end"""


def pages(spark, sf):
    index = standin(spark, sf, "pages_index").withColumnRenamed("ord", "page_id").drop("url")
    rows = table(spark, sf, "pages").select("page_id", F.expr(VARIANT).alias("html")).join(index, "page_id")
    return rows.select(
        "page_id", "name", F.when(F.col("page_id") % 5 == 0, "macos").otherwise("ios").alias("os"), "date",
        tx_day().alias("day"), "html",
    )


def tx_day():
    from shorelark.functions import times as tm

    return tm.release_day(F.col("date"))


def parsed(spark, sf):
    return fd.parse_pages(pages(spark, sf), "html", LAYOUT)


def findings(spark, sf):
    return fd.flat_findings(parsed(spark, sf))


def _impact(body: str) -> str:
    t = sql_collapse(f"regexp_replace({body}, '<[^>]+>', ' ', 'g')")
    i = _nodots_twice(f"regexp_extract({t}, 'Impact:\\s*(.+?)(?:\\s*Description:|\\s*CVE-|\\s*Available for|\\s*Entry|\\s*$)', 1)")
    d = _nodots_twice(f"regexp_extract({t}, 'Description:\\s*(.+?)(?:\\s*CVE-|\\s*Entry|\\s*$)', 1)")
    s = _nodots(
        f"regexp_extract({t}, '(?:^|[.] )([A-Z][^.]*(?:may|could|might|can|able to|addressed|issue|vulnerability|problem|flaw)[^.]*)', 1)"
    )
    return f"case when {i} is null and {d} is null and {s} is not null then {s} else coalesce({i} || '. ' || {d}, {i}, {d}, 'Security issue addressed') end"


def _distinct(ids: str) -> str:
    return f"list_filter(list_transform(range(1, len({ids}) + 1), lambda k: case when list_position({ids}, {ids}[k]) = k then {ids}[k] end), lambda x: x is not null)"


def _sections(tag: str, text: str, pattern: str) -> str:
    """Blocks and headings of a layout as rows, each block with the last valid heading it can use."""
    return f"""
{tag}_s as (select page_id, string_split_regex(t, '{pattern}') as parts, regexp_extract_all(t, '{pattern}', 1) as heads from (select page_id, {text} as t from clean) x),
{tag}_h as (select page_id, {sql_strip('h')} as name, pos from (select page_id, unnest(heads) as h, unnest(range(1, len(heads) + 1)) as pos from {tag}_s) x),
{tag}_v as (select * from {tag}_h where not ({_SKIP})),
{tag}_b as (select *, lag(pos, 1, 0) over (partition by page_id order by pos) as prev from (select page_id, unnest(parts) as body, unnest(range(len(parts))) as pos from {tag}_s) x
  where pos > 0 and regexp_matches(body, '{IDS}')),
{tag} as (select b.page_id, b.pos, arg_max(v.name, v.pos) as component, {_impact('b.body')} as description, {_distinct('b.ids')} as cves
  from (select *, regexp_extract_all(body, '{IDS}') as ids from {tag}_b) b join {tag}_v v on v.page_id = b.page_id and v.pos <= b.pos and v.pos > b.prev group by b.page_id, b.pos, b.body, b.ids)"""


PARSE_SQL = f"""
clean as (select page_id, regexp_replace({VARIANT}, '(?s)<!--.*?-->', '', 'g') as html from pages),
{_sections('heading', "regexp_replace(regexp_replace(html, '<br\\s*/?>', chr(10), 'g'), '</?(?:span|div|a|em|i|u)[^>]*>', '', 'g')", '<(?:h3|strong)[^>]*>\\s*([^<]+?)\\s*</(?:h3|strong)>')},
{_sections('bold', 'html', '<(?:b|strong)>([^<]{2,60})</(?:b|strong)>')},
par_p as (select page_id, unnest(ps) as p, unnest(range(len(ps))) as pos from (select page_id, regexp_extract_all(html, '(?s)<p[^>]*>(.*?)</p>', 1) as ps from clean) x),
par_r as (select *, bold and not ({_SKIP}) as opens from (select page_id, pos, {sql_strip("regexp_replace(p, '<[^>]+>', '', 'g')")} as plain, regexp_matches(p, '<b>([^<]+)</b>') as bold,
  {sql_strip("regexp_extract(p, '<b>([^<]+)</b>', 1)")} as name from par_p) x),
par_g as (select *, sum(case when opens then 1 else 0 end) over (partition by page_id order by pos) as gid from par_r),
par_a as (select page_id, gid, min(pos) filter (where opens) as pos, min(name) filter (where opens) as component,
    {_nodots("arg_max(regexp_extract(plain, '^Impact:\\s*(.+)', 1), pos) filter (where not bold and regexp_matches(plain, '^Impact:\\s*.'))")} as i,
    {_nodots("arg_max(regexp_extract(plain, '^Description:\\s*(.+)', 1), pos) filter (where not bold and regexp_matches(plain, '^Description:\\s*.'))")} as d,
    flatten(list(regexp_extract_all(plain, '{IDS}') order by pos) filter (where not bold and not regexp_matches(plain, '^(Impact|Description):\\s*.'))) as ids
  from par_g where gid > 0 group by page_id, gid),
paragraph as (select page_id, pos, component, coalesce(i || '. ' || d, i, d, 'Security issue addressed') as description, {_distinct('ids')} as cves from par_a where len(ids) > 0),
every as (select 1 as pri, 'heading' as layout, * from heading union all select 2, 'paragraph', * from paragraph union all select 3, 'bold', * from bold),
found as (select page_id, layout, cast(row_number() over (partition by page_id order by pos) - 1 as int) as pos, component, description, cves
  from (select *, rank() over (partition by page_id order by pri) as rk from every) x where rk = 1),
info as (select ord as page_id, name, date, case when ord % 5 = 0 then 'macos' else 'ios' end as os, cast(2015 + ord % 9 as int) as year from pages_index),
findings as (select f.*, i.name, i.date, i.os, i.year from found f join info i using (page_id))
"""


def finding(name, body):
    return query(name, f"with {PARSE_SQL} {body}", ["pages_index"])


def _ids(c="cves"):
    return F.array_join(c, ",").alias("cves")


@finding("se06_layout_fallback", "select page_id, layout, pos, component, description, array_to_string(cves, ',') as cves from found")
def se06(spark, sf):
    return findings(spark, sf).select("page_id", "layout", "pos", "component", "description", _ids())


@finding("wn02_section_carry", "select 'heading' as layout, page_id, component, array_to_string(cves, ',') as cves from heading union all select 'bold', page_id, component, array_to_string(cves, ',') from bold")
def wn02(spark, sf):
    clean = pages(spark, sf).select("page_id", tx.strip_comments(F.col("html")).alias("html"))
    out = None
    for name, text, pattern in (("heading", fd.heading_text(F.col("html")), LAYOUT.heading), ("bold", F.col("html"), LAYOUT.bold)):
        rows = clean.select(F.lit(name).alias("layout"), "page_id", F.inline(fd.section_findings(text, pattern, IDS)))
        rows = rows.select("layout", "page_id", "component", _ids())
        out = rows if out is None else out.unionByName(rows)
    return out


@finding("wn03_paragraph_carry", "select page_id, component, description, array_to_string(cves, ',') as cves from paragraph")
def wn03(spark, sf):
    clean = pages(spark, sf).select("page_id", tx.strip_comments(F.col("html")).alias("html"))
    return clean.select("page_id", F.inline(fd.paragraph_findings(F.col("html"), LAYOUT))).select(
        "page_id", "component", "description", _ids()
    )


_TABLE = "replace(replace(html, '<li>', '<TR class=\"r\"><td>1</td><td>2</td><td a=\"b\">'), '</li>', '</td></tr>')"


@query(
    "io06_table_rows",
    f"""select page_id, cast(pos - 1 as int) as row_pos, cells[3] as third from (select page_id, pos, regexp_extract_all(r, '(?is)<td[^>]*>(.*?)</td>', 1) as cells from (
          select page_id, unnest(rows) as r, unnest(range(1, len(rows) + 1)) as pos from (select page_id, regexp_extract_all({_TABLE}, '(?is)<tr[^>]*>(.*?)</tr>', 1) as rows from pages) a) b) c where len(cells) >= 3""",
)
def io06(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", F.expr(_TABLE).alias("html"))
    return fd.table_rows(rows, "html", 3).select("page_id", "row_pos", F.get("cells", 2).alias("third"))


@query(
    "io06_release_index",
    """select ord, n as name, date, 'https://support.example.org/k/' || cast(ord as varchar) as url, os, strftime(strptime(date, '%d %b %Y'), '%Y-%m-%d') as day
       from (select *, replace(name, ' and iPadOS', ' / iPadOS') as n, 'ios' as os from pages_index where ord % 4 <> 0 and ord % 7 <> 0) x""",
    ["pages_index"],
)
def io06_index(spark, sf):
    rows = standin(spark, sf, "pages_index")
    label = F.when(F.col("ord") % 7 == 0, F.concat(F.lit("tvOS "), "name")).otherwise(F.col("name"))
    link = F.when(F.col("ord") % 4 == 0, label).otherwise(
        F.concat(F.lit('<a href="/k/'), F.col("ord").cast("string"), F.lit('"><b>'), label, F.lit("</b></a>"))
    )
    html = F.concat(F.lit("<table><tr><th>x</th></tr><tr><td>"), link, F.lit("</td><td>all</td><td>"), F.col("date"), F.lit("&nbsp;</td></tr></table>"))
    index = fd.release_index(rows.select("ord", html.alias("html")), "html", "https://support.example.org")
    return index.select("ord", "name", "date", "url", "os", F.col("day").cast("string").alias("day"))


@query(
    "io06_schedule_rows",
    """select cid, course, strftime(iso, '%Y-%m-%d') as iso, location, instructor, cast(length(instructor) as varchar) as instructor_id
       from (select cid, course, iso, p as location, coalesce(instructor, 'Ann-Marie O''Neil') as instructor from (select *, replace(location, '   ', ' ') as p from classes) x) y""",
    ["classes"],
)
def io06_schedule(spark, sf):
    c = standin(spark, sf, "classes")
    who = F.coalesce("instructor", F.lit("Ann-Marie O'Neil"))
    date = F.coalesce(F.date_format("iso", "MMMM d, yyyy"), F.lit("to be set"))
    html = F.concat(
        F.lit('<tr><td><a href="/class-details?cid='), "cid", F.lit('">'), "course", F.lit("</a></td><td>Sat "), date,
        F.lit(" </td><td>"), "location", F.lit('</td><td><a href="/i?id='), F.length(who).cast("string"), F.lit('">'), F.upper(who), F.lit("</a></td></tr>"),
    )
    rows = fd.schedule_rows(c.select(html.alias("html")), "html")
    return rows.select("cid", "course", F.col("iso").cast("string").alias("iso"), "location", "instructor", "instructor_id")


@query(
    "jn01_new_releases",
    """select name, ord, url from (select name, ord, url, row_number() over (partition by name order by ord) as rn from pages_index) x where rn = 1 and name not in (select name from pages_index where ord % 40 < 15)""",
    ["pages_index"],
)
def jn01(spark, sf):
    index = standin(spark, sf, "pages_index")
    return fd.new_releases(index, index.filter(F.col("ord") % 40 < 15), "ord").select("name", "ord", "url")


@finding("jn12_shared_ids", "select cve, name, count(*) over (partition by cve) - 1 as others from (select distinct name, unnest(cves) as cve from findings) x")
def jn12(spark, sf):
    return fd.shared_ids(findings(spark, sf))


@finding("ag15_release_totals", "select name, cast(sum(len(cves)) as bigint) as ids, count(*) as findings from findings group by name")
def ag15(spark, sf):
    return fd.release_totals(findings(spark, sf))


@finding("ag16_top_components", "select component, count(*) as n from findings group by 1 order by n desc, component limit 15")
def ag16(spark, sf):
    return fd.top_components(findings(spark, sf), 15)


@finding("ag16_components", "select distinct component from findings")
def ag16_all(spark, sf):
    return fd.components(findings(spark, sf))


@finding(
    "fl09_search",
    """select page_id, pos, component, 'text' as kind from findings where contains(lower(component), 'thation') or contains(lower(description), 'thation') or len(list_filter(cves, lambda c: contains(c, 'thation'))) > 0
       union all select page_id, pos, component, 'facet' from findings where os = 'ios' and year = 2018 and contains(name, 'iOS 1')
       union all select page_id, pos, component, 'family' from findings where (starts_with(component, 'The') or starts_with(component, 'Of')) and os = 'macos'""",
)
def fl09(spark, sf):
    rows = findings(spark, sf)
    picks = [
        ("text", fd.search(rows, " Thation")), ("facet", fd.search(rows, os="ios", version="iOS 1", year=2018)),
        ("family", fd.search(rows, os="macos", families=["The", "Of"])),
    ]
    out = None
    for kind, df in picks:
        df = df.select("page_id", "pos", "component", F.lit(kind).alias("kind"))
        out = df if out is None else out.unionByName(df)
    return out


@finding(
    "so07_finding_order",
    """select page_id, pos, row_number() over (order by component desc nulls last, name nulls first, pos, page_id) as by_component,
         row_number() over (order by name nulls first, pos, page_id) as by_name from findings""",
)
def so07(spark, sf):
    rows = cut_lineage(findings(spark, sf).select("page_id", "pos", "component", "name"))
    one = fd.finding_places(rows, "component", "page_id", descending=True, out="by_component").select("page_id", "pos", "by_component")
    two = fd.finding_places(rows, "name", "page_id", out="by_name").select("page_id", "pos", "by_name")
    return one.join(two, ["page_id", "pos"])


@finding("io09_append_blocks", "select page_id, -page_id as append_ord, len(list(component)) as findings, '2024-01-31T00:00:00Z' as updated from findings group by page_id")
def io09(spark, sf):
    path = scratch_path(spark, "advisories")
    rows = fd.append_blocks(parsed(spark, sf), "page_id", "2024-01-31T00:00:00Z").select(
        "page_id", "append_ord", F.size("findings").cast("bigint").alias("findings"), "updated"
    )
    fd.append_to(rows, path)
    fd.append_to(rows.filter("page_id < 0"), path)  # nothing new, nothing written
    return spark.read.parquet(path)


@finding(
    "io10_release_blocks",
    f"""select page_id, to_json({{'r': any_value(name), 'os': any_value(os), 'd': any_value(date), 'v': list({{'c': {sql_collapse('component')}, 'desc': {sql_collapse('description')}, 'cve': cves}} order by pos)}})::varchar as block
        from findings group by page_id""",
)
def io10(spark, sf):
    return fd.serialised(parsed(spark, sf), "page_id")
