"""Advisories: release index, page layouts, search and facets.

A page is parsed inside its own row (split, filter and transform over arrays), so no page text is
ever shuffled and a release that occurs in many copies never gathers in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shorelark.functions import text as tx
from shorelark.functions import times as tm
from shorelark.operators.scale import first_by, global_position

ROW = r"(?is)<tr[^>]*>(.*?)</tr>"
CELL = r"(?is)<td[^>]*>(.*?)</td>"
LINK = r'(?s)<a[^>]*href="([^"]+)"[^>]*>(.*?)</a>'


# ---- tables in pages ------------------------------------------------------

def table_rows(pages: DataFrame, html: str, min_cells: int, marker: str | None = None) -> DataFrame:
    """One row per table row with at least ``min_cells`` cells; the marker text, if given, must occur."""
    rows = pages.select(
        *[c for c in pages.columns if c != html],
        # outer, so that no filter on the array is derived and the pattern runs once per page
        F.posexplode_outer(F.regexp_extract_all(F.col(html), F.lit(ROW), F.lit(1))).alias("row_pos", "row_html"),
    ).filter(F.col("row_pos").isNotNull())
    if marker:
        rows = rows.filter(F.col("row_html").contains(marker))
    return rows.withColumn("cells", F.regexp_extract_all("row_html", F.lit(CELL), F.lit(1))).filter(
        F.size("cells") >= min_cells
    )


def release_index(pages: DataFrame, html: str, base: str) -> DataFrame:
    """Index rows with a link, a date and a known platform."""
    rows = table_rows(pages, html, 3)
    first = F.get("cells", 0)
    name = tx.html_to_line(F.regexp_extract(first, LINK, 2))
    date = tx.html_to_line(F.get("cells", 2))
    href = F.regexp_extract(first, LINK, 1)
    return rows.select(
        *[c for c in pages.columns if c != html], "row_pos", name.alias("_name"), date.alias("date"),
        F.when(href.startswith("/"), F.concat(F.lit(base.rstrip("/")), href)).otherwise(href).alias("url"),
    ).filter(F.col("url") != "").filter(F.col("date").rlike(tm.RELEASE_DATE)).select(
        "*", tx.platform_of(F.col("_name")).alias("os"), tx.platform_name(F.col("_name")).alias("name"),
        tm.release_day(F.col("date")).alias("day"),
    ).filter(F.col("os").isNotNull()).drop("_name")


def schedule_rows(pages: DataFrame, html: str, marker: str = "class-details") -> DataFrame:
    """Schedule table rows as classes; an unreadable date stays as text with a null ISO date."""
    rows = table_rows(pages, html, 4, marker)
    keys = [c for c in pages.columns if c != html]
    plain = rows.select(
        *keys, "row_pos", tx.none_if_empty(F.regexp_extract(F.get("cells", 0), r"cid=(\d+)", 1)).alias("cid"),
        tx.none_if_empty(F.regexp_extract(F.get("cells", 3), r"id=(\d+)", 1)).alias("instructor_id"),
        *[tx.html_to_line(F.get("cells", i), "").alias(c) for i, c in enumerate(("course", "date", "location", "_who"))],
    )
    return plain.select(
        *keys, "row_pos", "cid", "course", "date", tm.long_date_iso(F.col("date")).try_cast("date").alias("iso"), "location",
        tx.name_case(F.col("_who")).alias("instructor"), "instructor_id",
    )


# ---- page layouts ---------------------------------------------------------

@dataclass(frozen=True)
class Layout:
    """Fixed patterns of an advisory page; the identifier pattern decides what counts as a finding."""

    identifier: str = tx.CVE_ID
    heading: str = r"<(?:h3|strong)[^>]*>\s*([^<]+?)\s*</(?:h3|strong)>"
    bold: str = r"<(?:b|strong)>([^<]{2,60})</(?:b|strong)>"
    paragraph: str = r'(?s)<p[^>]*class="gb-paragraph"[^>]*>(.*?)</p>'
    any_paragraph: str = r"(?s)<p[^>]*>(.*?)</p>"
    paragraph_heading: str = r"<b>([^<]+)</b>"


FINDING = "array<struct<component:string,description:string,cves:array<string>>>"


def section_findings(text: Column, heading: str, identifier: str) -> Column:
    """Findings of a page split at headings.

    A valid heading names the component until a block with identifiers uses it up; an ignored
    heading leaves it in place. So a block is a finding when the last valid heading before it stands
    after the previous block with identifiers.
    """
    return tx.let(text, lambda t: _sections(t, heading, identifier))


def _sections(text: Column, heading: str, identifier: str) -> Column:
    heads = F.transform(F.regexp_extract_all(text, F.lit(heading), F.lit(1)), lambda h: tx.strip(h))
    heads = F.transform(heads, lambda h: F.struct(h.alias("name"), tx.is_skip_name(h).alias("skip")))
    blocks = F.transform(F.split(text, heading), lambda b, i: F.struct(i.alias("pos"), b.alias("body")))
    blocks = F.filter(blocks, lambda b: (b["pos"] > 0) & b["body"].rlike(identifier))
    packed = F.struct(heads.alias("heads"), blocks.alias("blocks"))  # bound once, not re-derived per block

    def build(pack: Column) -> Column:
        def one(b: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(pack["blocks"], i - 1)["pos"]).otherwise(F.lit(0))
            # only the headings since the block before: all blocks together look at each heading once
            since = F.slice(pack["heads"], before + 1, b["pos"] - before)
            name = F.try_element_at(F.filter(since, lambda h: ~h["skip"]), F.lit(-1))["name"]
            return F.struct(
                name.alias("component"), tx.impact_and_description(b["body"]).alias("description"),
                tx.ids_in(b["body"], identifier).alias("cves"),
            )

        return F.filter(F.transform(pack["blocks"], one), lambda f: f["component"].isNotNull())

    return tx.let(packed, build)


def paragraph_findings(text: Column, layout: Layout = Layout()) -> Column:
    """Findings of a page made of paragraphs: a bold name opens a group, labelled and id paragraphs fill it."""
    return tx.let(_paragraphs(text, layout), lambda ps: _paragraph_groups(ps, layout))


def _paragraphs(text: Column, layout: Layout) -> Column:
    """Marked paragraphs, or all of them on a page without any."""
    marked = F.regexp_extract_all(text, F.lit(layout.paragraph), F.lit(1))
    plain = F.regexp_extract_all(text, F.lit(layout.any_paragraph), F.lit(1))
    return tx.let(marked, lambda m: F.when(F.size(m) > 0, m).otherwise(plain))


def _paragraph_groups(paragraphs: Column, layout: Layout) -> Column:
    def read(p: Column, i: Column) -> Column:
        plain = tx.strip(F.regexp_replace(p, r"<[^>]+>", ""))
        name = tx.strip(F.regexp_extract(p, layout.paragraph_heading, 1))
        bold = p.rlike(layout.paragraph_heading)
        return F.struct(
            i.alias("pos"), (bold & ~tx.is_skip_name(name)).alias("opens"), bold.alias("bold"), name.alias("name"), plain.alias("plain")
        )

    read_all = F.transform(paragraphs, read)
    is_impact, is_description = r"(?U)^Impact:\s*.", r"(?U)^Description:\s*."

    def labelled(ps: Column, pattern: str) -> Column:
        hit = F.try_element_at(F.filter(ps, lambda q: q["plain"].rlike(pattern)), F.lit(-1))["plain"]
        return F.regexp_extract(hit, pattern.rstrip(".") + "(.+)", 1)

    def group(pack: Column) -> Column:
        def one(o: Column, i: Column) -> Column:
            until = F.coalesce(F.get(pack["opens"], i + 1)["pos"], F.size(pack["all"]))
            mine = F.filter(F.slice(pack["all"], o["pos"] + 2, until - o["pos"] - 1), lambda q: ~q["bold"])
            bare = F.filter(mine, lambda q: ~q["plain"].rlike(is_impact) & ~q["plain"].rlike(is_description))
            ids = F.flatten(F.transform(
                bare, lambda q: F.regexp_extract_all(q["plain"], F.lit(layout.identifier), F.lit(0))
            ))
            return F.struct(
                o["name"].alias("component"),
                tx.combine_impact(labelled(mine, is_impact), labelled(mine, is_description)).alias("description"),
                F.array_distinct(ids).alias("cves"),
            )

        return F.filter(F.transform(pack["opens"], one), lambda f: F.size(f["cves"]) > 0)

    packed = tx.let(read_all, lambda ps: F.struct(ps.alias("all"), F.filter(ps, lambda q: q["opens"]).alias("opens")))
    return tx.let(packed, group)


def heading_text(html: Column) -> Column:
    """Line breaks kept as such, inline wrappers removed, as the heading layout expects."""
    return F.regexp_replace(F.regexp_replace(html, r"<br\s*/?>", "\n"), r"</?(?:span|div|a|em|i|u)[^>]*>", "")


def parse_pages(pages: DataFrame, html: str = "html", layout: Layout = Layout()) -> DataFrame:
    """Findings per page by the first of three layouts that yields any, with the layout's name."""
    clean = pages.withColumn(html, tx.strip_comments(F.col(html)))
    tried = (
        clean.withColumn("_h", section_findings(heading_text(F.col(html)), layout.heading, layout.identifier))
        .withColumn("_p", F.when(F.size("_h") == 0, paragraph_findings(F.col(html), layout)))
        .withColumn("_b", F.when((F.size("_h") == 0) & (F.size("_p") == 0), section_findings(F.col(html), layout.bold, layout.identifier)))
    )
    chosen = (
        F.when(F.size("_h") > 0, F.col("_h")).when(F.size("_p") > 0, F.col("_p"))
        .when(F.size("_b") > 0, F.col("_b")).otherwise(F.array().cast(FINDING))
    )
    name = F.when(F.size("_h") > 0, "heading").when(F.size("_p") > 0, "paragraph").when(F.size("_b") > 0, "bold")
    return tried.select(*[c for c in pages.columns if c != html], name.alias("layout"), chosen.alias("findings"))


def flat_findings(parsed: DataFrame) -> DataFrame:
    """One row per finding, in page order."""
    keys = [c for c in parsed.columns if c != "findings"]
    # outer, so that no filter on the array is derived, which would parse every page twice
    rows = parsed.select(*keys, F.posexplode_outer("findings").alias("pos", "_f")).filter(F.col("pos").isNotNull())
    return rows.select(*keys, "pos", "_f.component", "_f.description", "_f.cves")


# ---- increments -----------------------------------------------------------

def new_releases(index: DataFrame, known: DataFrame, ordinal: str) -> DataFrame:
    """Index rows whose name is not known yet, the first row per name."""
    return first_by(index, ["name"], [ordinal]).join(known.select("name").distinct(), "name", "left_anti")


def append_blocks(parsed: DataFrame, ordinal: str, stamp: str) -> DataFrame:
    """Rows to append: releases with findings, oldest first by descending index position, stamped."""
    return parsed.filter(F.size("findings") > 0).withColumn("append_ord", -F.col(ordinal)).withColumn("updated", F.lit(stamp))


def append_to(df: DataFrame, path: str) -> bool:
    """Append when there is something to append; an empty batch leaves the table untouched."""
    if df.isEmpty():
        return False
    df.write.mode("append").parquet(path)
    return True


def serialised(parsed: DataFrame, key: str = "name") -> DataFrame:
    """One JSON text per release, told by ``key``, with its findings nested; whitespace collapsed, quotes escaped."""
    flat = F.transform("findings", lambda f: F.struct(
        tx.collapse(f["component"]).alias("c"), tx.collapse(f["description"]).alias("desc"), f["cves"].alias("cve")
    ))
    body = F.struct(tx.collapse(F.col("name")).alias("r"), F.col("os"), F.col("date").alias("d"), flat.alias("v"))
    return parsed.filter(F.size("findings") > 0).select(key, F.to_json(body).alias("block"))


# ---- search ---------------------------------------------------------------

def search(
    findings: DataFrame, text: str = "", os: str | None = None, version: str | None = None, year: int | None = None,
    families: list[str] | None = None,
) -> DataFrame:
    """Text in component, description or ids, and platform, version, year; chips are or-ed among themselves."""
    out = findings
    if os:
        out = out.filter(F.col("os") == os)
    if year:
        out = out.filter(F.year("day") == year)
    if version:
        out = out.filter(F.col("name").contains(version))
    if families:
        any_family = F.lit(False)
        for family in families:
            any_family = any_family | F.col("component").startswith(family)
        out = out.filter(any_family)
    q = text.strip().lower()
    if q:
        out = out.filter(
            F.lower("component").contains(q) | F.lower("description").contains(q)
            | F.exists("cves", lambda c: F.lower(c).contains(q))
        )
    return out


def finding_order_keys(column: str, descending: bool = False) -> list[Column]:
    c = F.col(column)
    return [c.desc() if descending else c.asc(), F.col("name").asc(), F.col("pos").asc()]


def finding_order(findings: DataFrame, column: str, descending: bool = False) -> DataFrame:
    return findings.orderBy(*finding_order_keys(column, descending))


def finding_places(findings: DataFrame, column: str, tie: str, descending: bool = False, out: str = "place") -> DataFrame:
    """Findings with their place in the order by any column, from 1; ``tie`` orders those that are equal in it.

    Ranges are told by a sample, so the rows are computed twice: hand in a checkpoint where pages are still to be parsed.
    """
    return global_position(findings, [*finding_order_keys(column, descending), F.col(tie).asc()], out)


def top_components(findings: DataFrame, k: int) -> DataFrame:
    counts = findings.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "component").limit(k)


def components(findings: DataFrame) -> DataFrame:
    return findings.select("component").distinct()


def release_totals(findings: DataFrame) -> DataFrame:
    return findings.groupBy("name").agg(F.sum(F.size("cves")).cast("bigint").alias("ids"), F.count(F.lit(1)).alias("findings"))


def shared_ids(findings: DataFrame) -> DataFrame:
    """Every (identifier, release) with the number of other releases that carry the identifier.

    Counts instead of pairs: an identifier in very many releases does not multiply. The releases of
    one identifier are ``releases_of``.
    """
    pairs = findings.select("name", F.explode("cves").alias("cve")).distinct()
    counts = pairs.groupBy("cve").agg(F.count(F.lit(1)).alias("_n"))
    return pairs.join(counts, "cve").select("cve", "name", (F.col("_n") - 1).alias("others"))


def releases_of(findings: DataFrame, cve: str, other_than: str | None = None) -> DataFrame:
    hits = findings.filter(F.array_contains("cves", cve)).select("name").distinct()
    return hits.filter(F.col("name") != other_than) if other_than else hits
