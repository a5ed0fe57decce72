"""Text expressions: cleaning, titles, prices, links, identifiers."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"
NBSP = "\u00a0"


def let(value: Column, body) -> Column:
    """``body`` over a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), 0)


def strip(c: Column, chars: str | None = None) -> Column:
    """Trim Unicode whitespace, or the given characters, from both ends."""
    if chars is not None:
        return F.btrim(c, F.lit(chars))
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def none_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, SPACE, " "))


def clean_text(c: Column) -> Column:
    """Multi-line clean-up: blanks collapsed inside lines, space around line ends dropped."""
    c = F.replace(c, F.lit(NBSP), F.lit(" "))
    c = F.regexp_replace(c, r"[ \t\r\f]+", " ")
    c = F.regexp_replace(c, r"(?U)\s*\n\s*", "\n")
    return none_if_empty(strip(c))


# ---- entities -------------------------------------------------------------

def _utf32(code_hex: Column) -> Column:
    code = F.lpad(F.upper(code_hex), 8, "0")
    invalid = (F.length(code_hex) > 8) | (code == "00000000") | (code > "0010FFFF") | code.between("0000D800", "0000DFFF")
    return F.when(invalid, F.lit("\ufffd")).otherwise(F.decode(F.unhex(code), "UTF-32"))


def _no_character(n: Column) -> Column:
    """Code points that stand for nothing: controls and non-characters."""
    control = n.between(1, 8) | (n == 11) | n.between(14, 31) | n.between(127, 159)
    return control | n.between(0xFDD0, 0xFDEF) | ((n > 0) & (n < 0x110000) & (n % 0x10000 >= 0xFFFE))


def _literal_map(pairs: dict[str, str]) -> Column:
    # one JSON literal folds to one map literal, whatever the number of entries
    return F.from_json(F.lit(json.dumps(pairs)), "map<string,string>")


def _named_entities() -> dict[str, str]:
    common = ("amp;", "lt;", "gt;", "quot;", "nbsp;", "apos;")
    names = [*common, *sorted(n for n in html5 if n.endswith(";") and n not in common)]
    return {n[:-1]: html5[n] for n in names}


def _bare_names() -> str:
    # names browsers also accept without the semicolon, longest first
    return "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))


def _c1_controls() -> dict[str, str]:
    # numeric references 128..159 mean the windows-1252 character, as browsers read them
    out = {}
    for code in range(128, 160):
        try:
            out[str(code)] = bytes([code]).decode("cp1252")
        except UnicodeDecodeError:
            out[str(code)] = chr(code)
    return out | {"13": "\r"}


def decode_entities(c: Column) -> Column:
    """Named and numeric character references to text, inside the JVM."""
    named, c1 = _literal_map(_named_entities()), _literal_map(_c1_controls())
    numeric = r"^(#[0-9]+|#[xX][0-9a-fA-F]+);?"
    closed = r"^([A-Za-z][A-Za-z0-9]*);"
    bare = f"^({_bare_names()})"

    def number(p: Column) -> Column:
        token = F.regexp_extract(p, numeric, 1)
        digits = F.regexp_replace(token, "^#[xX]?0*(?=.)", "")
        code = F.when(F.length(digits) > 8, F.lit("-1")).when(token.rlike("^#[xX]"), F.conv(digits, 16, 10)).otherwise(digits)
        return let(code.cast("bigint"), lambda n: F.coalesce(
            F.try_element_at(c1, n.cast("string")), F.when(_no_character(n), F.lit("")), _utf32(F.hex(n))
        ))

    def name(p: Column) -> Column:
        return F.try_element_at(named, F.regexp_extract(p, closed, 1))

    def bare_name(p: Column) -> Column:
        return F.try_element_at(named, F.regexp_extract(p, bare, 1))

    def piece(p: Column, i: Column) -> Column:
        return (
            F.when(i == 0, p)
            .when(p.rlike(numeric), F.concat(number(p), F.regexp_replace(p, numeric, "")))
            .otherwise(let(name(p), lambda known: F.when(known.isNotNull(), F.concat(known, F.regexp_replace(p, closed, "")))
                           .when(p.rlike(bare), F.concat(bare_name(p), F.regexp_replace(p, bare, "")))
                           .otherwise(F.concat(F.lit("&"), p))))
        )

    # most texts hold no reference
    return let(c, lambda text: F.when(text.contains("&"), F.array_join(F.transform(F.split(text, "&"), piece), "")).otherwise(text))


def html_to_line(c: Column, tag_becomes: str = " ") -> Column:
    """Tags removed, references decoded, all whitespace collapsed to single blanks."""
    c = F.regexp_replace(c, r"<[^>]+>", tag_becomes)
    c = F.replace(decode_entities(c), F.lit(NBSP), F.lit(" "))
    return collapse(c)


def strip_comments(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)<!--.*?-->", "")


# ---- keys and titles ------------------------------------------------------

def canonical(c: Column) -> Column:
    return F.lower(collapse(c))


def name_case(c: Column) -> Column:
    """Lower case, then a capital at the start and after blanks, hyphens and apostrophes."""
    pieces = F.split(F.lower(c), r"(?U)(?<=[\s\-'])")
    return F.array_join(
        F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))), ""
    )


def normal_title(c: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?iU)\s*\(sold out\)\s*$", ""))


SOLD_OUT = r"(?iU)\(\s*sold\s*out\s*\)"


def is_sold_out(text: Column | None = None, places: Column | None = None, flag: Column | None = None) -> Column:
    out = F.lit(False)
    if text is not None:
        out = out | F.coalesce(text.rlike(SOLD_OUT), F.lit(False))
    if places is not None:
        out = out | F.coalesce(places == 0, F.lit(False))
    if flag is not None:
        out = out | F.coalesce(flag, F.lit(False))
    return out


def with_sold_out(title: Column, sold_out: Column) -> Column:
    return F.when(sold_out, F.concat(title, F.lit(" (sold out)"))).otherwise(title)


# fixed value: the trailing date forms a listing title may carry
TRAILING_DATE = (
    r"(?iU)(?:\s*[-–]?\s*\d{1,2}/\d{1,2}/\d{2,4}"
    r"|\s*[-–]?\s*(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s*[-–]?\s*\d{2,4}"
    r"|\s+20\d{2})\s*$"
)


def drop_trailing_dates(c: Column, passes: int = 2) -> Column:
    for _ in range(passes):
        c = strip(F.regexp_replace(c, TRAILING_DATE, ""), " -–·")
    return c


# fixed value: weekday prefix of a weekly item name
WEEKDAY_PREFIX = (
    r"(?iU)^(mon|tues|wednes|thurs|fri|satur|sun)day(\s+(morning|afternoon|evening|night))?\s*[-–—]*\s*"
)


def drop_weekday(c: Column) -> Column:
    t = strip(F.regexp_replace(c, WEEKDAY_PREFIX, ""), " -–—/·")
    return F.coalesce(none_if_empty(F.regexp_replace(t, r"(?U)\s{2,}", " ")), c)


def split_location(title: Column, pattern: str, prefix: str) -> tuple[Column, Column]:
    """A recognised suffix leaves the title and becomes the location; no suffix, no location."""
    place = F.regexp_extract(title, pattern, 1)
    location = F.when(place != "", F.concat(F.lit(prefix), F.initcap(place)))
    return F.when(place != "", strip(F.regexp_replace(title, pattern, ""))).otherwise(title), location


LOCATION_SUFFIX = r"(?iU)\s*-\s*Sydney\s*-\s*(Alexandria|Manly)\s*$"  # fixed value
START_TIME = r"(?iU)Start\s*Time:\s*(\d{1,2}:\d{2})"  # fixed value
PRICE = r"(?U)\$\s*([\d,]+(?:\.\d{2})?)"  # fixed value


def start_time_text(c: Column) -> Column:
    return none_if_empty(F.regexp_extract(c, START_TIME, 1))


def price_text(c: Column) -> Column:
    """``$`` amount found in the text."""
    amount = none_if_empty(F.regexp_extract(c, PRICE, 1))
    return F.concat(F.lit("$"), amount)


def nonzero_price(c: Column) -> Column:
    return F.when(~c.rlike(r"^\$0(\.00)?$"), none_if_empty(c))


def join_parts(*parts: Column, sep: str = " · ") -> Column:
    """Non-empty parts joined; null when there are none."""
    return none_if_empty(F.concat_ws(sep, *[none_if_empty(p) for p in parts]))


def ellipsis_after(c: Column, limit: int) -> Column:
    """Text above the limit is cut one short of it and closed with an ellipsis."""
    cut = F.regexp_replace(F.substring(c, 1, limit - 1), r"(?U)\s+$", "")
    return F.when(F.length(c) > limit, F.concat(cut, F.lit("…"))).otherwise(c)


def summary_text(c: Column, limit: int = 400) -> Column:
    return F.substring(F.regexp_replace(c, r"(?U)\s*\.{3}\s*\(Read More\)\s*$", "…"), 1, limit)


# ---- links ----------------------------------------------------------------

def absolute_url(href: Column, base: str) -> Column:
    root = base.rstrip("/")
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(F.lit(base.split(":", 1)[0] + ":"), href))
        .when(href.startswith("/"), F.concat(F.lit(root), href))
        .otherwise(F.concat(F.lit(root + "/"), href))
    )


def drop_query(url: Column) -> Column:
    """Everything from the query or fragment on is dropped; empty becomes null."""
    return none_if_empty(F.regexp_replace(url, r"[?#].*$", ""))


def _query_of(url: Column) -> Column:
    return F.regexp_extract(url, r"\?([^#]*)", 1)


def rebase_without(url: Column, base: str, dropped: list[str]) -> Column:
    """Path and query put on another host, without the listed query keys."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/]*", "")
    pairs = F.filter(
        F.split(_query_of(url), "&"),
        lambda p: p.rlike("^[^=]+=.+") & ~F.regexp_extract(p, "^([^=]*)", 1).isin(*dropped),
    )
    query = F.array_join(pairs, "&")
    full = F.concat(
        F.lit(base.rstrip("/")),
        F.when(path == "", F.lit("/")).otherwise(path),
        F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)),
    )
    return F.when(F.coalesce(url, F.lit("")) != "", full)


def query_value(url: Column, key: str) -> Column:
    """First value of a query key, decoded; blank values count as absent."""
    raw = F.regexp_extract(F.concat(F.lit("&"), _query_of(url)), f"&{key}=([^&]*)", 1)
    return F.try_url_decode(none_if_empty(raw))


def deep_link(prefix: str, key: Column, suffix: str = "") -> Column:
    """Null key, null link."""
    return F.concat(F.lit(prefix), F.url_encode(key.cast("string")), F.lit(suffix))


def event_id(source: Column, title: Column, start: Column, url: Column) -> Column:
    bar = chr(124)
    digest = F.sha1(F.concat_ws(bar, source, title, start, F.coalesce(url, F.lit(""))))
    return F.concat(source, F.lit("-"), F.substring(digest, 1, 12))


# ---- advisory text --------------------------------------------------------

# fixed values: headings that never name a component
SKIP_EXACT = (
    "Impact", "Description", "CVE", "Available for", "Entry added", "Entry updated",
    "Note", "Released", "This document", "For our customers",
)
SKIP_PREFIXES = (
    "iOS ", "iPadOS ", "macOS ", "tvOS ", "watchOS ", "Safari ", "Xcode ",
    "Additional ", "Entry ", "About ", "Apple security", "Apple Product",
)
CVE_ID = r"CVE-\d{4}-\d+"
DEFAULT_FINDING_TEXT = "Security issue addressed"


def is_skip_name(c: Column) -> Column:
    """Headings too short, too long, numbered or on the fixed lists."""
    prefixes = "^(" + "|".join(SKIP_PREFIXES) + ")"
    return (
        c.isNull()
        | ~F.length(c).between(2, 80)
        | c.rlike(r"(?U)^\d")
        | c.isin(*SKIP_EXACT)
        | c.rlike(prefixes)
    )


def _no_final_dots(c: Column) -> Column:
    return let(F.rtrim(strip(c), F.lit(".")), none_if_empty)


def combine_impact(impact: Column, description: Column) -> Column:
    parts = F.struct(_no_final_dots(impact).alias("i"), _no_final_dots(description).alias("d"))
    return let(parts, lambda v: F.coalesce(
        F.concat(v["i"], F.lit(". "), v["d"]), v["i"], v["d"], F.lit(DEFAULT_FINDING_TEXT)
    ))


# fixed values: stop words and sentence cues of advisory text
IMPACT_TEXT = r"(?U)Impact:\s*(.+?)(?:\s*Description:|\s*CVE-|\s*Available for|\s*Entry|\s*$)"
DESCRIPTION_TEXT = r"(?U)Description:\s*(.+?)(?:\s*CVE-|\s*Entry|\s*$)"
SENTENCE_TEXT = (
    r"(?:^|\. )([A-Z][^.]*(?:may|could|might|can|able to|addressed|issue|vulnerability|problem|flaw)[^.]*)"
)


def impact_and_description(fragment: Column) -> Column:
    """Labelled parts of a block, else its first telling sentence, else the default text."""
    def parts(text: Column) -> Column:
        return F.struct(
            _no_final_dots(F.regexp_extract(text, IMPACT_TEXT, 1)).alias("i"),
            _no_final_dots(F.regexp_extract(text, DESCRIPTION_TEXT, 1)).alias("d"),
            _no_final_dots(F.regexp_extract(text, SENTENCE_TEXT, 1)).alias("s"),
        )

    def choose(v: Column) -> Column:
        unlabelled = v["i"].isNull() & v["d"].isNull() & v["s"].isNotNull()
        return F.when(unlabelled, v["s"]).otherwise(combine_impact(v["i"], v["d"]))

    text = collapse(F.regexp_replace(fragment, r"<[^>]+>", " "))
    return let(let(text, parts), choose)


def ids_in(c: Column, pattern: str = CVE_ID) -> Column:
    """Distinct identifiers in order of first occurrence."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)))


def platform_of(name: Column) -> Column:
    return F.when(name.rlike("^(iOS|iPadOS) "), "ios").when(name.startswith("macOS "), "macos")


def platform_name(name: Column) -> Column:
    return F.replace(name, F.lit(" and iPadOS"), F.lit(" / iPadOS"))
