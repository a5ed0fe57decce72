"""Main text of web pages by wrapper induction.

A page is a tree of block elements; runs of inline markup and text are the blocks' lines. The trees of all pages of a
host are aligned by simple tree matching (the largest ordered matching of two trees whose matched nodes have equal labels
and matched parents) and merged into the wrapper of the host. A node of the wrapper knows on how many pages it occurs,
how much text it held, and whether that was the same text on all of them. Constant nodes are the host's template. The
varying ones are its slots; those that lie in the part of the page that holds its article are the content.

Pages of a host that have the same tree are one: trees are counted before they are aligned, so the alignments of a host
grow with the different trees, not with the pages.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shorelark.llm.common import looked_up
from shorelark.session import cut_lineage, shuffle_partitions

#: Elements that start and end lines; all others are part of a line.
BLOCKS = frozenset(
    "html body header footer main article section nav aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption form fieldset address details summary hr hgroup menu search dialog center".split()
)
#: Elements of which nothing is text of the page; the content of the first six is no markup.
RAW = frozenset("script style textarea title noscript template".split())
SILENT = RAW | frozenset("head select option button object iframe svg math audio video canvas map datalist".split())
#: Elements without an end.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Start tags that end an open element: the open ones, and where the search for them stops.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody"}, {"table"}),
}
#: Parts of a page around its article, by element and by words of class, id and role.
CHROME_TAGS = frozenset("nav aside form footer menu dialog search fieldset".split())
CHROME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert alerts "
    "popup modal overlay nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar sidebars rail widget widgets footer masthead "
    "topbar toolbar comment comments commentlist disqus reply replies respond share sharing social related recommended newsletter subscribe subscription "
    "signup login search complementary contentinfo form hidden".split()
)
HEADS = frozenset("header banner".split())
STORY_WORDS = frozenset("article post entry story content main".split())
NEGATIONS = frozenset("has with no without is".split())
WHOLE = frozenset("html body main article".split())

#: Elements deeper than this count as lines of the last level; a longer row of children is told apart by labels only.
DEEPEST, WIDEST = 24, 48
#: A constant node is template where it stands on so many pages of the host and on this share of them.
SUPPORT, SHARE = 20, 0.9
#: A step towards the article is taken while one child holds this share of the varying text.
MOST = 0.8
#: Trees of a host are merged in so many parts before the parts are merged.
PARTS = 32
#: Wrappers of all hosts are sent to every task up to so many bytes; beyond that they are joined.
SENT_BYTES = 32 << 20

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]{0,65536}+\"|'[^']{0,65536}+')*+)>")
_NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|$)""", re.IGNORECASE)
_WORD = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _attributes(text: str) -> tuple[str, bool, bool]:
    """Class, id and role words as a label, whether they name a part around the article, and whether it is a head."""
    if "=" not in text and "hidden" not in text.lower():
        return "", False, False
    words: list[str] = []
    chrome = False
    for name, value in _NAMED.findall(text):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            chrome = True
        elif name == "style":
            chrome = chrome or bool(re.search(r"display\s*:\s*none", value, re.IGNORECASE))
        elif name != "aria-hidden":
            for token in value.split():
                parts = [w.lower() for w in _WORD.findall(_CAMEL.sub(" ", token))]
                words += parts
                chrome = chrome or bool(CHROME_WORDS.intersection(parts)) and not NEGATIONS.intersection(parts)
    head = bool(HEADS.intersection(words)) and not STORY_WORDS.intersection(words)
    return ".".join(dict.fromkeys(words[:4])), chrome, head


_attributes_of = lru_cache(maxsize=4096)(_attributes)


class Page:
    """The tree of a page: ``nodes`` as [label, parent, around the article, inside the article], and ``lines`` as (node, text) in page order."""

    def __init__(self, source: str):
        self.nodes: list[list] = []
        self.lines: list[tuple[int, str]] = []
        self._open: list[tuple[str, int]] = []  # element and node
        self._text: list[str] = []
        self._node = self._add("", "", -1)
        self._read(source)
        self._line()

    def _add(self, tag: str, attributes: str, parent: int) -> int:
        words, chrome, head = _attributes_of(attributes)
        inside = parent >= 0 and self.nodes[parent]
        story = bool(inside) and inside[3] or tag in ("article", "main")
        if tag in WHOLE:
            # the page and its article are not named away but by what is no article at all
            chrome = tag == "article" and bool({"comment", "related", "teaser", "ad", "promo"} & set(words.split(".")))
        else:
            chrome = chrome or tag in CHROME_TAGS or ((tag == "header" or head) and not story)
        self.nodes.append([f"{tag}.{words}" if words else tag, parent, bool(inside) and inside[2] or chrome, story])
        return len(self.nodes) - 1

    def _line(self) -> None:
        if self._text:
            text = " ".join(html.unescape("".join(self._text)).split())
            if text:
                self.lines.append((self._node, text))
            self._text = []

    def _read(self, source: str) -> None:
        at, end, silent = 0, len(source), ""
        depth = 0  # of silent elements of one kind
        while at < end:
            lt = source.find("<", at)
            if lt < 0:
                lt = end
            if lt > at and not silent:
                self._text.append(source[at:lt])
            if lt == end:
                return
            if source.startswith("<!--", lt):
                close = source.find("-->", lt + 4)
                if source.startswith("<!-->", lt) or source.startswith("<!--->", lt):
                    close = source.index(">", lt) - 2
                at = end if close < 0 else close + 3
                continue
            after = source[lt + 1:lt + 2]
            if after in ("!", "?") or (after == "/" and not source[lt + 2:lt + 3].isalpha()):
                close = source.find(">", lt)
                at = end if close < 0 else close + 1
                continue
            if not (after.isalpha() and after.isascii()) and after != "/":
                if not silent:
                    self._text.append("<")
                at = lt + 1
                continue
            found = _TAG.match(source, lt)
            if found:
                closing, tag, attributes, at = found[1], found[2].lower(), found[3], found.end()
            else:
                close = source.find(">", lt)
                if close < 0:
                    return  # a tag that never ends is no text
                name = re.match(r"</?([A-Za-z][^\s/>]*)", source[lt:lt + 64])
                closing, tag, attributes, at = after == "/", name[1].lower() if name else "", "", close + 1
            if silent:
                depth += 0 if tag != silent else (-1 if closing else 1)
                silent = silent if depth else ""
            elif closing:
                self._end(tag)
            elif tag in SILENT:
                if tag in RAW:
                    raw = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(source, at)
                    close = source.find(">", raw.end()) if raw else -1
                    at = end if close < 0 else close + 1
                elif not attributes.endswith("/"):
                    silent, depth = tag, 1
            else:
                self._start(tag, attributes)

    def _start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self._text.append(" ")
        if tag not in BLOCKS:
            return
        self._line()
        if tag in ("html", "body") and any(t == tag for t, _ in self._open):
            return
        if self._open and any(t == "p" for t, _ in self._open[-3:]):
            self._end("p")
        if tag in ENDS:
            ended, within = ENDS[tag]
            for i in range(len(self._open) - 1, -1, -1):
                if self._open[i][0] in within:
                    break
                if self._open[i][0] in ended:
                    self._close(i)
                    break
        if tag in VOID:
            return
        parent = self._open[-1][1] if self._open else 0
        node = parent
        if len(self._open) < DEEPEST:
            node = self._add(tag, attributes, parent)
        elif not self.nodes[parent][2] and (_attributes_of(attributes)[1] or tag in CHROME_TAGS):
            node = self._add(tag, attributes, parent)
        self._open.append((tag, node))
        self._node = node

    def _end(self, tag: str) -> None:
        if tag not in BLOCKS:
            return
        self._line()
        for i in range(len(self._open) - 1, -1, -1):
            if self._open[i][0] == tag:
                self._close(i)
                return
            if self._open[i][0] in ("table", "article", "main") and tag not in WHOLE:
                return

    def _close(self, i: int) -> None:
        self._line()
        del self._open[i:]
        self._node = self._open[-1][1] if self._open else 0


# ---- trees, matching and wrappers --------------------------------------------

class Tree:
    """A node: label, pages it is on, characters of its own lines, and their digest (None: no lines, '*': they vary)."""

    __slots__ = ("label", "pages", "chars", "digest", "kids", "chrome")

    def __init__(self, label: str, pages: int, chars: int, digest: str | None, chrome: bool):
        self.label, self.pages, self.chars, self.digest, self.chrome, self.kids = label, pages, chars, digest, chrome, []

    def packed(self) -> list:
        return [self.label, self.pages, self.chars, self.digest, int(self.chrome), [k.packed() for k in self.kids]]

    def size(self) -> int:
        return 1 + sum(k.size() for k in self.kids)


def unpacked(data: list) -> Tree:
    node = Tree(*data[:4], bool(data[4]))
    node.kids = [unpacked(k) for k in data[5]]
    return node


#: Rows of these are one slot, however many there are.
REPEATED = frozenset("p li dt dd tr td th h2 h3 h4 h5 h6 blockquote pre figure hr".split())


def folded(page: Page) -> tuple[Tree, list[Tree]]:
    """The tree of a page with repeated siblings merged, and the node of it for each node of the page."""
    own: list[list[str]] = [[] for _ in page.nodes]
    for node, text in page.lines:
        own[node].append(text)
    kids: list[list[int]] = [[] for _ in page.nodes]
    for i, node in enumerate(page.nodes[1:], 1):
        kids[node[1]].append(i)
    of: list[Tree | None] = [None] * len(page.nodes)

    def build(label: str, members: list[int]) -> Tree:
        tree = Tree(label, 1, 0, None, page.nodes[members[0]][2])
        for m in members:
            of[m] = tree
        mine = [t for m in members for t in own[m]]
        tree.chars = sum(len(t) for t in mine)
        if mine:
            tree.digest = blake2b("\n".join(mine).encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()
        groups: list[tuple[str, list[int]]] = []
        named: dict[tuple[str, bool], list[int]] = {}
        below = [k for m in members for k in kids[m]]
        wide = len(below) > WIDEST and len({page.nodes[k][0] for k in below}) > WIDEST
        for k in below:
            label, _, chrome, _ = page.nodes[k]
            label = label.split(".")[0] if wide else label
            merged = label.split(".")[0] in REPEATED or len(below) > WIDEST or len(members) > 1
            if merged and (label, chrome) in named:
                named[label, chrome].append(k)
                continue
            groups.append((label, [k]))
            if merged:
                named[label, chrome] = groups[-1][1]
        tree.kids = [build(name, group) for name, group in groups]
        return tree

    return build("", [0]), of


def shape(tree: Tree) -> str:
    """Labels of a tree as text; trees of one shape align node by node."""
    return tree.label + ("!" if tree.chrome else "") + ("(" + "|".join(shape(k) for k in tree.kids) + ")" if tree.kids else "")


def matching(a: Tree, b: Tree) -> list[tuple[Tree, Tree]]:
    """Simple tree matching of two trees with equal labels: the matched pairs below them, themselves not included."""
    memo: dict[tuple[int, int], int] = {}

    def score(x: Tree, y: Tree) -> int:
        if x.label != y.label:
            return 0
        key = (id(x), id(y))
        if key not in memo:
            memo[key] = 1 + table(x, y)[-1][-1]
        return memo[key]

    rivals: dict[tuple[int, int], list[Tree]] = {}

    def alike(x: Tree, y: Tree) -> list[Tree]:
        """Children of x that a child of y may match; the others change no matching, however many a wrapper has."""
        key = (id(x), id(y))
        if key not in rivals:
            labels = {q.label for q in y.kids}
            rivals[key] = [p for p in x.kids if p.label in labels] if labels else []
        return rivals[key]

    def table(x: Tree, y: Tree) -> list[list[int]]:
        rows = [[0] * (len(y.kids) + 1)]
        for p in alike(x, y):
            row, above = [0], rows[-1]
            for j, q in enumerate(y.kids):
                row.append(max(above[j + 1], row[j], above[j] + score(p, q)))
            rows.append(row)
        return rows

    pairs: list[tuple[Tree, Tree]] = []
    stack = [(a, b)]
    while stack:
        x, y = stack.pop()
        rows, ahead = table(x, y), alike(x, y)
        i, j = len(ahead), len(y.kids)
        while i and j:
            gain = score(ahead[i - 1], y.kids[j - 1])
            if gain and rows[i][j] == rows[i - 1][j - 1] + gain:
                pairs.append((ahead[i - 1], y.kids[j - 1]))
                stack.append(pairs[-1])
                i, j = i - 1, j - 1
            elif rows[i][j] == rows[i - 1][j]:
                i -= 1
            else:
                j -= 1
    return pairs


def merge(wrapper: Tree, other: Tree) -> None:
    """Aligns a tree with a wrapper and adds it whole; what has no match is inserted where its neighbours are."""
    matched = {id(b): a for a, b in matching(wrapper, other)}
    stack = [(wrapper, other)]
    while stack:
        w, t = stack.pop()
        w.pages += t.pages
        w.chars += t.chars
        w.chrome = w.chrome and t.chrome
        if w.digest is None or t.digest is None:
            w.digest = w.digest or t.digest
        elif w.digest != t.digest:
            w.digest = "*"
        place = 0
        for kid in t.kids:
            partner = matched.get(id(kid))
            if partner is None and len(w.kids) >= WIDEST:  # a row this long is told apart by labels
                partner = next((x for x in w.kids if x.label == kid.label), None)
            if partner is not None:
                stack.append((partner, kid))
                place = next(i for i, x in enumerate(w.kids) if x is partner) + 1
            else:
                w.kids.insert(place, kid)
                place += 1


def article(tree: Tree, partner: dict[int, Tree], pages: int) -> set[int]:
    """Ids of the nodes of a page's tree that are content, by the wrapper's nodes that they are aligned with."""
    def constant(t: Tree) -> bool:
        w = partner.get(id(t))
        return bool(w) and w.digest not in (None, "*") and w.pages >= SUPPORT and w.pages >= SHARE * pages

    weights: dict[int, float] = {}

    def weigh(t: Tree) -> float:
        """Varying text below a node that is not around the article: mean characters of the slot, or the page's own."""
        w = partner.get(id(t))
        own = 0.0 if constant(t) else (w.chars / max(1, w.pages) if w else float(t.chars))
        total = own + sum(weigh(k) for k in t.kids)
        weights[id(t)] = 0.0 if t.chrome else total
        return weights[id(t)]

    if not weigh(tree):
        weights = {}

        def plain(t: Tree) -> float:
            total = float(t.chars) + sum(plain(k) for k in t.kids)
            weights[id(t)] = 0.0 if t.chrome else total
            return weights[id(t)]

        plain(tree)
        constant = lambda t: False  # noqa: E731  nothing varies: there is no second page to compare with

    def tops(t: Tree, tag: str) -> list[Tree]:
        if t.chrome:
            return []
        if t.label.split(".")[0] == tag and weights[id(t)]:
            return [t]
        return [x for k in t.kids for x in tops(k, tag)]

    # a slot that the pages themselves mark as the article, else the narrowest part with most of the varying text
    roots = tops(tree, "article") or tops(tree, "main")
    if not roots:
        at = tree
        while True:
            inner = [k for k in at.kids if k.label.split(".")[0] not in REPEATED]
            best = max(inner, key=lambda k: weights[id(k)], default=None)
            if best is None or weights[id(best)] < MOST * weights[id(at)]:
                break
            at = best
        roots = [at]
    content: set[int] = set()
    stack = list(roots)
    while stack:
        t = stack.pop()
        if t.chrome:
            continue
        if not constant(t):
            content.add(id(t))
        stack += t.kids
    return content


def text_of(source: str, wrapper: Tree | None, known: dict[str, list[bool]]) -> str:
    """The content of a page as lines; ``known`` keeps the decisions of the host's wrapper for each shape of tree."""
    page = Page(source)
    tree, of = folded(page)
    flat = preorder(tree)
    key = shape(tree)
    chosen = known.get(key)
    if chosen is None:
        pairs = {id(b): a for a, b in matching(wrapper, tree)} | {id(tree): wrapper} if wrapper else {}
        content = article(tree, pairs, wrapper.pages if wrapper else 1)
        chosen = [id(t) in content for t in flat]
        if wrapper:
            known[key] = chosen
    kept = {id(t) for t, c in zip(flat, chosen, strict=True) if c}
    return "\n".join(text for node, text in page.lines if id(of[node]) in kept)


def preorder(tree: Tree) -> list[Tree]:
    out, stack = [], [tree]
    while stack:
        t = stack.pop()
        out.append(t)
        stack += reversed(t.kids)
    return out


# ---- over all pages -----------------------------------------------------------

def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different trees of a task's pages, with their pages, characters and digests."""
    seen: dict[tuple[str, str], Tree] = {}
    nodes = 0

    def rows() -> pa.RecordBatch:
        keys = list(seen)
        return pa.RecordBatch.from_pydict({
            "host": pa.array([h for h, _ in keys], pa.string()), "shape": pa.array([s for _, s in keys], pa.string()),
            "tree": pa.array([json.dumps(seen[k].packed(), separators=(",", ":")) for k in keys], pa.string()),
        })

    for batch in batches:
        for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            tree, _ = folded(Page(source))
            key = (host, shape(tree))
            if key in seen:
                _add_same(seen[key], tree)
            else:
                seen[key] = tree
                nodes += tree.size()
        if nodes > 200_000:
            yield rows()
            seen, nodes = {}, 0
    if seen:
        yield rows()


def _add_same(into: Tree, tree: Tree) -> None:
    """Adds a tree of the same shape."""
    for a, b in zip(preorder(into), preorder(tree), strict=True):
        a.pages += b.pages
        a.chars += b.chars
        if a.digest is None or b.digest is None:
            a.digest = a.digest or b.digest
        elif a.digest != b.digest:
            a.digest = "*"


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper for each host and part of rows that come sorted by them; only one is in memory."""
    at, wrapper = None, None

    def row() -> pa.RecordBatch:
        text = json.dumps(wrapper.packed(), separators=(",", ":"))
        return pa.RecordBatch.from_pydict({"host": [at[0]], "part": pa.array([at[1]], pa.int32()), "shape": [""], "tree": [text]})

    for batch in batches:
        for host, part, tree in zip(*[batch.column(c).to_pylist() for c in ("host", "part", "tree")], strict=True):
            tree = unpacked(json.loads(tree))
            if (host, part) != at:
                if at is not None:
                    yield row()
                at, wrapper = (host, part), tree
            else:
                merge(wrapper, tree)
    if at is not None:
        yield row()


def hosted(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))


def induce(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, tree): the wrapper of every host as JSON. All pages count; of equal trees only their sums are shuffled.

    A host's trees are merged in PARTS parts, each in the order of its shapes, and then the parts: the wrapper is the same
    however the pages are dealt, and a host with a third of all pages is in no single task but for its parts.
    """
    schema = "host string, part int, shape string, tree string"
    trees = hosted(pages, id_col, url_col, html_col).select("host", "html").mapInArrow(_counted, "host string, shape string, tree string")
    trees = trees.withColumn("part", F.pmod(F.xxhash64("shape"), F.lit(PARTS)).cast("int")).select("host", "part", "shape", "tree")
    n = shuffle_partitions(pages.sparkSession)
    parts = trees.repartition(n, "host", "part").sortWithinPartitions("host", "part", "shape", "tree").mapInArrow(_merged, schema)
    whole = parts.select("host", F.lit(0).alias("part"), F.col("part").cast("string").alias("shape"), "tree")
    return whole.repartition(n, "host").sortWithinPartitions("host", F.col("shape").cast("int")).mapInArrow(_merged, schema).select("host", "tree")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text.

    The text is the article of the whole page: its lines in page order, character references decoded, white space inside a
    line one space. A null or empty page has an empty text. Pages without a host (or with a null url) are one host. Null or
    repeated ids and repeated rows keep a row each; an empty table gives none. Other columns are not read. A host with a
    single page has no template to compare with; its parts are then told by their elements and names alone.
    """
    wrappers = cut_lineage(induce(pages, id_col, url_col, html_col))
    size = wrappers.agg(F.coalesce(F.sum(F.octet_length("tree") + F.octet_length("host")), F.lit(0))).first()[0]
    rows, schema = hosted(pages, id_col, url_col, html_col), f"page_id {pages.schema[id_col].dataType.simpleString()}, url string, text string"
    sent = None
    if size <= SENT_BYTES:
        sent = pages.sparkSession.sparkContext.broadcast({r["host"]: r["tree"] for r in wrappers.collect()})
    else:
        rows = looked_up(rows, wrappers, "host", "html", PARTS)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[str, tuple[Tree | None, dict]] = {}
        for batch in batches:
            trees = [sent.value.get(h) for h in batch.column("host").to_pylist()] if sent else batch.column("tree").to_pylist()
            out = []
            for host, tree, source in zip(batch.column("host").to_pylist(), trees, batch.column("html").to_pylist(), strict=True):
                if host not in ready:
                    if len(ready) >= 200:
                        ready.clear()
                    ready[host] = (unpacked(json.loads(tree)) if tree else None, {})
                wrapper, known = ready[host]
                if len(known) >= 500:
                    known.clear()
                out.append(text_of(source, wrapper, known))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])

    return rows.mapInArrow(texts, schema)
