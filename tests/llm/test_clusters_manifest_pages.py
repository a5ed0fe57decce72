"""Centroids, manifest and page text on awkward small tables, against plain versions."""

from __future__ import annotations

import hashlib
import html
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shorelark.llm import manifest as mf
from shorelark.llm import wrappers as wr
from shorelark.llm.centroids import cluster, nearest, neighbour_lists
from tests.llm import helpers as h

# ---- centroids ----------------------------------------------------------------


def plain_clusters(rows, k, rounds, components):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == components and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def assign(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(assign(v)[1], []).append(v)
        centroids = [[sum(col) // len(groups[i]) for col in zip(*groups[i], strict=True)] if i in groups else c for i, c in enumerate(centroids)]
    return Counter((i, c, d) for i, v in kept for d, c in [assign(v)]), centroids


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], "vec_id bigint, embedding array<float>, cluster int, distance int, v string").repartition(3)


@pytest.mark.parametrize("k,n", [(7, 300), (40, 25), (1, 60)])
def test_clusters_equal_plain_ones(spark, k, n):
    rng = random.Random(n)
    rows = [(i, [rng.randint(-8, 8) / 4 for _ in range(6)]) for i in range(n)]  # coarse steps: many ties
    rows += [(3, rows[3][1]), (None, rows[4][1]), (None, [0.1] * 6), (n, None), (n + 1, [1.0] * 5), (n + 2, [1.0] * 5 + [None]), (n + 3, [float("nan")] * 6), (n + 4, [float("inf")] * 6), (n + 5, [])]
    found = cluster(vectors(spark, rows), k=k, rounds=3, components=6)
    want, centroids = plain_clusters(rows, k, 3, 6)
    assert Counter(tuple(r) for r in found.rows.collect()) == want
    mine = {r["cluster"]: r for r in found.centroids.collect()}
    assert [mine[i]["components"] for i in range(len(centroids))] == centroids
    assert found.inertia == sum(d * m for (_, _, d), m in want.items())
    assert {i: r["size"] for i, r in mine.items() if r["size"]} == Counter(c for (_, c, _), m in want.items() for _ in range(m))


def test_no_vectors(spark):
    found = cluster(vectors(spark, [(1, None), (2, [1.0])]), components=6)
    assert (found.rows.count(), found.centroids.count(), found.inertia) == (0, 0, 0)
    assert cluster(vectors(spark, [(1, None)]).limit(0)).rows.count() == 0


def test_too_large_components_are_refused(spark):
    with pytest.raises(Exception, match="magnitude"):
        cluster(vectors(spark, [(1, [1e9] * 6), (2, [0.0] * 6)]), components=6).rows.count()


def test_search_equals_comparing_all():
    rng = np.random.default_rng(1)
    for spread in (3, 50, 1 << 20):
        centroids, points = rng.integers(-spread, spread, (40, 5)), rng.integers(-spread, spread, (2000, 5))
        centroids[7] = centroids[3]
        all_pairs = ((points[:, None] - centroids[None]) ** 2).sum(axis=2)
        at, distance = nearest(points, centroids, *neighbour_lists(centroids))
        assert (at == all_pairs.argmin(axis=1)).all() and (distance == all_pairs.min(axis=1)).all()


# ---- manifest -----------------------------------------------------------------

def sha(*texts) -> str:
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def plain_leaf(*values) -> str:
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain_tree(nodes):
    """Root and, per leaf, the siblings with their side."""
    paths = [[] for _ in nodes]
    at, level = list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, path in enumerate(paths):
            other = at[i] ^ 1
            path.append((level[other] if other < len(level) else None, other < at[i]))
            at[i] >>= 1
        level = [sha(*level[i:i + 2]) for i in range(0, len(level), 2)]
    return level[0], paths


def plain_manifest(rows):
    groups = {}
    for doc, text, lang, source, n in rows:
        groups.setdefault(lang, []).append((doc, plain_leaf(doc, source, lang, n, text)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[g] = plain_tree([leaf for _, leaf in groups[g]])
    root, crown = plain_tree([trees[g][0] for g in names])
    return Counter(
        (doc, leaf, trees[g][0], root, sha(*[s for s, _ in path + top if s]))
        for g, top in zip(names, crown, strict=True) for (doc, leaf), path in zip(groups[g], trees[g][1], strict=True)
    )


def manifest_rows(spark, rows):
    full = [(*r, 1, "a", 2) for r in rows]
    return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, slot int, leaf string, n int").repartition(3)


def digests(rows, leaf="leaf"):
    out = mf.checked(rows, leaf).select("doc_id", *[F.lower(F.hex(c)) for c in ("leaf", "subroot", "root", "siblings")], "folded", "root")
    return out.collect()


@pytest.mark.parametrize("ids", ["dense", "sparse", "awkward"])
def test_manifest_equals_plain_trees(spark, ids):
    rng = random.Random(5)
    if ids == "dense":  # one group above a slot array, one that ends with a lone node, one of a single leaf
        rows = [(i, f"t{i}", "de" if i % 3 else None, "s", i) for i in range(1500)] + [(1500, "", "x", None, None)]
    elif ids == "sparse":
        far = [-(1 << 63), (1 << 63) - 1, -1, 0, 63, 64, 1 << 40, *[rng.randrange(-(1 << 62), 1 << 62) for _ in range(300)]]
        rows = [(i, "same", "en", "s", 1) for i in far]
    else:
        rows = [(i, t, lang, None, None if t is None else len(t)) for i, t, lang in h.awkward()]
        rows += [rows[1]] * 3 + [(2, None, "en", "s", 3), (None, "z", "zz", "s", 3), (None, "z", "zz", "s", 3), (7, "a", "ä", "", 0), (7, "a", "~", "", 0)]
    found = digests(mf.build(manifest_rows(spark, rows)).rows)
    assert Counter(tuple(r)[:5] for r in found) == plain_manifest(rows)
    assert all(r[5] == r[6] for r in found)


def test_changed_leaves_do_not_verify(spark):
    docs = manifest_rows(spark, [(i, f"t{i}", "en", "s", i if i % 2 else None) for i in range(700)])
    other = mf.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + 1, F.col("text"))
    rows = mf.checked(mf.build(docs, carry={"other": other}).rows, "other").collect()
    assert all((r["folded"] == r["root"]) == (r["doc_id"] % 2 == 0) for r in rows) and len(rows) == 700


def test_no_manifest_and_wrong_ids(spark):
    docs = manifest_rows(spark, [(1, "a", "en", "s", 1)])
    assert mf.build(docs.limit(0)).rows.count() == 0
    with pytest.raises(TypeError):
        mf.build(docs.withColumn("doc_id", F.lit("x")))


# ---- pages --------------------------------------------------------------------

SHELL = "<html><head><title>t</title><style>p{{}}</style></head><body>{}</body></html>"


def site(n: int, marked: bool) -> list[tuple[int, str, str, str]]:
    """Pages of one host with their text; without marks the article is told from the template by what varies."""
    out = []
    for i in range(n):
        story = [h.prose(1000 + 7 * i + j, 30) for j in range(1 + i % 4)]
        inner = f"<h1>Story {i} &amp; more</h1>" + "".join(f"<p>{html.escape(s)}" for s in story) + "<div><p>Written by the desk.</p></div>"
        body = f"<article>{inner}<aside>See {i}</aside></article>" if marked else f"<div>{inner}</div>"
        page = SHELL.format(f"<div><p>Our motto.</p></div><nav><a>a{i}</a></nav><!-- x -->{body}<div class='comments'><p>I say {i}</p></div><div><p>All rights kept.</p></div>")
        out.append((i, f"https://{'m' if marked else 'u'}.example/{i}", page, "\n".join([f"Story {i} & more", *story])))
    return out


@pytest.fixture(scope="module")
def web(spark):
    rows = site(40, True) + site(40, False)
    rows += [
        (100, None, "<p>no  host\n here", "no host here"), (100, None, "<p>no  host\n here", "no host here"), (None, "u", None, ""), (101, "https://e.example", "", ""),
        (102, "https://one.example/a", "<body class='has-sidebar'><header>h</header><main><header><h2>T</h2></header>a<b>b</b> <i>c</i><br>d<script>x<p></script><footer>f</footer></main>", "T\nab c d"),
        (103, "https://two.example", "<div id=main-menu>m</div><div class='post header'>x</div><ul><li>1<li>2</ul><form>q</form>", "x\n1\n2"),
        (104, "//three.example", "<p>cut &am; &lt;b&gt; 1 < 2 <p>end &copy <a href='>'>link</a><b", "cut &am; <b> 1 < 2\nend © link"),
        (105, "https://four.example", "<table><tr><td>a<td>b<tr><td>c</table>" + "<div>" * 300 + "deep", "a\nb\nc\ndeep"),
        (106, "https://five.example", SHELL.format("<article class='comment'>r</article><article><p>" + "w " * 60_000 + "</article>"), ("w " * 60_000).strip()),
    ]
    frame = spark.createDataFrame([(*r[:3], "host", 1, "tree") for r in rows], "page_id bigint, url string, html string, host string, part int, text string")
    return frame, Counter((r[0], r[1], r[3]) for r in rows)


def answer(df):
    return Counter(tuple(r) for r in df.collect())


def test_text_of_pages(web):
    frame, want = web
    assert answer(wr.extract(frame.repartition(5))) == want


def test_text_when_wrappers_are_joined(web, monkeypatch):
    frame, want = web
    monkeypatch.setattr(wr, "SENT_BYTES", 0)
    assert answer(wr.extract(frame)) == want


def test_wrappers_do_not_depend_on_how_pages_are_dealt(web):
    frame, _ = web
    assert answer(wr.induce(frame.repartition(7))) == answer(wr.induce(frame.coalesce(1)))
    assert wr.extract(frame.limit(0)).count() == 0


def test_a_crowded_wrapper_leaves_no_tree_out():
    def page(labels, pages):
        t = wr.Tree("", pages, 0, None, False)
        t.kids = [wr.Tree(x, pages, 5, "same", False) for x in labels]
        return t

    wrapper = page(["nav"], 1)
    for i in range(250):
        wr.merge(wrapper, page(["nav", *[f"div.w{i}x{j}" for j in range(20)]], 1))
    wr.merge(wrapper, page(["nav", "footer.last"], 9000))
    found = {k.label: k.pages for k in wrapper.kids}
    assert len(found) == 250 * 20 + 2 and found["footer.last"] == 9000 and found["nav"] == wrapper.pages == 9251


def plain_matching(a, b) -> int:
    """Size of the largest ordered matching, by trying all."""
    if a.label != b.label:
        return 0

    def rows(x, y):
        if not x or not y:
            return 0
        return max(rows(x[1:], y), rows(x, y[1:]), rows(x[1:], y[1:]) + plain_matching(x[0], y[0]))

    return 1 + rows(a.kids, b.kids)


def test_matching_is_largest():
    rng = random.Random(3)

    def grow(depth):
        t = wr.Tree(rng.choice("ab") if depth < 3 else "r", 1, 0, None, False)
        t.kids = [grow(depth - 1) for _ in range(rng.randint(0, 3))] if depth else []
        return t

    for _ in range(60):
        a, b = grow(3), grow(3)
        pairs = wr.matching(a, b)
        assert 1 + len(pairs) == plain_matching(a, b) and all(x.label == y.label for x, y in pairs)
