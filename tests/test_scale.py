"""Operators built for hot keys against brute force on small fixtures."""

import math
import random

import pytest
from pyspark.sql import functions as F

from shorelark.operators import places as pl
from shorelark.operators import scale as sc
from shorelark.operators.conditions import Clock, site_hours


def test_greedy_dedupe_equals_a_sequential_scan(spark):
    rng = random.Random(3)
    for n, a_keys, b_keys in ((60, 9, 9), (200, 40, 15), (150, 3, 80)):
        rows = [(i, rng.randrange(a_keys), rng.randrange(b_keys)) for i in range(n)]
        kept, seen_a, seen_b = [], set(), set()
        for i, a, b in rows:
            if a in seen_a or b in seen_b:
                continue
            kept.append(i)
            seen_a.add(a)
            seen_b.add(b)
        df = spark.createDataFrame(rows, "o int, a int, b int").repartition(4)
        got = sorted(r.o for r in sc.greedy_two_key_dedupe(df, "a", "b", "o").collect())
        assert got == kept


def test_greedy_dedupe_needs_the_kept_rows_only(spark):
    # row 1 is dropped by row 0, so its second key must not drop row 2
    rows = [(0, "x", "p"), (1, "x", "q"), (2, "y", "q")]
    df = spark.createDataFrame(rows, "o int, a string, b string")
    assert sorted(r.o for r in sc.greedy_two_key_dedupe(df, "a", "b", "o").collect()) == [0, 2]


def greedy(rows):
    kept, seen_a, seen_b = [], set(), set()
    for i, a, b in sorted(rows, key=lambda r: r[0]):
        if a not in seen_a and b not in seen_b:
            kept.append(i)
            seen_a.add(a)
            seen_b.add(b)
    return kept


def test_greedy_dedupe_of_a_long_chain_needs_few_rounds(spark, monkeypatch):
    rounds, rows = [], [(i, i // 2, (i + 1) // 2) for i in range(100_000)]  # every row hangs on the one before it
    plain = sc._greedy_round
    monkeypatch.setattr(sc, "_greedy_round", lambda live: rounds.append(1) or plain(live))
    df = spark.createDataFrame(rows, "o int, a int, b int").repartition(8)
    assert sorted(r.o for r in sc.greedy_two_key_dedupe(df, "a", "b", "o").collect()) == greedy(rows)
    assert len(rounds) <= 20


@pytest.mark.parametrize("most", [0, 30, 10_000])
def test_greedy_dedupe_by_components_and_by_rounds(spark, most):
    rng = random.Random(most)
    # crowded keys in rising order keep many rows open; null is a key as well
    rows = [(i, rng.choice([None, 1, i // 3, i // 7]), f"{rng.choice([i // 2, i // 5, 0])}") for i in range(400)]
    df = spark.createDataFrame(rows, "o int, a int, b string").repartition(4)
    assert sorted(r.o for r in sc.greedy_two_key_dedupe(df, "a", "b", "o", most).collect()) == greedy(rows)
    assert sc.greedy_two_key_dedupe(df.limit(0), "a", "b", "o").count() == 0


def test_components(spark):
    rng = random.Random(9)
    pairs = [(i, i + 1) for i in range(3000)] + [(rng.randrange(4000, 5000), rng.randrange(4000, 5000)) for _ in range(600)] + [(7000, 7000)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in pairs:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    rng.shuffle(pairs)
    got = {r.node: r.root for r in sc.components_of(spark.createDataFrame(pairs, "u int, v int"), 20).collect()}
    assert got == {x: find(x) for x in root}


def test_forward_fill_crosses_pages_and_blocks(spark):
    rng = random.Random(5)
    rows = [(s, p, i, rng.choice([None, None, None, f"{s}-{p}-{i}"])) for s in "ab" for p in range(23) for i in range(4)]
    want, last = {}, {}
    for s, p, i, v in rows:
        last[s] = v if v is not None else last.get(s)
        want[(s, p, i)] = last[s]
    df = spark.createDataFrame(rows, "s string, p int, i int, v string").repartition(5)
    got = {(r.s, r.p, r.i): r.out for r in sc.forward_fill(df, "s", "p", "i", "v", "out", pages_per_block=4).collect()}
    assert got == want


def test_mean_of_top_with_ties_and_hot_values(spark):
    rng = random.Random(7)
    rows = [(d, rng.choice([1.0, 3.5, rng.random() * 10])) for d in range(3) for _ in range(400)] + [(9, 2.0), (9, 4.0)] + [(8, None)]
    df = spark.createDataFrame(rows, "d int, v double")
    got = {r.d: (r.n, r.mean) for r in sc.mean_of_top(df, ["d"], "v", F.greatest(F.lit(5), F.floor(F.col("n") / 2)), 0.0, 10.0, 16).collect()}
    for d in (0, 1, 2, 9):
        values = sorted((v for k, v in rows if k == d and v is not None), reverse=True)
        top = values[: max(5, len(values) // 2)]
        assert got[d][0] == len(values)
        assert got[d][1] == pytest.approx(sum(top) / len(top))
    assert 8 not in got


def test_mean_of_top_with_a_million_values_in_one_bucket(spark):
    df = spark.range(1_000_000).select(F.lit(1).alias("d"), (F.lit(5.0) + F.col("id") / 1e12).alias("v")).unionAll(spark.createDataFrame([(1, 9.0), (1, 1.0)], "d int, v double"))
    got = sc.mean_of_top(df, ["d"], "v", F.floor(F.col("n") / 2), 0.0, 10.0, 256).first()
    top = [9.0] + [5.0 + i / 1e12 for i in range(500_000, 1_000_000)]
    assert (got.n, got.k) == (1_000_002, 500_001) and got.mean == pytest.approx(math.fsum(top) / len(top), rel=1e-12)


def test_nearest_feature_in_a_crowded_cell(spark):
    rng = random.Random(11)
    # a third of the features in one spot's surroundings, copies included, the rest scattered
    feats = [(i, -33.8 + rng.gauss(0, 0.0004), 151.28 + rng.gauss(0, 0.0004)) for i in range(300)]
    feats += [(300 + i, -33.8, 151.28) for i in range(50)] + [(350 + i, -33.9 + rng.random() / 5, 151.2 + rng.random() / 5) for i in range(400)]
    sites = [(i, -33.9 + rng.random() / 5, 151.2 + rng.random() / 5) for i in range(150)] + [(500 + i, -33.8 + rng.gauss(0, 0.001), 151.28) for i in range(50)]
    sites += [(900, 10.0, 10.0), (901, -33.8, 151.28)]
    want = {}
    for s, lat, lng in sites:
        hits = [(math.sqrt(((fl - lat) * 111) ** 2 + ((fg - lng) * 92) ** 2), f) for f, fl, fg in feats]
        hits = [h for h in hits if h[0] < 2.5]
        if hits:
            want[s] = min(hits)[1]
    s = spark.createDataFrame(sites, "site_id int, lat double, lng double")
    f = spark.createDataFrame(feats, "fid int, lat double, lng double").withColumn("ord", F.col("fid"))
    got = {r.site_id: r.fid for r in sc.nearest_within(s, f, "site_id", "fid", "ord").collect()}
    assert got == want
    assert got[901] == 300


def test_nearest_feature_exactly_on_the_radius_is_out(spark):
    s = spark.createDataFrame([(1, 0.0, 0.0)], "site_id int, lat double, lng double")
    f = spark.createDataFrame([(1, 2.5 / 111, 0.0, 1)], "fid int, lat double, lng double, ord int")
    d = math.sqrt((2.5 / 111 * 111) ** 2)
    assert sc.nearest_within(s, f, "site_id", "fid", "ord").count() == (1 if d < 2.5 else 0)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_typo_pairs_equal_all_pairs(spark):
    rng = random.Random(13)

    def word(n):
        return "".join(rng.choice("abc") for _ in range(n))

    known = {f"{word(rng.randrange(4, 12))}, t{rng.randrange(2)}" for _ in range(150)}
    todo = {f"{word(rng.randrange(4, 12))}, t{rng.randrange(2)}" for _ in range(80)} | {"abcab", "aabbccaab , t0"}
    want = set()
    for loc in todo:
        city, _, tail = (x.strip() for x in loc.partition(","))
        if not tail or len(city) < 5:
            continue
        for k in known:
            kc, _, kt = (x.strip() for x in k.partition(","))
            if kt == tail and kc != city:
                d = edit_distance(city, kc)
                if d <= (1 if len(city) <= 8 else 2):
                    want.add((loc, k, d))
    a = spark.createDataFrame([(x,) for x in todo], "loc string")
    b = spark.createDataFrame([(x,) for x in known], "loc string")
    assert {tuple(r) for r in pl.typo_edges(a, b).select("loc", "known_loc", "d").collect()} == want


def cache_frame(spark, rows):
    return spark.createDataFrame(rows, "loc string, lat double, lng double, approx boolean")


def test_ambiguous_spellings_are_left_alone(spark):
    cache = cache_frame(spark, [
        ("high springs, us", 1.0, 2.0, False), ("high springd, us", 1.0, 2.0, False), ("xunny town, fr", 1.0, 1.0, False),
        ("zunny town, fr", 3.0, 3.0, False), ("failed place, us", None, None, None), ("roughly here, us", 4.0, 4.0, True),
    ])
    todo = spark.createDataFrame([("high springx, us",), ("sunny town, fr",), ("failed placf, us",), ("roughly herf, us",)], "loc string")
    got = {r.loc: r.alias_of for r in pl.typo_match(todo, cache).collect()}
    assert got == {"high springx, us": "high springd, us"}


def test_a_repaired_location_repairs_a_later_one(spark):
    # b-word is one edit from the cache, c-word is two edits from the cache but one from the b-word
    cache = cache_frame(spark, [("aaaaaa, us", 1.0, 2.0, False)])
    todo = spark.createDataFrame([("aaaaab, us",), ("aaaabb, us",), ("aaabbb, us",), ("zzzzzz, germany",), ("nowhere else, mars",)], "loc string")
    gaz = spark.createDataFrame([("zzzzzz, germany", 5.0, 6.0, "Z", "de")], "query string, lat double, lng double, display string, country string")
    rev = spark.createDataFrame([("5.0,6.0", "de")], "key string, country string")
    got = {r.loc: (r.status, r.alias_of, r.lat) for r in pl.resolve_locations(todo, cache, gaz, rev).collect()}
    assert got["aaaaab, us"] == ("alias", "aaaaaa, us", 1.0)
    assert got["aaaabb, us"] == ("alias", "aaaaab, us", 1.0)
    assert got["aaabbb, us"] == ("alias", "aaaabb, us", 1.0)
    assert got["zzzzzz, germany"] == ("located", None, 5.0)
    assert got["nowhere else, mars"][0] == "failed"


@pytest.mark.parametrize("most", [0, 200_000])
def test_repairs_equal_a_sequential_run(spark, most):
    rng = random.Random(17)
    cache = {"".join(rng.choice("ab") for _ in range(7)) + ", us": (float(rng.randrange(3)), 0.0) for _ in range(6)}
    todo = sorted({"".join(rng.choice("ab") for _ in range(7)) + ", us" for _ in range(50)} - set(cache))
    state, want = {k: (v, False) for k, v in cache.items()}, {}
    for loc in todo:
        near = [(edit_distance(loc[:7], k[:7]), k) for k in state]
        near = sorted(x for x in near if x[0] == 1)
        spots = {state[k][0] for _, k in near}
        if near and len(spots) == 1:
            want[loc] = near[0][1]
            state[loc] = (state[near[0][1]][0], False)
    gaz = spark.createDataFrame([("none", 0.0, 0.0, "", "de")], "query string, lat double, lng double, display string, country string")
    rev = spark.createDataFrame([("0,0", "de")], "key string, country string")
    out = pl.resolve_locations(
        spark.createDataFrame([(x,) for x in todo], "loc string"), cache_frame(spark, [(k, *v, False) for k, v in cache.items()]), gaz, rev, most
    )
    assert {r.loc: r.alias_of for r in out.collect() if r.alias_of} == want


def test_rejected_and_unchecked_countries(spark):
    todo = spark.createDataFrame([("a, germany",), ("b, bonaire",), ("c, nowhere",)], "loc string")
    cache = cache_frame(spark, [("q", None, None, None)])
    gaz = spark.createDataFrame(
        [("a, germany", 1.0, 1.0, "A", "de"), ("b, bonaire", 2.0, 2.0, "B", "nl"), ("c, nowhere", 3.0, 3.0, "C", "xx")],
        "query string, lat double, lng double, display string, country string",
    )
    rev = spark.createDataFrame([("1.0,1.0", "fr"), ("2.0,2.0", "nl")], "key string, country string")
    got = {r.loc: (r.status, r.verified) for r in pl.resolve_locations(todo, cache, gaz, rev).collect()}
    assert got == {"a, germany": ("failed", None), "b, bonaire": ("located", True), "c, nowhere": ("located", False)}


def test_salted_fan_out_is_the_plain_join(spark):
    from shorelark.plans import conditions_queries as cq

    sf = "/root/testdata/sf0.001"
    frames = cq.sites(spark, sf), cq.marine(spark, sf), cq.weather(spark, sf), None, None, Clock(240, 249), 200, 230
    cols = ["site_id", "idx", "swell_h", "wind", "rain_mm"]
    one = site_hours(*frames, salts=1).select(*cols)
    many = site_hours(*frames, salts=7).select(*cols)
    assert one.count() == many.count() > 0
    assert one.exceptAll(many).isEmpty()


def test_first_by_keeps_whole_rows(spark):
    df = spark.createDataFrame([("a", 3, "x"), ("a", 1, None), ("b", 2, "z")], "k string, o int, v string")
    assert sorted(tuple(r) for r in sc.first_by(df, ["k"], ["o"]).collect()) == [("a", 1, None), ("b", 2, "z")]
    assert sorted(tuple(r) for r in sc.first_by(df, ["k"], ["o"], latest=True).collect()) == [("a", 3, "x"), ("b", 2, "z")]


def test_places_in_a_total_order(spark):
    rng = random.Random(21)
    # a third of the rows share one value; the rest has ties and nulls
    rows = [(i, rng.choice([7, 7, None, rng.randrange(50), i])) for i in range(5000)]
    df = spark.createDataFrame(rows, "i int, v int").repartition(6)
    got = {r.i: r.position for r in sc.global_position(df, [F.col("v").desc(), F.col("i").asc()]).collect()}
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == {i: n for n, (i, _) in enumerate(want, 1)}
    assert sc.global_position(df.limit(0), [F.col("i")]).count() == 0


def test_changed_rows_between_snapshots(spark):
    schema = "a string, b string, n int"
    rows = [(f"a{i}", None if i % 3 else f"b{i}", i % 5) for i in range(2000)] + [("x", None, 1), ("x", None, 1)]
    old = spark.createDataFrame(rows, schema).repartition(5)
    same = spark.createDataFrame(rows[::-1], schema).repartition(3)
    assert pl.changed_rows(old, same).count() == 0 and not pl.snapshot_changed(old, same)
    # one row less of two equal ones, one value that changes its column, one new row
    new = spark.createDataFrame([*rows[1:-1], (None, "a0", 0), ("y", None, None)], schema)
    got = {(r.a, r.b, r.n): r.delta for r in pl.changed_rows(old, new).collect()}
    assert got == {("a0", "b0", 0): -1, (None, "a0", 0): 1, ("x", None, 1): -1, ("y", None, None): 1}
    moved = pl.changed_rows(spark.createDataFrame([("v", None, 1)], schema), spark.createDataFrame([(None, "v", 1)], schema))
    assert moved.count() == 2
