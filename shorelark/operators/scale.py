"""Operators that stay whole and exact when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shorelark.session import cut_lineage, parameter_frame, shuffle_partitions


def computed_once(df: DataFrame, *columns: Column | str) -> DataFrame:
    """A selection whose columns are computed once a row, however often later filters and columns name them.

    Catalyst copies an expression into the filters above it, once for every mention; what a generator puts out it can't copy.
    """
    return df.select(F.inline(F.array(F.struct(*columns))))


def global_position(df: DataFrame, order: list[Column], out: str = "position", parts: int | None = None) -> DataFrame:
    """Rows with their place (from 1) in an order over the whole table; no task sees more than its range of it.

    Rows are dealt by ranges of the order, sorted within a range and counted; a place is the count of all ranges before
    plus the place inside. Rows that tie in the whole order come in any order, so end it with something unique; that also
    lets a value that many rows share be split. One reliable checkpoint keeps places fixed if a task runs again; only
    a count per range reaches the driver.
    """
    dealt = df.repartitionByRange(parts or shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = cut_lineage(dealt.withColumns({"_range": F.spark_partition_id(), "_inside": inside}))
    sizes = {r["_range"]: r["n"] for r in placed.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()}
    bases, before = [], 1
    for number in sorted(sizes):
        bases.append((number, before))
        before += sizes[number]
    base = parameter_frame(df.sparkSession, bases, "_range int, _base bigint")
    return placed.join(base, "_range").withColumn(out, F.col("_base") + F.col("_inside")).drop("_range", "_inside", "_base")


def first_by(df: DataFrame, keys: list[str], order: list[str], latest: bool = False) -> DataFrame:
    """One row per key: the first (or last) in the given order.

    A min/max over a struct combines on the map side, so a hot key never gathers in one task.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.struct(*order, *rest)
    pick = F.max_by if latest else F.min_by
    picked = df.groupBy(*keys).agg(pick(packed, F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in order + rest]).select(*df.columns)


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key; the rank filter is applied before the shuffle as well."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def mean_of_top(
    df: DataFrame, keys: list[str], value: str, wanted: Column, lo: float, hi: float, buckets: int = 4096
) -> DataFrame:
    """Mean of the largest values per key, their number given by ``wanted`` (an expression over ``n``).

    Equal values are merged first, once. A histogram finds the bucket where the count is reached, a finer one is laid inside
    that bucket, and so on until it holds no more different values than a histogram has buckets: only these are ranked. No
    task sees more than that of a key, and the answer is exact.
    """
    merged = cut_lineage(df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c")))
    totals = merged.groupBy(*keys).agg(F.sum("_c").alias("n")).withColumn("_k", F.least(wanted, F.col("n")).cast("bigint"))
    inside = merged.withColumns({"_lo": F.lit(float(lo)), "_w": F.lit(float(hi - lo) / buckets)})
    state = totals.withColumns({"_need": F.col("_k"), "_above": F.lit(0.0)})
    down = W.partitionBy(*keys).orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, W.currentRow)
    while True:
        place = F.floor((F.col("_v") - F.col("_lo")) / F.col("_w"))
        placed = inside.withColumn("_b", F.greatest(F.lit(0), F.least(F.lit(buckets - 1), place)).cast("int"))
        hist = placed.groupBy(*keys, "_b").agg(F.sum("_c").alias("_c"), F.sum(F.col("_c") * F.col("_v")).alias("_s"), F.count(F.lit(1)).alias("_different"))
        upto = hist.withColumns({"_upto": F.sum("_c").over(down), "_sum_upto": F.sum("_s").over(down)}).join(state, keys)
        edge = cut_lineage(upto.filter((F.col("_upto") >= F.col("_need")) & (F.col("_upto") - F.col("_c") < F.col("_need"))).select(
            *keys, "_b", "n", "_k", (F.col("_need") - F.col("_upto") + F.col("_c")).alias("_need"),
            (F.col("_above") + F.col("_sum_upto") - F.col("_s")).alias("_above"), "_different",
        ))
        inside = cut_lineage(placed.join(edge.select(*keys, "_b"), [*keys, "_b"]).select(
            *keys, "_v", "_c", (F.col("_lo") + F.col("_b") * F.col("_w")).alias("_lo"), (F.col("_w") / buckets).alias("_w")
        ))
        state = edge.drop("_b", "_different")
        most, finest = edge.agg(F.max("_different")).first()[0] or 0, inside.agg(F.min("_w")).first()[0] or 0.0
        if most <= buckets or finest < 1e-300:
            break
    ranked = W.partitionBy(*keys).orderBy(F.desc("_v")).rowsBetween(W.unboundedPreceding, -1)
    taken = inside.join(state, keys).withColumn("_before", F.coalesce(F.sum("_c").over(ranked), F.lit(0))).withColumn(
        "_take", F.greatest(F.lit(0), F.least(F.col("_c"), F.col("_need") - F.col("_before")))
    )
    return taken.groupBy(*keys, "n", "_k", "_above").agg(F.sum(F.col("_take") * F.col("_v")).alias("_part")).select(
        *keys, F.col("n"), F.col("_k").alias("k"), ((F.col("_above") + F.col("_part")) / F.col("_k")).alias("mean")
    )


def forward_fill(
    df: DataFrame, source: str, page: str, pos: str, value: str, out: str, pages_per_block: int = 1000
) -> DataFrame:
    """Last non-null ``value`` so far within a source, in (page, pos) order, carried over page ends.

    Three bounded passes: inside a page, over the pages of a block, over the blocks of a source.
    ``page`` is an integer ordinal; a whole source is never ordered in one task.
    """
    inside = W.partitionBy(source, page).orderBy(pos).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = df.withColumn("_own", F.last(value, ignorenulls=True).over(inside))
    pages = (
        df.groupBy(source, page)
        .agg(F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.col(pos))).alias("_last"))
        .withColumn("_block", F.floor(F.col(page) / pages_per_block))
    )
    earlier_pages = W.partitionBy(source, "_block").orderBy(page).rowsBetween(W.unboundedPreceding, -1)
    pages = pages.withColumn("_in_block", F.last("_last", ignorenulls=True).over(earlier_pages))
    blocks = pages.groupBy(source, "_block").agg(
        F.max_by(F.col("_last"), F.when(F.col("_last").isNotNull(), F.col(page))).alias("_last")
    )
    earlier_blocks = W.partitionBy(source).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(source, "_block", F.last("_last", ignorenulls=True).over(earlier_blocks).alias("_carry"))
    carry = pages.join(blocks, [source, "_block"]).select(
        source, page, F.coalesce("_in_block", "_carry").alias("_before")
    )
    return rows.join(carry, [source, page]).withColumn(out, F.coalesce("_own", "_before")).drop("_own", "_before")


# ---- sequential rules on a graph ------------------------------------------

#: Rows of a component that one task may settle in order; larger components go by rounds.
COMPONENT_ROWS = 200_000


def components_of(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(node, root) of every node of the edges (u, v): the smallest node that it reaches.

    Every round a node takes the smallest grandparent among its neighbours, its parent takes it too, and it moves to its own
    grandparent: chains halve, so rounds grow with the logarithm of a component. Each round ends in a reliable checkpoint.
    """
    both = cut_lineage(edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    state = cut_lineage(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("root")))
    for _ in range(most_rounds):
        up = state.select(F.col("node").alias("root"), F.col("root").alias("high"))
        high = cut_lineage(state.join(up, "root"))  # node, root, high (the parent's parent)
        near = both.join(high.select(F.col("node").alias("v"), "high"), "v").groupBy("u").agg(F.min("high").alias("low"))
        known = high.join(near.withColumnRenamed("u", "node"), "node").withColumn("low", F.least("low", "high"))
        told = known.select("node", "low").unionAll(known.select(F.col("root").alias("node"), "low"))
        best = told.groupBy("node").agg(F.min("low").alias("low"))
        after = cut_lineage(state.join(best, "node").select("node", F.least("root", "low").alias("root"), (F.col("low") < F.col("root")).alias("moved")))
        state = after.drop("moved")
        if after.filter("moved").isEmpty():
            return state
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def settled_in_order(
    rows: DataFrame, roots: DataFrame, node: str, order: list[str], settle: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str, most: int
) -> tuple[DataFrame, DataFrame]:
    """Rows of components of at most ``most`` rows, each component in order through ``settle``; and the rows of larger ones.

    ``settle`` gets the rows of one component as tuples and yields tuples of ``schema``; a task holds what it remembers of one
    component at a time. ``roots`` (node, root) may lack nodes that are alone.
    """
    found = rows.join(roots.withColumnRenamed("node", node), node, "left").withColumn("_root", F.coalesce("root", node)).drop("root")
    found = cut_lineage(found)
    sizes = found.groupBy("_root").agg(F.count(F.lit(1)).alias("_n"))
    giants = sizes.filter(F.col("_n") > most).select("_root")
    names = [n for n in found.columns if n != "_root"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stream() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*[batch.column(c).to_pylist() for c in ("_root", *names)], strict=True)

        out = []
        for _, group in groupby(stream(), key=lambda r: r[0]):
            out += settle(r[1:] for r in group)
            if len(out) >= 20_000:
                yield to_batch(out)
                out = []
        if out:
            yield to_batch(out)

    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def to_batch(tuples: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*tuples, strict=True), arrow.types, strict=True)], schema=arrow)

    small = found.join(giants, "_root", "left_anti")
    dealt = small.repartition(shuffle_partitions(rows.sparkSession), "_root").sortWithinPartitions("_root", *order)
    return dealt.mapInArrow(walk, schema), found.join(giants, "_root", "left_semi").drop("_root")


def _greedy(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows (ordinal, first key, second key) in order: those whose keys no earlier kept row has."""
    first, second = set(), set()
    for o, a, b in rows:
        if a not in first and b not in second:
            first.add(a)
            second.add(b)
            yield (o,)


def _greedy_round(live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept rows, rows that stay open) of one round.

    A row that is the first under both keys is kept. A row behind exactly one open row under one key, and the first under the
    other, is kept if that one isn't: such rows form chains, which are followed by doubling up to a row of the first kind.
    """
    def second(key: str, first: str) -> DataFrame:
        return marked.filter(F.col("_o") > F.col(first)).groupBy(key).agg(F.min("_o").alias("_next" + key))

    first_a, first_b = live.groupBy("_a").agg(F.min("_o").alias("_fa")), live.groupBy("_b").agg(F.min("_o").alias("_fb"))
    marked = cut_lineage(live.join(first_a, "_a").join(first_b, "_b"))
    both = marked.join(second("_a", "_fa"), "_a", "left").join(second("_b", "_fb"), "_b", "left")
    o = F.col("_o")
    ahead = F.when((o == F.col("_fb")) & (o == F.col("_next_a")), F.col("_fa")).when((o == F.col("_fa")) & (o == F.col("_next_b")), F.col("_fb"))
    heads = marked.filter((o == F.col("_fa")) & (o == F.col("_fb")))
    chain = cut_lineage(both.select("_o", ahead.alias("_up"), F.lit(1).alias("_steps")).filter("_up is not null"))
    while True:
        higher = chain.select(F.col("_o").alias("_up"), F.col("_up").alias("_higher"), F.col("_steps").alias("_more"))
        after = cut_lineage(chain.join(higher, "_up", "left"))
        if after.filter("_higher is not null").isEmpty():
            break
        chain = after.select("_o", F.coalesce("_higher", "_up").alias("_up"), ((F.col("_steps") + F.coalesce("_more", F.lit(0))) % 2).alias("_steps"))
    told = chain.join(heads.select(F.col("_o").alias("_up")), "_up", "left_semi")
    kept = heads.select("_o").unionAll(told.filter("_steps % 2 = 0").select("_o"))
    winners = cut_lineage(marked.join(kept, "_o", "left_semi").select("_o", "_a", "_b"))
    rest = live.join(winners.select("_a"), "_a", "left_anti").join(winners.select("_b"), "_b", "left_anti")
    return winners, cut_lineage(rest)


def greedy_two_key_dedupe(df: DataFrame, key_a: str, key_b: str, ordinal: str, most: int = COMPONENT_ROWS) -> DataFrame:
    """Keep a row unless an earlier *kept* row has the same first or the same second key; null is a key like any other.

    Rows that agree in both keys are first reduced to the earliest one. Rounds settle rows that depend on one chain of open
    rows at most, as long as each settles half of what is open. Then the open rows are split into the components of the
    graph of their keys: a component of at most ``most`` rows is settled in order by one task, larger ones go on by rounds.
    """
    keys = [F.to_json(F.struct(F.col(k).alias("k"))).alias(n) for k, n in ((key_a, "_a"), (key_b, "_b"))]
    live = cut_lineage(df.select(*keys, F.col(ordinal).alias("_o")).groupBy("_a", "_b").agg(F.min("_o").alias("_o")).select("_o", "_a", "_b"))
    kind = df.schema[ordinal].dataType.simpleString()
    kept, n, split = [], live.count(), False
    while n:
        winners, live = _greedy_round(live)
        kept.append(winners.select("_o"))
        before, n = n, live.count()
        if n > before / 2 and not split:
            first_a, first_b = live.groupBy("_a").agg(F.min("_o").alias("v")), live.groupBy("_b").agg(F.min("_o").alias("v"))
            edges = live.join(first_a, "_a").unionByName(live.join(first_b, "_b")).select(F.col("_o").alias("u"), "v").filter("u <> v")
            small, live = settled_in_order(live, components_of(edges), "_o", ["_o"], _greedy, f"_o {kind}", most)
            kept.append(cut_lineage(small))
            live, split = cut_lineage(live), True
            n = live.count()
    if not kept:
        return df
    return df.join(reduce(DataFrame.unionAll, kept).withColumnRenamed("_o", ordinal), ordinal, "left_semi")


# ---- nearest feature ------------------------------------------------------

KM_PER_DEG_LAT, KM_PER_DEG_LNG = 111.0, 92.0  # fixed values: flat-earth kilometres per degree


def _axis_gap(x: Column, cell: Column, size: float) -> tuple[Column, Column]:
    """Least and greatest distance along one axis from a point to a cell."""
    lo, hi = cell * size, (cell + 1) * size
    least = F.greatest(F.lit(0.0), lo - x, x - hi)
    return least, F.greatest(F.abs(x - lo), F.abs(x - hi))


def nearest_within(
    sites: DataFrame, features: DataFrame, site_id: str, feature_id: str, ordinal: str, radius_km: float = 2.5,
    levels: int = 4, split: int = 8,
) -> DataFrame:
    """Nearest feature strictly inside the radius per site; the smallest ordinal wins ties.

    A pyramid of ever finer cells: a site keeps only cells that can still hold its nearest feature
    (least distance not above the smallest greatest distance of a non-empty cell), so a crowded cell
    is entered through its few closest sub-cells and never paired with all its features.
    """
    def xy(df: DataFrame) -> DataFrame:
        return df.withColumn("_x", F.col("lng") * KM_PER_DEG_LNG).withColumn("_y", F.col("lat") * KM_PER_DEG_LAT)

    sizes = [radius_km / split**i for i in range(levels)]
    # features on one spot: only the first can win
    spots = xy(
        features.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull()).groupBy("lat", "lng")
        .agg(F.min_by(F.struct(ordinal, feature_id), ordinal).alias("_f"))
    )
    for i, size in enumerate(sizes):
        spots = spots.withColumn(f"_cx{i}", F.floor(F.col("_x") / size)).withColumn(f"_cy{i}", F.floor(F.col("_y") / size))
    cells = [spots.select(*[c for j in range(i + 1) for c in (f"_cx{j}", f"_cy{j}")]).distinct() for i in range(levels)]

    points = xy(sites.select(site_id, "lat", "lng"))
    near = F.expr("sequence(-1, 1)")
    cand = (
        points.withColumn("_dx", F.explode(near)).withColumn("_dy", F.explode(near))
        .withColumn("_cx0", F.floor(F.col("_x") / sizes[0]) + F.col("_dx"))
        .withColumn("_cy0", F.floor(F.col("_y") / sizes[0]) + F.col("_dy"))
        .drop("_dx", "_dy").join(cells[0], ["_cx0", "_cy0"])
    )
    per_site = W.partitionBy(site_id)
    for i in range(levels):
        if i:
            parent = [f"_cx{i-1}", f"_cy{i-1}"]
            cand = cand.join(cells[i].select(*parent, f"_cx{i}", f"_cy{i}"), parent).drop(*parent)
        lx, gx = _axis_gap(F.col("_x"), F.col(f"_cx{i}"), sizes[i])
        ly, gy = _axis_gap(F.col("_y"), F.col(f"_cy{i}"), sizes[i])
        cand = (
            cand.withColumn("_least", lx * lx + ly * ly).withColumn("_most", gx * gx + gy * gy)
            .filter(F.col("_least") < radius_km * radius_km + 1e-9)
            .withColumn("_bound", F.min("_most").over(per_site))
            .filter(F.col("_least") <= F.col("_bound") + 1e-9).drop("_least", "_most", "_bound")
        )
    last = [f"_cx{levels-1}", f"_cy{levels-1}"]
    hits = cand.join(spots.select(*last, F.col("lat").alias("_flat"), F.col("lng").alias("_flng"), "_f"), last)
    north, east = (F.col("_flat") - F.col("lat")) * KM_PER_DEG_LAT, (F.col("_flng") - F.col("lng")) * KM_PER_DEG_LNG
    dist = F.sqrt(north * north + east * east)
    best = (
        hits.withColumn("_d", dist).filter(F.col("_d") < radius_km)
        .groupBy(site_id).agg(F.min(F.struct(F.col("_d"), F.col(f"_f.{ordinal}"), F.col(f"_f.{feature_id}"))).alias("_w"))
    )
    return best.select(site_id, F.col(f"_w.{feature_id}").alias(feature_id), F.col("_w._d").alias("distance_km"))
