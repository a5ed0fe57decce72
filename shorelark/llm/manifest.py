"""A Merkle manifest of a dataset: one tree per group of rows, and one tree over the groups.

The place of a row in its group comes from bitmap ranks, not from sorting: ids are merged into 64-bit words of a bitmap
per group, of which only those in use are kept, and directories of popcounts over ever larger blocks tell how many ids
lie before a word. A row looks its word up and adds the bits below its own. Rows so placed fall into slot arrays keyed
by (group, slot / RUN); each array is reduced by several levels at once and gives one node of the next round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shorelark.llm.common import looked_up
from shorelark.operators.scale import global_position
from shorelark.session import cut_lineage

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A word holds 64 ids, an entry of a directory 2 ** FAN entries of the one below.
WORD, FAN = 6, 10
#: 2 ** LEVELS slots are one array.
LEVELS = 8
SALTS = 16
#: Stands for the word of rows without an id; no id has it.
NO_WORD = -(1 << 63)


@dataclass(frozen=True)
class Manifest:
    """``rows``: doc_id, grp, leaf, path, subroot, root and the carried columns; digests are 32 bytes. ``groups``: grp, subroot."""

    rows: DataFrame
    groups: DataFrame


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    """SHA-256 of the fields, each with its length before it."""
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


# ---- places by bitmap ranks -------------------------------------------------

def _directories(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(grp, word, bits, n, base, total) of every word, and (grp, base, total) of the rows without an id: ``base`` rows of the
    group come before."""
    numbered, blank = words.filter("word is not null"), words.filter("word is null")
    lo, hi = numbered.agg(F.min("word"), F.max("word")).first()
    tables = [numbered.select("grp", "word", "n")]
    while lo is not None and hi - lo >= 1 << FAN:
        lo, hi = lo >> FAN, hi >> FAN
        up = F.shiftright("word", FAN).alias("word")
        tables.append(cut_lineage(tables[-1].groupBy("grp", up).agg(F.sum("n").alias("n"))))
    # at the top a group has at most 2 ** FAN entries and one for all rows without an id
    group = W.partitionBy("grp")
    before = F.coalesce(F.sum("n").over(group.orderBy(F.col("word").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    top = tables[-1].unionByName(blank.select("grp", "word", "n"))
    top = cut_lineage(top.withColumns({"base": before, "total": F.sum("n").over(group)}))
    found = top.filter("word is not null")
    inside = W.partitionBy("grp", "up").orderBy("word").rowsBetween(W.unboundedPreceding, -1)
    for table in reversed(tables[:-1]):
        above = found.select("grp", F.col("word").alias("up"), F.col("base").alias("above"), "total")
        rows = table.withColumn("up", F.shiftright("word", FAN)).join(above, ["grp", "up"])
        found = rows.withColumn("base", F.col("above") + F.coalesce(F.sum("n").over(inside), F.lit(0))).drop("up", "above")
    directory = found.drop("n").join(numbered, ["grp", "word"])
    return directory, top.filter("word is null").select("grp", "base", "total")


def placed(rows: DataFrame) -> DataFrame:
    """Rows (grp, doc_id, leaf, ...) with ``slot`` (from 0, in the order of ids in the group) and ``n``, the size of the group.

    Rows without an id come first. A bit tells only one row of an id; rows in the words of ids that several rows have, and
    rows without an id, are placed by id, then digest of the leaf: only these are sorted, by ranges over all of them.
    """
    columns = rows.columns
    place = f"cast(doc_id & {(1 << WORD) - 1} as int)"
    rows = rows.withColumns({
        "word": F.shiftright("doc_id", WORD), "bit": F.expr(f"shiftleft(1L, {place})"), "lower": F.expr(f"~shiftleft(-1L, {place})"),
    })
    words = cut_lineage(rows.groupBy("grp", "word").agg(F.bit_or("bit").alias("bits"), F.count(F.lit(1)).alias("n")))
    directory, blank = _directories(words)
    several = F.col("n") > F.bit_count("bits")
    repeated, unnamed = words.agg(F.coalesce(F.max(several), F.lit(False)), F.count_if(F.col("word").isNull())).first()
    found = rows.join(directory.withColumnRenamed("n", "in_word"), ["grp", "word"])
    several = F.col("in_word") > F.bit_count("bits")
    below = F.bit_count(F.col("bits").bitwiseAND(F.col("lower")))
    out = found.filter(~several).select(*columns, (F.col("base") + below).alias("slot"), F.col("total").alias("n"))
    if not repeated and not unnamed:
        return out
    tied = found.filter(several).select(*columns, "word", "base", "total")
    if unnamed:
        nameless = looked_up(rows.filter("word is null"), blank, "grp", "leaf", SALTS)
        tied = tied.unionByName(nameless.select(*columns, F.lit(NO_WORD).alias("word"), "base", "total"))
    # rows that are equal in all they hold may take any of their places; the last key deals them out
    order = [F.col("grp"), F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("_any")]
    tied = global_position(tied.withColumns({"_any": F.rand(17), "_word": F.concat_ws(":", "word", "grp")}), order, "_at")
    first = tied.groupBy("_word").agg(F.min("_at").alias("_first"))
    tied = looked_up(tied, first, "_word", "_any", SALTS)
    slot = (F.col("base") + F.col("_at") - F.col("_first")).alias("slot")
    return out.unionByName(tied.select(*columns, slot, F.col("total").alias("n")))


# ---- levels -----------------------------------------------------------------

def _parent(children: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(c.hex().encode() for c in children)).digest()


def reduced(nodes: list[bytes], levels: int) -> tuple[list[bytes], list[bytes]]:
    """The nodes ``levels`` above, and the path of every node: per level the side of its sibling (L or R) and the sibling,
    or a dot where it has none."""
    rising = [nodes]
    for _ in range(levels):
        below = rising[-1]
        rising.append([_parent(below[i:i + 2]) for i in range(0, len(below), 2)])
    paths = [b""] * len(rising[-1])
    for level in reversed(rising[:-1]):
        steps = []
        for i in range(len(level)):
            other = i ^ 1
            steps.append((b"." if other >= len(level) else (b"L" if other < i else b"R") + level[other]) + paths[i >> 1])
        paths = steps
    return rising[-1], paths


def climbed(leaf: bytes, path: bytes) -> tuple[bytes, bytes]:
    """The root that a leaf and its path give, and the siblings of the path as hex text."""
    node, siblings, at = leaf, [], 0
    while at < len(path):
        side = path[at:at + 1]
        if side == b".":
            node, at = _parent([node]), at + 1
            continue
        other = path[at + 1:at + 33]
        node, at = _parent([other, node] if side == b"L" else [node, other]), at + 33
        siblings.append(other.hex().encode())
    return node, b"".join(siblings)


def _array(key: tuple, table: pa.Table) -> pa.Table:
    """One slot array: its nodes in their slots, reduced; the row in the first slot carries the node above."""
    run = (1 << LEVELS) - 1
    slots = [s & run for s in table.column("slot").to_pylist()]
    nodes: list[bytes | None] = [None] * len(slots)
    for slot, node in zip(slots, table.column("leaf").to_pylist(), strict=True):
        nodes[slot] = node
    if None in nodes:
        raise ValueError("two rows have one slot")
    top, paths = reduced(nodes, min(LEVELS, (table.column("n")[0].as_py() - 1).bit_length()))
    above = pa.array([None if s else top[0] for s in slots], pa.binary())
    return table.drop(["block"]).append_column("path", pa.array([paths[s] for s in slots], pa.binary())).append_column("above", above)


def _round(nodes: DataFrame) -> DataFrame:
    schema = T.StructType([*nodes.schema.fields, T.StructField("path", T.BinaryType()), T.StructField("above", T.BinaryType())])
    keyed = nodes.withColumn("block", F.shiftright("slot", LEVELS))
    return cut_lineage(keyed.groupBy("grp", "block").applyInArrow(_array, schema))


def levels_of(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Rounds over (grp, slot, n, leaf, ...) until every group is one node: their rows with paths, and (grp, subroot)."""
    rounds = [_round(leaves)]
    most = rounds[0].agg(F.max("n")).first()[0] or 0
    while True:
        most = (most + (1 << LEVELS) - 1) >> LEVELS
        up = rounds[-1].filter("above is not null").select(
            "grp", F.shiftright("slot", LEVELS).alias("slot"), F.shiftright(F.col("n") + ((1 << LEVELS) - 1), LEVELS).alias("n"), F.col("above").alias("leaf")
        )
        if most <= 1:
            return rounds, up.select("grp", F.col("leaf").alias("subroot"))
        rounds.append(_round(up))


def _downward(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Rows of the first round with their whole path; ``tops``: grp, path and what each row of a group gets."""
    above = tops.withColumn("slot", F.lit(0).cast("bigint"))
    for table in reversed(rounds):
        upper = above.withColumnsRenamed({"slot": "_block", "path": "_rest"})
        rows = table.drop("above", "n").withColumn("_block", F.shiftright("slot", LEVELS)).join(upper, ["grp", "_block"])
        above = rows.withColumn("path", F.concat("path", "_rest")).drop("_rest", "_block")
        if table is not rounds[0]:
            above = above.drop("leaf")
    return above


def build(
    docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = FIELDS, carry: dict[str, Column] | None = None
) -> Manifest:
    """The manifest of all rows; ``carry`` adds columns (over those of ``docs``) to the rows of the result.

    A leaf is the digest of the fields; rows of a group ascend by id, which is an integer. Rows without an id come before all
    others of their group, those of one id ascend by leaf; equal rows hold their places in any order. Groups ascend by the
    bytes of their name, null before all. Null fields differ from empty ones. Texts are hashed whole. Other columns are not
    read. An empty table gives no rows.
    """
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be an integer")
    name = F.when(F.col(group_col).isNull(), "-").otherwise(F.concat(F.lit(":"), F.col(group_col).cast("string")))
    leaf = leaf_digest(*[F.col(f) for f in fields])
    rows = docs.select(
        name.alias("grp"), F.col(id_col).cast("bigint").alias("doc_id"), leaf.alias("leaf"), *[c.alias(n) for n, c in (carry or {}).items()]
    )
    rounds, groups = levels_of(placed(rows))
    groups = cut_lineage(groups)
    order = global_position(groups, [F.col("grp")], "slot")
    known = order.select(F.lit("").alias("grp"), (F.col("slot") - 1).alias("slot"), F.lit(groups.count()).cast("bigint").alias("n"), F.col("subroot").alias("leaf"), F.col("grp").alias("name"))
    upper, root = levels_of(known)
    tops = _downward(upper, root.select("grp", F.lit(b"").alias("path"), F.col("subroot").alias("root")))
    tops = tops.select(F.col("name").alias("grp"), "path", F.col("leaf").alias("subroot"), "root")
    return Manifest(_downward(rounds, tops).drop("slot"), groups)


def checked(rows: DataFrame, leaf: str = "leaf") -> DataFrame:
    """Adds ``folded`` (the root that the column ``leaf`` and the row's path give) and ``siblings`` (SHA-256 of the path's
    digests as hex text)."""
    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [climbed(a, p) for a, p in zip(batch.column(leaf).to_pylist(), batch.column("path").to_pylist(), strict=True)]
            out = [pa.array([f for f, _ in found], pa.binary()), pa.array([hashlib.sha256(s).digest() for _, s in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], [*batch.schema.names, "folded", "siblings"])

    schema = T.StructType([*rows.schema.fields, T.StructField("folded", T.BinaryType()), T.StructField("siblings", T.BinaryType())])
    return rows.mapInArrow(climb, schema)
