"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shorelark.session import cut_lineage

#: Documents are cut into runs of about this many bytes before numpy looks at them.
RUN_BYTES = 1 << 20
#: Links that one task reduces to a forest.
LINKS_PER_TASK = 2_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rid, text): null texts are empty; rid tells rows apart whose doc_id is null or repeated.

    Rows that agree in doc_id and text share a rid, and so every result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.select("doc_id", F.xxhash64("doc_id", "text").alias("rid"), "text")


def beside(rows: DataFrame, more: DataFrame) -> DataFrame:
    """Left join on (doc_id, rid) with a table that has each pair once; null ids meet by rid."""
    right = more.withColumnRenamed("doc_id", "_id").withColumnRenamed("rid", "_rid")
    same = (F.col("rid") == F.col("_rid")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    return rows.join(right, same, "left").drop("_id", "_rid")


def looked_up(rows: DataFrame, table: DataFrame, key: str, spread_by: str, salts: int) -> DataFrame:
    """Left join of rows with a table that has each key once, safe for a key that holds a large share of the rows.

    The rows of a key are dealt over ``salts`` parts by ``spread_by``; the table's row is repeated for each part.
    The table should hold only the keys that need an answer, so the repetition stays small.
    """
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    right = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "_salt"], "left").drop("_salt")


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def runs(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = RUN_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about ``most`` bytes of text each; a longer text is a slice of its own."""
    for batch in batches:
        texts = byte_texts(batch.column(text))
        start = size = 0
        for i, t in enumerate(texts):
            if size and size + len(t) > most:
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(t)
        if len(texts) > start:
            yield batch.slice(start), texts[start:]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int | np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    factors = np.full(n, base, np.uint64)
    factors[:1] = 1
    return np.cumprod(factors, dtype=np.uint64)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links (u, v) of a task as stars: each node with the smallest one that it reaches here."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root.get(top, top) != top:
            top = root[top]
        while root.get(x, x) != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = find(u), find(v)
            root[max(a, b)] = root[min(a, b)] = min(a, b)
    nodes = [x for x in root if find(x) != x]
    for at in range(0, len(nodes), 50_000):
        part = nodes[at:at + 50_000]
        yield pa.RecordBatch.from_pydict({"u": pa.array(part, pa.int64()), "v": pa.array([find(x) for x in part], pa.int64())})


def _rooted(edges: DataFrame) -> DataFrame:
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)


def components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root) of every node of the links (a, b): the smallest node that it reaches. Nodes are 64-bit integers.

    First about LINKS_PER_TASK links at a time are reduced to a forest, so that a crowded group enters with few links for each
    of its nodes, however many it has. Where all links are so few, that is the answer. Else alternating stars: neighbours above a node move to the smallest neighbour, then those below it do. Each round
    ends in a reliable checkpoint; only a count and a checksum reach the driver.
    """
    given = cut_lineage(links.filter("a <> b").select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v")))
    parts = max(1, -(-given.count() // LINKS_PER_TASK))
    edges = cut_lineage(given.repartition(parts).mapInArrow(_forest, "u long, v long").distinct())
    if parts == 1:
        return _rooted(edges)
    seen = None
    for _ in range(most_rounds):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = cut_lineage(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return _rooted(edges)
        seen = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
