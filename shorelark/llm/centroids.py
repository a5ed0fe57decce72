"""Clustering around centroids; the nearest one is found by Orchard search.

Every centroid has the list of all others, nearest first. A vector walks the list of its current centroid. As soon as
a closer one is met, the walk goes on in the list of that one; centroids met before are not compared again. It ends
strictly beyond twice the current distance: by the triangle inequality nothing there is as close. All figures are
integers, so every machine and every order of rows gives the same clusters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shorelark.session import cut_lineage

CENTROIDS, ROUNDS, COMPONENTS, STEPS_PER_UNIT = 40, 5, 64, 256
#: Magnitudes up to here keep the squared distance of 64 components inside 64 bits.
MOST = 1 << 27
#: Vectors that walk side by side.
WALKING = 4096


@dataclass(frozen=True)
class Clusters:
    """``rows``: vec_id, cluster, distance (squared); ``centroids``: cluster, components, size, inertia."""

    rows: DataFrame
    centroids: DataFrame
    inertia: int


def whole_vectors(column: pa.Array, components: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors that have all their components, and these in whole steps."""
    lists = column.cast(pa.list_(pa.float64()))
    sized = np.flatnonzero(lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == components)
    flat = lists.take(pa.array(sized)).flatten().to_numpy(zero_copy_only=False).reshape(-1, components)
    good = np.isfinite(flat).all(axis=1)
    with np.errstate(over="ignore"):  # a product beyond the doubles is refused below as well
        stepped = np.floor(flat[good] * float(steps))
    if stepped.size and not np.abs(stepped).max() <= MOST:
        raise ValueError(f"a component is beyond {MOST // steps} in magnitude; its squared distances may not fit 64 bits")
    return sized[good], stepped.astype(np.int64)


def neighbour_lists(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per centroid all others, nearest first, and a quarter (rounded up) of their squared distances."""
    k = len(centroids)
    gaps = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    order = np.argsort(gaps, axis=1, kind="stable")
    order = order[order != np.arange(k)[:, None]].reshape(k, k - 1)
    return order, (np.take_along_axis(gaps, order, axis=1) + 3) // 4


def nearest(vectors: np.ndarray, centroids: np.ndarray, lists: np.ndarray, quarters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (the smaller of equally near ones) and its squared distance, by Orchard search."""
    n, k = len(vectors), len(centroids)
    at = np.zeros(n, np.int64)
    distance = ((vectors - centroids[0]) ** 2).sum(axis=1)
    met = np.zeros((n, k), bool)
    met[:, 0] = True
    place = np.zeros(n, np.int64)
    walking = np.arange(n)
    while walking.size:
        walking = walking[place[walking] < k - 1]
        # squared: gap > 4 * distance is the same as its quarter, rounded up, > distance
        walking = walking[quarters[at[walking], place[walking]] <= distance[walking]]
        other = lists[at[walking], place[walking]]
        place[walking] += 1
        new = ~met[walking, other]
        rows, other = walking[new], other[new]
        met[rows, other] = True
        gap = ((vectors[rows] - centroids[other]) ** 2).sum(axis=1)
        closer = (gap < distance[rows]) | ((gap == distance[rows]) & (other < at[rows]))
        rows, other = rows[closer], other[closer]
        at[rows], distance[rows], place[rows] = other, gap[closer], 0
    return at, distance


def _walks(vectors: np.ndarray, centroids: np.ndarray, lists: np.ndarray, quarters: np.ndarray):
    for start in range(0, len(vectors), WALKING):
        part = vectors[start:start + WALKING]
        yield start, part, *nearest(part, centroids, lists, quarters)


def cluster(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS,
    components: int = COMPONENTS, steps: int = STEPS_PER_UNIT, salt: str = "2:",
) -> Clusters:
    """Clusters of the vectors with exactly ``components`` components, none null or non-finite; each counts in whole steps
    (the floor of ``steps`` times it).

    The first centroids are the ``k`` vectors whose id, behind ``salt``, has the smallest SHA-256; fewer vectors give fewer
    centroids. Each round assigns all vectors and moves every non-empty centroid to the floor of the mean; then all are
    assigned once more. Other vectors and null vectors get no row; an empty table gives none. A null id comes after all
    others in the choice of centroids; equal ids are chosen in the order of their vectors, and repeated rows count each.
    Other columns are not read. A component beyond 2**27 steps is refused with an error.

    Each round is one scan of the vectors with partial sums per task; the driver holds the k centroids and nothing that
    grows with the table.
    """
    source = table.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, vectors = whole_vectors(batch.column("v"), components, steps)
            offsets = pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * components)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(rows)), pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel()))], ["vec_id", "v"]
            )

    id_type = source.schema["vec_id"].dataType.simpleString()
    named = source.mapInArrow(kept, f"vec_id {id_type}, v array<bigint>")
    digest = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    first = named.select(digest.alias("digest"), "v").orderBy(F.col("digest").asc_nulls_last(), "v").limit(k).collect()
    centroids = np.array([r["v"] for r in first], np.int64).reshape(len(first), components)
    if not len(centroids):
        spark = table.sparkSession
        return Clusters(
            spark.createDataFrame([], f"vec_id {id_type}, cluster int, distance bigint"),
            spark.createDataFrame([], "cluster int, components array<bigint>, size bigint, inertia bigint"), 0,
        )

    for _ in range(rounds):
        centroids = _moved(source, centroids, components, steps)

    lists, quarters = neighbour_lists(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, vectors = whole_vectors(batch.column("v"), components, steps)
            for start, part, at, distance in _walks(vectors, centroids, lists, quarters):
                ids = batch.column("vec_id").take(pa.array(rows[start:start + len(part)]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(at.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    rows = cut_lineage(source.mapInArrow(assign, f"vec_id {id_type}, cluster int, distance bigint"))
    sums = rows.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()
    size, inertia = {r["cluster"]: r["n"] for r in sums}, {r["cluster"]: int(r["d"]) for r in sums}
    final = [(i, [int(x) for x in c], size.get(i, 0), inertia.get(i, 0)) for i, c in enumerate(centroids)]
    frame = table.sparkSession.createDataFrame(final, "cluster int, components array<bigint>, size bigint, inertia bigint")
    return Clusters(rows, frame, sum(inertia.values()))


def _moved(source: DataFrame, centroids: np.ndarray, components: int, steps: int) -> np.ndarray:
    """One round: sums per centroid and component from every task, then the floors of the means."""
    lists, quarters = neighbour_lists(centroids)
    k = len(centroids)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, sizes = np.zeros((k, components), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            _, vectors = whole_vectors(batch.column("v"), components, steps)
            for _, part, at, _ in _walks(vectors, centroids, lists, quarters):
                for c in np.unique(at):
                    sums[c] += part[at == c].sum(axis=0)
                sizes += np.bincount(at, minlength=k)
        used = np.flatnonzero(sizes)
        # the size of a cluster goes along as one more component
        table = np.concatenate([sums[used], sizes[used, None]], axis=1)
        yield pa.RecordBatch.from_pydict({
            "cluster": pa.array(np.repeat(used, components + 1).astype(np.int32)),
            "component": pa.array(np.tile(np.arange(components + 1, dtype=np.int32), len(used))), "total": pa.array(table.ravel()),
        })

    found = source.select("v").mapInArrow(gather, "cluster int, component int, total bigint")
    totals = np.zeros((k, components + 1), object)
    for row in found.groupBy("cluster", "component").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        totals[row["cluster"], row["component"]] = int(row["total"])
    sizes = totals[:, -1]
    return np.array([
        [int(x) // int(n) for x in row[:-1]] if n else list(old) for row, n, old in zip(totals, sizes, centroids, strict=True)
    ], np.int64).reshape(k, components)
