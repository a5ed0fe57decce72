"""The scheduled polls as Structured Streaming jobs that take what is new and stop."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shorelark.operators.scale import first_by
from shorelark.session import scratch_path


def landed(
    spark: SparkSession, folder: str, schema, kind: str = "parquet", names: str | None = None, files_per_trigger: int | None = None
) -> DataFrame:
    """A drop folder as a stream; files already taken are remembered in the checkpoint."""
    reader = spark.readStream.format(kind).schema(schema)
    if names:
        reader = reader.option("pathGlobFilter", names)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder)


def run_to_end(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def ingest(stream: DataFrame, normalise: Callable[[DataFrame], DataFrame], path: str, state: str) -> None:
    """New files through a normaliser into a table."""
    run_to_end(
        normalise(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", state)
        .outputMode("append").trigger(availableNow=True).start()
    )


def first_seen(stream: DataFrame, keys: list[str], when: str | None = None, delay: str = "30 days") -> DataFrame:
    """Rows whose key was not seen in an earlier poll. A time column bounds the remembered keys."""
    if when:
        return stream.withWatermark(when, delay).dropDuplicatesWithinWatermark(keys)
    return stream.dropDuplicates(keys)


class BatchTable:
    """A keyed table kept as what arrived: every batch adds its rows, and the winner of a key is chosen on reading.

    A batch owns the folder named by its checkpoint and its number. Replayed, it writes that folder again; a new
    checkpoint starts folders of its own, so nothing of an earlier run is overwritten or forgotten. Batches are numbered as
    they arrive, whatever the clock says; a replayed batch keeps its number.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def arrived(self) -> DataFrame:
        """All rows with arrival (the number of their batch in the order of arrival), run and batch."""
        kept = f"{self.schema}, arrival bigint, run string, batch bigint"
        try:
            return self.spark.read.schema(kept).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], kept)

    def add(self, df: DataFrame, run: str, batch: int) -> None:
        same = (F.col("run") == run) & (F.col("batch") == batch)
        last, own = self.arrived().agg(F.max("arrival"), F.max(F.when(same, F.col("arrival")))).first()
        number = own if own is not None else (last or 0) + 1
        columns = self.spark.createDataFrame([], self.schema).columns
        df.select(*columns, F.lit(number).cast("bigint").alias("arrival")).write.mode("overwrite").parquet(f"{self.path}/run={run}/batch={batch}")

    def compacted(self, path: str, winners: Callable[[DataFrame], DataFrame]) -> BatchTable:
        """A new table that holds only the winners; they have arrived before anything that is added to it."""
        small = BatchTable(self.spark, path, self.schema)
        rows = winners(self.arrived()).withColumn("arrival", F.lit(0).cast("bigint"))
        rows.write.mode("overwrite").parquet(f"{small.path}/run=compacted/batch=0")
        return small


def maintain(stream: DataFrame, table: BatchTable, state: str) -> None:
    """Every new batch into the table."""
    run = hashlib.sha256(state.encode()).hexdigest()[:16]

    def batch(df: DataFrame, batch_id: int) -> None:
        table.add(df, run, batch_id)

    run_to_end(
        stream.writeStream.foreachBatch(batch).option("checkpointLocation", state).trigger(availableNow=True).start()
    )


def append_only(arrived: DataFrame) -> DataFrame:
    """Located entries are never overwritten, failed ones retried: the first batch that located a place has it.

    Batches come in the order of their numbers; of several answers in one batch the largest holds.
    """
    found = F.col("lat").isNotNull()
    order = F.struct(-F.col("arrival"), "run", "batch", "lat", "lng")
    return arrived.groupBy("loc").agg(F.max(F.when(found, order)).alias("_p")).select("loc", "_p.lat", "_p.lng")


def latest_by_key(keys: list[str], order: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Newest snapshot per key; keys without news keep what they had."""
    def winners(arrived: DataFrame) -> DataFrame:
        return first_by(arrived, keys, [*order, "arrival"], latest=True).drop("arrival", "run", "batch")

    return winners


def with_staleness(latest: DataFrame, fetched: str, now_s: int, ttl_s: int) -> DataFrame:
    return latest.withColumn("stale", F.lit(now_s) - F.col(fetched) >= ttl_s)


def stream_paths(spark: SparkSession, label: str) -> tuple[str, str]:
    root = scratch_path(spark, label)
    return f"{root}/table", f"{root}/state"
