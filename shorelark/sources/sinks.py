"""Tables and documents written for readers outside Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shorelark.functions import text as tx

OPTIONAL = ("end", "url", "location", "description")


def event_documents(events: DataFrame, *carried: str) -> DataFrame:
    """Events as JSON objects with their id and the carried columns beside; empty optional fields are left out."""
    ident = tx.event_id(F.col("source"), F.col("title"), F.col("start"), F.col("url"))
    body = F.struct(
        ident.alias("id"), "source", "title", "start", "all_day",
        *[tx.none_if_empty(F.col(c)).alias(c) for c in OPTIONAL if c in events.columns],
    )
    return events.select("source", F.substring("start", 1, 7).alias("month"), ident.alias("id"), F.to_json(body).alias("json"), *carried)


def write_calendar(events: DataFrame, sources: DataFrame, lo: str, hi: str, stamp: str, zone: str, path: str) -> None:
    """The calendar document as a folder: a small header, the source rows, and the events by month.

    One file would pass everything through one task; the folder holds the same parts and grows.
    """
    spark = events.sparkSession
    docs = event_documents(events)
    docs.select("month", F.col("json").alias("value")).repartitionByRange("month", "value").write.mode("overwrite").partitionBy(
        "month"
    ).text(f"{path}/events")
    sources.select(F.to_json(F.struct(*sources.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/sources")
    header = F.struct(
        F.lit(stamp).alias("generated_at"), F.lit(zone).alias("timezone"),
        F.struct(F.lit(lo).alias("start"), F.lit(hi).alias("end")).alias("window"),
    )
    spark.range(1).select(F.to_json(header).alias("value")).write.mode("overwrite").text(f"{path}/header")


def write_lookup(lookup: DataFrame, path: str) -> None:
    """Location lookup, sorted by key across files."""
    lookup.repartitionByRange("loc").sortWithinPartitions("loc").write.mode("overwrite").parquet(path)


def write_entries(entries: DataFrame, path: str) -> None:
    """Day entries partitioned by month, so a month view reads one folder; days sorted inside."""
    rows = entries.withColumn("month", F.date_format("day", "yyyy-MM"))
    rows.repartitionByRange("month", "day", "start", "title").sortWithinPartitions("month", "day").write.mode(
        "overwrite"
    ).partitionBy("month").parquet(path)
