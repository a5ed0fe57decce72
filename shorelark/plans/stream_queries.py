"""The streaming jobs run to the end of what has landed, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from shorelark.plans.registry import query
from shorelark.plans.standins import table
from shorelark.streaming import ingest as st


def _landed(spark, sf, name):
    return st.landed(spark, sf, table(spark, sf, name).schema, names=f"{name}.parquet")


@query("st01_incremental_ingest", "select event_type as source, user_id, cast(sum(value_cents) as bigint) as cents, count(*) as n from (select *, cast(round(value * 100) as bigint) as value_cents from events) x group by all")
def st01(spark, sf):
    path, state = st.stream_paths(spark, "ingest")

    def normalise(df):
        return df.select(F.col("event_type").alias("source"), "user_id", F.round(F.col("value") * 100).cast("bigint").alias("cents"))

    for _ in range(2):  # the second run finds nothing new
        st.ingest(_landed(spark, sf, "events"), normalise, path, state)
    return spark.read.parquet(path).groupBy("source", "user_id").agg(F.sum("cents").alias("cents"), F.count(F.lit(1)).alias("n"))


@query("st02_first_seen", "select distinct o_custkey, o_orderpriority from orders")
def st02(spark, sf):
    path, state = st.stream_paths(spark, "seen")
    keys = ["o_custkey", "o_orderpriority"]
    st.ingest(_landed(spark, sf, "orders"), lambda df: st.first_seen(df.select(*keys), keys), path, state)
    return spark.read.parquet(path)


@query("st02_first_seen_in_time", "select distinct event_type, user_id from events")
def st02_in_time(spark, sf):
    """Keys are remembered for a bounded time, here longer than the table's."""
    path, state = st.stream_paths(spark, "seen")
    keys = ["event_type", "user_id"]
    polls = _landed(spark, sf, "events").select(*keys, F.col("ts").cast("timestamp").alias("ts"))
    st.ingest(polls, lambda df: st.first_seen(df, keys, "ts", "60 days"), path, state)
    return spark.read.parquet(path).select(*keys)


@query(
    "st03_append_only_state",
    "select lower(p_name || ', ' || p_brand) as loc, max(case when p_partkey % 3 <> 0 then cast(p_partkey as double) end) as lat from part group by 1",
)
def st03(spark, sf):
    path, state = st.stream_paths(spark, "cache")
    known = st.BatchTable(spark, path, "loc string, lat double, lng double")
    k = F.col("p_partkey")
    tries = _landed(spark, sf, "part").select(
        F.lower(F.concat("p_name", F.lit(", "), "p_brand")).alias("loc"),
        F.when(k % 3 != 0, k.cast("double")).alias("lat"), F.when(k % 3 != 0, k.cast("double")).alias("lng"),
    )
    st.maintain(tries, known, state)
    return st.append_only(known.arrived()).select("loc", "lat")


@query(
    "st04_latest_per_feed",
    """select event_type as feed, event_id, 1706659200 - fetched_s >= 1800 as stale from (select event_type, event_id, cast(epoch_us(ts) // 1000000 as bigint) as fetched_s,
         row_number() over (partition by event_type order by ts desc, event_id desc) as rn from events) x where rn = 1""",
)
def st04(spark, sf):
    path, state = st.stream_paths(spark, "latest")
    latest = st.BatchTable(spark, path, "feed string, fetched_s bigint, ts timestamp, event_id bigint")
    polls = _landed(spark, sf, "events").select(
        F.col("event_type").alias("feed"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("fetched_s"),
        F.col("ts").cast("timestamp").alias("ts"), "event_id",
    )
    st.maintain(polls, latest, state)
    newest = st.latest_by_key(["feed"], ["ts", "event_id"])(latest.arrived())
    return st.with_staleness(newest, "fetched_s", 1706659200, 1800).select("feed", "event_id", "stale")
