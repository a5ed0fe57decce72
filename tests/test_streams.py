"""Incremental runs end where one batch run ends."""

from pyspark.sql import functions as F

from shorelark.session import scratch_path
from shorelark.streaming import ingest as st


def land(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_only_new_files_are_taken(spark):
    drop, (path, state) = scratch_path(spark, "drop"), st.stream_paths(spark, "out")
    schema = "id int, name string"

    def run():
        st.ingest(st.landed(spark, drop, schema), lambda df: st.first_seen(df, ["name"]), path, state)
        return sorted(r.name for r in spark.read.parquet(path).collect())

    land(spark, drop, [(1, "a"), (2, "b"), (3, "a")], schema)
    assert run() == ["a", "b"]
    assert run() == ["a", "b"]
    land(spark, drop, [(4, "b"), (5, "c")], schema)
    assert run() == ["a", "b", "c"]


def located(table):
    return {r.loc: r.lat for r in st.append_only(table.arrived()).collect()}


def test_append_only_table_retries_failures(spark):
    drop, (path, state) = scratch_path(spark, "drop"), st.stream_paths(spark, "cache")
    schema = "loc string, lat double, lng double"
    table = st.BatchTable(spark, path, schema)

    def run(state):
        st.maintain(st.landed(spark, drop, schema), table, state)
        return located(table)

    assert located(table) == {}
    land(spark, drop, [("a", 1.0, 1.0), ("b", None, None)], schema)
    assert run(state) == {"a": 1.0, "b": None}
    land(spark, drop, [("a", 9.0, 9.0), ("b", 2.0, 2.0), ("c", None, None)], schema)
    assert run(state) == {"a": 1.0, "b": 2.0, "c": None}
    assert run(state) == {"a": 1.0, "b": 2.0, "c": None}
    # a fresh checkpoint reads all files again and neither loses nor overwrites anything
    assert run(scratch_path(spark, "state")) == {"a": 1.0, "b": 2.0, "c": None}
    land(spark, drop, [("c", 3.0, 3.0)], schema)
    assert run(scratch_path(spark, "state")) == {"a": 1.0, "b": 2.0, "c": 3.0}
    small = table.compacted(scratch_path(spark, "small"), st.append_only)
    assert located(small) == {"a": 1.0, "b": 2.0, "c": 3.0} and small.arrived().count() == 3


def test_a_replayed_batch_counts_once(spark):
    table = st.BatchTable(spark, scratch_path(spark, "replay"), "loc string, lat double, lng double")
    rows = spark.createDataFrame([("a", 1.0, 1.0), ("b", None, None)], table.schema)
    for _ in range(2):
        table.add(rows, "r", 0)
    table.add(spark.createDataFrame([("a", 5.0, 5.0)], table.schema), "r", 1)
    assert table.arrived().count() == 3 and located(table) == {"a": 1.0, "b": None}


def test_batches_win_in_the_order_they_arrive(spark):
    # run names fall, answers rise, and all is added within moments: only the order of arrival may count
    table = st.BatchTable(spark, scratch_path(spark, "order"), "loc string, lat double, lng double")
    for run, batch, rows in (("z", 0, [("b", None, None)]), ("y", 5, [("a", 1.0, 1.0)]), ("x", 0, [("a", 2.0, 2.0), ("b", 3.0, 3.0)]), ("a", 9, [("b", 4.0, 4.0)])):
        table.add(spark.createDataFrame(rows, table.schema), run, batch)
    table.add(spark.createDataFrame([("a", 1.5, 1.5)], table.schema), "y", 5)  # a replay keeps its place
    assert located(table) == {"a": 1.5, "b": 3.0}
    assert {(r.run, r.arrival) for r in table.arrived().select("run", "arrival").collect()} == {("z", 1), ("y", 2), ("x", 3), ("a", 4)}


def test_first_seen_with_bounded_memory(spark):
    drop, (path, state) = scratch_path(spark, "drop"), st.stream_paths(spark, "out")
    schema = "name string, at timestamp"
    import datetime as dt

    for day, names in ((1, "ab"), (2, "bc"), (90, "z")):
        land(spark, drop, [(n, dt.datetime(2024, 1, 1) + dt.timedelta(days=day)) for n in names], schema)
        st.ingest(st.landed(spark, drop, schema), lambda df: st.first_seen(df, ["name"], "at"), path, state)
    assert sorted(r.name for r in spark.read.parquet(path).collect()) == ["a", "b", "c", "z"]


def test_latest_keeps_old_feeds(spark):
    drop, (path, state) = scratch_path(spark, "drop"), st.stream_paths(spark, "latest")
    schema = "feed string, fetched_s bigint, v int"
    table = st.BatchTable(spark, path, schema)
    for rows in ([("m", 100, 1), ("w", 100, 2)], [("m", 90, 7), ("m", 200, 3)]):
        land(spark, drop, rows, schema)
        st.maintain(st.landed(spark, drop, schema), table, state)
    latest = st.latest_by_key(["feed"], ["fetched_s"])(table.arrived())
    got = {r.feed: (r.v, r.stale) for r in st.with_staleness(latest, "fetched_s", 260, 120).collect()}
    assert got == {"m": (3, False), "w": (2, True)}
    assert latest.filter(F.col("v") == 7).isEmpty()
