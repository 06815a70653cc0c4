"""Streams over several files equal the batch result; late and repeated rows."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators.joins import sessionize
from tidemark.sources import publish
from tidemark.streaming import rollups as ro
from tidemark.streaming import state as st
from tidemark.streaming.merge import Merged

T0 = datetime(2024, 1, 1)
REQ = """event_id long, ts timestamp_ntz, node string, country string, client_ip string, bytes_sent long,
req_time_ms long, status int, user_id long"""
EV = """event_id long, idempotency_key string, vid string, user_id long, created_at timestamp_ntz, event_type string"""


@pytest.fixture(scope="module")
def requests(spark):
    rng = random.Random(1)
    rows = [(i, T0 + timedelta(seconds=rng.randint(0, 3600)), f"n{rng.randint(0, 1)}", rng.choice(["in", "us"]),
             f"ip{rng.randint(0, 30)}", rng.randint(1, 100), rng.randint(1, 1000), rng.choice([200, 404, 500]), rng.randint(0, 3))
            for i in range(2000)]
    return spark.createDataFrame(rows, REQ)


def as_stream(df, path, files=4):
    df.repartition(files).write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_parts_of_a_stream_merge_to_the_batch(spark, requests, tmp_path, rows):
    stream = as_stream(requests, str(tmp_path / "in"))
    spec = ro.ROLLUPS["country_minute"]
    ro.start_rollup(stream, spec, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert len(list((tmp_path / "out").glob("run=*/batch_id=*"))) == 4
    exact = ["bucket", "node", "country", "requests", "bytes", "req_time_sum", "client_ips"]
    got = ro.readout(ro.read_rollup(spark, spec, str(tmp_path / "out")))
    want = ro.readout(ro.rollup(requests, spec))
    assert rows(got, *exact) == rows(want, *exact)
    # a batch that runs again after a failure replaces its own part
    again = spark.read.parquet(str(tmp_path / "out")).filter("batch_id = 2").drop("run", "batch_id")
    kept = again.collect()
    spark.createDataFrame(kept, again.schema).write.mode("overwrite").parquet(str(next((tmp_path / "out").glob("run=*")) / "batch_id=2"))
    assert rows(ro.readout(ro.read_rollup(spark, spec, str(tmp_path / "out"))), *exact) == rows(want, *exact)


def test_coarser_grain_and_percentiles(requests, rows):
    spec = ro.ROLLUPS["stats_minute"]
    hour = ro.readout(ro.reroll(ro.rollup(requests, spec), spec, "1 hour", []))
    want = requests.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("bucket")).agg(
        F.count(F.lit(1)).alias("requests"), F.sum("bytes_sent").alias("bytes"), F.count_if(F.col("status") >= 400).alias("errors"))
    assert rows(hour, "bucket", "requests", "bytes", "errors") == rows(want)
    exact = {r.bucket: sorted(x[0] for x in requests.filter(F.date_trunc("hour", "ts").cast("timestamp_ntz") == r.bucket).select("req_time_ms").collect())
             for r in hour.collect()}
    for r in hour.collect():
        values = exact[r.bucket]
        for p, v in ((0.5, r.req_time_p50), (0.95, r.req_time_p95)):
            rank = sum(x <= v for x in values) / len(values)
            assert abs(rank - p) < 0.03


def test_filters_of_named_rollups(spark):
    base = spark.createDataFrame([(1, T0, "n", 200, 101, "/thumbs/a", 0, 5, 9, 1, 7), (2, T0, "n", 200, 9, "/vod/a", 1, 5, 9, 0, 7)],
                                 "event_id long, ts timestamp_ntz, node string, status int, body_bytes long, path string, is_stalled int, bytes_sent long, bytes_expect long, user_id long, stall_ms long").withColumn("base_path", F.lit("/m"))
    assert ro.rollup(base, ro.ROLLUPS["stream_empty_stub_minute"]).first().pattern == "thumbs"
    assert {r.pattern for r in ro.rollup(base, ro.ROLLUPS["stream_status_minute"]).collect()} == {"thumbs", "vod_map"}
    assert ro.rollup(base, ro.ROLLUPS["user_minute"]).first().user_id == 1
    r = ro.rollup(base, ro.ROLLUPS["stall_minute"]).first()
    assert (r.stalls, r.bytes_lost, r.stall_ms_sum) == (1, 4, 7)


def run(df, path, checkpoint):
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(
        availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def waves(spark, tmp_path, batches, schema):
    """One file per batch, read in order."""
    src = tmp_path / "in"
    for i, rows_ in enumerate(batches):
        spark.createDataFrame(rows_, schema).coalesce(1).write.parquet(str(src / f"w{i}"))
    import shutil

    flat = tmp_path / "flat"
    flat.mkdir()
    for i in range(len(batches)):
        part = next((src / f"w{i}").glob("part-*.parquet"))
        target = flat / f"{i}.parquet"
        shutil.copy(part, target)
        import os

        os.utime(target, (1_700_000_000 + i * 60,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(flat))


def test_watermark_keeps_four_minutes_late_and_drops_six(spark, tmp_path):
    def r(i, minutes):
        return (i, T0 + timedelta(minutes=minutes), "n", "us", "ip", 1, 1, 200, 1)

    stream = waves(spark, tmp_path, [[r(1, 10)], [r(6, 9.5)], [r(2, 6.2), r(3, 3.5)], [r(4, 30)], [r(5, 60)]], REQ)
    spec = ro.Rollup("t", "1 minute", ("node",), (ro.count("requests"),))
    got = run(ro.windowed_rollup(stream, spec), str(tmp_path / "out"), str(tmp_path / "cp"))
    found = {(r.bucket - T0).total_seconds() / 60: r.requests for r in got.collect()}
    assert found.get(6.0) == 1 and 3.0 not in found and found.get(10.0) == 1


def test_windowed_sessions_emit_closed_ones(spark, tmp_path):
    stream = waves(spark, tmp_path, [[ev(1, 1, 0), ev(2, 1, 20)], [ev(3, 1, 45), ev(4, 2, 45)], [ev(5, 1, 200)], [ev(6, 1, 400)]], EV)
    got = run(st.windowed_sessions(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    found = {(r.user_id, (r.started_at - T0).total_seconds() / 60): r.events for r in got.collect()}
    assert found.items() >= {(1, 0.0): 3, (2, 45.0): 1}.items()


def ev(i, user, minutes, kind="pageview", vid="v1", key=None):
    return (i, key or f"k{i}", vid, user, T0 + timedelta(minutes=minutes), kind)


def test_duplicate_keys_are_dropped(spark, tmp_path):
    stream = waves(spark, tmp_path, [[ev(1, 1, 0, key="a"), ev(2, 1, 1, key="b")], [ev(3, 1, 2, key="a"), ev(4, 1, 2, key="c")]], EV)
    got = run(st.dedup(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r.idempotency_key for r in got.collect()) == ["a", "b", "c"]


def test_skew_guard(spark):
    rows_ = [(1, T0 + timedelta(minutes=m), T0) for m in (-60, 0, 4, 5, 6)]
    df = spark.createDataFrame(rows_, "event_id long, created_at timestamp_ntz, received_at timestamp_ntz")
    got = sorted(r.t for r in st.with_skew_guard(df).select(F.col("created_at").cast("timestamp_ntz").alias("t")).collect())
    assert got == [T0 - timedelta(minutes=60), T0, T0, T0]


def test_state_tables_over_a_stream(spark, tmp_path):
    batches = [
        [ev(1, 1, 0, "subscription.created"), ev(2, 2, 0, "subscription.created", "v2"), ev(3, None, 1, vid="v3")],
        [ev(4, 1, 5, "subscription.canceled"), ev(5, 7, 6, vid="v2"), ev(9, 3, 9, "subscription.cancellation_scheduled", "v9")],
        [ev(6, 2, -5, "subscription.canceled", "v2"), ev(7, 4, 1, "subscription.reactivated", "v4")],  # a late cancel
    ]
    stream = waves(spark, tmp_path, batches, EV)
    st.start_subscription_state(stream, str(tmp_path / "s"), str(tmp_path / "s-cp")).awaitTermination()
    got = st.merge_subscription(spark.read.parquet(str(tmp_path / "s")))
    assert sorted((r.user_id, r.last_event_type) for r in got.collect()) == [(2, "subscription.created"), (4, "subscription.reactivated")]
    everything = spark.createDataFrame([r for b in batches for r in b], EV)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, st.subscription_state(everything).collect()))
    st.start_vid_map(stream, str(tmp_path / "v"), str(tmp_path / "v-cp")).awaitTermination()
    seen = {r.vid: r.user_id for r in st.merge_vid_map(spark.read.parquet(str(tmp_path / "v"))).collect()}
    assert seen == {"v1": 1, "v2": 7, "v4": 4, "v9": 3}
    ro.compact(spark, str(tmp_path / "v"), st.merge_vid_parts, str(tmp_path / "vc"))
    assert spark.read.parquet(str(tmp_path / "vc" / "rows")).count() == 4
    merged = st.merge_vid_map(ro.read_parts(spark, str(tmp_path / "v"), str(tmp_path / "vc")))
    assert {r.vid: r.user_id for r in merged.collect()} == seen


def test_sessions_of_a_stream_equal_batch(spark, tmp_path, rows):
    rng = random.Random(4)
    events = [ev(i, rng.randint(1, 3), rng.randint(0, 900)) for i in range(200)]
    stream = waves(spark, tmp_path, [events[i::3] for i in range(3)], EV)
    st.start_sessions(stream, str(tmp_path / "s"), str(tmp_path / "cp")).awaitTermination()
    got = st.read_sessions(spark.read.parquet(str(tmp_path / "s")))
    assert rows(got) == rows(sessionize(spark.createDataFrame(events, EV), "user_id", "created_at"))


def test_error_filter(spark):
    df = spark.createDataFrame([(1, 0, 200), (2, 1, 200), (3, 0, 404)], "id long, is_error int, status int")
    assert sorted(r.id for r in st.payment_errors(df).collect()) == [2, 3]


def sub_events(spark, rows):
    return spark.createDataFrame([(i, f"k{i}", f"v{u}", u, T0 + timedelta(days=d), f"subscription.{kind}") for i, (u, d, kind) in enumerate(rows)], EV)


def test_users_leave_the_stored_table_and_late_rows_do_not_bring_them_back(spark, tmp_path):
    table, cp = Merged(str(tmp_path / "t"), buckets=4, keep_days=10), str(tmp_path / "cp")
    inbox = str(tmp_path / "in")

    def run(rows, first=0):
        sub_events(spark, rows).withColumn("event_id", F.col("event_id") + first).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(EV).option("maxFilesPerTrigger", 1).parquet(inbox)
        st.start_subscription_table(stream, table, cp).awaitTermination()
        return sorted((r.user_id, r.last_event_type[13:]) for r in st.read_subscription_table(spark, table).collect())

    assert run([(1, 1, "created"), (2, 1, "created"), (3, 2, "created"), (None, 1, "created")]) == [(1, "created"), (2, "created"), (3, "created")]
    assert run([(1, 5, "canceled"), (2, 4, "billing_plan_change")], 10) == [(2, "billing_plan_change"), (3, "created")]
    assert table.stored(spark).count() == 3  # user 1 as a tombstone
    assert run([(1, 3, "reactivated"), (2, 2, "canceled")], 20) == [(2, "billing_plan_change"), (3, "created")]  # both late
    assert [r.user_id for r in table.lookup(spark, 1, 3).collect()] == [3]
    every = list(range(4, 40))  # all folders are rewritten, the tombstone has had its time
    got = run([(u, 30, "created") for u in every], 30)
    assert got == [(2, "billing_plan_change"), (3, "created"), *[(u, "created") for u in every]]
    assert 1 not in [r.user_id for r in table.stored(spark).collect()]


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    table = Merged(str(tmp_path / "t"), buckets=2)
    rows = st.subscription_rows(sub_events(spark, [(1, 1, "created"), (2, 1, "expired")]))
    assert table.merge(rows, "a", 0) and not table.merge(rows, "a", 0)
    assert table.merge(rows.limit(0), "a", 1) and not table.merge(rows, "a", 1)
    assert table.merge(rows, "b", 0)  # another stream may bring the same rows
    assert publish.current(spark, table.path).number == 3
    assert [r.user_id for r in table.read(spark).collect()] == [1]


def test_state_aggregations_hash_numbers(spark):
    df = sub_events(spark, [(1, 1, "created")])
    for frame in (st.subscription_state(df), st.subscription_rows(df), st.merge_vid_map(st.vid_map(df))):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "HashAggregate" in plan
