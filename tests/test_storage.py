from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.sources import clustered, files, io, publish
from tidemark.sources.schemas import USER_DAY_TASK


def test_bad_value_stops_the_read(spark, tmp_path):
    (tmp_path / "task_1.tsv").write_text("1\t2024-01-01\t1\t2\t3\n")
    (tmp_path / "task_2.tsv").write_text("1\t2024-01-02\tx\t2\t3\n")
    good = io.read_typed(spark, str(tmp_path / "task_1*"), USER_DAY_TASK)
    assert good.first().day == date(2024, 1, 1)
    with pytest.raises(Exception, match="(?i)malformed"):
        io.read_typed(spark, str(tmp_path / "task_*"), USER_DAY_TASK).collect()


def test_empty_glob_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="(?i)path"):
        io.read_typed(spark, str(tmp_path / "none_*"), USER_DAY_TASK)


def test_types_by_name(spark):
    df = spark.createDataFrame([("7", "2024-01-02", "1.5", "1", "9", "", "2024-01-02 03:04:05")],
                               "user_id string, send_date string, label_rev_365 string, seg_x string, n string, gb_7d string, last_at string")
    typed = io.cast_by_name(df)
    assert dict(typed.dtypes) == {"user_id": "bigint", "send_date": "date", "label_rev_365": "double", "seg_x": "tinyint",
                                  "n": "string", "gb_7d": "double", "last_at": "timestamp_ntz"}
    assert typed.first().gb_7d is None and io.cast_by_name(df, empty_default=True).first().gb_7d == 0.0
    assert io.cast_by_name(spark.range(1).withColumnRenamed("id", "txns")).dtypes == [("txns", "bigint")]


def test_write_list_counts_and_splits(spark, tmp_path):
    df = spark.range(30).select("id", (F.col("id") % 3).alias("g"))
    assert io.write_list(df, str(tmp_path / "a"), by="g", count=True) == 30
    assert sorted(p.name for p in (tmp_path / "a").glob("g=*")) == ["g=0", "g=1", "g=2"]
    assert io.write_list(df.filter("g = 1"), str(tmp_path / "a"), by="g", count=True) == 10
    assert sorted(p.name for p in (tmp_path / "a").glob("g=*")) == ["g=1"]
    assert io.write_list(df.filter("g > 5"), str(tmp_path / "a"), by="g", count=True) == 0
    assert io.export_segments([("x", df), ("y", df.filter("g = 1"))], str(tmp_path / "s")) == {"x": 30, "y": 10}
    assert io.read_inferred(spark, str(tmp_path / "s" / "x"), ",").count() == 30


def test_gzip_panel_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, date(2024, 1, 1), "us", 2.5, 1)], "user_id long, send_date date, country string, ltv_usd double, ever_paid int")
    io.write_list(df, str(tmp_path / "p"), compression="gzip")
    assert list((tmp_path / "p").glob("*.csv.gz"))
    got = io.read_panel(spark, str(tmp_path / "p"), ["user_id", "send_date", "ltv_usd"])
    assert tuple(got.first()) == (1, date(2024, 1, 1), 2.5)


def test_refresh_only_missing_months(spark, tmp_path):
    path, asked = str(tmp_path / "m"), []

    def extract(first, last):
        asked.append((first, last))
        months = spark.createDataFrame([(m,) for m in io.months_between(first, last)], "month int")
        return months.select(F.explode(F.sequence(F.lit(1), F.col("month") % 100)).alias("id"), "month")

    assert io.months_between(202311, 202402) == [202311, 202312, 202401, 202402]
    assert io.refresh_months(spark, extract, path, [202311, 202312]) == [202311, 202312]
    assert io.refresh_months(spark, extract, path, [202311, 202312, 202401], always=[202312]) == [202312, 202401]
    assert asked == [(202311, 202312), (202312, 202401)]
    assert io.read_months(spark, path).count() == 11 + 12 + 1
    assert io.read_months(spark, path, [202401]).count() == 1
    assert io.drop_expired(spark, path, "month", 202401) == [202311, 202312]
    assert io.partition_values(spark, path, "month") == [202401] and io.read_months(spark, path).count() == 1
    assert io.partition_values(spark, path + "-none", "month") == []


def test_history_snapshots_and_drift(spark, tmp_path):
    path = str(tmp_path / "h")
    one = spark.createDataFrame([(1, "a")], "user_id long, x string")
    assert io.append_snapshot(one, path, date(2024, 1, 1)) == "new"
    assert io.append_snapshot(one.union(one), path, date(2024, 1, 1)) == "same"
    assert io.read_history(spark, path).count() == 2
    wider = one.withColumn("y", F.lit(5))
    with pytest.raises(ValueError, match="y"):
        io.append_snapshot(wider, path, date(2024, 1, 2), "fail")
    assert io.append_snapshot(wider, path, date(2024, 1, 2)) == "evolved"
    got = io.read_history(spark, path)
    assert got.count() == 3 and got.filter("y IS NULL").count() == 2
    assert io.append_snapshot(one, path, date(2024, 1, 3), "reset") == "reset"
    assert [r.snapshot_date for r in io.read_history(spark, path).collect()] == [date(2024, 1, 3)]


def test_replace_one_campaign(spark, tmp_path):
    path = str(tmp_path / "c")
    io.replace_campaign(spark.createDataFrame([(1, "a"), (2, "b")], "user_id long, campaign string"), path)
    io.replace_campaign(spark.createDataFrame([(9, "a")], "user_id long, campaign string"), path)
    assert sorted((r.user_id, r.campaign) for r in spark.read.parquet(path).collect()) == [(2, "b"), (9, "a")]


def test_managed_table_is_replaced(spark):
    for n in (3, 2):
        table = io.save_table(spark.range(n).withColumnRenamed("id", "user_id"), "lists_test")
        assert table.count() == n
    spark.sql("DROP TABLE lists_test")


def test_null_report(spark):
    df = spark.createDataFrame([(1, None), (2, datetime(2024, 1, 1))], "a int, b timestamp_ntz")
    assert sorted(tuple(r) for r in io.null_report(df, ["a", "b"]).collect()) == [(2, "a", 0), (2, "b", 1)]


def test_bucketed_tables_join_without_a_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        a = io.save_table(spark.range(1000).withColumnRenamed("id", "user_id"), "bucket_a", buckets=4)
        b = io.save_table(spark.range(500).select(F.col("id").alias("user_id"), F.lit(1).alias("x")), "bucket_b", buckets=4)
        joined = a.join(b, "user_id", "left")
        assert joined.count() == 1000
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("bucket_a", "bucket_b"):
            spark.sql(f"DROP TABLE {name}")


def test_refresh_is_published_at_once(spark, tmp_path):
    path, seen = str(tmp_path / "m"), []

    def extract(first, last):
        if files.exists(spark, path):  # a reader between the writes of one refresh
            seen.append(sorted({r.month for r in io.read_months(spark, path).collect()}))
        months = spark.createDataFrame([(m,) for m in io.months_between(first, last)], "month int")
        return months.select(F.col("month").cast("long").alias("id"), "month")

    io.refresh_months(spark, extract, path, [202301])
    before = io.read_months(spark, path)
    io.refresh_months(spark, extract, path, [202212, 202301, 202303, 202305])
    assert seen == [[202301]] * 3  # three stretches were written, none was seen before the last
    assert io.partition_values(spark, path, "month") == [202212, 202301, 202303, 202305]
    assert before.count() == 1 and io.read_months(spark, path).count() == 4
    with pytest.raises(ZeroDivisionError):
        io.refresh_months(spark, lambda first, last: extract(first, last) if first < 202400 else 1 / 0, path, [202310, 202401])
    assert io.read_months(spark, path).count() == 4


def test_one_of_two_writers_wins(spark, tmp_path):
    path = str(tmp_path / "p")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "x long, g string")
    schema, staged = publish.stage(rows, path, "g")
    first = publish.commit(spark, path, None, "g", schema, staged, notes={"run": 3})
    second = publish.commit(spark, path, first, "g", schema, publish.stage(rows.filter("x = 1").withColumn("x", F.lit(9).cast("long")), path, "g")[1])
    with pytest.raises(publish.Conflict):
        publish.commit(spark, path, first, "g", schema, {})
    with pytest.raises(ValueError, match="partitioned"):
        publish.commit(spark, path, second, "x", schema, {})
    assert sorted(r.x for r in publish.read(spark, path).collect()) == [2, 3, 9]
    assert sorted(r.x for r in publish.read(spark, path, first).collect()) == [1, 2, 3]
    assert [r.x for r in publish.read(spark, path, values=[None]).collect()] == [3]
    assert publish.read(spark, path, values=["z"]).count() == 0
    assert publish.current(spark, path) == second and second.notes == {"run": 3}
    assert publish.vacuum(spark, path, keep=1) == 1
    assert sorted(r.x for r in publish.read(spark, path).collect()) == [2, 3, 9]
    assert publish.current(spark, path + "-none") is None


def test_counts_come_from_the_writing_job(spark, tmp_path):
    df = spark.range(1000).withColumn("g", F.col("id") % 4)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("counted", "")
    try:
        assert io.write_list(df, str(tmp_path / "n"), fmt="parquet", count=True) == 1000
        assert len(tracker.getJobIdsForGroup("counted")) == 1
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def scanned_rows(df):
    """Rows that came out of the Parquet scans of a frame after it has run."""
    plan = df._jdf.queryExecution().executedPlan()
    df.collect()
    found, left = 0, [plan]
    while left:
        node = left.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            left.append(node.executedPlan())
            continue
        if "QueryStage" in node.nodeName():
            left.append(node.plan())
            continue
        if node.nodeName().startswith("Scan parquet"):
            found += node.metrics().apply("numOutputRows").value()
        children = node.children()
        left += [children.apply(i) for i in range(children.size())]
    return found


@pytest.fixture(scope="module")
def by_user(spark, tmp_path_factory):
    """A tenth of all rows belong to one user, and some to none."""
    path = str(tmp_path_factory.mktemp("clustered") / "events")
    events = spark.range(60_000).select(
        F.when(F.col("id") % 10 == 0, 7).when(F.col("id") % 997 == 1, None).otherwise(F.col("id") % 5000).cast("long").alias("user_id"),
        F.col("id").alias("at"), F.sha2(F.col("id").cast("string"), 256).alias("vid"))
    clustered.write_clustered(events, path, "user_id", ["at"], 4, bloom=["vid"], distinct=5000, group_bytes=64 << 10, file_rows=4000)
    return events, path


def test_one_key_reads_one_folder_and_few_row_groups(spark, by_user, rows):
    events, path = by_user
    for user in (7, 11, 4999, 123_456):
        got = clustered.read_keys(spark, path, "user_id", [user], 4)
        assert rows(got, *events.columns) == rows(events.where(F.col("user_id") == user))
    one = clustered.read_keys(spark, path, "user_id", [11], 4)
    assert "PartitionFilters: [isnotnull(key_bucket" in one._jdf.queryExecution().executedPlan().toString()
    folder = spark.read.parquet(path).where(F.col(clustered.BUCKET) == clustered.bucket_of(F.lit(11).cast("long"), 4)).count()
    assert 0 < scanned_rows(one) < folder / 4  # of one folder of four, less than a quarter again


def test_lists_of_keys_and_rows_without_one(spark, by_user, rows):
    events, path = by_user
    few = clustered.read_keys(spark, path, "user_id", [1, 2, 7], 4)
    assert rows(few, *events.columns) == rows(events.where("user_id IN (1, 2, 7)"))
    ids = spark.createDataFrame([(1,), (7,), (7,), (None,), (999_999,)], "user_id long")
    assert rows(clustered.read_members(spark, path, "user_id", ids, 4), *events.columns) == rows(events.where("user_id IN (1, 7)"))
    assert spark.read.parquet(path).where("user_id IS NULL").count() == events.where("user_id IS NULL").count() > 0


def test_bloom_filters_leave_row_groups_out(spark, by_user):
    events, path = by_user
    some = events.where("at = 31").first()
    found = spark.read.parquet(path).where(F.col("vid") == some.vid)
    assert [r["at"] for r in found.collect()] == [31]
    assert scanned_rows(found) < 60_000 / 4  # rows are sorted by user; every group spans all visitor ids
