"""Stored feature tables: star joins without a shuffle, days, and tables a new session finds again."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.plans.feature_store import FeatureStore

DAY, NEXT = date(2024, 1, 30), date(2024, 1, 31)


@pytest.fixture
def store(spark, tmp_path):
    kept = FeatureStore(str(tmp_path / "features"), f"t{abs(hash(str(tmp_path)))}", 4)
    yield kept
    for table in ("a", "b", "c"):
        for day in kept.days(spark, table):
            kept.forget(spark, table, day)


def users(spark, n, name):
    return spark.range(n).select(F.col("id").alias("user_id"), (F.col("id") * 2).alias(name))


def test_star_join_of_a_day_has_no_shuffle(spark, store):
    store.write_day(spark, DAY, [
        {"a": lambda: users(spark, 1000, "x"), "b": lambda: users(spark, 700, "y")},
        {"c": lambda: store.read(spark, "a", DAY).join(store.read(spark, "b", DAY), "user_id").select("user_id", (F.col("x") + F.col("y")).alias("z"))}])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        star = store.read(spark, "a")
        for name in ("b", "c"):
            star = star.join(store.read(spark, name), "user_id", "left")
        assert "Exchange" not in star._jdf.queryExecution().executedPlan().toString()
        got = star.agg(F.count("*"), F.count("y"), F.sum("z")).first()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert tuple(got) == (1000, 700, sum(4 * i for i in range(700)))


def test_days_are_kept_apart_and_found_by_a_new_session(spark, store):
    store.write("a", DAY, users(spark, 10, "x"))
    store.write("a", NEXT, users(spark, 20, "x"))
    store.write("a", NEXT, users(spark, 15, "x"))  # the day again replaces it
    assert store.days(spark, "a") == [DAY, NEXT]
    spark.sql(f"DROP TABLE {store._name('a', NEXT)}")  # a session that has not written it does not know the table
    assert store.read(spark, "a").count() == 15 and store.read(spark, "a", DAY).count() == 10
    assert "Buckets" not in store.read(spark, "a").columns
    told = spark.sql(f"DESCRIBE EXTENDED {store._name('a', NEXT)}").where("col_name = 'Num Buckets'").first()
    assert told.data_type == "4"
    store.forget(spark, "a", NEXT)
    assert store.read(spark, "a").count() == 10
    with pytest.raises(FileNotFoundError):
        store.read(spark, "b")


def test_a_failed_table_does_not_count_as_stored(spark, store):
    def broken():
        raise ZeroDivisionError

    with pytest.raises(ZeroDivisionError):
        store.write_day(spark, DAY, [{"a": lambda: users(spark, 5, "x"), "b": broken}, {"c": lambda: users(spark, 5, "x")}])
    assert store.has(spark, "a", DAY) and not store.has(spark, "b", DAY) and not store.has(spark, "c", DAY)
