"""Sources and sinks: each query writes to scratch storage, reads back, and is compared."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.catalog import sqlparts as p
from tidemark.catalog.experiments import HOLDOUT, past_holdout
from tidemark.catalog.profiles import OFFER, WINBACK
from tidemark.catalog.registry import query
from tidemark.operators import extracts as x
from tidemark.operators import segments as s
from tidemark.plans import winback as wb
from tidemark.session import scratch_dir
from tidemark.sources import filetree as tree
from tidemark.sources import io
from tidemark.sources.fixtures import AS_OF, TEST_CONFIG as CFG
from tidemark.sources.schemas import USER_DAY_TASK
from tidemark.sources.tables import Tables

C = F.col


def _spark(t: Tables):
    return t.events.sparkSession


@query("storage_segment_csv", "IO-1 IO-6", """
SELECT user_id, COUNT(*) AS opens, MAX(created_at) AS last_open_at FROM fx_events
WHERE created_at >= TIMESTAMP '2024-01-01 00:00:00' AND event_type = 'email.opened' AND user_id IS NOT NULL GROUP BY 1""")
def segment_csv(t: Tables) -> DataFrame:
    path = scratch_dir(_spark(t), "segment")
    io.write_list(s.email_engaged(t, AS_OF, CFG), path, compression="gzip")
    return io.read_typed(_spark(t), path, "user_id long, opens long, last_open_at timestamp_ntz", ",", True)


@query("storage_extract_files", "IO-2 IO-3 IO-4", f"""{p.TASK}
SELECT user_id, strftime(DATE '1970-01-01' + day, '%Y-%m-%d') AS day, CAST(completed AS INTEGER) AS completed,
  CAST(failed AS INTEGER) AS failed, CAST(storage_warnings AS INTEGER) AS storage_warnings FROM task_day""")
def extract_files(t: Tables) -> DataFrame:
    base = scratch_dir(_spark(t), "extracts")
    tasks = x.user_day_task(t.events).withColumn("day", F.date_from_unix_date("day"))
    for name, half in (("task_a", C("day") < "2024-01-15"), ("task_b", C("day") >= "2024-01-15")):
        io.write_extract(tasks.filter(half), f"{base}/{name}")
    return io.read_typed(_spark(t), f"{base}/task_*", USER_DAY_TASK)


@query("storage_month_refresh", "IO-5", f"""
o AS (SELECT o_custkey AS user_id, o_orderdate AS ts FROM orders),
m AS (SELECT user_id, CAST(year(ts) * 100 + month(ts) AS INTEGER) AS month FROM o)
SELECT month, COUNT(*) AS orders, COUNT(DISTINCT user_id) AS users FROM m GROUP BY month""")
def month_refresh(t: Tables) -> DataFrame:
    spark, path = _spark(t), scratch_dir(_spark(t), "months")
    orders = spark.read.parquet(f"{t.location.rstrip('/')}/orders.parquet").select(
        C("o_custkey").alias("user_id"), C("o_orderdate").alias("ts"))
    month = (F.year("ts") * 100 + F.month("ts")).cast("int")
    bounds = orders.agg(F.min(month), F.max(month)).first()
    months = io.months_between(*bounds) if bounds[0] is not None else []

    def some(first: int, last: int) -> DataFrame:
        return orders.filter(x.month_filter("ts", first, last)).withColumn("month", month)

    half = len(months) // 2
    io.refresh_months(spark, some, path, months[:half])
    io.refresh_months(spark, some, path, months, always=months[half - 1:half])  # adds the rest, rebuilds one
    return io.read_months(spark, path).groupBy("month").agg(
        F.count(F.lit(1)).alias("orders"), F.count_distinct("user_id").alias("users"))


@query("storage_snapshot_history", "IO-11 IO-12 K-8", """
d AS (SELECT user_id, CAST(SUM(amount_usd) AS DOUBLE) AS ltv, COUNT(*) AS txns FROM fx_revenue
  WHERE status = 'completed' AND user_id <> 0 GROUP BY user_id)
SELECT user_id, ltv, CAST(NULL AS BIGINT) AS txns, '2024-01-30' AS snapshot_date FROM d
UNION ALL SELECT user_id, ltv, txns, '2024-01-31' FROM d""")
def snapshot_history(t: Tables) -> DataFrame:
    path = scratch_dir(_spark(t), "history")
    full = x.txns(t.revenue).groupBy("user_id").agg(
        F.sum("amount_usd").cast("double").alias("ltv"), F.count(F.lit(1)).alias("txns"))
    io.append_snapshot(full.drop("txns"), path, date(2024, 1, 30))
    io.append_snapshot(full, path, date(2024, 1, 31))
    io.append_snapshot(full, path, date(2024, 1, 31))  # the same day again replaces it
    return io.read_history(_spark(t), path)


@query("storage_campaign_replace", "IO-13 K-18", f"""{HOLDOUT}
SELECT user_id, arm, '2023-06-01' AS assigned_date, 'hd_upsell' AS campaign FROM hold
UNION ALL SELECT user_id, 'treatment', '2023-06-01', 'other' FROM hold""")
def campaign_replace(t: Tables) -> DataFrame:
    path = scratch_dir(_spark(t), "holdout")
    arms = past_holdout(t)
    other = arms.withColumns({"campaign": F.lit("other"), "arm": F.lit("treatment")})
    io.replace_campaign(other, path)
    io.replace_campaign(arms.withColumn("arm", F.lit("wrong")), path)
    io.replace_campaign(arms, path)
    return _spark(t).read.parquet(path)


@query("storage_split_by_group", "IO-14 IO-18 K-14", f"{WINBACK} SELECT user_id, winback_group, {OFFER} AS recommended_offer FROM g")
def split_by_group(t: Tables) -> DataFrame:
    path = scratch_dir(_spark(t), "groups")
    lists = wb.winback(t, AS_OF, CFG).select("user_id", "winback_group", "recommended_offer")
    io.write_list(lists, path, fmt="parquet", by="winback_group")
    return _spark(t).read.parquet(path)


@query("storage_cast_by_name", "IO-7 X-15", """
SELECT user_id, CAST(SUM(amount_usd) AS DOUBLE) AS ltv_usd, COUNT(*) AS txns,
  CAST(CASE WHEN COUNT(*) > 5 THEN 1 ELSE 0 END AS TINYINT) AS seg_often, MAX(transaction_date) AS last_at
FROM fx_revenue WHERE status = 'completed' AND user_id <> 0 GROUP BY user_id""")
def typed_by_name(t: Tables) -> DataFrame:
    path = scratch_dir(_spark(t), "panel")
    rows = x.txns(t.revenue).groupBy("user_id").agg(
        F.sum("amount_usd").alias("ltv_usd"), F.count(F.lit(1)).alias("txns"),
        F.max("ts").alias("last_at")).withColumn("seg_often", (C("txns") > 5).cast("int"))
    io.write_list(rows, path, compression="gzip")
    return io.read_panel(_spark(t), path).withColumn("txns", C("txns").cast("long"))


@query("storage_plan_seed", "IO-15", """
SELECT billing_plan_id, storage_gb, plan_name FROM fx_plan_storage
WHERE billing_plan_id IN (SELECT billing_plan_id FROM fx_revenue)""")
def plan_seed(t: Tables) -> DataFrame:
    path = scratch_dir(_spark(t), "plans")
    io.write_list(t.plan_storage, path, fmt="parquet")
    seeded = _spark(t).read.parquet(path)
    used = t.revenue.select("billing_plan_id").distinct()
    return seeded.join(used, "billing_plan_id", "left_semi").drop("confidence")


@query("storage_resume", "IO-17 U-3", """
SELECT DISTINCT user_id, CASE WHEN user_id % 23 = 7 THEN 'retried' ELSE 'ok' END AS content_status FROM fx_accounts""")
def resumed(t: Tables) -> DataFrame:
    previous = t.accounts.select("user_id", "content_status")
    fresh = tree.todo(t.accounts.select("user_id"), previous).withColumn("content_status", F.lit("retried"))
    return tree.resume(previous, fresh)


@query("storage_null_report", "IO-21 F-6", """
SELECT COUNT(*) AS rows, 'user_id' AS column, COUNT(*) FILTER (user_id IS NULL) AS nulls FROM fx_events
UNION ALL SELECT COUNT(*), 'matomo_idgoal', COUNT(*) FILTER (matomo_idgoal IS NULL) FROM fx_events""")
def nulls(t: Tables) -> DataFrame:
    return io.null_report(t.events, ["user_id", "matomo_idgoal"])


query("storage_hash_sample", "T-4 X-13", """
SELECT user_id FROM (SELECT DISTINCT user_id FROM fx_revenue) ORDER BY md5(CAST(user_id AS VARCHAR)), user_id LIMIT 100""")(
    lambda t: tree.sample_users(t.revenue, 100))


@query("storage_inferred_list", "IO-8", """
SELECT user_id, CAST(SUM(amount_usd) AS DOUBLE) AS ltv_usd, CAST(COUNT(*) AS INTEGER) AS txns, MAX(provider) AS provider
FROM fx_revenue WHERE status = 'completed' AND user_id <> 0 GROUP BY user_id""")
def inferred_list(t: Tables) -> DataFrame:
    """A list with header read back with the types its own values have."""
    path = scratch_dir(_spark(t), "inferred")
    rows = x.txns(t.revenue).groupBy("user_id").agg(
        F.sum("amount_usd").cast("double").alias("ltv_usd"), F.count(F.lit(1)).cast("int").alias("txns"), F.max("provider").alias("provider"))
    io.write_list(rows, path)
    return io.read_inferred(_spark(t), path, ",").withColumn("user_id", C("user_id").cast("long"))


TABLE_SQL = """
SELECT user_id, CAST(SUM(amount_usd) AS DOUBLE) AS ltv_usd, COUNT(*) AS txns, CAST(CASE WHEN COUNT(*) > 5 THEN 1 ELSE 0 END AS TINYINT) AS seg_often
FROM fx_revenue WHERE status = 'completed' AND user_id <> 0 GROUP BY user_id"""


@query("storage_load_table", "IO-9 IO-10", TABLE_SQL)
def load_table(t: Tables) -> DataFrame:
    """A text panel typed by its names, saved as a bucketed table, created and then replaced, read by its name."""
    spark, path, place = _spark(t), scratch_dir(_spark(t), "table-panel"), scratch_dir(_spark(t), "table")
    rows = x.txns(t.revenue).groupBy("user_id").agg(
        F.sum("amount_usd").alias("ltv_usd"), F.count(F.lit(1)).alias("txns")).withColumn("seg_often", (C("txns") > 5).cast("int"))
    io.write_list(rows, path)
    typed = io.read_panel(spark, path).withColumn("txns", C("txns").cast("long"))
    name = "tidemark_" + place.rsplit("-", 1)[1]
    io.save_table(typed.limit(0), name, path=place)
    rows = io.save_table(typed, name, buckets=8, path=place)
    spark.sql(f"DROP TABLE {name}")  # the entry; the files of a table with a path stay, and the rows are read from them
    return rows


@query("storage_retention", "IO-21", """
SELECT CAST(year(transaction_date) * 100 + month(transaction_date) AS INTEGER) AS month, COUNT(*) AS txns, CAST(SUM(amount_usd) AS DOUBLE) AS amount
FROM fx_revenue WHERE transaction_date >= TIMESTAMP '2023-01-01 00:00:00' GROUP BY 1""")
def retention(t: Tables) -> DataFrame:
    """Monthly partitions of all payments; the expired ones are deleted as folders, the rest is read back."""
    spark, path = _spark(t), scratch_dir(_spark(t), "retention")
    dated = t.revenue.select((F.year("transaction_date") * 100 + F.month("transaction_date")).cast("int").alias("month"), "amount_usd")
    io.overwrite_partitions(dated, path, "month")
    io.drop_expired(spark, path, "month", 202301)
    return io.read_months(spark, path).groupBy("month").agg(F.count(F.lit(1)).alias("txns"), F.sum("amount_usd").cast("double").alias("amount"))
