"""Documented recipes with their check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.catalog.registry import query
from tidemark.operators import recipes as r
from tidemark.session import scratch_dir
from tidemark.sources import files
from tidemark.sources.clustered import read_keys, write_clustered
from tidemark.sources.fixtures import AS_OF
from tidemark.sources.tables import Tables

D30 = "TIMESTAMP '2024-01-01 00:00:00'"
D7 = "TIMESTAMP '2024-01-24 00:00:00'"
PREM = "(SELECT user_id FROM fx_subscription_state)"

query("recipe_user_journey", "R-1 F-11 T-2", f"""
SELECT user_id, created_at, event_id, event_type, surface, category, action, matomo_idgoal, url, country
FROM fx_events WHERE surface IN ('web', 'landing') AND user_id IN {PREM}"""
)(lambda t: r.user_journey(t.events, t.subscription_state))

_CLUSTERED: dict[tuple[str, str], str] = {}


def clustered_events(t: Tables) -> str:
    """The events by user, written once per application: what a loader keeps beside the table for look-ups."""
    spark = t.events.sparkSession
    kept = (spark.sparkContext.applicationId, t.location)
    if kept not in _CLUSTERED or not files.exists(spark, _CLUSTERED[kept]):
        _CLUSTERED[kept] = scratch_dir(spark, "events-by-user")
        write_clustered(t.events, _CLUSTERED[kept], "user_id", ("created_at", "event_id"), BUCKETS, bloom=("vid", "idempotency_key"))
    return _CLUSTERED[kept]


BUCKETS = 16


@query("recipe_one_user_journey", "R-1 F-11 T-2", """
SELECT user_id, created_at, event_id, event_type, surface, category, action, matomo_idgoal, url, country
FROM fx_events WHERE surface IN ('web', 'landing') AND user_id = (SELECT MIN(user_id) FROM fx_events)""")
def one_user_journey(t: Tables) -> DataFrame:
    """One user's journey out of the table clustered by user: one folder, and in it the row groups that may hold the user."""
    spark, user = t.events.sparkSession, t.events.agg(F.min("user_id")).first()[0]
    rows = read_keys(spark, clustered_events(t), "user_id", [user], BUCKETS)
    return r.user_journey(rows, spark.createDataFrame([(user,)], "user_id long"))


@query("recipe_visitor_events", "R-1 IO-20", """
SELECT vid, event_id, user_id, created_at, event_type FROM fx_events WHERE vid = (SELECT MAX(vid) FROM fx_events)""")
def visitor_events(t: Tables) -> DataFrame:
    """One visitor's events, by a column the clustered table is not sorted by: bloom filters leave row groups out."""
    spark, visitor = t.events.sparkSession, t.events.agg(F.max("vid")).first()[0]
    rows = spark.read.parquet(clustered_events(t)).where(F.col("vid") == visitor)
    return rows.select("vid", "event_id", "user_id", "created_at", "event_type")


query("recipe_journey_aggregates", "R-2 A-9", f"""
m AS (SELECT user_id, country, row_number() OVER (PARTITION BY user_id ORDER BY COUNT(*) DESC, country) AS rn
  FROM fx_events WHERE created_at >= {D30} GROUP BY user_id, country)
SELECT e.user_id, COUNT(DISTINCT vid) AS device_count, MIN(created_at) AS first_visit_at,
  MAX(created_at) AS last_visit_at, COUNT(*) AS total_actions,
  COUNT(*) FILTER (event_type = 'pageview') AS pageviews, COUNT(matomo_idgoal) AS goal_firings,
  MAX(matomo_idgoal) AS max_goal_reached, MAX(m.country) AS primary_country
FROM fx_events e JOIN m ON e.user_id = m.user_id AND m.rn = 1
WHERE created_at >= {D30} AND e.user_id IN {PREM} GROUP BY e.user_id"""
)(lambda t: r.journey_aggregates(t.events, t.subscription_state, AS_OF))

query("recipe_daily_volume", "R-3 A-27", f"""
SELECT strftime(CAST(created_at AS DATE), '%Y-%m-%d') AS day,
  COUNT(*) FILTER (event_type = 'pageview') AS pageviews, COUNT(*) FILTER (event_type = 'event') AS events,
  COUNT(*) FILTER (event_type = 'goal' OR (event_type = 'signup' AND matomo_idgoal IS NOT NULL)) AS goals,
  COUNT(DISTINCT user_id) AS unique_users, COUNT(DISTINCT vid) AS unique_visitors
FROM fx_events WHERE created_at >= {D30} GROUP BY 1""")(lambda t: r.daily_volume(t.events, AS_OF))

query("recipe_email_engagement", "R-4 A-11", """
e AS (SELECT user_id, COUNT(*) FILTER (event_type = 'email.sent') AS sent,
  COUNT(*) FILTER (event_type = 'email.opened') AS opened,
  COUNT(*) FILTER (event_type = 'email.clicked') AS clicked
  FROM fx_events WHERE surface = 'email' AND user_id IS NOT NULL GROUP BY user_id)
SELECT user_id, sent, opened, clicked,
  ROUND(CAST(opened * 100.0 / NULLIF(sent, 0) AS DOUBLE), 1) AS open_rate,
  ROUND(CAST(clicked * 100.0 / NULLIF(opened, 0) AS DOUBLE), 1) AS click_rate FROM e"""
)(lambda t: r.email_engagement(t.events))

query("recipe_goal_funnel", "R-5", f"""
SELECT COUNT(*) FILTER (matomo_idgoal = 1) AS s1_pricing_views,
  COUNT(*) FILTER (matomo_idgoal = 2) AS s2_package_clicks,
  COUNT(*) FILTER (matomo_idgoal = 3) AS s3_payment_chosen, COUNT(*) FILTER (matomo_idgoal = 4) AS s4_clicked_pay,
  COUNT(DISTINCT CASE WHEN matomo_idgoal = 4 THEN user_id END) AS s4_unique_users
FROM fx_events WHERE created_at >= {D7} AND matomo_idgoal IS NOT NULL"""
)(lambda t: r.goal_funnel(t.events, AS_OF))

query("recipe_goals_per_day", "R-6", f"""
SELECT strftime(CAST(created_at AS DATE), '%Y-%m-%d') AS day,
  COUNT(*) FILTER (matomo_idgoal = 1) AS g1, COUNT(*) FILTER (matomo_idgoal = 2) AS g2,
  COUNT(*) FILTER (matomo_idgoal = 4) AS g4, COUNT(*) FILTER (matomo_idgoal = 5) AS g5
FROM fx_events WHERE created_at >= {D7} AND matomo_idgoal IS NOT NULL GROUP BY 1"""
)(lambda t: r.goals_per_day(t.events, AS_OF))

query("recipe_user_ltv", "R-7 T-5", """
SELECT user_id, CAST(SUM(amount_usd) AS DOUBLE) AS ltv_usd, COUNT(*) AS transactions,
  MIN(transaction_date) AS first_purchase, MAX(transaction_date) AS last_purchase
FROM fx_revenue WHERE status = 'completed' GROUP BY user_id
ORDER BY SUM(amount_usd) DESC, user_id LIMIT 100""")(lambda t: r.user_ltv(t.revenue))

query("recipe_ltv_engagement", "R-7 J-23", f"""
r AS (SELECT user_id, CAST(SUM(amount_usd) AS DOUBLE) AS ltv_usd FROM fx_revenue
  WHERE status = 'completed' GROUP BY user_id),
e AS (SELECT user_id, MAX(created_at) AS last_seen, COUNT(*) AS pageviews_30d FROM fx_events
  WHERE created_at >= {D30} AND event_type = 'pageview' AND user_id IS NOT NULL GROUP BY user_id)
SELECT r.user_id, r.ltv_usd, e.last_seen, e.pageviews_30d FROM r LEFT JOIN e ON r.user_id = e.user_id
WHERE r.ltv_usd > 100 ORDER BY r.ltv_usd DESC, r.user_id LIMIT 50"""
)(lambda t: r.ltv_engagement(t.revenue, t.events, AS_OF))

query("recipe_events_by_source", "R-8 X-10 F-10", """
SELECT json_extract_string(metadata, '$.src') AS src, COUNT(*) AS events FROM fx_events GROUP BY 1"""
)(lambda t: r.events_by_source(t.events))

query("recipe_funnel_stage", "R-10", """
SELECT user_id, CAST(MAX(CASE WHEN matomo_idgoal BETWEEN 1 AND 4 THEN matomo_idgoal ELSE 0 END) AS INTEGER)
  AS funnel_stage FROM fx_events WHERE user_id IS NOT NULL GROUP BY user_id"""
)(lambda t: r.funnel_stage(t.events))

query("recipe_goal_dedup", "R-11", """
SELECT user_id, strftime(CAST(created_at AS DATE), '%Y-%m-%d') AS day, MIN(created_at) AS first_at,
  COUNT(*) AS firings FROM fx_events WHERE matomo_idgoal = 4 AND user_id IS NOT NULL GROUP BY 1, 2"""
)(lambda t: r.goal_dedup(t.events))

query("recipe_reconciliation_rows", "R-12", """
SELECT * FROM fx_billing WHERE action = 'RECONCILIATION_CRITICAL'"""
)(lambda t: r.reconciliation_rows(t.billing))

query("recipe_billing_error_rate", "R-12", """
SELECT action, COUNT(*) AS events, COUNT(*) FILTER (level = 'error') AS errors,
  ROUND(CAST(COUNT(*) FILTER (level = 'error') AS DOUBLE) / COUNT(*), 4) AS error_rate
FROM fx_billing GROUP BY action""")(lambda t: r.billing_error_rate(t.billing))

query("recipe_failures_by_status", "R-12 ST-16", """
SELECT base_path, status, COUNT(*) AS failures FROM fx_requests WHERE status >= 400 GROUP BY 1, 2"""
)(lambda t: r.failures_by_status(t.requests))
