"""User-day extracts, sessions and tolerance matches with their check SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import sqlparts as p
from tidemark.catalog.registry import query
from tidemark.operators import extracts as x
from tidemark.operators.joins import join_text_id, match_tolerance, sessionize
from tidemark.sources.fixtures import AS_OF, TEST_CONFIG as CFG
from tidemark.sources.tables import apply_retention, clamp_future, exclude_window, latest_version, Retention

query("extract_email_day", "E-1 X-1 X-10 F-10", f"{p.EMAIL} SELECT * FROM email_day")(
    lambda t: x.user_day_email(t.events))
query("extract_web_day", "E-2 F-5 F-8", f"{p.WEBDAY} SELECT * FROM web_day")(
    lambda t: x.user_day_web(t.events))
query("extract_task_day", "E-3", f"{p.TASK} SELECT * FROM task_day")(
    lambda t: x.user_day_task(t.events))
query("extract_activity_day", "E-1 E-2 E-3", f"""{p.EMAIL}, {p.WEBDAY}, {p.TASK},
k AS (SELECT user_id, day FROM email_day UNION SELECT user_id, day FROM web_day
  UNION SELECT user_id, day FROM task_day)
SELECT user_id, day, CAST(e.opened IS NOT NULL AS INTEGER) AS has_email,
  {", ".join(f"COALESCE({c}, 0) AS {c}" for c in ("mautic_sent", "internal_sent", "opened", "clicked", "completed",
             "failed", "storage_warnings"))},
  w.* EXCLUDE (user_id, day)
FROM k LEFT JOIN email_day e USING (user_id, day) LEFT JOIN web_day w USING (user_id, day)
LEFT JOIN task_day USING (user_id, day)""")(lambda t: x.user_day_activity(t.events))
query("extract_account_profile", "E-6 E-7 J-18", f"""{p.PROFILE}
SELECT p.*, COALESCE(m.mobile_share, 0.0) AS mobile_share FROM profile p LEFT JOIN mobile m USING (user_id)""")(
    lambda t: x.account_profile(t.events, AS_OF, CFG.mobile_window))
query("extract_transactions", "E-4 F-13", f"""{p.TXN}
SELECT user_id, ts, txn_id, CAST(amount_usd AS DOUBLE) AS amount_usd, billing_plan_id, provider, country
FROM txn""")(lambda t: x.txns(t.revenue))
query("extract_transaction_days", "E-4 A-24", f"""{p.TXN}
SELECT user_id, day, CAST(SUM(amount_usd) AS DOUBLE) AS amount, COUNT(*) AS txns,
  CAST(arg_min(amount_usd, (ts, txn_id)) AS DOUBLE) AS first_amount,
  CAST(arg_max(amount_usd, (ts, txn_id)) AS DOUBLE) AS last_amount,
  CAST(MIN(amount_usd) AS DOUBLE) AS min_amount, CAST(MAX(amount_usd) AS DOUBLE) AS max_amount,
  CAST(COALESCE(SUM(amount_usd) FILTER (amount_usd < 0), 0) AS DOUBLE) AS refund_amount,
  COUNT(*) FILTER (amount_usd < 0) AS refund_count
FROM txn GROUP BY user_id, day""")(
    lambda t: x.txn_days(t.revenue).drop("last_txn", "plans", "cents_sq"))
query("extract_subscription_events", "E-5 F-4", f"{p.SUB} SELECT user_id, ts, event_id, type FROM sub")(
    lambda t: x.sub_events(t.events))
query("extract_subscription_days", "E-5 X-8", f"""{p.SUB}
SELECT user_id, day, substr(arg_max(type, (ts, event_id)), 14) AS last_type,
  COUNT(*) FILTER (type IN ('subscription.created', 'subscription.reactivated')) AS started,
  COUNT(*) FILTER (type = 'subscription.reactivated') AS reactivated,
  COUNT(*) FILTER (type IN ('subscription.canceled', 'subscription.expired')) AS churned,
  COUNT(*) FILTER (type = 'subscription.cancellation_scheduled') AS cancel_sched
FROM sub GROUP BY user_id, day""")(lambda t: x.sub_days(t.events))
query("extract_profile", "E-6 A-7 A-9", f"{p.PROFILE} SELECT * FROM profile")(lambda t: x.profile(t.events))
query("extract_mobile_share", "E-7 F-9", f"{p.PROFILE} SELECT * FROM mobile")(
    lambda t: x.mobile_share(t.events, AS_OF, CFG.mobile_window))
query("extract_send_detail", "E-8", f"{p.BULK} SELECT user_id, day, email_id, c FROM detail")(
    lambda t: x.send_detail(t.events, CFG))
query("extract_bulk_sends", "E-9 J-17", f"{p.BULK} SELECT * FROM bulk")(
    lambda t: x.bulk_sends(t.events, CFG))
query("extract_one_month", "F-3 IO-5", f"""{p.EMAIL}
SELECT *, CAST(202401 AS INTEGER) AS month FROM email_day
WHERE day BETWEEN 19723 AND 19753""")(
    lambda t: x.monthly(x.user_day_email(t.events.filter(x.month_filter("created_at", 202401)))))

SESSIONS = """
g AS (SELECT user_id, created_at, CASE WHEN created_at - lag(created_at) OVER w <= INTERVAL 30 MINUTE
    THEN 0 ELSE 1 END AS fresh FROM fx_events WHERE user_id IS NOT NULL
    WINDOW w AS (PARTITION BY user_id ORDER BY created_at, event_id)),
n AS (SELECT user_id, created_at, CAST(SUM(fresh) OVER (PARTITION BY user_id ORDER BY created_at
    ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM g)
SELECT user_id, session_no, MIN(created_at) AS started_at, MAX(created_at) AS ended_at, COUNT(*) AS events,
  CAST(date_diff('microsecond', MIN(created_at), MAX(created_at)) AS DOUBLE) / 1000000 AS seconds
FROM n GROUP BY user_id, session_no"""
query("sessions_idle_30min", "W-15", SESSIONS)(lambda t: sessionize(t.events, "user_id", "created_at", 30))

query("join_text_subscription_id", "J-21", """
b AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'n/a' ELSE CAST(uid AS VARCHAR) END AS sub_id FROM fx_billing),
p AS (SELECT user_id, COUNT(*) AS txns FROM fx_revenue GROUP BY user_id)
SELECT p.user_id, b.event_id, b.sub_id, p.txns FROM b JOIN p ON TRY_CAST(b.sub_id AS BIGINT) = p.user_id""")(
    lambda t: join_text_id(
        t.billing.select("event_id", F.when(F.col("event_id") % 10 == 0, "n/a")
                         .otherwise(F.col("uid").cast("string")).alias("sub_id")),
        "sub_id", t.revenue.groupBy("user_id").agg(F.count(F.lit(1)).alias("txns")), "user_id"))

# page views in local wall-clock time against purchases in UTC, hours apart are accepted
TOL = 4 * 3600
query("match_across_sources", "J-22 X-16", f"""
b AS (SELECT event_id AS view_id, user_id,
    timezone('UTC', timezone('Asia/Jerusalem', created_at)) AS at FROM fx_events
    WHERE event_type = 'pageview'),
a AS (SELECT event_id AS buy_id, user_id, created_at AS at FROM fx_events
    WHERE event_type LIKE 'subscription.%' AND user_id IS NOT NULL),
pairs AS (SELECT a.buy_id, b.view_id, date_diff('microsecond', b.at, a.at) AS d,
    row_number() OVER (PARTITION BY a.buy_id ORDER BY abs(date_diff('microsecond', b.at, a.at)),
      date_diff('microsecond', b.at, a.at) DESC, b.view_id) AS rn
  FROM a JOIN b ON a.user_id = b.user_id AND abs(date_diff('microsecond', b.at, a.at)) <= {TOL * 1000000})
SELECT buy_id, view_id, CAST(abs(d) AS DOUBLE) / 1000000 AS gap_seconds FROM pairs WHERE rn = 1""")(
    lambda t: match_tolerance(
        t.events.filter(F.col("event_type").startswith("subscription.") & F.col("user_id").isNotNull())
        .withColumnRenamed("event_id", "buy_id"),
        t.events.filter("event_type = 'pageview'").withColumnRenamed("event_id", "view_id"),
        "user_id", "created_at", "created_at", "buy_id", "view_id", TOL, "Asia/Jerusalem"))

query("latest_event_per_visitor", "IO-20 W-13 W-8", """
v AS (SELECT vid, event_id, event_type, created_at,
    row_number() OVER (PARTITION BY vid ORDER BY created_at DESC, event_id DESC) AS rn FROM fx_events)
SELECT vid, event_id, event_type, created_at FROM v WHERE rn = 1""")(
    lambda t: latest_version(t.events.select("vid", "event_id", "event_type", "created_at"), ["vid"],
                             [F.desc("created_at"), F.desc("event_id")]))

RULES = (Retention("created_at", 5, "event_type = 'session_end'"), Retention("created_at", 20))
query("retention_applied", "IO-21", """
SELECT event_id, event_type, created_at FROM fx_events
WHERE created_at >= TIMESTAMP '2024-01-11 00:00:00'
  AND (event_type <> 'session_end' OR created_at >= TIMESTAMP '2024-01-26 00:00:00')""")(
    lambda t: apply_retention(t.events, RULES, AS_OF).select("event_id", "event_type", "created_at"))

query("inflated_window_excluded", "F-20", """
SELECT event_id, least(created_at, TIMESTAMP '2024-01-20 00:00:00') AS created_at FROM fx_events
WHERE created_at <= TIMESTAMP '2024-01-20 00:05:00'
  AND NOT (created_at >= TIMESTAMP '2024-01-10 00:00:00' AND created_at < TIMESTAMP '2024-01-12 00:00:00')""")(
    lambda t: clamp_future(
        exclude_window(t.events, "created_at", AS_OF.replace(day=10), AS_OF.replace(day=12)),
        "created_at", AS_OF.replace(day=20)).select("event_id", "created_at"))
