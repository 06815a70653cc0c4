"""Training panels with their check SQL (range joins instead of windows)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.catalog import sqlparts as p
from tidemark.catalog.registry import query
from tidemark.functions.scalar import epoch_day, to_epoch_day
from tidemark.operators import extracts as x
from tidemark.operators import pit
from tidemark.plans import churn_panel as churn
from tidemark.plans import conversion_panel as conv
from tidemark.plans import ltv_panel as ltv
from tidemark.session import scratch_dir
from tidemark.sources import io
from tidemark.sources.fixtures import AS_OF, CHURN_SNAPSHOTS, LTV_DATES, TEST_CONFIG as CFG
from tidemark.sources.tables import Tables

C = F.col

LO, HI, CUT = 19730, 19738, 19737  # 2024-01-08, 2024-01-16, 2024-01-15

INDEX = f"""{p.EMAIL}, {p.WEBDAY}, {p.TASK}, {p.TXN}, {p.SUB}, {p.BULK}, {p.PROFILE},
treat AS (SELECT e.user_id, e.day,
    CASE WHEN mautic_sent > 0 AND e.day <= {CUT} THEN 'mautic' WHEN COALESCE(bulk, 0) > 0 THEN 'internal' END AS era,
    CASE WHEN mautic_sent > 0 AND e.day <= {CUT} THEN mautic_sent ELSE 0 END + COALESCE(bulk, 0) AS sends_today
  FROM email_day e LEFT JOIN bulk b ON e.user_id = b.user_id AND e.day = b.day
  WHERE e.day BETWEEN {LO} AND {HI}),
quiet AS (SELECT w.user_id, w.day, row_number() OVER (PARTITION BY w.user_id
    ORDER BY md5(concat(CAST(w.user_id AS VARCHAR), ':', CAST(w.day AS VARCHAR))), w.day) AS rn
  FROM web_day w WHERE w.day BETWEEN {LO} AND {HI} AND w.user_id IN (SELECT user_id FROM email_day)
  AND NOT EXISTS (SELECT 1 FROM email_day e WHERE e.user_id = w.user_id AND abs(e.day - w.day) <= 14
                  AND e.mautic_sent + e.internal_sent > 0)),
control AS (SELECT user_id, day, 'control' AS era, CAST(0 AS BIGINT) AS sends_today FROM quiet WHERE rn <= 3)"""


def sums(alias: str, cols: dict[str, tuple[int, ...]]) -> str:
    return ",\n".join(
        f"CAST(COALESCE(SUM({c}) FILTER (f.day >= i.day - {n}), 0) AS BIGINT) AS {alias}{c}_{n}"
        for c, spans in cols.items() for n in spans
    )


def ranged(name: str, table: str, span: int, body: str) -> str:
    return f"""{name} AS (SELECT i.user_id, i.day, {body}
  FROM idx i LEFT JOIN {table} f ON f.user_id = i.user_id AND f.day BETWEEN i.day - {span} AND i.day - 1
  GROUP BY i.user_id, i.day)"""


WEB_COLS = {"pageviews": (7, 30), "file_dl": (30, 90), "archive_dl": (30, 90), "file_views": (30,),
            "streams": (30, 90), "pricing_views": (30, 90), "goal4": (30, 90), "promo_sub": (30, 90),
            "sessions": (7, 30)}
EM_WINDOWS = ranged("em", "email_day", 90, """
  CAST(COALESCE(SUM(mautic_sent + internal_sent) FILTER (f.day >= i.day - 7), 0) AS BIGINT) AS em_sent_7,
  CAST(COALESCE(SUM(mautic_sent + internal_sent) FILTER (f.day >= i.day - 30), 0) AS BIGINT) AS em_sent_30,
  CAST(COALESCE(SUM(mautic_sent + internal_sent), 0) AS BIGINT) AS em_sent_90,
  CAST(COALESCE(SUM(opened) FILTER (f.day >= i.day - 30), 0) AS BIGINT) AS em_opened_30,
  CAST(COALESCE(SUM(opened), 0) AS BIGINT) AS em_opened_90,
  CAST(COALESCE(SUM(clicked), 0) AS BIGINT) AS em_clicked_90,
  COALESCE(i.day - MAX(f.day) FILTER (mautic_sent + internal_sent > 0), -1) AS days_since_last_send,
  COALESCE(i.day - MAX(f.day) FILTER (opened > 0), -1) AS days_since_last_open""")
WEB_WINDOWS = ranged("wb", "web_day", 90, f"""
  COUNT(f.day) FILTER (f.day >= i.day - 7) AS web_active_days_7,
  COUNT(f.day) FILTER (f.day >= i.day - 30) AS web_active_days_30, {sums('', WEB_COLS)},
  COALESCE(i.day - MAX(f.day), -1) AS days_since_web_activity,
  COALESCE(i.day - MAX(f.day) FILTER (promo_sub > 0), -1) AS days_since_promo_sub""")

CANDIDATES = f"""
{EM_WINDOWS}, {WEB_WINDOWS},
{ranged("tk", "task_day", 30, '''
  CAST(COALESCE(SUM(completed), 0) AS BIGINT) AS tasks_completed_30,
  CAST(COALESCE(SUM(failed), 0) AS BIGINT) AS tasks_failed_30,
  CAST(COALESCE(SUM(storage_warnings), 0) AS BIGINT) AS storage_warnings_30''')},
mo AS (SELECT i.user_id, i.day, COALESCE(SUM(amount_usd), 0) AS ltv, COUNT(f.day) AS txns_before,
    COUNT(f.day) FILTER (f.day >= i.day - 365) AS txns_365d, MAX(f.day) AS last_day, MIN(f.day) AS first_txn,
    COALESCE(arg_max(amount_usd, (ts, txn_id)), 0) AS last_amount
  FROM idx i LEFT JOIN txn f ON f.user_id = i.user_id AND f.day < i.day GROUP BY 1, 2),
sb AS (SELECT i.user_id, i.day, COALESCE(substr(arg_max(type, (ts, event_id)), 14), '') AS last_sub_event,
    COALESCE(i.day - MAX(f.day), -1) AS days_since_sub_event
  FROM idx i LEFT JOIN sub f ON f.user_id = i.user_id AND f.day < i.day GROUP BY 1, 2),
nx AS (SELECT i.user_id, i.day, MIN(f.day) AS pay_day, arg_min(amount_usd, (ts, txn_id)) AS pay_amount
  FROM idx i LEFT JOIN txn f ON f.user_id = i.user_id AND f.day > i.day GROUP BY 1, 2),
ls AS (SELECT i.user_id, i.day, CAST(COUNT(f.day) > 0 AS INTEGER) AS label_sub_started_14d
  FROM idx i LEFT JOIN sub f ON f.user_id = i.user_id AND f.day > i.day AND f.day <= i.day + 14
  AND f.type IN ('subscription.created', 'subscription.reactivated') GROUP BY 1, 2),
base AS (SELECT i.*, em.* EXCLUDE (user_id, day), wb.* EXCLUDE (user_id, day), tk.* EXCLUDE (user_id, day),
    sb.* EXCLUDE (user_id, day), ls.label_sub_started_14d, mo.ltv, mo.txns_before, mo.txns_365d, mo.last_amount,
    CAST(mo.txns_before > 0 AS INTEGER) AS ever_paid, COALESCE(i.day - mo.last_day, -1) AS days_since_last_txn,
    mo.first_txn, nx.pay_day, nx.pay_amount, pr.country, pr.devices, pr.first_day, mb.mobile_share
  FROM idx i JOIN em USING (user_id, day) JOIN wb USING (user_id, day) JOIN tk USING (user_id, day)
  JOIN mo USING (user_id, day) JOIN sb USING (user_id, day) JOIN nx USING (user_id, day)
  JOIN ls USING (user_id, day) LEFT JOIN profile pr ON pr.user_id = i.user_id
  LEFT JOIN mobile mb ON mb.user_id = i.user_id),
prem AS (SELECT *, CAST(ever_paid = 1 AND (days_since_last_txn <= 35
    OR (last_amount >= 400000 AND days_since_last_txn <= 370)) AS INTEGER) AS premium_at_send,
    CAST(COALESCE(pay_day <= day + 14, FALSE) AS INTEGER) AS label_payment_14d FROM base),
cand AS (SELECT user_id, day, treatment, strftime(DATE '1970-01-01' + day, '%Y-%m-%d') AS send_date, era, sends_today,
    em_sent_7, em_sent_30, em_sent_90, em_opened_30, em_opened_90, em_clicked_90,
    CASE WHEN em_sent_90 > 0 THEN ROUND(CAST(em_opened_90 AS DOUBLE) / em_sent_90, 4) ELSE 0.0 END AS em_open_rate_90,
    days_since_last_send, days_since_last_open, web_active_days_7, web_active_days_30, pageviews_7, pageviews_30,
    file_dl_30, file_dl_90, archive_dl_30, archive_dl_90, file_views_30, streams_30, streams_90,
    pricing_views_30, pricing_views_90, goal4_30, goal4_90, days_since_web_activity, promo_sub_30, promo_sub_90,
    days_since_promo_sub, sessions_7, sessions_30,
    ROUND(CAST(pageviews_7 AS DOUBLE) / (pageviews_30 + 1), 4) AS pv_trend_7_30,
    ROUND(CAST(web_active_days_7 AS DOUBLE) / (web_active_days_30 + 1), 4) AS wa_trend_7_30,
    CAST((day + 4) % 7 AS INTEGER) AS send_dow, tasks_completed_30, tasks_failed_30, storage_warnings_30,
    CAST(day >= 19733 AS INTEGER) AS tasks_observable, ever_paid, CAST(ltv AS DOUBLE) AS ltv_before_usd,
    txns_before, days_since_last_txn, CAST(last_amount AS DOUBLE) AS last_txn_amount, txns_365d, premium_at_send,
    last_sub_event, days_since_sub_event, CAST(day >= 19732 AS INTEGER) AS subs_observable,
    COALESCE(country, '') AS country,
    CASE WHEN first_day IS NULL THEN -1 ELSE day - least(first_day, COALESCE(first_txn, first_day)) END AS tenure_days,
    COALESCE(devices, 0) AS devices, COALESCE(mobile_share, 0.0) AS mobile_share_now,
    CAST(storage_warnings_30 > 0 AS INTEGER) AS seg_storage_warning,
    CAST(file_dl_30 + archive_dl_30 > 50 AS INTEGER) AS seg_heavy_downloader,
    CAST(streams_30 >= 5 AS INTEGER) AS seg_streamer,
    CAST(pricing_views_30 > 0 AND goal4_30 = 0 AND premium_at_send = 0 AS INTEGER) AS seg_cart_abandoner,
    CAST(ever_paid = 1 AND premium_at_send = 0 AND web_active_days_30 > 0 AS INTEGER) AS seg_winback_active,
    CAST(ever_paid = 1 AND premium_at_send = 0 AND days_since_last_txn BETWEEN 0 AND 180
         AND web_active_days_30 = 0 AS INTEGER) AS seg_dormant_payer,
    CAST(last_sub_event = 'cancellation_scheduled' AND days_since_sub_event <= 60 AS INTEGER) AS seg_soft_cancel,
    CAST(premium_at_send = 1 AND txns_365d >= 2 AND last_amount < 250000 AS INTEGER) AS seg_monthly_loyal,
    label_payment_14d, CAST(label_payment_14d = 1 AND premium_at_send = 0 AS INTEGER) AS label_conv_14d,
    label_sub_started_14d, CASE WHEN label_payment_14d = 1 THEN pay_day - day ELSE -1 END AS days_to_payment,
    CASE WHEN label_payment_14d = 1 THEN CAST(pay_amount AS DOUBLE) ELSE 0.0 END AS first_payment_usd
  FROM prem)"""
TREATED = "idx AS (SELECT *, CAST(1 AS INTEGER) AS treatment FROM treat WHERE era IS NOT NULL)"
BOTH = (TREATED[:-1] + " UNION ALL SELECT *, CAST(0 AS INTEGER) FROM control)")
KEEP = p.bucket("concat(CAST(user_id AS VARCHAR), ':', CAST(day AS VARCHAR))", 10000) + " < 2500"
SAMPLED = f"""
SELECT * EXCLUDE (day{{drop}}), CASE WHEN label_payment_14d = 1 THEN 1.0::DOUBLE ELSE 4.0::DOUBLE END AS sample_weight
FROM cand WHERE label_payment_14d = 1 OR {KEEP}"""

query("panel_index_days", "P-1 P-20", f"{INDEX} SELECT *, CAST(1 AS INTEGER) AS treatment FROM treat WHERE era IS NOT NULL")(
    lambda t: conv.index_days(x.user_day_email(t.events), x.bulk_sends(t.events, CFG), CFG, AS_OF))
query("panel_control_days", "P-2 J-15 W-7 Q-13", f"{INDEX} SELECT *, CAST(0 AS INTEGER) AS treatment FROM control")(
    lambda t: conv.control_days(x.user_day_activity(t.events), conv.emailed_users(t.events), CFG, AS_OF))
query("panel_conversion", "P-1 P-3 P-4 P-5 P-6 P-7 P-8 P-9 P-10 P-11 P-12 P-13 P-14 P-17 P-18 P-20 W-1 W-2 W-3 "
      "W-4 J-12 J-13 J-14 J-18 X-3 X-11 X-12 Q-1 Q-11",
      f"{INDEX}, {TREATED}, {CANDIDATES} {SAMPLED.format(drop=', treatment')}")(
    lambda t: conv.build_conversion_panel(t, AS_OF, CFG))
query("panel_uplift", "P-2 P-16 U-1", f"{INDEX}, {BOTH}, {CANDIDATES} {SAMPLED.format(drop='')}")(
    lambda t: conv.build_conversion_panel(t, AS_OF, CFG, uplift=True))
REPORT = " UNION ALL ".join(
    f"SELECT '{c}' AS segment, CAST(COALESCE(SUM({v}), 0) AS BIGINT) AS samples, "
    f"CAST(COALESCE(SUM({v} * label_payment_14d), 0) AS BIGINT) AS positives FROM cand"
    for c, v in [("all_candidates", "1"), *[(c, c) for c in conv.SEGMENT_FLAGS]])
query("panel_segment_report", "P-15 A-25", f"""{INDEX}, {TREATED}, {CANDIDATES}, rep AS ({REPORT})
SELECT *, CAST(positives AS DOUBLE) / greatest(samples, 1) AS rate FROM rep""")(
    lambda t: conv.segment_report(conv.panel_candidates(t, AS_OF, CFG)))
query("panel_winback_segment", "P-19", f"""{INDEX}, {TREATED}, {CANDIDATES},
s AS ({SAMPLED.format(drop=', treatment')}) SELECT * FROM s WHERE seg_winback_active = 1""")(
    lambda t: conv.segment_panel(conv.build_conversion_panel(t, AS_OF, CFG), "seg_winback_active"))


def churn_sql(days: str, horizon: int, label: bool) -> str:
    lab = ", CAST(COALESCE(lb.churn, 0) AS INTEGER) AS label_churn_30" if label else ""
    return f"""{p.EMAIL}, {p.WEBDAY}, {p.TXN}, {p.SUB}, {p.PROFILE},
snaps AS (SELECT * FROM (VALUES {days}) AS s(day)),
st AS (SELECT s.user_id, n.day, arg_max(type, (ts, event_id)) AS last_type, MAX(s.day) AS last_day,
    MIN(s.day) FILTER (type IN ('subscription.created', 'subscription.reactivated')) AS started,
    COUNT(*) FILTER (type IN ('subscription.canceled', 'subscription.expired')) AS prior_cancels,
    COUNT(*) FILTER (type = 'subscription.reactivated') AS prior_reactivations,
    CAST(COUNT(*) FILTER (type = 'subscription.cancellation_scheduled' AND s.day >= n.day - 30) > 0 AS INTEGER)
      AS had_cancel_sched_30
  FROM sub s JOIN snaps n ON s.day < n.day GROUP BY 1, 2),
idx AS (SELECT * FROM st WHERE started IS NOT NULL AND last_type IN ('subscription.created',
  'subscription.reactivated', 'subscription.billing_plan_change', 'subscription.cancellation_scheduled')),
{EM_WINDOWS}, {WEB_WINDOWS},
mo AS (SELECT i.user_id, i.day, COALESCE(SUM(amount_usd), 0) AS ltv, COUNT(f.day) AS txns_before,
    COUNT(f.day) FILTER (f.day >= i.day - 365) AS txns_365d, MAX(f.day) AS last_day, MIN(f.day) AS first_txn,
    COALESCE(arg_max(amount_usd, (ts, txn_id)), 0) AS last_amount,
    COALESCE(CAST(arg_max(billing_plan_id, (ts, txn_id)) AS VARCHAR), '0') AS last_plan_id
  FROM idx i LEFT JOIN txn f ON f.user_id = i.user_id AND f.day < i.day GROUP BY 1, 2),
gp AS (SELECT user_id, sday, COALESCE({p.upper_median("list(gap)")}, -1) AS med FROM (
    SELECT i.user_id, i.day AS sday, f.day - lag(f.day) OVER (PARTITION BY i.user_id, i.day
      ORDER BY f.ts, f.txn_id) AS gap FROM idx i JOIN txn f ON f.user_id = i.user_id AND f.day < i.day)
  WHERE gap IS NOT NULL GROUP BY 1, 2),
lb AS (SELECT i.user_id, i.day, MAX(1) AS churn FROM idx i JOIN sub f ON f.user_id = i.user_id
  AND f.day > i.day AND f.day <= i.day + {horizon}
  AND f.type IN ('subscription.canceled', 'subscription.expired') GROUP BY 1, 2),
b AS (SELECT i.*, em.* EXCLUDE (user_id, day), wb.* EXCLUDE (user_id, day), mo.* EXCLUDE (user_id, day, last_day),
    COALESCE(i.day - mo.last_day, -1) AS since, COALESCE(gp.med, -1) AS med
  FROM idx i JOIN em USING (user_id, day) JOIN wb USING (user_id, day) JOIN mo USING (user_id, day)
  LEFT JOIN gp ON gp.user_id = i.user_id AND gp.sday = i.day)
SELECT b.user_id, strftime(DATE '1970-01-01' + b.day, '%Y-%m-%d') AS snapshot_date, em_sent_30, em_sent_90,
  em_opened_90, em_clicked_90,
  CASE WHEN em_sent_90 > 0 THEN ROUND(CAST(em_opened_90 AS DOUBLE) / em_sent_90, 4) ELSE 0.0 END AS em_open_rate_90,
  days_since_last_send, days_since_last_open, web_active_days_30, pageviews_30, file_dl_30, file_dl_90,
  archive_dl_30, streams_90, pricing_views_30, days_since_web_activity, CAST(ltv AS DOUBLE) AS ltv_before_usd,
  txns_before, since AS days_since_last_txn, CAST(last_amount AS DOUBLE) AS last_txn_amount, txns_365d,
  med AS prior_txn_gap_median,
  CASE WHEN med > 0 AND since >= 0 THEN ROUND(CAST(since AS DOUBLE) / med, 3) ELSE -1.0 END AS cycle_position,
  CASE WHEN med > 0 AND since >= 0 THEN med - since ELSE -999 END AS days_to_renewal, last_plan_id,
  CAST(med > 180 OR last_amount >= 400000 AS INTEGER) AS is_annual, b.day - started AS sub_tenure_days,
  b.day - last_day AS days_since_sub_event, substr(last_type, 14) AS last_sub_event, prior_cancels,
  prior_reactivations, had_cancel_sched_30, COALESCE(pr.country, '') AS country,
  b.day - least(pr.first_day, COALESCE(first_txn, pr.first_day)) AS tenure_days, COALESCE(pr.devices, 0) AS devices,
  COALESCE(mb.mobile_share, 0.0) AS mobile_share, b.day - 19732 AS snapshot_age{lab}
FROM b LEFT JOIN profile pr ON pr.user_id = b.user_id LEFT JOIN mobile mb ON mb.user_id = b.user_id
LEFT JOIN lb ON lb.user_id = b.user_id AND lb.day = b.day"""


query("panel_churn", "C-1 C-2 C-3 C-4 C-5 C-6 C-7 C-8 W-5 W-6 A-15 J-16 J-19 Q-2 Q-4 Q-7 X-8",
      churn_sql("(19730), (19737), (19744)", 7, True))(
    lambda t: churn.build_churn_panel(t, CHURN_SNAPSHOTS, AS_OF, CFG))
query("panel_churn_today", "C-9", churn_sql("(19753)", 7, False))(
    lambda t: churn.build_churn_panel(t, [AS_OF.date()], AS_OF, CFG, with_label=False))
query("panel_active_subscribers", "C-2 J-13", f"""{p.SUB}, st AS (SELECT user_id,
    arg_max(type, (ts, event_id)) AS last_type,
    MAX(CAST(type IN ('subscription.created', 'subscription.reactivated') AS INTEGER)) AS ever
  FROM sub WHERE ts < TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1)
SELECT user_id, substr(last_type, 14) AS last_sub_event FROM st WHERE ever = 1 AND last_type IN (
  'subscription.created', 'subscription.reactivated', 'subscription.billing_plan_change',
  'subscription.cancellation_scheduled')""")(lambda t: churn.active_at(t, CHURN_SNAPSHOTS[1]))


def ltv_sql(dates: str, version: int, label: bool, select: str = "*") -> str:
    recent = "HAVING i.day - MAX(fday) <= 730" if version == 2 else ""
    lab = "0"
    if label:
        lab = "ROUND(CAST(COALESCE(lb.fwd, 0) AS DOUBLE), 2)"
        if version == 2:
            lab = f"greatest({lab}, 0.0)"
    v2 = f"""strftime(DATE '1970-01-01' + b.day, '%Y-%m-%d') AS index_date, b.day - last_day AS recency_days,
  frequency, CAST(msum AS DOUBLE) AS monetary_sum, ROUND(CAST(CAST(msum * 100 AS BIGINT) AS DOUBLE) / frequency, 0) / 100 AS monetary_avg,
  ROUND(sqrt(CAST(frequency * csq - CAST(msum * 100 AS HUGEINT) * CAST(msum * 100 AS HUGEINT) AS DOUBLE)) / frequency, 0) / 100 AS monetary_std, CAST(first_amount AS DOUBLE) AS first_amount,
  CAST(last_amount AS DOUBLE) AS last_amount, CAST(min_amount AS DOUBLE) AS min_amount,
  CAST(max_amount AS DOUBLE) AS max_amount, b.day - first_day AS tenure_days,
  ROUND((b.day - first_day) / 30.4::DOUBLE, 1) AS months_since_first,
  ROUND(CAST(CAST(msum * 100 AS BIGINT) AS DOUBLE) / greatest((b.day - first_day) / 30.4::DOUBLE, 1.0), 0) / 100 AS avg_monthly_rev,
  COALESCE(med, -1) AS gap_median, COALESCE(gmin, -1) AS gap_min, COALESCE(gmax, -1) AS gap_max,
  txns_90, txns_180, txns_365, CAST(rev_90 AS DOUBLE) AS rev_90, CAST(rev_180 AS DOUBLE) AS rev_180,
  CAST(rev_365 AS DOUBLE) AS rev_365, CAST(rprev AS DOUBLE) AS rev_prev_365,
  CASE WHEN rprev > 0 THEN ROUND(CAST(rev_365 AS DOUBLE) / CAST(rprev AS DOUBLE), 3) ELSE -1.0 END AS rev_trend,
  CAST(COALESCE(med, -1) > 180 OR last_amount >= 400000 AS INTEGER) AS is_annual, n_plans, last_plan_id,
  provider, country, refund_count, CAST(refund_amount AS DOUBLE) AS refund_amount"""
    v1 = """strftime(DATE '1970-01-01' + b.day, '%Y-%m-%d') AS index_date, b.day - last_day AS recency_days,
  frequency, CAST(msum AS DOUBLE) AS monetary_sum, ROUND(CAST(CAST(msum * 100 AS BIGINT) AS DOUBLE) / frequency, 0) / 100 AS monetary_avg,
  CAST(last_amount AS DOUBLE) AS last_amount, b.day - first_day AS tenure_days, COALESCE(med, -1) AS gap_median,
  txns_365 AS txns_365_prior, CAST(rev_365 AS DOUBLE) AS rev_365_prior,
  CAST(COALESCE(med, -1) > 180 OR last_amount >= 400000 AS INTEGER) AS is_annual"""
    return f"""{p.TXN}, dates AS (SELECT * FROM (VALUES {dates}) AS d(day)),
h AS (SELECT i.day, f.* EXCLUDE (day), f.day AS fday, f.day - lag(f.day) OVER (PARTITION BY f.user_id, i.day
    ORDER BY f.ts, f.txn_id) AS gap FROM dates i JOIN txn f ON f.day < i.day),
b AS (SELECT i.user_id, i.day, COUNT(*) AS frequency, SUM(amount_usd) AS msum,
    SUM(CAST(amount_usd * 100 AS HUGEINT) * CAST(amount_usd * 100 AS HUGEINT)) AS csq, arg_min(amount_usd, (ts, txn_id)) AS first_amount,
    arg_max(amount_usd, (ts, txn_id)) AS last_amount, MIN(amount_usd) AS min_amount, MAX(amount_usd) AS max_amount,
    MIN(fday) AS first_day, MAX(fday) AS last_day, {p.upper_median("list(gap) FILTER (gap IS NOT NULL)")} AS med,
    MIN(gap) AS gmin, MAX(gap) AS gmax, COUNT(*) FILTER (i.day - fday <= 90) AS txns_90,
    COUNT(*) FILTER (i.day - fday <= 180) AS txns_180, COUNT(*) FILTER (i.day - fday <= 365) AS txns_365,
    COALESCE(SUM(amount_usd) FILTER (i.day - fday <= 90), 0) AS rev_90,
    COALESCE(SUM(amount_usd) FILTER (i.day - fday <= 180), 0) AS rev_180,
    COALESCE(SUM(amount_usd) FILTER (i.day - fday <= 365), 0) AS rev_365,
    COALESCE(SUM(amount_usd) FILTER (i.day - fday > 365 AND i.day - fday <= 730), 0) AS rprev,
    CAST(COUNT(DISTINCT billing_plan_id) AS INTEGER) AS n_plans,
    CAST(arg_max(billing_plan_id, (ts, txn_id)) AS VARCHAR) AS last_plan_id,
    arg_max(provider, (ts, txn_id)) AS provider, arg_max(country, (ts, txn_id)) AS country,
    COUNT(*) FILTER (amount_usd < 0) AS refund_count,
    COALESCE(SUM(amount_usd) FILTER (amount_usd < 0), 0) AS refund_amount
  FROM h i GROUP BY i.user_id, i.day {recent}),
lb AS (SELECT i.day, f.user_id, SUM(amount_usd) AS fwd FROM dates i
  JOIN txn f ON f.day > i.day AND f.day <= i.day + 365 GROUP BY 1, 2),
panel AS (SELECT b.user_id, {v2 if version == 2 else v1}, {lab} AS label_rev_365
  FROM b LEFT JOIN lb ON lb.user_id = b.user_id AND lb.day = b.day)
SELECT {select} FROM panel"""


DATES_SQL = ", ".join(f"({to_epoch_day(d)})" for d in LTV_DATES)
HALF_YEARS = [d for d in LTV_DATES if d.month in (1, 7)]
HALF_SQL = ", ".join(f"({to_epoch_day(d)})" for d in HALF_YEARS)

query("panel_ltv", "L-2 L-3 L-4 A-14 A-15 A-23 A-24 J-14 J-16 W-4 W-6", ltv_sql(DATES_SQL, 2, True))(
    lambda t: ltv.build_ltv_panel(t.revenue, LTV_DATES, CFG))
query("panel_ltv_first_version", "L-1 Q-15", ltv_sql(HALF_SQL, 1, True))(
    lambda t: ltv.build_ltv_panel(t.revenue, HALF_YEARS, CFG, version=1))
query("panel_ltv_today", "L-5", ltv_sql("(19753)", 2, False, "* EXCLUDE (label_rev_365)"))(
    lambda t: ltv.score_rows(t.revenue, AS_OF, CFG))

TAKEN = (date(2023, 3, 1), date(2023, 6, 1), date(2023, 9, 1), date(2023, 12, 1))


@query("panel_from_history", "J-13 J-16 K-8", f"""{p.TXN},
dates AS (SELECT unnest([{", ".join(str(to_epoch_day(d)) for d in TAKEN)}]) AS taken),
hist AS (SELECT user_id, taken, CAST(SUM(amount_usd) AS DOUBLE) AS ltv_then, COUNT(*) AS txns_then FROM txn JOIN dates ON day < taken GROUP BY ALL),
idx AS (SELECT DISTINCT user_id, day FROM txn WHERE day >= {to_epoch_day(date(2023, 4, 1))}),
joined AS (SELECT idx.user_id, idx.day, CASE WHEN idx.day - taken <= 200 THEN ltv_then END AS ltv_then, CASE WHEN idx.day - taken <= 200 THEN txns_then END AS txns_then,
  CASE WHEN idx.day - taken <= 200 THEN idx.day - taken END AS snapshot_age FROM idx ASOF LEFT JOIN hist ON idx.user_id = hist.user_id AND idx.day > hist.taken)
SELECT joined.*, CAST(EXISTS (SELECT 1 FROM txn b WHERE b.user_id = joined.user_id AND b.day > joined.day AND b.day <= joined.day + 90) AS INTEGER) AS label_paid_90d FROM joined""")
def panel_from_history(t: Tables) -> DataFrame:
    """Payment days with what the dated snapshots knew before them, and whether another payment follows within 90 days."""
    spark, path = t.revenue.sparkSession, scratch_dir(t.revenue.sparkSession, "value-history")
    days = x.txns(t.revenue).groupBy("user_id", epoch_day("ts").alias("day")).agg(F.sum("amount_usd").alias("amount"), F.count(F.lit(1)).alias("n"))
    for taken in TAKEN:  # the daily job's files
        known = days.filter(C("day") < to_epoch_day(taken)).groupBy("user_id").agg(
            F.sum("amount").cast("double").alias("ltv_then"), F.sum("n").alias("txns_then"))
        io.append_snapshot(known, path, taken)
    history = io.read_history(spark, path).withColumn("snapshot_day", F.unix_date("snapshot_date"))
    paid = days.select("user_id", "day", F.lit(1).alias("_paid"))
    rows = pit.pit_windows(paid, days.filter(C("day") >= to_epoch_day(date(2023, 4, 1))).select("user_id", "day"), {"_next": pit.ahead(F.max("_paid"), 90)})
    rows = rows.select("user_id", "day", F.coalesce("_next", F.lit(0)).alias("label_paid_90d"))
    return pit.with_history(rows, history, ("ltv_then", "txns_then"), max_age=200)
