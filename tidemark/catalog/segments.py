"""Segments with their check SQL."""

from __future__ import annotations

from dataclasses import replace

from tidemark.catalog.registry import bodies, query
from tidemark.operators import segments as s
from tidemark.sources.fixtures import AS_OF, TEST_CONFIG as CFG

W30 = "TIMESTAMP '2024-01-01 00:00:00'"
PREM = "(SELECT user_id FROM fx_subscription_state)"
WEB = "surface IN ('web', 'landing')"
PRODUCT = "surface IN ('web', 'landing', 'task')"

query("segment_storage_warning", "G-1 F-1 F-4 F-6 J-4 A-1 A-3 T-1", f"""
SELECT user_id, COUNT(*) AS warnings_30d, MAX(created_at) AS last_warning_at,
       CASE WHEN user_id IN {PREM} THEN 1 ELSE 0 END AS is_premium
FROM fx_events WHERE created_at >= {W30} AND event_type = 'account.storage_warning'
  AND user_id IS NOT NULL GROUP BY user_id""")(lambda t: s.storage_warning(t, AS_OF, CFG))

query("segment_bandwidth_free", "G-2 F-2 F-7 J-5 A-2 A-10 X-4 X-17", f"""
SELECT user_id, ROUND(SUM(bytes) / 1e9, 2) AS gb_7d, CAST(SUM(reqs) AS BIGINT) AS requests_7d
FROM fx_bw_user_day WHERE day >= DATE '2024-01-24' AND user_id <> 0 AND user_id NOT IN {PREM}
GROUP BY user_id HAVING ROUND(SUM(bytes) / 1e9, 2) >= 8""")(lambda t: s.bandwidth_free(t, AS_OF, CFG))

query("segment_winback_active", "G-3 J-1 J-5 F-5 F-13 A-5", f"""
active AS (SELECT user_id, MAX(created_at) AS last_seen_at, COUNT(*) AS events_30d FROM fx_events
  WHERE created_at >= {W30} AND {PRODUCT} AND user_id IS NOT NULL GROUP BY user_id)
SELECT r.user_id, CAST(SUM(r.amount_usd) AS DOUBLE) AS ltv_usd, COUNT(*) AS lifetime_txns,
       MAX(r.transaction_date) AS last_txn_at, MAX(a.last_seen_at) AS last_seen_at,
       MAX(a.events_30d) AS events_30d
FROM fx_revenue r JOIN active a ON r.user_id = a.user_id
WHERE r.status = 'completed' AND r.user_id NOT IN {PREM} GROUP BY r.user_id"""
)(lambda t: s.winback_active(t, AS_OF, CFG))

query("segment_soft_cancel", "G-4 A-8", """
last AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, event_id DESC) AS rn
  FROM fx_events WHERE created_at >= TIMESTAMP '2023-12-02 00:00:00' AND event_type LIKE 'subscription.%'
  AND user_id IS NOT NULL)
SELECT user_id, created_at AS scheduled_at FROM last
WHERE rn = 1 AND event_type = 'subscription.cancellation_scheduled'"""
)(lambda t: s.soft_cancel(t, AS_OF, CFG))

query("segment_streamers_free", "G-5 A-6", f"""
m AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM fx_requests WHERE ts >= TIMESTAMP '2024-01-24 00:00:00' AND base_path = '/media' AND user_id <> 0)
SELECT user_id, COUNT(*) AS media_requests_7d, ROUND(SUM(bytes_sent) / 1e9, 2) AS gb_streamed_7d,
       MAX(CASE WHEN rn = 1 THEN country END) AS country
FROM m WHERE user_id NOT IN {PREM} GROUP BY user_id HAVING COUNT(*) >= 5"""
)(lambda t: s.streamers_free(t, AS_OF, CFG))

FUNNEL = f"""
funnel AS (SELECT vid, MAX(matomo_idgoal) AS furthest_goal,
    MAX(CASE WHEN matomo_idgoal IN (1, 2, 3) THEN 1 ELSE 0 END) AS touched,
    MAX(CASE WHEN matomo_idgoal = 4 THEN 1 ELSE 0 END) AS paid, MAX(created_at) AS last_touch_at
  FROM fx_events WHERE created_at >= {W30} AND matomo_idgoal IS NOT NULL GROUP BY vid),
aband AS (SELECT m.user_id, MAX(f.furthest_goal) AS furthest_goal, MAX(f.last_touch_at) AS last_touch_at,
    COUNT(*) AS funnel_vids FROM funnel f JOIN fx_vid_user_map m ON f.vid = m.vid
  WHERE f.touched = 1 AND f.paid = 0 GROUP BY m.user_id)"""

query("segment_cart_abandoners", "G-6 J-3 A-4 A-12 Q-9", f"""{FUNNEL}
SELECT * FROM aband WHERE user_id NOT IN {PREM}""")(lambda t: s.cart_abandoners(t, AS_OF, CFG))

query("segment_funnel_abandonment", "G-20", f"""{FUNNEL}
SELECT * FROM aband""")(lambda t: s.funnel_abandonment(t, AS_OF, CFG))

query("segment_visitor_funnel", "A-4 A-12", f"""{FUNNEL}
SELECT * FROM funnel""")(lambda t: s.visitor_funnel(t, AS_OF, CFG))

query("segment_dormant_payers", "G-7 F-7 J-5", f"""
SELECT user_id, CAST(SUM(amount_usd) AS DOUBLE) AS ltv_usd, MAX(transaction_date) AS last_txn_at,
       COUNT(*) AS lifetime_txns
FROM fx_revenue WHERE status = 'completed' AND user_id NOT IN {PREM}
  AND user_id NOT IN (SELECT user_id FROM fx_events WHERE created_at >= {W30} AND user_id IS NOT NULL
                      AND {PRODUCT})
GROUP BY user_id HAVING MAX(transaction_date) >= TIMESTAMP '2023-08-04 00:00:00'"""
)(lambda t: s.dormant_payers(t, AS_OF, CFG))

query("segment_monthly_to_annual", "G-8 J-2 A-2 A-8", """
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY transaction_date DESC, txn_id DESC) AS rn
  FROM fx_revenue WHERE status = 'completed'),
m AS (SELECT user_id, MAX(CASE WHEN rn = 1 THEN amount_usd END) AS last_amount,
    COUNT(*) FILTER (transaction_date >= TIMESTAMP '2023-01-31 00:00:00') AS txns_12mo,
    COALESCE(SUM(amount_usd) FILTER (transaction_date >= TIMESTAMP '2023-01-31 00:00:00'), 0) AS paid
  FROM r GROUP BY user_id)
SELECT s.user_id, s.current_plan_id, CAST(m.last_amount AS DOUBLE) AS last_amount_usd, m.txns_12mo,
       CAST(m.paid AS DOUBLE) AS paid_12mo_usd
FROM fx_subscription_state s JOIN m ON s.user_id = m.user_id
WHERE m.last_amount < 250000 AND m.txns_12mo >= 2""")(lambda t: s.monthly_to_annual(t, AS_OF, CFG))

query("segment_lapsed_high_ltv", "G-9", f"""
SELECT user_id, CAST(SUM(amount_usd) AS DOUBLE) AS ltv_usd, COUNT(*) AS lifetime_txns
FROM fx_revenue WHERE status = 'completed' AND user_id NOT IN {PREM}
GROUP BY user_id HAVING SUM(amount_usd) >= 1000000""")(lambda t: s.lapsed_high_ltv(t, AS_OF, CFG))

query("segment_recently_lapsed", "G-10", f"""
SELECT user_id, MAX(transaction_date) AS last_txn_at
FROM fx_revenue WHERE status = 'completed' AND user_id NOT IN {PREM}
GROUP BY user_id HAVING MAX(transaction_date) >= TIMESTAMP '2023-08-04 00:00:00'"""
)(lambda t: s.recently_lapsed(t, AS_OF, CFG))

query("segment_hard_churned", "G-11", f"""
SELECT user_id, MAX(created_at) AS churned_at, COUNT(*) AS churn_events
FROM fx_events WHERE created_at >= {W30} AND user_id IS NOT NULL
  AND event_type IN ('subscription.canceled', 'subscription.expired') GROUP BY user_id"""
)(lambda t: s.hard_churned(t, AS_OF, CFG))

USAGE = f"""
used AS (SELECT user_id,
    COUNT(*) FILTER (event_type = 'event' AND category = 'File' AND action = 'Download') AS file_downloads,
    COUNT(*) FILTER (event_type = 'event' AND category = 'Archive' AND action = 'Download') AS archive_downloads,
    COUNT(*) FILTER (event_type = 'event' AND category = 'video'
                     AND action IN ('stream_start', 'stream_session')) AS streams,
    COUNT(*) FILTER (event_type = 'pageview' AND (url ILIKE '%pricing%' OR url ILIKE '%payment%')) AS pricing_views
  FROM fx_events WHERE created_at >= {W30} AND {WEB} AND user_id IS NOT NULL GROUP BY user_id)"""

query("segment_archive_only", "G-12", f"""{USAGE}
SELECT user_id, archive_downloads FROM used WHERE archive_downloads > 0 AND file_downloads = 0"""
)(lambda t: s.archive_only(t, AS_OF, CFG))

query("segment_heavy_downloaders", "G-13", f"""{USAGE}
SELECT user_id, file_downloads FROM used WHERE file_downloads > 1"""
)(lambda t: s.heavy_downloaders(t, AS_OF, CFG))

SHORT, SHORT_WINDOW = replace(CFG, events_window=3), ("dormant", "new-or-resurrected")
query("segment_dormant", "G-14", f"""
SELECT user_id, MAX(created_at) AS last_seen_at FROM fx_events
WHERE created_at >= TIMESTAMP '2024-01-25 00:00:00' AND {PRODUCT} AND user_id IS NOT NULL
GROUP BY user_id HAVING MAX(created_at) < TIMESTAMP '2024-01-28 00:00:00'"""
)(lambda t: s.dormant(t, AS_OF, SHORT))

query("segment_new_or_resurrected", "G-15", f"""
SELECT user_id, COUNT(*) FILTER (created_at >= TIMESTAMP '2024-01-28 00:00:00') AS events_now
FROM fx_events WHERE created_at >= TIMESTAMP '2024-01-25 00:00:00' AND {PRODUCT} AND user_id IS NOT NULL
GROUP BY user_id HAVING MIN(created_at) >= TIMESTAMP '2024-01-28 00:00:00'"""
)(lambda t: s.new_or_resurrected(t, AS_OF, SHORT))

query("segment_email_engaged", "G-16", f"""
SELECT user_id, COUNT(*) AS opens, MAX(created_at) AS last_open_at FROM fx_events
WHERE created_at >= {W30} AND event_type = 'email.opened' AND user_id IS NOT NULL GROUP BY user_id"""
)(lambda t: s.email_engaged(t, AS_OF, CFG))

query("segment_power_users", "G-17 F-8", f"""{USAGE}
SELECT user_id, file_downloads + archive_downloads + streams AS actions FROM used
WHERE file_downloads + archive_downloads + streams > 3 AND pricing_views = 0 AND user_id NOT IN {PREM}"""
)(lambda t: s.power_users(t, AS_OF, CFG))

query("segment_heavy_streamers", "G-18", f"""{USAGE}
SELECT user_id, streams, file_downloads + archive_downloads AS downloads FROM used
WHERE streams > 0 AND file_downloads + archive_downloads < 10 AND user_id NOT IN {PREM}"""
)(lambda t: s.heavy_streamers(t, AS_OF, CFG))

query("segment_heavy_downloaders_free", "G-19", f"""{USAGE}
SELECT user_id, file_downloads FROM used WHERE file_downloads > 1 AND user_id NOT IN {PREM}"""
)(lambda t: s.heavy_downloaders_free(t, AS_OF, CFG))

query("segment_archive_only_free", "G-19", f"""{USAGE}
SELECT user_id, archive_downloads FROM used
WHERE archive_downloads > 0 AND file_downloads = 0 AND user_id NOT IN {PREM}"""
)(lambda t: s.archive_only_free(t, AS_OF, CFG))

query("segment_geo_emerging", "G-21 A-7", f"""
c AS (SELECT user_id, country, row_number() OVER (PARTITION BY user_id ORDER BY COUNT(*) DESC, country) AS rn
  FROM fx_events WHERE created_at >= {W30} AND user_id IS NOT NULL GROUP BY user_id, country)
SELECT user_id, country FROM c WHERE rn = 1
  AND country IN ('in','id','ph','bd','ng','vn','lk','pk','ke','tz','ug','et','gh','mm')
  AND user_id NOT IN {PREM}""")(lambda t: s.geo_emerging(t, AS_OF, CFG))

query("segment_premium_upsell", "G-21", """
SELECT user_id, current_plan_id FROM fx_subscription_state""")(lambda t: s.premium_upsell(t, AS_OF, CFG))

query("segment_mobile_first", "G-21 F-9 A-11", f"""
m AS (SELECT user_id, ROUND(CAST(COUNT(*) FILTER (regexp_matches(ua, 'Mobile|Android')) AS DOUBLE)
    / COUNT(*), 3) AS mobile_share
  FROM fx_events WHERE created_at >= {W30} AND {WEB} AND ua <> '' AND user_id IS NOT NULL GROUP BY user_id)
SELECT * FROM m WHERE mobile_share > 0.5 AND user_id NOT IN {PREM}"""
)(lambda t: s.mobile_first(t, AS_OF, CFG))

query("segment_top_decile_usage", "G-22 W-10", f"""
u AS (SELECT user_id, CAST(SUM(bytes) AS BIGINT) AS bytes_7d FROM fx_bw_user_day
  WHERE day >= DATE '2024-01-24' AND user_id <> 0 AND user_id NOT IN {PREM} GROUP BY user_id),
r AS (SELECT *, row_number() OVER (ORDER BY bytes_7d, user_id) AS rn, COUNT(*) OVER () AS n FROM u),
k AS (SELECT user_id, COUNT(*) AS tasks_completed FROM fx_events
  WHERE created_at >= {W30} AND event_type = 'task.completed' AND user_id IS NOT NULL GROUP BY user_id)
SELECT r.user_id, r.bytes_7d, COALESCE(k.tasks_completed, 0) AS tasks_completed
FROM r LEFT JOIN k ON r.user_id = k.user_id
WHERE (rn - 1) * 10 > 9 * (n - 1)""")(lambda t: s.top_decile_usage(t, AS_OF, CFG))



def _sizes_sql() -> str:
    """One count per catalogue segment over the SQL its own query is checked against."""
    parts = []
    for name in s.SEGMENTS:
        body = bodies["segment_" + name.replace("-", "_")].strip()
        inner = body if body.upper().startswith("SELECT") else f"WITH {body}"
        parts.append(f"SELECT '{name}' AS segment, COUNT(*) AS users FROM ({inner})")
    return f"SELECT segment, users FROM ({' UNION ALL '.join(parts)}) WHERE users > 0"


query("segment_sizes", "IO-19 A-22", _sizes_sql())(
    lambda t: s.segment_share([x.build(t, AS_OF, SHORT if x.name in SHORT_WINDOW else CFG) for x in s.select_segments()], list(s.SEGMENTS)))
