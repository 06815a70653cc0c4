"""Shared pieces of the check SQL: user-day extracts over the adapter views."""

EDAY = "date_diff('day', DATE '1970-01-01', CAST({} AS DATE))"
DAY = "CAST(" + EDAY.format("created_at") + " AS INTEGER)"
WEB = "surface IN ('web', 'landing')"
SRC = "json_extract_string(metadata, '$.src')"



def _tally(name: str, tags: str, source: str, counters: tuple[str, ...]) -> str:
    """User-day counters the other way round: every event is turned into a list of tags (a row of its user-day in any case),
    tags are tallied into one map per user-day, and the map is spread into columns at the end."""
    spread = ", ".join(f"CAST(COALESCE(tally['{c}'], 0) AS BIGINT) AS {c}" for c in counters)
    return f"""{name} AS (SELECT user_id, day, {spread} FROM (
  SELECT user_id, day, histogram(tag) AS tally FROM (
    SELECT user_id, {DAY} AS day, unnest(list_filter([{tags}], lambda x: x IS NOT NULL)) AS tag
    FROM fx_events WHERE user_id IS NOT NULL AND {source}) GROUP BY ALL))"""


EMAIL = _tally(
    "email_day",
    f"CASE event_type || '<' || {SRC} WHEN 'email.sent<mautic' THEN 'mautic_sent' WHEN 'email.sent<internal_events' THEN 'internal_sent' END, "
    "CASE WHEN event_type <> 'email.sent' THEN substr(event_type, 7) END, 'seen'",
    "starts_with(event_type, 'email.') AND substr(event_type, 7) IN ('sent', 'opened', 'clicked')",
    ("mautic_sent", "internal_sent", "opened", "clicked"))

WEBDAY = _tally(
    "web_day",
    "'seen', CASE event_type WHEN 'pageview' THEN 'pageviews' WHEN 'session_end' THEN 'sessions' "
    "WHEN 'event' THEN CASE category || ':' || action WHEN 'File:Download' THEN 'file_dl' WHEN 'File:View' THEN 'file_views' "
    "WHEN 'Archive:Download' THEN 'archive_dl' WHEN 'Promotional:visited_subscription' THEN 'promo_sub' "
    "WHEN 'video:stream_start' THEN 'streams' WHEN 'video:stream_session' THEN 'streams' END END, "
    "CASE WHEN event_type = 'pageview' AND regexp_matches(lower(url), 'pricing|payment') THEN 'pricing_views' END, "
    "CASE matomo_idgoal WHEN 4 THEN 'goal4' END",
    WEB,
    ("pageviews", "file_dl", "archive_dl", "file_views", "streams", "pricing_views", "goal4", "promo_sub", "sessions"))

TASK = _tally(
    "task_day",
    "CASE event_type WHEN 'account.storage_warning' THEN 'storage_warnings' ELSE split_part(event_type, '.', 2) END",
    "event_type IN ('task.completed', 'task.failed', 'account.storage_warning')",
    ("completed", "failed", "storage_warnings"))

TXN = f"""txn AS (SELECT user_id, transaction_date AS ts, txn_id, amount_usd, billing_plan_id, provider, country,
  CAST({EDAY.format('transaction_date')} AS INTEGER) AS day
  FROM fx_revenue WHERE status = 'completed' AND user_id IS NOT NULL AND user_id <> 0)"""

SUB = f"""sub AS (SELECT user_id, created_at AS ts, event_id, event_type AS type, {DAY} AS day
  FROM fx_events WHERE event_type LIKE 'subscription.%' AND user_id IS NOT NULL)"""

BULK = f"""detail AS (SELECT user_id, {DAY} AS day, json_extract_string(metadata, '$.email_id') AS email_id,
  COUNT(*) AS c FROM fx_events WHERE event_type = 'email.sent' AND user_id IS NOT NULL
  AND created_at >= TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1, 2, 3),
bulk AS (SELECT user_id, day, CAST(SUM(c) AS BIGINT) AS bulk FROM
  (SELECT *, SUM(c) OVER (PARTITION BY email_id, day) AS total FROM detail) WHERE total >= 10 GROUP BY 1, 2)"""

PROFILE = f"""places AS (SELECT user_id, country, COUNT(*) AS n FROM fx_events WHERE user_id IS NOT NULL GROUP BY ALL),
modal AS (SELECT p.user_id, MIN(country) AS country FROM places p
  JOIN (SELECT user_id, MAX(n) AS most FROM places GROUP BY user_id) b ON b.user_id = p.user_id AND n = most GROUP BY p.user_id),
visits AS (SELECT user_id, vid, MIN({DAY}) AS since FROM fx_events WHERE user_id IS NOT NULL GROUP BY ALL),
profile AS (SELECT v.user_id, any_value(m.country) AS country, MIN(since) AS first_day, CAST(COUNT(vid) AS INTEGER) AS devices
  FROM visits v JOIN modal m ON m.user_id = v.user_id GROUP BY v.user_id),
mobile AS (SELECT user_id, ROUND(AVG(CAST(position('Mobile' IN ua) + position('Android' IN ua) > 0 AS DOUBLE)), 3) AS mobile_share
  FROM fx_events WHERE {WEB} AND user_id IS NOT NULL AND length(ua) > 0 AND created_at >= TIMESTAMP '2023-11-02 00:00:00'
  GROUP BY user_id)"""


def bucket(text: str, modulus: int) -> str:
    return f"(CAST(concat('0x', substr(md5({text}), 1, 8)) AS BIGINT) % {modulus})"


def upper_median(values: str) -> str:
    """sorted[n // 2] of a list expression."""
    return f"list_sort({values})[CAST(len({values}) // 2 AS INTEGER) + 1]"
