"""Adapter: the star-schema test tables seen as the logical source tables.

The view texts run unchanged on Spark and on DuckDB, so the same inputs feed a
query and the SQL it is checked against.
"""

from __future__ import annotations

from dataclasses import replace
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession

from tidemark.config import Config
from tidemark.session import prepare, scratch_dir
from tidemark.sources import files
from tidemark.sources.seeds import plan_storage
from tidemark.sources.tables import Tables

AS_OF = datetime(2024, 1, 31)
AS_OF_DAY = 19753

BASE_TABLES = ("events", "orders", "documents")

VIEWS = {
    "fx_revenue": """
SELECT o_orderkey AS txn_id, o_custkey AS user_id,
       CAST(o_totalprice AS DECIMAL(18,2)) AS amount_usd,
       CASE WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'completed' END AS status,
       o_orderdate + INTERVAL 8217 DAY AS transaction_date,
       lower(substr(o_orderpriority, 3)) AS provider,
       o_orderkey % 7 AS billing_plan_id, 'usd' AS currency,
       CASE o_custkey % 4 WHEN 0 THEN 'in' WHEN 1 THEN 'us' WHEN 2 THEN 'de' ELSE 'id' END AS country
FROM {orders}""",
    "fx_events": """
SELECT event_id, concat('ik', CAST(event_id AS STRING)) AS idempotency_key,
       concat('v', CAST(user_id AS STRING), '-', CAST(event_id % 4 AS STRING)) AS vid,
       CASE WHEN event_type = 'signup' AND event_id % 7 <> 3 THEN NULL ELSE user_id END AS user_id,
       ts AS created_at,
       CASE WHEN event_type = 'view' THEN 'pageview'
            WHEN event_type = 'signup' THEN 'goal'
            WHEN event_type = 'click' AND event_id % 5 = 0 THEN 'event'
            WHEN event_type = 'click' AND event_id % 5 IN (1, 2) THEN 'email.sent'
            WHEN event_type = 'click' AND event_id % 5 = 3 THEN 'email.opened'
            WHEN event_type = 'click' THEN 'email.clicked'
            WHEN event_type = 'error' AND event_id % 5 IN (0, 1) THEN 'task.completed'
            WHEN event_type = 'error' AND event_id % 5 = 2 THEN 'task.failed'
            WHEN event_type = 'error' AND event_id % 5 = 3 THEN 'account.storage_warning'
            WHEN event_type = 'error' THEN 'session_end'
            WHEN event_id % 8 IN (0, 1) THEN 'subscription.created'
            WHEN event_id % 8 = 2 THEN 'subscription.reactivated'
            WHEN event_id % 8 = 3 THEN 'subscription.billing_plan_change'
            WHEN event_id % 8 = 4 THEN 'subscription.cancellation_scheduled'
            WHEN event_id % 8 = 5 THEN 'subscription.payment_failed'
            WHEN event_id % 8 = 6 THEN 'subscription.canceled'
            ELSE 'subscription.expired' END AS event_type,
       CASE WHEN event_type IN ('view', 'signup') OR (event_type = 'click' AND event_id % 5 = 0)
                 OR (event_type = 'error' AND event_id % 5 = 4)
                 THEN CASE WHEN event_id % 2 = 0 THEN 'web' ELSE 'landing' END
            WHEN event_type = 'click' THEN 'email'
            WHEN event_type = 'error' AND event_id % 5 = 3 THEN 'account'
            WHEN event_type = 'error' THEN 'task' ELSE 'subscription' END AS surface,
       CASE WHEN event_type = 'signup' THEN 1 + event_id % 7 % 4 ELSE NULL END AS matomo_idgoal,
       CASE WHEN event_type = 'click' AND event_id % 5 = 0 THEN
            CASE event_id % 3 WHEN 0 THEN 'File' WHEN 1 THEN 'Archive' ELSE 'video' END ELSE '' END AS category,
       CASE WHEN event_type = 'click' AND event_id % 5 = 0 THEN
            CASE event_id % 3 WHEN 2 THEN 'stream_start' ELSE 'Download' END ELSE '' END AS action,
       CASE WHEN event_type = 'view' AND event_id % 10 = 0 THEN '/Pricing' ELSE '/app' END AS url,
       CASE WHEN event_id % 5 < 3 THEN 'Android Mobile' ELSE 'Desktop' END AS ua,
       CASE event_id % 4 WHEN 0 THEN 'in' WHEN 1 THEN 'in' WHEN 2 THEN 'us' ELSE 'de' END AS country,
       concat('{"src":"', CASE WHEN event_type = 'click' AND event_id % 2 = 0 THEN 'mautic'
                               ELSE 'internal_events' END,
              '","email_id":"', CAST(event_id % 3 AS STRING), '"}') AS metadata
FROM {events}""",
    "fx_requests": """
SELECT event_id, ts, user_id, event_id % 9 AS file_id,
       CASE event_id % 3 WHEN 0 THEN '/media' WHEN 1 THEN '/app' ELSE '/tasks' END AS base_path,
       CASE WHEN event_id % 20 = 0 THEN 429 WHEN event_id % 33 = 0 THEN 500 ELSE 200 END AS status,
       event_id % 1000 * 1000003 AS bytes_sent,
       CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END AS is_stall,
       CASE event_id % 3 WHEN 0 THEN 'h2' WHEN 1 THEN 'h3' ELSE 'h1' END AS proto,
       concat('n', CAST(event_id % 5 AS STRING)) AS node,
       CAST(event_id % 977 AS BIGINT) AS req_time_ms,
       concat('10.0.0.', CAST(event_id % 200 AS STRING)) AS client_ip,
       64500 + event_id % 13 AS asn, concat('org', CAST(event_id % 13 AS STRING)) AS asn_org,
       concat('h', CAST(event_id % 101 AS STRING)) AS hash,
       CASE event_id % 8 WHEN 0 THEN '/presentation/master.m3u8' WHEN 1 THEN '/presentation/audio/a.ts'
            WHEN 2 THEN '/presentation/hls/v.ts' WHEN 3 THEN '/hls/lq/x.ts' WHEN 4 THEN '/hls/hd/x.ts'
            WHEN 5 THEN '/thumbs/1.jpg' WHEN 6 THEN '/subtitles/1.vtt' ELSE '/app/index' END AS path,
       CASE WHEN event_id % 19 = 0 THEN 101 ELSE event_id % 1000 * 1000003 END AS body_bytes,
       event_id % 1000 * 1000003 + CASE WHEN event_id % 17 = 0 THEN 5000 ELSE 0 END AS bytes_expect,
       100 + event_id % 5000 AS rtt_us, event_id % 3 AS retrans,
       CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END AS is_stalled, event_id % 300 AS stall_ms,
       CASE event_id % 4 WHEN 0 THEN 'in' WHEN 1 THEN 'in' WHEN 2 THEN 'us' ELSE 'de' END AS country
FROM {events}""",
    "fx_subscription_state": """
SELECT user_id, event_type AS last_event_type, created_at AS last_event_at,
       event_id % 7 AS current_plan_id FROM (
  SELECT e.*, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, event_id DESC) AS rn
  FROM {fx_events} e WHERE event_type LIKE 'subscription.%' AND user_id IS NOT NULL) s
WHERE rn = 1 AND event_type IN ('subscription.created', 'subscription.reactivated',
                                'subscription.billing_plan_change')""",
    "fx_vid_user_map": """
SELECT DISTINCT vid, user_id FROM {fx_events} WHERE user_id IS NOT NULL""",
    "fx_bw_user_day": """
SELECT user_id, CAST(ts AS DATE) AS day, CAST(SUM(bytes_sent) AS BIGINT) AS bytes, COUNT(*) AS reqs
FROM {fx_requests} GROUP BY user_id, CAST(ts AS DATE)""",
    "fx_files": """
SELECT doc_id AS file_id, doc_id % 137 AS user_id, doc_id % 11 AS folder_id,
       concat('f', CAST(doc_id AS STRING),
              CASE doc_id % 8 WHEN 0 THEN '.MKV' WHEN 1 THEN '.mp4' WHEN 2 THEN '.flac'
              WHEN 3 THEN '.epub' WHEN 4 THEN '.iso' WHEN 5 THEN '.zip' WHEN 6 THEN '.srt' ELSE '' END)
              AS relative_path,
       n_chars * 1000003 AS size, 19753 - doc_id % 400 AS last_update_day,
       CASE WHEN doc_id % 50 = 0 THEN 1 ELSE 0 END AS is_lost
FROM {documents}""",
    "fx_accounts": """
SELECT u.user_id, CASE WHEN u.user_id % 23 = 7 THEN 'timeout' ELSE 'ok' END AS content_status,
       CAST(COALESCE(f.bytes + u.user_id % 3 * 1000000007, 0) AS BIGINT) AS root_size,
       u.user_id * 12345678 AS bandwidth_used,
       CASE WHEN u.user_id % 5 = 0 THEN NULL ELSE 19753 - u.user_id % 40 END AS last_signin_day,
       CASE WHEN u.user_id % 6 = 0 THEN NULL ELSE 19753 - u.user_id % 900 END AS sign_up_day,
       u.user_id % 2 AS saw_walkthrough, CASE WHEN u.user_id % 7 = 0 THEN 1 ELSE 0 END AS is_business,
       CASE WHEN u.user_id % 8 = 0 THEN 1 ELSE 0 END AS is_referred,
       CASE WHEN u.user_id % 9 = 0 THEN 1 ELSE 0 END AS has_sso, u.user_id % 4 AS lost_pw_requests,
       CASE WHEN u.user_id % 10 = 0 THEN 1 ELSE 0 END AS totp_enabled, u.user_id % 3 AS invites_accepted
FROM (SELECT DISTINCT user_id FROM {fx_events} WHERE user_id IS NOT NULL) u
LEFT JOIN (SELECT user_id, SUM(size) AS bytes FROM {fx_files} GROUP BY user_id) f ON u.user_id = f.user_id""",
    "fx_billing": """
SELECT event_id, ts, user_id AS uid,
       CASE WHEN event_id % 40 = 0 THEN 'GRACE_WATCH'
            WHEN event_id % 41 = 0 THEN 'RECONCILIATION_CRITICAL' ELSE 'USER_STATE' END AS action,
       CASE WHEN event_id % 29 = 0 THEN 'error' ELSE 'info' END AS level
FROM {events} WHERE event_type = 'purchase'""",
    "fx_expiry": """
SELECT event_id, user_id, created_at, 19753 + event_id % 60 - 10 AS expires_day,
       CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS has_pm
FROM {fx_events} WHERE event_type LIKE 'subscription.%' AND user_id IS NOT NULL""",
}

PLAN_STORAGE_SQL = """
SELECT * FROM (VALUES (0, 2, 'Free'), (1, 30, 'Basic'), (2, 30, 'Basic-annual'), (3, 100, 'Pro'),
  (4, 100, 'Pro-annual'), (5, 1000, 'Master'), (6, 1000, 'Master-annual'))
  AS p(billing_plan_id, storage_gb, plan_name)"""

# amounts and volumes of the test tables differ from the defaults
TEST_CONFIG = replace(
    Config(),
    annual_amount=400000.0, monthly_max_amount=250000.0, monthly_min_txns=2,
    tiers=(("Platinum", 3000000.0), ("Gold", 1500000.0), ("Silver", 500000.0)),
    winback_vip_ltv=2500000.0, winback_emerging_ltv=1000000.0,
    urgent_ltv=200000.0, vip_ltv=400000.0, lapsed_ltv=1000000.0, high_value=250000.0,
    heavy_downloads=1, power_actions=3, streamer_streams=0, winback_heavy_actions=2,
    bulk_threshold=10, heavy_gb=8.0, media_requests=5,
    panel_start=date(2024, 1, 8), panel_end=date(2024, 1, 16), era_cutover=date(2024, 1, 15),
    tasks_since=date(2024, 1, 1), tasks_warmup=10, subs_since=date(2024, 1, 10),
    churn_start=date(2024, 1, 8), churn_horizon=7,
    ltv_start=date(2019, 1, 1), ltv_v1_start=date(2019, 1, 1), ltv_split=date(2022, 1, 1),
)

CHURN_SNAPSHOTS = (date(2024, 1, 8), date(2024, 1, 15), date(2024, 1, 22))
LTV_DATES = tuple(
    date(y, m, 1) for y in range(2019, 2024) for m in (1, 4, 7, 10) if (y, m) <= (2023, 1)
)


def _bind(text: str, names: dict[str, str]) -> str:
    for key, name in names.items():
        text = text.replace("{" + key + "}", name)
    return text


def load(spark: SparkSession, sf_dir: str) -> Tables:
    """Lazy logical tables over ``sf_dir/*.parquet``."""
    prepare(spark)
    names = {}
    for base in BASE_TABLES:
        names[base] = f"tidemark_src_{base}"
        spark.read.parquet(f"{sf_dir.rstrip('/')}/{base}.parquet").createOrReplaceTempView(names[base])
    frames: dict[str, DataFrame] = {}
    for view, text in VIEWS.items():
        names[view] = f"tidemark_{view}"
        frames[view] = spark.sql(_bind(text, names))
        frames[view].createOrReplaceTempView(names[view])
    return Tables(
        events=frames["fx_events"], revenue=frames["fx_revenue"], requests=frames["fx_requests"],
        subscription_state=frames["fx_subscription_state"], vid_user_map=frames["fx_vid_user_map"],
        bw_user_day=frames["fx_bw_user_day"], files=frames["fx_files"],
        accounts=frames["fx_accounts"], billing=frames["fx_billing"],
        expiry=frames["fx_expiry"], plan_storage=plan_storage(spark), location=sf_dir,
    )


_FEEDS: dict[tuple[str, str, int], str] = {}


def feed(spark: SparkSession, sf_dir: str, parts: int = 3, repeats: int = 1) -> str:
    """The events table as ``parts`` files in time order (each delivered ``repeats`` times): a stream over them takes as
    many micro-batches. Written once per application."""
    key = (spark.sparkContext.applicationId, sf_dir, repeats)
    if key not in _FEEDS or not files.exists(spark, _FEEDS[key]):
        _FEEDS[key] = scratch_dir(spark, "feed")
        ordered = spark.read.parquet(f"{sf_dir.rstrip('/')}/events*.parquet").repartitionByRange(parts, "ts", "event_id")
        for _ in range(repeats):
            ordered.write.mode("append").parquet(_FEEDS[key])
    return _FEEDS[key]


def load_stream(spark: SparkSession, sf_dir: str, files_per_batch: int = 1, repeats: int = 1) -> dict[str, DataFrame]:
    """The event-born views as streams over several files of the same rows."""
    prepare(spark)
    path = feed(spark, sf_dir, repeats=repeats)
    schema = spark.read.parquet(path).schema
    stream = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    )
    names = {"events": "tidemark_stream_events", "fx_events": "tidemark_stream_fx_events"}
    stream.createOrReplaceTempView(names["events"])
    frames = {}
    for view in ("fx_events", "fx_requests"):
        frames[view] = spark.sql(_bind(VIEWS[view], names))
    return frames


def with_views(body: str) -> str:
    """Put the adapter views in front of a DuckDB query (``[ctes] SELECT``)."""
    names = {k: k for k in (*BASE_TABLES, *VIEWS)}
    ctes = [f"{view} AS ({_bind(text, names)})" for view, text in VIEWS.items()]
    ctes.append(f"fx_plan_storage AS ({PLAN_STORAGE_SQL})")
    body = body.strip()
    glue = "\n" if body.upper().startswith(("SELECT", "(SELECT")) else ",\n"
    return "WITH " + ",\n".join(ctes) + glue + body
