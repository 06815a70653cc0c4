"""Feature tables, scores, customer profile and win-back with their check SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.catalog import sqlparts as p
from tidemark.catalog.panels import churn_sql, ltv_sql
from tidemark.catalog.registry import query
from tidemark.operators import extracts as x
from tidemark.operators import features as f
from tidemark.plans import churn_panel as churn
from tidemark.plans import customer_profile as cp
from tidemark.plans import ltv_eda as eda
from tidemark.plans import ltv_panel as ltv
from tidemark.plans import scoring as sc
from tidemark.plans import winback as wb
from tidemark.plans.feature_store import FeatureStore
from tidemark.session import scratch_dir
from tidemark.sources import filetree as tree
from tidemark.sources.fixtures import AS_OF, CHURN_SNAPSHOTS, TEST_CONFIG as CFG
from tidemark.sources.tables import Tables

C = F.col

EDGE = """edge AS (SELECT user_id, COUNT(*) AS edge_requests_7d, ROUND(SUM(bytes_sent) / 1e9, 3) AS edge_gb_7d,
  COUNT(*) FILTER (base_path = '/media') AS media_requests_7d,
  ROUND(COALESCE(SUM(bytes_sent) FILTER (base_path = '/media'), 0) / 1e9, 3) AS stream_gb_7d,
  COUNT(*) FILTER (status = 429) AS n_rate_limited_7d, COUNT(*) FILTER (is_stall = 1) AS n_stall_7d,
  COUNT(*) FILTER (status >= 500) AS n_errors_7d, COUNT(DISTINCT file_id) AS distinct_files_7d,
  COUNT(DISTINCT CAST(ts AS DATE)) AS active_days_7d,
  ROUND(CAST(COUNT(*) FILTER (proto = 'h3') AS DOUBLE) / COUNT(*), 3) AS h3_share,
  COUNT(*) FILTER (base_path = '/app') AS app_requests_7d, COUNT(DISTINCT country) AS n_countries
  FROM fx_requests WHERE ts >= TIMESTAMP '2024-01-24 00:00:00' AND user_id <> 0 GROUP BY user_id)"""

TASKS = """tasks AS (SELECT user_id, COUNT(*) FILTER (event_type = 'task.completed') AS downloads_30d,
  COUNT(*) FILTER (event_type = 'task.failed') AS tasks_failed_30d,
  ROUND(CAST(COUNT(*) FILTER (event_type = 'task.failed') AS DOUBLE) / greatest(COUNT(*), 1), 3) AS task_failure_rate,
  COUNT(DISTINCT CAST(created_at AS DATE)) AS active_task_days_30d,
  CAST(date_diff('day', CAST(MAX(created_at) AS DATE), DATE '2024-01-31') AS INTEGER) AS days_since_last_task
  FROM fx_events WHERE event_type LIKE 'task.%' AND created_at >= TIMESTAMP '2024-01-01 00:00:00'
  AND user_id IS NOT NULL GROUP BY user_id)"""

BILLING = """health AS (SELECT uid AS user_id,
  CAST(COUNT(*) FILTER (action = 'GRACE_WATCH') > 0 AS INTEGER) AS in_grace_period,
  CAST(COUNT(*) FILTER (action = 'RECONCILIATION_CRITICAL') > 0 AS INTEGER) AS reconciliation_critical,
  COUNT(*) FILTER (level = 'error') AS billing_errors_30d,
  CAST(date_diff('day', CAST(MAX(ts) AS DATE), DATE '2024-01-31') AS INTEGER) AS days_since_billing_event
  FROM fx_billing WHERE ts >= TIMESTAMP '2023-12-17 00:00:00' AND uid <> 0 GROUP BY uid)"""

CATS = ("archive", "audio", "ebook", "image", "other", "software", "submeta", "video")
PER_CAT = ", ".join(
    f"COUNT(*) FILTER (cat = '{c}') AS n_{c}_, COALESCE(SUM(size) FILTER (cat = '{c}'), 0) AS b_{c}" for c in CATS)
BY_CAT = " UNION ALL ".join(
    f"SELECT user_id, '{c}' AS cat, n_{c}_ AS n, b_{c} AS b, bytes FROM agg" for c in CATS)


def content_ctes(nodes: str, accounts: str) -> str:
    """Content profile over node and account relations of the given names."""
    def ok(expr: str, name: str) -> str:
        return f"CASE WHEN a.content_status = 'ok' THEN {expr} END AS {name}"

    def gb(c: str) -> str:
        return ok(f"ROUND(COALESCE(b_{c}, 0) / 1e9, 2)", f"gb_{c}")

    def share(c: str) -> str:
        return ok(f"CASE WHEN root_size > 0 THEN ROUND((COALESCE(b_{c}, 0) / 1e9) / (root_size / 1e9), 3) "
                  f"ELSE 0.0 END", f"share_{c}")

    return f"""nodes AS (SELECT *, CASE regexp_extract(lower(relative_path), '[.]([a-z0-9]*)$', 1)
    WHEN 'mkv' THEN 'video' WHEN 'mp4' THEN 'video' WHEN 'flac' THEN 'audio' WHEN 'epub' THEN 'ebook'
    WHEN 'iso' THEN 'software' WHEN 'zip' THEN 'archive' WHEN 'srt' THEN 'submeta' ELSE 'other' END AS cat
  FROM {nodes}),
agg AS (SELECT user_id, COUNT(*) AS n_files, SUM(size) AS bytes, MAX(size) AS largest, SUM(is_lost) AS lost,
    COUNT(DISTINCT folder_id) AS folders, MIN(last_update_day) AS d0, MAX(last_update_day) AS d1,
    COUNT(*) FILTER (19753 - last_update_day <= 30) AS a30, COUNT(*) FILTER (19753 - last_update_day <= 90) AS a90,
    {PER_CAT} FROM nodes GROUP BY user_id),
pri AS (SELECT user_id, cat FROM (SELECT *, row_number() OVER (PARTITION BY user_id
    ORDER BY CASE WHEN bytes > 0 THEN b ELSE n END DESC, cat) AS rn FROM ({BY_CAT})) WHERE rn = 1),
content AS (SELECT a.user_id, a.content_status,
  CASE WHEN a.content_status = 'ok' THEN COALESCE(n_files, 0) ELSE 0 END AS n_files,
  {ok("ROUND(root_size / 1e9, 3)", "storage_gb")}, {ok("ROUND(COALESCE(bytes, 0) / 1e9, 3)", "library_gb")},
  {ok("ROUND(COALESCE(largest, 0) / 1e9, 3)", "largest_file_gb")},
  {ok("COALESCE(ROUND((bytes / 1e9) / n_files, 4), 0.0)", "avg_file_gb")},
  {", ".join(ok(f"COALESCE(n_{c}_, 0)", f"n_{c}") for c in ("video", "audio", "ebook", "software", "archive", "image"))},
  {ok("COALESCE(n_other_ + n_submeta_, 0)", "n_other")},
  {", ".join(gb(c) for c in ("video", "audio", "ebook", "software", "archive", "image"))},
  {", ".join(share(c) for c in ("video", "audio", "ebook", "software"))},
  {ok("COALESCE(p.cat, 'none')", "primary_category")},
  {ok("CASE COALESCE(p.cat, 'none') WHEN 'none' THEN 'empty' WHEN 'video' THEN 'video_streamer' "
      "WHEN 'audio' THEN 'music_audio' WHEN 'ebook' THEN 'reader' WHEN 'software' THEN 'software_downloader' "
      "WHEN 'archive' THEN 'archive_hoarder' WHEN 'image' THEN 'image_store' ELSE 'mixed' END", "content_persona")},
  {ok("COALESCE(19753 - d1, -1)", "days_since_last_add")},
  {ok("ROUND(bandwidth_used / 1e9, 3)", "bandwidth_used_gb")},
  {ok("COALESCE(last_signin_day, -1)", "last_signin_day")},
  {ok("COALESCE(19753 - sign_up_day, -1)", "account_age_days")},
  {ok("COALESCE(folders, 0)", "n_folders")}, {ok("CAST(COALESCE(lost, 0) AS BIGINT)", "n_lost_files")},
  {ok("COALESCE(a30, 0)", "files_added_30d")}, {ok("COALESCE(a90, 0)", "files_added_90d")},
  {ok("COALESCE(19753 - d0, -1)", "library_age_days")},
  {", ".join(ok(c, c) for c in ("saw_walkthrough", "is_business", "is_referred", "has_sso", "lost_pw_requests",
                                "totp_enabled", "invites_accepted"))}
  FROM {accounts} a LEFT JOIN agg ON agg.user_id = a.user_id LEFT JOIN pri p ON p.user_id = a.user_id)"""


CONTENT = content_ctes("fx_files", "fx_accounts")

TIER = "CASE WHEN {0} >= 3000000 THEN 'Platinum' WHEN {0} >= 1500000 THEN 'Gold' WHEN {0} >= 500000 THEN 'Silver' " \
       "WHEN {0} > 0 THEN 'Bronze' ELSE 'Prospect' END"
LTV = f"""ltv_today AS (WITH {ltv_sql("(19753)", 2, False, "* EXCLUDE (label_rev_365)")}),
ltvs AS (SELECT user_id, rev_365 AS pred_ltv_12m, rev_365 AS pred_ltv_gbm, recency_days, frequency,
    monetary_sum AS ltv_to_date, rev_365 AS rev_365_prior, last_amount, is_annual, country, provider, last_plan_id,
    {TIER.format('monetary_sum')} AS value_tier,
    CAST(greatest(1, ((rn - 1) * 10 + greatest(n - 1, 1) - 1) // greatest(n - 1, 1)) AS INTEGER) AS ltv_decile
  FROM (SELECT *, row_number() OVER (ORDER BY rev_365, user_id) AS rn, COUNT(*) OVER () AS n FROM ltv_today))"""
CHURN = f"""churn_today AS (WITH {churn_sql("(19753)", 7, False)}),
exp AS (SELECT user_id, arg_max(expires_day, (created_at, event_id)) AS ed, arg_max(has_pm, (created_at, event_id)) AS pm
  FROM fx_expiry GROUP BY user_id),
scored AS (SELECT c.*, CAST(least(5 + 10 * prior_cancels, 85) AS DOUBLE) / 100 AS risk,
    COALESCE(ed - 19753, -999) AS dte, COALESCE(pm, -1) AS pm
  FROM churn_today c LEFT JOIN exp ON exp.user_id = c.user_id),
ruled AS (SELECT *, CASE WHEN dte BETWEEN -7 AND 30 AND pm = 0 THEN 0.95::DOUBLE
    WHEN dte BETWEEN 0 AND 30 AND had_cancel_sched_30 = 1 THEN 0.9::DOUBLE
    WHEN dte BETWEEN 0 AND 15 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS brisk FROM scored),
chs AS (SELECT user_id, ROUND(greatest(risk, brisk), 4) AS churn_risk_30d, ROUND(risk, 4) AS model_risk,
    dte AS days_to_expires, pm AS has_payment_method,
    CASE WHEN brisk > risk THEN 'billing_rule' ELSE 'model' END AS risk_source,
    had_cancel_sched_30 AS had_cancel_sched, days_since_last_txn, cycle_position, sub_tenure_days, last_sub_event,
    prior_reactivations, ltv_before_usd, is_annual, CASE WHEN country = '' THEN 'unknown' ELSE country END AS country
  FROM ruled)"""
QUOTA = """quota AS (SELECT l.user_id, l.last_plan_id, COALESCE(p.plan_name, 'unmapped') AS plan_name,
  COALESCE(p.storage_gb, 0) AS plan_gb, COALESCE(c.storage_gb, 0.0) AS used_gb,
  CASE WHEN p.storage_gb > 0 AND c.storage_gb IS NOT NULL THEN ROUND(ROUND(c.storage_gb * 1000) / p.storage_gb) / 10
       ELSE -1.0 END AS storage_used_pct
  FROM ltvs l LEFT JOIN fx_plan_storage p ON CAST(l.last_plan_id AS BIGINT) = p.billing_plan_id
  LEFT JOIN content c ON c.user_id = l.user_id)"""
PROFILE = f"""{EDGE}, {TASKS}, {BILLING}, {CONTENT}, {LTV}, {CHURN}, {QUOTA},
c360 AS (SELECT l.user_id, l.value_tier, l.pred_ltv_12m, l.ltv_decile, l.country, l.is_annual, l.recency_days,
  COALESCE(ch.churn_risk_30d, -1.0) AS churn_risk_30d, COALESCE(ch.has_payment_method, -1) AS has_payment_method,
  COALESCE(ch.days_to_expires, -999) AS days_to_expires, COALESCE(ch.had_cancel_sched, 0) AS had_cancel_sched,
  COALESCE(bh.in_grace_period, 0) AS in_grace_period, COALESCE(bh.reconciliation_critical, 0) AS reconciliation_critical,
  COALESCE(co.content_persona, 'unknown') AS content_persona, COALESCE(co.storage_gb, -1.0) AS storage_gb,
  COALESCE(co.files_added_30d, 0) AS files_added_30d, COALESCE(co.n_lost_files, 0) AS n_lost_files,
  COALESCE(co.saw_walkthrough, -1) AS saw_walkthrough, COALESCE(sq.storage_used_pct, -1.0) AS storage_used_pct,
  COALESCE(sq.plan_name, 'unknown') AS plan_name, COALESCE(e.n_rate_limited_7d, 0) AS n_rate_limited_7d,
  COALESCE(e.n_stall_7d, 0) AS n_stall_7d, COALESCE(e.media_requests_7d, 0) AS media_requests_7d,
  COALESCE(e.stream_gb_7d, 0.0) AS stream_gb_7d, COALESCE(t.downloads_30d, 0) AS downloads_30d,
  COALESCE(t.task_failure_rate, 0.0) AS task_failure_rate,
  CASE WHEN ch.churn_risk_30d IS NOT NULL THEN 'subscriber' ELSE 'lapsed_or_free' END AS lifecycle_stage,
  CASE WHEN COALESCE(bh.in_grace_period, 0) = 1 OR (COALESCE(ch.has_payment_method, -1) = 0
        AND COALESCE(ch.days_to_expires, -999) BETWEEN -7 AND 30) THEN 'fix_payment'
    WHEN COALESCE(ch.churn_risk_30d, 0) >= 0.5 AND l.pred_ltv_12m >= 200000 THEN 'urgent_save'
    WHEN co.content_persona = 'video_streamer' AND (e.n_rate_limited_7d > 0 OR e.n_stall_7d > 5) THEN 'hd_upsell'
    WHEN sq.storage_used_pct >= 80 AND COALESCE(sq.plan_name, '') NOT IN ('Master', 'Master-annual', 'unmapped', 'unknown')
      THEN 'storage_upsell'
    WHEN co.content_persona = 'empty' THEN 'reactivate_empty' WHEN l.pred_ltv_12m >= 400000 THEN 'vip_nurture'
    ELSE 'monitor' END AS next_best_action
  FROM ltvs l LEFT JOIN chs ch ON l.user_id = ch.user_id LEFT JOIN health bh ON l.user_id = bh.user_id
  LEFT JOIN content co ON l.user_id = co.user_id LEFT JOIN edge e ON l.user_id = e.user_id
  LEFT JOIN tasks t ON l.user_id = t.user_id LEFT JOIN quota sq ON l.user_id = sq.user_id)"""


# --- the same tables on Spark -----------------------------------------------------
def ltv_table(t: Tables) -> DataFrame:
    """Persistence scores: next year is last year."""
    rows = ltv.score_rows(t.revenue, AS_OF, CFG)
    return sc.ltv_scores(rows.withColumns({"pred_ltv_12m": C("rev_365"), "pred_ltv_gbm": C("rev_365")}), CFG)


def churn_table(t: Tables) -> DataFrame:
    """Churn scores with a fixed formula in place of a trained model."""
    rows = churn.build_churn_panel(t, [AS_OF.date()], AS_OF, CFG, with_label=False)
    risk = F.least(C("prior_cancels") * 10 + 5, F.lit(85)).cast("double") / 100
    return sc.churn_scores(rows.withColumn("model_risk", risk), t.expiry, AS_OF, CFG)


def content_table(t: Tables) -> DataFrame:
    return f.user_content(t.files, t.accounts, AS_OF)


_STORES: dict[tuple[str, str], FeatureStore] = {}


FEATURE_TABLES = ("ltv", "churn", "billing", "content", "edge", "tasks", "quota")
NOW_TABLES = ("content", "quota", "edge", "tasks")


def feature_store(t: Tables, names: Sequence[str] = FEATURE_TABLES) -> FeatureStore:
    """The feature tables of the day, each written once per application, as the daily job would, and read by all that joins them.
    Of the tables only ``names`` and what they are made from are sure to be there."""
    spark, day = t.events.sparkSession, AS_OF.date()
    kept = (spark.sparkContext.applicationId, t.location)
    if kept not in _STORES:
        root = scratch_dir(spark, "features")
        _STORES[kept] = FeatureStore(root, "tidemark_" + root.rsplit("-", 1)[1], 8)
    store = _STORES[kept]
    wanted = {*names, *(("ltv", "content") if "quota" in names else ())}
    steps = [{
        "ltv": lambda: ltv_table(t), "content": lambda: content_table(t), "churn": lambda: churn_table(t),
        "billing": lambda: f.user_billing_health(t.billing, AS_OF, CFG), "edge": lambda: f.user_edge(t.requests, AS_OF, CFG),
        "tasks": lambda: f.user_tasks(t.events, AS_OF, CFG),
    }, {"quota": lambda: f.user_storage_quota(store.read(spark, "ltv", day), t.plan_storage, store.read(spark, "content", day))}]
    store.write_day(spark, day, [{n: rows for n, rows in step.items() if n in wanted and not store.has(spark, n, day)} for step in steps])
    return store


def profile_table(t: Tables) -> DataFrame:
    """The profile over the stored tables, bucket by bucket."""
    spark, store = t.events.sparkSession, feature_store(t)
    parts = [store.read(spark, name) for name in FEATURE_TABLES]
    return cp.customer_360(*parts, CFG)


query("feature_user_edge", "K-1 A-1 A-2 A-9 A-11", f"{EDGE} SELECT * FROM edge")(
    lambda t: f.user_edge(t.requests, AS_OF, CFG))
query("feature_user_tasks", "K-2 X-2 Q-19", f"{TASKS} SELECT * FROM tasks")(
    lambda t: f.user_tasks(t.events, AS_OF, CFG))
query("feature_billing_health", "K-3 X-15", f"{BILLING} SELECT * FROM health")(
    lambda t: f.user_billing_health(t.billing, AS_OF, CFG))
query("feature_storage_quota", "K-4 J-8 IO-15", f"{CONTENT}, {LTV}, {QUOTA} SELECT * FROM quota")(
    lambda t: f.user_storage_quota(ltv_table(t), t.plan_storage, content_table(t)))
query("feature_user_content", "K-5 F-16 X-9 X-17 Q-18 A-23", f"{CONTENT} SELECT * FROM content")(content_table)
query("feature_readable_content", "F-22", f"""{CONTENT}
SELECT user_id, n_files, content_persona, CAST(n_files = 0 AS INTEGER) AS is_empty FROM content
WHERE content_status = 'ok'""")(
    lambda t: f.readable_content(content_table(t)).select("user_id", "n_files", "content_persona", "is_empty"))
NOW = f"""{EDGE}, {TASKS}, {CONTENT}, {LTV}, {QUOTA}, now_f AS (SELECT c.user_id, COALESCE(q.storage_used_pct, -1.0) AS storage_used_pct,
  COALESCE(c.content_persona, 'unknown') AS content_persona, COALESCE(c.n_lost_files, 0) AS n_lost_files,
  COALESCE(c.files_added_30d, 0) AS files_added_30d, COALESCE(c.storage_gb, -1.0) AS content_storage_gb,
  COALESCE(c.share_video, -1.0) AS share_video, COALESCE(c.bandwidth_used_gb, -1.0) AS bandwidth_used_gb,
  COALESCE(e.n_rate_limited_7d, 0) AS n_rate_limited_7d, COALESCE(e.n_stall_7d, 0) AS n_stall_7d,
  COALESCE(e.stream_gb_7d, 0.0) AS stream_gb_7d, COALESCE(t.downloads_30d, 0) AS downloads_30d,
  COALESCE(t.task_failure_rate, 0.0) AS task_failure_rate
FROM content c LEFT JOIN quota q ON q.user_id = c.user_id LEFT JOIN edge e ON e.user_id = c.user_id
LEFT JOIN tasks t ON t.user_id = c.user_id)"""


def now_table(t: Tables) -> DataFrame:
    spark, store = t.events.sparkSession, feature_store(t, NOW_TABLES)
    return f.now_features(*[store.read(spark, name) for name in NOW_TABLES])


query("feature_now", "K-22 J-11", f"{NOW} SELECT * FROM now_f")(now_table)

CAMPAIGN_SQL = f"""d AS (SELECT json_extract_string(metadata, '$.email_id') AS email_id, CAST({p.EDAY.format('created_at')} AS INTEGER) AS day,
  COUNT(*) FILTER (event_type = 'email.sent') AS sent, COUNT(*) FILTER (event_type = 'email.opened') AS opened, COUNT(*) FILTER (event_type = 'email.clicked') AS clicked
  FROM fx_events WHERE event_type IN ('email.sent', 'email.opened', 'email.clicked') GROUP BY ALL),
h AS (SELECT a.email_id, a.day, CAST(COALESCE(SUM(b.sent) FILTER (b.email_id = a.email_id), 0) AS BIGINT) AS sent_before,
  (COALESCE(SUM(b.opened) FILTER (b.email_id = a.email_id), 0) + 50 * SUM(b.opened) / NULLIF(SUM(b.sent), 0)::DOUBLE) / (COALESCE(SUM(b.sent) FILTER (b.email_id = a.email_id), 0) + 50) AS open_rate_before,
  (COALESCE(SUM(b.clicked) FILTER (b.email_id = a.email_id), 0) + 50 * SUM(b.clicked) / NULLIF(SUM(b.sent), 0)::DOUBLE) / (COALESCE(SUM(b.sent) FILTER (b.email_id = a.email_id), 0) + 50) AS click_rate_before
  FROM d a LEFT JOIN d b ON b.day < a.day GROUP BY a.email_id, a.day)"""
query("feature_campaign_history", "E-8 W-4", f"{CAMPAIGN_SQL} SELECT * FROM h")(
    lambda t: f.campaign_history(f.campaign_days(t.events)))
query("feature_send_history", "E-8 J-18", f"""{p.BULK}, {CAMPAIGN_SQL}
SELECT detail.*, sent_before, open_rate_before, click_rate_before FROM detail LEFT JOIN h USING (email_id, day)""")(
    lambda t: f.with_campaign_history(x.send_detail(t.events, CFG), f.campaign_history(f.campaign_days(t.events)), CFG.salts))

query("score_ltv", "K-17 M-12 W-10", f"{LTV} SELECT * FROM ltvs")(ltv_table)
query("score_ltv_tiers", "K-17 A-21", f"""{LTV} SELECT value_tier, COUNT(*) AS users,
  AVG(pred_ltv_12m) AS avg_pred_ltv, SUM(pred_ltv_12m) AS sum_pred FROM ltvs GROUP BY value_tier""")(
    lambda t: sc.tier_summary(ltv_table(t)))
query("score_ltv_top_decile", "K-17 T-5", f"""{LTV} SELECT SUM(pred_ltv_12m) AS total_pred,
  COUNT(*) FILTER (ltv_decile = 10) AS top_users,
  SUM(pred_ltv_12m) FILTER (ltv_decile = 10) / SUM(pred_ltv_12m) AS top_share FROM ltvs""")(
    lambda t: sc.top_decile_share(ltv_table(t)))
query("score_churn", "K-15 K-16 Q-6", f"{CHURN} SELECT * FROM chs")(churn_table)
query("score_churn_summary", "K-15 Q-16", f"""{CHURN} SELECT COUNT(*) AS scored, AVG(model_risk) AS mean_model_risk,
  CAST(SUM(had_cancel_sched) AS BIGINT) AS cancel_scheduled, COUNT(*) FILTER (model_risk > 0.5) AS high_model_risk,
  COUNT(*) FILTER (churn_risk_30d > 0.5) AS high_final_risk FROM chs""")(lambda t: sc.risk_summary(churn_table(t)))

query("profile_customer_360", "K-6 K-7 J-6 F-12 F-14 F-15 Q-8 X-7", f"{PROFILE} SELECT * FROM c360")(profile_table)
query("profile_action_counts", "K-7 IO-18 A-22", f"""{PROFILE}
SELECT next_best_action, COUNT(*) AS users FROM c360 GROUP BY 1""")(
    lambda t: profile_table(t).groupBy("next_best_action").agg(F.count(F.lit(1)).alias("users")))
PRIORITY = f"""{LTV}, {CHURN}, pr AS (SELECT l.user_id, l.value_tier, l.pred_ltv_12m, c.churn_risk_30d, c.had_cancel_sched,
  c.has_payment_method, c.days_to_expires, ROUND(l.pred_ltv_12m * c.churn_risk_30d, 2) AS expected_loss,
  CASE WHEN has_payment_method = 0 AND days_to_expires BETWEEN -7 AND 30 THEN 'P0_fix_payment'
    WHEN pred_ltv_12m >= 250000 AND (churn_risk_30d >= 0.3 OR had_cancel_sched = 1) THEN 'P1_urgent_save'
    WHEN pred_ltv_12m >= 250000 THEN 'P2_high_value_nurture'
    WHEN churn_risk_30d >= 0.3 OR had_cancel_sched = 1 THEN 'P3_at_risk_lowvalue' ELSE 'P4_monitor' END AS priority
  FROM ltvs l JOIN chs c ON l.user_id = c.user_id)"""
query("profile_retention_priority", "K-9 J-20 Q-5", f"{PRIORITY} SELECT * FROM pr")(
    lambda t: cp.retention_priority(ltv_table(t), churn_table(t), CFG))
query("profile_priority_summary", "K-9 A-21", f"""{PRIORITY} SELECT priority, COUNT(*) AS users,
  AVG(pred_ltv_12m) AS avg_value, AVG(churn_risk_30d) AS avg_risk, SUM(expected_loss) AS at_risk FROM pr
  GROUP BY priority""")(
    lambda t: cp.priority_summary(cp.retention_priority(ltv_table(t), churn_table(t), CFG)))

W45 = "TIMESTAMP '2023-12-17 00:00:00'"
WINBACK = f"""
base AS (SELECT user_id, arg_max(event_type, (created_at, event_id)) AS churn_type,
    strftime(CAST(MAX(created_at) AS DATE), '%Y-%m-%d') AS churn_date,
    CAST(date_diff('day', CAST(MAX(created_at) AS DATE), DATE '2024-01-31') AS INTEGER) AS days_since_churn
  FROM fx_events WHERE created_at >= TIMESTAMP '2024-01-01 00:00:00' AND user_id IS NOT NULL
  AND event_type IN ('subscription.canceled', 'subscription.expired') GROUP BY user_id),
sb AS (SELECT user_id, COUNT(*) FILTER (event_type = 'subscription.reactivated') AS prior_reactivations,
    COUNT(*) FILTER (event_type = 'subscription.payment_failed' AND created_at >= {W45}) AS recent_payment_failed,
    COUNT(*) FILTER (event_type = 'subscription.cancellation_scheduled' AND created_at >= {W45}) AS recent_cancel_sched
  FROM fx_events WHERE event_type LIKE 'subscription.%' GROUP BY user_id),
rv AS (SELECT user_id, SUM(amount_usd) AS ltv, COUNT(*) AS txns,
    arg_max(amount_usd, (transaction_date, txn_id)) AS last_amount,
    arg_max(billing_plan_id, (transaction_date, txn_id)) AS last_plan_id,
    CAST(MIN(transaction_date) AS DATE) AS d0, CAST(MAX(transaction_date) AS DATE) AS d1
  FROM fx_revenue WHERE status = 'completed' GROUP BY user_id),
ct AS (SELECT user_id, country, row_number() OVER (PARTITION BY user_id ORDER BY COUNT(*) DESC, country) AS rn
  FROM fx_events WHERE user_id IS NOT NULL GROUP BY user_id, country),
eg AS (SELECT user_id, COUNT(*) FILTER (event_type = 'pageview') AS pageviews_120,
    COUNT(DISTINCT CASE WHEN surface IN ('web', 'landing') THEN CAST(created_at AS DATE) END) AS web_active_days_120,
    COUNT(*) FILTER (category = 'File' AND action = 'Download')
      + COUNT(*) FILTER (category = 'Archive' AND action = 'Download') AS total_downloads,
    COUNT(*) FILTER (category = 'video' AND action IN ('stream_start', 'stream_session')) AS streams_120,
    COUNT(*) FILTER (category = 'Promotional' AND action = 'visited_subscription') AS promo_sub_120,
    CAST(date_diff('day', CAST(MAX(created_at) AS DATE), DATE '2024-01-31') AS INTEGER) AS days_since_last_web,
    COUNT(*) FILTER (event_type = 'email.sent') AS em_sent, COUNT(*) FILTER (event_type = 'email.opened') AS em_opened,
    COUNT(*) FILTER (event_type = 'email.clicked') AS em_clicked,
    ROUND(CAST(COUNT(*) FILTER (regexp_matches(ua, 'Mobile|Android')) AS DOUBLE)
          / greatest(COUNT(*) FILTER (ua <> ''), 1), 2) AS mobile_share, COUNT(DISTINCT vid) AS devices
  FROM fx_events WHERE user_id IS NOT NULL GROUP BY user_id),
w AS (SELECT b.*, COALESCE(prior_reactivations, 0) AS prior_reactivations,
    COALESCE(recent_payment_failed, 0) AS recent_payment_failed, COALESCE(recent_cancel_sched, 0) AS recent_cancel_sched,
    COALESCE(CAST(ltv AS DOUBLE), 0) AS ltv_usd, COALESCE(txns, 0) AS txns,
    COALESCE(CAST(last_amount AS DOUBLE), 0) AS last_amount, last_plan_id, strftime(d0, '%Y-%m-%d') AS first_purchase,
    strftime(d1, '%Y-%m-%d') AS last_purchase,
    CAST(COALESCE(date_diff('day', d0, d1), 0) AS INTEGER) AS customer_lifespan_days,
    COALESCE(country, 'unknown') AS country, eg.* EXCLUDE (user_id)
  FROM base b LEFT JOIN sb ON sb.user_id = b.user_id LEFT JOIN rv ON rv.user_id = b.user_id
  LEFT JOIN eg ON eg.user_id = b.user_id LEFT JOIN ct ON ct.user_id = b.user_id AND ct.rn = 1),
x AS (SELECT *, CASE WHEN em_sent > 0 THEN ROUND(CAST(em_opened AS DOUBLE) / em_sent, 3) ELSE 0.0 END AS email_open_rate,
    CAST(last_amount >= 400000 OR CAST(customer_lifespan_days AS DOUBLE) / greatest(txns, 1) > 180 AS INTEGER) AS is_annual,
    CAST(country IN ('in','id','ph','bd','ng','vn','lk','pk','ke','tz','ug','et','gh','mm') AS INTEGER) AS is_emerging,
    {TIER.format('ltv_usd')} AS value_tier FROM w),
g AS (SELECT *, CASE WHEN recent_payment_failed > 0 THEN 'involuntary_payment_failed'
    WHEN ltv_usd >= 2500000 OR value_tier = 'Platinum' THEN 'vip_high_value' WHEN is_annual = 1 THEN 'loyal_annual'
    WHEN prior_reactivations >= 1 THEN 'serial_reactivator'
    WHEN total_downloads + streams_120 >= 2 THEN 'heavy_user_productfit'
    WHEN is_emerging = 1 AND ltv_usd < 1000000 THEN 'emerging_price_sensitive'
    WHEN days_since_last_web <= 14 THEN 'engaged_recent' ELSE 'dormant_lowvalue' END AS winback_group FROM x)"""
OFFER = "CASE winback_group " + " ".join(
    f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in wb.OFFERS.items()) + " END"

query("winback_churned_base", "K-10 A-8 X-2", f"{WINBACK} SELECT * FROM base")(
    lambda t: wb.churned_base(t.events, AS_OF, CFG))
query("winback_master", "K-11 K-12 K-13 K-14 J-9 F-11 F-16 F-21 T-2 X-14 Q-14",
      f"{WINBACK} SELECT *, {OFFER} AS recommended_offer FROM g")(lambda t: wb.winback(t, AS_OF, CFG))
query("winback_groups", "K-14 A-21", f"""{WINBACK}
SELECT winback_group, COUNT(*) AS users, ROUND(AVG(ltv_usd), 0) AS avg_ltv, ROUND(SUM(ltv_usd), 0) AS total_ltv,
  ROUND(AVG(days_since_churn), 1) AS avg_days_since_churn FROM g GROUP BY 1""")(
    lambda t: wb.group_totals(wb.winback(t, AS_OF, CFG)))
query("winback_tiers", "K-14 A-22", f"{WINBACK} SELECT value_tier, COUNT(*) AS users FROM g GROUP BY 1")(
    lambda t: wb.winback(t, AS_OF, CFG).groupBy("value_tier").agg(F.count(F.lit(1)).alias("users")))


# --- file trees: JSON documents built row by row from the documents table ---------------
def landed_trees(t: Tables) -> DataFrame:
    """One JSON document per file row: object or list form, some broken, some not fetched."""
    doc = C("file_id")
    day = F.date_format(F.date_from_unix_date("last_update_day"), "yyyy-MM-dd HH:mm:ss")
    node = F.struct("size", "relative_path", day.alias("last_update"), "is_lost", "folder_id")
    thumb = F.struct(
        F.lit(None).cast("long").alias("size"), F.concat(F.lit("dir/.hid."), doc, F.lit(".JPG")).alias("relative_path"),
        F.lit("unknown").alias("last_update"), F.lit(0).alias("is_lost"), F.lit(None).cast("long").alias("folder_id"))
    user = F.struct((doc * 1000003).alias("bandwidth_used"), ((19753 - doc % 40) * 86400 + 7).alias("last_sign_in_stamp"),
                    F.when(doc % 6 != 0, (19753 - doc % 900) * 86400).alias("sign_up_stamp"),
                    (doc % 2).alias("saw_walkthrough"), (doc % 7).alias("org_id"))
    root = F.struct((C("size") * 2).alias("size"))
    as_map = F.to_json(F.struct(user.alias("user"), root.alias("root"),
                                F.struct(node.alias("a"), thumb.alias("b"), F.lit(7).alias("c")).alias("fs")))
    as_list = F.to_json(F.struct(user.alias("user"), root.alias("root"), F.array(node, thumb).alias("fs")))
    raw = F.when(doc % 13 == 5, F.substring(as_map, 1, 60)).when(doc % 2 == 0, as_map).otherwise(as_list)
    status = F.when(doc % 17 == 3, "timeout").otherwise("ok")
    return t.files.select(doc.alias("user_id"), status.alias("fetch_status"),
                          F.when(status == "ok", raw).alias("raw"))


TREE = f"""
tree_nodes AS (SELECT file_id AS user_id, size, relative_path, last_update_day, is_lost, folder_id
  FROM fx_files WHERE file_id % 17 <> 3 AND file_id % 13 <> 5
  UNION ALL SELECT file_id, 0, concat('dir/.hid.', CAST(file_id AS VARCHAR), '.JPG'), NULL, 0, NULL
  FROM fx_files WHERE file_id % 17 <> 3 AND file_id % 13 <> 5),
tree_accounts AS (SELECT file_id AS user_id, CASE WHEN file_id % 17 = 3 THEN 'timeout'
    WHEN file_id % 13 = 5 THEN 'error' ELSE 'ok' END AS content_status, size * 2 AS root_size,
    file_id * 1000003 AS bandwidth_used, 19753 - file_id % 40 AS last_signin_day,
    CASE WHEN file_id % 6 <> 0 THEN 19753 - file_id % 900 END AS sign_up_day, file_id % 2 AS saw_walkthrough,
    CAST(file_id % 7 > 0 AS INTEGER) AS is_business, 0 AS is_referred, 0 AS has_sso, 0 AS lost_pw_requests,
    0 AS totp_enabled, 0 AS invites_accepted FROM fx_files),
{content_ctes("tree_nodes", "tree_accounts").replace("ELSE 'other' END AS cat", "WHEN 'jpg' THEN 'image' ELSE 'other' END AS cat")}"""
query("content_from_json_trees", "IO-16 IO-22 K-5 X-9", f"{TREE} SELECT * FROM content")(
    lambda t: f.user_content(tree.parse_nodes(landed_trees(t)), tree.parse_accounts(landed_trees(t)), AS_OF))
query("content_status_counts", "IO-16 A-22", f"{TREE} SELECT content_status, COUNT(*) AS users FROM content GROUP BY 1")(
    lambda t: tree.parse_accounts(landed_trees(t)).groupBy("content_status").agg(F.count(F.lit(1)).alias("users")))
query("content_todo", "IO-17 U-3 U-4", f"""{TREE} SELECT DISTINCT user_id FROM fx_files
WHERE user_id NOT IN (SELECT user_id FROM tree_accounts WHERE content_status = 'ok')""")(
    lambda t: tree.todo(t.files.select("user_id"), tree.parse_accounts(landed_trees(t))))


# --- churn rates ------------------------------------------------------------------------
CHURN_PANEL = f"cp AS (WITH {churn_sql('(19730), (19737), (19744)', 7, True)})"


def churn_with_now(t: Tables) -> DataFrame:
    """The churn panel with the features that are known for the present only."""
    panel = churn.build_churn_panel(t, CHURN_SNAPSHOTS, AS_OF, CFG)
    return panel.join(now_table(t), "user_id", "left").fillna(f.NOW_DEFAULTS)


RATES = f"""{NOW}, {CHURN_PANEL}, lat AS (SELECT *, row_number() OVER (PARTITION BY user_id
  ORDER BY snapshot_date DESC) AS rn FROM cp),
j AS (SELECT l.user_id, label_churn_30 AS y, COALESCE(n.content_persona, 'unknown') AS content_persona,
    COALESCE(n.storage_used_pct, -1.0) AS pct FROM lat l LEFT JOIN now_f n ON n.user_id = l.user_id WHERE rn = 1)"""
query("churn_rate_by_persona", "K-20 W-8", f"""{RATES} SELECT content_persona, COUNT(*) AS users, AVG(y) AS churn_rate
FROM j WHERE content_persona IS NOT NULL GROUP BY 1 HAVING COUNT(*) >= 5""")(
    lambda t: eda.churn_rate_by(churn_with_now(t), "content_persona", min_rows=5))
query("churn_rate_by_storage", "K-20 X-14", f"""{RATES} SELECT CASE WHEN pct > 0 AND pct <= 50 THEN '<50%'
    WHEN pct > 50 AND pct <= 80 THEN '50-80%' WHEN pct > 80 AND pct <= 100 THEN '80-100%' WHEN pct > 100 THEN '100%+' END
    AS bucket, COUNT(*) AS users, AVG(y) AS churn_rate FROM j WHERE pct > 0 GROUP BY 1""")(
    lambda t: eda.churn_rate_by(
        churn_with_now(t).withColumn("bucket", eda.storage_bucket()), "bucket", min_rows=1))
