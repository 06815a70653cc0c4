"""Customer profile: one row per scored payer with a next best action."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.functions.scalar import case_chain

C = F.col

# output columns with their defaults when the user is absent from a feature table
DEFAULTS: dict[str, object] = {
    "churn_risk_30d": -1.0, "has_payment_method": -1, "days_to_expires": -999, "had_cancel_sched": 0,
    "in_grace_period": 0, "reconciliation_critical": 0,
    "content_persona": "unknown", "storage_gb": -1.0, "files_added_30d": 0, "n_lost_files": 0,
    "saw_walkthrough": -1, "storage_used_pct": -1.0, "plan_name": "unknown",
    "n_rate_limited_7d": 0, "n_stall_7d": 0, "media_requests_7d": 0, "stream_gb_7d": 0.0,
    "downloads_30d": 0, "task_failure_rate": 0.0,
}
# plans that have nothing larger to sell (or are not known at all)
NO_UPSELL_PLANS = ("Master", "Master-annual", "unmapped", "unknown")


def _or(col: str, default: object) -> Column:
    return F.coalesce(C(col), F.lit(default))


def next_best_action(cfg: Config) -> Column:
    """First rule that holds. Missing values take the rule's own default, which for
    the plan name is '' and not the 'unknown' shown in the table."""
    expiring = _or("days_to_expires", -999).between(-cfg.expiry_before, cfg.expiry_after)
    return case_chain([
        ((_or("in_grace_period", 0) == 1) | ((_or("has_payment_method", -1) == 0) & expiring), "fix_payment"),
        ((_or("churn_risk_30d", 0.0) >= cfg.urgent_risk) & (C("pred_ltv_12m") >= cfg.urgent_ltv), "urgent_save"),
        ((_or("content_persona", "") == "video_streamer")
         & ((_or("n_rate_limited_7d", 0) > 0) | (_or("n_stall_7d", 0) > cfg.stall_limit)), "hd_upsell"),
        ((_or("storage_used_pct", -1.0) >= cfg.storage_pct) & ~_or("plan_name", "").isin(*NO_UPSELL_PLANS),
         "storage_upsell"),
        (_or("content_persona", "") == "empty", "reactivate_empty"),
        (C("pred_ltv_12m") >= cfg.vip_ltv, "vip_nurture"),
    ], "monitor")


def customer_360(
    ltv_scores: DataFrame, churn_scores: DataFrame, billing_health: DataFrame, content: DataFrame,
    edge: DataFrame, tasks: DataFrame, quota: DataFrame, cfg: Config,
) -> DataFrame:
    """Star join on user_id; every table has one row per user."""
    base = ltv_scores.select("user_id", "value_tier", "pred_ltv_12m", "ltv_decile", "country", "is_annual",
                             "recency_days")
    parts = (
        churn_scores.select("user_id", "churn_risk_30d", "has_payment_method", "days_to_expires", "had_cancel_sched"),
        billing_health.select("user_id", "in_grace_period", "reconciliation_critical"),
        content.select("user_id", "content_persona", "storage_gb", "files_added_30d", "n_lost_files",
                       "saw_walkthrough"),
        edge.select("user_id", "n_rate_limited_7d", "n_stall_7d", "media_requests_7d", "stream_gb_7d"),
        tasks.select("user_id", "downloads_30d", "task_failure_rate"),
        quota.select("user_id", "storage_used_pct", "plan_name"),
    )
    for part in parts:
        base = base.join(part, "user_id", "left")
    stage = F.when(C("churn_risk_30d").isNotNull(), "subscriber").otherwise("lapsed_or_free")
    return (
        base.withColumn("lifecycle_stage", stage)
        .withColumn("next_best_action", next_best_action(cfg))
        .fillna(DEFAULTS)
        .select("user_id", "value_tier", "pred_ltv_12m", "ltv_decile", "country", "is_annual", "recency_days",
                *DEFAULTS, "lifecycle_stage", "next_best_action")
    )


def retention_priority(ltv_scores: DataFrame, churn_scores: DataFrame, cfg: Config) -> DataFrame:
    """Value x risk quadrants over current subscribers who are payers."""
    high_value = C("pred_ltv_12m") >= cfg.high_value
    at_risk = (C("churn_risk_30d") >= cfg.high_risk) | (C("had_cancel_sched") == 1)
    expiring = (C("has_payment_method") == 0) & C("days_to_expires").between(-cfg.expiry_before, cfg.expiry_after)
    priority = case_chain([
        (expiring, "P0_fix_payment"),
        (high_value & at_risk, "P1_urgent_save"),
        (high_value, "P2_high_value_nurture"),
        (at_risk, "P3_at_risk_lowvalue"),
    ], "P4_monitor")
    value = ltv_scores.select("user_id", "value_tier", "pred_ltv_12m")
    risk = churn_scores.select("user_id", "churn_risk_30d", "had_cancel_sched", "has_payment_method", "days_to_expires")
    return (
        value.join(risk, "user_id")
        .withColumn("expected_loss", F.round(C("pred_ltv_12m") * C("churn_risk_30d"), 2))
        .withColumn("priority", priority)
        .orderBy("priority", F.desc("expected_loss"), "user_id")
    )


def priority_summary(priorities: DataFrame) -> DataFrame:
    """Per priority: users, mean value and risk, money at risk; two and four decimals are added exactly."""
    users = F.count(F.lit(1))
    return priorities.groupBy("priority").agg(
        users.alias("users"), (F.sum(C("pred_ltv_12m").cast("decimal(18,2)")).cast("double") / users).alias("avg_value"),
        (F.sum(C("churn_risk_30d").cast("decimal(18,4)")).cast("double") / users).alias("avg_risk"),
        F.sum(C("expected_loss").cast("decimal(18,2)")).cast("double").alias("at_risk"))
