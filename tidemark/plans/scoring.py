"""Score tables: churn risk with the billing rule, and lifetime value with tiers."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.functions.ranking import quantile_bin
from tidemark.functions.scalar import case_chain, to_epoch_day, value_tier

C = F.col


def latest_expiry(expiry: DataFrame) -> DataFrame:
    """Expiry day and payment-method flag of the latest subscription event per user."""
    newest = F.max_by(F.struct("expires_day", "has_pm"), F.struct("created_at", "event_id"))
    return (
        expiry.filter(C("expires_day").isNotNull()).groupBy("user_id").agg(newest.alias("_e"))
        .select("user_id", "_e.expires_day", "_e.has_pm")
    )


def billing_override(scores: DataFrame, expiry: DataFrame, as_of: datetime, cfg: Config) -> DataFrame:
    """Raise the model risk where the billing date already tells the outcome.

    ``scores`` brings user_id, model_risk and had_cancel_sched.
    """
    joined = scores.join(latest_expiry(expiry), "user_id", "left").withColumns({
        "days_to_expires": F.coalesce(C("expires_day") - to_epoch_day(as_of), F.lit(-999)),
        "has_payment_method": F.coalesce("has_pm", F.lit(-1)),
    })
    left = C("days_to_expires")
    rule = case_chain([
        (left.between(-cfg.expiry_before, cfg.expiry_after) & (C("has_payment_method") == 0), cfg.risk_no_method),
        (left.between(0, cfg.cancelled_days) & (C("had_cancel_sched") == 1), cfg.risk_cancelled),
        (left.between(0, cfg.expiring_days), cfg.risk_expiring),
    ], 0.0)
    return joined.withColumns({
        "churn_risk_30d": F.round(F.greatest("model_risk", rule), 4),
        "risk_source": F.when(rule > C("model_risk"), "billing_rule").otherwise("model"),
        "model_risk": F.round("model_risk", 4),
    }).drop("expires_day", "has_pm")


CHURN_SCORE_COLUMNS = (
    "user_id", "churn_risk_30d", "model_risk", "days_to_expires", "has_payment_method", "risk_source",
    "had_cancel_sched", "days_since_last_txn", "cycle_position", "sub_tenure_days", "last_sub_event",
    "prior_reactivations", "ltv_before_usd", "is_annual", "country",
)


def churn_scores(features: DataFrame, expiry: DataFrame, as_of: datetime, cfg: Config) -> DataFrame:
    """``features``: churn rows at ``as_of`` with a ``model_risk`` column."""
    rows = features.withColumnRenamed("had_cancel_sched_30", "had_cancel_sched").withColumn(
        "country", F.when(C("country") == "", "unknown").otherwise(C("country")))
    return (
        billing_override(rows, expiry, as_of, cfg).select(*CHURN_SCORE_COLUMNS)
        .orderBy(F.desc("churn_risk_30d"), "user_id")
    )


def risk_summary(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """High-risk counts by the model alone and after the billing rule."""
    return scores.agg(
        F.count(F.lit(1)).alias("scored"), F.avg("model_risk").alias("mean_model_risk"),
        F.sum("had_cancel_sched").alias("cancel_scheduled"),
        F.count_if(C("model_risk") > threshold).alias("high_model_risk"),
        F.count_if(C("churn_risk_30d") > threshold).alias("high_final_risk"))


def ltv_scores(rows: DataFrame, cfg: Config) -> DataFrame:
    """``rows``: value features at ``as_of`` with ``pred_ltv_12m`` and ``pred_ltv_gbm``."""
    table = rows.select(
        "user_id", F.round("pred_ltv_12m", 2).alias("pred_ltv_12m"),
        F.round("pred_ltv_gbm", 2).alias("pred_ltv_gbm"), "recency_days", "frequency",
        C("monetary_sum").alias("ltv_to_date"), C("rev_365").alias("rev_365_prior"), "last_amount",
        "is_annual", "country", "provider", "last_plan_id",
        value_tier("monetary_sum", cfg.tiers).alias("value_tier"),
    )
    return quantile_bin(table, "pred_ltv_12m", "user_id", 10, "ltv_decile")


def _cents(amount: Column) -> Column:
    """Exact money: sums of it do not depend on the order rows are added in."""
    return amount.cast("decimal(18,2)")


def tier_summary(scores: DataFrame) -> DataFrame:
    """Users, mean and total value by tier: cents are added exactly and divided last."""
    total = F.sum(_cents(C("pred_ltv_12m"))).cast("double")
    return scores.groupBy("value_tier").agg(
        F.count(F.lit(1)).alias("users"), (total / F.count("pred_ltv_12m")).alias("avg_pred_ltv"), total.alias("sum_pred"))


def top_decile_share(scores: DataFrame) -> DataFrame:
    value = _cents(C("pred_ltv_12m"))
    total, top = F.sum(value).cast("double"), F.sum(F.when(C("ltv_decile") == 10, value)).cast("double")
    return scores.agg(
        total.alias("total_pred"), F.count_if(C("ltv_decile") == 10).alias("top_users"),
        (top / F.nullif(total, F.lit(0.0))).alias("top_share"))
