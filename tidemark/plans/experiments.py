"""Randomised holdouts and uplift measurement."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.functions.scalar import count_if, flag, hash_bucket, sum_if
from tidemark.sources.tables import completed

C = F.col


def assign_holdout(profile: DataFrame, campaign: str, assigned: date, cfg: Config) -> DataFrame:
    """Persistent arms: the same user and campaign always land in the same arm."""
    bucket = hash_bucket([C("user_id"), F.lit(campaign)], 100)
    return profile.filter(C("next_best_action") == campaign).select(
        "user_id", F.lit(campaign).alias("campaign"),
        F.when(bucket < cfg.holdout_pct, "holdout").otherwise("treatment").alias("arm"),
        F.lit(assigned).alias("assigned_date"))


def conversions(holdout: DataFrame, revenue: DataFrame, campaign: str, window_days: int) -> DataFrame:
    """Converted flag and revenue per user in (assigned date, assigned date + window].

    The date stands for its midnight, so payments later on the assigned day count.
    Payments are combined per user and day first, midnight ones apart.
    """
    day = F.to_date("transaction_date")
    midnight = C("transaction_date") == day.cast("timestamp_ntz")
    paid = (
        completed(revenue).filter(C("user_id").isNotNull())
        .groupBy("user_id", day.alias("_day"), midnight.alias("_midnight"))
        .agg(F.sum("amount_usd").alias("_usd"))
    )
    end = F.date_add("assigned_date", window_days)
    after = (C("_day") > C("assigned_date")) | ((C("_day") == C("assigned_date")) & ~C("_midnight"))
    before = (C("_day") < end) | ((C("_day") == end) & C("_midnight"))
    inside = F.coalesce(after & before, F.lit(False))
    return (
        holdout.filter(C("campaign") == campaign).join(paid, "user_id", "left")
        .groupBy("arm", "user_id")
        .agg(F.max(flag(inside)).alias("converted"), sum_if("_usd", inside).cast("double").alias("revenue"))
    )


def measure_uplift(holdout: DataFrame, revenue: DataFrame, campaign: str, window_days: int, cfg: Config) -> DataFrame:
    """One row: both arms, uplift, revenue per user and a pooled two-proportion z-test."""
    per_user = conversions(holdout, revenue, campaign, window_days)
    treated, held = C("arm") == "treatment", C("arm") == "holdout"
    arms = per_user.agg(
        count_if(treated).alias("nt"), sum_if("converted", treated).alias("ct"),
        F.round(sum_if("revenue", treated), 2).alias("rev_t"),
        count_if(held).alias("nh"), sum_if("converted", held).alias("ch"),
        F.round(sum_if("revenue", held), 2).alias("rev_h"),
    )

    def div(a, b):
        return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))

    nt, nh, ct, ch = C("nt"), C("nh"), C("ct"), C("ch")
    pooled = div(ct + ch, nt + nh)
    gap = div(ct, nt) - div(ch, nh)
    z = div(gap, F.sqrt(pooled * (1 - pooled) * (div(F.lit(1), nt) + div(F.lit(1), nh))))
    return arms.select(
        F.lit(campaign).alias("campaign"),
        nt.alias("treat_users"), ct.alias("treat_conv"), F.round(div(ct, nt), 5).alias("conv_treatment"),
        C("rev_t").alias("treat_revenue_usd"), F.round(div(C("rev_t"), nt), 4).alias("arpu_treatment"),
        nh.alias("hold_users"), ch.alias("hold_conv"), F.round(div(ch, nh), 5).alias("conv_holdout"),
        C("rev_h").alias("hold_revenue_usd"), F.round(div(C("rev_h"), nh), 4).alias("arpu_holdout"),
        F.round(gap, 5).alias("absolute_uplift"),
        F.round(div(gap, div(ch, nh)) * 100, 1).alias("relative_uplift_pct"),
        F.round(z, 2).alias("z_score"),
        F.when(F.abs(z) > cfg.z_critical, "significant_95").otherwise("not_significant").alias("verdict"),
    )
