"""Lifetime-value panels: payers at index dates, label = revenue of the year after."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.functions.scalar import day_to_date, flag, ratio
from tidemark.functions.stats import upper_median
from tidemark.operators import extracts as x
from tidemark.operators.pit import Frame, ahead, back, cross_index, history, pit_windows

C = F.col
NEVER = 1 << 30


def index_dates(start: date, as_of: datetime, horizon: int, step_months: int) -> list[date]:
    """First-of-month dates with a complete label window."""
    last = (as_of - timedelta(days=horizon)).date()
    out, month = [], start.year * 12 + start.month - 1
    while date(month // 12, month % 12 + 1, 1) <= last:
        out.append(date(month // 12, month % 12 + 1, 1))
        month += step_months
    return out


FEATURES_V2 = (
    "recency_days", "frequency", "monetary_sum", "monetary_avg", "monetary_std",
    "first_amount", "last_amount", "min_amount", "max_amount",
    "tenure_days", "months_since_first", "avg_monthly_rev", "gap_median", "gap_min", "gap_max",
    "txns_90", "txns_180", "txns_365", "rev_90", "rev_180", "rev_365", "rev_prev_365", "rev_trend",
    "is_annual", "n_plans", "last_plan_id", "provider", "country", "refund_count", "refund_amount",
)
FEATURES_V1 = (
    "recency_days", "frequency", "monetary_sum", "monetary_avg", "last_amount", "tenure_days",
    "gap_median", "txns_365_prior", "rev_365_prior", "is_annual",
)


def _money(col: Column) -> Column:
    return F.round(F.coalesce(col, F.lit(0)).cast("double"), 2)


def _cents(col: Column) -> Column:
    """Whole cents, half up, back to currency: halves are exact at this scale."""
    return F.round(col, 0) / 100


def _frames(cfg: Config, with_label: bool) -> dict[str, Frame]:
    pay_day = F.when(C("txns").isNotNull(), C("day"))
    frames = {
        "frequency": history(F.sum("txns")), "_sum": history(F.sum("amount")),
        "_cents_sq": history(F.sum("cents_sq")),
        "_first": history(F.first("first_amount", True)), "_last": history(F.last("last_amount", True)),
        "_min": history(F.min("min_amount")), "_max": history(F.max("max_amount")),
        "_first_day": history(F.min(pay_day)), "_last_day": history(F.max(pay_day)),
        "_gaps": history(F.collect_list("gap")), "_same_day": history(F.sum("same_day")),
        "_plans": history(F.collect_list("plans")), "_txn": history(F.last("last_txn", True)),
        "refund_count": history(F.sum("refund_count")), "_refunds": history(F.sum("refund_amount")),
        "_prev": Frame(F.sum("amount"), -730, -366),
    }
    for n in (90, 180, 365):
        frames[f"txns_{n}"] = back(F.sum("txns"), n)
        frames[f"_rev_{n}"] = back(F.sum("amount"), n)
    if with_label:
        frames["_label"] = ahead(F.sum("amount"), cfg.ltv_horizon)
    return frames


def payer_index(history_days: DataFrame, dates: Sequence[date], active_window: int | None) -> DataFrame:
    """Index rows from the payment days themselves: a date belongs to the last payment
    day before it, so every (user, date) comes up once and dates past the active
    window never come up at all."""
    until = F.coalesce("next_day", F.lit(NEVER))
    if active_window is not None:
        until = F.least(until, C("day") + active_window)
    spans = history_days.select("user_id", C("day").alias("_after"), until.alias("_until"))
    return cross_index(spans, dates, "_after", "_until").select("user_id", "day")


def build_ltv_panel(
    revenue: DataFrame, dates: Sequence[date], cfg: Config, version: int = 2, with_label: bool = True
) -> DataFrame:
    """Version 2: 30 features, payers seen in the last two years, label not below 0.
    Version 1: 10 features, any earlier payment, label as it is."""
    days = x.txn_history(revenue)
    index = payer_index(days, dates, cfg.ltv_active_window if version == 2 else None)
    wide = pit_windows(days.drop("next_day"), index, _frames(cfg, with_label))
    wide = wide.fillna(0, subset=["txns_90", "txns_180", "txns_365", "refund_count"])
    n = C("frequency")
    cents = (C("_sum") * 100).cast("decimal(18,0)")
    spread = (n.cast("decimal(12,0)") * C("_cents_sq") - cents * cents).cast("double")
    zeros = F.coalesce("_same_day", F.lit(0))
    smallest = F.when(zeros > 0, 0).otherwise(F.array_min("_gaps"))
    gap_median = F.coalesce(upper_median(F.array_sort("_gaps"), zeros), F.lit(-1))
    tenure = C("day") - C("_first_day")
    months = tenure / F.lit(30.4)
    rows = wide.withColumns({
        "index_date": day_to_date("day"),
        "recency_days": C("day") - C("_last_day"),
        "monetary_sum": _money(C("_sum")),
        "monetary_avg": _cents(cents.cast("double") / n),
        "monetary_std": _cents(F.sqrt(F.greatest(spread, F.lit(0.0))) / n),
        "first_amount": _money(C("_first")), "last_amount": _money(C("_last")),
        "min_amount": _money(C("_min")), "max_amount": _money(C("_max")),
        "tenure_days": tenure,
        "months_since_first": F.round(months, 1),
        "avg_monthly_rev": _cents(cents.cast("double") / F.greatest(months, F.lit(1.0))),
        "gap_median": gap_median.cast("int"),
        "gap_min": F.coalesce(smallest, F.lit(-1)).cast("int"),
        "gap_max": F.coalesce(F.array_max("_gaps"), F.when(zeros > 0, 0), F.lit(-1)).cast("int"),
        "rev_90": _money(C("_rev_90")), "rev_180": _money(C("_rev_180")), "rev_365": _money(C("_rev_365")),
        "rev_prev_365": _money(C("_prev")),
        "rev_trend": F.when(C("_prev") > 0, ratio(F.coalesce("_rev_365", F.lit(0)), C("_prev"), 3)).otherwise(-1.0),
        "is_annual": flag((gap_median > cfg.annual_gap) | (C("_last") >= cfg.annual_amount)),
        "n_plans": F.size(F.array_distinct(F.flatten("_plans"))),
        "last_plan_id": C("_txn.billing_plan_id").cast("string"),
        "provider": C("_txn.provider"), "country": C("_txn.country"),
        "refund_amount": _money(C("_refunds")),
        "txns_365_prior": C("txns_365"), "rev_365_prior": _money(C("_rev_365")),
    })
    features = FEATURES_V2 if version == 2 else FEATURES_V1
    if not with_label:
        return rows.select("user_id", "index_date", *features)
    label = F.coalesce(C("_label").cast("double"), F.lit(0.0))
    label = F.greatest(label, F.lit(0.0)) if version == 2 else label
    return rows.select("user_id", "index_date", *features, F.round(label, 2).alias("label_rev_365"))


def score_rows(revenue: DataFrame, as_of: datetime, cfg: Config) -> DataFrame:
    """Version 2 features of the active payers at ``as_of``."""
    return build_ltv_panel(revenue, [as_of.date()], cfg, with_label=False)
