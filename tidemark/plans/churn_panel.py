"""Churn panel: active subscribers at weekly snapshots, label = cancelled or expired soon after."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import ACTIVE_SUB_EVENTS, Config
from tidemark.functions.scalar import day_to_date, flag, in_days, ratio, strip_prefix, to_epoch_day
from tidemark.functions.stats import upper_median
from tidemark.operators import extracts as x
from tidemark.operators.pit import ahead, back, cross_index, history, pit_windows, stack_facts
from tidemark.plans.conversion_panel import LOOKBACK, with_profile
from tidemark.session import materialize
from tidemark.sources.tables import Tables

C = F.col
ACTIVE_TYPES = tuple(e.removeprefix("subscription.") for e in ACTIVE_SUB_EVENTS)


def snapshot_dates(cfg: Config, as_of: datetime) -> list[date]:
    """Weekly dates whose label window is complete at ``as_of``."""
    last = (as_of - timedelta(days=cfg.churn_horizon + 1)).date()
    out, d = [], cfg.churn_start
    while d <= last:
        out.append(d)
        d += timedelta(days=cfg.churn_step)
    return out


def _rounded(col: Column, digits: int) -> Column:
    return F.round(col.cast("double"), digits)


def billing_cycle(df: DataFrame, cfg: Config) -> DataFrame:
    """Median payment gap, place in the current cycle and days to the next renewal."""
    median = upper_median(F.array_sort("_gaps"), F.coalesce("_same_day", F.lit(0)))
    known = (C("prior_txn_gap_median") > 0) & (C("days_since_last_txn") >= 0)
    return df.withColumn("prior_txn_gap_median", F.coalesce(median, F.lit(-1)).cast("int")).withColumns({
        "cycle_position": F.when(
            known, ratio(C("days_since_last_txn"), C("prior_txn_gap_median"), 3)).otherwise(-1.0),
        "days_to_renewal": F.when(
            known, C("prior_txn_gap_median") - C("days_since_last_txn")).otherwise(-999),
        "is_annual": flag((C("prior_txn_gap_median") > cfg.annual_gap)
                          | (C("last_txn_amount") >= cfg.annual_amount)),
    })


def _since(day: str, missing: int = -1) -> Column:
    return F.coalesce(C("day") - C(day), F.lit(missing)).cast("int")


CHURN_COLUMNS = (
    "user_id", "snapshot_date", "em_sent_30", "em_sent_90", "em_opened_90", "em_clicked_90",
    "em_open_rate_90", "days_since_last_send", "days_since_last_open", "web_active_days_30",
    "pageviews_30", "file_dl_30", "file_dl_90", "archive_dl_30", "streams_90", "pricing_views_30",
    "days_since_web_activity", "ltv_before_usd", "txns_before", "days_since_last_txn",
    "last_txn_amount", "txns_365d", "prior_txn_gap_median", "cycle_position", "days_to_renewal",
    "last_plan_id", "is_annual", "sub_tenure_days", "days_since_sub_event", "last_sub_event",
    "prior_cancels", "prior_reactivations", "had_cancel_sched_30", "country", "tenure_days",
    "devices", "mobile_share", "snapshot_age",
)


def subscriber_index(sub_days: DataFrame, snapshots: Sequence[date]) -> DataFrame:
    """Snapshots with an earlier subscription event: each belongs to the last event day
    before it, so every (user, snapshot) comes up once."""
    following = F.lead("day").over(Window.partitionBy("user_id").orderBy("day"))
    spans = sub_days.select("user_id", C("day").alias("_after"), following.alias("_next"))
    spans = spans.withColumn("_until", F.coalesce("_next", F.lit(1 << 30)))
    return cross_index(spans, snapshots, "_after", "_until").select("user_id", "day")


def build_churn_panel(
    t: Tables, snapshots: Sequence[date], as_of: datetime, cfg: Config, with_label: bool = True
) -> DataFrame:
    """One row per (user, snapshot) with an active subscription just before the snapshot.

    Everything but the label is computed from days strictly before the snapshot.
    """
    subs = x.sub_days(t.events)
    index = subscriber_index(subs.select("user_id", "day"), snapshots)
    # only users who can be in the panel are read any further: ids once, raw rows cut to them before they are combined
    members = materialize(index.select("user_id").distinct(), "panel-members")

    def of_members(raw: DataFrame) -> DataFrame:
        return raw.join(members, "user_id", "left_semi")

    first, last = to_epoch_day(min(snapshots)), to_epoch_day(max(snapshots))
    reach = of_members(t.events.filter(in_days("created_at", first - LOOKBACK, last - 1)))
    days = x.user_day_activity(reach).drop(
        "has_email", "completed", "failed", "storage_warnings", "file_views", "goal4", "promo_sub", "sessions")
    money = x.txn_history(of_members(t.revenue)).select(
        "user_id", "day", "amount", "txns", "last_amount", "last_txn", "gap", "same_day")
    facts = stack_facts([days, of_members(subs), money])
    sent = C("mautic_sent") + C("internal_sent")
    counters = {
        "em_sent_30": back(F.sum(sent), 30), "em_sent_90": back(F.sum(sent), 90),
        "em_opened_90": back(F.sum("opened"), 90), "em_clicked_90": back(F.sum("clicked"), 90),
        "web_active_days_30": back(F.count("pageviews"), 30),
        "pageviews_30": back(F.sum("pageviews"), 30),
        "file_dl_30": back(F.sum("file_dl"), 30), "file_dl_90": back(F.sum("file_dl"), 90),
        "archive_dl_30": back(F.sum("archive_dl"), 30), "streams_90": back(F.sum("streams"), 90),
        "pricing_views_30": back(F.sum("pricing_views"), 30),
        "txns_before": history(F.sum("txns")), "txns_365d": back(F.sum("txns"), 365),
        "prior_cancels": history(F.sum("churned")),
        "prior_reactivations": history(F.sum("reactivated")),
        "had_cancel_sched_30": back(F.max(flag(C("cancel_sched") > 0)), 30),
    }
    state = {
        "_last_send": back(F.max(F.when(sent > 0, C("day"))), 90),
        "_last_open": back(F.max(F.when(C("opened") > 0, C("day"))), 90),
        "_last_web": back(F.max(F.when(C("pageviews").isNotNull(), C("day"))), 90),
        "_ltv": history(F.sum("amount")),
        "_last_txn_day": history(F.max(F.when(C("txns").isNotNull(), C("day")))),
        "_first_txn_day": history(F.min(F.when(C("txns").isNotNull(), C("day")))),
        "_last_amount": history(F.last("last_amount", True)),
        "_last_txn": history(F.last("last_txn", True)),
        "_gaps": history(F.collect_list("gap")),  # one entry per payment day at most
        "_same_day": history(F.sum("same_day")),
        "_sub": history(F.last(F.when(C("last_type").isNotNull(), F.struct("last_type", "day")), True)),
        "_started_day": history(F.min(F.when(C("started") > 0, C("day")))),
    }
    label = {"_churn": ahead(F.max(flag(C("churned") > 0)), cfg.churn_horizon)} if with_label else {}
    wide = pit_windows(facts, index, {**counters, **state, **label})
    active = (
        wide.filter(C("_sub.last_type").isin(*ACTIVE_TYPES) & C("_started_day").isNotNull())
        .fillna(0, subset=list(counters))
        .withColumns({
            "em_open_rate_90": ratio(C("em_opened_90"), C("em_sent_90"), 4),
            "days_since_last_send": _since("_last_send"),
            "days_since_last_open": _since("_last_open"),
            "days_since_web_activity": _since("_last_web"),
            "ltv_before_usd": _rounded(F.coalesce("_ltv", F.lit(0)), 2),
            "days_since_last_txn": _since("_last_txn_day"),
            "last_txn_amount": _rounded(F.coalesce("_last_amount", F.lit(0)), 2),
            "last_plan_id": F.coalesce(C("_last_txn.billing_plan_id").cast("string"), F.lit("0")),
            "sub_tenure_days": _since("_started_day"),
            "days_since_sub_event": _since("_sub.day"),
            "last_sub_event": C("_sub.last_type"),
            "snapshot_age": (C("day") - to_epoch_day(cfg.subs_since)).cast("int"),
            "snapshot_date": day_to_date("day"),
        })
    )
    full = (
        with_profile(billing_cycle(active, cfg), x.account_profile(of_members(t.events), as_of, cfg.mobile_window))
        .drop("mobile_share").withColumnRenamed("mobile_share_now", "mobile_share")
    )
    if not with_label:
        return full.select(*CHURN_COLUMNS)
    return full.select(*CHURN_COLUMNS, F.coalesce("_churn", F.lit(0)).alias("label_churn_30"))


def active_at(t: Tables, when: date) -> DataFrame:
    """Users with an active subscription just before ``when``."""
    before = x.sub_events(t.events).filter(C("ts") < F.lit(when.isoformat()).cast("timestamp_ntz"))
    status = before.groupBy("user_id").agg(
        F.max_by("type", F.struct("ts", "event_id")).alias("last_type"),
        F.max(flag(C("type").isin("subscription.created", "subscription.reactivated"))).alias("_ever"),
    )
    return status.filter(C("last_type").isin(*ACTIVE_SUB_EVENTS) & (C("_ever") == 1)).select(
        "user_id", strip_prefix("last_type", "subscription.").alias("last_sub_event"))
