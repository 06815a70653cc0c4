"""Marketing segments: one row per user.

Facts are reduced to one row per user (or per visitor) before any join, so a very
active user costs partial aggregation, not a hot join key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import (
    CHURN_SUB_EVENTS, EMERGING_COUNTRIES, MOBILE_UA, PRODUCT_SURFACES, WEB_SURFACES, Config,
)
from tidemark.functions.ranking import quantile_bin
from tidemark.functions.scalar import (
    any_if, contains_ci, count_if, flag, gigabytes, ratio, since, since_midnight, sum_if,
)
from tidemark.sources.tables import Tables, completed, premium_ids

C = F.col


def _identified(events: DataFrame) -> DataFrame:
    return events.filter(C("user_id").isNotNull())


def _free(df: DataFrame, t: Tables) -> DataFrame:
    return df.join(premium_ids(t.subscription_state), "user_id", "left_anti")


def _active(t: Tables, as_of: datetime, days: int) -> DataFrame:
    """Identified product activity in the window, one row per user."""
    return (
        _identified(t.events)
        .filter(since("created_at", as_of, days) & C("surface").isin(*PRODUCT_SURFACES))
        .groupBy("user_id")
        .agg(F.max("created_at").alias("last_seen_at"), F.count(F.lit(1)).alias("events_30d"))
    )


def _payers(t: Tables) -> DataFrame:
    return (
        completed(t.revenue).groupBy("user_id")
        .agg(F.sum("amount_usd").alias("ltv"), F.count(F.lit(1)).alias("lifetime_txns"),
             F.max("transaction_date").alias("last_txn_at"))
    )


def _usd(col: str) -> Column:
    return F.round(C(col), 2).cast("double")


# --- the eight campaign segments ------------------------------------------------
def storage_warning(t: Tables, as_of: datetime, cfg: Config) -> DataFrame:
    hits = (
        _identified(t.events)
        .filter(since("created_at", as_of, cfg.events_window)
                & (C("event_type") == "account.storage_warning"))
        .groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("warnings_30d"), F.max("created_at").alias("last_warning_at"))
    )
    premium = premium_ids(t.subscription_state).withColumn("_premium", F.lit(True))
    return (
        hits.join(premium, "user_id", "left")
        .select("user_id", "warnings_30d", "last_warning_at", flag(C("_premium")).alias("is_premium"))
        .orderBy(F.desc("warnings_30d"), F.desc("last_warning_at"), "user_id")
    )


def bandwidth_free(t: Tables, as_of: datetime, cfg: Config) -> DataFrame:
    usage = (
        t.bw_user_day
        .filter((C("day") >= F.date_sub(F.lit(as_of.date()), cfg.traffic_window)) & (C("user_id") != 0))
        .groupBy("user_id")
        .agg(F.round(gigabytes(F.sum("bytes")), 2).alias("gb_7d"), F.sum("reqs").alias("requests_7d"))
        .filter(C("gb_7d") >= cfg.heavy_gb)  # the rounded value is tested
    )
    return _free(usage, t).orderBy(F.desc("gb_7d"), "user_id")


def winback_active(t: Tables, as_of: datetime, cfg: Config) -> DataFrame:
    joined = _payers(t).join(_active(t, as_of, cfg.events_window), "user_id")
    return (
        _free(joined, t)
        .select("user_id", _usd("ltv").alias("ltv_usd"), "lifetime_txns", "last_txn_at",
                "last_seen_at", "events_30d")
        .orderBy(F.desc("ltv_usd"), "user_id")
    )


def soft_cancel(t: Tables, as_of: datetime, cfg: Config) -> DataFrame:
    latest = (
        _identified(t.events)
        .filter(since("created_at", as_of, cfg.sub_event_window)
                & C("event_type").startswith("subscription."))
        .groupBy("user_id")
        .agg(F.max_by("event_type", F.struct("created_at", "event_id")).alias("last_type"),
             F.max("created_at").alias("scheduled_at"))
    )
    return (
        latest.filter(C("last_type") == "subscription.cancellation_scheduled")
        .select("user_id", "scheduled_at").orderBy(F.desc("scheduled_at"), "user_id")
    )


def streamers_free(t: Tables, as_of: datetime, cfg: Config) -> DataFrame:
    media = (
        t.requests
        .filter(since_midnight("ts", as_of, cfg.traffic_window) & (C("base_path") == "/media")
                & (C("user_id") != 0))
        .groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("media_requests_7d"),
             F.round(gigabytes(F.sum("bytes_sent")), 2).alias("gb_streamed_7d"),
             F.max_by("country", F.struct("ts", "event_id")).alias("country"))
        .filter(C("media_requests_7d") >= cfg.media_requests)
    )
    return _free(media, t).orderBy(F.desc("gb_streamed_7d"), "user_id")


def visitor_funnel(t: Tables, as_of: datetime, cfg: Config) -> DataFrame:
    """Goal funnel per visitor: goals 1-3 carry no account id."""
    goal = C("matomo_idgoal")
    return (
        t.events
        .filter(since("created_at", as_of, cfg.events_window) & goal.isNotNull())
        .groupBy("vid")
        .agg(F.max(goal).alias("furthest_goal"), any_if(goal.isin(1, 2, 3)).alias("touched"),
             any_if(goal == 4).alias("paid"), F.max("created_at").alias("last_touch_at"))
    )


def _abandoned(t: Tables, as_of: datetime, cfg: Config) -> DataFrame:
    return (
        visitor_funnel(t, as_of, cfg).filter((C("touched") == 1) & (C("paid") == 0))
        .join(t.vid_user_map, "vid").groupBy("user_id")
        .agg(F.max("furthest_goal").alias("furthest_goal"), F.max("last_touch_at").alias("last_touch_at"),
             F.count(F.lit(1)).alias("funnel_vids"))
    )


def cart_abandoners(t: Tables, as_of: datetime, cfg: Config) -> DataFrame:
    return _free(_abandoned(t, as_of, cfg), t).orderBy(F.desc("last_touch_at"), "user_id")


def dormant_payers(t: Tables, as_of: datetime, cfg: Config) -> DataFrame:
    recent = _payers(t).filter(since("last_txn_at", as_of, cfg.payer_window))
    quiet = recent.join(_active(t, as_of, cfg.events_window).select("user_id"), "user_id", "left_anti")
    return (
        _free(quiet, t)
        .select("user_id", _usd("ltv").alias("ltv_usd"), "last_txn_at", "lifetime_txns")
        .orderBy(F.desc("ltv_usd"), "user_id")
    )


def monthly_to_annual(t: Tables, as_of: datetime, cfg: Config) -> DataFrame:
    in_year = since("transaction_date", as_of, cfg.loyalty_window)
    money = (
        completed(t.revenue).groupBy("user_id")
        .agg(F.max_by("amount_usd", F.struct("transaction_date", "txn_id")).alias("last_amount"),
             count_if(in_year).alias("txns_12mo"), sum_if("amount_usd", in_year).alias("paid_12mo"))
        .filter((C("last_amount") < cfg.monthly_max_amount) & (C("txns_12mo") >= cfg.monthly_min_txns))
    )
    return (
        t.subscription_state.join(money, "user_id")
        .select("user_id", "current_plan_id", C("last_amount").cast("double").alias("last_amount_usd"),
                "txns_12mo", _usd("paid_12mo").alias("paid_12mo_usd"))
        .orderBy(F.desc("paid_12mo_usd"), "user_id")
    )


# --- further segment definitions --------------------------------------------------
def lapsed_high_ltv(t: Tables, as_of: datetime, cfg: Config) -> DataFrame:
    rich = _payers(t).filter(C("ltv") >= cfg.lapsed_ltv)
    return _free(rich, t).select("user_id", _usd("ltv").alias("ltv_usd"), "lifetime_txns")


def recently_lapsed(t: Tables, as_of: datetime, cfg: Config) -> DataFrame:
    recent = _payers(t).filter(since("last_txn_at", as_of, cfg.payer_window))
    return _free(recent, t).select("user_id", "last_txn_at")


def hard_churned(t: Tables, as_of: datetime, cfg: Config) -> DataFrame:
    return (
        _identified(t.events)
        .filter(since("created_at", as_of, cfg.events_window) & C("event_type").isin(*CHURN_SUB_EVENTS))
        .groupBy("user_id")
        .agg(F.max("created_at").alias("churned_at"), F.count(F.lit(1)).alias("churn_events"))
    )


def usage_counts(t: Tables, as_of: datetime, days: int) -> DataFrame:
    """Downloads, streams and pricing visits per identified web user."""
    event = C("event_type") == "event"
    return (
        _identified(t.events)
        .filter(since("created_at", as_of, days) & C("surface").isin(*WEB_SURFACES))
        .groupBy("user_id")
        .agg(
            count_if(event & (C("category") == "File") & (C("action") == "Download")).alias("file_downloads"),
            count_if(event & (C("category") == "Archive") & (C("action") == "Download")).alias("archive_downloads"),
            count_if(event & (C("category") == "video")
                     & C("action").isin("stream_start", "stream_session")).alias("streams"),
            count_if((C("event_type") == "pageview")
                     & (contains_ci("url", "pricing") | contains_ci("url", "payment"))).alias("pricing_views"),
        )
    )


def archive_only(t: Tables, as_of: datetime, cfg: Config) -> DataFrame:
    used = usage_counts(t, as_of, cfg.events_window)
    return used.filter((C("archive_downloads") > 0) & (C("file_downloads") == 0)).select(
        "user_id", "archive_downloads")


def heavy_downloaders(t: Tables, as_of: datetime, cfg: Config) -> DataFrame:
    used = usage_counts(t, as_of, cfg.events_window)
    return used.filter(C("file_downloads") > cfg.heavy_downloads).select("user_id", "file_downloads")


def dormant(t: Tables, as_of: datetime, cfg: Config) -> DataFrame:
    """Active in the window before the last one, silent in the last one."""
    w = cfg.events_window
    return (
        _active(t, as_of, 2 * w)
        .filter(~since("last_seen_at", as_of, w)).select("user_id", "last_seen_at")
    )


def new_or_resurrected(t: Tables, as_of: datetime, cfg: Config) -> DataFrame:
    """Active in the last window with no activity in the one before."""
    w = cfg.events_window
    recent = since("created_at", as_of, w)
    return (
        _identified(t.events)
        .filter(since("created_at", as_of, 2 * w) & C("surface").isin(*PRODUCT_SURFACES))
        .groupBy("user_id")
        .agg(count_if(recent).alias("events_now"), count_if(~recent).alias("_before"))
        .filter((C("events_now") > 0) & (C("_before") == 0)).drop("_before")
    )


def email_engaged(t: Tables, as_of: datetime, cfg: Config) -> DataFrame:
    return (
        _identified(t.events)
        .filter(since("created_at", as_of, cfg.events_window) & (C("event_type") == "email.opened"))
        .groupBy("user_id").agg(F.count(F.lit(1)).alias("opens"), F.max("created_at").alias("last_open_at"))
    )


def power_users(t: Tables, as_of: datetime, cfg: Config) -> DataFrame:
    used = usage_counts(t, as_of, cfg.events_window)
    actions = C("file_downloads") + C("archive_downloads") + C("streams")
    hit = used.withColumn("actions", actions).filter(
        (C("actions") > cfg.power_actions) & (C("pricing_views") == 0))
    return _free(hit, t).select("user_id", "actions")


def heavy_streamers(t: Tables, as_of: datetime, cfg: Config) -> DataFrame:
    used = usage_counts(t, as_of, cfg.events_window).withColumn(
        "downloads", C("file_downloads") + C("archive_downloads"))
    hit = used.filter((C("streams") > cfg.streamer_streams) & (C("downloads") < cfg.streamer_max_downloads))
    return _free(hit, t).select("user_id", "streams", "downloads")


def heavy_downloaders_free(t: Tables, as_of: datetime, cfg: Config) -> DataFrame:
    return _free(heavy_downloaders(t, as_of, cfg), t)


def archive_only_free(t: Tables, as_of: datetime, cfg: Config) -> DataFrame:
    return _free(archive_only(t, as_of, cfg), t)


def funnel_abandonment(t: Tables, as_of: datetime, cfg: Config) -> DataFrame:
    """Accounts whose visitors reached stages 1-3 and never paid, premium included."""
    return _abandoned(t, as_of, cfg)


def _modal_country(t: Tables, as_of: datetime, days: int) -> DataFrame:
    return (
        _identified(t.events).filter(since("created_at", as_of, days))
        .groupBy("user_id").agg(F.mode("country", True).alias("country"))
    )


def geo_emerging(t: Tables, as_of: datetime, cfg: Config) -> DataFrame:
    geo = _modal_country(t, as_of, cfg.events_window)
    return _free(geo.filter(C("country").isin(*EMERGING_COUNTRIES)), t)


def premium_upsell(t: Tables, as_of: datetime, cfg: Config) -> DataFrame:
    return t.subscription_state.select("user_id", "current_plan_id")


def mobile_first(t: Tables, as_of: datetime, cfg: Config) -> DataFrame:
    share = (
        _identified(t.events)
        .filter(since("created_at", as_of, cfg.events_window) & C("surface").isin(*WEB_SURFACES)
                & (C("ua") != ""))
        .groupBy("user_id")
        .agg(ratio(count_if(C("ua").rlike(MOBILE_UA)), F.count(F.lit(1)), 3).alias("mobile_share"))
    )
    return _free(share.filter(C("mobile_share") > 0.5), t)


def top_decile_usage(t: Tables, as_of: datetime, cfg: Config) -> DataFrame:
    """Free users in the top bandwidth decile, with their completed tasks."""
    usage = (
        t.bw_user_day
        .filter((C("day") >= F.date_sub(F.lit(as_of.date()), cfg.traffic_window)) & (C("user_id") != 0))
        .groupBy("user_id").agg(F.sum("bytes").alias("bytes_7d"))
    )
    tasks = (
        _identified(t.events)
        .filter(since("created_at", as_of, cfg.events_window) & (C("event_type") == "task.completed"))
        .groupBy("user_id").agg(F.count(F.lit(1)).alias("tasks_completed"))
    )
    ranked = quantile_bin(_free(usage, t), "bytes_7d", "user_id", 10, "decile")
    return (
        ranked.filter("decile = 10").join(tasks, "user_id", "left")
        .select("user_id", "bytes_7d", F.coalesce("tasks_completed", F.lit(0)).alias("tasks_completed"))
    )


# --- catalogue --------------------------------------------------------------------
@dataclass(frozen=True)
class Segment:
    name: str
    title: str
    build: Callable[[Tables, datetime, Config], DataFrame]


SEGMENTS: dict[str, Segment] = {
    s.name: s
    for s in (
        Segment("storage-warning", "Accounts at their storage quota", storage_warning),
        Segment("bandwidth-free", "Free accounts with heavy bandwidth", bandwidth_free),
        Segment("winback-active", "Former payers who still use the product", winback_active),
        Segment("soft-cancel", "Cancellation scheduled but still paying", soft_cancel),
        Segment("streamers-free", "Free accounts that stream a lot", streamers_free),
        Segment("cart-abandoners", "Entered the purchase funnel, did not pay", cart_abandoners),
        Segment("dormant-payers", "Recent payers who went silent", dormant_payers),
        Segment("monthly-to-annual", "Loyal monthly payers", monthly_to_annual),
        Segment("lapsed-high-ltv", "Lapsed payers of high value", lapsed_high_ltv),
        Segment("recently-lapsed", "Paid lately, no subscription", recently_lapsed),
        Segment("hard-churned", "Cancelled or expired lately", hard_churned),
        Segment("archive-only", "Downloads archives only", archive_only),
        Segment("heavy-downloaders", "Many file downloads", heavy_downloaders),
        Segment("dormant", "Active before, silent now", dormant),
        Segment("new-or-resurrected", "Active now, not before", new_or_resurrected),
        Segment("email-engaged", "Opened e-mail lately", email_engaged),
        Segment("power-users", "Heavy free use, never on pricing", power_users),
        Segment("heavy-streamers", "Free streamers with few downloads", heavy_streamers),
        Segment("heavy-downloaders-free", "Free heavy downloaders", heavy_downloaders_free),
        Segment("archive-only-free", "Free archive-only accounts", archive_only_free),
        Segment("funnel-abandonment", "Funnel stages 1-3, never 4", funnel_abandonment),
        Segment("geo-emerging", "Free accounts in emerging markets", geo_emerging),
        Segment("premium-upsell", "Current subscribers", premium_upsell),
        Segment("mobile-first", "Free accounts mostly on mobile", mobile_first),
        Segment("top-decile-usage", "Top decile of free bandwidth", top_decile_usage),
    )
}


def select_segments(names: Sequence[str] | None = None) -> list[Segment]:
    """Chosen segments in catalogue order of request; an unknown name is an error."""
    if not names:
        return list(SEGMENTS.values())
    unknown = [n for n in names if n not in SEGMENTS]
    if unknown:
        raise KeyError(f"unknown segments: {', '.join(unknown)}; known: {', '.join(SEGMENTS)}")
    return [SEGMENTS[n] for n in names]


def segment_share(segments: Sequence[DataFrame], names: Sequence[str]) -> DataFrame:
    """Size of each segment (one row per segment)."""
    sized = [
        df.select(F.lit(n).alias("segment"), "user_id") for df, n in zip(segments, names, strict=True)
    ]
    out = sized[0]
    for s in sized[1:]:
        out = out.unionByName(s)
    return out.groupBy("segment").agg(F.count(F.lit(1)).alias("users"))
