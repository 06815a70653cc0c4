"""Documented query recipes over events, revenue and rollups."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import count_if, json_field, ratio, since_midnight, ts_lit
from tidemark.operators.joins import keep_members
from tidemark.sources.tables import completed

C = F.col


def user_journey(events: DataFrame, users: DataFrame) -> DataFrame:
    """Ordered web events of the given users (normally one)."""
    web = events.filter(C("surface").isin("web", "landing"))
    return (
        keep_members(web, users, "user_id")
        .select("user_id", "created_at", "event_id", "event_type", "surface", "category", "action",
                "matomo_idgoal", "url", "country")
        .orderBy("user_id", "created_at", "event_id")
    )


def journey_aggregates(events: DataFrame, users: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    return (
        keep_members(events.filter(since_midnight("created_at", as_of, days)), users, "user_id")
        .groupBy("user_id")
        .agg(F.count_distinct("vid").alias("device_count"),
             F.min("created_at").alias("first_visit_at"), F.max("created_at").alias("last_visit_at"),
             F.count(F.lit(1)).alias("total_actions"),
             count_if(C("event_type") == "pageview").alias("pageviews"),
             count_if(C("matomo_idgoal").isNotNull()).alias("goal_firings"),
             F.max("matomo_idgoal").alias("max_goal_reached"),
             F.mode("country", True).alias("primary_country"))
    )


def daily_volume(events: DataFrame, as_of: datetime, days: int = 30, exact: bool = True) -> DataFrame:
    """Dashboard per day; ``exact=False`` counts users and visitors with a sketch."""
    distinct = F.count_distinct if exact else F.approx_count_distinct
    goal = C("matomo_idgoal").isNotNull()
    return (
        events.filter(since_midnight("created_at", as_of, days))
        .groupBy(F.to_date("created_at").alias("day"))
        .agg(count_if(C("event_type") == "pageview").alias("pageviews"),
             count_if(C("event_type") == "event").alias("events"),
             count_if((C("event_type") == "goal") | ((C("event_type") == "signup") & goal)).alias("goals"),
             distinct("user_id").alias("unique_users"), distinct("vid").alias("unique_visitors"))
        .orderBy("day")
    )


def email_engagement(events: DataFrame) -> DataFrame:
    sent, opened, clicked = (count_if(C("event_type") == f"email.{k}") for k in ("sent", "opened", "clicked"))
    per_user = (
        events.filter((C("surface") == "email") & C("user_id").isNotNull())
        .groupBy("user_id")
        .agg(sent.alias("sent"), opened.alias("opened"), clicked.alias("clicked"))
    )

    def pct(num: str, den: str):
        return F.round(C(num) * 100.0 / F.nullif(C(den), F.lit(0)), 1)

    return per_user.withColumns({"open_rate": pct("opened", "sent"), "click_rate": pct("clicked", "opened")})


def goal_funnel(events: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """Raw firings per stage; accounts are known at stage 4 only."""
    g = C("matomo_idgoal")
    return events.filter(since_midnight("created_at", as_of, days) & g.isNotNull()).agg(
        count_if(g == 1).alias("s1_pricing_views"), count_if(g == 2).alias("s2_package_clicks"),
        count_if(g == 3).alias("s3_payment_chosen"), count_if(g == 4).alias("s4_clicked_pay"),
        F.count_distinct(F.when(g == 4, C("user_id"))).alias("s4_unique_users"),
    )


def goals_per_day(events: DataFrame, as_of: datetime, days: int = 7, goals=(1, 2, 4, 5)) -> DataFrame:
    g = C("matomo_idgoal")
    return (
        events.filter(since_midnight("created_at", as_of, days) & g.isNotNull())
        .groupBy(F.to_date("created_at").alias("day"))
        .agg(*[count_if(g == k).alias(f"g{k}") for k in goals]).orderBy("day")
    )


def user_ltv(revenue: DataFrame, top: int | None = 100) -> DataFrame:
    ltv = (
        completed(revenue).groupBy("user_id")
        .agg(F.sum("amount_usd").cast("double").alias("ltv_usd"), F.count(F.lit(1)).alias("transactions"),
             F.min("transaction_date").alias("first_purchase"), F.max("transaction_date").alias("last_purchase"))
    )
    return ltv if top is None else ltv.orderBy(F.desc("ltv_usd"), "user_id").limit(top)


def ltv_engagement(revenue: DataFrame, events: DataFrame, as_of: datetime, min_ltv: float = 100,
                   days: int = 30, top: int = 50) -> DataFrame:
    rich = user_ltv(revenue, None).filter(C("ltv_usd") > min_ltv).select("user_id", "ltv_usd")
    views = (
        events.filter(since_midnight("created_at", as_of, days) & (C("event_type") == "pageview")
                      & C("user_id").isNotNull())
        .groupBy("user_id")
        .agg(F.max("created_at").alias("last_seen"), F.count(F.lit(1)).alias("pageviews_30d"))
    )
    return rich.join(views, "user_id", "left").orderBy(F.desc("ltv_usd"), "user_id").limit(top)


def events_by_source(events: DataFrame) -> DataFrame:
    return events.groupBy(json_field("metadata", "src").alias("src")).agg(F.count(F.lit(1)).alias("events"))


def recent_node_stats(stats_minute: DataFrame, as_of: datetime, minutes: int = 30, top: int = 20) -> DataFrame:
    """Read over the minute rollup: partial sums are added up again, averages last."""
    start = as_of - timedelta(minutes=minutes)
    return (
        stats_minute.filter(C("bucket") >= ts_lit(start))
        .groupBy("bucket", "node")
        .agg(F.sum("requests").alias("reqs"), F.sum("bytes").alias("bytes"), F.sum("errors").alias("errors"),
             ratio(F.sum("req_time_sum"), F.sum("requests"), 3).alias("rt_avg_ms"))
        .orderBy(F.desc("bucket"), F.desc("reqs"), "node").limit(top)
    )


def funnel_stage(events: DataFrame) -> DataFrame:
    """Furthest funnel stage 0-4 per identified account."""
    g = C("matomo_idgoal")
    return (
        events.filter(C("user_id").isNotNull()).groupBy("user_id")
        .agg(F.max(F.when(g.between(1, 4), g).otherwise(0)).cast("int").alias("funnel_stage"))
    )


def goal_dedup(events: DataFrame, goal: int = 4) -> DataFrame:
    """One firing per account and day: the first."""
    day = F.to_date("created_at")
    return (
        events.filter((C("matomo_idgoal") == goal) & C("user_id").isNotNull())
        .groupBy("user_id", day.alias("day"))
        .agg(F.min("created_at").alias("first_at"), F.count(F.lit(1)).alias("firings"))
    )


def reconciliation_rows(billing: DataFrame) -> DataFrame:
    return billing.filter(C("action") == "RECONCILIATION_CRITICAL")


def billing_error_rate(billing: DataFrame) -> DataFrame:
    return (
        billing.groupBy("action")
        .agg(F.count(F.lit(1)).alias("events"), count_if(C("level") == "error").alias("errors"))
        .withColumn("error_rate", ratio(C("errors"), C("events"), 4))
    )


def failures_by_status(requests: DataFrame, route: str = "base_path") -> DataFrame:
    return (
        requests.filter(C("status") >= 400).groupBy(route, "status").agg(F.count(F.lit(1)).alias("failures"))
    )


def quality_vs_load(stats_minute: DataFrame, node_load: DataFrame) -> DataFrame:
    """Request quality per minute next to node telemetry of the same minute.

    ``node_load`` is reduced to one row per node and minute first.
    """
    load = (
        node_load.groupBy("node", F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("bucket"))
        .agg(F.avg("load1").alias("load1"))
    )
    per_minute = (
        stats_minute.groupBy("node", "bucket")
        .agg(F.sum("requests").alias("requests"), F.sum("errors").alias("errors"))
        .withColumn("error_rate", ratio(C("errors"), C("requests")))
    )
    return (
        per_minute.join(load, ["node", "bucket"]).groupBy("node")
        .agg(F.count(F.lit(1)).alias("minutes"), F.corr("error_rate", "load1").alias("load_corr"))
    )
