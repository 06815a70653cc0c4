"""Per-user-day extracts: the bounded inputs of every point-in-time window.

Raw facts are combined to (user, day) before anything is partitioned by user, so
one user never brings more rows into a window than there are days.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import MOBILE_UA, WEB_SURFACES, Config
from tidemark.functions.ranking import salted_join
from tidemark.functions.scalar import (
    contains_ci, count_if, epoch_day, flag, json_field, ratio, since_midnight, strip_prefix, yyyymm,
)
from tidemark.sources.tables import completed

C = F.col
EMAIL_TYPES = ("email.sent", "email.opened", "email.clicked")
SUB_KINDS = {
    "started": ("created", "reactivated"), "reactivated": ("reactivated",),
    "churned": ("canceled", "expired"), "cancel_sched": ("cancellation_scheduled",),
}
TASK_TYPES = ("task.completed", "task.failed", "account.storage_warning")


def month_filter(ts: str, month: int, last: int | None = None):
    """Rows of one month (yyyymm), or of all up to ``last``, as a range on the raw timestamp, so it can prune."""
    year, mon = divmod(month if last is None else last, 100)
    nxt = (year + mon // 12, mon % 12 + 1)
    lo, hi = f"{month // 100}-{month % 100:02d}-01", f"{nxt[0]}-{nxt[1]:02d}-01"
    return (C(ts) >= F.lit(lo).cast("timestamp_ntz")) & (C(ts) < F.lit(hi).cast("timestamp_ntz"))


def _per_day(events: DataFrame):
    return events.groupBy("user_id", epoch_day("created_at").alias("day"))


def user_day_email(events: DataFrame) -> DataFrame:
    """E-mail user-day; the sending system is told apart by its source tag."""
    src = json_field("metadata", "src")
    sent = C("event_type") == "email.sent"
    rows = events.filter(C("event_type").isin(*EMAIL_TYPES) & C("user_id").isNotNull())
    return _per_day(rows).agg(
        count_if(sent & (src == "mautic")).alias("mautic_sent"),
        count_if(sent & (src == "internal_events")).alias("internal_sent"),
        count_if(C("event_type") == "email.opened").alias("opened"),
        count_if(C("event_type") == "email.clicked").alias("clicked"),
    )


def user_day_web(events: DataFrame) -> DataFrame:
    event, view = C("event_type") == "event", C("event_type") == "pageview"

    def act(category: str, *actions: str):
        return count_if(event & (C("category") == category) & C("action").isin(*actions))

    rows = events.filter(C("surface").isin(*WEB_SURFACES) & C("user_id").isNotNull())
    return _per_day(rows).agg(
        count_if(view).alias("pageviews"),
        act("File", "Download").alias("file_dl"),
        act("Archive", "Download").alias("archive_dl"),
        act("File", "View").alias("file_views"),
        act("video", "stream_start", "stream_session").alias("streams"),
        count_if(view & (contains_ci("url", "pricing") | contains_ci("url", "payment"))).alias("pricing_views"),
        count_if(C("matomo_idgoal") == 4).alias("goal4"),
        act("Promotional", "visited_subscription").alias("promo_sub"),
        count_if(C("event_type") == "session_end").alias("sessions"),
    )


def user_day_task(events: DataFrame) -> DataFrame:
    rows = events.filter(C("event_type").isin(*TASK_TYPES) & C("user_id").isNotNull())
    return _per_day(rows).agg(
        count_if(C("event_type") == "task.completed").alias("completed"),
        count_if(C("event_type") == "task.failed").alias("failed"),
        count_if(C("event_type") == "account.storage_warning").alias("storage_warnings"),
    )


def user_day_activity(events: DataFrame) -> DataFrame:
    """E-mail, web and task user-days in one pass over the events.

    Same columns as the single extracts. Web counters are NULL on days without a web
    event, so a count of them still counts active days; ``has_email`` tells the days
    the e-mail extract would have a row for. Only counters, so the pass stays a hash
    aggregation; the last subscription event of a day (:func:`sub_days`) would turn it
    into a sort of all rows and is read apart from its few rows.
    """
    kind, src = C("event_type"), json_field("metadata", "src")
    web = C("surface").isin(*WEB_SURFACES)
    email = kind.isin(*EMAIL_TYPES)
    event, view = web & (kind == "event"), web & (kind == "pageview")

    def act(category: str, *actions: str):
        return event & (C("category") == category) & C("action").isin(*actions)

    web_counters = {
        "pageviews": view,
        "file_dl": act("File", "Download"), "archive_dl": act("Archive", "Download"),
        "file_views": act("File", "View"), "streams": act("video", "stream_start", "stream_session"),
        "pricing_views": view & (contains_ci("url", "pricing") | contains_ci("url", "payment")),
        "goal4": web & (C("matomo_idgoal") == 4),
        "promo_sub": act("Promotional", "visited_subscription"),
        "sessions": web & (kind == "session_end"),
    }
    counters = {
        "mautic_sent": (kind == "email.sent") & (src == "mautic"),
        "internal_sent": (kind == "email.sent") & (src == "internal_events"),
        "opened": kind == "email.opened", "clicked": kind == "email.clicked",
        "completed": kind == "task.completed", "failed": kind == "task.failed",
        "storage_warnings": kind == "account.storage_warning",
    }
    rows = events.filter(C("user_id").isNotNull() & (web | kind.isin(*EMAIL_TYPES, *TASK_TYPES)))
    web_rows = count_if(web)
    return _per_day(rows).agg(
        flag(count_if(email) > 0).alias("has_email"),
        *[count_if(cond).alias(name) for name, cond in counters.items()],
        *[F.when(web_rows > 0, count_if(cond)).alias(name) for name, cond in web_counters.items()],
    )


def txns(revenue: DataFrame) -> DataFrame:
    """Completed payments of identified users."""
    return (
        completed(revenue).filter(C("user_id").isNotNull() & (C("user_id") != 0))
        .select("user_id", C("transaction_date").alias("ts"), "txn_id", "amount_usd", "billing_plan_id",
                "provider", "country")
    )


def txn_days(revenue: DataFrame) -> DataFrame:
    """Payments per user-day. Order within a day is by full timestamp, then id."""
    when = F.struct("ts", "txn_id")
    amount = C("amount_usd")
    cents = (amount * 100).cast("decimal(18,0)")
    return (
        txns(revenue).groupBy("user_id", epoch_day("ts").alias("day"))
        .agg(F.sum(amount).alias("amount"), F.count(F.lit(1)).alias("txns"),
             F.min_by(amount, when).alias("first_amount"), F.max_by(amount, when).alias("last_amount"),
             F.min(amount).alias("min_amount"), F.max(amount).alias("max_amount"),
             F.sum(cents * cents).cast("decimal(38,0)").alias("cents_sq"),  # exact: no cancellation later
             F.coalesce(F.sum(F.when(amount < 0, amount)), F.lit(0)).alias("refund_amount"),
             count_if(amount < 0).alias("refund_count"),
             F.max_by(F.struct("billing_plan_id", "provider", "country"), when).alias("last_txn"),
             F.collect_set("billing_plan_id").alias("plans"))  # plan catalogue: a few dozen ids
    )


def txn_history(revenue: DataFrame) -> DataFrame:
    """Payment days with the gap to the previous payment day of the user."""
    w = Window.partitionBy("user_id").orderBy("day")
    return txn_days(revenue).withColumns({
        "gap": C("day") - F.lag("day").over(w),
        "next_day": F.lead("day").over(w),
        "same_day": C("txns") - 1,  # payments that follow another one of the same day
    })


def sub_events(events: DataFrame) -> DataFrame:
    return (
        events.filter(C("event_type").startswith("subscription.") & C("user_id").isNotNull())
        .select("user_id", C("created_at").alias("ts"), "event_id", C("event_type").alias("type"))
    )


def sub_days(events: DataFrame) -> DataFrame:
    """Subscription events per user-day: last type of the day and counts per kind."""
    short = strip_prefix("type", "subscription.")
    rows = sub_events(events).withColumn("short", short)
    return rows.groupBy("user_id", epoch_day("ts").alias("day")).agg(
        F.max_by("short", F.struct("ts", "event_id")).alias("last_type"),
        *[count_if(C("short").isin(*names)).alias(kind) for kind, names in SUB_KINDS.items()],
    )


def profile(events: DataFrame) -> DataFrame:
    """Modal country, first day seen and number of visitors per account."""
    return (
        events.filter(C("user_id").isNotNull()).groupBy("user_id")
        .agg(F.mode("country", True).alias("country"), F.min(epoch_day("created_at")).alias("first_day"),
             F.count_distinct("vid").cast("int").alias("devices"))
    )


def mobile_share(events: DataFrame, as_of: datetime, days: int = 90) -> DataFrame:
    return (
        events.filter(since_midnight("created_at", as_of, days) & C("surface").isin(*WEB_SURFACES)
                      & C("user_id").isNotNull() & (C("ua") != ""))
        .groupBy("user_id")
        .agg(ratio(count_if(C("ua").rlike(MOBILE_UA)), F.count(F.lit(1)), 3).alias("mobile_share"))
    )


def account_profile(events: DataFrame, as_of: datetime, days: int = 90) -> DataFrame:
    """Profile and mobile share together, in one pass over the events."""
    with_ua = (since_midnight("created_at", as_of, days) & C("surface").isin(*WEB_SURFACES) & (C("ua") != ""))
    return (
        events.filter(C("user_id").isNotNull()).groupBy("user_id")
        .agg(F.mode("country", True).alias("country"), F.min(epoch_day("created_at")).alias("first_day"),
             F.count_distinct("vid").cast("int").alias("devices"),
             ratio(count_if(with_ua & C("ua").rlike(MOBILE_UA)), count_if(with_ua), 3).alias("mobile_share"))
    )


def send_detail(events: DataFrame, cfg: Config) -> DataFrame:
    """Sends per user, day and campaign from the day the internal sender took over."""
    start = F.lit(cfg.era_cutover.isoformat()).cast("timestamp_ntz")
    return (
        events.filter((C("event_type") == "email.sent") & C("user_id").isNotNull() & (C("created_at") >= start))
        .groupBy("user_id", epoch_day("created_at").alias("day"), json_field("metadata", "email_id").alias("email_id"))
        .agg(F.count(F.lit(1)).alias("c"))
    )


def bulk_sends(events: DataFrame, cfg: Config) -> DataFrame:
    """Sends of campaigns that reached the bulk size on that day, per user-day.

    A big campaign day holds a large part of all sends, so the day totals are
    combined first and joined back with the details spread over salts.
    """
    detail = send_detail(events, cfg)
    bulk_days = (
        detail.groupBy("email_id", "day").agg(F.sum("c").alias("_sent"))
        .filter(C("_sent") >= cfg.bulk_threshold).select("email_id", "day")
    )
    return (
        salted_join(detail, bulk_days, ["email_id", "day"], ["user_id"], cfg.salts)
        .groupBy("user_id", "day").agg(F.sum("c").alias("bulk"))
    )


def monthly(df: DataFrame, day: str = "day") -> DataFrame:
    """Add the month column extracts are partitioned by on disk."""
    return df.withColumn("month", yyyymm(F.date_from_unix_date(day)))
