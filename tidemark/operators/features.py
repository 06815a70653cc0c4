"""Per-user feature tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.functions.ranking import salted_join
from tidemark.functions.scalar import (
    count_if, days_before, epoch_day, file_extension, flag, gigabytes, json_field, lookup, ratio, since, since_midnight,
    small_distinct, sum_if, to_epoch_day,
)
from tidemark.sources.seeds import CATEGORIES, PERSONAS, content_category

C = F.col


def _gb(col: Column, digits: int) -> Column:
    return F.round(gigabytes(col), digits)


def user_edge(requests: DataFrame, as_of: datetime, cfg: Config) -> DataFrame:
    """Request-log quality of the last week."""
    rows = F.count(F.lit(1))
    media = C("base_path") == "/media"
    return (
        requests.filter(since_midnight("ts", as_of, cfg.edge_window) & (C("user_id") != 0))
        .groupBy("user_id")
        .agg(rows.alias("edge_requests_7d"), _gb(F.sum("bytes_sent"), 3).alias("edge_gb_7d"),
             count_if(media).alias("media_requests_7d"),
             _gb(sum_if("bytes_sent", media), 3).alias("stream_gb_7d"),
             count_if(C("status") == 429).alias("n_rate_limited_7d"),
             count_if(C("is_stall") == 1).alias("n_stall_7d"),
             count_if(C("status") >= 500).alias("n_errors_7d"),
             F.count_distinct("file_id").alias("distinct_files_7d"),
             small_distinct(F.to_date("ts")).alias("active_days_7d"),
             ratio(count_if(C("proto") == "h3"), rows, 3).alias("h3_share"),
             count_if(C("base_path") == "/app").alias("app_requests_7d"),
             small_distinct("country").alias("n_countries"))
    )


def user_tasks(events: DataFrame, as_of: datetime, cfg: Config) -> DataFrame:
    """Task use of the last month; the failure rate is over all task events."""
    failed = count_if(C("event_type") == "task.failed")
    return (
        events.filter(C("event_type").startswith("task.") & since("created_at", as_of, cfg.task_window)
                      & C("user_id").isNotNull())
        .groupBy("user_id")
        .agg(count_if(C("event_type") == "task.completed").alias("downloads_30d"),
             failed.alias("tasks_failed_30d"),
             ratio(failed, F.greatest(F.count(F.lit(1)), F.lit(1)), 3).alias("task_failure_rate"),
             small_distinct(F.to_date("created_at")).alias("active_task_days_30d"),
             days_before(F.max("created_at"), as_of).alias("days_since_last_task"))
    )


def user_billing_health(billing: DataFrame, as_of: datetime, cfg: Config) -> DataFrame:
    return (
        billing.filter(since("ts", as_of, cfg.billing_window) & (C("uid") != 0))
        .groupBy(C("uid").alias("user_id"))
        .agg(flag(count_if(C("action") == "GRACE_WATCH") > 0).alias("in_grace_period"),
             flag(count_if(C("action") == "RECONCILIATION_CRITICAL") > 0).alias("reconciliation_critical"),
             count_if(C("level") == "error").alias("billing_errors_30d"),
             days_before(F.max("ts"), as_of).alias("days_since_billing_event"))
    )


def user_storage_quota(ltv_scores: DataFrame, plan_storage: DataFrame, content: DataFrame) -> DataFrame:
    """Plan capacity against used storage; -1 when either is unknown."""
    plans = plan_storage.select(
        C("billing_plan_id").alias("_plan"), C("storage_gb").alias("_cap"), C("plan_name").alias("_name"))
    used = content.select("user_id", C("storage_gb").alias("_used"))
    known = (C("_cap") > 0) & C("_used").isNotNull()
    # one decimal of a percent from whole thousandths of a GB, so halves are exact
    tenths = F.round(F.round(C("_used") * 1000) / C("_cap"))
    return (
        ltv_scores.select("user_id", "last_plan_id")
        .join(plans, C("last_plan_id").cast("string").try_cast("bigint") == C("_plan"), "left")
        .join(used, "user_id", "left")
        .select("user_id", "last_plan_id", F.coalesce("_name", F.lit("unmapped")).alias("plan_name"),
                F.coalesce("_cap", F.lit(0)).alias("plan_gb"),
                F.coalesce("_used", F.lit(0.0)).alias("used_gb"),
                F.when(known, tenths / 10).otherwise(-1.0).alias("storage_used_pct"))
    )


CONTENT_COLUMNS = (
    "user_id", "content_status", "n_files", "storage_gb", "library_gb", "largest_file_gb", "avg_file_gb",
    "n_video", "n_audio", "n_ebook", "n_software", "n_archive", "n_image", "n_other",
    "gb_video", "gb_audio", "gb_ebook", "gb_software",
    "share_video", "share_audio", "share_ebook", "share_software",
    "primary_category", "content_persona", "days_since_last_add", "bandwidth_used_gb",
    "last_signin_day", "account_age_days", "gb_archive", "gb_image", "n_folders", "n_lost_files",
    "files_added_30d", "files_added_90d", "library_age_days", "saw_walkthrough", "is_business",
    "is_referred", "has_sso", "lost_pw_requests", "totp_enabled", "invites_accepted",
)


def _largest(prefix: str) -> Column:
    """Category with the largest value, first by name on a tie."""
    ordered = sorted(CATEGORIES)
    return F.greatest(*[
        F.struct(C(f"{prefix}{c}").alias("v"), F.lit(-i).alias("o"), F.lit(c).alias("c"))
        for i, c in enumerate(ordered)
    ])["c"]


def user_content(files: DataFrame, accounts: DataFrame, as_of: datetime) -> DataFrame:
    """Content profile per account: 42 columns. Accounts whose document could not be
    read keep only their status and zero files."""
    today = to_epoch_day(as_of)
    category = content_category(file_extension("relative_path"))
    age = F.lit(today) - C("last_update_day")
    per_user = (
        files.withColumn("_cat", category).groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("_bytes"), F.max("size").alias("_largest"),
             *[count_if(C("_cat") == c).alias(f"_n_{c}") for c in CATEGORIES],
             *[sum_if("size", C("_cat") == c).alias(f"_b_{c}") for c in CATEGORIES],
             F.sum("is_lost").alias("n_lost_files"), F.count_distinct("folder_id").alias("n_folders"),
             F.min("last_update_day").alias("_first"), F.max("last_update_day").alias("_last"),
             count_if(age <= 30).alias("files_added_30d"), count_if(age <= 90).alias("files_added_90d"))
    )
    numbers = [c for c in per_user.columns if c not in ("user_id", "_first", "_last")]
    ok = C("content_status") == "ok"
    joined = accounts.join(per_user, "user_id", "left").fillna(0, subset=numbers)
    primary = (
        F.when(C("_bytes") > 0, _largest("_b_")).when(C("n_files") > 0, _largest("_n_")).otherwise("none")
    )
    storage = gigabytes("root_size")

    def share(c: str) -> Column:
        return F.when(C("root_size") > 0, F.round(gigabytes(f"_b_{c}") / storage, 3)).otherwise(0.0)

    full = joined.withColumns({
        "storage_gb": F.round(storage, 3),
        "library_gb": _gb(C("_bytes"), 3),
        "largest_file_gb": _gb(C("_largest"), 3),
        "avg_file_gb": ratio(gigabytes("_bytes"), C("n_files"), 4),
        **{f"n_{c}": C(f"_n_{c}") for c in ("video", "audio", "ebook", "software", "archive", "image")},
        "n_other": C("_n_other") + C("_n_submeta"),
        **{f"gb_{c}": _gb(C(f"_b_{c}"), 2) for c in ("video", "audio", "ebook", "software", "archive", "image")},
        **{f"share_{c}": share(c) for c in ("video", "audio", "ebook", "software")},
        "primary_category": primary,
        "days_since_last_add": F.coalesce(F.lit(today) - C("_last"), F.lit(-1)),
        "library_age_days": F.coalesce(F.lit(today) - C("_first"), F.lit(-1)),
        "bandwidth_used_gb": _gb(C("bandwidth_used"), 3),
        "last_signin_day": F.coalesce("last_signin_day", F.lit(-1)),
        "account_age_days": F.coalesce(F.lit(today) - C("sign_up_day"), F.lit(-1)),
    }).withColumn(
        "content_persona",
        F.when(C("n_files") == 0, "empty").otherwise(lookup("primary_category", PERSONAS, "mixed")),
    )
    full = full.withColumn("n_files", F.when(ok, C("n_files")).otherwise(0))
    kept = ("user_id", "content_status", "n_files")
    return full.select(*[C(c) if c in kept else F.when(ok, C(c)).alias(c) for c in CONTENT_COLUMNS])


def readable_content(content: DataFrame) -> DataFrame:
    """Accounts that could be read, with an empty flag and a named persona."""
    return (
        content.filter(C("content_status") == "ok")
        .withColumn("is_empty", flag(C("n_files") == 0))
        .withColumn("content_persona", F.coalesce("content_persona", F.lit("none")))
    )


NOW_DEFAULTS: dict[str, object] = {
    "storage_used_pct": -1.0, "content_persona": "unknown", "n_lost_files": 0, "files_added_30d": 0,
    "content_storage_gb": -1.0, "share_video": -1.0, "bandwidth_used_gb": -1.0, "n_rate_limited_7d": 0,
    "n_stall_7d": 0, "stream_gb_7d": 0.0, "downloads_30d": 0, "task_failure_rate": 0.0,
}


def now_features(content: DataFrame, quota: DataFrame, edge: DataFrame, tasks: DataFrame) -> DataFrame:
    """Features known only for the present, for ablation tests."""
    joined = (
        content.withColumnRenamed("storage_gb", "content_storage_gb")
        .select("user_id", "content_persona", "n_lost_files", "files_added_30d", "content_storage_gb",
                "share_video", "bandwidth_used_gb")
        .join(quota.select("user_id", "storage_used_pct"), "user_id", "left")
        .join(edge.select("user_id", "n_rate_limited_7d", "n_stall_7d", "stream_gb_7d"), "user_id", "left")
        .join(tasks.select("user_id", "downloads_30d", "task_failure_rate"), "user_id", "left")
    )
    return joined.select("user_id", *NOW_DEFAULTS).fillna(NOW_DEFAULTS)


# --- campaigns -------------------------------------------------------------------------------------------
def campaign_days(events: DataFrame) -> DataFrame:
    """Sends, opens and clicks per campaign and day, by the day they happened."""
    kinds = {"sent": "email.sent", "opened": "email.opened", "clicked": "email.clicked"}
    return (
        events.filter(C("event_type").isin(*kinds.values()))
        .groupBy(json_field("metadata", "email_id").alias("email_id"), epoch_day("created_at").alias("day"))
        .agg(*[count_if(C("event_type") == e).alias(n) for n, e in kinds.items()])
    )


def campaign_history(days: DataFrame, strength: float = 50.0) -> DataFrame:
    """What was known about a campaign before each of its days: ``sent_before`` and the open and click rates per send, each
    pulled towards the rate of all campaigns before that day by ``strength`` sends. NULL where nothing had been sent at all.

    Only earlier days count, so a rate never holds the responses of the day it is used on. Windows run over campaign days; the
    rates of all campaigns over calendar days.
    """
    counts = ("sent", "opened", "clicked")
    calendar = days.groupBy("day").agg(*[F.sum(c).alias(c) for c in counts])
    earlier = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)  # a row per calendar day
    overall = calendar.select("day", *[F.sum(c).over(earlier).alias(f"_all_{c}") for c in counts])
    own = Window.partitionBy("email_id").orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
    known = days.select("email_id", "day", *[F.coalesce(F.sum(c).over(own), F.lit(0)).alias(f"{c}_before") for c in counts])
    joined = known.join(overall, "day")

    def rate(c: str):
        everywhere = C(f"_all_{c}") / F.nullif(C("_all_sent"), F.lit(0))
        return (C(f"{c}_before") + F.lit(strength) * everywhere) / (C("sent_before") + F.lit(strength))

    return joined.select("email_id", "day", "sent_before", rate("opened").alias("open_rate_before"), rate("clicked").alias("click_rate_before"))


def with_campaign_history(sends: DataFrame, history: DataFrame, salts: int) -> DataFrame:
    """Sends (email_id, day) with their campaign's history; a campaign day may hold a large part of all sends."""
    return salted_join(sends, history, ["email_id", "day"], ["user_id"], salts, "left")
