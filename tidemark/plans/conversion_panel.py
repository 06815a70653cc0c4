"""E-mail conversion and uplift panel: one row per (user, send day or control day)."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.functions.scalar import (
    day_to_date, flag, hash_bucket, in_days, ratio, to_epoch_day, weekday0,
)
from tidemark.operators import extracts as x
from tidemark.operators.pit import Frame, ahead, back, history, stack_facts, with_frames
from tidemark.sources.tables import Tables

C = F.col
SAMPLE_BUCKETS = 10_000
LOOKBACK = 90  # longest counter window, days
SEGMENT_FLAGS = (
    "seg_storage_warning", "seg_heavy_downloader", "seg_streamer", "seg_cart_abandoner",
    "seg_winback_active", "seg_dormant_payer", "seg_soft_cancel", "seg_monthly_loyal",
)


def date_range(cfg: Config, as_of: datetime) -> tuple[int, int]:
    """First and last index day; the last one still has a complete label."""
    last = cfg.panel_end or (as_of - timedelta(days=cfg.label_days + 1)).date()
    return to_epoch_day(cfg.panel_start), to_epoch_day(last)


def mark_campaign_days(days: DataFrame, bulk: DataFrame, cfg: Config, as_of: datetime) -> DataFrame:
    """Add ``era`` (NULL when the day is no campaign sample) and ``sends_today``.

    ``days`` has one row per user-day with the e-mail counters and ``has_email``.
    """
    lo, hi = date_range(cfg, as_of)
    old_era = (C("mautic_sent") > 0) & (C("day") <= to_epoch_day(cfg.era_cutover))
    blast = F.coalesce(C("bulk"), F.lit(0))
    era = F.when(old_era, "mautic").when(blast > 0, "internal")
    sends = F.when(old_era, C("mautic_sent")).otherwise(0) + blast
    in_scope = (C("has_email") == 1) & C("day").between(lo, hi)
    return (
        days.join(bulk, ["user_id", "day"], "left")
        .withColumns({"era": F.when(in_scope, era), "sends_today": F.when(in_scope, sends)}).drop("bulk")
    )


def index_days(email_day: DataFrame, bulk: DataFrame, cfg: Config, as_of: datetime) -> DataFrame:
    """Campaign days of each user with the era of the sender and sends that day."""
    marked = mark_campaign_days(email_day.withColumn("has_email", F.lit(1)), bulk, cfg, as_of)
    return marked.filter(C("era").isNotNull()).select(
        "user_id", "day", "era", "sends_today", F.lit(1).alias("treatment"))


def mark_control_days(days: DataFrame, emailed: DataFrame, cfg: Config, as_of: datetime) -> DataFrame:
    """Add ``is_control``: web-active days without a send nearby, the first few per user
    in hash order, only for users in the e-mail data (``emailed``: one row per user).

    Uses the same partitioning by user as the feature windows that follow.
    """
    lo, hi = date_range(cfg, as_of)
    quiet = cfg.control_quiet_days
    user = Window.partitionBy("user_id")
    near = F.sum(C("mautic_sent") + C("internal_sent")).over(user.orderBy("day").rangeBetween(-quiet, quiet))
    eligible = (
        C("pageviews").isNotNull() & C("day").between(lo, hi) & (F.coalesce(near, F.lit(0)) == 0)
        & C("_emailed").isNotNull()
    )
    place = F.row_number().over(user.orderBy(F.desc("_eligible"), F.md5(F.concat_ws(":", "user_id", "day")), "day"))
    return (
        days.join(emailed.select("user_id", F.lit(True).alias("_emailed")), "user_id", "left")
        .withColumn("_eligible", F.coalesce(eligible, F.lit(False)))
        .withColumn("is_control", C("_eligible") & (place <= cfg.control_per_user)).drop("_eligible", "_emailed")
    )


def emailed_users(events: DataFrame) -> DataFrame:
    return events.filter(C("event_type").isin(*x.EMAIL_TYPES) & C("user_id").isNotNull()).select("user_id").distinct()


def control_days(days: DataFrame, emailed: DataFrame, cfg: Config, as_of: datetime) -> DataFrame:
    """Control rows from the user-day activity."""
    return mark_control_days(days, emailed, cfg, as_of).filter("is_control").select(
        "user_id", "day", F.lit("control").alias("era"), F.lit(0).cast("long").alias("sends_today"),
        F.lit(0).alias("treatment"))


def _window_features() -> dict[str, Frame]:
    sent = C("mautic_sent") + C("internal_sent")
    frames = {f"em_sent_{n}": back(F.sum(sent), n) for n in (7, 30, 90)}
    frames |= {f"em_opened_{n}": back(F.sum("opened"), n) for n in (30, 90)}
    frames["em_clicked_90"] = back(F.sum("clicked"), 90)
    frames["_last_send"] = back(F.max(F.when(sent > 0, C("day"))), 90)
    frames["_last_open"] = back(F.max(F.when(C("opened") > 0, C("day"))), 90)
    web = {
        "pageviews": (7, 30), "file_dl": (30, 90), "archive_dl": (30, 90), "file_views": (30,),
        "streams": (30, 90), "pricing_views": (30, 90), "goal4": (30, 90), "promo_sub": (30, 90),
        "sessions": (7, 30),
    }
    # a web row always carries pageviews (possibly 0), so counting them counts active days
    frames |= {f"web_active_days_{n}": back(F.count("pageviews"), n) for n in (7, 30)}
    frames |= {f"{c}_{n}": back(F.sum(c), n) for c, spans in web.items() for n in spans}
    frames["_last_web"] = back(F.max(F.when(C("pageviews").isNotNull(), C("day"))), 90)
    frames["_last_promo"] = back(F.max(F.when(C("promo_sub") > 0, C("day"))), 90)
    frames |= {
        "tasks_completed_30": back(F.sum("completed"), 30),
        "tasks_failed_30": back(F.sum("failed"), 30),
        "storage_warnings_30": back(F.sum("storage_warnings"), 30),
    }
    return frames


def _money_features(cfg: Config) -> dict[str, Frame]:
    txn_day = F.when(C("txns").isNotNull(), C("day"))
    first_ahead = F.first(F.when(C("txns").isNotNull(), F.struct("day", "first_amount")), True)
    return {
        "_ltv": history(F.sum("amount")),
        "txns_before": history(F.sum("txns")),
        "_last_txn_day": history(F.max(txn_day)),
        "_first_txn_day": history(F.min(txn_day)),
        "_last_amount": history(F.last("last_amount", True)),
        "txns_365d": back(F.sum("txns"), 365),
        "_sub": history(F.last(F.when(C("last_type").isNotNull(), F.struct("last_type", "day")), True)),
        "_pay": ahead(first_ahead, cfg.label_days),
        "_started": ahead(F.max(F.when(C("started") > 0, 1)), cfg.label_days),
    }


def _since(day: str) -> Column:
    return F.coalesce(C("day") - C(day), F.lit(-1)).cast("int")


def panel_candidates(t: Tables, as_of: datetime, cfg: Config, uplift: bool = False) -> DataFrame:
    """All index rows with features, flags and labels, before negatives are sampled."""
    lo, hi = date_range(cfg, as_of)
    # the counters look back 90 days at most and controls a few days ahead: older and
    # newer events are never read for them
    reach = t.events.filter(in_days("created_at", lo - LOOKBACK, hi + cfg.control_quiet_days))
    campaign = t.events.filter(in_days("created_at", lo, hi))
    days = mark_campaign_days(x.user_day_activity(reach), x.bulk_sends(campaign, cfg), cfg, as_of)
    if uplift:
        days = mark_control_days(days, emailed_users(t.events), cfg, as_of)
        control = C("is_control") & C("era").isNull()
    else:
        control = F.lit(False)
    days = days.withColumns({
        "treatment": F.when(C("era").isNotNull(), 1).when(control, 0),
        "sends_today": F.coalesce("sends_today", F.lit(0)),
        "era": F.coalesce("era", F.lit("control")),
    })
    money = x.txn_days(t.revenue).select("user_id", "day", "amount", "txns", "first_amount", "last_amount")
    subs = x.sub_days(t.events).select("user_id", "day", "last_type", "started")
    counters = _window_features()
    # index days are activity days: they are marked, not added
    rows = with_frames(stack_facts([days, money, subs]), {**counters, **_money_features(cfg)})
    wide = rows.filter(C("treatment").isNotNull()).select(
        "user_id", "day", "era", "sends_today", "treatment", *counters, *_money_features(cfg))
    zero = [c for c in (*counters, "txns_before", "txns_365d") if not c.startswith("_")]
    wide = wide.fillna(0, subset=zero)

    premium = (C("ever_paid") == 1) & (
        (C("days_since_last_txn") <= cfg.premium_recent_days)
        | ((C("last_txn_amount") >= cfg.annual_amount) & (C("days_since_last_txn") <= cfg.premium_annual_days))
    )
    wide = wide.withColumns({
        "em_open_rate_90": ratio(C("em_opened_90"), C("em_sent_90"), 4),
        "days_since_last_send": _since("_last_send"),
        "days_since_last_open": _since("_last_open"),
        "days_since_web_activity": _since("_last_web"),
        "days_since_promo_sub": _since("_last_promo"),
        "pv_trend_7_30": ratio(C("pageviews_7"), C("pageviews_30") + 1, 4),
        "wa_trend_7_30": ratio(C("web_active_days_7"), C("web_active_days_30") + 1, 4),
        "send_dow": weekday0(C("day")),
        "tasks_observable": flag(C("day") >= to_epoch_day(cfg.tasks_since) + cfg.tasks_warmup),
        "subs_observable": flag(C("day") >= to_epoch_day(cfg.subs_since)),
        "ever_paid": flag(C("txns_before") > 0),
        "ltv_before_usd": F.coalesce(C("_ltv").cast("decimal(18,2)"), F.lit(0)),
        "days_since_last_txn": _since("_last_txn_day"),
        "last_txn_amount": F.coalesce("_last_amount", F.lit(0)),
        "last_sub_event": F.coalesce("_sub.last_type", F.lit("")),
        "days_since_sub_event": _since("_sub.day"),
    }).withColumn("premium_at_send", flag(premium))

    free, payer = C("premium_at_send") == 0, C("ever_paid") == 1
    paid = C("_pay").isNotNull()
    wide = wide.withColumns({
        "seg_storage_warning": flag(C("storage_warnings_30") > 0),
        "seg_heavy_downloader": flag(C("file_dl_30") + C("archive_dl_30") > cfg.panel_heavy_downloads),
        "seg_streamer": flag(C("streams_30") >= cfg.panel_streams),
        "seg_cart_abandoner": flag((C("pricing_views_30") > 0) & (C("goal4_30") == 0) & free),
        "seg_winback_active": flag(payer & free & (C("web_active_days_30") > 0)),
        "seg_dormant_payer": flag(payer & free & C("days_since_last_txn").between(0, cfg.panel_dormant_days)
                                  & (C("web_active_days_30") == 0)),
        "seg_soft_cancel": flag((C("last_sub_event") == "cancellation_scheduled")
                                & (C("days_since_sub_event") <= cfg.panel_soft_cancel_days)),
        "seg_monthly_loyal": flag(~free & (C("txns_365d") >= cfg.monthly_min_txns)
                                  & (C("last_txn_amount") < cfg.monthly_max_amount)),
        "label_payment_14d": flag(paid),
        "label_conv_14d": flag(paid & free),
        "label_sub_started_14d": F.coalesce("_started", F.lit(0)),
        "days_to_payment": F.coalesce(C("_pay.day") - C("day"), F.lit(-1)).cast("int"),
        "first_payment_usd": F.coalesce("_pay.first_amount", F.lit(0)),
    })
    return with_profile(wide, x.account_profile(t.events, as_of, cfg.mobile_window))


def with_profile(df: DataFrame, profile: DataFrame) -> DataFrame:
    """Country, devices, tenure and mobile share; users without a profile get defaults."""
    known = profile.withColumnRenamed("first_day", "_first_seen")
    first = F.least("_first_seen", "_first_txn_day")  # ignores a missing payment day
    return df.join(known, "user_id", "left").withColumns({
        "country": F.coalesce("country", F.lit("")),
        "devices": F.coalesce("devices", F.lit(0)),
        "tenure_days": F.when(C("_first_seen").isNull(), -1).otherwise(C("day") - first).cast("int"),
        "mobile_share_now": F.when(C("_first_seen").isNull(), 0.0).otherwise(F.coalesce("mobile_share", F.lit(0.0))),
    })


PANEL_COLUMNS = (
    "user_id", "send_date", "era", "sends_today",
    "em_sent_7", "em_sent_30", "em_sent_90", "em_opened_30", "em_opened_90", "em_clicked_90",
    "em_open_rate_90", "days_since_last_send", "days_since_last_open",
    "web_active_days_7", "web_active_days_30", "pageviews_7", "pageviews_30",
    "file_dl_30", "file_dl_90", "archive_dl_30", "archive_dl_90", "file_views_30",
    "streams_30", "streams_90", "pricing_views_30", "pricing_views_90", "goal4_30", "goal4_90",
    "days_since_web_activity", "promo_sub_30", "promo_sub_90", "days_since_promo_sub",
    "sessions_7", "sessions_30", "pv_trend_7_30", "wa_trend_7_30", "send_dow",
    "tasks_completed_30", "tasks_failed_30", "storage_warnings_30", "tasks_observable",
    "ever_paid", "ltv_before_usd", "txns_before", "days_since_last_txn", "last_txn_amount",
    "txns_365d", "premium_at_send", "last_sub_event", "days_since_sub_event", "subs_observable",
    "country", "tenure_days", "devices", "mobile_share_now",
    *SEGMENT_FLAGS,
    "label_payment_14d", "label_conv_14d", "label_sub_started_14d",
    "days_to_payment", "first_payment_usd", "sample_weight",
)


def downsample_negatives(df: DataFrame, label: str, rate: float, keys: tuple[str, ...]) -> DataFrame:
    """Keep all positives and a stable ``rate`` of the negatives; the weight undoes it."""
    positive = C(label) == 1
    bucket = hash_bucket([C(k) for k in keys], SAMPLE_BUCKETS)
    return (
        df.filter(positive | (bucket < int(rate * SAMPLE_BUCKETS)))
        .withColumn("sample_weight", F.when(positive, 1.0).otherwise(round(1.0 / rate, 4)))
    )


def build_conversion_panel(t: Tables, as_of: datetime, cfg: Config, uplift: bool = False) -> DataFrame:
    """The 69-column training panel; uplift mode adds control rows and ``treatment``."""
    rows = downsample_negatives(
        panel_candidates(t, as_of, cfg, uplift), "label_payment_14d", cfg.negative_rate, ("user_id", "day")
    )
    return (
        rows.withColumn("send_date", day_to_date("day"))
        .select(*PANEL_COLUMNS, *(["treatment"] if uplift else []))
    )


def segment_report(candidates: DataFrame) -> DataFrame:
    """Samples, positives and rate per flag over all treatment rows, plus all rows."""
    rows = candidates.filter(C("treatment") == 1).withColumn("all_candidates", F.lit(1))
    flags = ["all_candidates", *SEGMENT_FLAGS]
    totals = rows.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(f"n_{c}") for c in flags],
        *[F.coalesce(F.sum(C(c) * C("label_payment_14d")), F.lit(0)).alias(f"p_{c}") for c in flags],
    )
    entries = F.array(*[
        F.struct(F.lit(c).alias("segment"), C(f"n_{c}").alias("samples"), C(f"p_{c}").alias("positives"))
        for c in flags
    ])
    return (
        totals.select(F.inline(entries))
        .withColumn("rate", C("positives") / F.greatest(C("samples"), F.lit(1)))
    )


def segment_panel(panel: DataFrame, name: str) -> DataFrame:
    """Rows of one historical segment."""
    return panel.filter(C(name) == 1)
