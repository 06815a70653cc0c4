"""The logical source tables an operator can ask for, and reads over versioned tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import ts_lit


@dataclass(frozen=True)
class Tables:
    """Lazy source frames. Only what an operator touches is ever read."""

    events: DataFrame
    revenue: DataFrame
    requests: DataFrame
    subscription_state: DataFrame
    vid_user_map: DataFrame
    bw_user_day: DataFrame
    files: DataFrame
    accounts: DataFrame
    billing: DataFrame
    expiry: DataFrame
    plan_storage: DataFrame
    location: str = ""  # folder the tables were read from


def latest_version(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first by ``order`` (give a unique order).

    The rank filter is applied before the shuffle as well, so a key with very many
    copies sends at most one row per input partition.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def premium_ids(state: DataFrame) -> DataFrame:
    """Presence in the state table means premium: cancelled users are absent."""
    return state.select("user_id").distinct()


def completed(revenue: DataFrame) -> DataFrame:
    return revenue.filter(F.col("status") == "completed")


@dataclass(frozen=True)
class Retention:
    """Rows matching ``when`` (all rows if None) live for ``days``."""

    ts: str
    days: int
    when: str | None = None


RETENTION_RULES = {
    "events": (Retention("created_at", 30, "event_type = 'heartbeat'"),
               Retention("created_at", 730)),
    "requests": (Retention("ts", 90),),
    "node_health": (Retention("ts", 30),),
}


def apply_retention(df: DataFrame, rules: Sequence[Retention], as_of: datetime) -> DataFrame:
    """Keep the rows whose time to live has not passed under any rule."""
    keep = F.lit(True)
    for r in rules:
        alive = F.col(r.ts) >= ts_lit(as_of - timedelta(days=r.days))
        keep = keep & (alive if r.when is None else (alive | ~F.coalesce(F.expr(r.when), F.lit(False))))
    return df.filter(keep)


def exclude_window(df: DataFrame, ts: str, start: datetime, end: datetime) -> DataFrame:
    """Leave out a window known to be inflated (double-written)."""
    return df.filter(~((F.col(ts) >= ts_lit(start)) & (F.col(ts) < ts_lit(end))))


def clamp_future(df: DataFrame, ts: str, as_of: datetime, skew_seconds: int = 300) -> DataFrame:
    """Client clocks run ahead: rows up to the tolerance are pulled back to ``as_of``,
    rows beyond it are left out."""
    limit = as_of + timedelta(seconds=skew_seconds)
    return df.filter(F.col(ts) <= ts_lit(limit)).withColumn(ts, F.least(F.col(ts), ts_lit(as_of)))
