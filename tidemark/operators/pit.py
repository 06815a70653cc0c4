"""Point-in-time windows: what was known about a key before an index day.

Facts (one row per key and day at most, per source) and index rows go through one
window partitioning. A frame is a range of days relative to the index day:
``(-30, -1)`` is the 30 days before it, ``(1, 14)`` the two weeks after it. The
index day itself belongs to neither. There is no range join, and the rows of one
key are bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import to_epoch_day

START = Window.unboundedPreceding


@dataclass(frozen=True)
class Frame:
    agg: Column
    lo: int
    hi: int


def back(agg: Column, days: int) -> Frame:
    return Frame(agg, -days, -1)


def history(agg: Column) -> Frame:
    return Frame(agg, START, -1)


def ahead(agg: Column, days: int) -> Frame:
    return Frame(agg, 1, days)


def pit_windows(
    facts: Sequence[DataFrame] | DataFrame,
    index: DataFrame,
    frames: Mapping[str, Frame],
    key: str = "user_id",
    day: str = "day",
) -> DataFrame:
    """Index rows (all their columns) with one column per frame.

    Several fact frames may be given; a column missing from one is NULL there.
    Aggregates skip NULL, so index rows never count as facts.
    """
    sources = [facts] if isinstance(facts, DataFrame) else list(facts)
    rows = stack_facts([index.withColumn("_index", F.lit(True)), *sources])
    return with_frames(rows, frames, key, day).filter("_index").select(*index.columns, *frames)


def stack_facts(sources: Sequence[DataFrame]) -> DataFrame:
    """Facts of several sources under each other, missing columns NULL."""
    out = sources[0]
    for f in sources[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def with_frames(rows: DataFrame, frames: Mapping[str, Frame], key: str = "user_id", day: str = "day") -> DataFrame:
    """All rows with one column per frame. When index days are days of a fact row
    anyway, the caller marks and filters them itself and needs no extra rows."""
    w = Window.partitionBy(key).orderBy(day)
    return rows.withColumns({n: f.agg.over(w.rangeBetween(f.lo, f.hi)) for n, f in frames.items()})


def cross_index(
    spans: DataFrame, dates: Sequence[date], after: str = "first_day", until: str | None = None,
    day: str = "day",
) -> DataFrame:
    """One row per key and index date later than ``after`` (and not past ``until``).

    The dates are a literal array: every row explodes to its own eligible dates,
    nothing is crossed and pruned later.
    """
    days = F.array(*[F.lit(to_epoch_day(d)) for d in dates])

    def eligible(d: Column) -> Column:
        ok = d > F.col(after)
        return ok if until is None else ok & (d <= F.col(until))

    return spans.withColumn(day, F.explode(F.filter(days, eligible)))


def with_history(
    rows: DataFrame, history: DataFrame, columns: Sequence[str], snapshot: str = "snapshot_day", max_age: int | None = None,
    key: str = "user_id", day: str = "day",
) -> DataFrame:
    """Rows with ``columns`` of their key's latest snapshot dated before their day, and its age in days as ``snapshot_age``.

    A snapshot of the day itself may hold what the day brought, so it counts from the next day on; one older than ``max_age`` days
    does not count. A snapshot is valid until the key's next one: rows and snapshots go through one window over the key, and
    no interval is joined. A key has a row per snapshot and day at most.
    """
    known = F.struct(*[F.col(c) for c in columns], F.col(snapshot).alias("_taken"))
    facts = history.select(F.col(key), F.col(snapshot).alias(day), known.alias("_known"))
    found = pit_windows(facts, rows, {"_then": Frame(F.last("_known", True), START if max_age is None else -max_age, -1)}, key, day)
    return found.select(*rows.columns, *[F.col(f"_then.{c}").alias(c) for c in columns], (F.col(day) - F.col("_then._taken")).alias("snapshot_age"))
