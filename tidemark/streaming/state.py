"""State tables kept from the event stream, each with a batch twin."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.config import STATE_SUB_EVENTS
from tidemark.operators.joins import merge_slots, session_slots, stitch_sessions
from tidemark.streaming.merge import Merged
from tidemark.streaming.rollups import append_parts, watermarked

C = F.col


def with_skew_guard(events: DataFrame, late: str = "5 minutes", skew_seconds: int = 300) -> DataFrame:
    """Watermark for late rows; rows dated further ahead of their arrival than the
    tolerance are left out, the others are pulled back to it."""
    ahead = C("created_at") - F.make_dt_interval(secs=F.lit(skew_seconds))
    near = events.filter(ahead <= C("received_at")).withColumn("created_at", F.least("created_at", "received_at"))
    return watermarked(near, "created_at", late)


def dedup(events: DataFrame, late: str = "5 minutes", key: str = "idempotency_key") -> DataFrame:
    """First arrival per key within the watermark; the state stays bounded."""
    first = watermarked(events, "created_at", late).dropDuplicatesWithinWatermark([key])
    return first.withColumn("created_at", C("created_at").cast("timestamp_ntz"))


def payment_errors(requests: DataFrame) -> DataFrame:
    return requests.filter((C("is_error") == 1) | (C("status") >= 400))


def windowed_sessions(events: DataFrame, gap_minutes: int = 30, late: str = "5 minutes") -> DataFrame:
    """Stateful variant for append sinks: a session is emitted once it can no longer grow."""
    return (
        watermarked(events.filter(C("user_id").isNotNull()), "created_at", late)
        .groupBy("user_id", F.session_window("created_at", f"{gap_minutes} minutes").alias("w"))
        .agg(F.count(F.lit(1)).alias("events"))
        .select("user_id", C("w.start").cast("timestamp_ntz").alias("started_at"), "events")
    )


def start_sessions(events: DataFrame, path: str, checkpoint: str, gap_minutes: int = 30) -> StreamingQuery:
    """Append slot parts per micro-batch; :func:`read_sessions` merges and stitches them."""
    return append_parts(
        events, lambda batch: session_slots(batch, "user_id", "created_at", gap_minutes), path, checkpoint)


def read_sessions(parts: DataFrame, gap_minutes: int = 30) -> DataFrame:
    return stitch_sessions(merge_slots(parts, "user_id"), "user_id", gap_minutes)


# --- visitor -> account -----------------------------------------------------------------
def _version() -> Column:
    """(time, event id) as one number that orders alike: numbers keep the aggregation over all events hashed, where a
    struct would make Spark sort them."""
    micros = F.unix_micros(C("created_at").cast("timestamp")).cast("decimal(18,0)")
    return micros * F.lit(Decimal(10) ** 19) + C("event_id").cast("decimal(19,0)")


def vid_map(events: DataFrame) -> DataFrame:
    """Latest identified account per visitor, with the version it was seen at."""
    seen = events.filter(C("user_id").isNotNull()).select("vid", "user_id", _version().alias("version"))
    return seen.groupBy("vid").agg(F.max_by("user_id", "version").alias("user_id"), F.max("version").alias("version"))


def merge_vid_parts(parts: DataFrame) -> DataFrame:
    """One part per visitor out of many, still with its version."""
    return parts.groupBy("vid").agg(F.max_by("user_id", "version").alias("user_id"), F.max("version").alias("version"))


def merge_vid_map(parts: DataFrame) -> DataFrame:
    return merge_vid_parts(parts).drop("version")


# --- subscription state -----------------------------------------------------------------
#: Paying event types by number; every other type of a subscription event is ENDED.
ENDED = -1


def _kind() -> Column:
    kind = F.lit(ENDED)
    for number, name in enumerate(STATE_SUB_EVENTS):
        kind = F.when(C("event_type") == name, number).otherwise(kind)
    return kind


def last_subscription(events: DataFrame) -> DataFrame:
    """Number of the latest subscription event's type per user, with its version: both are numbers, which are hashed, not sorted."""
    seen = events.filter(C("event_type").startswith("subscription.") & C("user_id").isNotNull())
    seen = seen.select("user_id", _kind().alias("kind"), _version().alias("version"))
    return seen.groupBy("user_id").agg(F.max_by("kind", "version").alias("kind"), F.max("version").alias("version"))


def _state_columns(latest: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(n) for n in STATE_SUB_EVENTS])
    micros = F.floor(C("version") / F.lit(Decimal(10) ** 19)).cast("bigint")
    return latest.select("user_id", F.element_at(names, C("kind") + 1).alias("last_event_type"),
                         F.timestamp_micros(micros).cast("timestamp_ntz").alias("last_event_at"))


def merge_subscription(parts: DataFrame) -> DataFrame:
    """Current subscribers: users whose latest event is no longer a paying one are absent."""
    latest = parts.groupBy("user_id").agg(F.max_by("kind", "version").alias("kind"), F.max("version").alias("version"))
    return _state_columns(latest.filter(C("kind") != ENDED))


def subscription_state(events: DataFrame) -> DataFrame:
    """Batch twin."""
    return merge_subscription(last_subscription(events))


def subscription_rows(events: DataFrame) -> DataFrame:
    """Rows of the stored subscription table: users whose latest event ends their subscription are gone."""
    return last_subscription(events).withColumns({
        "at": F.floor(C("version") / F.lit(Decimal(10) ** 19)).cast("bigint"), "gone": C("kind") == ENDED})


def read_subscription_table(spark: SparkSession, table: Merged) -> DataFrame:
    return _state_columns(table.read(spark))


def start_subscription_table(events: DataFrame, table: Merged, checkpoint: str) -> StreamingQuery:
    return table.start(events, subscription_rows, checkpoint)


def start_vid_map(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return append_parts(events, vid_map, path, checkpoint)


def start_subscription_state(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return append_parts(events, last_subscription, path, checkpoint)


def start_payment_errors(requests: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return append_parts(requests, payment_errors, path, checkpoint)


def start_dedup(events: DataFrame, path: str, checkpoint: str, late: str = "5 minutes") -> StreamingQuery:
    """First arrivals appended as they come; the sink's commit protocol keeps a repeated batch out."""
    return (dedup(events, late).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
