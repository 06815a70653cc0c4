"""Joins Spark has no single operator for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ranking import salted_join

C = F.col


def match_tolerance(
    a: DataFrame, b: DataFrame, key: str, ts_a: str, ts_b: str, id_a: str, id_b: str,
    tolerance: int = 300, zone: str | None = None,
) -> DataFrame:
    """Nearest ``b`` row within ``tolerance`` seconds of every ``a`` row of the same key.

    ``zone`` converts local wall-clock times of ``b`` to UTC first. Result: ``id_a``,
    ``id_b`` and ``gap_seconds``; ``a`` rows without a partner are left out. On equal
    distance the earlier partner wins, then the smaller id. As in any equi-join a NULL key
    matches nothing, nor does a NULL time.

    Time is cut into slots as long as the tolerance. A ``b`` row visits its own and
    both neighbouring slots; inside (key, slot) one ordered pass finds the last
    partner before and the first one after. No pair is ever built, and a hot key is
    spread over its slots.
    """
    b_time = C(ts_b) if zone is None else F.to_utc_timestamp(ts_b, zone)

    def micros(c):
        return F.unix_micros(c.cast("timestamp"))

    step = tolerance * 1_000_000
    a, b = a.filter(C(key).isNotNull() & C(ts_a).isNotNull()), b.filter(C(key).isNotNull() & C(ts_b).isNotNull())
    left = a.select(
        C(key).alias("_k"), micros(C(ts_a)).alias("_t"), C(id_a).alias("_a"),
        F.lit(None).cast(b.schema[id_b].dataType).alias("_b"),
    ).withColumn("_slot", F.floor(C("_t") / step))
    right = b.select(
        C(key).alias("_k"), micros(b_time).alias("_t"),
        F.lit(None).cast(a.schema[id_a].dataType).alias("_a"), C(id_b).alias("_b"),
    ).withColumn("_slot", F.explode(F.sequence(F.floor(C("_t") / step) - 1, F.floor(C("_t") / step) + 1)))
    # of the partners at one instant only the smallest id can win
    right = right.groupBy("_k", "_t", "_a", "_slot").agg(F.min("_b").alias("_b")).select(*left.columns)
    both = left.unionByName(right)
    partner = F.when(C("_b").isNotNull(), F.struct("_t", "_b"))
    slot = Window.partitionBy("_k", "_slot")
    before = F.last(partner, True).over(slot.orderBy("_t").rangeBetween(Window.unboundedPreceding, 0))
    after = F.last(partner, True).over(
        slot.orderBy(F.desc("_t")).rangeBetween(Window.unboundedPreceding, -1)
    )
    spotted = both.withColumns({"_before": before, "_after": after}).filter(C("_a").isNotNull())
    d_before, d_after = C("_t") - C("_before._t"), C("_after._t") - C("_t")
    take_before = d_before.isNotNull() & (d_after.isNull() | (d_before <= d_after))
    return (
        spotted.select(
            C("_a").alias(id_a),
            F.when(take_before, C("_before._b")).otherwise(C("_after._b")).alias(id_b),
            F.when(take_before, d_before).otherwise(d_after).alias("_d"),
        )
        .filter(C("_d") <= step)
        .select(id_a, id_b, (C("_d") / 1_000_000).alias("gap_seconds"))
    )


def session_slots(df: DataFrame, key: str, ts: str, gap_minutes: int = 30) -> DataFrame:
    """First, last and number of events per key and gap-long slot of time.

    Two events of one slot always share a session, so slots can be merged in any
    order (late rows, micro-batches) before sessions are formed.
    """
    gap = gap_minutes * 60_000_000
    micros = F.unix_micros(C(ts).cast("timestamp"))
    return (
        df.filter(C(key).isNotNull())
        .groupBy(key, F.floor(micros / gap).alias("slot"))
        .agg(F.min(ts).alias("first_at"), F.max(ts).alias("last_at"), F.count(F.lit(1)).alias("events"))
    )


def merge_slots(slots: DataFrame, key: str) -> DataFrame:
    return slots.groupBy(key, "slot").agg(
        F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.sum("events").alias("events"))


def stitch_sessions(slots: DataFrame, key: str, gap_minutes: int = 30) -> DataFrame:
    """Sessions from slots: a new one starts after more than ``gap_minutes`` of silence.

    A key has one row per slot of time at most, however many events it has.
    """
    w = Window.partitionBy(key).orderBy("slot")
    lo, hi = (F.unix_micros(C(c).cast("timestamp")) for c in ("first_at", "last_at"))
    marked = slots.withColumns({"_lo": lo, "_hi": hi})
    silence = C("_lo") - F.lag("_hi").over(w)
    is_new = F.coalesce(silence > gap_minutes * 60_000_000, F.lit(True)).cast("int")
    numbered = marked.withColumn("_new", is_new).withColumn(
        "session_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session_no").agg(
        F.min("first_at").alias("started_at"), F.max("last_at").alias("ended_at"),
        F.sum("events").alias("events"), ((F.max("_hi") - F.min("_lo")) / 1_000_000).alias("seconds"))


def sessionize(df: DataFrame, key: str, ts: str, gap_minutes: int = 30) -> DataFrame:
    return stitch_sessions(session_slots(df, key, ts, gap_minutes), key, gap_minutes)


def join_text_id(left: DataFrame, text_id: str, right: DataFrame, key: str, how: str = "inner",
                 salts: int = 16) -> DataFrame:
    """Join a text id to a numeric key; text that is no number matches nothing.

    ``right`` has one row per key.
    """
    number = C(text_id).try_cast("bigint")
    return salted_join(left.withColumn(key, number), right, [key], left.columns, salts, how)


def keep_members(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in ``ids``: a semi join, which Spark broadcasts or splits by the sizes it meets."""
    return df.join(ids.select(key), key, "left_semi")
