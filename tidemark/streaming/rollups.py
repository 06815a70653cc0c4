"""Rollups of the request log: the same definition for batch and stream.

A rollup row holds parts that can be merged again: counts and sums as they are,
averages as sum and count, distinct counts and percentiles as sketches. Every
micro-batch appends its parts under its own batch id; a read merges them. There
is no state to keep, late rows just add another part, and a batch that is run
again after a failure overwrites exactly its own folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.scalar import case_chain, ratio

C = F.col


@dataclass(frozen=True)
class Measure:
    """``part`` over raw rows and ``merge`` over parts, as SQL expressions."""

    name: str
    part: str
    merge: str = "sum"

    def collect(self) -> Column:
        return F.expr(self.part).alias(self.name)

    def combine(self) -> Column:
        return F.expr(f"{self.merge}({self.name})").alias(self.name)


def count(name: str, cond: str | None = None) -> Measure:
    return Measure(name, "count(1)" if cond is None else f"count_if({cond})")


def total(name: str, value: str) -> Measure:
    return Measure(name, f"sum({value})")


def distinct(name: str, value: str) -> Measure:
    return Measure(name, f"hll_sketch_agg({value})", "hll_union_agg")


def quantiles(name: str, value: str) -> Measure:
    return Measure(name, f"kll_sketch_agg_bigint(CAST({value} AS BIGINT))", "kll_merge_agg_bigint")


@dataclass(frozen=True)
class Rollup:
    name: str
    grain: str
    keys: tuple[str, ...]
    measures: tuple[Measure, ...]
    where: str | None = None
    derive: tuple[tuple[str, Callable[[], Column]], ...] = ()
    ts: str = "ts"


def stream_pattern(path: str = "path") -> Column:
    """Stream class of a request path."""
    c = C(path)
    rules = [
        (c.startswith("/presentation/master"), "presentation_master"),
        (c.startswith("/presentation/audio"), "presentation_audio"),
        (c.startswith("/presentation/hls"), "presentation_hls"),
        (c.startswith("/hls/lq"), "legacy_lq"), (c.startswith("/hls/hd"), "legacy_hd"),
        (c.startswith("/vod"), "vod_map"), (c.startswith("/subnode/"), "subnode_action"),
        (c.startswith("/thumbs"), "thumbs"), (c.startswith("/subtitles"), "subtitles"),
    ]
    return case_chain(rules, "other")


def rollup(df: DataFrame, spec: Rollup) -> DataFrame:
    """Parts per time bucket and key."""
    rows = df if spec.where is None else df.filter(spec.where)
    for name, expr in spec.derive:
        rows = rows.withColumn(name, expr())
    bucket = F.window(C(spec.ts), spec.grain)
    return (
        rows.groupBy(bucket.alias("_w"), *spec.keys).agg(*[m.collect() for m in spec.measures])
        .select(C("_w.start").alias("bucket"), *spec.keys, *[m.name for m in spec.measures])
    )


def reroll(parts: DataFrame, spec: Rollup, grain: str | None = None, keys: Sequence[str] | None = None) -> DataFrame:
    """Merge parts, optionally to a coarser grain or fewer keys."""
    keys = list(spec.keys if keys is None else keys)
    bucket = F.window("bucket", grain or spec.grain)
    return (
        parts.groupBy(bucket.alias("_w"), *keys).agg(*[m.combine() for m in spec.measures])
        .select(C("_w.start").alias("bucket"), *keys, *[m.name for m in spec.measures])
    )


def readout(merged: DataFrame) -> DataFrame:
    """Turn the known mergeable columns into numbers people read."""
    out = merged
    if "req_time_sum" in out.columns:
        out = out.withColumn("req_time_avg", ratio(C("req_time_sum"), C("requests"), 3))
    if "client_ips" in out.columns:
        out = out.withColumn("client_ips", F.hll_sketch_estimate("client_ips"))
    for sketch, points in (("req_time_kll", (0.5, 0.95, 0.99)), ("rtt_kll", (0.5, 0.95))):
        if sketch in out.columns:
            stem = sketch.removesuffix("_kll")
            out = out.withColumns({
                f"{stem}_p{round(p * 100)}": F.kll_sketch_get_quantile_bigint(sketch, F.lit(p)) for p in points
            }).drop(sketch)
    return out


_TRAFFIC = (count("requests"), total("bytes", "bytes_sent"))
_TIMING = (total("req_time_sum", "req_time_ms"), quantiles("req_time_kll", "req_time_ms"))
_PATTERN = (("pattern", stream_pattern),)

ROLLUPS: dict[str, Rollup] = {
    r.name: r
    for r in (
        Rollup("stats_minute", "1 minute", ("node",),
               (*_TRAFFIC, count("errors", "status >= 400"), *_TIMING)),
        Rollup("country_minute", "1 minute", ("node", "country"),
               (*_TRAFFIC, distinct("client_ips", "client_ip"), *_TIMING)),
        Rollup("isp_minute", "1 minute", ("node", "asn", "asn_org"),
               (*_TRAFFIC, distinct("client_ips", "client_ip"), *_TIMING)),
        Rollup("path_minute", "1 minute", ("node", "base_path"), (*_TRAFFIC, *_TIMING)),
        Rollup("status_minute", "1 minute", ("node", "status"), (count("requests"),)),
        Rollup("ip_minute", "1 minute", ("node", "client_ip"), _TRAFFIC),
        Rollup("file_minute", "1 minute", ("node", "hash"), _TRAFFIC),
        Rollup("user_minute", "1 minute", ("node", "user_id"), _TRAFFIC, "user_id <> 0"),
        Rollup("stall_minute", "1 minute", ("node", "base_path"),
               (count("stalls"), total("bytes_lost", "bytes_expect - bytes_sent"),
                total("stall_ms_sum", "stall_ms")), "is_stalled = 1"),
        Rollup("stream_status_minute", "1 minute", ("node", "pattern", "status"), (count("requests"),),
               derive=_PATTERN),
        Rollup("stream_empty_stub_minute", "1 minute", ("node", "pattern"), (count("requests"),),
               "status = 200 AND body_bytes = 101", _PATTERN),
        Rollup("path_quality", "1 hour", ("node", "asn", "base_path"),
               (*_TRAFFIC, quantiles("rtt_kll", "rtt_us"), total("retrans", "retrans"),
                count("stalls", "is_stall = 1"), count("errors", "status >= 500"),
                count("h3_requests", "proto = 'h3'"))),
        Rollup("bw_user_day", "1 day", ("user_id",), (total("bytes", "bytes_sent"), count("reqs")),
               "user_id <> 0"),
    )
}


# --- streaming ------------------------------------------------------------------------
def append_parts(
    stream: DataFrame, part: Callable[[DataFrame], DataFrame], path: str, checkpoint: str
) -> StreamingQuery:
    """Append the parts of every micro-batch, one folder per run and batch id.

    A run is a checkpoint: a restarted stream goes on in its own folder, a repeated batch overwrites itself, and a stream
    that starts over with a new checkpoint overwrites nothing.
    """
    run = hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def write(batch: DataFrame, batch_id: int) -> None:
        part(batch).write.mode("overwrite").parquet(f"{path}/run={run}/batch_id={batch_id}")

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def start_rollup(stream: DataFrame, spec: Rollup, path: str, checkpoint: str) -> StreamingQuery:
    return append_parts(stream, lambda batch: rollup(batch, spec), path, checkpoint)


def read_parts(spark: SparkSession, path: str, compacted: str | None = None) -> DataFrame:
    """All parts of a stream: what ``compacted`` holds, and the batches written since."""
    parts = spark.read.option("basePath", path).parquet(f"{path}/run=*")
    if compacted is None:
        return parts.drop("run", "batch_id")
    covered = spark.read.parquet(f"{compacted}/covered")  # one row per batch
    fresh = parts.join(covered, ["run", "batch_id"], "left_anti").drop("run", "batch_id")
    return spark.read.parquet(f"{compacted}/rows").unionByName(fresh)


def compact(spark: SparkSession, path: str, merge: Callable[[DataFrame], DataFrame], out: str, before: str | None = None) -> None:
    """Merge the parts written so far (and an earlier compaction) into the new folder ``out``, with the list of batches it covers.

    ``merge`` returns parts again. Readers that are given ``out`` leave the covered batches out, whenever they were written.
    ``out`` is a folder of its own: a reader may hold the parts or the earlier compaction."""
    if out.rstrip("/") in (path.rstrip("/"), (before or "").rstrip("/")):
        raise ValueError("compact into a new folder, not over the one that is read")
    seen = spark.read.option("basePath", path).parquet(f"{path}/run=*").select("run", "batch_id").distinct()
    seen.write.mode("overwrite").parquet(f"{out}/covered")
    covered = spark.read.parquet(f"{out}/covered")
    parts = spark.read.option("basePath", path).parquet(f"{path}/run=*").join(covered, ["run", "batch_id"], "left_semi")
    if before is not None:
        parts = parts.join(spark.read.parquet(f"{before}/covered"), ["run", "batch_id"], "left_anti")
    parts = parts.drop("run", "batch_id")
    if before is not None:
        parts = parts.unionByName(spark.read.parquet(f"{before}/rows"))
    merge(parts).write.mode("overwrite").parquet(f"{out}/rows")


def read_rollup(spark: SparkSession, spec: Rollup, path: str, grain: str | None = None, compacted: str | None = None) -> DataFrame:
    return reroll(read_parts(spark, path, compacted), spec, grain)


def watermarked(df: DataFrame, ts: str, late: str) -> DataFrame:
    """Watermark on a time column; the engine wants the zoned timestamp type (UTC here)."""
    return df.withColumn(ts, C(ts).cast("timestamp")).withWatermark(ts, late)


def windowed_rollup(stream: DataFrame, spec: Rollup, late: str = "5 minutes") -> DataFrame:
    """Stateful variant for append sinks: a bucket is emitted once, when the watermark
    has passed its end. Rows later than ``late`` are left out."""
    return rollup(watermarked(stream, spec.ts, late), spec).withColumn("bucket", C("bucket").cast("timestamp_ntz"))
