"""Rollups and state tables, batch and streaming, with their check SQL."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.catalog.extracts import SESSIONS
from tidemark.catalog.registry import query
from tidemark.operators import recipes as rc
from tidemark.session import scratch_dir
from tidemark.sources import fixtures
from tidemark.sources.fixtures import AS_OF
from tidemark.sources.tables import Tables
from tidemark.streaming import rollups as ro
from tidemark.streaming import state as st
from tidemark.streaming.merge import Merged

C = F.col
MIN = "date_trunc('minute', ts) AS bucket"
TRAFFIC = "COUNT(*) AS requests, CAST(SUM(bytes_sent) AS BIGINT) AS bytes"
TIME = "CAST(SUM(req_time_ms) AS BIGINT) AS req_time_sum, ROUND(CAST(SUM(req_time_ms) AS DOUBLE) / COUNT(*), 3) AS req_time_avg"
PATTERN = """CASE WHEN path LIKE '/presentation/master%' THEN 'presentation_master'
  WHEN path LIKE '/presentation/audio%' THEN 'presentation_audio' WHEN path LIKE '/presentation/hls%' THEN 'presentation_hls'
  WHEN path LIKE '/hls/lq%' THEN 'legacy_lq' WHEN path LIKE '/hls/hd%' THEN 'legacy_hd' WHEN path LIKE '/thumbs%' THEN 'thumbs'
  WHEN path LIKE '/subtitles%' THEN 'subtitles' ELSE 'other' END AS pattern"""
FROM = "FROM fx_requests GROUP BY ALL"
SQL = {
    "stats_minute": f"SELECT {MIN}, node, {TRAFFIC}, COUNT(*) FILTER (status >= 400) AS errors, {TIME} {FROM}",
    "country_minute": f"SELECT {MIN}, node, country, {TRAFFIC}, COUNT(DISTINCT client_ip) AS client_ips, {TIME} {FROM}",
    "isp_minute": f"SELECT {MIN}, node, asn, asn_org, {TRAFFIC}, COUNT(DISTINCT client_ip) AS client_ips, {TIME} {FROM}",
    "path_minute": f"SELECT {MIN}, node, base_path, {TRAFFIC}, {TIME} {FROM}",
    "status_minute": f"SELECT {MIN}, node, status, COUNT(*) AS requests {FROM}",
    "ip_minute": f"SELECT {MIN}, node, client_ip, {TRAFFIC} {FROM}",
    "file_minute": f"SELECT {MIN}, node, hash, {TRAFFIC} {FROM}",
    "user_minute": f"SELECT {MIN}, node, user_id, {TRAFFIC} FROM fx_requests WHERE user_id <> 0 GROUP BY ALL",
    "stall_minute": f"""SELECT {MIN}, node, base_path, COUNT(*) AS stalls,
      CAST(SUM(bytes_expect - bytes_sent) AS BIGINT) AS bytes_lost, CAST(SUM(stall_ms) AS BIGINT) AS stall_ms_sum
      FROM fx_requests WHERE is_stalled = 1 GROUP BY ALL""",
    "stream_status_minute": f"SELECT {MIN}, node, {PATTERN}, status, COUNT(*) AS requests {FROM}",
    "stream_empty_stub_minute": f"""SELECT {MIN}, node, {PATTERN}, COUNT(*) AS requests FROM fx_requests
      WHERE status = 200 AND body_bytes = 101 GROUP BY ALL""",
    "path_quality": f"""SELECT date_trunc('hour', ts) AS bucket, node, asn, base_path, {TRAFFIC},
      CAST(SUM(retrans) AS BIGINT) AS retrans, COUNT(*) FILTER (is_stall = 1) AS stalls,
      COUNT(*) FILTER (status >= 500) AS errors, COUNT(*) FILTER (proto = 'h3') AS h3_requests {FROM}""",
    "bw_user_day": """SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS bucket, user_id,
      CAST(SUM(bytes_sent) AS BIGINT) AS bytes, COUNT(*) AS reqs FROM fx_requests WHERE user_id <> 0 GROUP BY ALL""",
}
IDS = {name: f"ST-{i}" for i, name in enumerate(SQL, 1)}


def exact(df: DataFrame) -> DataFrame:
    """Leave out percentiles, which are approximate; averages come from sum and count."""
    return df.drop(*[c for c in df.columns if "_p" in c and c.rsplit("_p", 1)[1].isdigit()])


def percentile_ranks(t: Tables) -> DataFrame:
    """Whether the merged sketches' round-trip percentiles have the rank they claim, within two percent of the rows."""
    spec = ro.ROLLUPS["path_quality"]
    quantiles = ro.readout(ro.reroll(ro.rollup(t.requests, spec), spec, "1000 days", ["node"])).select("node", "rtt_p50", "rtt_p95")
    ranked = t.requests.join(F.broadcast(quantiles), "node").groupBy("node").agg(
        F.count("*").alias("requests"),
        *[F.count_if(C("rtt_us") < C(f"rtt_p{p}")).alias(f"below{p}") for p in (50, 95)], *[F.count_if(C("rtt_us") <= C(f"rtt_p{p}")).alias(f"upto{p}") for p in (50, 95)])
    close = [((C(f"below{p}") <= C("requests") * (p / 100 + 0.02)) & (C(f"upto{p}") >= C("requests") * (p / 100 - 0.02))).alias(f"p{p}_close") for p in (50, 95)]
    return ranked.select("node", "requests", *close)


def _register(name: str) -> None:
    spec = ro.ROLLUPS[name]
    query(f"rollup_{name}", IDS[name], SQL[name])(lambda t: exact(ro.readout(ro.rollup(t.requests, spec))))


for _name in SQL:
    _register(_name)

query("rollup_merged_to_hour", "ST-20 A-10", f"""SELECT date_trunc('hour', ts) AS bucket, country, {TRAFFIC},
  {TIME} {FROM}""")(
    lambda t: exact(ro.readout(ro.reroll(
        ro.rollup(t.requests, ro.ROLLUPS["country_minute"]), ro.ROLLUPS["country_minute"], "1 hour", ["country"])))
    .drop("client_ips"))
query("rollup_percentiles", "ST-1 ST-12 A-10")(
    lambda t: ro.readout(ro.reroll(
        ro.rollup(t.requests, ro.ROLLUPS["path_quality"]), ro.ROLLUPS["path_quality"], "1 day", ["node"])))
query("rollup_percentile_ranks", "ST-1 ST-12 A-10", """
SELECT node, count(*) AS requests, true AS p50_close, true AS p95_close FROM fx_requests GROUP BY node""")(
    lambda t: percentile_ranks(t))
query("rollup_recent_nodes", "R-9 A-10", f"""m AS (SELECT {MIN}, node, {TRAFFIC},
  COUNT(*) FILTER (status >= 400) AS errors, SUM(req_time_ms) AS rt {FROM})
SELECT bucket, node, requests AS reqs, bytes, errors, ROUND(CAST(rt AS DOUBLE) / requests, 3) AS rt_avg_ms FROM m
WHERE bucket >= TIMESTAMP '2024-01-30 12:00:00' ORDER BY bucket DESC, reqs DESC, node LIMIT 20""")(
    lambda t: rc.recent_node_stats(ro.rollup(t.requests, ro.ROLLUPS["stats_minute"]), AS_OF, 12 * 60))


def node_load(t: Tables) -> DataFrame:
    """Node telemetry stand-in: one reading per request time."""
    return t.requests.select("node", "ts", (C("event_id") % 100).cast("double").alias("load1"))


query("recipe_quality_vs_load", "R-13", f"""m AS (SELECT {MIN}, node, COUNT(*) AS n,
  CAST(COUNT(*) FILTER (status >= 400) AS DOUBLE) / COUNT(*) AS er, AVG(CAST(event_id % 100 AS DOUBLE)) AS load1 {FROM})
SELECT node, COUNT(*) AS minutes, ROUND(corr(er, load1), 9) AS load_corr FROM m GROUP BY node""")(
    lambda t: rc.quality_vs_load(ro.rollup(t.requests, ro.ROLLUPS["stats_minute"]), node_load(t))
    .withColumn("load_corr", F.round("load_corr", 9)))


# --- streams: the same tables kept incrementally --------------------------------------------
def _streamed(t: Tables, source: str, start, name: str, repeats: int = 1) -> DataFrame:
    """What a stream over several files of the source has written once it has caught up."""
    spark = t.events.sparkSession
    stream = fixtures.load_stream(spark, t.location, repeats=repeats)[source]
    path, checkpoint = scratch_dir(spark, name), scratch_dir(spark, f"{name}-progress")
    start(stream, path, checkpoint).awaitTermination()
    return spark.read.parquet(path)


def streamed_rollup(t: Tables, name: str) -> DataFrame:
    spec = ro.ROLLUPS[name]
    parts = _streamed(t, "fx_requests", lambda s, p, c: ro.start_rollup(s, spec, p, c), name)
    return exact(ro.readout(ro.reroll(parts, spec)))


def _register_stream(name: str) -> None:
    query(f"stream_{name}", IDS[name], SQL[name])(lambda t: streamed_rollup(t, name))


for _name in SQL:
    _register_stream(_name)


@query("stream_compacted_rollup", "ST-20", SQL["bw_user_day"])
def compacted_rollup(t: Tables) -> DataFrame:
    """A compaction, the batches of a second run after it, and a compaction on top: readers see every part once."""
    spark, spec = t.events.sparkSession, ro.ROLLUPS["bw_user_day"]
    stream = fixtures.load_stream(spark, t.location)["fx_requests"]
    path, first, second = (scratch_dir(spark, n) for n in ("parts", "compacted", "compacted"))
    halves = [stream.filter(f"event_id % 2 = {i}") for i in (0, 1)]
    ro.start_rollup(halves[0], spec, path, scratch_dir(spark, "progress")).awaitTermination()
    ro.compact(spark, path, lambda p: ro.reroll(p, spec), first)
    ro.start_rollup(halves[1], spec, path, scratch_dir(spark, "progress")).awaitTermination()
    ro.compact(spark, path, lambda p: ro.reroll(p, spec), second, before=first)
    return exact(ro.readout(ro.read_rollup(spark, spec, path, compacted=second)))


def _in_waves(rows: DataFrame, ts: str, waves: int = 3) -> DataFrame:
    """The rows as a stream that brings them in time order, then two rows of user -1 days later, which move the watermark past all
    others: what an append sink has got in the end is everything."""
    spark, inbox = rows.sparkSession, scratch_dir(rows.sparkSession, "waves")
    lo, hi = rows.agg(F.min(ts), F.max(ts)).first()
    if lo is not None:
        cuts = [lo + (hi - lo) * i / waves for i in range(1, waves)]
        for a, b in zip([None, *cuts], [*cuts, None], strict=True):
            late = F.lit(True) if a is None else C(ts) >= F.lit(a)
            rows.filter(late if b is None else late & (C(ts) < F.lit(b))).coalesce(1).write.mode("append").parquet(inbox)
        for days in (3, 6):
            closing = rows.limit(1).withColumns({ts: F.lit(hi + timedelta(days=days)), "user_id": F.lit(-1).cast(rows.schema["user_id"].dataType)})
            closing.write.mode("append").parquet(inbox)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(inbox)


def _appended(stream: DataFrame) -> DataFrame:
    """What an append sink holds once the stream has caught up."""
    spark = stream.sparkSession
    path, progress = scratch_dir(spark, "appended"), scratch_dir(spark, "appended-progress")
    (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", progress)
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(stream.schema).parquet(path)


@query("stream_windowed_sessions", "ST-19 ST-18", """
g AS (SELECT user_id, created_at, CASE WHEN created_at - lag(created_at) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh
  FROM fx_events WHERE user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY created_at, event_id)),
n AS (SELECT user_id, created_at, SUM(fresh) OVER (PARTITION BY user_id ORDER BY created_at) AS session_no FROM g)
SELECT user_id, MIN(created_at) AS started_at, COUNT(*) AS events FROM n GROUP BY user_id, session_no""")
def windowed_sessions(t: Tables) -> DataFrame:
    """Sessions out of state with a watermark: each is appended once, when it can no longer grow."""
    stream = _in_waves(t.events.select("user_id", "created_at"), "created_at")
    return _appended(st.windowed_sessions(stream)).filter("user_id >= 0")


@query("stream_windowed_rollup", "ST-13 ST-18", SQL["bw_user_day"])
def windowed_rollup(t: Tables) -> DataFrame:
    """The rollup out of state with a watermark: a bucket is appended once, when the watermark has passed its end."""
    spec = ro.ROLLUPS["bw_user_day"]
    stream = _in_waves(t.requests.select("ts", "user_id", "bytes_sent"), "ts")
    return exact(ro.readout(_appended(ro.windowed_rollup(stream, spec)).filter("user_id >= 0")))


VID = """v AS (SELECT vid, user_id, row_number() OVER (PARTITION BY vid ORDER BY created_at DESC, event_id DESC) AS rn
  FROM fx_events WHERE user_id IS NOT NULL) SELECT vid, user_id FROM v WHERE rn = 1"""
query("state_vid_map", "ST-14 J-3", VID)(lambda t: st.merge_vid_map(st.vid_map(t.events)))
query("stream_vid_map", "ST-14", VID)(
    lambda t: st.merge_vid_map(_streamed(t, "fx_events", st.start_vid_map, "vid-map")))
STATE = "SELECT user_id, last_event_type, last_event_at FROM fx_subscription_state"
query("state_subscription", "ST-15", STATE)(lambda t: st.subscription_state(t.events))
query("stream_subscription", "ST-15", STATE)(
    lambda t: st.merge_subscription(_streamed(t, "fx_events", st.start_subscription_state, "subscription")))


@query("stream_subscription_table", "ST-15", STATE)
def subscription_table(t: Tables) -> DataFrame:
    """The stored table after a stream over the first half of the events and a restart over the second, with users leaving in place."""
    spark = t.events.sparkSession
    inbox, progress = scratch_dir(spark, "subscription-events"), scratch_dir(spark, "subscribers-progress")
    table = Merged(scratch_dir(spark, "subscribers"), buckets=8)
    events = t.events.select("event_id", "user_id", "created_at", "event_type")
    for half in (C("created_at") < F.lit("2024-01-15").cast("timestamp_ntz"), C("created_at") >= F.lit("2024-01-15").cast("timestamp_ntz")):
        events.filter(half).repartition(2).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(inbox)
        st.start_subscription_table(stream, table, progress).awaitTermination()
    return st.read_subscription_table(spark, table)


query("state_request_errors", "ST-16", """SELECT event_id, status, base_path FROM fx_requests
WHERE status >= 400""")(
    lambda t: st.payment_errors(t.requests.withColumn("is_error", (C("status") >= 500).cast("int")))
    .select("event_id", "status", "base_path"))
query("stream_sessions", "ST-19 W-15", SESSIONS)(
    lambda t: st.read_sessions(_streamed(t, "fx_events", st.start_sessions, "sessions")))
query("stream_request_errors", "ST-16", """SELECT event_id, status, base_path FROM fx_requests
WHERE status >= 400""")(
    lambda t: _streamed(t, "fx_requests", lambda s, p, c: st.start_payment_errors(
        s.withColumn("is_error", (C("status") >= 500).cast("int")), p, c), "request-errors").select("event_id", "status", "base_path"))
# every file is delivered twice; the watermark is wide enough for all repeats
query("stream_dedup", "ST-17", "SELECT event_id, idempotency_key FROM fx_events")(
    lambda t: _streamed(t, "fx_events", lambda s, p, c: st.start_dedup(s, p, c, "60 days"), "dedup", repeats=2)
    .select("event_id", "idempotency_key"))
SKEW = "(event_id % 13 - 9)"
query("state_skew_guard", "ST-18 F-20", f"""
r AS (SELECT event_id, created_at, created_at + {SKEW} * INTERVAL 1 MINUTE AS received_at FROM fx_events)
SELECT event_id, least(created_at, received_at) AS created_at FROM r
WHERE created_at - INTERVAL 5 MINUTE <= received_at""")(
    lambda t: st.with_skew_guard(t.events.withColumn(
        "received_at", C("created_at") + F.make_dt_interval(mins=(C("event_id") % 13 - 9).cast("int"))))
    .select("event_id", C("created_at").cast("timestamp_ntz").alias("created_at")))
