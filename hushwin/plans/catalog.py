"""The registered bounded queries: one per operator, over the driver's
tables. Each takes ``(spark, sf_dir)`` and returns a DataFrame whose column
names match the DuckDB oracle in ``hushwin.plans.oracle``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushwin import schema
from hushwin.functions import codec
from hushwin.operators import clock, idle, latency, progress, routing, watermark, windows
from hushwin.sources import tables

# --- Fixed query parameters (shared with the oracle SQL) --------------------
DAY_MS = 86_400_000
HOUR_MS = 3_600_000
REF_WINDOW_MS = 10_000          # the reference's window size
SLIDE_MS = 21_600_000           # 6 h slide for the sliding variant
SESSION_GAP_MS = 1_800_000      # 30 min session gap
# -----------------------------------------------------------------------------

Query = Callable[[SparkSession, str], DataFrame]


def q_tumbling_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = tables.records(spark, sf_dir)
    return windows.tumbling_assign(r.select("seq", "t", "event_time"), REF_WINDOW_MS) \
        .select("seq", "t", "window_start_ms", "window_end_ms") \
        .withColumnRenamed("t", "event_time_ms")


def q_window_reduce_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.reduce_keep_max(tables.records(spark, sf_dir), DAY_MS)


def q_window_reduce_max_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.reduce_keep_max(tables.nan_records(spark, sf_dir), DAY_MS)


def q_window_max_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.reduce_max_by(tables.nan_records(spark, sf_dir), DAY_MS)


def q_sliding_reduce_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.reduce_keep_max(tables.records(spark, sf_dir), DAY_MS, slide_ms=SLIDE_MS)


def q_session_reduce_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.session_keep_max(tables.records(spark, sf_dir), SESSION_GAP_MS)


SINK_TOPICS = ("test-out", "audit")
TOPIC_PATTERN = "c.*|pur.*"
START_MS = 1_705_276_800_000    # 2024-01-15T00:00:00Z
OUT_CHANNELS = 4


def _decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.decode(tables.json_lines(spark, sf_dir))


def _record_cols(df: DataFrame) -> DataFrame:
    return df.select("topic", "seq", F.col("t").alias("event_time_ms"), "key", "value")


def q_json_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _record_cols(codec.good(_decoded(spark, sf_dir)))


def q_json_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.quarantine(_decoded(spark, sf_dir)).select("topic", "seq", "reason")


def q_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = codec.good(_decoded(spark, sf_dir)).select("topic", "seq", "event_time", "key", "value")
    again = codec.decode(codec.encode_records(once).select("topic", "seq", "payload"))
    return _record_cols(codec.good(again))


def q_topic_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = codec.good(_decoded(spark, sf_dir)).select("seq", "event_time", "key", "value")
    out = codec.encode_records(routing.topic_fanout(rec, SINK_TOPICS)).select("topic", "seq", "payload")
    return _record_cols(codec.good(codec.decode(out)))


def q_topic_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.topic_filter(tables.records(spark, sf_dir), TOPIC_PATTERN).select("topic", "seq")


def q_start_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The loader pushes the start instant into the parquet scan; the
    # operator states the rule for any trace.
    r = tables.records(spark, sf_dir, since_ms=START_MS)
    return routing.start_position(r, START_MS).select("seq", F.col("t").alias("event_time_ms"))


def q_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = tables.jittered(spark, sf_dir)
    return routing.round_robin(r, OUT_CHANNELS).select("shard", "seq", "out_partition")


LATE_WINDOW_MS = HOUR_MS        # jittered replay: 1 h windows, 10 min out-of-orderness
LATE_L_MS = 600_000
CLOSE_L_MS = 60_000             # close latency: 1 h windows, 1 min out-of-orderness
HB_IDLE_MS = 300_000            # decoupled replay: heartbeat / idle interval 5 min
HB_WINDOW_MS = HOUR_MS
HB_L_MS = 0
GRID_MS = 300_000               # idle replay: 5 min grid, 20 min idle timeout
IDLE_MS = 1_200_000


def q_bounded_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    wm = watermark.bounded_watermark(tables.jittered(spark, sf_dir), LATE_L_MS)
    return wm.select("shard", "seq", "p", F.col("t").alias("event_time_ms"), "wm_ms")


def q_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lr = watermark.late_rows(tables.jittered(spark, sf_dir), LATE_WINDOW_MS, LATE_L_MS)
    return lr.select("shard", "seq", F.col("t").alias("event_time_ms"), "window_start_ms", "window_end_ms",
                     "max_before_ms", "is_late")


def q_late_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watermark.late_drop(tables.jittered(spark, sf_dir), LATE_WINDOW_MS, LATE_L_MS)


def q_heartbeat_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clock.heartbeat_ticks(tables.decoupled(spark, sf_dir), HB_IDLE_MS).drop("p")


def q_connect_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    reals = tables.decoupled(spark, sf_dir)
    return clock.connect(reals, clock.heartbeat_ticks(reals, HB_IDLE_MS))


def q_drop_heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    reals = tables.decoupled(spark, sf_dir)
    u = clock.connect(reals, clock.heartbeat_ticks(reals, HB_IDLE_MS))
    u = u.withColumn("event_time", F.timestamp_millis("t"))
    return clock.real_only(u).select("shard", "seq", "p", "t")


def q_projected_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    pc = clock.projected_clock(tables.decoupled(spark, sf_dir), HB_IDLE_MS)
    return pc.select("shard", "seq", "p", "is_real", "s2", "d", "reanchored")


def q_heartbeat_window_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latency.heartbeat_window_close(tables.decoupled(spark, sf_dir), HB_WINDOW_MS, HB_L_MS, HB_IDLE_MS)


def q_heartbeat_job_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heartbeat job with the reference's defaults (10 s windows,
    30 s heartbeats, L = 0) over the decoupled replay."""
    return latency.heartbeat_window_close(tables.decoupled(spark, sf_dir), schema.DEFAULT_WINDOW_MS,
                                          schema.DEFAULT_LATENESS_MS, schema.DEFAULT_IDLE_MS)


def q_heartbeat_min_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latency.heartbeat_combined_replay(tables.decoupled(spark, sf_dir), HB_WINDOW_MS, HB_L_MS, HB_IDLE_MS)


def q_heartbeat_epoch_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals on the epoch clock, with a heartbeat source that starts on
    the day of the stream's first arrival: ticks and events share one axis."""
    return latency.heartbeat_window_close(tables.jittered(spark, sf_dir), HB_WINDOW_MS, HB_L_MS, HB_IDLE_MS,
                                          origin_ms=None)


def q_lateness_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.lateness_histogram(tables.jittered(spark, sf_dir), LATE_L_MS)


def q_close_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latency.close_latency(tables.jittered(spark, sf_dir), HOUR_MS, CLOSE_L_MS)


def q_idle_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idle.idle_intervals(tables.idle_fixture(spark, sf_dir), IDLE_MS)


def q_idle_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idle.idle_watermark(tables.idle_fixture(spark, sf_dir), GRID_MS, IDLE_MS)


IDLE_CLOSE_MS = 1_800_000       # idle-close replay: 30 min of silence closes a key's windows


def q_idle_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latency.idle_close_replay(tables.jittered(spark, sf_dir), HOUR_MS, IDLE_CLOSE_MS, 0)


def q_idle_timeout_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idle.idle_timeout_replay(tables.jittered(spark, sf_dir), HOUR_MS, GRID_MS, IDLE_MS)


def q_shard_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.shard_progress(tables.decoupled(spark, sf_dir), HB_WINDOW_MS, HB_L_MS, HB_IDLE_MS)


QUERIES: dict[str, Query] = {
    "tumbling_assign": q_tumbling_assign,
    "window_reduce_max": q_window_reduce_max,
    "window_reduce_max_nan": q_window_reduce_max_nan,
    "window_max_by": q_window_max_by,
    "sliding_reduce_max": q_sliding_reduce_max,
    "session_reduce_max": q_session_reduce_max,
    "json_decode": q_json_decode,
    "json_quarantine": q_json_quarantine,
    "json_roundtrip": q_json_roundtrip,
    "topic_fanout": q_topic_fanout,
    "topic_pattern": q_topic_pattern,
    "start_position": q_start_position,
    "round_robin": q_round_robin,
    "bounded_watermark": q_bounded_watermark,
    "late_rows": q_late_rows,
    "late_drop": q_late_drop,
    "heartbeat_ticks": q_heartbeat_ticks,
    "connect_union": q_connect_union,
    "drop_heartbeats": q_drop_heartbeats,
    "projected_clock": q_projected_clock,
    "heartbeat_window_close": q_heartbeat_window_close,
    "heartbeat_job_defaults": q_heartbeat_job_defaults,
    "heartbeat_min_shards": q_heartbeat_min_shards,
    "heartbeat_epoch_replay": q_heartbeat_epoch_replay,
    "lateness_histogram": q_lateness_histogram,
    "close_latency": q_close_latency,
    "idle_intervals": q_idle_intervals,
    "idle_watermark": q_idle_watermark,
    "idle_timeout_job": q_idle_timeout_job,
    "shard_progress": q_shard_progress,
    "idle_close": q_idle_close,
}

FLAGSHIP = "close_latency"
