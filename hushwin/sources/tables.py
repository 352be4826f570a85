"""Bounded inputs: the driver's parquet tables and the replay forms derived
from them.

Every loader casts ``TIMESTAMP_NTZ`` to ``TIMESTAMP`` (``withWatermark``
refuses NTZ) and truncates to milliseconds, the reference's event-time unit.
A *trace* is a sharded stream in arrival order, with columns

``shard INT, seq BIGINT, p BIGINT, t BIGINT, event_time TIMESTAMP,
key INT, value DOUBLE, topic STRING``

where ``p`` is the arrival time (ms), ``t`` the event time (ms) and ``seq``
the tie-breaking arrival sequence (the Kafka offset on a real stream). Order
within a shard is ``(p, seq)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

# --- Fixed fixture parameters (see FIXTURES.md) -----------------------------
N_KEYS = 10                   # key = user_id % 10
N_SHARDS = 4                  # shard = event_id % 4
NAN_EVERY = 7                 # value = NaN where event_id % 7 = 0
JITTER_MULT = 7919            # arrival = t + (event_id * 7919) % 4 h
JITTER_SPAN_MS = 14_400_000
DECOUPLED_STEP_MS = 170_000   # arrival = (event_id // 4) * 170 s
# -----------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # NTZ -> TIMESTAMP reads the wall time in the session zone: pin it to UTC,
    # the zone of every time in this package.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _ntz(ms: int):
    """An epoch-ms instant as a TIMESTAMP_NTZ literal value (UTC wall time)."""
    from datetime import datetime, timedelta
    return datetime(1970, 1, 1) + timedelta(milliseconds=int(ms))


def epoch_ms(ts: Column) -> Column:
    """Event time in epoch ms; NTZ values are read as UTC wall time."""
    return F.unix_millis(ts.cast("timestamp"))


def records(spark: SparkSession, sf_dir: str, since_ms: int | None = None) -> DataFrame:
    """``events`` as one in-order shard: arrival = event time.

    ``since_ms`` keeps records with ``t >= since_ms``; it is applied to the
    raw ``ts`` column (``floor(ts / 1 ms) >= X`` exactly when ``ts >= X ms``)
    so the parquet scan can skip row groups.
    """
    ev = table(spark, sf_dir, "events")
    if since_ms is not None:
        ev = ev.filter(F.col("ts") >= F.lit(_ntz(since_ms)))
    t = epoch_ms(F.col("ts"))
    return ev.select(
        F.lit(0).alias("shard"),
        F.col("event_id").alias("seq"),
        t.alias("p"),
        t.alias("t"),
        F.timestamp_millis(t).alias("event_time"),
        F.pmod(F.col("user_id"), F.lit(N_KEYS)).cast("int").alias("key"),
        F.col("value"),
        F.col("event_type").alias("topic"),
    )


def nan_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``records`` with NaN values on every seventh event."""
    r = records(spark, sf_dir)
    return r.withColumn(
        "value", F.when(F.pmod("seq", F.lit(NAN_EVERY)) == 0, F.lit(float("nan"))).otherwise(F.col("value")))


def sharded(df: DataFrame, shards: int = N_SHARDS) -> DataFrame:
    return df.withColumn("shard", F.pmod("seq", F.lit(shards)).cast("int"))


def jittered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four shards; each row arrives up to 4 h after its event time, so
    arrival order and event-time order disagree (late rows exist)."""
    r = sharded(records(spark, sf_dir))
    return r.withColumn("p", F.col("t") + F.pmod(F.col("seq") * JITTER_MULT, F.lit(JITTER_SPAN_MS)))


def decoupled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four shards whose arrival clock starts at 0 and runs at its own pace
    (one row per 170 s per shard), unrelated to event time."""
    r = sharded(records(spark, sf_dir))
    return r.withColumn("p", F.floor(F.col("seq") / N_SHARDS) * DECOUPLED_STEP_MS)


def idle_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four shards arriving at event time: quiet gaps make shards idle."""
    return sharded(records(spark, sf_dir))


# Corruption kinds of the JSON fixture, by seq % 10 (fixed, see FIXTURES.md §3):
# 0 no eventTime; 1 eventTime only (defaults apply); 2 not JSON;
# 3 unparsable time; 4 string value; 5-9 complete records.
JSON_KINDS = 10


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as keyed JSON messages ``(topic, seq, payload BINARY)``,
    with malformed and partial records mixed in."""
    from hushwin.functions import codec
    r = records(spark, sf_dir)
    kind = F.pmod(F.col("seq"), F.lit(JSON_KINDS))
    text = (F.when(kind == 0, F.to_json(F.struct("key", "value")))
             .when(kind == 1, F.to_json(F.struct(F.col("event_time").alias("eventTime")),
                                        codec.ENCODE_OPTIONS))
             .when(kind == 2, F.concat(F.lit("not json "), F.col("seq").cast("string")))
             .when(kind == 3, F.to_json(F.struct(F.lit("bad").alias("eventTime"), "key", "value")))
             .when(kind == 4, F.to_json(F.struct(F.col("event_time").alias("eventTime"), "key",
                                                 F.lit("x").alias("value")), codec.ENCODE_OPTIONS))
             .otherwise(F.to_json(F.struct(F.col("event_time").alias("eventTime"), "key", "value"),
                                  codec.ENCODE_OPTIONS)))
    return r.select("topic", "seq", "p", F.encode(text, "UTF-8").alias("payload"))
