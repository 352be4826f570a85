"""Live sources: file replay, heartbeats, and a deterministic sample stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushwin.schema import DEMO_INTERVAL_MS, DEMO_KEYS

TRACE = T.StructType([
    T.StructField("shard", T.IntegerType()), T.StructField("seq", T.LongType()),
    T.StructField("p", T.LongType()), T.StructField("t", T.LongType()),
    T.StructField("key", T.IntegerType()), T.StructField("value", T.DoubleType()),
])

TICKS = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("n", T.LongType()),
                      T.StructField("tick_ms", T.LongType())])


def replay(spark: SparkSession, path: str, schema: T.StructType = TRACE, fmt: str = "parquet",
           files_per_trigger: int = 1) -> DataFrame:
    """Replay files as a stream, ``files_per_trigger`` files per
    micro-batch, oldest first."""
    return (spark.readStream.format(fmt).schema(schema)
                 .option("maxFilesPerTrigger", files_per_trigger)
                 .option("latestFirst", "false").load(path))


def heartbeats(spark: SparkSession, idle_ms: int, shards: int = 1, rows_per_second: int = 1) -> DataFrame:
    """Wall-clock heartbeats: one tick per ``idle_ms`` per shard, counted
    from the query's checkpointed start, so ticks stay monotone across
    restarts. ``tick_ms = n * idle_ms``, never 0; ``p`` is the instant the
    tick was made, so ticks and records meet on one arrival axis."""
    if idle_ms <= 0 or rows_per_second <= 0:
        raise ValueError("idle interval and rate must be > 0")
    if (idle_ms * rows_per_second) % 1000:
        raise ValueError("idle_ms * rows_per_second must be a whole number of seconds' rows "
                         "(raise rows_per_second for sub-second heartbeats)")
    per_tick = idle_ms * rows_per_second // 1000
    rate = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return _ticks(rate.filter((F.col("value") > 0) & (F.pmod("value", F.lit(per_tick)) == 0))
                      .select((F.col("value") / per_tick).cast("long").alias("n"),
                              F.unix_millis("timestamp").alias("p")), idle_ms, shards)


def stepped_heartbeats(spark: SparkSession, idle_ms: int, shards: int = 1) -> DataFrame:
    """Heartbeats driven by micro-batches instead of the wall clock (tests,
    replays): batch ``b`` carries tick ``b + 1``."""
    rate = (spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1)
                 .option("advanceMillisPerBatch", idle_ms).load())
    return _ticks(rate.select((F.col("value") + 1).alias("n")), idle_ms, shards)


def _ticks(n: DataFrame, idle_ms: int, shards: int) -> DataFrame:
    return n.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "*") \
            .select("shard", "n", (F.col("n") * idle_ms).alias("tick_ms"), *[c for c in n.columns if c != "n"])


def sample_records(spark: SparkSession, shards: int = 1, interval_ms: int = DEMO_INTERVAL_MS) -> DataFrame:
    """A deterministic rare stream for demos: one record per
    ``interval_ms`` of event time per micro-batch, key in 0..9 and value in
    [0, 1) derived from hashes of the sequence number."""
    rate = (spark.readStream.format("rate-micro-batch").option("rowsPerBatch", shards)
                 .option("advanceMillisPerBatch", interval_ms).load())
    t = F.unix_millis("timestamp")
    return rate.select(
        F.pmod(F.col("value"), F.lit(shards)).cast("int").alias("shard"),
        F.col("value").alias("seq"), t.alias("p"), t.alias("t"),
        F.pmod(F.xxhash64("value"), F.lit(DEMO_KEYS)).cast("int").alias("key"),
        (F.pmod(F.xxhash64(F.col("value"), F.lit("v")), F.lit(1 << 30)) / F.lit(float(1 << 30))).alias("value"))
