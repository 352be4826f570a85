"""Per-shard progress of the projected clock, made visible."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushwin.operators import clock, latency, scan, watermark
from hushwin.plans.stage import stage


def shard_progress(reals: DataFrame, size_ms: int, lateness_ms: int, idle_ms: int,
                   extra_ticks: int = 0) -> DataFrame:
    """Per shard: real rows, heartbeats, re-anchors, real rows dropped as
    late by the projected watermark, the largest event time, and the
    projected time and offset after the last row."""
    proj = stage(clock.projected_clock(reals, idle_ms, extra_ticks=extra_ticks), "projected")
    rows = watermark.with_closing(proj, latency.projected_closing(proj, size_ms, lateness_ms), size_ms, ["shard"],
                                  watermark.arrival_key(F.col("is_real")))
    last = F.max_by(F.struct("s2", "d"), F.struct(*latency.hb_order()))
    agg = rows.groupBy("shard").agg(
        F.sum(F.col("is_real").cast("long")).alias("n_real"),
        F.sum((~F.col("is_real")).cast("long")).alias("n_tick"),
        F.sum(F.col("reanchored").cast("long")).alias("n_reanchored"),
        F.sum((F.col("is_real") & F.col("is_late")).cast("long")).alias("n_late"),
        F.max(F.when(F.col("is_real"), F.col("t"))).alias("max_event_ms"),
        last.alias("_last"))
    return agg.select("shard", "n_real", "n_tick", "n_reanchored", "n_late", "max_event_ms",
                      F.col("_last.s2").alias("last_projected_ms"), F.col("_last.d").alias("last_offset_ms"))


def lateness_histogram(df: DataFrame, class_ms: int, shard: str = "shard", parts: int | None = None) -> DataFrame:
    """Per shard, how far rows arrive behind the largest event time before
    them: ``late_from_ms`` (multiples of ``class_ms``; 0 holds the rows that
    are not behind) and ``n_rows``. It says which lateness L a shard needs."""
    if class_ms <= 0:
        raise ValueError("class width must be > 0")
    seen = scan.running_max(df.select(shard, "p", "seq", "t"), [shard], ("p", "seq"), "t", "_before", inclusive=False, parts=parts)
    behind = F.greatest(F.coalesce(F.col("_before") - F.col("t"), F.lit(0)), F.lit(0))
    return (seen.select(F.col(shard).alias("shard"), (behind - F.pmod(behind, F.lit(int(class_ms)))).alias("late_from_ms"))
            .groupBy("shard", "late_from_ms").agg(F.count(F.lit(1)).alias("n_rows")))


def live_progress(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Per shard, the projected time and offset that a running (or stopped)
    heartbeat job has reached, read from its checkpoint's last finished
    batch: ``shard, last_projected_ms, last_offset_ms``. The job is not
    disturbed; only the state of the clock is read."""
    steps = (spark.read.format("state-metadata").load(checkpoint)
             .where(F.col("operatorName").startswith("transformWithState") & F.col("operatorProperties").contains('"clock"'))
             .select("operatorId").distinct().limit(2).collect())
    if len(steps) != 1:
        raise ValueError(f"{len(steps)} projected clocks in the checkpoint, one is needed")
    state = (spark.read.format("statestore").option("operatorId", steps[0].operatorId)
             .option("stateVarName", "clock").load(checkpoint))
    return state.select(F.col("key.shard").alias("shard"), F.col("value.s2").alias("last_projected_ms"),
                        F.col("value.d").alias("last_offset_ms"))
