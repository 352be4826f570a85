"""When does each window close, and how long did it wait?

A window ``[s, e)`` on a shard closes at the first arrival whose event time
(for a heartbeat, its projected time) reaches ``e + L``; the running
maximum never needs to be formed, because "the running max reached X" is
the same as "some row so far has time >= X". So the close time is the
least arrival over the shard's rows with ``time >= e + L``: a suffix
minimum over the grid of window ends (``watermark.closing``), which rows
reach through a map-side aggregate. No sort of rows, no as-of join, and a
burst of one shard folds before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hushwin.operators import clock, idle, scan, watermark, windows
from hushwin.plans.stage import stage


def close_latency(df: DataFrame, size_ms: int, lateness_ms: int, keys: Sequence[str] = ("shard", "key")) -> DataFrame:
    """Per (shard, key, window): rows, last arrival, the arrival at which
    the shard's watermark closed the window (``close_ms``, null if it never
    did) and ``delay_ms = close_ms - window_end_ms`` (arrival and event time
    on one clock)."""
    ws, we = watermark.window_of(size_ms)
    groups = (df.select(*keys, "p", ws, we)
                .groupBy(*keys, "window_start_ms", "window_end_ms")
                .agg(F.count(F.lit(1)).alias("n_rows"), F.max("p").alias("last_arrival_ms")))
    ends = watermark.closing(df, size_ms, lateness_ms, ["shard"], F.col("p")).withColumnRenamed("closed", "close_ms")
    return (groups.join(ends, on=["shard", "window_end_ms"], how="left")
                  .select(*keys, "window_start_ms", "window_end_ms", "n_rows", "last_arrival_ms",
                          "close_ms", (F.col("close_ms") - F.col("window_end_ms")).alias("delay_ms")))


def hb_order():
    """Arrival order of a projected trace: a tick goes before a real event at the same instant."""
    return (F.col("p"), F.col("is_real").cast("int").alias("real"), F.col("seq"))


def projected_late_rows(proj: DataFrame, size_ms: int, lateness_ms: int,
                        parts: int | None = None) -> DataFrame:
    """Rows of a projected clock with the shard's watermark input before
    each (``max_before_ms``, over real and heartbeat times), the window
    bounds and ``is_late`` (real rows whose window had already closed)."""
    seen = scan.running_max(proj, ["shard"], hb_order(), "s2", "max_before_ms", inclusive=False, parts=parts)
    ws, we = watermark.window_of(size_ms)
    late = F.col("is_real") & F.coalesce(
        F.col("window_end_ms") <= F.col("max_before_ms") - F.lit(lateness_ms), F.lit(False))
    return seen.select("*", ws, we).withColumn("is_late", late)


def projected_closing(proj: DataFrame, size_ms: int, lateness_ms: int) -> DataFrame:
    """Per shard and window with a real row, the real event or heartbeat
    (``closed``, its arrival key) whose projected time closed it."""
    return watermark.closing(proj, size_ms, lateness_ms, ["shard"], watermark.arrival_key(F.col("is_real")), "s2", F.col("is_real"))


def heartbeat_window_close(reals: DataFrame, size_ms: int, lateness_ms: int, idle_ms: int,
                           keys: Sequence[str] = ("shard", "key"), extra_ticks: int = 0,
                           parts: int | None = None, origin_ms: int | None = 0) -> DataFrame:
    """The heartbeat job on a bounded trace: project event time with
    heartbeats, take the shard's watermark over real and heartbeat times,
    drop real rows whose window had closed, reduce keep-max per key and
    window, and report when each window closed (``close_ms``, the arrival
    at which the projected watermark reached ``end + L``). The heartbeat
    source starts at ``origin_ms`` (null: the day of the least arrival)."""
    if origin_ms is None:
        origin_ms = clock.day_origin(reals)
    # The projected trace is read twice below: stage it once.
    proj = stage(clock.projected_clock(reals, idle_ms, extra_ticks=extra_ticks, parts=parts, origin_ms=origin_ms), "projected")
    ends = projected_closing(proj, size_ms, lateness_ms)
    rows = watermark.with_closing(proj.filter("is_real"), ends, size_ms, ["shard"], watermark.arrival_key(F.col("is_real")))
    # A window of a shard has one closing arrival, so any row's will do.
    out = (rows.filter(~F.col("is_late")).groupBy(*dict.fromkeys(("shard", *keys)), "window_start_ms", "window_end_ms")
               .agg(windows.keep_max_agg().alias("r"), F.max("closed").alias("closed")))
    return out.select(*keys, "window_start_ms", "window_end_ms",
                      *[F.col(f"r.{f}").alias(f) for f in windows.RECORD_FIELDS if f not in keys], watermark.arrival_ms("closed").alias("close_ms"))


NEVER_IDLE_MS = 1 << 60


def heartbeat_combined_replay(reals: DataFrame, size_ms: int, lateness_ms: int, idle_ms: int,
                              grid_ms: int | None = None, extra_ticks: int = 0) -> DataFrame:
    """The heartbeat job with several source shards feeding one window
    operator: each shard projects its own clock, the operator's watermark
    is the minimum over the shards that have started (emitted every
    ``grid_ms``, default one heartbeat interval), and windows are per key
    across shards. Rows whose window closed before their arrival are
    dropped; the rest are reduced keep-max; ``close_ms`` is the emission
    that closed the window.
    """
    proj = stage(clock.projected_clock(reals, idle_ms, extra_ticks=extra_ticks), "projected")
    progress = proj.select("shard", "p", F.col("s2").alias("t"))
    rows = proj.filter(F.col("is_real")).drop("is_real", "s2", "d", "reanchored")
    return idle.idle_timeout_replay(rows, size_ms, grid_ms or idle_ms, NEVER_IDLE_MS, lateness_ms,
                                    progress=progress, reducer="keep_max")


def idle_close_replay(df: DataFrame, size_ms: int, idle_ms: int, lateness_ms: int = 0,
                      key: str = "key", parts: int | None = None) -> DataFrame:
    """The idle-close job on a replay whose processing time is the arrival
    time ``p`` (one row per micro-batch).

    Per key, arrivals form *bursts* separated by gaps of at least
    ``idle_ms``: the key's timer fires at the end of each burst plus
    ``idle_ms`` and closes every open window. A window also closes as soon
    as an arrival of its key has event time ``>= end + L``. A row is late
    when its window has already closed: ``end + L <= max event time
    before it``, or ``end <=`` the end of the window of the largest event
    time of earlier bursts (what the last timer closed). Output per key and
    window: the keep-max record, ``close_ms`` and ``closed_by``.
    """
    if size_ms <= 0 or idle_ms <= 0 or lateness_ms < 0:
        raise ValueError("size and idle must be > 0, lateness >= 0")
    part = [key]
    x = scan.steps(df.select(*dict.fromkeys((key, "key", "value", "p", "seq", "t"))), part, ("p", "seq"), "p",
                   lambda gap: gap >= idle_ms, "_burst", parts=parts)
    # One row per (key, burst), bounded by time span / idle: the largest
    # event time of all earlier bursts.
    wb = Window.partitionBy(key).orderBy("_burst").rowsBetween(Window.unboundedPreceding, -1)
    bursts = (x.groupBy(key, "_burst").agg(F.max("t").alias("_bmax"), F.max("p").alias("_bend"))
               .select(key, "_burst", "_bend", F.max("_bmax").over(wb).alias("_prior")))
    arrival = watermark.arrival_key()
    ends = watermark.closing(df, size_ms, lateness_ms, part, arrival)
    x = watermark.with_closing(x.join(bursts, on=[key, "_burst"], how="inner"), ends, size_ms, part, arrival)
    timed_out = watermark.reached_end(F.col("_prior"), size_ms) + F.lit(size_ms)
    late = F.col("is_late") | F.coalesce(F.col("window_end_ms") <= timed_out, F.lit(False))
    out = (x.filter(~late).groupBy(key, "window_start_ms", "window_end_ms")
             .agg(windows.keep_max_agg().alias("r"),
                  F.min_by("_bend", F.struct("p", "seq")).alias("_first_bend"), F.max("closed").alias("closed"))
             .withColumn("close_ms", watermark.arrival_ms("closed")))
    timer = F.col("_first_bend") + F.lit(idle_ms)
    by_event = F.col("close_ms").isNotNull() & (F.col("close_ms") < timer)
    return (out.select(key, "window_start_ms", "window_end_ms",
                       *[F.col(f"r.{f}").alias(f) for f in windows.RECORD_FIELDS if f != key],
                       F.when(by_event, F.col("close_ms")).otherwise(timer).alias("close_ms"),
                       F.when(by_event, F.lit("event_time")).otherwise(F.lit("idle_timeout")).alias("closed_by")))
