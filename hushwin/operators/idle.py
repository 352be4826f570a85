"""Idle inputs: when a shard goes quiet, and the watermark that ignores it.

A shard is idle once ``idle_ms`` passed since its last arrival, until its
next arrival. The combined watermark of several shards is the minimum over
the shards that are not idle; when every shard is idle it is the maximum
over all of them; it never moves back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hushwin.operators import clock, scan, windows
from hushwin.operators.watermark import first_reached, reached_end, window_of
from hushwin.plans.stage import stage


NO_WATERMARK = -(1 << 62)


def idle_intervals(df: DataFrame, idle_ms: int, shard: str = "shard",
                   parts: int | None = None) -> DataFrame:
    """``(shard, idle_from_ms, idle_to_ms)`` for every quiet gap longer than
    ``idle_ms``; the gap after the last arrival is open (``idle_to_ms``
    null)."""
    if idle_ms <= 0:
        raise ValueError("idle timeout must be > 0")
    r = df.select(F.col(shard).alias("shard"), "p", "seq")
    seen = scan.steps(r, ["shard"], ("p", "seq"), "p", lambda gap: gap, "_sum", "_prev", parts)
    gaps = seen.filter(F.col("p") - F.col("_prev") > idle_ms).select("shard", (F.col("_prev") + idle_ms).alias("idle_from_ms"), F.col("p").alias("idle_to_ms"))
    open_ = r.groupBy("shard").agg((F.max("p") + idle_ms).alias("idle_from_ms")).select("*", F.lit(None).cast("long").alias("idle_to_ms"))
    return gaps.unionByName(open_)


def idle_watermark(df: DataFrame, grid_ms: int, idle_ms: int, lateness_ms: int = 0,
                   shard: str = "shard") -> DataFrame:
    """The combined watermark at the end of every grid cell.

    Output ``grid_start_ms, n_idle, wm_ms``: cell ``[g*G, (g+1)*G)`` of
    arrival time, the shards idle at its end, and the combined watermark
    (``max event time - L - 1`` per shard).

    Rows are first reduced map-side to one summary per (shard, non-empty
    cell); from there on the grid, not the data, sets every size. A shard's
    non-empty cell ``c`` with last arrival ``mp`` stays active through cell
    ``floor((mp + idle) / G) - 1`` and is idle from there to its next
    non-empty cell; before its first cell it is idle with no watermark.
    Those spans explode to one row per (shard, cell), are combined per cell
    (min over active shards, else max over all) and made monotone.
    """
    if grid_ms <= 0 or idle_ms <= 0 or lateness_ms < 0:
        raise ValueError("grid and idle must be > 0, lateness >= 0")
    cells = stage(df.select(F.col(shard).alias("shard"), "p", "t",
                            F.floor(F.col("p") / grid_ms).cast("long").alias("g"))
                    .groupBy("shard", "g").agg(F.max("t").alias("_mt"), F.max("p").alias("_mp")),
                  "idle-cells")
    # The overall grid span: two numbers.
    lo, hi = cells.agg(F.min("g"), F.max("g")).first()
    if lo is None:
        return cells.sparkSession.createDataFrame([], "grid_start_ms long, n_idle int, wm_ms long")
    # Per shard over its non-empty cells (bounded by span / grid): running
    # max of event time and the next non-empty cell.
    w = Window.partitionBy("shard").orderBy("g")
    spans = cells.select(
        "shard", "g", "_mp",
        (F.max("_mt").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.lit(lateness_ms) - 1).alias("_wm"),
        F.lead("g").over(w).alias("_next"),
        F.min("g").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_first"),
        F.lit(lo).cast("long").alias("_lo"))
    spans = spans.withColumn("_to", F.coalesce(F.col("_next") - 1, F.lit(hi).cast("long"))) \
                 .withColumn("_idle_from", F.floor((F.col("_mp") + idle_ms) / grid_ms).cast("long"))
    active = spans.select("shard", F.col("g").alias("_a"), F.least("_to", F.col("_idle_from") - 1).alias("_b"),
                          "_wm", F.lit(False).alias("_idle"))
    quiet = spans.select("shard", F.greatest("g", "_idle_from").alias("_a"), F.col("_to").alias("_b"),
                         "_wm", F.lit(True).alias("_idle"))
    before = spans.filter(F.col("g") == F.col("_first")).select(
        "shard", F.col("_lo").alias("_a"), (F.col("g") - 1).alias("_b"),
        F.lit(None).cast("long").alias("_wm"), F.lit(True).alias("_idle"))
    per = clock._explode_range(active.unionByName(quiet).unionByName(before), "_a", "_b", "g")
    combined = stage(per.groupBy("g").agg(
        F.sum(F.col("_idle").cast("int")).alias("n_idle"),
        F.min(F.when(~F.col("_idle"), F.col("_wm"))).alias("_active"),
        F.max("_wm").alias("_all")).withColumn("_wm", F.coalesce("_active", "_all")),
        "idle-combined")
    # Cells before the first watermark have none; the running maximum keeps it so.
    mono = scan.running_max(combined.withColumn("_wm", F.coalesce("_wm", F.lit(NO_WATERMARK))), [], ["g"], "_wm", "wm_ms")
    mono = mono.withColumn("wm_ms", F.when(F.col("wm_ms") > NO_WATERMARK, F.col("wm_ms")))
    return mono.select((F.col("g") * grid_ms).alias("grid_start_ms"), F.col("n_idle").cast("int").alias("n_idle"),
                       "wm_ms")


def idle_timeout_replay(df: DataFrame, size_ms: int, grid_ms: int, idle_ms: int, lateness_ms: int = 0,
                        keys: tuple[str, ...] = ("key",), shard: str = "shard",
                        progress: DataFrame | None = None, reducer: str = "max_by") -> DataFrame:
    """The idle-timeout job on a replay: one combined watermark (minimum
    over non-idle shards, emitted at the end of every grid cell, the
    periodic emission), rows dropped when their window had closed by the
    emission before their arrival, ``maxBy(value)`` per key and window, and
    the emission at which each window closed (``close_ms``, null if never).

    A row sees the watermark emitted last at or before its arrival's cell
    began, so it is late when its window's closing emission is not after
    that. The emissions, one per grid cell, give every window end its
    closing emission (``watermark.first_reached``); rows join the ends.

    ``progress`` (``shard, p, t``) drives the watermark when it differs
    from the rows (heartbeats); ``reducer`` is ``max_by`` or ``keep_max``.
    """
    if reducer not in ("max_by", "keep_max"):
        raise ValueError("reducer is 'max_by' or 'keep_max'")
    src = df if progress is None else progress
    wm = idle_watermark(src, grid_ms, idle_ms, lateness_ms, shard)
    ws, we = window_of(size_ms)
    emitted = wm.filter(F.col("wm_ms").isNotNull()).select(
        reached_end(F.col("wm_ms") + 1, size_ms).alias("window_end_ms"),
        (F.col("grid_start_ms") + grid_ms).alias("closed"), F.lit(False).alias("held"))
    held = df.select(we, F.lit(None).cast("long").alias("closed"), F.lit(True).alias("held"))
    ends = first_reached(emitted.unionByName(held)).withColumnRenamed("closed", "close_ms")
    rows = df.select("*", ws, we).join(ends, on="window_end_ms", how="left")
    late = F.coalesce(F.col("close_ms") <= reached_end(F.col("p"), grid_ms), F.lit(False))
    out = (rows.filter(~late).groupBy(*keys, "window_start_ms", "window_end_ms")
               .agg((windows.max_by_agg() if reducer == "max_by" else windows.keep_max_agg()).alias("r"),
                    F.max("close_ms").alias("close_ms")))
    return out.select(*keys, "window_start_ms", "window_end_ms",
                      *[F.col(f"r.{f}").alias(f) for f in windows.RECORD_FIELDS if f not in keys], "close_ms")
