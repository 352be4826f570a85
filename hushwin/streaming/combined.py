"""Windows under one watermark combined from the shards' own clocks.

Spark's watermark is the maximum over its input, so a fast shard drops a
slow one's rows. Here the combined watermark is the minimum over the shards
that are not idle (over all that have started, without a timeout), as
parallel sources feed one window operator:

1. ``shard_summaries``: every Arrow batch of a task becomes one row a
   shard, its latest event and arrival time. No state, no shuffle.
2. ``CombinedClock``: one small state over those summaries. It emits the
   combined event time whenever that advances, with rows that come and,
   through a processing-time timer, when a shard falls idle.
3. Its output is the only column Spark draws the watermark from. Real rows
   carry none, so they neither move it nor are filtered by it.
4. ``ClosingWindows``: per key, the record kept of every open window; event-
   time timers close windows as the watermark passes their ends, and rows
   of closed windows are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import (ExpiredTimerInfo, StatefulProcessor,
                                                      StatefulProcessorHandle, TimerValues)

from hushwin.streaming.jobs import project

REDUCERS = ("max_by", "keep_max")
CLOSED = "key int, window_start_ms long, window_end_ms long, event_time_ms long, value double, seq long"


def shard_summaries(progress: DataFrame) -> DataFrame:
    """(shard, t, p) rows to (shard, t, p) maxima of each batch of a task."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                t = pa.Table.from_batches([batch]).group_by("shard").aggregate([("t", "max"), ("p", "max")])
                yield from t.rename_columns({"t_max": "t", "p_max": "p"}).select(["shard", "t", "p"]).combine_chunks().to_batches()

    return progress.select(F.col("shard").cast("int").alias("shard"), F.col("t").cast("long").alias("t"),
                           F.col("p").cast("long").alias("p")).mapInArrow(run, "shard int, t long, p long")


def combined_time(shards: dict[int, tuple[int, int]], now: int, idle_ms: int | None) -> int | None:
    """The combined event time of ``{shard: (latest event, last arrival)}``:
    the least over the shards heard of within ``idle_ms``, the greatest over
    all if none was."""
    live = [t for t, p in shards.values() if idle_ms is None or now - p <= idle_ms]
    return min(live) if live else max((t for t, _ in shards.values()), default=None)


class CombinedClock(StatefulProcessor):
    """One state over the shards' summaries. Arrival is processing time; on
    a replay (``grid_ms``) it is the row's ``p``, and now is the end of the
    grid cell of the latest arrival."""

    def __init__(self, idle_ms: int | None, grid_ms: int | None = None):
        if idle_ms is not None and idle_ms <= 0 or grid_ms is not None and grid_ms <= 0:
            raise ValueError("idle and grid must be > 0")
        self.idle, self.grid = idle_ms, grid_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.shards = handle.getMapState("shards", "shard int", "t long, p long")
        self.combined = handle.getValueState("combined", "t long")

    def _advanced(self, now: int) -> Iterator[pd.DataFrame]:
        known = {int(k[0]): (int(v[0]), int(v[1])) for k, v in self.shards.iterator()}
        t = combined_time(known, now, self.idle)
        if t is not None and (not self.combined.exists() or t > self.combined.get()[0]):
            self.combined.update((t,))
            yield pd.DataFrame({"t": [t]})
        if self.idle is not None and self.grid is None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            falls = [p + self.idle + 1 for _, p in known.values() if now - p <= self.idle]
            if falls:
                self.handle.registerTimer(min(falls))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        now = 0 if self.grid else timerValues.getCurrentProcessingTimeInMs()
        for pdf in rows:
            for shard, t, p in pdf[["shard", "t", "p"]].itertuples(index=False):
                p = int(p) if self.grid else now
                old = self.shards.getValue((int(shard),)) if self.shards.containsKey((int(shard),)) else (int(t), p)
                self.shards.updateValue((int(shard),), (max(int(t), int(old[0])), max(p, int(old[1]))))
        if self.grid:
            now = (max(int(v[1]) for _, v in self.shards.iterator()) // self.grid + 1) * self.grid
        yield from self._advanced(now)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advanced(timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


class ClosingWindows(StatefulProcessor):
    """Per key and window the kept record, independent of the order rows
    come in: the first arrival, and the best one with the earliest arrival
    among equals. ``keep_max``: the first if its value is NaN, else the
    largest that is not; ``max_by``: the largest, NaN above all."""

    def __init__(self, size_ms: int, reducer: str):
        if size_ms <= 0 or reducer not in REDUCERS:
            raise ValueError(f"size must be > 0, reducer one of {REDUCERS}")
        self.size, self.nan_wins = size_ms, reducer == "max_by"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = "t long, value double, p long, seq long"
        self.first = handle.getMapState("first", "start long", fields)
        self.best = handle.getMapState("best", "start long", fields)

    def _rank(self, r) -> tuple:
        """Greater is kept: by value, then by earlier arrival."""
        nan = math.isnan(r[1])
        return (nan, 0.0 if nan else r[1], -r[2], -r[3])

    def _keep(self, state, start: int, record: tuple, better) -> bool:
        old = tuple(state.getValue((start,))) if state.containsKey((start,)) else None
        if old is None or better(record, old):
            state.updateValue((start,), record)
        return old is None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        if not key[1]:                                  # a step of the combined clock
            return
        watermark = timerValues.getCurrentWatermarkInMs()
        for pdf in rows:
            start = pdf["t"] - pdf["t"] % self.size
            open_ = pdf.assign(start=start)[start + self.size > watermark].sort_values(["p", "seq"], kind="stable").reset_index(drop=True)
            for w, part in open_.groupby("start", sort=False):
                w = int(w)
                record = lambda r: (int(r.t), float(r.value), int(r.p), int(r.seq))
                if self._keep(self.first, w, record(part.iloc[0]), lambda a, b: (a[2], a[3]) < (b[2], b[3])):
                    self.handle.registerTimer(w + self.size)
                able = part if self.nan_wins else part[part["value"].notna()]
                if len(able):
                    nan = able["value"].isna()
                    top = able.loc[nan.idxmax() if nan.any() else able["value"].idxmax()]
                    self._keep(self.best, w, record(top), lambda a, b: self._rank(a) > self._rank(b))
        return
        yield

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        start = expiredTimerInfo.getExpiryTimeInMs() - self.size
        kept = tuple(self.first.getValue((start,)))
        if self.best.containsKey((start,)) and (self.nan_wins or not math.isnan(kept[1])):
            kept = tuple(self.best.getValue((start,)))
        self.first.removeKey((start,))
        self.best.removeKey((start,))
        yield pd.DataFrame({"key": [int(key[0])], "window_start_ms": [start], "window_end_ms": [start + self.size],
                            "event_time_ms": [kept[0]], "value": [kept[1]], "seq": [kept[3]]})

    def close(self) -> None:
        pass


def combined_windows(reals: DataFrame, progress: DataFrame, size_ms: int, lateness_ms: int = 0, idle_ms: int | None = None,
                     reducer: str = "max_by", grid_ms: int | None = None) -> DataFrame:
    """Tumbling windows per key over the streams' rows (``key, seq, p, t,
    value``), closed by the watermark combined from ``progress`` (``shard, t,
    p``): the rows themselves, or their projected clocks."""
    steps = shard_summaries(progress).withColumn("all", F.lit(0)).groupBy("all").transformWithStateInPandas(
        CombinedClock(idle_ms, grid_ms), "t long", "Append", "ProcessingTime" if idle_ms is not None and grid_ms is None else "None")
    none = F.lit(None)
    rows = reals.select(F.col("key").cast("int").alias("key"), F.lit(True).alias("is_row"), "seq", "p", "t", F.col("value").cast("double").alias("value"),
                        none.cast("timestamp").alias("stamp"))
    clock = steps.select(F.lit(0).alias("key"), F.lit(False).alias("is_row"), none.cast("long").alias("seq"), none.cast("long").alias("p"),
                         none.cast("long").alias("t"), none.cast("double").alias("value"), F.timestamp_millis("t").alias("stamp"))
    timed = rows.union(clock).withWatermark("stamp", f"{int(lateness_ms)} milliseconds")
    return timed.groupBy("key", "is_row").transformWithStateInPandas(ClosingWindows(size_ms, reducer), CLOSED, "Append", "EventTime")


def clock_progress(reals: DataFrame, ticks: DataFrame, idle_ms: int) -> DataFrame:
    """``shard, t, p`` of the shards' projected clocks."""
    return project(reals, ticks, idle_ms).select("shard", F.col("s2").alias("t"), "p")
