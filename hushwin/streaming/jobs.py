"""Streaming jobs and sinks.

* ``heartbeat_windows``: real records and heartbeats, unioned; the
  projected clock (``transformWithStateInPandas``); a watermark on the
  projected time; heartbeats dropped *after* the watermark; keep-max per key
  and tumbling window (append mode).
* ``idle_timeout_windows``: the watermark job without heartbeats: Spark's
  watermark is the maximum over all input partitions, so an idle partition
  never holds it back; ``maxBy(value)`` per key and window.
* ``idle_close_windows``: no heartbeats at all; per-key state closes a
  window when the key's own event time passes its end, or after
  ``idle_ms`` of processing time without input.
"""

from __future__ import annotations

import threading
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hushwin.functions import codec
from hushwin.operators import clock, routing, windows
from hushwin.session import STATE_STORE, checkpoint_path
from hushwin.sources import kafka
from hushwin.streaming.processors import CLOCK_OUT, WINDOW_OUT, IdleClose, ProjectedClock


def _window_rows(agg: DataFrame, keys: Sequence[str]) -> DataFrame:
    return agg.select(*keys, *windows.bounds_ms(),
                      *[F.col(f"r.{f}").alias(f) for f in windows.RECORD_FIELDS if f not in keys])


def project(reals: DataFrame, ticks: DataFrame, idle_ms: int) -> DataFrame:
    """Stamp every real row and heartbeat of a stream with the shard's
    projected time ``s2`` (state: two longs per shard, checkpointed)."""
    u = clock.connect(reals, ticks)
    return u.groupBy("shard").transformWithStateInPandas(
        ProjectedClock(idle_ms), CLOCK_OUT, "Append", "None")


def heartbeat_windows(reals: DataFrame, ticks: DataFrame, size_ms: int, lateness_ms: int,
                      idle_ms: int, keys: Sequence[str] = ("key",), slide_ms: int | None = None,
                      gap_ms: int | None = None) -> DataFrame:
    """The heartbeat job: windows close ``idle_ms``-periodically even when
    real messages are rare. Tumbling by default; sliding with ``slide_ms``,
    sessions with ``gap_ms``."""
    proj = project(reals, ticks, idle_ms)
    timed = proj.withColumn("event_time", F.timestamp_millis("s2")) \
                .withWatermark("event_time", f"{int(lateness_ms)} milliseconds")
    real = clock.real_only(timed)
    agg = real.groupBy(*keys, windows.stream_window(size_ms, slide_ms, gap_ms).alias("window")).agg(
        windows.keep_max_agg().alias("r"))
    return _window_rows(agg, keys)


def watermarked_union(inputs: Sequence[DataFrame], lateness_ms: int) -> DataFrame:
    """Several inputs, each with its own watermark, as one stream. How Spark
    combines these is fixed when the query starts (``start(policy=...)``)."""
    if not inputs:
        raise ValueError("at least one input is needed")
    timed = [i.withColumn("event_time", F.timestamp_millis("t"))
              .withWatermark("event_time", f"{int(lateness_ms)} milliseconds") for i in inputs]
    out = timed[0]
    for t in timed[1:]:
        out = out.unionByName(t)
    return out


def idle_timeout_windows(reals: DataFrame | Sequence[DataFrame], size_ms: int, lateness_ms: int,
                         keys: Sequence[str] = ("key",), slide_ms: int | None = None,
                         gap_ms: int | None = None) -> DataFrame:
    """The idle-timeout job: within one input the watermark is the maximum
    over all its partitions, so an idle partition never holds it back;
    several inputs combine by the policy the query starts with. maxBy value."""
    timed = watermarked_union([reals] if isinstance(reals, DataFrame) else list(reals), lateness_ms)
    agg = timed.groupBy(*keys, windows.stream_window(size_ms, slide_ms, gap_ms).alias("window")).agg(
        windows.max_by_agg().alias("r"))
    return _window_rows(agg, keys)


def idle_close_windows(reals: DataFrame, size_ms: int, idle_ms: int, lateness_ms: int = 0) -> DataFrame:
    """Windows per key closed by the key's event time or by ``idle_ms`` of
    processing-time silence (``closed_by`` says which)."""
    return reals.select("key", "seq", "p", "t", "value").groupBy("key").transformWithStateInPandas(
        IdleClose(size_ms, idle_ms, lateness_ms), WINDOW_OUT, "Append", "ProcessingTime")


class LateRows:
    """What one run of a query dropped as late, and what its observations
    counted, over all its batches. Spark keeps a run's last reports only, so
    a thread takes each as it comes (a Python listener would do so through a
    server of its own). A run is forgotten when ``forget`` is called."""

    POLL_S = 1.0
    runs: dict[str, LateRows] = {}

    def __init__(self, query: StreamingQuery, kept: int):
        self.query, self.kept = query, kept
        self.total, self.last, self.missed = 0, None, False
        self.observed: Counter = Counter()
        self.lock = threading.Lock()

    @classmethod
    def of(cls, query: StreamingQuery, kept: int = 100) -> LateRows:
        return cls.runs.setdefault(str(query.runId), cls(query, kept))

    @classmethod
    def watched(cls, query: StreamingQuery, spark) -> StreamingQuery:
        count = cls.of(query, int(spark.conf.get("spark.sql.streaming.numRecentProgressUpdates", "100")))
        threading.Thread(target=count._watch, name=f"late-rows-{query.runId}", daemon=True).start()
        return query

    def _watch(self) -> None:
        try:
            pause = threading.Event()
            while self.query.isActive:
                if self.read() <= self.kept // 4:
                    pause.wait(self.POLL_S)
            self.read()
        except Exception:                             # the session is gone; a caller's own read says so
            return

    def read(self) -> int:
        """Takes the reports not seen yet; how many there were. Each batch
        reports once when done; reports between batches count no rows."""
        with self.lock:
            newest = self.query.lastProgress
            if newest is None or self._key(newest) == self.last:
                return 0
            new = [newest]
            if self.last is None or newest["batchId"] != self.last[0] + 1:
                new = list(self.query.recentProgress)
                keys = [self._key(r) for r in new]
                if self.last in keys:
                    new = new[keys.index(self.last) + 1:]
                elif self.last is not None:
                    self.missed |= new[0]["batchId"] > self.last[0] + 1
                else:
                    self.missed |= len(new) >= self.kept - 1     # Spark keeps one less than it is told
            for report in new:
                self.total += sum(int(op.get("numRowsDroppedByWatermark", 0)) for op in report.get("stateOperators", []))
                for name, row in (report.get("observedMetrics") or {}).items():
                    self.observed.update({(name, field): n for field, n in row.asDict().items()})
            self.last = self._key(new[-1]) if new else self.last
            return len(new)

    @staticmethod
    def _key(report) -> tuple:
        return report["batchId"], report["timestamp"]


def dropped_by_watermark(query: StreamingQuery) -> int:
    """Rows the query's stateful operators dropped as late, since this run of
    it started (Spark filters with the previous batch's watermark, so a row
    late by less than one batch is still aggregated). Raises if reports were
    lost, as of a query that was not started here and has run for long."""
    count = LateRows.of(query)
    count.read()
    if count.missed:
        raise RuntimeError("some progress reports were gone before they were read: no full count of late rows")
    return count.total


def observed(query: StreamingQuery) -> dict[tuple[str, str], int]:
    """``{(observation, field): count}`` over all batches of this run: what
    its decode and encode steps let through and dropped. A batch that failed
    and ran again counts once, when it is done."""
    count = LateRows.of(query)
    count.read()
    if count.missed:
        raise RuntimeError("some progress reports were gone before they were read: no full counts")
    return dict(count.observed)


def forget(query: StreamingQuery) -> None:
    """Lets go of the counts of a run that has ended."""
    LateRows.runs.pop(str(query.runId), None)


# --- sinks --------------------------------------------------------------------

POLICIES = ("min", "max")
_STARTING = threading.Lock()


def _start(writer, spark: SparkSession, name: str, trigger_ms: int | None, checkpoint: str | None,
           policy: str = "max") -> StreamingQuery:
    """Start a query with the settings it reads as it starts: the state store
    of custom state, and how several inputs' watermarks combine. The session
    gets its own back, as the query has a copy."""
    if policy not in POLICIES:
        raise ValueError(f"policy is one of {POLICIES}")
    w = writer.queryName(name).option("checkpointLocation", checkpoint or checkpoint_path(spark, name))
    if trigger_ms:
        w = w.trigger(processingTime=f"{int(trigger_ms)} milliseconds")
    wanted = {"spark.sql.streaming.stateStore.providerClass": STATE_STORE,
              "spark.sql.streaming.multipleWatermarkPolicy": policy}
    with _STARTING:
        before = {k: spark.conf.get(k, None) for k in wanted}
        try:
            for k, v in wanted.items():
                spark.conf.set(k, v)
            query = w.start()
        finally:
            for k, v in before.items():
                spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return LateRows.watched(query, spark)


def start(df: DataFrame, name: str, sink: str = "console", trigger_ms: int | None = None,
          checkpoint: str | None = None, output_mode: str = "append", policy: str = "max") -> StreamingQuery:
    """Start a query on ``console`` (print), ``memory`` (tests) or any
    other sink format; state and offsets go to the checkpoint folder.

    Where inputs have watermarks of their own, Spark combines these with
    ``policy``: ``min`` waits for the slowest input, so a quiet one stalls
    every window; ``max`` follows the fastest, so a quiet input cannot hold
    windows open (but a slow, live one may see its rows dropped as late)."""
    return _start(df.writeStream.format(sink).outputMode(output_mode), df.sparkSession, name, trigger_ms, checkpoint, policy)


def start_idempotent(df: DataFrame, path: str, name: str, trigger_ms: int | None = None,
                     checkpoint: str | None = None, partition: Sequence[str] = (), policy: str = "max") -> StreamingQuery:
    """Exactly-once output: each micro-batch replaces its own
    ``batch_id=N`` folder, so a batch replayed after a failure overwrites
    instead of duplicating."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy(*partition).parquet(f"{path.rstrip('/')}/batch_id={batch_id}")

    return _start(df.writeStream.foreachBatch(write), df.sparkSession, name, trigger_ms, checkpoint, policy)


def start_sorted_out(raw: DataFrame, path: str, name: str, trigger_ms: int | None = None,
                     checkpoint: str | None = None) -> StreamingQuery:
    """One read of a topic, every record in one place: ``kind=good``
    (decoded, defaults applied), or under the reason it is none, with its
    payload. One write a batch, exactly once; ``observed`` counts the kinds."""
    return start_idempotent(codec.sorted_out(codec.decode(raw)), path, name, trigger_ms, checkpoint, ("kind",))


def payload(df: DataFrame, name: str, topics: Sequence[str] | None = None) -> DataFrame:
    """What a job writes to its topics: ``topic, value, headers``, the whole
    stream to each. Records that cannot be encoded are counted
    (``observed``: ``encode``) and dropped. A window's record carries an id
    by which ``kafka.once`` knows a second copy."""
    counted = df.observe("encode", F.count_if(codec.encodable()).alias("written"), F.count_if(~codec.encodable()).alias("dropped"))
    return kafka.kafka_payload(routing.topic_fanout(counted, kafka.sink_topics(topics)), name)


def start_kafka(df: DataFrame, name: str, topics: Sequence[str] | None = None,
                options: dict | None = None, checkpoint: str | None = None,
                trigger_ms: int | None = None) -> StreamingQuery:
    """Every producer topic gets the whole stream: fan out on a ``topic``
    column and let one Kafka sink route it. A batch replayed after a failure
    is written twice; readers that want each record once use ``kafka.once``."""
    out = payload(df, name, topics)
    return _start(out.writeStream.format("kafka").options(**(options or kafka.producer_options())),
                  df.sparkSession, name, trigger_ms, checkpoint)
