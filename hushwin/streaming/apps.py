"""The runnable jobs: source -> windows -> sink.

``run_heartbeat`` and ``run_idle_timeout`` are the two streaming jobs;
either reads keyed JSON from Kafka (``KafkaIn``), a file replay (``path``)
or the deterministic sample stream, and prints or writes to Kafka
(``KafkaOut``, every topic gets the whole stream).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from hushwin.config import KafkaIn, KafkaOut, WindowOptions
from hushwin.functions import codec
from hushwin.schema import DEFAULT_IDLE_MS
from hushwin.sources import kafka, streams
from hushwin.streaming import combined, jobs


def records_from(spark: SparkSession, source: KafkaIn | str | None, opts: WindowOptions) -> DataFrame:
    """A trace stream ``shard, seq, p, t, key, value`` from Kafka (decoded,
    bad records dropped), replayed files, or the sample stream."""
    if isinstance(source, KafkaIn):
        raw = kafka.read_records(spark, kafka.consumer_options(
            source.bootstrap, list(source.topics) if source.topics else None, source.pattern,
            source.offset, source.group_id, source.properties, source.reader), opts.shards)
        return decoded(raw)
    if isinstance(source, str):
        return streams.replay(spark, source)
    return streams.sample_records(spark, opts.shards)


def decoded(raw: DataFrame) -> DataFrame:
    """A trace from raw records. Bad ones are dropped and counted: the job's
    ``jobs.observed`` tells how many (observation ``decode``)."""
    return codec.good(codec.counted(codec.decode(raw))).select("shard", "seq", "p", "t", "key", "value")


def run_sorted_out(spark: SparkSession, source: KafkaIn, path: str, opts: WindowOptions = WindowOptions(),
                   name: str = "sorted-records") -> StreamingQuery:
    """One read of the topic for both the good and the bad records: each is
    written once under ``path``, ``kind=good`` as a trace that the window
    jobs can replay (``sorted_source``), the others with payload, topic,
    partition and offset."""
    raw = kafka.read_records(spark, kafka.consumer_options(
        source.bootstrap, list(source.topics) if source.topics else None, source.pattern,
        source.offset, source.group_id, source.properties, source.reader), opts.shards)
    return jobs.start_sorted_out(raw, path, name, trigger_ms=opts.trigger_ms)


def sorted_source(path: str) -> str:
    """The good records of ``run_sorted_out``, as the ``source`` of a job."""
    return f"{path.rstrip('/')}/batch_id=*/kind={codec.KIND_GOOD}"


def _sink(df: DataFrame, name: str, out: KafkaOut | None, opts: WindowOptions) -> StreamingQuery:
    if out is None:
        return jobs.start(df, name, sink="console", trigger_ms=opts.trigger_ms)
    if out.exactly_once_path:
        return jobs.start_idempotent(df, out.exactly_once_path, name, trigger_ms=opts.trigger_ms)
    rec = df.selectExpr("timestamp_millis(event_time_ms) AS event_time", "key", "value", "window_start_ms")
    return jobs.start_kafka(rec, name, out.topics, kafka.producer_options(out.bootstrap, out.properties),
                            trigger_ms=opts.trigger_ms)


def run_heartbeat(spark: SparkSession, opts: WindowOptions = WindowOptions(),
                  source: KafkaIn | str | None = None, out: KafkaOut | None = None,
                  name: str = "heartbeat-windows") -> StreamingQuery:
    """Heartbeats move event time forward so quiet windows still close. With
    several shards, the watermark is the minimum of their projected clocks
    (tumbling windows; sliding and session ones follow the fastest shard)."""
    reals = records_from(spark, source, opts)
    ticks = streams.heartbeats(spark, opts.idle_ms, opts.shards)
    if opts.shards > 1 and opts.slide_ms is None and opts.session_gap_ms is None:
        win = combined.combined_windows(reals, combined.clock_progress(reals, ticks, opts.idle_ms), opts.size_ms, opts.lateness_ms, None, "keep_max")
    else:
        win = jobs.heartbeat_windows(reals, ticks, opts.size_ms, opts.lateness_ms, opts.idle_ms,
                                     slide_ms=opts.slide_ms, gap_ms=opts.session_gap_ms)
    return _sink(win, name, out, opts)


def run_idle_timeout(spark: SparkSession, opts: WindowOptions = WindowOptions(),
                     source: KafkaIn | str | None = None, out: KafkaOut | None = None,
                     name: str = "idle-timeout-windows") -> StreamingQuery:
    """maxBy per key and window. With several shards, the watermark is
    combined from those that are not idle: a slow, live shard holds it, one
    silent for ``idle_ms`` does not. With one shard, and for sliding and
    session windows, Spark's own watermark follows the fastest partition: no
    idle one can hold it, so an ``idle_ms`` of one's own is refused there
    rather than ignored."""
    if opts.shards > 1 and opts.slide_ms is None and opts.session_gap_ms is None:
        reals = records_from(spark, source, opts)
        win = combined.combined_windows(reals, reals, opts.size_ms, opts.lateness_ms, opts.idle_ms, "max_by")
        return _sink(win, name, out, opts)
    if opts.idle_ms != DEFAULT_IDLE_MS:
        raise ValueError("run_idle_timeout takes no idle_ms where no partition can hold the watermark: one shard, sliding or session windows")
    reals = records_from(spark, source, opts)
    win = jobs.idle_timeout_windows(reals, opts.size_ms, opts.lateness_ms, slide_ms=opts.slide_ms,
                                    gap_ms=opts.session_gap_ms)
    return _sink(win, name, out, opts)


def run_idle_close(spark: SparkSession, opts: WindowOptions = WindowOptions(),
                   source: KafkaIn | str | None = None, out: KafkaOut | None = None,
                   name: str = "idle-close-windows") -> StreamingQuery:
    """No heartbeats: a key's windows close after ``idle_ms`` of silence."""
    reals = records_from(spark, source, opts)
    win = jobs.idle_close_windows(reals, opts.size_ms, opts.idle_ms, opts.lateness_ms)
    return _sink(win, name, out, opts)
