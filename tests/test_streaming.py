"""Streaming: liveness with heartbeats, the pushed-down filter trap,
streaming = bounded for the projected clock, idle-timeout closing."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from hushwin.operators import clock
from hushwin.sources import streams, tables
from hushwin.streaming import jobs

T0 = 1614556800000  # 2021-03-01T00:00:00Z
WINDOW = 10_000
IDLE = 30_000


def _write_json(path, name, rows, mtime):
    os.makedirs(path, exist_ok=True)
    f = os.path.join(path, name)
    with open(f, "w") as fh:
        for r in rows:
            fh.write(json.dumps(r) + "\n")
    os.utime(f, (mtime, mtime))


def _real(seq, p, t, key=3, value=0.5):
    return {"shard": 0, "seq": seq, "p": p, "t": t, "key": key, "value": value}


def _streams(spark, base):
    for d in ("reals", "ticks"):
        os.makedirs(os.path.join(base, d), exist_ok=True)
    reals = streams.replay(spark, os.path.join(base, "reals"), streams.TRACE, fmt="json")
    ticks = streams.replay(spark, os.path.join(base, "ticks"), streams.TICKS, fmt="json")
    return reals, ticks


def _run(spark, df, name, base, steps, policy="max"):
    q = jobs.start(df, name, sink="memory", checkpoint=os.path.join(base, "ckpt-" + name), policy=policy)
    try:
        for step in steps:
            step()
            q.processAllAvailable()
        q.processAllAvailable()
        return spark.table(name).collect()
    finally:
        q.stop()


def test_quiet_stream_closes_with_heartbeats(spark, scratch):
    now = time.time() - 100
    reals, ticks = _streams(spark, scratch)
    _write_json(os.path.join(scratch, "ticks"), "0.json", [], now)
    out = jobs.heartbeat_windows(reals, ticks, WINDOW, 0, IDLE)
    steps = [
        lambda: _write_json(os.path.join(scratch, "reals"), "0.json", [_real(1, 1000, T0 + 1000)], now + 1),
        lambda: _write_json(os.path.join(scratch, "ticks"), "1.json",
                            [{"shard": 0, "n": 1, "tick_ms": 30_000}, {"shard": 0, "n": 2, "tick_ms": 60_000}],
                            now + 2),
    ]
    rows = _run(spark, out, "hb_live", scratch, steps)
    assert [(r.key, r.window_start_ms, r.window_end_ms, r.value) for r in rows] == [(3, T0, T0 + WINDOW, 0.5)]


def test_quiet_stream_stays_open_without_heartbeats(spark, scratch):
    now = time.time() - 100
    reals, _ = _streams(spark, scratch)
    out = jobs.idle_timeout_windows(reals, WINDOW, 0)
    steps = [lambda: _write_json(os.path.join(scratch, "reals"), "0.json", [_real(1, 1000, T0 + 1000)], now)]
    assert _run(spark, out, "no_hb", scratch, steps) == []


def test_filter_pushed_below_watermark_loses_heartbeats(spark, scratch):
    """Regression for the optimizer trap: a bare is_real filter after
    withWatermark is pushed below it and the window never closes."""
    now = time.time() - 100
    reals, ticks = _streams(spark, scratch)
    _write_json(os.path.join(scratch, "ticks"), "0.json", [], now)
    proj = jobs.project(reals, ticks, IDLE)
    timed = proj.withColumn("event_time", F.timestamp_millis("s2")).withWatermark("event_time", "0 milliseconds")
    naive = timed.filter(F.col("is_real")).groupBy("key", F.window("event_time", "10 seconds")).agg(
        F.max("value").alias("v"))
    steps = [
        lambda: _write_json(os.path.join(scratch, "reals"), "0.json", [_real(1, 1000, T0 + 1000)], now + 1),
        lambda: _write_json(os.path.join(scratch, "ticks"), "1.json",
                            [{"shard": 0, "n": 1, "tick_ms": 30_000}], now + 2),
    ]
    assert _run(spark, naive, "t1_trap", scratch, steps) == []


def test_streaming_clock_equals_bounded(spark, scratch):
    reals = tables.decoupled(spark, "/root/testdata/sf0.001").select("shard", "seq", "p", "t", "key", "value")
    ticks = clock.heartbeat_ticks(reals, 300_000)
    expected = {(r.shard, r.seq): (r.s2, r.d, r.reanchored)
                for r in clock.projected_clock(reals, 300_000).collect()}
    rp, tp = reals.toPandas(), ticks.toPandas()
    edges = [0, 10_000_000, 20_000_000, 30_000_000, 10**12]
    now = time.time() - 1000
    for i in range(len(edges) - 1):
        lo, hi = edges[i], edges[i + 1]
        _write_json(os.path.join(scratch, "reals"), f"{i:03d}.json",
                    rp[(rp.p >= lo) & (rp.p < hi)].to_dict("records"), now + i)
        _write_json(os.path.join(scratch, "ticks"), f"{i:03d}.json",
                    tp[(tp.tick_ms >= lo) & (tp.tick_ms < hi)].to_dict("records"), now + i)
    rs, ts = _streams(spark, scratch)
    rows = _run(spark, jobs.project(rs, ts, 300_000), "clock_stream", scratch, [])
    got = {(r.shard, r.seq): (r.s2, r.d, r.reanchored) for r in rows}
    assert len(got) == len(expected) == len(rp) + len(tp)
    assert got == expected
    from hushwin.operators import progress
    live = progress.live_progress(spark, os.path.join(scratch, "ckpt-clock_stream"))
    want = progress.shard_progress(reals, WINDOW, 0, 300_000).select("shard", "last_projected_ms", "last_offset_ms")
    assert {tuple(r) for r in live.collect()} == {tuple(r) for r in want.collect()}


@pytest.mark.parametrize("gap_events", [False, True])
def test_idle_close(spark, scratch, gap_events):
    now = time.time() - 100
    base = os.path.join(scratch, "reals")
    rows = [_real(1, 1000, T0 + 1000, key=3, value=0.5), _real(2, 2000, T0 + 2000, key=3, value=0.9)]
    if gap_events:
        rows.append(_real(3, 30_000, T0 + 30_000, key=3, value=0.1))
    _write_json(base, "0.json", rows, now)
    src = streams.replay(spark, base, streams.TRACE, fmt="json")
    out = jobs.idle_close_windows(src, WINDOW, idle_ms=1000)
    q = (out.writeStream.format("memory").queryName(f"idle_close_{int(gap_events)}").outputMode("append")
            .option("checkpointLocation", os.path.join(scratch, "ckpt"))
            .trigger(processingTime="300 milliseconds").start())
    try:
        deadline = time.time() + 60
        want = 2 if gap_events else 1
        while time.time() < deadline:
            got = spark.table(f"idle_close_{int(gap_events)}").collect()
            if len(got) >= want:
                break
            time.sleep(0.5)
    finally:
        q.stop()
    got = sorted((r.window_start_ms, r.value, r.seq, r.closed_by) for r in got)
    first = (T0, 0.9, 2, "event_time" if gap_events else "idle_timeout")
    assert got[0] == first
    if gap_events:
        assert got[1] == (T0 + 30_000, 0.1, 3, "idle_timeout")


@pytest.mark.parametrize("policy,closes", [("max", True), ("min", False)])
def test_quiet_input_and_watermark_policy(spark, scratch, policy, closes):
    """Two inputs, one of them quiet: with 'max' the live input closes the
    window, with 'min' the quiet one holds it open."""
    now = time.time() - 100
    live_dir, quiet_dir = os.path.join(scratch, "live"), os.path.join(scratch, "quiet")
    _write_json(quiet_dir, "0.json", [_real(9, 0, T0 + 500, key=5, value=0.1)], now)
    _write_json(live_dir, "0.json", [_real(1, 1000, T0 + 1000)], now)
    live = streams.replay(spark, live_dir, streams.TRACE, fmt="json")
    quiet = streams.replay(spark, quiet_dir, streams.TRACE, fmt="json")
    out = jobs.idle_timeout_windows([live, quiet], WINDOW, 0)
    steps = [lambda: _write_json(live_dir, "1.json", [_real(2, 2000, T0 + 25_000, value=0.2)], now + 1)]
    rows = _run(spark, out, f"policy_{policy}", scratch, steps, policy)
    got = {(r.key, r.window_start_ms) for r in rows}
    assert ((3, T0) in got) == closes


def test_live_sources_drive_heartbeat_job(spark, scratch):
    """Sample records (one per 120 s of event time per batch) and
    micro-batch heartbeats: windows keep closing."""
    reals = streams.sample_records(spark, shards=1)
    ticks = streams.stepped_heartbeats(spark, IDLE, shards=1)
    out = jobs.heartbeat_windows(reals, ticks, WINDOW, 0, IDLE)
    q = (out.writeStream.format("memory").queryName("live_hb").outputMode("append")
            .option("checkpointLocation", os.path.join(scratch, "ckpt"))
            .trigger(processingTime="200 milliseconds").start())
    try:
        deadline = time.time() + 90
        while time.time() < deadline and spark.table("live_hb").count() < 3:
            time.sleep(1)
    finally:
        q.stop()
    rows = spark.table("live_hb").collect()
    assert len(rows) >= 3
    assert all(0 <= r.key < 10 and 0 <= r.value < 1 and r.window_end_ms - r.window_start_ms == WINDOW
               for r in rows)


def test_heartbeat_job_streaming_equals_bounded(spark, scratch):
    from hushwin.operators import latency
    reals = (tables.decoupled(spark, "/root/testdata/sf0.001")
             .withColumn("shard", F.lit(0)).withColumn("p", F.col("seq") * 42_500)
             .select("shard", "seq", "p", "t", "key", "value"))
    idle, size = 300_000, 3_600_000
    bounded = latency.heartbeat_window_close(reals, size, 0, idle)
    lr = latency.projected_late_rows(clock.projected_clock(reals, idle), size, 0)
    touched = {(r.key, r.window_start_ms) for r in lr.filter("is_late").collect()}
    want = {(r.key, r.window_start_ms): r.seq for r in bounded.collect()}
    rp = reals.toPandas()
    tp = clock.heartbeat_ticks(reals, idle).toPandas()
    now = time.time() - 1000
    step = 2_000_000
    for i, lo in enumerate(range(0, int(rp.p.max()) + step, step)):
        _write_json(os.path.join(scratch, "reals"), f"{i:04d}.json",
                    rp[(rp.p >= lo) & (rp.p < lo + step)].to_dict("records"), now + i)
        _write_json(os.path.join(scratch, "ticks"), f"{i:04d}.json",
                    tp[(tp.tick_ms >= lo) & (tp.tick_ms < lo + step)].to_dict("records"), now + i)
    rs, ts = _streams(spark, scratch)
    rows = _run(spark, jobs.heartbeat_windows(rs, ts, size, 0, idle), "hb_equal", scratch, [])
    got = {(r.key, r.window_start_ms): r.seq for r in rows}
    assert len(got) > 100
    for k, seq in got.items():
        if k not in touched:
            assert want.get(k) == seq, k


def test_late_rows_are_counted(spark, scratch):
    now = time.time() - 100
    base = os.path.join(scratch, "reals")
    _write_json(base, "0.json", [_real(1, 1000, T0 + 25_000)], now)
    src = streams.replay(spark, base, streams.TRACE, fmt="json")
    q = jobs.start(jobs.idle_timeout_windows(src, WINDOW, 0), "late_count", sink="memory",
                   checkpoint=os.path.join(scratch, "ckpt"))
    try:
        q.processAllAvailable()
        _write_json(base, "1.json", [_real(2, 2000, T0 + 1000)], now + 1)   # its window closed at 25 s
        q.processAllAvailable()
        assert jobs.dropped_by_watermark(q) == 1
    finally:
        q.stop()


def test_late_rows_are_counted_over_more_batches_than_spark_keeps(spark, scratch):
    now = time.time() - 1000
    base = os.path.join(scratch, "reals")
    _write_json(base, "0.json", [_real(1, 1000, T0 + 25_000)], now)
    src = spark.readStream.schema(streams.TRACE).option("maxFilesPerTrigger", 1).json(base)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    q = None
    try:
        q = jobs.start(jobs.idle_timeout_windows(src, WINDOW, 0), "late_count_long", sink="memory", checkpoint=os.path.join(scratch, "ckpt"))
        q.processAllAvailable()
        late = 110
        for i in range(late):
            _write_json(base, f"{i + 1}.json", [_real(i + 2, 2000, T0 + 1000)], now + i + 1)
        q.processAllAvailable()
        assert len(q.recentProgress) <= 100 and q.lastProgress["batchId"] >= late
        assert jobs.dropped_by_watermark(q) == late
        q.stop()
        assert jobs.dropped_by_watermark(q) == late
        other = jobs.LateRows(q, 100)                 # one that starts to read too late says so
        other.read()
        assert other.missed
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        if q is not None:
            q.stop()


def test_streaming_session_and_sliding_windows(spark, scratch):
    now = time.time() - 100
    base = os.path.join(scratch, "reals")
    _write_json(base, "0.json", [_real(1, 1000, T0 + 1000, value=0.2), _real(2, 3000, T0 + 3000, value=0.7)], now)
    src = streams.replay(spark, base, streams.TRACE, fmt="json")
    sess = jobs.idle_timeout_windows(src, WINDOW, 0, gap_ms=5_000)
    steps = [lambda: _write_json(base, "1.json", [_real(3, 20_000, T0 + 20_000, value=0.1)], now + 1)]
    rows = _run(spark, sess, "sessions", scratch, steps)
    assert [(r.window_start_ms, r.window_end_ms, r.seq) for r in rows] == [(T0 + 1000, T0 + 8000, 2)]
    src2 = streams.replay(spark, base, streams.TRACE, fmt="json")
    slide = jobs.idle_timeout_windows(src2, WINDOW, 0, slide_ms=5_000)
    rows = _run(spark, slide, "sliding", os.path.join(scratch, "b"), [])
    got = sorted((r.window_start_ms, r.seq) for r in rows)
    # rows at 1 s, 3 s and 20 s; the watermark (20 s) closes [-5, 5) and [0, 10) only
    assert got == [(T0 - 5000, 2), (T0, 2)]


def test_console_prints_closed_windows(spark, scratch):
    """The print sink takes the window that a later event closes (the JVM prints it, out of reach of pytest)."""
    now = time.time() - 100
    reals, _ = _streams(spark, scratch)
    _write_json(os.path.join(scratch, "reals"), "0.json", [_real(1, 1000, T0 + 1000, value=0.625)], now)
    _write_json(os.path.join(scratch, "reals"), "1.json", [_real(2, 2000, T0 + 25_000)], now + 1)
    q = jobs.start(jobs.idle_timeout_windows(reals, WINDOW, 0), "printed", sink="console", checkpoint=os.path.join(scratch, "ckpt"))
    try:
        q.processAllAvailable()
        assert q.exception() is None
        sinks = [p["sink"] for p in q.recentProgress]
        assert all("Console" in x["description"] for x in sinks)
        assert sum(max(x["numOutputRows"], 0) for x in sinks) == 1
    finally:
        q.stop()
