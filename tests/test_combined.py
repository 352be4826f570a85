"""Live windows under the watermark combined from several shards: the same
windows as the bounded replays, no row of a slow shard lost, no stall."""

import json
import os
import time

import pytest
from hushwin.config import KafkaOut, WindowOptions
from hushwin.operators import clock, idle, latency
from hushwin.sources import streams
from hushwin.streaming import apps, combined, jobs

GRID, IDLE, SIZE = 10_000, 25_000, 20_000


def write(path, name, rows, mtime):
    os.makedirs(path, exist_ok=True)
    f = os.path.join(path, name)
    with open(f, "w") as out:
        out.writelines(json.dumps(r) + "\n" for r in rows)
    os.utime(f, (mtime, mtime))


def trace():
    """Shard 0 in every cell; shard 1 far behind but live; shard 2 silent for a time; shard 3 starts late."""
    rows, seq = [], 0
    for cell in range(12):
        for shard in range(4):
            if shard == 2 and 3 <= cell < 8 or shard == 3 and cell < 2:
                continue
            for k in range(2):
                p = cell * GRID + 1000 + 2311 * k + 97 * shard
                t = p + 5000 - (shard == 1) * 18_000 - (seq % 5 == 0) * 33_000
                rows.append({"shard": shard, "seq": seq, "p": p, "t": max(t, 0), "key": seq % 3, "value": float((seq * 7) % 11)})
                seq += 1
    return rows


def run(spark, df, name, base, files, folder):
    now = time.time() - 1000
    q = jobs.start(df, name, sink="memory", checkpoint=os.path.join(base, "ckpt-" + name))
    try:
        for i, rows in enumerate(files):
            for d, part in rows.items():
                write(os.path.join(base, d), f"{i:03d}.json", part, now + i)
            q.processAllAvailable()
        q.processAllAvailable()
        got = [tuple(r[c] for c in ("key", "window_start_ms", "window_end_ms", "event_time_ms", "value", "seq")) for r in spark.table(name).collect()]
    finally:
        q.stop()
    assert len({r[:2] for r in got}) == len(got)          # every window once
    return sorted(got)


def closed(df):
    return sorted(tuple(r[c] for c in ("key", "window_start_ms", "window_end_ms", "event_time_ms", "value", "seq"))
                  for r in df.where("close_ms is not null").collect())


def cells(rows):
    return [[r for r in rows if r["p"] // GRID == g] for g in range(max(r["p"] for r in rows) // GRID + 1)]


def test_idle_timeout_replay_equals_the_bounded_job(spark, scratch):
    rows = trace()
    os.makedirs(f"{scratch}/rows")
    live = streams.replay(spark, f"{scratch}/rows", streams.TRACE, fmt="json")
    df = combined.combined_windows(live, live, SIZE, 1000, IDLE, "max_by", grid_ms=GRID)
    got = run(spark, df, "combined_idle", scratch, [{"rows": c} for c in cells(rows)], "rows")
    table = spark.createDataFrame(rows, streams.TRACE)
    want = closed(idle.idle_timeout_replay(table, SIZE, GRID, IDLE, 1000))
    assert got == want and len(want) > 5
    # Without the timeout, the silent shard holds windows for its silence.
    at = lambda idle_ms: {r.close_ms for r in idle.idle_timeout_replay(table, SIZE, GRID, idle_ms, 1000).collect()}
    assert at(IDLE) != at(1 << 40)


def test_heartbeat_minimum_over_shards_equals_the_bounded_job(spark, scratch):
    rows = [r | {"t": r["t"] + 1_000_000} for r in trace()]
    heart = GRID // 2
    table = spark.createDataFrame(rows, streams.TRACE)
    ticks = [{"shard": r.shard, "n": r.n, "tick_ms": r.tick_ms} for r in clock.heartbeat_ticks(table, heart).collect()]
    for d in ("rows", "ticks"):
        os.makedirs(f"{scratch}/{d}")
    live = streams.replay(spark, f"{scratch}/rows", streams.TRACE, fmt="json")
    beats = streams.replay(spark, f"{scratch}/ticks", streams.TICKS, fmt="json")
    df = combined.combined_windows(live, combined.clock_progress(live, beats, heart), SIZE, 0, None, "keep_max", grid_ms=GRID)
    files = [{"rows": c, "ticks": [x for x in ticks if x["tick_ms"] // GRID == g]} for g, c in enumerate(cells(rows))]
    got = run(spark, df, "combined_hb", scratch, files, "rows")
    want = closed(latency.heartbeat_combined_replay(table, SIZE, 0, heart, grid_ms=GRID))
    assert got == want and len(want) > 5


def test_slow_live_shard_loses_nothing_and_a_silent_one_stalls_nothing(spark, scratch):
    """In processing time: shard 1 is 60 s of event time behind and live, shard 2 falls silent."""
    os.makedirs(f"{scratch}/rows")
    live = streams.replay(spark, f"{scratch}/rows", streams.TRACE, fmt="json")
    q = jobs.start(combined.combined_windows(live, live, 10_000, 0, 20_000), "combined_live", sink="memory", checkpoint=f"{scratch}/ckpt")
    seen = lambda: sorted((r.key, r.window_start_ms) for r in spark.table("combined_live").collect())
    row = lambda shard, seq, t: {"shard": shard, "seq": seq, "p": seq, "t": t, "key": shard, "value": 1.0}
    files = iter(range(1000))

    def add(*rows):
        """A file, and a pause in which batches take it (timers in processing time keep batches running)."""
        write(f"{scratch}/rows", f"{next(files):04d}.json", rows, time.time() - 10)
        time.sleep(3)

    try:
        add(row(0, 0, 60_000), row(1, 1, 1_000), row(2, 2, 500))
        add(row(0, 3, 75_000), row(1, 4, 12_000))
        assert seen() == []                                # shard 2 holds all windows
        deadline = time.time() + 120
        while (1, 0) not in seen() and time.time() < deadline:
            add(row(0, 5, 75_000), row(1, 6, 12_000))      # shards 0 and 1 stay live, shard 2 falls silent
        assert seen() == [(1, 0), (2, 0)]                  # shard 1 is slow, and still counts: 60,000 stays open
    finally:
        q.stop()


def test_the_jobs_of_several_shards(spark, scratch):
    """``run_idle_timeout`` takes ``idle_ms`` and ``run_heartbeat`` the minimum of the clocks; with files as sink."""
    rows = [{"shard": s, "seq": 10 * i + s, "p": i, "t": 20_000 * i + 100 * s, "key": s, "value": 1.0} for i in range(4) for s in range(2)]
    write(f"{scratch}/in", "0.json", rows, time.time() - 10)
    spark.read.schema(streams.TRACE).json(f"{scratch}/in").coalesce(1).write.parquet(f"{scratch}/parquet")
    for name, job in (("idle", apps.run_idle_timeout), ("heart", apps.run_heartbeat)):
        out = f"{scratch}/out-{name}"
        q = job(spark, WindowOptions(size_ms=10_000, idle_ms=90_000, shards=2), source=f"{scratch}/parquet", out=KafkaOut(exactly_once_path=out), name=f"several-{name}")
        deadline, got = time.time() + 90, set()
        try:
            while len(got) < 6 and time.time() < deadline:
                time.sleep(2)
                if os.path.isdir(out) and any(f.startswith("batch_id") for f in os.listdir(out)):
                    got = {(r.key, r.window_start_ms) for r in spark.read.schema(combined.CLOSED).parquet(f"{out}/batch_id=*").collect()}
        finally:
            q.stop()
        assert got >= {(s, w) for s in range(2) for w in (0, 20_000, 40_000)}, name


@pytest.mark.parametrize("shards, now, idle_ms, want", [
    ({}, 5, 1, None), ({1: (7, 0)}, 5, None, 7), ({1: (7, 0), 2: (3, 5)}, 5, None, 3), ({1: (7, 5), 2: (3, 0)}, 5, 4, 7),
    ({1: (7, 5), 2: (3, 1)}, 5, 4, 3), ({1: (7, 0), 2: (3, 0)}, 50, 4, 7)])
def test_combined_time(shards, now, idle_ms, want):
    assert combined.combined_time(shards, now, idle_ms) == want


def test_bad_options():
    for args in ((0, None), (5, 0)):
        with pytest.raises(ValueError):
            combined.CombinedClock(*args)
    with pytest.raises(ValueError):
        combined.ClosingWindows(10, "median")
