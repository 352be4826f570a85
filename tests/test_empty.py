"""Every bounded operator accepts an empty trace and returns no rows."""

from pyspark.sql import functions as F

from hushwin.operators import clock, idle, latency, progress, routing, watermark, windows
from hushwin.sources import tables


def test_empty_inputs(spark):
    empty = tables.jittered(spark, "/root/testdata/sf0.001").filter(F.lit(False))
    cases = {
        "keep_max": windows.reduce_keep_max(empty, 3_600_000),
        "session": windows.session_keep_max(empty, 1_800_000),
        "late_rows": watermark.late_rows(empty, 3_600_000, 0),
        "close_latency": latency.close_latency(empty, 3_600_000, 0),
        "projected_clock": clock.projected_clock(empty, 300_000),
        "heartbeat": latency.heartbeat_window_close(empty, 3_600_000, 0, 300_000),
        "progress": progress.shard_progress(empty, 3_600_000, 0, 300_000),
        "idle_intervals": idle.idle_intervals(empty, 1_200_000),
        "idle_watermark": idle.idle_watermark(empty, 300_000, 1_200_000),
        "idle_close": latency.idle_close_replay(empty, 3_600_000, 1_800_000),
        "round_robin": routing.round_robin(empty, 4),
    }
    for name, df in cases.items():
        assert df.count() == 0, name
