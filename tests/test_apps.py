"""Runnable jobs: options, replay -> windows -> exactly-once files, and a
restart that resumes the projected clock from its checkpoint."""

import os
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from hushwin.config import KafkaOut, WindowOptions
from hushwin.operators import clock
from hushwin.sources import streams, tables
from hushwin.streaming import apps, jobs


def _write(path, name, pdf, schema, mtime):
    os.makedirs(path, exist_ok=True)
    f = os.path.join(path, name)
    pq.write_table(pa.Table.from_pandas(pdf, schema=schema, preserve_index=False), f)
    os.utime(f, (mtime, mtime))


TRACE_PA = pa.schema([("shard", pa.int32()), ("seq", pa.int64()), ("p", pa.int64()), ("t", pa.int64()),
                      ("key", pa.int32()), ("value", pa.float64())])
TICKS_PA = pa.schema([("shard", pa.int32()), ("n", pa.int64()), ("tick_ms", pa.int64())])


def test_options_validate():
    with pytest.raises(ValueError):
        WindowOptions(idle_ms=0)
    with pytest.raises(ValueError):
        WindowOptions(lateness_ms=-1)
    with pytest.raises(ValueError):
        KafkaOut(topics=("a",), exactly_once_path="/nowhere")
    with pytest.raises(ValueError):
        apps.run_idle_timeout(None, WindowOptions(idle_ms=5_000))
    assert WindowOptions().size_ms == 10_000 and WindowOptions().idle_ms == 30_000


def test_idle_timeout_job_exactly_once(spark, scratch):
    src = tables.records(spark, "/root/testdata/sf0.001").select("shard", "seq", "p", "t", "key", "value")
    pdf = src.toPandas()
    day = 86_400_000
    now = time.time() - 1000
    for i, (lo, hi) in enumerate([(0, 1_704_500_000_000), (1_704_500_000_000, 10**13)]):
        _write(os.path.join(scratch, "in"), f"{i}.parquet", pdf[(pdf.t >= lo) & (pdf.t < hi)], TRACE_PA, now + i)
    opts = WindowOptions(size_ms=day, lateness_ms=0)
    out = os.path.join(scratch, "out")
    q = apps.run_idle_timeout(spark, opts, source=os.path.join(scratch, "in"), out=KafkaOut(exactly_once_path=out))
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(out).select("key", "window_start_ms", "seq").collect()
    from hushwin.operators import windows
    want = windows.reduce_max_by(tables.records(spark, "/root/testdata/sf0.001"), day)
    last = pdf.t.max() - pdf.t.max() % day   # the last window never closes without later data
    want = {(r.key, r.window_start_ms, r.seq) for r in want.collect() if r.window_start_ms < last}
    assert {(r.key, r.window_start_ms, r.seq) for r in got} == want


def test_clock_resumes_after_restart(spark, scratch):
    reals = tables.decoupled(spark, "/root/testdata/sf0.001").select("shard", "seq", "p", "t", "key", "value")
    ticks = clock.heartbeat_ticks(reals, 300_000)
    expected = {(r.shard, r.seq): (r.s2, r.d) for r in clock.projected_clock(reals, 300_000).collect()}
    rp, tp = reals.toPandas(), ticks.toPandas()
    cut = 20_000_000
    ckpt = os.path.join(scratch, "ckpt")
    now = time.time() - 1000
    for phase, (lo, hi) in enumerate([(0, cut), (cut, 10**13)]):
        _write(os.path.join(scratch, "r"), f"{phase}.parquet", rp[(rp.p >= lo) & (rp.p < hi)], TRACE_PA, now + phase)
        _write(os.path.join(scratch, "k"), f"{phase}.parquet", tp[(tp.tick_ms >= lo) & (tp.tick_ms < hi)],
               TICKS_PA, now + phase)
        rs = streams.replay(spark, os.path.join(scratch, "r"))
        ts = streams.replay(spark, os.path.join(scratch, "k"), streams.TICKS)
        q = jobs.start_idempotent(jobs.project(rs, ts, 300_000), os.path.join(scratch, "out"),
                                  "clock_restart", checkpoint=ckpt)
        q.processAllAvailable()
        q.stop()
    got = {(r.shard, r.seq): (r.s2, r.d) for r in spark.read.parquet(os.path.join(scratch, "out")).collect()}
    assert got == expected


def test_ticks_and_epoch_arrivals_share_an_axis(spark):
    """A real row on an epoch clock, then a tick made 31 s later, in one
    batch: sorted by arrival, the tick moves the row's event time on."""
    from hushwin.streaming.processors import project_batch
    base = 1_704_067_200_000
    reals = spark.createDataFrame([(0, 7, base + 1000, base + 1000, 1, 0.5)], "shard int, seq long, p long, t long, key int, value double")
    ticks = spark.createDataFrame([(0, 1, 30_000, base), (0, 2, 60_000, base + 31_000)], "shard int, n long, tick_ms long, p long")
    pdf = clock.connect(reals, ticks).toPandas().sort_values(["p", "is_real", "seq"])
    s2, *_ = project_batch(pdf["is_real"].to_numpy(bool), pdf["t"].to_numpy(), 0, 0, 90_000)
    assert pdf["is_real"].tolist() == [False, True, False]
    assert s2.tolist() == [30_000, base + 1000, base + 31_000]
