"""Lateness by the closing arrival equals lateness by the running maximum,
and a heartbeat source may start at any arrival time."""

from pyspark.sql import functions as F

from hushwin.operators import clock, latency, watermark
from hushwin.sources import tables

SF = "/root/testdata/sf0.001"
HOUR = 3_600_000


def _late(df):
    return {(r.shard, r.seq) for r in df.filter("is_late").select("shard", "seq").collect()}


def test_closing_arrival_and_running_maximum_agree(spark):
    df = tables.jittered(spark, "/root/testdata/sf0.01")
    arrival = F.struct("p", "seq")
    for lateness in (0, 1, 600_000):
        ends = watermark.closing(df, HOUR, lateness, ["shard"], arrival)
        seen = watermark.with_closing(df, ends, HOUR, ["shard"], arrival)
        assert seen.count() == df.count()
        want = _late(watermark.late_rows(df, HOUR, lateness))
        assert _late(seen) == want
        assert want


def test_closing_on_a_projected_trace(spark):
    reals = tables.decoupled(spark, SF)
    proj = clock.projected_clock(reals, HOUR).persist()
    ends = latency.projected_closing(proj, HOUR, 60_000)
    seen = watermark.with_closing(proj.filter("is_real"), ends, HOUR, ["shard"], watermark.arrival_key(F.col("is_real")))
    assert _late(seen) == _late(latency.projected_late_rows(proj, HOUR, 60_000))
    proj.unpersist()


def test_equal_arrivals_take_their_sequence(spark):
    df = spark.createDataFrame([(0, 1, 5, 0), (0, 2, 5, 100), (0, 3, 5, 1), (1, 1, 5, 2)], "shard int, seq long, p long, t long")
    arrival = F.struct("p", "seq")
    ends = watermark.closing(df, 10, 0, ["shard"], arrival)
    assert _late(watermark.with_closing(df, ends, 10, ["shard"], arrival)) == {(0, 3)}


def test_origin_moves_arrivals_only(spark):
    """A trace that arrives ``origin`` later, under a source that starts
    there, projects the same times; the ticks follow the span, not the epoch."""
    origin = 1_700_000_000_000
    reals = tables.decoupled(spark, SF)
    moved = reals.withColumn("p", F.col("p") + origin)
    a = clock.projected_clock(reals, HOUR)
    b = clock.projected_clock(moved, HOUR, origin_ms=origin).withColumn("p", F.col("p") - origin)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(a.columns).collect()))
    ticks = clock.heartbeat_ticks(moved, HOUR, origin_ms=origin)
    assert ticks.count() == a.filter("not is_real").count()
    assert ticks.filter(F.col("p") != F.col("tick_ms") + origin).count() == 0


def test_arrival_keys_order_and_give_back_arrivals(spark):
    """Negative and large times, equal instants, heartbeats (negative seq) before rows."""
    rows = [(p, r, q) for p in (-10**17, -1, 0, 5, 1_704_067_200_000, 10**17) for r, q in ((False, -2**62), (False, -1), (True, 0), (True, 2**63 - 1))]
    df = spark.createDataFrame(rows, "p long, real boolean, seq long").withColumn("k", watermark.arrival_key(F.col("real")))
    got = df.orderBy("k").select("p", "real", "seq", watermark.arrival_ms("k").alias("ms")).collect()
    assert [tuple(r)[:3] for r in got] == sorted(rows) and all(r.p == r.ms for r in got)
