"""The projected clock: golden trace, the bounded operator against a
row-by-row fold on random traces, and the composition of its maps."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hushwin.operators import clock

T = 1614556800000
I = 30_000


def _reals(spark, rows):
    return spark.createDataFrame(
        [(0, seq, p, t, 3, 0.5) for seq, p, t in rows],
        "shard int, seq long, p long, t long, key int, value double")


def two_long_fold(reals, idle, n_ticks):
    """The rule of the clock, (offset, projected time), walked row by row
    over the merged trace (a tick first at the same instant)."""
    events = [(p, 1, seq, t) for seq, p, t in reals] + [(n * idle, 0, -n, n * idle) for n in range(1, n_ticks + 1)]
    d = s2 = 0
    out = {}
    for p, real, seq, t in sorted(events):
        if not real:
            s2 = d + t
        else:
            if abs(t - s2) >= 3 * idle:
                d += t - s2
            s2 = t
        out[seq] = (s2, d)
    return out


def test_golden_trace(spark):
    # arrival time p on the heartbeat clock; ticks at 30 s, 60 s, 90 s, 120 s
    reals = _reals(spark, [(1, 0, T + 1000), (2, 65_000, T + 100_000), (3, 95_000, T + 181_000)])
    got = {r.seq: (r.s2, r.d, r.reanchored)
           for r in clock.projected_clock(reals, I, extra_ticks=1).collect()}
    assert got == {
        1: (T + 1000, T + 1000, 1),       # first event re-anchors from 0
        -1: (T + 31_000, T + 1000, 0),
        -2: (T + 61_000, T + 1000, 0),
        2: (T + 100_000, T + 1000, 0),    # gap 39 s < 3I: no re-anchor
        -3: (T + 91_000, T + 1000, 0),    # steps back
        3: (T + 181_000, T + 91_000, 1),  # gap exactly 3I re-anchors
        -4: (T + 211_000, T + 91_000, 0),
    }


def test_rejects_zero_interval(spark):
    with pytest.raises(ValueError):
        clock.projected_clock(_reals(spark, [(1, 0, T)]), 0)


@settings(max_examples=6, deadline=None)
@given(st.integers(min_value=0, max_value=10**6), st.sampled_from([1, 5]))
def test_matches_row_by_row_fold(spark, seed, parts):
    rnd = random.Random(seed)
    rows, p, t = [], 0, T
    for seq in range(rnd.randint(1, 60)):
        p += rnd.choice([0, 1, 5_000, 29_999, 30_000, 45_000, 120_000])
        t += rnd.choice([-100_000, -90_000, -89_999, 0, 10, 30_000, 89_999, 90_000, 400_000])
        rows.append((seq, p, t))
    expected = two_long_fold(rows, I, p // I + 2)
    got = {r.seq: (r.s2, r.d)
           for r in clock.projected_clock(_reals(spark, rows), I, extra_ticks=2, parts=parts).collect()}
    assert got == expected


intervals = st.lists(st.tuples(st.integers(1, 4), st.integers(-60, 60), st.integers(-50, 50)), min_size=1, max_size=25)


def _apply(chunk, d):
    los, his, outside, shift = chunk
    return next((c for lo, hi, c in zip(los, his, outside) if not lo < d < hi), d + shift)


@settings(max_examples=500, deadline=None)
@given(intervals, st.lists(st.integers(-200, 200), min_size=1, max_size=30), st.integers(0, 25))
def test_composed_maps_walk_alike(steps, starts, cut):
    """The composed map gives every start the offset that walking gives it, and composing is associative."""
    idle, n, ns, t1s, js = 10, 0, [], [], []
    for gap, t1, j in steps:
        n += gap
        ns.append(n)
        t1s.append(n * idle + t1)
        js.append(j)
    whole = clock.compose(ns, t1s, js, idle)
    a, b = (clock.compose(ns[x], t1s[x], js[x], idle) for x in (slice(0, cut), slice(cut, None)))
    for d in starts:
        end = clock.walk(ns, t1s, js, d, idle)[-1][2]
        assert _apply(whole, d) == end == _apply(b, _apply(a, d))


def test_composed_map_as_an_expression(spark):
    chunk = clock.compose([1, 2, 5], [15, 29, 70], [0, 4, -40], 10)
    row = spark.createDataFrame([chunk], "band_lo array<long>, band_hi array<long>, outside array<long>, shift long")
    ds = spark.range(-120, 120).select(F.col("id").alias("d"))
    got = {r.d: r.x for r in ds.crossJoin(row.select(F.struct("*").alias("c"))).select("d", clock.applied(F.col("d"), F.col("c")).alias("x")).collect()}
    assert got == {d: _apply(chunk, d) for d in range(-120, 120)}


def test_one_shard_is_walked_in_many_chunks(spark):
    rows = spark.range(20_000).select(F.lit(0).alias("shard"), F.col("id").alias("seq"), (F.col("id") * 40_000).alias("p"),
                                      (F.lit(T) + F.col("id") * 41_000 + (F.col("id") % 7) * 50_000).alias("t"), F.lit(1).alias("key"), F.lit(0.5).alias("value"))
    got = {r.seq: (r.s2, r.d) for r in clock.projected_clock(rows, I, parts=16).collect()}
    data = [(r.seq, r.p, r.t) for r in rows.collect()]
    assert got == two_long_fold(data, I, max(p for _, p, _ in data) // I)


def test_rows_before_the_origin_fail_the_job(spark):
    reals = _reals(spark, [(0, -5000, T), (1, 10, T + 5), (2, 70_000, T + 100)])
    with pytest.raises(Exception, match="arrival before the heartbeat origin 0: -5000"):
        clock.projected_clock(reals, I).collect()
    origin = clock.day_origin(reals)
    assert origin == -86_400_000
    assert clock.projected_clock(reals, I, origin_ms=origin).where("is_real").count() == 3


def test_ticks_of_one_shard_come_from_many_tasks(spark):
    ticks = clock.heartbeat_ticks(_reals(spark, [(0, 2_000_000 * I, T)]), I)
    sizes = [r["count"] for r in ticks.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert sum(sizes) == 2_000_000 and len(sizes) > 1 and max(sizes) < 1_200_000
