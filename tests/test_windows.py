"""Window reducers: tie and NaN rules against the reference's sequential
fold, window boundaries, watermark closing points."""

import math
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hushwin.operators import watermark, windows

SCHEMA = "shard int, seq long, p long, t long, event_time timestamp, key int, value double"


def _df(spark, rows):
    return spark.createDataFrame(rows, "shard int, seq long, p long, t long, key int, value double") \
        .withColumn("event_time", F.timestamp_millis("t"))


def fold_keep_max(recs):
    acc = None
    for r in recs:  # arrival order
        if acc is None or acc[2] < r[2]:
            acc = r
    return acc


def fold_max_by(recs):
    def key(v):
        return (1, 0.0) if math.isnan(v) else (0, v)
    acc = None
    for r in recs:
        if acc is None or key(r[2]) > key(acc[2]):
            acc = r
    return acc


@settings(max_examples=5, deadline=None)
@given(st.integers(min_value=0, max_value=10**6))
def test_reducers_match_sequential_fold(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for seq in range(200):
        v = rnd.choice([float("nan"), 1.0, 2.0, 2.0, 3.0, float("-inf"), rnd.random()])
        rows.append((0, seq, seq * 7 + rnd.randint(0, 5), rnd.randint(0, 59_999), rnd.randint(0, 2), v))
    df = _df(spark, rows).repartition(7)  # arrival order must not depend on partitions
    keep = {(r.key, r.window_start_ms): r.seq for r in windows.reduce_keep_max(df, 20_000).collect()}
    maxby = {(r.key, r.window_start_ms): r.seq for r in windows.reduce_max_by(df, 20_000).collect()}
    groups = {}
    for r in sorted(rows, key=lambda r: (r[2], r[1])):
        groups.setdefault((r[4], r[3] - r[3] % 20_000), []).append((r[1], r[3], r[5]))
    assert keep == {g: fold_keep_max(v)[0] for g, v in groups.items()}
    assert maxby == {g: fold_max_by(v)[0] for g, v in groups.items()}


def test_window_boundaries(spark):
    df = _df(spark, [(0, 1, 1, 1_000, 1, 1.0), (0, 2, 2, 9_999, 1, 2.0), (0, 3, 3, 10_000, 1, 3.0)])
    got = {(r.seq, r.window_start_ms, r.window_end_ms)
           for r in windows.tumbling_assign(df, 10_000).collect()}
    assert got == {(1, 0, 10_000), (2, 0, 10_000), (3, 10_000, 20_000)}


def test_watermark_closes_exactly_at_window_end(spark):
    # events at 1 s, 2 s, then 10 s: with L = 0 the 10 s event closes [0, 10).
    df = _df(spark, [(0, 1, 1, 1_000, 1, 1.0), (0, 2, 2, 2_000, 1, 2.0), (0, 3, 3, 10_000, 1, 3.0),
                     (0, 4, 4, 5_000, 1, 9.0)])
    lr = {r.seq: r.is_late for r in watermark.late_rows(df, 10_000, 0).collect()}
    assert lr == {1: False, 2: False, 3: False, 4: True}
    wm = {r.seq: r.wm_ms for r in watermark.bounded_watermark(df, 0).collect()}
    assert wm[3] == 9_999  # max - L - 1: the window [0, 10 s) fires at 9 999
    kept = {(r.window_start_ms, r.seq) for r in watermark.late_drop(df, 10_000, 0).collect()}
    assert kept == {(0, 2), (10_000, 3)}


def test_lateness_admits_out_of_order(spark):
    df = _df(spark, [(0, 1, 1, 1_000, 1, 1.0), (0, 2, 2, 10_000, 1, 2.0), (0, 3, 3, 5_000, 1, 9.0)])
    lr = {r.seq: r.is_late for r in watermark.late_rows(df, 10_000, 1).collect()}
    assert lr == {1: False, 2: False, 3: False}


def test_jittered_fixture_late_count(spark):
    from hushwin.sources import tables
    lr = watermark.late_rows(tables.jittered(spark, "/root/testdata/sf0.01"), 3_600_000, 600_000)
    assert lr.filter("is_late").count() == 271
