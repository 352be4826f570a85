"""Range-dealt scans equal plain per-key window functions, for any number
of parts, and a burst of one key is dealt over many tasks."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from hushwin.operators import scan


def _step(d):
    return np.where(np.abs(d) >= 40, d, 0)


def plain(data):
    w = Window.partitionBy("k").orderBy("p", "id")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    d = data.withColumn("prev", F.lag("v").over(w))
    gap = F.coalesce(F.col("v") - F.col("prev"), F.lit(0))
    d = d.withColumn("g", F.when(F.abs(gap) >= 40, gap).otherwise(0))
    return {r.id: (r.mx, r.mxb, r.sm, r.rn, r.prev, r.st) for r in d.select(
        "id", "prev", F.max("v").over(upto).alias("mx"), F.max("v").over(before).alias("mxb"), F.sum("v").over(upto).alias("sm"),
        F.row_number().over(w).alias("rn"), F.sum("g").over(upto).alias("st")).collect()}


def dealt(data, parts):
    order = ["p", "id"]
    got = scan.running_max(data, ["k"], order, "v", "mx", parts=parts)
    got = scan.running_max(got, ["k"], order, "v", "mxb", inclusive=False, parts=parts)
    got = scan.running_sum(got, ["k"], order, "v", "sm", parts=parts)
    got = scan.row_number(got, ["k"], order, "rn", parts=parts)
    got = scan.steps(got, ["k"], order, "v", _step, "st", "prev", parts=parts)
    return {r.id: (r.mx, r.mxb, r.sm, r.rn, r.prev, r.st) for r in got.collect()}


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_scans_match_windows(spark, parts):
    rnd = random.Random(7)
    keys = ["a"] * 5 + ["b", None, "c"]
    rows = [(rnd.choice(keys), i, rnd.randint(0, 300), rnd.choice([rnd.randint(-100, 100), -10**15, 7 * 10**15])) for i in range(800)]
    data = spark.createDataFrame(rows, "k string, id long, p long, v long")
    assert dealt(data, parts) == plain(data)


def test_no_rows(spark):
    assert dealt(spark.createDataFrame([], "k string, id long, p long, v long"), 4) == {}


def test_a_burst_of_one_instant_is_dealt_over_parts(spark):
    """All rows of one key at one instant: only the tie-breaker differs."""
    data = spark.range(40_000).select(F.lit(1).alias("k"), F.col("id"), F.lit(5).cast("long").alias("p"), (F.col("id") % 97).alias("v"))
    rows = scan._scanned(data, ["k"], [F.col("p"), F.col("id")], "max", "v", None, 20)
    sizes = [r["count"] for r in rows.groupBy(scan.PART).count().collect()]
    assert len(sizes) == 20 and max(sizes) <= 2 * 40_000 // 20
    got = scan.row_number(data, ["k"], ["p", "id"], "rn", parts=20)
    assert got.where("rn <> id + 1").count() == 0


segments = st.lists(st.tuples(st.booleans(), st.integers(-2**40, 2**40)), min_size=1, max_size=60)


@settings(max_examples=200, deadline=None)
@given(segments, st.booleans())
def test_segment_sums_and_maxima(rows, wide):
    start = np.array([True, *[s for s, _ in rows[1:]]])
    x = np.array([v * (2**20 if wide else 1) for _, v in rows], np.int64)
    sums, tops, total, top = [], [], 0, 0
    for s, v in zip(start, x.tolist()):
        total, top = (v, v) if s else (total + v, max(top, v))
        sums.append((total + 2**63) % 2**64 - 2**63)
        tops.append(top)
    assert scan._segment_sum(x, start).tolist() == sums
    assert scan._segment_max(x, start).tolist() == tops
