"""Many parts on small data (a large input has so many): results must still
equal the oracle, and a later call must see files added since."""

import shutil

import pytest

import __spark_entry__ as E
from hushwin.operators import scan
from tests.parity import compare

NAMES = ["bounded_watermark", "late_drop", "round_robin", "session_reduce_max", "projected_clock",
         "heartbeat_window_close", "close_latency", "idle_intervals", "idle_watermark", "shard_progress",
         "idle_close", "idle_timeout_job", "heartbeat_job_defaults", "heartbeat_min_shards"]


@pytest.fixture()
def large_plan(monkeypatch):
    monkeypatch.setattr(scan, "part_count", lambda spark, parts=None: parts or 29)


@pytest.mark.parametrize("name", NAMES)
def test_large_plan_matches_oracle(spark, large_plan, name):
    r = compare(spark, "/root/testdata/sf0.01", name, E.queries()[name], E.oracle_sql()[name])
    assert r["ok"], r


@pytest.mark.parametrize("name", ["projected_clock", "idle_watermark", "shard_progress", "idle_timeout_job"])
def test_added_files_are_seen(spark, scratch, name):
    """A query sees the rows of a file added between two calls in one session."""
    sf = f"{scratch}/sf"
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.where("event_id % 2 = 0").coalesce(1).write.parquet(f"{sf}/events.parquet")
    E.queries()[name](spark, sf).collect()
    events.where("event_id % 2 = 1").coalesce(1).write.mode("append").parquet(f"{sf}/events.parquet")
    got = sorted(map(str, E.queries()[name](spark, sf).collect()))
    whole = f"{scratch}/whole"
    shutil.copytree("/root/testdata/sf0.001", whole)
    assert got == sorted(map(str, E.queries()[name](spark, whole).collect()))
