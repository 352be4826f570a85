"""Topics: bad records counted and sorted out in one read, records that cannot
be encoded, and reading each window's record once after a replayed batch."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from hushwin.config import WindowOptions
from hushwin.functions import codec
from hushwin.sources import kafka, streams
from hushwin.streaming import apps, jobs

RAW = "topic string, partition int, offset long, timestamp timestamp, value string"
T0 = "2021-03-01T00:00:0"


def _topic(path, name, records, mtime):
    os.makedirs(path, exist_ok=True)
    f = os.path.join(path, name)
    with open(f, "w") as out:
        for offset, (second, payload) in enumerate(records):
            out.write(json.dumps({"topic": "in", "partition": 0, "offset": offset,
                                  "timestamp": f"2021-03-01T00:00:{second:02d}.000Z", "value": payload}) + "\n")
    os.utime(f, (mtime, mtime))


def _line(time_, key=1, value=0.5):
    return json.dumps({"eventTime": time_, "key": key, "value": value})


GOOD = [_line(T0 + "1.000Z"), json.dumps({"eventTime": T0 + "2.000Z"})]
FAR = _line("+12021-03-01T00:00:03.000Z")
BAD = ["{no json", _line("not a time"), json.dumps({"key": 1, "value": 2.0})]


def _raw(spark, path):
    return kafka.kafka_columns(spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).json(path), 1)


def test_records_are_sorted_out_in_one_read(spark, scratch):
    src, out = os.path.join(scratch, "in"), os.path.join(scratch, "out")
    now = time.time() - 100
    _topic(src, "0.json", [(1, GOOD[0]), (2, BAD[0]), (3, BAD[1])], now)
    _topic(src, "1.json", [(4, GOOD[1]), (5, BAD[2]), (6, FAR)], now + 1)
    q = jobs.start_sorted_out(_raw(spark, src), out, "sorted_out", checkpoint=os.path.join(scratch, "ckpt"))
    try:
        q.processAllAvailable()
        counts = jobs.observed(q)
        read = sum(p["numInputRows"] for p in q.recentProgress)
    finally:
        q.stop()
    got = spark.read.parquet(out)
    kinds = {r["kind"]: r["n"] for r in got.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert kinds == {"good": 3, "unparsable": 2, "no_event_time": 1}
    assert counts == {("decode", "good"): 3, ("decode", "unparsable"): 2, ("decode", "no_event_time"): 1}
    assert read == 6
    kept = {(r.kind, r.payload) for r in got.select("kind", "payload").collect()}
    assert kept == {("good", None), ("unparsable", BAD[0]), ("unparsable", BAD[1]), ("no_event_time", BAD[2])}
    trace = spark.read.schema(streams.TRACE).parquet(apps.sorted_source(out)).orderBy("t").collect()
    assert [(r.shard, r.key, r.value) for r in trace] == [(0, 1, 0.5), (0, -1, float("-inf")), (0, 1, 0.5)]


def test_window_job_counts_its_bad_records(spark, scratch):
    src = os.path.join(scratch, "in")
    now = time.time() - 100
    _topic(src, "0.json", [(1, GOOD[0]), (2, BAD[0])], now)
    _topic(src, "1.json", [(3, BAD[2]), (9, _line("2021-03-01T00:00:25.000Z"))], now + 1)
    out = jobs.idle_timeout_windows(apps.decoded(_raw(spark, src)), 10_000, 0)
    q = jobs.start(out, "counts_bad", sink="memory", checkpoint=os.path.join(scratch, "ckpt"))
    try:
        q.processAllAvailable()
        assert jobs.observed(q) == {("decode", "good"): 2, ("decode", "unparsable"): 1, ("decode", "no_event_time"): 1}
        assert spark.table("counts_bad").count() == 1
    finally:
        q.stop()
    jobs.forget(q)
    assert str(q.runId) not in jobs.LateRows.runs


def test_what_cannot_be_encoded(spark):
    rows = spark.sql("""SELECT * FROM VALUES (timestamp_millis(1614556800000), 1, 1D), (CAST(NULL AS TIMESTAMP), 2, 2D),
        (timestamp_millis(-62198755200000), 3, 3D), (timestamp_millis(253402300799999), 4, CAST('-Infinity' AS DOUBLE)),
        (timestamp_millis(0), CAST(NULL AS INT), CAST(NULL AS DOUBLE)) AS t(event_time, key, value)""")
    every = rows.withColumn("payload", codec.encode())
    back = codec.decode(every.selectExpr("key AS k", "event_time AS was", "payload"))
    readable = {r.k for r in back.where("reason IS NULL AND event_time = was").select("k").collect()}
    assert {r.key for r in codec.encode_records(rows).select("key").collect()} == readable == {1, 3, 4, None}


def test_records_that_cannot_be_encoded_are_counted(spark, scratch):
    src = os.path.join(scratch, "in")
    os.makedirs(src)
    with open(os.path.join(src, "0.json"), "w") as out:
        for t in (1614556800000, None, None):
            out.write(json.dumps({"shard": 0, "seq": 1, "p": 0, "t": t, "key": 1, "value": 0.5}) + "\n")
    rec = streams.replay(spark, src, streams.TRACE, fmt="json").select(F.timestamp_millis("t").alias("event_time"), "key", "value")
    q = jobs.start(jobs.payload(rec, "unencodable", ("a", "b")), "unencodable", sink="memory", checkpoint=os.path.join(scratch, "ckpt"))
    try:
        q.processAllAvailable()
        assert jobs.observed(q) == {("encode", "written"): 1, ("encode", "dropped"): 2}
    finally:
        q.stop()
    assert sorted(r.topic for r in spark.table("unencodable").collect()) == ["a", "b"]


def _closed(spark, src):
    rows = streams.replay(spark, src, streams.TRACE, fmt="json")
    return jobs.idle_timeout_windows(rows, 10_000, 0).selectExpr(
        "timestamp_millis(event_time_ms) AS event_time", "key", "value", "window_start_ms")


def test_replayed_batch_reads_back_once(spark, scratch):
    """The sink writes a batch, then fails: the restarted job writes it again."""
    src, topic, ckpt = (os.path.join(scratch, x) for x in ("in", "topic", "ckpt"))
    os.makedirs(src)
    base, now = 1614556800000, time.time() - 100
    for i, t in enumerate([1_000, 25_000, 45_000]):
        f = os.path.join(src, f"{i}.json")
        with open(f, "w") as out:
            for key in (1, 2, 3):
                out.write(json.dumps({"shard": 0, "seq": 10 * i + key, "p": t, "t": base + t, "key": key, "value": key / 2}) + "\n")
        os.utime(f, (now + i, now + i))
    state = {"fail": True, "offset": 0}

    def append(batch, batch_id):
        n = batch.count()
        if not n:
            return
        (batch.select("topic", F.lit(0).alias("partition"), (F.monotonically_increasing_id() + F.lit(state["offset"])).alias("offset"),
                      F.timestamp_seconds(F.lit(1_700_000_000 + state["offset"] // 1000)).alias("timestamp"), "value", "headers")
         .write.mode("append").parquet(topic))
        state["offset"] += 1_000_000_000_000
        if state["fail"]:
            state["fail"] = False
            raise RuntimeError("after the write")

    def run():
        out = jobs.payload(_closed(spark, src), "replayed", ("a", "b"))
        return jobs._start(out.writeStream.foreachBatch(append), spark, "replayed", None, ckpt)

    q = run()
    with pytest.raises(Exception):
        q.processAllAvailable()
    q.stop()
    q = run()
    q.processAllAvailable()
    assert jobs.observed(q)[("encode", "dropped")] == 0
    q.stop()
    raw = spark.read.parquet(topic)
    copies = raw.groupBy("topic", "value").count()
    assert copies.where("count > 1").count() == 6            # three windows on two topics came twice
    want = sorted((r.topic, r.value.decode()) for r in copies.collect())
    assert sorted((r.topic, r.value.decode()) for r in kafka.once(raw, 1).collect()) == want
    stream = spark.readStream.schema(raw.schema).parquet(topic)
    q = jobs.start(kafka.once(stream, 10**13), "once", sink="memory", checkpoint=os.path.join(scratch, "ckpt2"))
    q.processAllAvailable()
    q.stop()
    assert sorted((r.topic, r.value.decode()) for r in spark.table("once").collect()) == want


def test_rows_without_an_id_are_all_kept(spark):
    rows = spark.createDataFrame([("a", 0, 1, b"x", None), ("a", 0, 2, b"x", None), ("a", 1, 1, b"x", [])],
                                 "topic string, partition int, offset long, value binary, headers array<struct<key:string,value:binary>>")
    assert kafka.once(rows, 1).count() == 3


def test_options_of_a_start(spark):
    with pytest.raises(ValueError):
        jobs.start(streams.sample_records(spark), "never", policy="median")
    before = spark.conf.get("spark.sql.streaming.multipleWatermarkPolicy")
    q = jobs.start(streams.sample_records(spark), "policy_kept", sink="memory", policy="max")
    q.stop()
    assert spark.conf.get("spark.sql.streaming.multipleWatermarkPolicy") == before
    assert WindowOptions().shards == 1
