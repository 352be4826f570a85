"""Kafka options, topic routing, start positions, round-robin dealing."""

import pytest
from pyspark.sql import functions as F

from hushwin.operators import routing
from hushwin.sources import kafka, tables


def test_consumer_options():
    o = kafka.consumer_options(topics=["a", "b"], offset="earliest", properties={"max.poll.records": 5})
    assert o["subscribe"] == "a,b" and o["startingOffsets"] == "earliest"
    assert o["kafka.max.poll.records"] == "5" and o["kafka.group.id"] == "test"
    stamped = kafka.consumer_options(pattern="in-.*", offset=1700000000000)
    assert stamped["startingTimestamp"] == "1700000000000"
    assert stamped["startingOffsetsByTimestampStrategy"] == "latest"  # a quiet partition starts at its end
    bounded = kafka.consumer_options(reader={"maxOffsetsPerTrigger": 500, "failOnDataLoss": "false"})
    assert bounded["maxOffsetsPerTrigger"] == "500" and bounded["failOnDataLoss"] == "false"
    assert "startingOffsets" not in kafka.consumer_options(offset="group")  # resume from the checkpoint
    assert kafka.consumer_options()["subscribe"] == "test-in"
    with pytest.raises(ValueError):
        kafka.consumer_options(topics=["a"], pattern="b")


def test_producer_options_user_wins():
    assert kafka.producer_options()["kafka.acks"] == "1"
    assert kafka.producer_options(properties={"acks": "all"})["kafka.acks"] == "all"
    assert kafka.sink_topics() == ["test-out"]
    with pytest.raises(ValueError):
        kafka.sink_topics("out-.*")
    with pytest.raises(ValueError):
        kafka.sink_topics(["out-.*"])


def test_topic_pattern_is_anchored(spark):
    df = spark.createDataFrame([("click",), ("clicks",), ("xclick",), ("view",)], "topic string")
    assert sorted(r.topic for r in routing.topic_filter(df, "click|view").collect()) == ["click", "view"]


def test_start_positions(spark):
    df = spark.createDataFrame([(0, 1, 10), (0, 2, 20), (1, 3, 30)], "shard int, seq long, t long")
    assert routing.start_position(df, "earliest").count() == 3
    assert routing.start_position(df, "latest").count() == 0
    assert routing.start_position(df, "20").count() == 2
    committed = df.sparkSession.createDataFrame([(0, 2), (1, 4)], "shard int, next_seq long")
    assert [r.seq for r in routing.start_position(df, "group", committed=committed).collect()] == [2]


def test_round_robin_offset_form_equals_rank_form(spark):
    r = tables.jittered(spark, "/root/testdata/sf0.001").withColumn("off", F.floor(F.col("seq") / 4))
    # arrival order within a shard is (p, seq); the offset form needs offsets in that order
    from pyspark.sql import Window
    r = r.withColumn("off", F.row_number().over(Window.partitionBy("shard").orderBy("p", "seq")) - 1)
    a = {x.seq: x.out_partition for x in routing.round_robin(r, 4).collect()}
    b = {x.seq: x.out_partition for x in routing.round_robin(r, 4, offset="off").collect()}
    assert a == b and set(a.values()) == {0, 1, 2, 3}


def test_fanout_gives_every_topic_everything(spark):
    df = spark.createDataFrame([(1,), (2,)], "seq long")
    out = routing.topic_fanout(df, ["x", "y"])
    assert sorted((r.topic, r.seq) for r in out.collect()) == [("x", 1), ("x", 2), ("y", 1), ("y", 2)]


def test_kafka_columns_decode_to_a_trace(spark):
    from datetime import datetime, timezone

    from hushwin.functions import codec
    ts = datetime(2024, 1, 1, tzinfo=timezone.utc)
    raw = spark.createDataFrame(
        [("in", 2, 7, ts, bytearray(b'{"eventTime":"2021-03-01T00:00:05.123Z","key":3,"value":0.5}')),
         ("in", 2, 8, ts, bytearray(b'not json'))],
        "topic string, partition int, offset long, timestamp timestamp, value binary")
    trace = codec.good(codec.decode(kafka.kafka_columns(raw)))
    rows = [(r.topic, r.shard, r.seq, r.p, r.t, r.key, r.value) for r in trace.collect()]
    assert rows == [("in", 2, 7, 1704067200000, 1614556805123, 3, 0.5)]
    out = kafka.kafka_payload(trace.select("topic", "event_time", "key", "value"))
    assert [r.value.decode() for r in out.collect()] == [
        '{"eventTime":"2021-03-01T00:00:05.123Z","key":3,"value":0.5}']


def test_partitions_are_dealt_over_the_clocks(spark):
    raw = spark.sql("""SELECT t AS topic, CAST(pt AS INT) AS partition, o AS offset, timestamp_millis(1000 + o) AS timestamp,
                              CAST('{}' AS BINARY) AS value
                       FROM (SELECT explode(array('a', 'b')) AS t) CROSS JOIN (SELECT id AS pt FROM range(5))
                            CROSS JOIN (SELECT id AS o FROM range(3))""")
    one = kafka.kafka_columns(raw, 1).collect()
    assert {r.shard for r in one} == {0} and len({(r.topic, r.partition, r.seq) for r in one}) == 30
    several = kafka.kafka_columns(raw, 3).collect()
    assert {r.shard for r in several} <= {0, 1, 2}
    assert len({(r.topic, r.partition, r.shard) for r in several}) == 10   # a partition stays on one clock
    assert {r.shard for r in kafka.kafka_columns(raw).collect()} == set(range(5))
