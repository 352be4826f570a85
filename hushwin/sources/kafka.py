"""Kafka source and sink options, and the keyed-record stream built on them.

Spark's Kafka connector reads ``topic, partition, offset, timestamp, value``;
the record is decoded from ``value`` (``hushwin.functions.codec``). A
(topic, partition) is dealt to one of ``shards`` logical clocks, whatever the
partition count, so the heartbeats of shards ``0 .. shards - 1`` reach every
record. The connector jar is not part of every install: the builders below
are plain dictionaries and are tested without a broker.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushwin.functions import codec
from hushwin.schema import (DEFAULT_ACKS, DEFAULT_BOOTSTRAP, DEFAULT_CONSUMER_TOPICS, DEFAULT_GROUP_ID,
                            DEFAULT_PRODUCER_TOPICS, DEFAULT_START_OFFSET)


def start_options(offset: str | int) -> dict[str, str]:
    """Where a consumer starts: ``earliest``, ``latest``, an epoch-ms
    number (first record stamped at or after it; a partition without one
    starts at its end), or anything else to resume where the query left off
    (its checkpoint holds the offsets)."""
    if isinstance(offset, int) or (isinstance(offset, str) and offset.lstrip("-").isdigit()):
        return {"startingTimestamp": str(int(offset)), "startingOffsetsByTimestampStrategy": "latest"}
    if offset in ("earliest", "latest"):
        return {"startingOffsets": offset}
    return {}


def consumer_options(bootstrap: str = DEFAULT_BOOTSTRAP, topics: Sequence[str] | None = None,
                     pattern: str | None = None, offset: str | int = DEFAULT_START_OFFSET,
                     group_id: str = DEFAULT_GROUP_ID,
                     properties: Mapping[str, str] | None = None,
                     reader: Mapping[str, str] | None = None) -> dict[str, str]:
    """Options for ``readStream.format('kafka')``. Exactly one of a topic
    list or a topic pattern. ``properties`` go to the Kafka client,
    ``reader`` to the Spark source (``maxOffsetsPerTrigger``,
    ``failOnDataLoss``, ``minPartitions``); both win over defaults."""
    if (topics is None) == (pattern is None):
        if topics is None:
            topics = list(DEFAULT_CONSUMER_TOPICS)
        else:
            raise ValueError("give a topic list or a topic pattern, not both")
    opts = {"kafka.bootstrap.servers": bootstrap, "kafka.group.id": group_id}
    if pattern is not None:
        re.compile(pattern)
        opts["subscribePattern"] = pattern
    else:
        if not topics or any(not t for t in topics):
            raise ValueError("topic list must be non-empty")
        opts["subscribe"] = ",".join(topics)
    opts.update(start_options(offset))
    for k, v in (properties or {}).items():
        opts[k if k.startswith("kafka.") else f"kafka.{k}"] = str(v)
    opts.update({k: str(v) for k, v in (reader or {}).items()})
    return opts


def producer_options(bootstrap: str = DEFAULT_BOOTSTRAP,
                     properties: Mapping[str, str] | None = None) -> dict[str, str]:
    """Options for ``writeStream.format('kafka')``; ``acks`` defaults to 1
    unless the user set it. The topic comes from each row's ``topic``
    column (see ``routing.topic_fanout``)."""
    opts = {"kafka.bootstrap.servers": bootstrap, "kafka.acks": DEFAULT_ACKS}
    for k, v in (properties or {}).items():
        opts[k if k.startswith("kafka.") else f"kafka.{k}"] = str(v)
    return opts


def sink_topics(topics: Sequence[str] | str | None = None) -> list[str]:
    """Producer topics must be an explicit list (a pattern is an error)."""
    if topics is None:
        return list(DEFAULT_PRODUCER_TOPICS)
    if isinstance(topics, str):
        raise ValueError("producer topics must be a list of names, not a pattern")
    topics = list(topics)
    if not topics or any(not t or any(c in t for c in "*?[]()|^$") for t in topics):
        raise ValueError("producer topics must be plain, non-empty names")
    return topics


def read_records(spark: SparkSession, options: Mapping[str, str], shards: int | None = None) -> DataFrame:
    """Keyed records from Kafka: ``topic, partition, shard, seq, p,
    payload``, ready for ``codec.decode``."""
    raw = spark.readStream.format("kafka").options(**options).load()
    return kafka_columns(raw, shards)


def kafka_columns(raw: DataFrame, shards: int | None = None) -> DataFrame:
    """Map the connector's columns to a trace: offset = arrival sequence,
    record timestamp = arrival time (``message.timestamp.type=LogAppendTime``
    makes it the broker's own). The shard is the partition, or with
    ``shards`` a hash of (topic, partition) below it. Offsets then repeat
    within a shard; ``topic, partition, seq`` stays a total order."""
    shard = F.col("partition") if shards is None else F.pmod(F.xxhash64("topic", "partition"), F.lit(shards))
    return raw.select("topic", F.col("partition").cast("int").alias("partition"), shard.cast("int").alias("shard"),
                      F.col("offset").alias("seq"), F.unix_millis("timestamp").alias("p"),
                      F.col("value").alias("payload"))


#: The header of a window's record that says which one it is.
ID_HEADER = "hushwin-id"
ID_COLUMNS = ("key", "window_start_ms")


def kafka_payload(df: DataFrame, name: str | None = None) -> DataFrame:
    """The rows a Kafka sink writes: ``topic``, UTF-8 JSON ``value`` and
    ``headers``. Rows of a window (``ID_COLUMNS``) carry the id ``name``,
    key and window start: a job emits a window once, so an id that comes
    again is a batch written twice. Other rows carry none."""
    out = codec.encode_records(df, "value_json")
    if name is None or not set(ID_COLUMNS) <= set(df.columns):
        return out.select("topic", F.col("value_json").alias("value"))
    own = F.to_json(F.array(F.lit(name), *[F.col(c).cast("string") for c in ID_COLUMNS]))
    header = F.struct(F.lit(ID_HEADER).alias("key"), F.encode(own, "UTF-8").alias("value"))
    return out.select("topic", F.col("value_json").alias("value"), F.array(header).alias("headers"))


def once(raw: DataFrame, within_ms: int) -> DataFrame:
    """The connector's rows (read with ``includeHeaders``), each window's
    record once a topic. Rows without an id are all kept.

    On a stream a copy is known for ``within_ms`` of append time: choose it
    above the time a failed job takes to write its last batch again and
    above the lag between partitions, as rows further behind are late. Its
    state is one id per record of that span. A table is compared whole."""
    own = F.get(F.filter("headers", lambda h: h["key"] == ID_HEADER), 0)["value"]
    place = F.concat_ws(":", F.lit("at"), F.col("partition"), F.col("offset"))
    marked = raw.withColumn("_id", F.coalesce(F.decode(own, "UTF-8"), place))
    if not raw.isStreaming:
        return marked.dropDuplicates(["topic", "_id"]).drop("_id")
    return (marked.withWatermark("timestamp", f"{int(within_ms)} milliseconds")
                  .dropDuplicatesWithinWatermark(["topic", "_id"]).drop("_id"))
