"""Routing: topic fan-out and selection, start positions, round-robin shards."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushwin.operators import scan


def topic_fanout(df: DataFrame, topics: Sequence[str], out: str = "topic") -> DataFrame:
    """Every topic receives the whole stream: one row per (record, topic).

    A single Kafka sink then routes on the ``topic`` column, instead of one
    producer per topic. Topics must be an explicit list, not a pattern.
    """
    topics = list(topics)
    if not topics or any(not isinstance(t, str) or not t for t in topics):
        raise ValueError("sink topics must be a non-empty list of names")
    return df.withColumn(out, F.explode(F.array(*[F.lit(t) for t in topics])))


def anchored(pattern: str) -> str:
    """A regex that must match the whole topic name (Java ``matches``)."""
    re.compile(pattern)
    return f"^(?:{pattern})$"


def topic_filter(df: DataFrame, pattern: str, topic: str = "topic") -> DataFrame:
    """Rows whose topic fully matches ``pattern`` (subscribe-by-pattern)."""
    return df.filter(F.col(topic).rlike(anchored(pattern)))


def start_position(df: DataFrame, offset: str | int, time_ms: str = "t",
                   committed: DataFrame | None = None, shard: str = "shard",
                   seq: str = "seq") -> DataFrame:
    """Where a replay starts reading.

    ``earliest``: everything; ``latest``: nothing already present; an
    epoch-ms number: records stamped at or after it; anything else: resume
    after the committed position per shard (``committed`` has ``shard`` and
    ``next_seq``), and without commits behave as ``latest``.
    """
    if isinstance(offset, int) or (isinstance(offset, str) and offset.lstrip("-").isdigit()):
        return df.filter(F.col(time_ms) >= F.lit(int(offset)))
    if offset == "earliest":
        return df
    if offset == "latest" or committed is None:
        return df.filter(F.lit(False))
    c = committed.select(F.col("shard").alias(shard), "next_seq")
    return df.join(c, on=shard, how="inner").filter(F.col(seq) >= F.col("next_seq")).drop("next_seq")


def round_robin(df: DataFrame, n: int, shard: str = "shard", order: Sequence = ("p", "seq"),
                parts: int | None = None, offset: str | None = None,
                out: str = "out_partition") -> DataFrame:
    """Deal each source shard's records to ``n`` outputs in turn.

    Source shard ``i`` starts at output ``i`` and sends its k-th record
    (k = 1, 2, ...) to ``(i + k) % n``. With a consecutive per-shard offset
    (a Kafka offset), ``k = offset + 1`` needs no ordering at all; otherwise
    ``k`` is the arrival rank, from a range-dealt scan.
    """
    if n <= 0:
        raise ValueError("n must be positive")
    if offset is not None:
        return df.withColumn(out, F.pmod(F.col(shard) + F.col(offset) + 1, F.lit(n)).cast("int"))
    ranked = scan.row_number(df, [shard], order, "_k", parts)
    return ranked.withColumn(out, F.pmod(F.col(shard) + F.col("_k"), F.lit(n)).cast("int")).drop("_k")
