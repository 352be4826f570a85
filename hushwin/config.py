"""Job options: plain keyword arguments with validation.

Bad values raise ``ValueError`` instead of silently becoming defaults, a
consumer takes a topic list *or* a pattern (never both), and user Kafka
properties win over our defaults.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from hushwin import schema


@dataclass(frozen=True)
class WindowOptions:
    size_ms: int = schema.DEFAULT_WINDOW_MS            # tumbling window size
    lateness_ms: int = schema.DEFAULT_LATENESS_MS      # bounded out-of-orderness L
    idle_ms: int = schema.DEFAULT_IDLE_MS              # heartbeat period = idle timeout = dead band / 3
    trigger_ms: int | None = None                      # micro-batch period (plays the watermark period)
    shards: int = schema.DEFAULT_SHARDS                # logical clocks; Kafka partitions are dealt over them
    slide_ms: int | None = None                        # sliding windows
    session_gap_ms: int | None = None                  # session windows instead of fixed ones

    def __post_init__(self):
        if self.size_ms <= 0:
            raise ValueError("size_ms must be > 0")
        if self.lateness_ms < 0:
            raise ValueError("lateness_ms must be >= 0")
        if self.idle_ms <= 0:
            raise ValueError("idle_ms must be > 0")
        if self.trigger_ms is not None and self.trigger_ms <= 0:
            raise ValueError("trigger_ms must be > 0")
        if self.shards <= 0:
            raise ValueError("shards must be > 0")
        if (self.slide_ms is not None and self.slide_ms <= 0) or \
                (self.session_gap_ms is not None and self.session_gap_ms <= 0):
            raise ValueError("slide_ms and session_gap_ms must be > 0")


@dataclass(frozen=True)
class KafkaIn:
    bootstrap: str = schema.DEFAULT_BOOTSTRAP
    topics: tuple[str, ...] | None = None
    pattern: str | None = None
    offset: str = schema.DEFAULT_START_OFFSET
    group_id: str = schema.DEFAULT_GROUP_ID
    properties: dict = field(default_factory=dict)     # Kafka client properties
    reader: dict = field(default_factory=dict)         # Spark source options (maxOffsetsPerTrigger, ...)


@dataclass(frozen=True)
class KafkaOut:
    bootstrap: str = schema.DEFAULT_BOOTSTRAP
    topics: tuple[str, ...] | None = None  # None: the default producer topics
    properties: dict = field(default_factory=dict)
    exactly_once_path: str | None = None   # set: idempotent file output per batch instead of Kafka

    def __post_init__(self):
        if self.exactly_once_path and self.topics:
            raise ValueError("exactly_once_path writes files: give it or topics, not both")
