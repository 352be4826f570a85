"""Record schemas and the fixed values the results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values (must equal the reference's for identical results) -------
# JSON time format, always UTC; the trailing Z is a literal.
JSON_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
# Field defaults when a JSON record omits them.
DEFAULT_KEY = -1
DEFAULT_VALUE = float("-inf")
# Job defaults: 10 s tumbling windows, 30 s idle / heartbeat interval,
# zero out-of-orderness, one source shard.
DEFAULT_WINDOW_MS = 10_000
DEFAULT_IDLE_MS = 30_000
DEFAULT_LATENESS_MS = 0
DEFAULT_SHARDS = 1
# A real event re-anchors the projected clock when it is at least this many
# idle intervals away from the projected time.
REANCHOR_INTERVALS = 3
# Demo stream: one message per 120 s per source task, keys 0..9.
DEMO_INTERVAL_MS = 120_000
DEMO_KEYS = 10
# Kafka defaults.
DEFAULT_BOOTSTRAP = "localhost:9092"
DEFAULT_CONSUMER_TOPICS = ("test-in",)
DEFAULT_PRODUCER_TOPICS = ("test-out",)
DEFAULT_GROUP_ID = "test"
DEFAULT_START_OFFSET = "latest"
DEFAULT_ACKS = "1"
# ---------------------------------------------------------------------------

# The JSON shape of a record (field names as written on the wire) plus the
# column that receives a line that failed to parse.
CORRUPT_COL = "_corrupt"
JSON_RECORD = T.StructType([
    T.StructField("eventTime", T.TimestampType(), True),
    T.StructField("key", T.IntegerType(), True),
    T.StructField("value", T.DoubleType(), True),
    T.StructField(CORRUPT_COL, T.StringType(), True),
])
