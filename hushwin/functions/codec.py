"""JSON record codec: decode with defaults and quarantine, encode.

Decoding is one ``from_json`` in PERMISSIVE mode: a line that is not JSON,
or whose fields do not convert (a bad time, a string value), lands in the
corrupt column, while the parsed fields may still be filled in, so the
corrupt column is tested first. A record without an event time cannot be
windowed and is quarantined too. Absent ``key``/``value`` take the record
defaults (-1, -Infinity) only on good rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushwin.schema import (CORRUPT_COL, DEFAULT_KEY, DEFAULT_VALUE, JSON_RECORD,
                            JSON_TIME_FORMAT)

# The 'Z' in the time format is a literal, so the zone must be given.
DECODE_OPTIONS = {
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": CORRUPT_COL,
    "timestampFormat": JSON_TIME_FORMAT,
    "timeZone": "UTC",
}
ENCODE_OPTIONS = {"timestampFormat": JSON_TIME_FORMAT, "timeZone": "UTC"}

REASON_UNPARSABLE = "unparsable"
REASON_NO_TIME = "no_event_time"
KIND_GOOD = "good"


def parse(payload: Column) -> Column:
    """The parsed struct of a UTF-8 JSON payload (binary or string)."""
    return F.from_json(payload.cast("string"), JSON_RECORD, DECODE_OPTIONS)


def decode(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Add ``event_time, key, value`` and ``reason`` (null on good rows).
    
    The parsed struct is expanded with ``inline`` (a generator): a later
    ``filter`` on its fields cannot be pushed below a generator, so the
    JSON is parsed once per row. Through a plain projection the optimizer
    would copy ``from_json`` into the pushed-down filter and parse twice.
    """
    reason = (F.when(F.col(CORRUPT_COL).isNotNull(), F.lit(REASON_UNPARSABLE))
               .when(F.col("eventTime").isNull(), F.lit(REASON_NO_TIME)))
    keep = [c for c in df.columns if c not in ("event_time", "key", "value", "reason")]
    return (df.select(*keep, F.inline(F.array(parse(F.col(payload)))))
              .select(*keep, F.col("eventTime").alias("event_time"), "key", "value", reason.alias("reason")))


def good(decoded: DataFrame) -> DataFrame:
    """Rows that decoded, with the record defaults applied."""
    return (decoded.filter(F.col("reason").isNull())
                   .withColumn("key", F.coalesce(F.col("key"), F.lit(DEFAULT_KEY)))
                   .withColumn("value", F.coalesce(F.col("value"), F.lit(DEFAULT_VALUE)))
                   .withColumn("t", F.unix_millis("event_time"))
                   .drop("reason"))


def counted(decoded: DataFrame) -> DataFrame:
    """The same rows, counted as they pass (observation ``decode``), so that
    the job which drops the bad ones also reports how many there were."""
    reason = F.col("reason")
    return decoded.observe("decode", F.count_if(reason.isNull()).alias(KIND_GOOD),
                           *[F.count_if(F.equal_null(reason, F.lit(r))).alias(r) for r in (REASON_UNPARSABLE, REASON_NO_TIME)])


def quarantine(decoded: DataFrame) -> DataFrame:
    """Rows that did not decode, with the reason."""
    return decoded.filter(F.col("reason").isNotNull()).drop("event_time", "key", "value")


def sorted_out(decoded: DataFrame, payload: str = "payload") -> DataFrame:
    """Every decoded row with its ``kind``: ``good`` (defaults applied, no
    payload), or the reason why it did not decode (with its payload)."""
    good = F.col("reason").isNull()
    plain = [c for c in decoded.columns if c not in ("event_time", "key", "value", "reason", payload)]
    return counted(decoded).select(
        *plain, F.when(~good, F.col(payload)).alias(payload), F.when(good, F.col("event_time")).alias("event_time"), F.when(good, F.unix_millis("event_time")).alias("t"),
        F.when(good, F.coalesce("key", F.lit(DEFAULT_KEY))).alias("key"),
        F.when(good, F.coalesce("value", F.lit(DEFAULT_VALUE))).alias("value"), F.coalesce("reason", F.lit(KIND_GOOD)).alias("kind"))


def encodable(event_time: Column | str = "event_time") -> Column:
    """Whether a record can be written so that ``decode`` reads back the same:
    it has an event time (any year does, keys and values may be absent)."""
    return (F.col(event_time) if isinstance(event_time, str) else event_time).isNotNull()


def encode(event_time: Column | str = "event_time", key: Column | str = "key",
           value: Column | str = "value") -> Column:
    """UTF-8 JSON bytes of a record. A null field is omitted and a
    non-finite value is written as a string ("-Infinity"), which ``decode``
    reads back."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    rec = F.struct(c(event_time).alias("eventTime"), c(key).alias("key"), c(value).alias("value"))
    return F.encode(F.to_json(rec, ENCODE_OPTIONS), "UTF-8")


def encode_records(df: DataFrame, out: str = "payload") -> DataFrame:
    """Encode, and drop rows that cannot be encoded (the sink never gets a
    null record, nor one that its readers must refuse)."""
    return df.filter(encodable()).withColumn(out, encode()).filter(F.col(out).isNotNull())
