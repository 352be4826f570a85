"""JSON decode/encode on the golden lines of FIXTURES.md section 3."""

import math
from datetime import datetime, timezone

from pyspark.sql import functions as F

from hushwin.functions import codec

TS = int(datetime(2021, 3, 1, 0, 0, 5, 123000, tzinfo=timezone.utc).timestamp() * 1000)

LINES = [
    ('{"eventTime":"2021-03-01T00:00:05.123Z","key":3,"value":0.5}', (TS, 3, 0.5)),
    ('{"eventTime":"2021-03-01T00:00:05.123Z"}', (TS, -1, float("-inf"))),
    ('{"key":1}', "no_event_time"),
    ("not json", "unparsable"),
    ('{"eventTime":"bad","key":1,"value":1}', "unparsable"),
    ('{"eventTime":"2021-03-01T00:00:05.123Z","key":3,"value":"x"}', "unparsable"),
    ('{"eventTime":"2021-03-01T00:00:05.123Z","key":3,"value":"-Infinity"}', (TS, 3, float("-inf"))),
]


def _lines(spark):
    return spark.createDataFrame([(i, l) for i, (l, _) in enumerate(LINES)], "seq long, payload string") \
        .withColumn("payload", F.encode("payload", "UTF-8"))


def test_golden_decode(spark):
    d = codec.decode(_lines(spark))
    good = {r.seq: (r.t, r.key, r.value) for r in codec.good(d).collect()}
    bad = {r.seq: r.reason for r in codec.quarantine(d).collect()}
    for i, (_, want) in enumerate(LINES):
        if isinstance(want, str):
            assert bad[i] == want and i not in good
        else:
            assert good[i] == want and i not in bad


def test_round_trip_keeps_infinities(spark):
    good = codec.good(codec.decode(_lines(spark))).select("seq", "event_time", "key", "value")
    enc = codec.encode_records(good)
    text = {r.seq: r.s for r in enc.select("seq", F.col("payload").cast("string").alias("s")).collect()}
    assert text[0] == '{"eventTime":"2021-03-01T00:00:05.123Z","key":3,"value":0.5}'
    back = {r.seq: (r.t, r.key, r.value) for r in codec.good(codec.decode(enc)).collect()}
    assert back == {r.seq: (r.t, r.key, r.value) for r in codec.good(codec.decode(_lines(spark))).collect()}
    assert math.isinf(back[1][2])


def test_parse_runs_once(spark):
    plan = codec.good(codec.decode(_lines(spark)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_decode_ignores_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        good = {r.seq: r.t for r in codec.good(codec.decode(_lines(spark))).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert good[0] == TS
