"""Bounded-out-of-orderness watermarks and late rows over a replayed trace.

The watermark after a row is ``max(event time so far) - L - 1`` per shard,
in arrival order ``(p, seq)``. A window ``[s, e)`` closes once the
watermark reaches ``e - 1``, i.e. once some arrival has event time
``>= e + L``; a row is late (dropped by the window) when its window had
already closed before it arrived: ``e <= max(event time before it) - L``.

Whether a row is late needs no ordered scan: a row is late exactly when
the arrival that closed its window came before it (``closing``). Only the
operators that return the running maximum itself form it, by a range-dealt
scan (``hushwin.operators.scan``), which splits a hot shard or a burst.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushwin.operators import scan, windows

def _order():
    return (F.col("p"), F.col("seq"))


#: An arrival as one number: ``p`` in units beyond any ``seq``, a real row half a unit after a heartbeat of its instant.
_UNIT = 10**20
_SHIFT = 10**19


def arrival_key(real: Column | None = None) -> Column:
    """The place of a row in arrival order (p, heartbeats first, seq) as one
    decimal, which aggregates by hash as a struct does not. ``p`` has at
    most 18 digits."""
    key = F.col("p").cast("decimal(18,0)") * F.lit(Decimal(_UNIT)) + F.col("seq").cast("decimal(19,0)")
    return key if real is None else key + F.when(real, F.lit(Decimal(_UNIT // 2))).otherwise(F.lit(Decimal(0)))


def arrival_ms(key: str) -> Column:
    """The ``p`` of an ``arrival_key``."""
    return F.expr(f"cast(({key} + {_SHIFT}BD - pmod({key} + {_SHIFT}BD, {_UNIT}BD)) div {_UNIT}BD as bigint)")


def _check(lateness_ms: int) -> None:
    if lateness_ms < 0:
        raise ValueError("lateness must be >= 0")


def window_of(size_ms: int, t: str = "t"):
    """Epoch-aligned tumbling window start/end of a millisecond column."""
    start = F.col(t) - F.pmod(F.col(t), F.lit(int(size_ms)))
    return start.alias("window_start_ms"), (start + F.lit(int(size_ms))).alias("window_end_ms")


def bounded_watermark(df: DataFrame, lateness_ms: int, shard: str = "shard",
                      parts: int | None = None) -> DataFrame:
    """Add ``wm_ms``: the shard's watermark right after each row."""
    _check(lateness_ms)
    m = scan.running_max(df, [shard], _order(), "t", "_max_t", parts=parts)
    return m.withColumn("wm_ms", F.col("_max_t") - F.lit(lateness_ms) - 1).drop("_max_t")


def late_rows(df: DataFrame, size_ms: int, lateness_ms: int, shard: str = "shard",
              parts: int | None = None) -> DataFrame:
    """Add the window bounds, ``max_before_ms`` (largest event time that
    arrived earlier on the shard) and ``is_late``."""
    _check(lateness_ms)
    m = scan.running_max(df, [shard], _order(), "t", "max_before_ms", inclusive=False, parts=parts)
    ws, we = window_of(size_ms)
    m = m.select("*", ws, we)
    late = F.coalesce(F.col("window_end_ms") <= F.col("max_before_ms") - F.lit(lateness_ms), F.lit(False))
    return m.withColumn("is_late", late)


def first_reached(points: DataFrame, part: Sequence[str] = ()) -> DataFrame:
    """``points`` (part.., ``window_end_ms``, ``closed``, ``held``) to one row
    per held window end: the least ``closed`` over all points at that end or
    a later one. The aggregate folds map-side; the suffix minimum runs over
    one row per grid point in use, bounded by time span / window size."""
    cells = points.groupBy(*part, "window_end_ms").agg(F.min("closed").alias("closed"), F.max("held").alias("held"))
    later = (Window.partitionBy(*[F.col(c) for c in part] or [F.lit(0)]).orderBy(F.col("window_end_ms").desc())
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (cells.select(*part, "window_end_ms", "held", F.min("closed").over(later).alias("closed"))
            .filter("held").drop("held"))


def reached_end(time: Column, size_ms: int) -> Column:
    """The last window end at or before ``time``."""
    return time - F.pmod(time, F.lit(int(size_ms)))


def closing(df: DataFrame, size_ms: int, lateness_ms: int, part: Sequence[str], arrival: Column,
            time: str = "t", held: Column | None = None) -> DataFrame:
    """``part.., window_end_ms, closed`` for every window that holds a row:
    the first ``arrival`` whose ``time`` is ``>= window_end_ms + L`` (null
    if none). ``held`` (default all) marks the rows that fill windows.

    Window ends lie on a grid, so a row closes every window up to the last
    end at or before ``time - L``. Each row therefore adds its arrival to
    one grid point and its own window's end to another."""
    own = F.when(F.lit(True) if held is None else held, window_of(size_ms)[1])
    point = F.struct(reached_end(F.col(time) - F.lit(int(lateness_ms)), size_ms).alias("window_end_ms"),
                     arrival.alias("closed"), F.lit(False).alias("held"))
    end = F.struct(own.alias("window_end_ms"), F.when(F.lit(False), arrival).alias("closed"), F.lit(True).alias("held"))
    points = df.select(*part, F.explode(F.array(point, end)).alias("c")).select(*part, "c.*")
    return first_reached(points.filter(F.col("window_end_ms").isNotNull()), part)


def with_closing(rows: DataFrame, ends: DataFrame, size_ms: int, part: Sequence[str], arrival: Column) -> DataFrame:
    """``rows`` with their window bounds, ``closed`` and ``is_late``: the
    window had closed before the row's own ``arrival``. ``ends`` has one row
    per window, so AQE broadcasts it if it measures small."""
    ws, we = window_of(size_ms)
    return (rows.select("*", ws, we).join(ends, on=[*part, "window_end_ms"], how="left")
            .withColumn("is_late", F.coalesce(F.col("closed") < arrival, F.lit(False))))


def late_drop(df: DataFrame, size_ms: int, lateness_ms: int, keys: Sequence[str] = ("shard", "key"),
              shard: str = "shard") -> DataFrame:
    """The windowed keep-max reduce as the window operator computes it:
    rows that arrive after their window closed are dropped."""
    _check(lateness_ms)
    arrival = arrival_key()
    ends = closing(df, size_ms, lateness_ms, [shard], arrival)
    on_time = with_closing(df, ends, size_ms, [shard], arrival).filter(~F.col("is_late"))
    out = on_time.groupBy(*keys, "window_start_ms", "window_end_ms").agg(windows.keep_max_agg().alias("r"))
    return out.select(*keys, "window_start_ms", "window_end_ms",
                      *[F.col(f"r.{f}").alias(f) for f in windows.RECORD_FIELDS if f not in keys])
