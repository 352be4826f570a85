"""Event-time windows and the per-window reducers.

Windows are epoch-aligned ``[start, end)`` in milliseconds. The reducers
keep the *whole winning record*; ties go to the record that arrived first,
so every input carries its arrival order ``(p, seq)``.

All reducers are plain aggregate expressions: Spark folds them partially on
the map side before the shuffle, so a hot key is pre-aggregated per input
partition and never lands whole in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushwin.operators import scan

RECORD_FIELDS = ("event_time_ms", "key", "value", "seq")


def window_col(size_ms: int, slide_ms: int | None = None, time_col: str = "event_time") -> Column:
    """Spark's event-time window on the record time (works on streams too)."""
    if size_ms <= 0 or (slide_ms is not None and slide_ms <= 0):
        raise ValueError("window size and slide must be positive")
    size = f"{int(size_ms)} milliseconds"
    if slide_ms is None or slide_ms == size_ms:
        return F.window(time_col, size)
    return F.window(time_col, size, f"{int(slide_ms)} milliseconds")


def session_col(gap_ms: int, time_col: str = "event_time") -> Column:
    """Spark's gap-based session window (streams and batch)."""
    if gap_ms <= 0:
        raise ValueError("session gap must be positive")
    return F.session_window(time_col, f"{int(gap_ms)} milliseconds")


def stream_window(size_ms: int, slide_ms: int | None = None, gap_ms: int | None = None) -> Column:
    """Tumbling (default), sliding (``slide_ms``) or session (``gap_ms``)."""
    if gap_ms is not None:
        return session_col(gap_ms)
    return window_col(size_ms, slide_ms)


def bounds_ms(win: str = "window") -> list[Column]:
    return [F.unix_millis(F.col(f"{win}.start")).alias("window_start_ms"),
            F.unix_millis(F.col(f"{win}.end")).alias("window_end_ms")]


def tumbling_assign(df: DataFrame, size_ms: int) -> DataFrame:
    """Each record with the tumbling window it belongs to."""
    return (df.select("*", window_col(size_ms).alias("window"))
              .select(*[c for c in df.columns], *bounds_ms()))


def _record() -> Column:
    return F.struct(F.col("t").alias("event_time_ms"), "key", "value", "seq")


def _arrival_rank() -> list[Column]:
    # Larger is earlier: max over (value, -p, -seq) picks the first arrival on ties.
    return [-F.col("p"), -F.col("seq")]


def _by(by: str | Column) -> Column:
    return F.col(by) if isinstance(by, str) else by


def keep_max_agg(by: str | Column = "value") -> Column:
    """The reference's fold ``if (acc.by < next.by) next else acc``.

    Strict ``<`` keeps the first arrival on ties, and NaN never compares
    greater: a NaN that arrives first stays, a later NaN never wins. So the
    result is the first record when its ``by`` is NaN, else the earliest
    record with the largest non-NaN ``by``. ``by`` is any double column
    expression (the comparator of the fold); it defaults to the value.
    """
    key = _by(by).cast("double")
    rec = _record()
    first = F.min_by(F.struct(key.alias("_by"), rec.alias("r")), F.struct(F.col("p"), F.col("seq")))
    ordered = F.when(~F.isnan(key), F.struct(key, *_arrival_rank()))
    best = F.max_by(rec, ordered)
    return F.when(F.isnan(first["_by"]), first["r"]).otherwise(F.coalesce(best, first["r"]))


def max_by_agg(by: str | Column = "value") -> Column:
    """``maxBy(by)``: largest ``by`` (NaN largest), first arrival on ties."""
    return F.max_by(_record(), F.struct(_by(by), *_arrival_rank()))


def _reduce(df: DataFrame, keys: Sequence[str], win: Column, agg: Column) -> DataFrame:
    out = (df.groupBy(*keys, win.alias("window"))
             .agg(agg.alias("r")))
    return out.select(*keys, *bounds_ms(),
                      *[F.col(f"r.{f}").alias(f) for f in RECORD_FIELDS if f not in keys])


def reduce_keep_max(df: DataFrame, size_ms: int, keys: Sequence[str] = ("key",),
                    slide_ms: int | None = None, by: str | Column = "value") -> DataFrame:
    """Per key and window, the record kept by the reference's max fold."""
    return _reduce(df, keys, window_col(size_ms, slide_ms), keep_max_agg(by))


def reduce_max_by(df: DataFrame, size_ms: int, keys: Sequence[str] = ("key",),
                  slide_ms: int | None = None, by: str | Column = "value") -> DataFrame:
    """Per key and window, ``maxBy(by)`` with first-arrival ties."""
    return _reduce(df, keys, window_col(size_ms, slide_ms), max_by_agg(by))


def session_ids(df: DataFrame, gap_ms: int, keys: Sequence[str] = ("key",),
                parts: int | None = None) -> DataFrame:
    """Assign gap-based sessions (0, 1, ..) in event-time order per key.

    A record opens a new session when it is at least ``gap_ms`` after the
    previous record of its key (Spark's ``session_window`` rule: a session
    ``[first, last + gap)`` absorbs any record that starts inside it). One
    range-dealt scan counts the openings (``scan``), so a hot key is not one
    task.
    """
    if gap_ms <= 0:
        raise ValueError("gap must be positive")
    return scan.steps(df, keys, ("t", "seq"), "t", lambda gap: gap >= gap_ms, "session_id", parts=parts)


def session_keep_max(df: DataFrame, gap_ms: int, keys: Sequence[str] = ("key",),
                     parts: int | None = None) -> DataFrame:
    """Per key and gap session, the record kept by the max fold."""
    s = session_ids(df.select(*dict.fromkeys((*keys, "key", "value", "p", "seq", "t"))), gap_ms, keys, parts)
    out = s.groupBy(*keys, "session_id").agg(
        F.min("t").alias("window_start_ms"), (F.max("t") + F.lit(gap_ms)).alias("window_end_ms"),
        keep_max_agg().alias("r"))
    return out.select(*keys, "window_start_ms", "window_end_ms",
                      *[F.col(f"r.{f}").alias(f) for f in RECORD_FIELDS if f not in keys])
