"""Heartbeats and the projected event-time clock over a bounded trace.

A shard's state is the offset ``D`` between event time and its heartbeat
clock, and the last projected time ``s2`` (both start at 0). With idle
interval ``I``:

* a heartbeat tick ``f`` projects ``s2 = D + f``;
* a real event ``t`` re-anchors (``D += t - s2``) when ``|t - s2| >= 3I``,
  and in any case sets ``s2 = t``.

Ticks arrive at ``p = n * I`` (n = 1, 2, ...) and go before real events at
the same instant. Inside tick interval ``n = floor(p / I)`` only the first
real event's test depends on ``D``: it compares with ``D + n*I``, every
later one with the real event before it. So a non-empty interval is a map
of ``D`` made of two numbers, its first event time ``t1`` and the sum ``J``
of the re-anchoring jumps among its later events: ``D + J`` inside a band
around ``t1 - n*I``, else the constant ``t1 - n*I + J``.

Such maps compose, and composing is associative. So the clock is a prefix
scan: intervals are dealt over chunks by range, each chunk composes its
maps into one (``compose``), the chunks' maps are applied in turn, one row a
chunk, and each chunk then walks its own intervals from the offset it
starts with (``walk``). No task holds a shard; a hot shard adds rows to
intervals and chunks, not steps to one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushwin.operators import scan
from hushwin.plans.stage import stage
from hushwin.schema import DEFAULT_KEY, DEFAULT_VALUE, REANCHOR_INTERVALS

TICK_CHUNK = 10_000

WALK_SCHEMA = ("shard int, _n long, d_start long, d_first long, "
               "tick_lo long, tick_hi long, tick_d long")
CHUNK_SCHEMA = "shard int, chunk int, first_n long, band_lo array<long>, band_hi array<long>, outside array<long>, shift long"


def _check(idle_ms: int) -> None:
    if idle_ms <= 0:
        raise ValueError("idle interval must be > 0 (a zero interval would spin)")


def _explode_range(df: DataFrame, lo: str, hi: str, out: str, chunk: int = TICK_CHUNK) -> DataFrame:
    """Two-level explode of ``[lo, hi]``: chunks first, then values, so no
    single array holds a whole long range."""
    c = F.explode(F.sequence(F.lit(0).cast("long"),
                             F.floor((F.col(hi) - F.col(lo)) / chunk).cast("long"))).alias("_c")
    # Ranges of values, dealt before they are made: one key's values come from many tasks.
    d = df.filter(F.col(lo) <= F.col(hi)).select("*", c).repartition(scan.part_count(df.sparkSession))
    a = F.col(lo) + F.col("_c") * chunk
    b = F.least(a + chunk - 1, F.col(hi))
    return d.select("*", F.explode(F.sequence(a, b)).alias(out)).drop("_c")


def heartbeat_ticks(reals: DataFrame, idle_ms: int, shard: str = "shard",
                    extra_ticks: int = 0, origin_ms: int = 0) -> DataFrame:
    """The bounded heartbeat source: ticks ``n*I`` for n = 1 .. the last
    tick at or before the shard's last arrival (plus ``extra_ticks``).
    The source starts at arrival time ``origin_ms``, so tick n arrives at
    ``p = origin + n*I``. Columns ``shard, n, tick_ms, p``."""
    _check(idle_ms)
    last = reals.groupBy(shard).agg((F.floor((F.max("p") - origin_ms) / idle_ms) + extra_ticks).cast("long").alias("_hi"))
    ticks = _explode_range(last.withColumn("_lo", F.lit(1).cast("long")), "_lo", "_hi", "n")
    return ticks.select(F.col(shard).alias("shard"), "n", (F.col("n") * idle_ms).alias("tick_ms"),
                        (F.col("n") * idle_ms + origin_ms).alias("p"))


def connect(reals: DataFrame, ticks: DataFrame) -> DataFrame:
    """Tagged union of real records and heartbeats, one schema: a tick is a
    record at its tick time with the default key and value. It arrives at
    its own ``p`` where ``ticks`` has one, else at its tick time."""
    arrival = F.col("p") if "p" in ticks.columns else F.col("tick_ms")
    r = reals.select("shard", "seq", "p", "t", F.lit(True).alias("is_real"), "key", "value")
    h = ticks.select("shard", (-F.col("n")).alias("seq"), arrival.alias("p"),
                     F.col("tick_ms").alias("t"), F.lit(False).alias("is_real"),
                     F.lit(DEFAULT_KEY).alias("key"), F.lit(DEFAULT_VALUE).alias("value"))
    return r.unionByName(h)


def real_only(df: DataFrame, time_col: str = "event_time") -> DataFrame:
    """Drop heartbeats after the watermark. The predicate mentions the
    event-time column on purpose: a bare ``is_real`` filter is pushed below
    ``withWatermark`` and the heartbeats vanish before they can move it."""
    keep = F.when(F.col(time_col).isNull(), F.lit(False)).otherwise(F.col("is_real"))
    return df.filter(keep).drop("is_real")


def arrival_since(origin_ms: int, p: str = "p") -> Column:
    """Arrival time on the heartbeat source's clock. A row that arrived
    before the source started has no place on it: the job fails."""
    late = F.raise_error(F.concat(F.lit(f"arrival before the heartbeat origin {origin_ms}: "), F.col(p).cast("string"))).cast("long")
    return F.when(F.col(p) < origin_ms, late).otherwise(F.col(p) - F.lit(origin_ms))


def day_origin(reals: DataFrame, day_ms: int = 86_400_000) -> int:
    """The start of the day of the least arrival: an origin no row precedes."""
    least = reals.agg(F.min("p")).first()[0]
    return 0 if least is None else least - least % day_ms


def compose(ns: list[int], t1s: list[int], js: list[int], idle_ms: int) -> tuple[list[int], list[int], list[int], int]:
    """The maps of consecutive intervals as one: ``(lo, hi, outside, shift)``.

    An offset in every open band ``(lo[i], hi[i])`` is moved by ``shift``;
    the bands shrink, and the first band that an offset is not in decides:
    it becomes ``outside[i]``. Offsets that re-anchored at the same interval
    are equal from then on, so neighbouring bands of one value are one."""
    width = REANCHOR_INTERVALS * idle_ms
    bands: list[list[int]] = []          # [lo, hi, offset now of those outside], outermost first
    shift, lo, hi = 0, -(1 << 62), 1 << 62
    for n, t1, j in zip(ns, t1s, js):
        anchor = t1 - n * idle_ms
        for b in bands:
            b[2] = b[2] + j if abs(anchor - b[2]) < width else anchor + j
        if lo + 1 < hi:
            new_lo, new_hi = max(lo, anchor - width - shift), min(hi, anchor + width - shift)
            if (new_lo, new_hi) != (lo, hi):
                lo, hi = new_lo, max(new_hi, new_lo + 1)     # an empty band holds no whole number
                bands.append([lo, hi, anchor + j])
            shift += j
        if len(bands) > 1:
            bands = [b for b, inner in zip(bands, bands[1:]) if b[2] != inner[2]] + bands[-1:]
    return [b[0] for b in bands], [b[1] for b in bands], [b[2] for b in bands], shift


def applied(d: Column, chunk: Column) -> Column:
    """The offset after a chunk's map, as an expression on the struct of ``compose``."""
    zones = F.arrays_zip(chunk["band_lo"], chunk["band_hi"], chunk["outside"])
    left = F.filter(zones, lambda z: ~((z["band_lo"] < d) & (d < z["band_hi"])))
    return F.coalesce(F.get(left, F.lit(0))["outside"], d + chunk["shift"])


def _chunk_fn(idle_ms: int):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_n")
        lo, hi, outside, shift = compose(pdf["_n"].tolist(), pdf["t1"].tolist(), pdf["J"].tolist(), idle_ms)
        return pd.DataFrame({"shard": [key[0]], "chunk": [key[1]], "first_n": [pdf["_n"].iloc[0]],
                             "band_lo": [lo], "band_hi": [hi], "outside": [outside], "shift": [shift]})

    return run


def walk(ns: list[int], t1s: list[int], js: list[int], d: int, idle_ms: int) -> list[tuple[int, int, int]]:
    """Per interval the offset before it, after its first event and after
    all, from the offset ``d`` before the first."""
    band, out = REANCHOR_INTERVALS * idle_ms, []
    for n, t1, j in zip(ns, t1s, js):
        first = d if abs(t1 - (d + n * idle_ms)) < band else t1 - n * idle_ms
        out.append((d, first, first + j))
        d = first + j
    return out


def _walk_fn(idle_ms: int):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_n")
        ns = pdf["_n"].tolist()
        steps = walk(ns, pdf["t1"].tolist(), pdf["J"].tolist(), int(pdf["d"].iloc[0]), idle_ms)
        upto = [*[n for n in ns[1:]], int(pdf["next_n"].iloc[0])]
        rows = [(key[0], n, a, b, n + 1, hi, c) for n, hi, (a, b, c) in zip(ns, upto, steps)]
        return pd.DataFrame(rows, columns=["shard", "_n", "d_start", "d_first", "tick_lo", "tick_hi", "tick_d"])

    return run


def _interval_scan(r: DataFrame, band: int, parts: int | None) -> DataFrame:
    """Per real row of a (shard, interval): the running sum of the
    re-anchoring jumps (``_cum``) and the event time before (``_prev``, null
    for the interval's first row). One exchange of the rows; an interval
    with many rows is dealt over parts."""
    return scan.steps(r, ["shard", "_n"], [F.col("p"), F.col("seq")], "t", lambda gap: np.where(np.abs(gap) >= band, gap, 0),
                      "_cum", "_prev", parts)


def _folded(intervals: DataFrame, idle_ms: int, extra_ticks: int, parts: int | None) -> DataFrame:
    """(shard, _n, t1, J) of the non-empty intervals to ``WALK_SCHEMA``."""
    n = scan.part_count(intervals.sparkSession, parts)
    dealt = stage(intervals.repartitionByRange(n, "shard", "_n").withColumn("chunk", F.spark_partition_id()), "clock-intervals")
    chunks = dealt.groupBy("shard", "chunk").applyInPandas(_chunk_fn(idle_ms), CHUNK_SCHEMA)
    # The chunks of a shard, one row each: at most the number of parts.
    per = chunks.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("chunk", "first_n", "band_lo", "band_hi", "outside", "shift"))).alias("c"))
    start = F.array(F.lit(0).cast("long"))
    offsets = F.aggregate("c", start, lambda acc, c: F.concat(acc, F.array(applied(F.element_at(acc, -1), c))))
    per = per.select("shard", "c", offsets.alias("ds"))
    at = per.select("shard", F.posexplode("c").alias("i", "c"), "ds", F.col("c").alias("all"))
    follows = F.get(F.col("all"), F.col("i") + 1)["first_n"]
    starts = at.select("shard", F.col("c.chunk").alias("chunk"), F.get("ds", "i").alias("d"), follows.alias("next_n"), "i", F.col("c.first_n").alias("first_n"))
    starts = stage(starts, "clock-chunks")
    # After a shard's last interval come the extra ticks alone.
    ends = dealt.groupBy("shard").agg((F.max("_n") + extra_ticks).alias("end_n"))
    starts_of = starts.join(ends, "shard").select("shard", "chunk", "d", F.coalesce("next_n", "end_n").alias("next_n"))
    folded = dealt.join(starts_of, ["shard", "chunk"]).groupBy("shard", "chunk").applyInPandas(_walk_fn(idle_ms), WALK_SCHEMA)
    # Ticks before a shard's first event project from offset 0.
    zero = F.lit(0).cast("long")
    before = starts.where((F.col("i") == 0) & (F.col("first_n") >= 1)).select(
        "shard", F.lit(-1).cast("long").alias("_n"), zero.alias("d_start"), zero.alias("d_first"),
        F.lit(1).cast("long").alias("tick_lo"), F.col("first_n").alias("tick_hi"), zero.alias("tick_d"))
    return folded.unionByName(before)


def projected_clock(reals: DataFrame, idle_ms: int, shard: str = "shard",
                    extra_ticks: int = 0, parts: int | None = None, origin_ms: int = 0) -> DataFrame:
    """Every real event and heartbeat of each shard with the projected time
    ``s2`` after it, the offset ``d`` after it and ``reanchored`` (0/1).

    Input columns: ``shard, seq, p, t, key, value``. ``origin_ms`` is the
    arrival time at which the heartbeat source starts; a row that arrived
    earlier fails the job (``day_origin`` gives an origin that fits).
    Heartbeats get ``seq = -n``, ``t = n*I``, ``p = origin + n*I``.
    ``parts`` is how many tasks rows and intervals are dealt over.
    """
    _check(idle_ms)
    band = REANCHOR_INTERVALS * idle_ms
    r = reals.select(F.col(shard).alias("shard"), "seq", arrival_since(origin_ms).alias("p"), "t", "key", "value") \
             .withColumn("_n", F.floor(F.col("p") / idle_ms).cast("long"))
    r = _interval_scan(r, band, parts)
    # One row of an interval has no row before.
    jump = F.when(F.abs(F.col("t") - F.col("_prev")) >= band, F.col("t") - F.col("_prev")).otherwise(F.lit(0).cast("long"))
    intervals = r.groupBy("shard", "_n").agg(F.max(F.when(F.col("_prev").isNull(), F.col("t"))).alias("t1"), F.sum(jump).alias("J"))
    folded = stage(_folded(intervals, idle_ms, extra_ticks, parts), "clock-fold")

    per = folded.filter(F.col("_n") >= 0).select("shard", "_n", "d_start", "d_first")
    j = r.join(per, on=["shard", "_n"], how="inner")
    gap = F.col("t") - F.coalesce("_prev", F.col("d_start") + F.col("_n") * idle_ms)
    real_out = j.select("shard", "seq", (F.col("p") + origin_ms).alias("p"), "t", F.lit(True).alias("is_real"), "key", "value",
                        F.col("t").alias("s2"), (F.col("d_first") + F.col("_cum")).alias("d"),
                        (F.abs(gap) >= band).cast("int").alias("reanchored"))

    ticks = _explode_range(folded, "tick_lo", "tick_hi", "n")
    tick_out = ticks.select("shard", (-F.col("n")).alias("seq"), (F.col("n") * idle_ms + origin_ms).alias("p"),
                            (F.col("n") * idle_ms).alias("t"), F.lit(False).alias("is_real"),
                            F.lit(DEFAULT_KEY).alias("key"), F.lit(DEFAULT_VALUE).alias("value"),
                            (F.col("tick_d") + F.col("n") * idle_ms).alias("s2"),
                            F.col("tick_d").alias("d"), F.lit(0).alias("reanchored"))
    return real_out.unionByName(tick_out)
