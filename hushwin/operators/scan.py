"""Ordered scans within a partition key that never put one key in one task.

A running maximum, running sum, row number or previous value over
``partitionBy(shard).orderBy(arrival)`` is the natural way to write a
watermark or a gap test, but it sends every row of a shard to one task, and
a hot shard may hold a third of all rows. Here the rows are dealt by range
instead:

1. ``repartitionByRange`` on (key, order). Spark samples the data for the
   boundaries, so a hot key, or a burst of one instant, is cut into as many
   parts as its rows need; the order ends with a unique tie-breaker, so any
   two rows can be parted.
2. One pass over each sorted part, in Arrow batches, adds the local scan
   columns. A *segment* is the rows of one key in one part. The result is
   written once (``hushwin.plans.stage``).
3. Only a key that crosses from one part into the next needs a carry, and
   only a part's first segment can receive one. The ends of each part's
   first and last segment, two rows a part, go to the driver, which adds
   them up; the carries, at most one row a part, are broadcast back.

One exchange of the rows, whatever is computed, at every size. The part
count is ``spark.sql.shuffle.partitions`` unless given.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushwin.plans.stage import stage

#: Columns that the pass adds.
PART, SEGMENT, LOCAL, PREVIOUS, HEAD, EDGE = "_part", "_segment", "_local", "_previous", "_head", "_edge"
_ADDED = T.StructType([T.StructField(SEGMENT, T.LongType()), T.StructField(LOCAL, T.LongType()),
                       T.StructField(PREVIOUS, T.LongType()), T.StructField(HEAD, T.LongType()), T.StructField(EDGE, T.BooleanType())])
#: A running maximum before any row.
_LOWEST = np.iinfo(np.int64).min

Step = Callable[[np.ndarray], np.ndarray]


def part_count(spark: SparkSession, parts: int | None = None) -> int:
    if parts is not None and parts <= 0:
        raise ValueError("parts must be > 0")
    return parts or int(spark.conf.get("spark.sql.shuffle.partitions"))


def _segment_sum(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Running sums of ``x`` that begin anew at every row of ``start``."""
    total = np.cumsum(x)
    heads = np.flatnonzero(start)
    return total - np.repeat(total[heads] - x[heads], np.diff(np.append(heads, len(x))))


def _segment_max(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Running maxima of ``x`` that begin anew at every row of ``start``."""
    heads = np.flatnonzero(start)
    low, high = int(x.min()), int(x.max())
    if (high - low + 1) * len(heads) < 1 << 62:      # later segments lifted above earlier ones
        lift = (np.cumsum(start) - 1) * (high - low + 1)
        return np.maximum.accumulate(x - low + lift) - lift + low
    return np.concatenate([np.maximum.accumulate(p) for p in np.split(x, heads[1:])])


class _Pass:
    """The local pass over one sorted part, batch by batch."""

    def __init__(self, keys: list[int], value: int | None, kind: str, step: Step | None):
        self.keys, self.value, self.kind, self.step = keys, value, kind, step
        self.last: pa.RecordBatch | None = None      # the row before
        self.segment, self.local, self.value_before, self.head = -1, 0, 0, 0

    def _changes(self, rows: pa.RecordBatch) -> np.ndarray:
        """Whether each row after the first has another key than the one before it."""
        out = np.zeros(rows.num_rows - 1, bool)
        for k in self.keys:
            codes = rows.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            out |= codes[1:] != codes[:-1]
        return out

    def rows(self, body: pa.RecordBatch, following: pa.RecordBatch | None) -> list[pa.Array]:
        """The added columns of ``body``; ``following`` is the row after it."""
        n = body.num_rows
        near = [b for b in (self.last, body, following) if b is not None]
        changes = self._changes(_joined(near))
        first = self.last is None
        start = np.concatenate(([True], changes[:n - 1])) if first else changes[:n]
        end = np.append(changes, True)[-n:] if following is None else changes[-n:]
        segment = self.segment + np.cumsum(start)
        v = np.ones(n, np.int64) if self.value is None else body.column(self.value).cast(pa.int64()).to_numpy(zero_copy_only=False).astype(np.int64)
        begin = start.copy()
        begin[0] = True
        carried = not start[0]
        if self.kind == "max":
            x = v.copy()
            if carried:
                x[0] = max(x[0], self.local)
            local = _segment_max(x, begin)
            before = np.concatenate(([self.local], local[:-1]))
        else:
            before = np.concatenate(([self.value_before], v[:-1]))
            x = v if self.step is None else np.where(start, 0, self.step(v - before))
            x = x.astype(np.int64)
            if carried:
                x[0] += self.local
            local = _segment_sum(x, begin)
        heads = np.flatnonzero(begin)
        head = np.repeat(np.concatenate(([self.head if carried else v[0]], v[heads[1:]])), np.diff(np.append(heads, n)))
        edge = end & (segment == 0)
        edge[-1] |= following is None
        self.last, self.segment, self.local, self.value_before, self.head = body.slice(n - 1), int(segment[-1]), int(local[-1]), int(v[-1]), int(head[-1])
        return [pa.array(segment), pa.array(local), pa.array(before, mask=start), pa.array(head), pa.array(edge)]


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(batches) == 1:
        return batches[0]
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _scanned(df: DataFrame, part: Sequence[str], order: Sequence[Column], kind: str, value: str | None, step: Step | None, parts: int | None) -> DataFrame:
    """The rows, dealt and staged, with the local columns and the part."""
    names = df.columns
    keys, at = [names.index(k) for k in part], None if value is None else names.index(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local, tail, schema = _Pass(keys, at, kind, step), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _joined([batch] if tail is None else [tail, batch])
            body, tail, schema = rows.slice(0, rows.num_rows - 1), rows.slice(rows.num_rows - 1), schema or [*rows.schema.names, *_ADDED.names]
            if body.num_rows:
                yield pa.RecordBatch.from_arrays([*body.columns, *local.rows(body, tail)], names=schema)
        if tail is not None:
            yield pa.RecordBatch.from_arrays([*tail.columns, *local.rows(tail, None)], names=schema)

    by = [*[F.col(k) for k in part], *order]
    dealt = df.repartitionByRange(part_count(df.sparkSession, parts), *by).sortWithinPartitions(*by).withColumn(PART, F.spark_partition_id())
    return stage(dealt.mapInArrow(run, T.StructType([*dealt.schema.fields, *_ADDED.fields])), "scanned")


def _carries(rows: DataFrame, part: Sequence[str], kind: str, value: str | None, step: Step | None) -> list[tuple[int, int, int]]:
    """(part, carry, value before) of every part whose first key began in an earlier part."""
    last = F.lit(0).cast("long") if value is None else F.col(value).cast("long")
    ends = rows.where(EDGE).select(F.col(PART), SEGMENT, HEAD, LOCAL, last.alias("_last"), F.struct(*part).alias("_key") if part else F.lit(0).alias("_key")).collect()
    out, key, total, before = [], None, 0, 0
    for e in sorted(ends, key=lambda e: (e[PART], e[SEGMENT])):
        if e[SEGMENT] > 0 or e["_key"] != key or key is None:
            total, carry = (_LOWEST if kind == "max" else 0), None
        else:
            carry = total
            if step is not None:
                carry += int(step(np.array([e[HEAD] - before]))[0])
            out.append((e[PART], carry, before))
        own = e[LOCAL]
        total = max(total, own) if kind == "max" else (carry if carry is not None else 0) + own
        key, before = e["_key"], e["_last"]
    return out


def _finished(rows: DataFrame, carries: list[tuple[int, int, int]]) -> DataFrame:
    """Adds ``_carry`` and ``_before`` (null where a segment has no earlier one)."""
    carry = rows.sparkSession.createDataFrame(carries, "_c_part int, _carry long, _before long")
    return rows.join(F.broadcast(carry), (F.col(PART) == F.col("_c_part")) & (F.col(SEGMENT) == 0), "left")


def _scan(df, part, order, kind, value, step, parts, columns: dict[str, Column]) -> DataFrame:
    part, order = list(part), [F.col(c) if isinstance(c, str) else c for c in order]
    rows = _scanned(df, part, order, kind, value, step, parts)
    done = _finished(rows, _carries(rows, part, kind, value, step))
    return done.select(*df.columns, *[c.alias(name) for name, c in columns.items()])


def running_max(df: DataFrame, part: Sequence[str], order: Sequence, value: str, out: str,
                inclusive: bool = True, parts: int | None = None) -> DataFrame:
    """``max(value)`` over the rows up to this one (or strictly before it).
    ``value`` is a long column without nulls."""
    return _scan(df, part, order, "max", value, None, parts, {out: F.greatest(LOCAL if inclusive else PREVIOUS, "_carry")})


def running_sum(df: DataFrame, part: Sequence[str], order: Sequence, value: str, out: str, parts: int | None = None) -> DataFrame:
    """``sum(value)`` over the rows up to this one."""
    return _scan(df, part, order, "sum", value, None, parts, {out: F.col(LOCAL) + F.coalesce("_carry", F.lit(0))})


def row_number(df: DataFrame, part: Sequence[str], order: Sequence, out: str, parts: int | None = None) -> DataFrame:
    """1-based position of each row within its key."""
    return _scan(df, part, order, "sum", None, None, parts, {out: F.col(LOCAL) + F.coalesce("_carry", F.lit(0))})


def steps(df: DataFrame, part: Sequence[str], order: Sequence, value: str, step: Step, total: str,
          previous: str | None = None, parts: int | None = None) -> DataFrame:
    """``previous``: the value of the row before within the key (null for its
    first row). ``total``: the sum of ``step(value - previous)`` over the
    rows up to this one, the first counting 0. ``step`` maps an array of
    differences to an array of whole numbers."""
    columns = {total: F.col(LOCAL) + F.coalesce("_carry", F.lit(0))}
    if previous:
        columns[previous] = F.coalesce(PREVIOUS, "_before")
    return _scan(df, part, order, "sum", value, step, parts, columns)
