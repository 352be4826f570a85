"""Shared helpers: table loading, shared stage folder, word arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushwin.plans.stage import scope, stage

__all__ = ["WORD", "crc32_mod", "runs", "scope", "staged", "table", "text_slices", "words"]

#: Java and RE2 pattern of a word: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Text bytes that one numpy step takes at most, unless a single text is longer.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str, keep: bool = False, by: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and
    later steps do not depend on the executors that computed it. Inside a
    ``scope`` the folder goes when the scope ends (``keep``: when the one
    around it does)."""
    return stage(df, name, "llm", keep, by)


def crc32_mod(id_col: str, m: int) -> Column:
    """crc32 of the id as decimal text, modulo ``m`` (null id: null)."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(m))


def text_slices(batches, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of Arrow batches with at most ``limit`` bytes of
    text in ``column``, or one row, so that memory does not follow the
    number of long texts in a batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        end = np.cumsum(size, dtype=np.int64)
        at, done = 0, 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(end, done + limit, "right")))
            yield batch.slice(at, to - at)
            at, done = to, int(end[to - 1])


def words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array]:
    """(starts, values): the words of text ``i`` are
    ``values[starts[i]:starts[i + 1]]``; a null text has none. ``lower``
    lower-cases A-Z only."""
    if lower:
        texts = pc.ascii_lower(texts)
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(texts)
    values, at = lists.flatten(), lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    at = at - at[0]
    full = pc.greater(pc.binary_length(values), 0)
    before = np.zeros(len(values) + 1, np.int64)
    np.cumsum(full.to_numpy(zero_copy_only=False), out=before[1:])
    return before[at], values.filter(full)


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, .., of every run, one after another."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
