"""Importance resampling towards a target distribution.

Documents and target texts become counts of hashed word features. A
bucket's gain is the log ratio of its smoothed shares in target and corpus;
a document's weight is the mean gain of its features, looked up in one
array. Weight plus seeded Gumbel noise is the score, and the highest scores
are a sample without replacement in proportion to exp(weight).

The draw never sorts the corpus: the scores are persisted, repeated exact
counts bisect the score at the cutoff, then the tied doc_ids, and only the
drawn rows are dealt by range and ranked.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushwin.llm.common import staged, text_slices, words

BUCKETS = 10_000
NGRAM = 1
MIN_WORDS = 20
DRAW_PCT = 10
SEED = 2024

#: Per byte: A-Z to a-z, digits, a-z and bytes above ASCII as they are, all else to a blank.
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x30:0x3A] = np.arange(0x30, 0x3A)
_FOLD[0x61:0x7B] = _FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def folded(texts: pa.Array, table: np.ndarray = _FOLD) -> pa.Array:
    """``texts`` with every byte replaced by ``table``; a null text is empty."""
    texts = pc.fill_null(texts, "")
    if not len(texts):
        return texts
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(ends - ends[0])), pa.py_buffer(table[data]))


def feature_buckets(texts: pa.Array, n: int = NGRAM, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, bucket, n_words): the features of text ``i``, all runs of 1
    to ``n`` words, have the buckets ``bucket[starts[i]:starts[i + 1]]``."""
    at, values = words(folded(texts))
    coded = values.dictionary_encode()
    each = coded.dictionary.to_pylist()
    index = coded.indices.to_numpy(zero_copy_only=False) if len(values) else np.zeros(0, np.int32)
    count = np.diff(at)
    owner = np.repeat(np.arange(len(count)), count)
    found, owners = [], []
    single = np.array([zlib.crc32(w.encode()) % buckets for w in each], np.int64)
    found.append(single[index] if len(index) else np.zeros(0, np.int64))
    owners.append(owner)
    for k in range(2, n + 1):
        heads = np.flatnonzero(owner[:len(owner) - k + 1] == owner[k - 1:]) if len(owner) >= k else np.zeros(0, np.int64)
        runs = [" ".join(each[j] for j in index[h:h + k]) for h in heads]
        found.append(np.array([zlib.crc32(r.encode()) % buckets for r in runs], np.int64))
        owners.append(owner[heads])
    owner_all = np.concatenate(owners)
    order = np.argsort(owner_all, kind="stable") if n > 1 else slice(None)
    starts = np.concatenate(([0], np.cumsum(np.bincount(owner_all, minlength=len(count)))))
    return starts, np.concatenate(found)[order], count


def bucket_counts(docs: DataFrame, n: int = NGRAM, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all rows' ``text`` fall in each bucket. A task
    adds up one array; ``buckets`` numbers a task are shuffled, ``buckets``
    rows reach the driver, whatever the corpus."""
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in text_slices(batches, 0):
            total += np.bincount(feature_buckets(batch.column(0), n, buckets)[1], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], names=["bucket", "n"])

    rows = (docs.select(F.col("text").cast("string")).mapInArrow(run, "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).collect())
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket floor(1000 * ln of the ratio of smoothed shares)."""
    k = len(corpus)
    s, t = corpus.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, n: int = NGRAM) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row."""
    def run(batches):
        for batch in text_slices(batches, 1):
            starts, bucket, n_words = feature_buckets(batch.column(1), n, len(gain))
            total = np.concatenate(([0], np.cumsum(gain[bucket])))
            count = np.diff(starts)
            weight = np.where(count > 0, (total[starts[1:]] - total[starts[:-1]]) // np.maximum(count, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n_words, count, weight))],
                                             names=["doc_id", "n_words", "n_features", "weight"])

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(run, "doc_id long, n_words long, n_features long, weight long"))


def noise(seed: int = SEED) -> Column:
    """floor(1000 * Gumbel noise) from the id's hash; a null id has the text ``null``."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def highest_cut(rows: DataFrame, column: str, want: int) -> tuple[int, int]:
    """(cut, above): the greatest value of the long ``column`` that at least
    ``want`` rows reach (1 <= want <= rows), and how many rows are above it.
    Every step halves the interval by one exact count of the persisted rows."""
    least, most = rows.agg(F.min(column), F.max(column)).first()
    above = 0
    while least < most:
        middle = least + (most - least + 1) // 2
        reach = rows.where(F.col(column) >= middle).count()
        if reach >= want:
            least = middle
        else:
            most, above = middle - 1, reach
    return least, above


def draw(scored: DataFrame, want: int) -> tuple[Column, list[Column]]:
    """(drawn, order): the condition that ``want`` rows of the persisted
    ``scored`` meet, and the order they are ranked in: falling score, then
    rising doc_id (null last), then ``row``, which is unique."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc()]
    able = F.col("able")
    if want <= 0:
        return F.lit(False), order
    cut, above = highest_cut(scored.where(able), "score", want)
    # Falling keys, so that each tie is cut the same way as the score.
    ties = scored.where(able & (F.col("score") == cut))
    taken, left = F.col("score") > cut, want - above
    at = F.col("score") == cut
    by_id = ties.where("doc_id is not null").withColumn("key", -F.col("doc_id") - 1)
    n_ids = by_id.count()
    if left >= n_ids:
        taken, left, at = taken | (at & F.col("doc_id").isNotNull()), left - n_ids, at & F.col("doc_id").isNull()
    else:
        key, over = highest_cut(by_id, "key", left)
        taken, left, at = taken | (at & (F.col("doc_id") < -key - 1)), left - over, at & (F.col("doc_id") == -key - 1)
    if left > 0:
        row, _ = highest_cut(scored.where(able & at).withColumn("key", -F.col("row") - 1), "key", left)
        taken = taken | (at & (F.col("row") <= -row - 1))
    return able & F.coalesce(taken, F.lit(False)), order


def ranked(rows: DataFrame, order: list[Column], parts: int) -> DataFrame:
    """``rows`` with ``rank`` (1, 2, ..) in the total ``order``: dealt by
    range, sorted within each part, each part's places moved by the rows
    before it. Only one count a part is summed in one place."""
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    dealt = staged(dealt, "drawn").withColumn("part", F.shiftright("place", 33)).withColumn("place", F.col("place").bitwiseAND((1 << 33) - 1))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return dealt.join(starts, "part").withColumn("rank", F.col("start") + F.col("place") + 1).drop("part", "place", "start")


def resample(docs: DataFrame, target: DataFrame, pct: int = DRAW_PCT, min_words: int = MIN_WORDS,
             n: int = NGRAM, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null if not drawn) of every row.

    Of the rows with ``min_words`` words, ``pct`` percent, rounded down, are
    drawn. A null text has no words; null ids share one draw of noise and
    come last among ties; repeated rows are rows of their own, and of rows
    equal in all of this as many are drawn as fit. Empty tables: no rows, or
    gains from the other side's counts alone."""
    spark = docs.sparkSession
    gain = gains(bucket_counts(docs, n, buckets), bucket_counts(target, n, buckets))
    scored = staged(weigh(docs, gain, n).withColumn("score", F.col("weight") + noise(seed))
                    .select("doc_id", "n_features", "weight", "score", (F.col("n_words") >= min_words).alias("able"),
                            F.monotonically_increasing_id().alias("row")), "scored")
    drawn, order = draw(scored, pct * scored.where("able").count() // 100)
    columns = ["doc_id", "n_features", "weight", "score"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    top = ranked(scored.where(drawn), order, parts).select(*columns, F.col("rank").cast("long").alias("rank"))
    return top.union(scored.where(~drawn).select(*columns, F.lit(None).cast("long")))
