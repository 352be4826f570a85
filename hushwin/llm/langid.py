"""Language identification by rank-order profiles.

A profile is a list of the most frequent letter n-grams (one to three, of
words padded by a space). A document's profile is compared with each
language's by out-of-place distance: the sum over its n-grams of how far
their rank is from the language's, or the list length where missing.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hushwin.llm.common import crc32_mod, text_slices

PROFILE = 400
#: Training documents per language, in expectation (a seeded hash of the id picks them).
SAMPLE = 3_000
#: Values of ``lang`` that are learned as languages, those with most documents.
MAX_LANGS = 500
FOLDS, HELD_OUT = 4, 2
_BITS = np.uint64(21)


@functools.lru_cache(1)
def _letters() -> np.ndarray:
    """For every code point, itself if a letter, else 0 (a word boundary)."""
    return np.array([c if chr(c).isalpha() else 0 for c in range(0x110000)], np.uint32)


def gram_keys(text: str) -> np.ndarray:
    """The text's n-grams as numbers; 0 stands for a word boundary."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    c = np.concatenate(([0], _letters()[points], [0])).astype(np.uint64)
    c = c[np.concatenate(([True], (c[1:] != 0) | (c[:-1] != 0)))]       # one boundary between words
    one = c[c != 0]
    two = (c[:-1] << _BITS | c[1:]) | np.uint64(1) << np.uint64(63)
    x, y, z = c[:-2], c[1:-1], c[2:]
    three = (x << (_BITS + _BITS) | y << _BITS | z)[y != 0]
    # Single letters lie below 2**21; pairs carry the top bit; triples lie between, as their middle is never 0.
    return np.concatenate((one, two[: len(c) - 1 if len(one) else 0], three + np.uint64(1 << 21)))


def ranked(keys: np.ndarray, n: int = PROFILE) -> np.ndarray:
    """The ``n`` most frequent keys, most frequent first, ties to the lesser key."""
    distinct, count = np.unique(keys, return_counts=True)
    if len(distinct) > n:
        least = np.partition(count, len(count) - n)[len(count) - n]
        keep = count >= least
        distinct, count = distinct[keep], count[keep]
    return distinct[np.lexsort((distinct, -count))][:n]


def profiles(docs: DataFrame, sample: int = SAMPLE, size: int = PROFILE) -> dict[str, np.ndarray]:
    """Language to ranked n-grams. Learned from text and lang of a bounded
    sample of each language's documents outside the held-out fold, equal
    texts once. The ``MAX_LANGS`` values of lang with most documents are
    languages; the driver receives ``size`` n-grams for each."""
    own = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(crc32_mod("doc_id", FOLDS) != HELD_OUT, F.lit(True)))
    totals = own.groupBy("lang").agg(F.count("*").alias("total")).orderBy(F.col("total").desc(), "lang").limit(MAX_LANGS).collect()
    totals = docs.sparkSession.createDataFrame([tuple(r) for r in totals], "its_lang string, total long")
    # Rows that share an id, or have none, have places of their own.
    place = F.pmod(F.xxhash64("doc_id", "text", F.lit("langid")), F.lit(1 << 40)) / (1 << 40)
    # One number for each of at most MAX_LANGS languages: texts stay where they are. Equal texts, which share a place, are combined in each task.
    picked = own.join(F.broadcast(totals), F.col("lang") == F.col("its_lang")).where(place * F.col("total") < sample).select("lang", "text").distinct()

    def run(batches):
        for batch in text_slices(batches, 1):
            by_lang: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_lang.setdefault(lang, []).append(gram_keys(text))
            for lang, keys in by_lang.items():
                distinct, count = np.unique(np.concatenate(keys), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(distinct), pa.string()), pa.array(distinct.view(np.int64)), pa.array(count, pa.int64())], names=["lang", "gram", "n"])

    counts = picked.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # Unsigned order, as in a document's own ranking.
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), F.col("gram") < 0, F.col("gram"))
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).collect()
    out: dict[str, np.ndarray] = {}
    for r in sorted(top, key=lambda r: (r.lang, r.rank)):
        out.setdefault(r.lang, []).append(r.gram)
    return {lang: np.array(grams, np.int64).view(np.uint64) for lang, grams in out.items()}


class RankModel:
    def __init__(self, by_lang: dict[str, np.ndarray], size: int = PROFILE):
        self.size, self.langs = size, sorted(by_lang)
        self.vocabulary = np.unique(np.concatenate([by_lang[x] for x in self.langs])) if by_lang else np.zeros(0, np.uint64)
        self.rank = np.full((len(self.langs), len(self.vocabulary) + 1), -1, np.int64)
        for i, lang in enumerate(self.langs):
            self.rank[i, np.searchsorted(self.vocabulary, by_lang[lang])] = np.arange(len(by_lang[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): the nearest profile, ties to the first in code
        point order; the score is the share of the greatest distance that is
        not used up. Without a letter, or without profiles: und, 0."""
        keys = gram_keys(text or "")
        if not len(keys) or not self.langs:
            return "und", 0.0
        top = ranked(keys, self.size)
        at = np.searchsorted(self.vocabulary, top)
        at = np.where((at < len(self.vocabulary)) & (self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] == top), at, len(self.vocabulary))
        rank = self.rank[:, at]
        apart = np.where(rank < 0, self.size, np.abs(rank - np.arange(len(top))))
        distance = apart.sum(1)
        best = int(np.argmin(distance))
        return self.langs[best], float(1 - distance[best] / (self.size * len(top)))


def identify(docs: DataFrame, by_lang: dict[str, np.ndarray] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row, from whole texts.
    A null doc_id is not held out; repeated rows are judged alike."""
    model = RankModel(profiles(docs) if by_lang is None else by_lang)

    def run(batches):
        for batch in text_slices(batches, 1):
            found = [model.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                                             names=["doc_id", "held_out", "lang_pred", "score"])

    held_out = F.coalesce(crc32_mod("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out.alias("held_out")).mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double")
