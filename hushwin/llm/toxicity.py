"""Toxicity by maximum-scoring segments.

Token log-odds between toxic and clean labelled documents, with an
informative Dirichlet prior, score every word; a word that carries no
evidence costs a little. One linear scan (all maximal scoring
subsequences) finds the passages; extreme-value statistics of clean
documents turn a passage's score and the text's length into the number of
such passages expected by chance, and a logistic curve over the evidence
of all significant passages gives the document's probability.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushwin.llm.common import crc32_mod, staged, text_slices, words

#: Labelled rows to learn from, in expectation (a seeded hash of id and text picks them).
SAMPLE = 20_000
#: Tokens kept in the model, by evidence, the least evidence (z-score) and documents.
MAX_TOKENS = 5_000
MIN_Z = 3.0
MIN_DOCS = 5
PRIOR = 500.0        # Dirichlet prior mass, spread like the whole sample's tokens,
PRIOR_EACH = 0.5     # and some for each token, so that one never seen in clean text is not certain
WORD_COST = 0.6      # of every word; keeps the expected score of clean text below zero
STEM = 5             # words without evidence of their own fall back to their first letters
FOLDS, HELD_OUT = 5, 0

_TRIM = ".,;:!?|\"'()[]{}<>#$%&*"


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(starts, codes, dictionary) of the lower-cased, trimmed words."""
    at, values = words(pc.utf8_lower(texts))
    coded = pc.utf8_trim(values, _TRIM).dictionary_encode()
    return at, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def stems(dictionary: pa.Array) -> pa.Array:
    """First letters of words longer than those, marked by a star; null for shorter words."""
    long = pc.greater(pc.utf8_length(dictionary), STEM)
    return pc.if_else(long, pc.binary_join_element_wise(pc.utf8_slice_codeunits(dictionary, 0, STEM), "*", ""), None)


def _token_counts(labelled: DataFrame) -> DataFrame:
    """(token, a, b, docs): uses of a word, or of a stem, in toxic and in
    clean documents, and the documents that hold it."""
    def run(batches):
        for batch in text_slices(batches, 0):
            at, codes, dictionary = tokens(batch.column(0))
            if not len(codes):
                continue
            doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)[doc]
            coded = stems(dictionary).dictionary_encode()
            stem_of = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
            for names, code in ((dictionary, codes), (coded.dictionary, stem_of[codes])):
                known, size = code >= 0, len(names)
                if size:
                    pair = np.unique(doc[known] * size + code[known])
                    yield pa.RecordBatch.from_arrays(
                        [names, pa.array(np.bincount(code[known & toxic], minlength=size)), pa.array(np.bincount(code[known & ~toxic], minlength=size)),
                         pa.array(np.bincount(pair % size, minlength=size))], names=["token", "a", "b", "docs"])

    each = labelled.select("text", "toxic").mapInArrow(run, "token string, a long, b long, docs long")
    return each.where("token != ''").groupBy("token").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("docs").alias("docs"))


def maximal_segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring subsequences as (first, end, score), in order.

    One pass over the positive places: a new segment joins earlier ones as
    far back as a segment began lower and ended lower, else it stands."""
    total = np.concatenate(([0.0], np.cumsum(score)))
    found: list[tuple[float, float, int, int, int]] = []     # (sum before, sum at end, first, end, nearest earlier one that began lower)
    for at in np.flatnonzero(score > 0):
        low, high, first, end = total[at], total[at + 1], int(at), int(at) + 1
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= low:
                j = found[j][4]
            if j < 0 or found[j][1] >= high:
                found.append((low, high, first, end, j))
                break
            low, first = found[j][0], found[j][2]
            del found[j:]
    return [(first, end, float(high - low)) for low, high, first, end, _ in found]


class Model:
    """Token scores, extreme-value constants and the final curve."""

    def __init__(self, scores: dict[str, float]):
        self.names = list(scores)
        self.values = np.array([scores[x] for x in self.names] + [0.0])
        self.rate, self.scale = 1.0, 1.0
        self.curve = (0.0, 0.0)

    def word_scores(self, dictionary: pa.Array) -> np.ndarray:
        known = pa.array(self.names, pa.string())
        exact = pc.fill_null(pc.index_in(dictionary, known), -1).to_numpy(zero_copy_only=False)
        stem = pc.fill_null(pc.index_in(stems(dictionary), known, skip_nulls=True), -1).to_numpy(zero_copy_only=False)
        return self.values[np.where(exact >= 0, exact, stem)] - WORD_COST

    def passages(self, texts: pa.Array):
        """Per text: (words, maximal segments)."""
        at, codes, dictionary = tokens(texts)
        score = self.word_scores(dictionary)[codes] if len(codes) else np.zeros(0)
        positive = np.concatenate(([0], np.cumsum(score > 0)))
        for a, b in zip(at[:-1], at[1:]):
            yield int(b - a), maximal_segments(score[a:b]) if positive[b] > positive[a] else []

    def evidence(self, n: int, score: float) -> float:
        """Minus the log of the passages this good expected by chance in n words; 0 if one or more are."""
        return max(0.0, self.rate * score - math.log(max(self.scale * n, 1e-12)))

    def probability(self, evidence: float) -> float:
        z = self.curve[0] + self.curve[1] * math.log1p(evidence)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _rate(scores: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum(share * exp(rate * score)) = 1."""
    grown = lambda r: float(np.sum(share * np.exp(np.minimum(r * scores, 50)))) - 1
    low, high = 1e-6, 1.0
    while grown(high) < 0 and high < 50:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if grown(mid) < 0 else (low, mid)
    return max(high, 0.05)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Bias and slope by Newton's method with a small ridge."""
    design, w = np.stack((np.ones_like(x), x), 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        g = design.T @ (y - p) - 0.1 * w
        h = (design * (p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2)
        step = np.linalg.solve(h, g)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(max(w[1], 0.0))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic) of about ``sample`` rows with a labelled id outside the
    held-out fold, equal texts once. Rows are picked by a hash of id and
    text, so an id that many rows share brings its part of them."""
    own = (labels.select("doc_id", "toxic").where((crc32_mod("doc_id", FOLDS) != HELD_OUT) & F.col("toxic").isNotNull())
           .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    able = docs.select("doc_id", "text").where("text is not null and doc_id is not null")
    # Ids alone are counted before, so that a shared one is a row a task.
    total = able.groupBy("doc_id").agg(F.count("*").alias("n")).join(own, "doc_id").agg(F.sum("n")).first()[0] or 0
    share = min(1.0, sample / max(total, 1))
    place = F.pmod(F.xxhash64("doc_id", "text", F.lit("toxicity")), F.lit(1 << 62))
    return able.where(place < int(share * (1 << 62))).join(own, "doc_id").select("text", "toxic").distinct()


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from labelled rows only; the driver sees ``MAX_TOKENS`` token
    counts and four numbers for each sampled text."""
    rows = staged(training_rows(docs, labels, sample), "toxic-sample")
    counts = staged(_token_counts(rows), "toxic-counts")
    totals = counts.where(~F.col("token").endswith("*")).agg(F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    big_a, big_b = float(totals[0]), float(totals[1])
    if not big_a or not big_b:                   # one class only: nothing to tell apart
        return Model({})
    alpha = F.lit(PRIOR_EACH) + F.lit(PRIOR) * (F.col("a") + F.col("b")) / (big_a + big_b)
    odds = lambda y, n: F.log((F.col(y) + alpha) / (n + PRIOR - F.col(y) - alpha))
    z = F.col("odds") / F.sqrt(1 / (F.col("a") + alpha) + 1 / (F.col("b") + alpha))
    best = (counts.withColumn("odds", odds("a", big_a) - odds("b", big_b)).withColumn("z", z)
            .where((F.col("z") >= MIN_Z) & (F.col("docs") >= MIN_DOCS)).orderBy(F.col("z").desc(), "token").limit(MAX_TOKENS).collect())
    model = Model({r.token: min(r.odds, 6.0) for r in best})
    share = np.array([(r.b + 0.5) / big_b for r in best] + [0.0])
    share[-1] = max(1e-9, 1 - share.sum())
    model.rate = _rate(np.append(model.values[:-1], 0.0) - WORD_COST, share)
    clean = [(n, s) for toxic, n, s, _ in _score_sample(rows, model) if not toxic]
    model.scale = (len(clean) + 1) / (sum(max(n, 1) * math.exp(-model.rate * s) for n, s in clean) + 1)
    seen = _score_sample(rows, model)
    model.curve = _logistic(np.array([math.log1p(e) for *_, e in seen]), np.array([float(t) for t, *_ in seen]))
    return model


def _score_sample(rows: DataFrame, model: Model) -> list[tuple[int, int, float, float]]:
    """(toxic, words, best segment, evidence of all segments) of each sampled text."""
    def run(batches):
        for batch in text_slices(batches, 0):
            found = list(model.passages(batch.column(0)))
            best = [max((s for _, _, s in segments), default=0.0) for _, segments in found]
            evidence = [sum(model.evidence(n, s) for _, _, s in segments) for n, segments in found]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([n for n, _ in found], pa.int64()), pa.array(best, pa.float64()), pa.array(evidence, pa.float64())],
                                             names=["toxic", "n", "best", "evidence"])

    return [tuple(r) for r in rows.select("text", "toxic").mapInArrow(run, "toxic int, n long, best double, evidence double").collect()]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and every significant passage (word positions, score,
    evidence). Whole texts; a null or empty text has no passage and gets the
    curve's score for none. Repeated rows are scored alike."""
    def run(batches):
        for batch in text_slices(batches, 1):
            p, passages = [], []
            for n, segments in model.passages(batch.column(1)):
                each = [(a, b, s, model.evidence(n, s)) for a, b, s in segments]
                each = [x for x in each if x[3] > 0]
                p.append(model.probability(sum(x[3] for x in each)))
                passages.append([{"first_word": a, "end_word": b, "score": s, "evidence": e} for a, b, s, e in each])
            kind = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("score", pa.float64()), ("evidence", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array(passages, kind)], names=["doc_id", "score", "passages"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))).mapInArrow(
        run, "doc_id long, score double, passages array<struct<first_word: long, end_word: long, score: double, evidence: double>>")


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``score`` with held_out and predicted; a null doc_id is not held out."""
    scored = score(docs, fit(docs, labels, sample))
    held_out = F.coalesce(crc32_mod("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")
