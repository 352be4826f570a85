"""Hashed maximum-entropy language model.

Every token has a unit: the most frequent ones their own, all others one
by a hash of their last letters. Units are dealt to classes, and the
softmax is factored: first the class, then the unit within its class, both
log-linear in hashed features of the three units before (each alone, the
nearest as an n-gram, the others as skips, and the nearest two together).
Within a unit, a token has its smoothed share of the unit's count, so the
probabilities of all known tokens and of an unknown one in every hashed
unit sum to one.

Training makes distributed gradient updates: the training documents are
dealt over steps by a hash, and each step adds up, over its documents, how
often each feature met each outcome and how often the model expected it.
The difference is the gradient of the log-likelihood; a step moves each
weight by the damped log ratio of the two (iterative scaling). All training
documents take part. The weights are a fixed number of parameters.

Token counts are exact and cover all training documents, whatever the
vocabulary: the counts of the most frequent tokens are broadcast, all
other tokens meet theirs in a join.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushwin.llm.common import staged, text_slices, words

SMOOTH = 0.1
#: The token after a text's last word; no word holds a line end.
END = "\n"
SIDE = 32                   # classes, and units a class
UNITS = SIDE * SIDE
OWN_CLASSES = 20            # classes of single tokens: the end (unit 0) and the most frequent ones
PAIR_ROWS = 4096            # hashed features of the two nearest units
ROWS = 3 * UNITS + PAIR_ROWS
UNIT_ROWS = 8192            # hashed features (unit before, class), for each place
UNIT_PLACES = 2             # places that the unit within a class looks at: the n-gram and the nearest skip
STEPS = 6
DAMPING = 0.35
PRIOR = 2.0                 # added to observed and expected counts
#: Tokens whose counts are broadcast, and their longest form; the others are joined.
COMMON = 200_000
COMMON_BYTES = 64
SLICE = 8 << 20
#: Tokens at a time: their outcome rows stay in a core's cache.
CHUNK = 1 << 13
#: Tokens whose observed counts are added at once.
SEEN = 1 << 18
#: Weight rows that are summed as one.
BLOCK = 1024


def token_counts(docs: DataFrame) -> DataFrame:
    """token, c: exact counts over all rows, the end token included."""
    def run(batches):
        for batch in text_slices(batches, 0, SLICE):
            _, values = words(batch.column(0), lower=True)
            found = values.value_counts()
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([found.field("values"), pa.array([END])]),
                                              pa.concat_arrays([found.field("counts"), pa.array([batch.num_rows], pa.int64())])], names=["token", "c"])

    return (docs.select(F.col("text").cast("string")).mapInArrow(run, "token string, c long")
            .groupBy("token").agg(F.sum("c").alias("c")))


def _hashed_units(tokens: pa.Array) -> np.ndarray:
    """The units of tokens without one of their own: the class from the last
    two letters, the place within it from the last four."""
    def codes(part: pa.Array, n: int) -> np.ndarray:
        coded = part.dictionary_encode()
        each = np.array([xxhash.xxh64_intdigest(w) % n for w in coded.dictionary.to_pylist()], np.int64)
        return each[coded.indices.to_numpy(zero_copy_only=False)] if len(part) else np.zeros(0, np.int64)

    row = codes(pc.utf8_slice_codeunits(tokens, -2), SIDE - OWN_CLASSES) + OWN_CLASSES
    return row * SIDE + codes(pc.utf8_slice_codeunits(tokens, -4), SIDE)


@dataclass
class Vocabulary:
    """The common tokens, most frequent first, with their counts; sums over
    the whole vocabulary. Bounded by ``COMMON`` tokens of ``COMMON_BYTES``."""

    tokens: pa.Array
    counts: np.ndarray
    total: int = 0
    size: int = 0
    unit_totals: np.ndarray = field(default_factory=lambda: np.zeros(UNITS))

    def units(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(unit, place among the common tokens or -1) of each token. The
        first places are own units after the end's, whatever place it has."""
        at = pc.fill_null(pc.index_in(tokens, self.tokens), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        unit = _hashed_units(tokens)
        own = (at >= 0) & (at < OWN_CLASSES * SIDE - 1)
        unit[own] = at[own] + 1
        unit[pc.equal(tokens, END).to_numpy(zero_copy_only=False)] = 0
        return unit, at


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The vocabulary of the staged ``counts``."""
    total, size = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = (counts.where(F.octet_length("token") <= COMMON_BYTES)
           .orderBy(F.col("c").desc(), "token").limit(COMMON).toArrow())
    voc = Vocabulary(pa.array(top.column("token").to_pylist(), pa.string()), np.array(top.column("c").to_pylist(), np.int64), total, size)
    shared = counts.sparkSession.sparkContext.broadcast(voc)

    def run(batches):
        for batch in batches:
            unit, _ = shared.value.units(batch.column(0))
            c = batch.column(1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(UNITS)), pa.array(np.bincount(unit, c, UNITS)),
                                              pa.array(np.bincount(unit, minlength=UNITS).astype(np.int64))], names=["unit", "c", "types"])

    sums = counts.select("token", "c").mapInArrow(run, "unit long, c double, types long").groupBy("unit").agg(F.sum("c"), F.sum("types")).collect()
    # One unknown token a hashed unit; a unit of its own has none.
    voc.unit_totals[OWN_CLASSES * SIDE:] = SMOOTH
    voc.unit_totals[:OWN_CLASSES * SIDE] = 1e-9
    for unit, c, types in sums:
        voc.unit_totals[unit] += c + SMOOTH * types
    voc.unit_totals[0] = max(voc.unit_totals[0], SMOOTH)
    return voc


def encode(docs: DataFrame, voc: Vocabulary, held_out: Column) -> DataFrame:
    """Per row: doc_id, held_out, step (of training; -1: none), n_tokens, units, the
    common tokens' number and sum of log10(c + SMOOTH), and every other
    token with its number in the text."""
    shared = docs.sparkSession.sparkContext.broadcast(voc)

    def run(batches):
        v = shared.value
        for batch in text_slices(batches, 3, SLICE):
            at, values = words(batch.column(3), lower=True)
            coded = values.dictionary_encode()
            tokens = pa.concat_arrays([coded.dictionary, pa.array([END])])
            unit, place = v.units(tokens)
            n = batch.num_rows
            ends = at[1:] + np.arange(n)                         # the end token follows each text's last word
            code = np.full(len(values) + n, len(tokens) - 1, np.int64)
            inside = np.ones(len(code), bool)
            inside[ends] = False
            code[inside] = coded.indices.to_numpy(zero_copy_only=False)
            starts = np.concatenate(([0], ends + 1))
            row = np.repeat(np.arange(n), np.diff(starts))
            common = place >= 0
            logs = np.zeros(len(tokens))
            logs[common] = np.log10(v.counts[place[common]] + SMOOTH)
            rest = np.flatnonzero(~common[code])
            key, number = np.unique(row[rest] * len(tokens) + code[rest], return_counts=True)
            bounds = np.searchsorted(key, np.arange(n + 1) * len(tokens)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(unit[code].astype(np.int16))),
                     pa.array(np.bincount(row, common[code], n).astype(np.int64)), pa.array(np.bincount(row, logs[code], n)),
                     pa.ListArray.from_arrays(pa.array(bounds), tokens.take(pa.array(key % len(tokens)))),
                     pa.ListArray.from_arrays(pa.array(bounds), pa.array(number.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(starts).astype(np.int64)), *lists],
                                             names=["doc_id", "held_out", "step", "n_tokens", "units", "n_common", "log_common", "rest", "rest_n"])

    held = F.coalesce(held_out, F.lit(False))
    step = F.when(held, F.lit(-1)).otherwise(F.pmod(F.xxhash64("doc_id", "text"), F.lit(STEPS))).cast("int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), step.alias("step"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, step int, n_tokens long, units array<short>, n_common long, "
                                "log_common double, rest array<string>, rest_n array<int>")


def contexts(units: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """The units one, two and three places before each, 0 before a text."""
    out = []
    for k in (1, 2, 3):
        before = np.zeros(len(units), np.int16)
        before[k:] = units[:max(len(units) - k, 0)]
        # The first k places of a text; where the text is shorter, those of the next ones.
        heads = (starts[:-1, None] + np.arange(k)).reshape(-1)
        before[heads[heads < len(units)]] = 0
        out.append(before)
    return out


def class_features(before: list[np.ndarray]) -> list[np.ndarray]:
    """Rows of the class weights that are on."""
    one, two, three = before
    pair = ((one * UNITS + two) * 0x9E3779B1 >> 7) % PAIR_ROWS
    return [one, two + UNITS, three + 2 * UNITS, pair + 3 * UNITS]


def unit_features(before: list[np.ndarray], of_class: np.ndarray) -> list[np.ndarray]:
    """Rows of the weights of units within a class that are on."""
    return [((b * SIDE + of_class) * 0x9E3779B1 >> 5) % UNIT_ROWS + k * UNIT_ROWS for k, b in enumerate(before[:UNIT_PLACES])]


@dataclass
class Weights:
    """The model: log shares without context, and the features' weights."""

    base: np.ndarray                 # (class), log share
    base_unit: np.ndarray            # (class, unit), log share within the class
    by_class: np.ndarray = field(default_factory=lambda: np.zeros((ROWS, SIDE), np.float32))
    by_unit: np.ndarray = field(default_factory=lambda: np.zeros((UNIT_PLACES * UNIT_ROWS, SIDE), np.float32))

    @staticmethod
    def start(voc: Vocabulary) -> Weights:
        share = voc.unit_totals.reshape(SIDE, SIDE) / voc.unit_totals.sum()
        of_class = share.sum(axis=1)
        return Weights(np.log(of_class).astype(np.float32), np.log(share / of_class[:, None]).astype(np.float32))


def _softmax(base: np.ndarray, table: np.ndarray, features: list[np.ndarray]) -> np.ndarray:
    """Natural logs of the outcomes' probabilities, a row a token."""
    x = table[features[0]]
    for f in features[1:]:
        x += table[f]
    x += base
    x -= x.max(axis=1, keepdims=True)
    x -= np.log(np.exp(x).sum(axis=1, keepdims=True))
    return x


def log_probabilities(w: Weights, units: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Natural log of each unit's probability after the units before it."""
    out = np.zeros(len(units))
    before = contexts(units, starts)
    for a in range(0, len(units), CHUNK):
        of_class, unit = np.divmod(units[a:a + CHUNK].astype(np.int64), SIDE)
        near = [b[a:a + CHUNK].astype(np.int64) for b in before]
        at = np.arange(len(unit))
        out[a:a + CHUNK] = (_softmax(w.base, w.by_class, class_features(near))[at, of_class]
                            + _softmax(w.base_unit[of_class], w.by_unit, unit_features(near, of_class))[at, unit])
    return out


def _add(total: np.ndarray, feature: np.ndarray, p: np.ndarray) -> None:
    """Adds the rows of ``p`` to the rows ``feature`` of ``total``."""
    order = np.argsort(feature.astype(np.int16 if len(total) < 1 << 15 else np.int32), kind="stable")
    rows = feature[order]
    heads = np.flatnonzero(np.diff(rows, prepend=-1))
    total[rows[heads]] += np.add.reduceat(p[order], heads, axis=0)


def gradient_parts(w: Weights, units: np.ndarray, starts: np.ndarray, seen: np.ndarray, expected: np.ndarray) -> None:
    """Adds to ``seen`` and ``expected`` how often each feature met each
    outcome and how often the model expects it (class rows, then unit rows)."""
    before = contexts(units, starts)
    for a in range(0, len(units), SEEN):
        of_class, unit = np.divmod(units[a:a + SEEN].astype(np.int64), SIDE)
        near = [b[a:a + SEEN].astype(np.int64) for b in before]
        for f in class_features(near):
            seen.reshape(-1)[:] += np.bincount(f * SIDE + of_class, minlength=seen.size)
        for f in unit_features(near, of_class):
            seen.reshape(-1)[:] += np.bincount((f + ROWS) * SIDE + unit, minlength=seen.size)
    for a in range(0, len(units), CHUNK):
        of_class = units[a:a + CHUNK].astype(np.int64) // SIDE
        near = [b[a:a + CHUNK].astype(np.int64) for b in before]
        for base, table, features, shift in (
                (w.base, w.by_class, class_features(near), 0),
                (w.base_unit[of_class], w.by_unit, unit_features(near, of_class), ROWS)):
            p = np.exp(_softmax(base, table, features))
            for f in features:
                _add(expected[shift:shift + len(table)], f, p)


def gradient(encoded: DataFrame, w: Weights) -> tuple[np.ndarray, np.ndarray]:
    """(seen, expected) over all rows of ``encoded``. A task adds up its own
    rows; blocks of weight rows are summed where Spark deals them, one
    batch at a time; the driver gets one table, the size of the weights."""
    shared = encoded.sparkSession.sparkContext.broadcast(w)
    rows = ROWS + UNIT_PLACES * UNIT_ROWS

    def run(batches):
        seen, expected = np.zeros((rows, SIDE), np.float64), np.zeros((rows, SIDE), np.float64)
        some = False
        for batch in batches:
            starts, units = _flat(batch.column(0))
            if len(units):
                some = True
                gradient_parts(shared.value, units, starts, seen, expected)
        for a in range(0, rows, BLOCK) if some else ():
            parts = [x[a:a + BLOCK].astype(np.float32).tobytes() for x in (seen, expected)]
            yield pa.RecordBatch.from_arrays([pa.array([a // BLOCK]), *[pa.array([x], pa.binary()) for x in parts]], names=["block", "seen", "expected"])

    def add(batches):
        total: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for block, *parts in zip(*[c.to_pylist() for c in batch.columns]):
                parts = [np.frombuffer(x, np.float32).astype(np.float64) for x in parts]
                total[block] = [x + y for x, y in zip(total[block], parts)] if block in total else parts
        for block, parts in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([block]), *[pa.array([x.tobytes()], pa.binary()) for x in parts]], names=["block", "seen", "expected"])

    schema = "block long, seen binary, expected binary"
    summed = encoded.select("units").mapInArrow(run, schema).repartition("block").mapInArrow(add, schema).collect()
    seen, expected = np.zeros((rows, SIDE)), np.zeros((rows, SIDE))
    for r in summed:
        at = slice(r.block * BLOCK, r.block * BLOCK + BLOCK)
        seen[at] = np.frombuffer(r.seen).reshape(-1, SIDE)
        expected[at] = np.frombuffer(r.expected).reshape(-1, SIDE)
    shared.unpersist()
    return seen, expected


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    at = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    return at - at[0], lists.flatten().to_numpy(zero_copy_only=False)


def updated(w: Weights, seen: np.ndarray, expected: np.ndarray, damping: float = DAMPING, prior: float = PRIOR) -> Weights:
    """The weights after one step: along the gradient ``seen - expected``, by
    the damped log of the two counts' smoothed ratio."""
    move = (damping * np.log((seen + prior) / (expected + prior))).astype(np.float32)
    return Weights(w.base, w.base_unit, w.by_class + move[:ROWS], w.by_unit + move[ROWS:])


def train(encoded: DataFrame, voc: Vocabulary, steps: int = STEPS) -> Weights:
    """One update from each step's share of the training rows, in turn."""
    w = Weights.start(voc)
    for step in range(steps):
        w = updated(w, *gradient(encoded.where(F.col("step") == step), w))
    return w


def unit_scores(encoded: DataFrame, w: Weights, voc: Vocabulary) -> DataFrame:
    """The staged rows with ``log_units``: sum over tokens of log10 P(unit)
    less the log10 of the unit's count total."""
    shared = encoded.sparkSession.sparkContext.broadcast((w, np.log10(voc.unit_totals)))

    def run(batches):
        weights, log_total = shared.value
        for batch in batches:
            starts, units = _flat(batch.column(6))
            each = log_probabilities(weights, units, starts) / np.log(10) - log_total[units] if len(units) else np.zeros(0)
            total = np.add.reduceat(each, starts[:-1]) if len(units) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(total)], names=[*batch.schema.names[:6], "log_units"])

    return (encoded.select("row", "doc_id", "held_out", "n_tokens", "n_common", "log_common", "units")
            .mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_common long, log_common double, log_units double"))


def score(docs: DataFrame, held_out: Column, steps: int = STEPS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null or empty text has the end token alone. Rows without an id are
    training rows; repeated ids and rows are rows of their own. With no
    training rows all tokens are unknown; an empty table gives no rows."""
    rows = docs.withColumn("_held", F.coalesce(held_out, F.lit(False)))
    counts = staged(token_counts(rows.where(~F.col("_held"))), "token-counts")
    voc = vocabulary(counts)
    encoded = staged(encode(docs, voc, held_out).withColumn("row", F.monotonically_increasing_id()), "encoded", by="step")
    w = train(encoded, voc, steps)
    scored = unit_scores(encoded, w, voc)
    each = encoded.where(F.size("rest") > 0).select("row", F.explode(F.arrays_zip("rest", "rest_n")).alias("t")).select("row", F.col("t.rest").alias("token"), F.col("t.rest_n").alias("n"))
    c = F.coalesce(F.col("c"), F.lit(0))
    rest = (each.join(counts, "token", "left").groupBy("row")
            .agg(F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("n_rest"), F.sum(F.col("n") * F.log10(c + SMOOTH)).alias("log_rest")))
    logs = F.col("log_common") + F.coalesce("log_rest", F.lit(0.0))
    return (scored.join(rest, "row", "left")
            .select("doc_id", "held_out", "n_tokens", (F.col("n_common") + F.coalesce("n_rest", F.lit(0))).cast("long").alias("n_known"),
                    F.lit(voc.total).cast("long").alias("train_tokens"),
                    (logs - F.col("n_tokens") * F.log10(F.lit(voc.total + SMOOTH * (voc.size + 1)))).alias("base_score"),
                    (logs + F.col("log_units")).alias("score")))
