"""Near-duplicates by min-max hashing of word shingles.

One pass hashes every document's shingles and keeps, for each permutation,
both the least and the greatest value: two signature values for one hash
evaluation. Bands of two permutations (four values) make candidates, full
shingle sets confirm them, and confirmed links make components.

Equal sets are one class, so exact copies cost one row after a map-side
combine; classes are numbered, and only numbers are shuffled. A bucket's
pairs are never listed: every member is compared with one pivot, the member
that shares most buckets, and links are merged. For members still apart, an
index on their rarest shingles finds every link that is left (see
``_open_links``). Bands can miss a link between small sets, so all sets of
few shingles go through that index, too, which misses none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushwin.llm.common import runs, scope, staged, text_slices, words
from hushwin.llm.graph import components

SHINGLE = 5
SIMILARITY_PCT = 75
BANDS = 32          # of two permutations, four values each: a pair of large sets at the threshold is missed with (1 - 0.75**4)**32 < 6e-6
#: Sets up to this size are all compared through the exact index.
SMALL = 86
SEED = 20

_rng = np.random.default_rng(SEED)
_FOLD = _rng.integers(0, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PAD = np.uint64(0x9E3779B97F4A7C15)
_A = _rng.integers(0, 2**63, 2 * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, 2 * BANDS, dtype=np.uint64)
_KEY = _rng.integers(0, 2**63, (BANDS, 5), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes): 64-bit hashes of the shingles of text ``i`` are
    ``hashes[starts[i]:starts[i + 1]]``, repeats included. A text of fewer
    words than a shingle has one, its whole sequence; without words none."""
    at, values = words(texts, lower=True)
    coded = values.dictionary_encode()
    each = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    word = each[coded.indices.to_numpy(zero_copy_only=False)] if len(values) else np.zeros(0, np.uint64)
    word = np.concatenate((word, np.full(SHINGLE, _PAD)))
    n = np.diff(at)
    count = np.where(n > 0, np.maximum(n - SHINGLE + 1, 1), 0)
    p = runs(at[:-1], count)
    h = np.zeros(len(p), np.uint64)
    for k in range(SHINGLE):
        h += word[p + k] * _FOLD[k]
    starts = np.concatenate(([0], np.cumsum(count)))
    for i in np.flatnonzero((n > 0) & (n < SHINGLE)):
        part = np.concatenate((word[at[i]:at[i + 1]], np.full(SHINGLE - n[i], _PAD)))
        h[starts[i]] = (part * _FOLD).sum(dtype=np.uint64) + np.uint64(n[i])
    return starts, _mix(h)


def band_keys(starts: np.ndarray, h: np.ndarray) -> np.ndarray:
    """(documents, BANDS) bucket keys; rows of documents without shingles mean nothing."""
    full = np.diff(starts) > 0
    keys = np.zeros((len(full), BANDS), np.uint64)
    if not full.any():
        return keys
    at = starts[:-1][full]
    for band in range(BANDS):
        key = np.full(len(at), np.uint64(band)) * _KEY[band, 4]
        for j in (0, 1):
            value = h * _A[2 * band + j] + _B[2 * band + j]
            key = key + np.minimum.reduceat(value, at) * _KEY[band, 2 * j] + np.maximum.reduceat(value, at) * _KEY[band, 2 * j + 1]
        keys[full, band] = _mix(key)
    return keys


def _sets(starts: np.ndarray, h: np.ndarray) -> list[np.ndarray]:
    return [np.unique(h[a:b]) for a, b in zip(starts[:-1], starts[1:])]


def _digest(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, cls (digest of the shingle set; null if empty), bands."""
    def run(batches):
        for batch in text_slices(batches, 1):
            starts, h = shingle_hashes(batch.column(1))
            sets = _sets(starts, h)
            keys = band_keys(starts, h).astype(np.int64)
            ends = np.arange(0, keys.size + 1, BANDS, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) for s in sets], pa.binary()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1)))],
                names=["doc_id", "n_shingles", "cls", "bands"])

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(run, "doc_id long, n_shingles long, cls binary, bands array<long>"))


def _with_sets(texts: DataFrame) -> DataFrame:
    """(cls, digest, text) to cls and its sorted shingle set, of the rows whose text has the digest."""
    def run(batches):
        for batch in text_slices(batches, 2):
            sets = _sets(*shingle_hashes(batch.column(2)))
            own = [i for i, d in enumerate(batch.column(1).to_pylist()) if len(sets[i]) and _digest(sets[i]) == d]
            ends = np.concatenate(([0], np.cumsum([len(sets[i]) for i in own]))).astype(np.int32)
            flat = np.concatenate([sets[i] for i in own]).astype(np.int64) if own else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own, pa.int64())),
                                              pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["cls", "set"])

    return texts.mapInArrow(run, "cls long, set array<long>")


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Distinct (a, b, n_a, n_b) with the shingles that their full sets share."""
    both = (pairs.select("a", "b", "n_a", "n_b").distinct()
            .join(sets.select(F.col("cls").alias("b"), F.col("set").alias("set_b")), "b")
            .join(sets.select(F.col("cls").alias("a"), F.col("set").alias("set_a")), "a"))
    return both.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("set_a", "set_b")).cast("long").alias("common"))


def _similar(n_a, n_b, common, pct: int):
    """Whether sets of n_a and n_b members that share ``common`` are similar enough."""
    return 100 * common >= pct * (n_a + n_b - common)


def _shared_buckets(rows: DataFrame) -> DataFrame:
    """Of (bucket, cls, n), the rows of buckets with several classes, with the bucket's size."""
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("members")).where(F.col("members") > 1)
    return rows.join(sizes, "bucket")


def _labelled(rows: DataFrame, labels: DataFrame, cls: str, label: str) -> DataFrame:
    return (rows.join(labels.select(F.col("node").alias(cls), F.col("label").alias(label)), cls, "left")
            .withColumn(label, F.coalesce(label, cls)))


def _links(members: DataFrame, small: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """(node, label) of the classes that have links. ``members``: the classes
    in shared buckets (bucket, cls, n, members); ``small``: (cls, n) of all
    small ones."""
    score = members.groupBy("cls").agg(F.sum("members").alias("score"))
    pivots = (members.join(score, "cls").groupBy("bucket").agg(F.max(F.struct("score", "cls", "n")).alias("p"))
              .select("bucket", F.col("p.cls").alias("pivot"), F.col("p.n").alias("pivot_n")))
    level = staged(members.join(pivots, "bucket").select("bucket", "cls", "n", "pivot", "pivot_n"), "members")
    star = level.where(F.col("cls") != F.col("pivot")).select(F.col("cls").alias("a"), F.col("pivot").alias("b"), F.col("n").alias("n_a"), F.col("pivot_n").alias("n_b"))
    star = staged(_overlaps(star, sets), "pivot-overlaps")
    edges = star.where(_similar(F.col("n_a"), F.col("n_b"), F.col("common"), pct)).select("a", "b")
    labels = components(edges)
    more = staged(_open_links(_open(level, labels, small, pct), sets, pct), "links")
    if not more.limit(1).count():
        return labels
    return components(edges.union(more))


def _open(level: DataFrame, labels: DataFrame, small: DataFrame, pct: int) -> DataFrame:
    """cls, n, label, least, outside of the classes that may have a link
    left: those in a bucket that the pivots left in several components
    (``outside``: not in the component of some such bucket's pivot; each open
    pair of a bucket has such a member), and all small ones. ``least``: no
    partner is smaller."""
    rows = _labelled(_labelled(level, labels, "cls", "label"), labels, "pivot", "pivot_label")
    mixed = (rows.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("n").alias("least"))
             .where(F.col("lo") != F.col("hi")).select("bucket", "least"))
    open_ = (rows.join(mixed, "bucket").groupBy("cls", "n", "label")
             .agg(F.min("least").alias("least"), F.max((F.col("label") != F.col("pivot_label")).cast("int")).alias("outside")))
    all_small = _labelled(small, labels, "cls", "label").select("cls", "n", "label", F.lit(0).cast("long").alias("least"), F.lit(1).alias("outside"))
    both = open_.union(all_small).groupBy("cls", "n", "label").agg(F.min("least").alias("least"), F.max("outside").alias("outside"))
    return staged(both.withColumn("least", F.greatest("least", F.ceil(F.col("n") * pct / 100.0 - 1e-6))), "open")


def _open_links(classes: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """Links (a, b) between classes of different labels; complete, without
    listing the pairs of a bucket or of a frequent shingle.

    Sets of n and m members that are similar share at least ``need`` =
    pct / (100 + pct) of n + m. So if each set's shingles are put in one
    common order, rarest first, two linked sets meet among the first
    n - need + 1 of the one and m - need + 1 of the other. An index on
    these finds every link; what many documents share stands late in the
    order, so hardly any other pair meets. A set of which fewer than ``need``
    shingles occur in another component has no link left.

    Shingles of one component alone are left out first: they make no link,
    and the order among the others is as good. What else is known of a class
    than its number joins only what is left then."""
    entries = classes.select("cls", "label").join(sets, "cls").select("cls", "label", F.explode("set").alias("shingle"))
    uses = (entries.groupBy("shingle").agg(F.count("*").alias("uses"), F.min("label").alias("lo"), F.max("label").alias("hi"))
            .where("lo <> hi").select("shingle", "uses"))
    own = Window.partitionBy("cls")
    placed = (entries.select("cls", "shingle").join(uses, "shingle")
              .select("cls", "shingle", F.row_number().over(own.orderBy("uses", "shingle")).alias("place"), F.count("*").over(own).alias("held")))
    need = F.ceil((F.col("n") + F.col("least")) * pct / (100.0 + pct) - 1e-6)
    early = staged(placed.join(classes, "cls").where((F.col("held") >= need) & (F.col("place") <= F.col("held") - need + 1))
                   .select("cls", "n", "label", "outside", "shingle", (F.col("held") - F.col("place") + 1).alias("rest")), "rare")
    x = early.where("outside = 1").select(F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("label").alias("label_a"), F.col("rest").alias("rest_a"), "shingle")
    y = early.select(F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("label").alias("label_b"), F.col("outside").alias("also"), F.col("rest").alias("rest_b"), "shingle")
    fits = 100 * F.least("n_a", "n_b") >= pct * F.greatest("n_a", "n_b")
    once = (F.col("also") == 0) | (F.col("a") < F.col("b"))
    # At the first shingle that both hold, what either has left must still do.
    enough = (100 + pct) * F.least("rest_a", "rest_b") >= pct * (F.col("n_a") + F.col("n_b"))
    pairs = x.join(y, "shingle").where((F.col("label_a") != F.col("label_b")) & fits & once & enough).select("a", "b", "n_a", "n_b")
    return _overlaps(pairs, sets).where(_similar(F.col("n_a"), F.col("n_b"), F.col("common"), pct)).select("a", "b")


def near_duplicates(docs: DataFrame, pct: int = SIMILARITY_PCT) -> DataFrame:
    """Per row: doc_id, n_shingles, cls, component_id, kept, stays (kept, and
    of its component's class that stays: the least one with the least id).

    component_id is the least doc_id that confirmed links reach, null ids
    aside (null if a component has no other); a row without words is linked
    with nothing. Rows that share an id are rows of their own. An empty
    table gives no rows."""
    with scope(docs.sparkSession):
        sig = staged(signatures(docs), "signatures")
        by_class = staged(_by_class(docs, sig, pct), "by-class")
        out = sig.drop("bands").join(by_class, "cls", "left")
        component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
        out = (out.withColumn("component_id", component)
               .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
               .select("doc_id", "n_shingles", "cls", "component_id", "kept", (F.col("kept") & F.coalesce("first", F.lit(True))).alias("stays")))
        return staged(out, "judged", keep=True)


def _by_class(docs: DataFrame, sig: DataFrame, pct: int) -> DataFrame:
    """cls (digest), component_id, first: of every distinct set of the staged signatures."""
    classes = staged(sig.where("cls is not null").groupBy("cls")
                     .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
                     .select(F.monotonically_increasing_id().alias("number"), "cls", "rep", "n", "bands"), "classes")
    members = staged(_shared_buckets(classes.select(F.explode("bands").alias("bucket"), F.col("number").alias("cls"), "n")), "shared")
    small = classes.where(F.col("n") <= SMALL).select(F.col("number").alias("cls"), "n")
    wanted = members.select("cls").union(small.select("cls")).distinct()
    wanted = wanted.join(classes.select(F.col("number").alias("cls"), F.col("cls").alias("digest"), "rep"), "cls")
    texts = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
             .join(wanted, F.col("doc_id").eqNullSafe(F.col("rep"))).select("cls", "digest", "text"))
    sets = staged(_with_sets(texts).groupBy("cls").agg(F.first("set").alias("set")), "sets")
    labels = _links(members, small, sets, pct)
    labelled = labels.join(classes.select(F.col("number").alias("node"), "cls", "rep"), "node")
    least = labelled.groupBy("label").agg(F.min("rep").alias("least"), F.min(F.struct(F.col("rep").isNull(), "rep", "cls")).alias("lead"))
    merged = labelled.join(least, "label").select("cls", "least", (F.col("cls") == F.col("lead.cls")).alias("first"))
    return classes.select("cls", "rep").join(merged, "cls", "left").select("cls", F.coalesce("least", "rep").alias("component_id"), F.coalesce("first", F.lit(True)).alias("first"))


def _classed(rows: DataFrame) -> DataFrame:
    """Adds cls to (row, words)."""
    def run(batches):
        for batch in text_slices(batches, 1):
            digests = [_digest(s) for s in _sets(*shingle_hashes(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary())], names=["row", "words", "cls"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("cls", T.BinaryType())]))


def kept_rows(docs: DataFrame, pct: int = SIMILARITY_PCT) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with their columns;
    rows without words stay. An id that only one row has decides for it; of
    rows that share an id or have none, the class decides, and of a class's
    rows the one with the least text stays."""
    with scope(docs.sparkSession):
        marked = near_duplicates(docs, pct)
        ids = staged(marked.groupBy("doc_id").agg(F.count("*").alias("shared"), F.max("stays").alias("stays")).where("stays")
                     .select(F.col("doc_id").alias("kept_id"), "shared"), "kept", keep=True)
        own = staged(marked.where("stays and cls is not null").select(F.col("doc_id").alias("own_id"), F.col("cls").alias("own_cls")).distinct()
                     .join(ids.where("shared > 1"), F.col("own_id").eqNullSafe(F.col("kept_id"))).select("own_id", "own_cls"), "kept-classes", keep=True)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row).join(ids, F.col("row.doc_id").cast("long").eqNullSafe(F.col("kept_id"))).select("row", "shared")
    once = rows.where("shared = 1").select("row")
    again = _classed(rows.where("shared > 1").select("row", F.col("row.text").cast("string").alias("words")))
    first = Window.partitionBy("own_id", "own_cls").orderBy("words")
    least = (again.join(own, F.col("row.doc_id").cast("long").eqNullSafe(F.col("own_id")) & (F.col("cls") == F.col("own_cls")))
             .withColumn("place", F.row_number().over(first)).where("place = 1").select("row"))
    out = once.union(again.where("cls is null").select("row")).union(least)
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
