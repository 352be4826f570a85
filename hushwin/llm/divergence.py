"""Divergence of a language's sources, by hash-consed segment trees.

Every (lang, source) group counts the language's kept terms. A group's
counts are the leaves of a segment tree over term ids; subtrees with equal
counts are one node, shared by all groups. Two groups are compared by
walking both trees at once: a pair of nodes met before is not walked again,
and each pair of leaf counts is priced once.

Term ids are a block and a place in it. The trees of one block of one
language are built and compared in one task, and Spark adds up the blocks;
so the trees' upper levels are a sum, and no task sees a whole vocabulary.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hushwin.llm.common import staged, text_slices, words
from hushwin.llm.resample import folded

MIN_DOCS = 3
TOP_TERMS = 200
SCALE = 1_000_000_000
#: Counts (terms x sources) that a block's trees hold on average; blocks are cut from the sources' number, results do not depend on it.
BLOCK_COUNTS = 1 << 17

#: Per byte: A-Z to a-z, a-z and bytes above ASCII as they are, all else to a blank.
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x61:0x7B] = _FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)

#: Text bytes that are counted at once before rows leave a task.
SLICE = 16 << 20


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows that hold it), and one
    row with a null term for every group. Null columns are ''."""
    def run(batches):
        for batch in text_slices(batches, 0, SLICE):
            at, values = words(folded(batch.column(0), _FOLD))
            lang, source = batch.column(1).dictionary_encode(), batch.column(2).dictionary_encode()
            n_source = max(len(source.dictionary), 1)
            group = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n_source + source.indices.to_numpy(zero_copy_only=False)
            coded = values.dictionary_encode()
            n_terms = max(len(coded.dictionary), 1)
            term = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(values) else np.zeros(0, np.int64)
            row = np.repeat(np.arange(batch.num_rows, dtype=np.int64), np.diff(at))
            held, n = np.unique(row * n_terms + term, return_counts=True)      # a term of a text
            key, inverse = np.unique(group[held // n_terms] * n_terms + held % n_terms, return_inverse=True)
            groups = np.unique(group)
            g = np.concatenate((key // n_terms, groups))
            t = pa.array(np.concatenate((key % n_terms, np.zeros(len(groups), np.int64))), mask=np.arange(len(g)) >= len(key))
            counts = np.concatenate((np.bincount(inverse, n, len(key)).astype(np.int64), np.zeros(len(groups), np.int64)))
            rows = np.concatenate((np.bincount(inverse, minlength=len(key)), np.zeros(len(groups), np.int64)))
            yield pa.RecordBatch.from_arrays(
                [lang.dictionary.take(pa.array(g // n_source)), source.dictionary.take(pa.array(g % n_source)),
                 coded.dictionary.take(t), pa.array(counts), pa.array(rows)], names=["lang", "source", "term", "n", "docs"])

    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    return (texts.mapInArrow(run, "lang string, source string, term string, n long, docs long")
            .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def share(count: np.ndarray, total: int, vocabulary: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / (total + vocabulary)), exact for
    totals below 9e15: the quotient is formed three digits at a time."""
    rest, out, divisor = count + 1, np.zeros(len(count), np.int64), total + vocabulary
    whole, rest = np.divmod(rest, divisor)
    out += whole
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, divisor)
        out = out * 1000 + digits
    return out + 1


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q); shares are at most SCALE + 1, so 64 bits hold it."""
    return (p - q) * (p - q) // q


def hash_cons(counts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(leaf counts, children by level, root of each group) of the segment
    trees over the rows of ``counts`` (groups x a power of two of places).
    Equal subtrees of a level, within a tree or across trees, are one node."""
    leaves, nodes = np.unique(counts, return_inverse=True)
    nodes, known = nodes.reshape(counts.shape).astype(np.int64), len(leaves)
    levels = []
    while nodes.shape[1] > 1:
        pairs, inverse = np.unique(nodes[:, ::2] * known + nodes[:, 1::2], return_inverse=True)
        levels.append(np.stack(np.divmod(pairs, known), axis=1))
        nodes, known = inverse.reshape(len(counts), -1).astype(np.int64), len(pairs)
    return leaves, levels, nodes[:, 0]


def compare(leaves: np.ndarray, levels: list[np.ndarray], a: int, b: int, totals: tuple[int, int], vocabulary: int) -> tuple[int, int]:
    """(price of b seen from a, price of a seen from b) over the trees with
    the roots ``a`` and ``b``. Going down, each distinct pair of nodes is
    kept once; going up, its price is the sum of its two child pairs."""
    left, right, back = np.array([a]), np.array([b]), []
    for level, children in zip(range(len(levels) - 1, -1, -1), reversed(levels)):
        below = len(levels[level - 1]) if level else len(leaves)
        x, y = children[left], children[right]
        pairs, inverse = np.unique(x * below + y, return_inverse=True)
        back.append(inverse.reshape(x.shape))
        left, right = np.divmod(pairs, below)
    p, q = share(leaves[left], totals[0], vocabulary), share(leaves[right], totals[1], vocabulary)
    of_a, of_b = price(p, q), price(q, p)
    for inverse in reversed(back):
        of_a, of_b = of_a[inverse].sum(axis=1), of_b[inverse].sum(axis=1)
    return int(of_a[0]), int(of_b[0])


def _block_pairs(key, cells: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """One block: the summed prices of all pairs of the language's sources."""
    groups = groups.sort_values("source", ignore_index=True)
    vocabulary, totals = (int(groups["vocabulary"].iloc[0]), groups["total"].tolist()) if len(groups) else (0, [])
    out = []
    if len(cells) and len(groups) > 1:
        # Places by falling count in the language: rare terms, whose counts agree most, lie together.
        terms = cells.drop_duplicates("term").sort_values(["lang_n", "term"], ascending=[False, True])["term"]
        width = 1 << (len(terms) - 1).bit_length()
        counts = np.zeros((len(groups), width), np.int64)
        counts[pd.Index(groups["source"]).get_indexer(cells["source"]), pd.Index(terms).get_indexer(cells["term"])] = cells["n"]
        leaves, levels, roots = hash_cons(counts)
        # Places beyond the last term are no terms: what they add is the price of two zeros.
        for i in range(len(groups)):
            for j in range(i + 1, len(groups)):
                there, back = compare(leaves, levels, roots[i], roots[j], (totals[i], totals[j]), vocabulary)
                zero = [share(np.zeros(1, np.int64), totals[k], vocabulary) for k in (i, j)]
                spare = width - len(terms)
                out.append((groups["source"][i], groups["source"][j], there - spare * int(price(zero[0], zero[1])[0])))
                out.append((groups["source"][j], groups["source"][i], back - spare * int(price(zero[1], zero[0])[0])))
    frame = pd.DataFrame(out, columns=["source", "item", "value"])
    frame.insert(0, "lang", key[0])
    return frame


def _shares(n: str, total: str) -> str:
    """SQL of a share, in decimals that hold the product."""
    return (f"1 + cast((cast({SCALE} as decimal(10,0)) * cast({n} + 1 as decimal(19,0))) div cast({total} + vocabulary as decimal(19,0)) as bigint)")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, block_counts: int = BLOCK_COUNTS) -> DataFrame:
    """lang, source, part, item, value, rank.

    ``pair``: every other source of the language with the summed divergence.
    ``term``: the ``top`` terms that the group holds more often than the
    language. Null text, lang and source are ''; repeated rows count as
    often as they stand; a group without terms, a language without kept
    terms (values 0, no term rows) and an empty table (no rows) are fine.

    A term's cells are at most one a source, so the window that finds a
    term's documents is bounded by the sources; totals are one row a group."""
    counts = staged(term_counts(docs), "term-counts")
    of_term = Window.partitionBy("lang", "term")
    kept = (counts.where("term is not null")
            .withColumn("held", F.sum("docs").over(of_term)).withColumn("lang_n", F.sum("n").over(of_term))
            .withColumn("first", (F.row_number().over(of_term.orderBy("source")) == 1).cast("long")).where(F.col("held") >= min_docs)
            .select("lang", "source", "term", "n", "lang_n", "first"))
    kept = staged(kept, "kept-terms")
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("first").alias("firsts"))
    groups = (counts.where("term is null").select("lang", "source").join(sums, ["lang", "source"], "left")
              .select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("firsts", F.lit(0)).alias("firsts")))
    by_lang = groups.groupBy("lang").agg(F.sum("firsts").alias("vocabulary"), F.sum("total").alias("lang_total"), F.count("*").alias("sources"))
    blocks = F.ceil(F.col("vocabulary") * F.col("sources") / F.lit(block_counts)).cast("long")
    by_lang = staged(by_lang.withColumn("blocks", F.greatest(blocks, F.lit(1))), "langs")
    groups = staged(groups.select("lang", "source", "total").join(by_lang, "lang"), "groups")

    cells = (kept.join(by_lang.select("lang", "blocks"), "lang")
             .withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks"))).select("lang", "block", "source", "term", "n", "lang_n"))
    sides = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("lang", "block", "source", "total", "vocabulary")
    priced = (cells.groupBy("lang", "block").cogroup(sides.groupBy("lang", "block"))
              .applyInPandas(_block_pairs, "lang string, source string, item string, value long"))
    summed = priced.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    # Languages without kept terms have pairs too, of value 0.
    bare = groups.where("vocabulary = 0").select("lang", "source")
    none = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source <> item").withColumn("value", F.lit(0).cast("long"))
    pairs = summed.union(none).withColumn("part", F.lit("pair"))

    own = kept.join(groups, ["lang", "source"])
    shares = own.select("lang", "source", F.col("term").alias("item"), F.expr(_shares("n", "total")).alias("p"), F.expr(_shares("lang_n", "lang_total")).alias("q"))
    terms = shares.where("p > q").select("lang", "source", "item", F.expr("(p - q) * (p - q) div q").alias("value"), F.lit("term").alias("part"))

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    columns = ["lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank")]
    return (pairs.withColumn("rank", rank).select(*columns)
            .union(terms.withColumn("rank", rank).where(F.col("rank") <= top).select(*columns)))
