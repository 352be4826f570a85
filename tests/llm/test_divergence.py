import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hushwin.llm import divergence
from hushwin.llm.common import table
from tests.conftest import SF001
from tests.llm.cases import edge_docs, empty_docs, rows
from tests.llm.test_resample import LOWER


def brute(docs, min_docs=3, top=200):
    terms = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))) for text, lang, source in docs]
    out = []
    for lang in {t[0] for t in terms}:
        held = Counter(w for own, _, ws in terms if own == lang for w in set(ws))
        kept = sorted(w for w, n in held.items() if n >= min_docs)
        of = {s: Counter(w for own, src, ws in terms if (own, src) == (lang, s) for w in ws if held[w] >= min_docs) for own, s, _ in terms if own == lang}
        both = sum(of.values(), Counter())
        p = lambda c, w: 1 + 1_000_000_000 * (c[w] + 1) // (sum(c.values()) + len(kept))
        f = lambda a, b: (a - b) ** 2 // b
        for s, c in of.items():
            pairs = [(x, sum(f(p(c, w), p(of[x], w)) for w in kept)) for x in of if x != s]
            words = [(w, f(p(c, w), p(both, w))) for w in kept if c[w] and p(c, w) > p(both, w)]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", words, top)):
                best = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(best)]
    return sorted(out)


def check(docs, **options):
    got = sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in rows(divergence.audit(docs, **options)))
    want = brute([(r.text, r.lang, r.source) for r in docs.collect()], **{k: v for k, v in options.items() if k != "block_counts"})
    assert got == want
    return got


def test_whole_table_over_many_blocks(spark):
    got = check(table(spark, SF001, "documents"))
    assert check(table(spark, SF001, "documents"), block_counts=997) == got


@pytest.mark.parametrize("min_docs", [1, 3])
def test_edges(spark, min_docs):
    check(edge_docs(spark), min_docs=min_docs, top=3)


def test_empty_and_without_terms(spark):
    assert rows(divergence.audit(empty_docs(spark))) == []
    docs = spark.createDataFrame([("1 2", "x", "a"), (None, "x", "b"), ("rare", None, None)], "text string, lang string, source string")
    assert [r[4] for r in check(docs)] == [0, 0]


counts = st.lists(st.lists(st.integers(0, 3), min_size=8, max_size=8), min_size=2, max_size=4)


@settings(max_examples=60, deadline=None)
@given(counts)
def test_trees_price_as_term_by_term(data):
    c = np.array(data, np.int64)
    leaves, levels, roots = divergence.hash_cons(c)
    totals = c.sum(axis=1).tolist()
    p = [divergence.share(row, n, 8) for row, n in zip(c, totals)]
    there, back = divergence.compare(leaves, levels, roots[0], roots[1], (totals[0], totals[1]), 8)
    assert there == divergence.price(p[0], p[1]).sum() and back == divergence.price(p[1], p[0]).sum()
    # Equal trees are one node, and nodes are as many as there are distinct subtrees.
    assert (roots[0] == roots[1]) == (data[0] == data[1])
    assert len(levels[0]) == len({tuple(row[i:i + 2]) for row in data for i in range(0, 8, 2)})


@given(st.integers(0, 10**12), st.integers(0, 10**15))
def test_share_is_exact(count, more):
    total = count + more
    assert divergence.share(np.array([count]), total, 1)[0] == 1 + 10**9 * (count + 1) // (total + 1)


def test_equal_pairs_are_walked_once():
    """Trees of 2**16 places with two distinct counts meet in few pairs of nodes."""
    c = np.zeros((2, 1 << 16), np.int64)
    c[0, :1000], c[1, :500] = 1, 1
    leaves, levels, roots = divergence.hash_cons(c)
    assert sum(len(x) for x in levels) < 60
    there, _ = divergence.compare(leaves, levels, roots[0], roots[1], (1000, 500), 1 << 16)
    p, q = divergence.share(c[0], 1000, 1 << 16), divergence.share(c[1], 500, 1 << 16)
    assert there == divergence.price(p, q).sum()
