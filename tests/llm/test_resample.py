import hashlib
import math
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from hushwin.llm import resample
from hushwin.llm.common import table
from tests.conftest import SF001
from tests.llm.cases import edge_docs, empty_docs, rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, n=1):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return words, [" ".join(words[i:i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def brute(docs, target, pct, min_words, n=1):
    """[(doc_id, n_features, weight, score)] in order and the number drawn."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s = Counter(bucket(f) for _, text in docs for f in features(text, n)[1])
    t = Counter(bucket(f) for text in target for f in features(text, n)[1])
    sums = (sum(t.values()) + 10_000, sum(s.values()) + 10_000)
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * sums[1] / ((s[b] + 1) * sums[0]))) for b in s}
    out, able = [], 0
    for doc_id, text in docs:
        words, found = features(text, n)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        able += len(words) >= min_words
        out.append((doc_id, len(found), weight, score, len(words) >= min_words))
    return out, pct * able // 100


def check(spark, docs, target, pct=10, min_words=20, n=1):
    got = rows(resample.resample(docs, target, pct, min_words, n))
    key = lambda r: (r is None, r or 0)
    want, size = brute([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], pct, min_words, n)
    order = lambda x: (key(x[0]), *x[1:])
    assert sorted([(r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got], key=order) == sorted([w[:4] for w in want], key=order)
    drawn = sorted([r for r in got if r["rank"] is not None], key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, size + 1))
    best = sorted([w for w in want if w[4]], key=lambda w: (-w[3], key(w[0])))[:size]
    assert [(r["score"], r["doc_id"]) for r in drawn] == [(w[3], w[0]) for w in best]


def test_whole_tables(spark):
    check(spark, table(spark, SF001, "documents"), table(spark, SF001, "benchmark"))


@pytest.mark.parametrize("pct", [0, 50, 100])
def test_edges(spark, pct):
    check(spark, edge_docs(spark), table(spark, SF001, "benchmark"), pct, min_words=4)
    check(spark, edge_docs(spark), empty_docs(spark), pct, min_words=4, n=3)


def test_empty(spark):
    assert rows(resample.resample(empty_docs(spark), empty_docs(spark))) == []


@pytest.mark.parametrize("pct", [20, 60])
def test_ties_of_score_id_and_whole_rows(spark, pct):
    """One id in a third of all rows, null ids, and ids that share a score."""
    docs = [(7 if i % 3 == 0 else None if i % 3 == 1 else i, "same words " * 15) for i in range(300)]
    check(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(5), empty_docs(spark), pct)


@pytest.mark.parametrize("want", [1, 4, 5, 9])
def test_cut_by_ids_among_equal_scores(spark, want):
    """The score's cutoff may fall on any row of a tie, negative and null ids among them."""
    data = [(5, -3, True, 0), (5, 4, True, 1), (5, None, True, 2), (5, 0, True, 3), (9, 1, True, 4), (5, 4, True, 5),
            (5, None, True, 6), (1, 2, True, 7), (9, 9, False, 8), (1, 2, True, 9), (0, 0, True, 10), (-7, 5, True, 11)]
    scored = spark.createDataFrame(data, "score long, doc_id long, able boolean, row long")
    drawn, order = resample.draw(scored, want)
    got = [r.row for r in resample.ranked(scored.where(drawn), order, 3).orderBy("rank").collect()]
    best = sorted([r for r in data if r[2]], key=lambda r: (-r[0], r[1] is None, r[1] or 0, r[3]))
    assert got == [r[3] for r in best[:want]]


def test_folded_keeps_bytes_above_ascii():
    texts = pa.array(["Straße, ÄB-9", None, "", "日本X"])
    assert resample.folded(texts[0:4]).to_pylist() == ["straße  Äb 9", "", "", "日本x"]
    assert resample.folded(texts.slice(1, 3)).to_pylist() == ["", "", "日本x"]
