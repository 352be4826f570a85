import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hushwin.llm import maxent
from hushwin.llm.common import crc32_mod, table
from tests.conftest import SF001, SF01
from tests.llm.cases import edge_docs, empty_docs, rows
from tests.llm.test_resample import LOWER

def HELD():
    return crc32_mod("doc_id", 10) == 0


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), "\n"]


def check_base(docs, held_out, got):
    texts = [(r.doc_id, r.text, bool(r.h)) for r in docs.select("doc_id", "text", held_out.alias("h")).collect()]
    c = Counter(t for _, text, h in texts if not h for t in tokens(text))
    n, v = sum(c.values()), len(c)
    want = []
    for doc_id, text, h in texts:
        ts = tokens(text)
        want.append((doc_id, h, len(ts), sum(t in c for t in ts), n, sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts)))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:4], round(r[5], 6))
    have = sorted([tuple(r[k] for k in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")) for r in got], key=key)
    assert len(have) == len(want)
    for a, b in zip(have, sorted(want, key=key)):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9)
    assert all(r["score"] <= 0 and math.isfinite(r["score"]) for r in got)


@pytest.fixture(scope="module")
def scored(spark):
    return rows(maxent.score(table(spark, SF01, "documents"), HELD()))


def test_base_by_brute_force(spark, scored):
    check_base(table(spark, SF01, "documents"), HELD(), scored)
    assert {r["doc_id"] for r in scored if r["held_out"]} == {r["doc_id"] for r in scored if zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0}


def test_held_out_texts_are_likelier_than_by_their_words_alone(scored):
    held = [r for r in scored if r["held_out"]]
    n = sum(r["n_tokens"] for r in held)
    base, score = (sum(r[k] for r in held) / n for k in ("base_score", "score"))
    print(f"held-out log10 per token: base {base:.3f}, model {score:.3f}")
    assert score > base + 0.2


def test_rare_tokens_are_joined(spark, monkeypatch):
    """With few common tokens, nearly all counts come from the join."""
    monkeypatch.setattr(maxent, "COMMON", 7)
    docs = table(spark, SF001, "documents")
    check_base(docs, HELD(), rows(maxent.score(docs, HELD(), steps=1)))


def test_edges(spark):
    docs = edge_docs(spark)
    check_base(docs, HELD(), rows(maxent.score(docs, HELD(), steps=1)))
    check_base(docs, F.lit(True), rows(maxent.score(docs, F.lit(True), steps=1)))
    assert rows(maxent.score(empty_docs(spark), HELD(), steps=1)) == []


def vocabulary(texts):
    c = Counter(t for text in texts for t in tokens(text))
    top = sorted(c, key=lambda t: (-c[t], t))
    voc = maxent.Vocabulary(pa.array(top, pa.string()), np.array([c[t] for t in top]), sum(c.values()), len(c))
    unit, _ = voc.units(voc.tokens)
    voc.unit_totals[maxent.OWN_CLASSES * maxent.SIDE:] = 0.1
    voc.unit_totals[:maxent.OWN_CLASSES * maxent.SIDE] = 1e-9
    np.add.at(voc.unit_totals, unit, [c[t] + 0.1 for t in top])
    return voc, unit


def random_weights(voc, seed=3):
    rng = np.random.default_rng(seed)
    w = maxent.Weights.start(voc)
    return maxent.Weights(w.base, w.base_unit, rng.normal(0, 0.5, w.by_class.shape).astype(np.float32), rng.normal(0, 0.5, w.by_unit.shape).astype(np.float32))


def test_units_probabilities_sum_to_one():
    voc, _ = vocabulary([" ".join(f"w{i}x{i % 13}" for i in range(j, 2000)) for j in range(0, 2000, 100)])
    w = random_weights(voc)
    # The same context before every unit: texts of three units, the last one varied.
    units = np.array([[5, 9, u] for u in range(maxent.UNITS)]).reshape(-1)
    logs = maxent.log_probabilities(w, units, np.arange(0, len(units) + 1, 3))
    assert math.isclose(np.exp(logs[2::3]).sum(), 1, rel_tol=1e-4)


def test_gradient_by_brute_force():
    texts = ["the cat sat on the mat", "", "the the the dog", "a cat and a dog and a cat"]
    voc, _ = vocabulary(texts)
    w = random_weights(voc)
    units = [voc.units(pa.array(tokens(t), pa.string()))[0] for t in texts]
    starts = np.concatenate(([0], np.cumsum([len(u) for u in units])))
    seen = np.zeros((maxent.ROWS + maxent.UNIT_PLACES * maxent.UNIT_ROWS, maxent.SIDE))
    expected = seen.copy()
    maxent.gradient_parts(w, np.concatenate(units), starts, seen, expected)
    want, model = np.zeros_like(seen), np.zeros_like(seen)
    total = 0.0
    for u in units:
        for i, x in enumerate(u):
            before = [np.array([u[i - k] if i >= k else 0]) for k in (1, 2, 3)]
            cls, place = x // maxent.SIDE, x % maxent.SIDE
            for base, tab, fs, y, shift in ((w.base, w.by_class, maxent.class_features(before), cls, 0),
                                            (w.base_unit[cls], w.by_unit, maxent.unit_features(before, np.array([cls])), place, maxent.ROWS)):
                z = np.exp(base.astype(float) + sum(tab[f[0]].astype(float) for f in fs))
                z /= z.sum()
                total += math.log(z[y])
                for f in fs:
                    want[f[0] + shift, y] += 1
                    model[f[0] + shift] += z
    assert np.array_equal(seen, want) and np.allclose(expected, model, atol=1e-4)
    assert math.isclose(maxent.log_probabilities(w, np.concatenate(units), starts).sum(), total, rel_tol=1e-5)
    # A step along it makes the texts likelier.
    better = maxent.updated(w, seen, expected)
    assert maxent.log_probabilities(better, np.concatenate(units), starts).sum() > total


def test_distributed_gradient_is_the_sum(spark):
    docs = table(spark, SF001, "documents").limit(60)
    counts = maxent.token_counts(docs)
    voc = maxent.vocabulary(counts)
    w = random_weights(voc)
    encoded = maxent.encode(docs, voc, F.lit(False))
    one, three = maxent.gradient(encoded.coalesce(1), w), maxent.gradient(encoded.repartition(3), w)
    assert np.array_equal(one[0], three[0]) and np.allclose(one[1], three[1], rtol=1e-3, atol=1e-3)
