import re

from hushwin.llm import quality
from hushwin.llm.common import table
from tests.llm.cases import edge_docs, empty_docs, rows

from tests.conftest import SF001

SP = " \t\n\x0b\x0c\r"


def brute(text):
    text = text or ""
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if x.strip(SP)]
    seen, covered = {}, set()
    for i in range(len(ws) - 4):
        seen.setdefault(tuple(ws[i:i + 5]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered.update(j for i in at for j in range(i, i + 5))
    return {"n_words": len(ws), "word_chars": sum(map(len, ws)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


def check(spark, docs):
    got = quality.judge(docs, ("doc_id", "text")).collect()
    assert len(got) == docs.count()
    for r in got:
        want = brute(r.text)
        assert {k: r[k] for k in want} == want
        failed = want["n_words"] < 10 or 100 * want["n_repeat_words"] > 20 * want["n_words"]
        assert r.base_failed == failed and (not failed or not r.kept)


def test_base_figures_equal_brute_force(spark):
    check(spark, table(spark, SF001, "documents"))


def test_edges(spark):
    check(spark, edge_docs(spark))
    assert rows(quality.judge(empty_docs(spark))) == []


def test_em_recovers_rule_accuracy():
    import itertools
    import random
    rnd = random.Random(3)
    right = [0.95, 0.9, 0.6, 0.8]
    counts = {}
    for _ in range(20000):
        good = rnd.random() < 0.8
        v = tuple((1 if (rnd.random() < a) == good else -1) if rnd.random() < 0.8 else 0 for a in right)
        counts[v] = counts.get(v, 0) + 1
    share, probs = quality.fit(sorted(counts.items()))
    assert abs(share - 0.8) < 0.1
    got = [p["good"][1] / (p["good"][1] + p["good"][-1]) for p in probs]
    assert sorted(range(4), key=lambda j: got[j]) == [2, 3, 1, 0]
    for v in itertools.product((-1, 0, 1), repeat=4):
        assert 0 <= quality.posterior(v, share, probs) <= 1


def test_keeps_labelled_good_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    labels = table(spark, "/root/testdata/sf0.01", "labels")
    got = {(x.quality, x.kept): x["count"] for x in quality.judge(docs).join(labels, "doc_id").groupBy("quality", "kept").count().collect()}
    good = got.get((1, True), 0) / max(1, got.get((1, True), 0) + got.get((1, False), 0))
    assert good > 0.85
    bad = got.get((0, False), 0) / max(1, got.get((0, True), 0) + got.get((0, False), 0))
    assert bad > 0.7
