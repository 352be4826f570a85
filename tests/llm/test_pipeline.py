import corpus_pipeline
from hushwin.llm import mixing, neardup, packing, pii, quality
from hushwin.llm.common import table
from tests.conftest import SF001
from tests.llm.cases import edge_docs, empty_docs, rows
from tests.llm.test_neardup import brute as groups


def key(r):
    return tuple(map(str, r))


def test_stages_take_effect(spark):
    docs = table(spark, SF001, "documents")
    names, stages = zip(*corpus_pipeline.STAGES)
    good, unique, clean, mixed, packed = stages
    judged = {r["doc_id"]: r["kept"] for r in rows(quality.judge(docs))}
    a = good(spark, docs, SF001).cache()
    assert a.columns == docs.columns and sorted(r.doc_id for r in a.collect()) == sorted(i for i, k in judged.items() if k)
    b = unique(spark, a, SF001).cache()
    want = sorted(i for i, _, _, kept in groups([(r.doc_id, r.text) for r in a.collect()]) if kept)
    assert b.columns == docs.columns and sorted(r.doc_id for r in b.collect()) == want
    c = clean(spark, b, SF001).cache()
    before, after = ({r.doc_id: r.text for r in x.collect()} for x in (b, c))
    assert c.columns == docs.columns and before.keys() == after.keys()
    assert any(x != after[i] for i, x in before.items())
    assert all((after[i] != x) == bool(pii.base_spans(x)) or "[" in after[i] for i, x in before.items())
    assert not any(pii.base_spans(x) for x in after.values())
    d = mixed(spark, c, SF001).cache()
    assert d.columns == docs.columns
    assert d.select(mixing.word_count("text").alias("n")).agg({"n": "sum"}).first()[0] == sum(r["taken"] for r in rows(mixing.mix(c)))
    e = rows(packed(spark, d, SF001))
    assert {r["doc_id"] for r in e} == {r.doc_id for r in d.collect()} and len({r["sequence_id"] for r in e}) == len(e)
    run = rows(corpus_pipeline.run(spark, SF001))
    assert sorted(key(r.values()) for r in run) == sorted(key(r.values()) for r in e)


def test_edges(spark):
    for docs in (edge_docs(spark), empty_docs(spark)):
        out = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, "/none")
            assert out.columns == docs.columns, name
        corpus_pipeline.STAGES[-1][1](spark, out, "/none").collect()
