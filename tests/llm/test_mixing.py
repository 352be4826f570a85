import math

from hushwin.llm import mixing
from hushwin.llm.common import table
from tests.conftest import SF01
from tests.llm.cases import edge_docs, empty_docs, rows


def water_fill(sizes, weights=(5, 2, 1), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), sum(sizes.values())
    while open_:
        total = sum(w[s] for s in open_)
        above = [s for s in open_ if w[s] * left / total >= cap * sizes[s]]
        if not above:
            target |= {s: w[s] * left / total for s in open_}
            break
        for s in above:
            target[s] = cap * sizes[s]
            open_.discard(s)
        left = sum(sizes.values()) - sum(target.values())
    return target


def check(docs, slack=0):
    got = rows(mixing.mix(docs))
    sized = docs.select("doc_id", "source", mixing.word_count("text").alias("n")).collect()
    assert len(got) == len(sized)
    sizes = {}
    for r in sized:
        sizes[r.source] = sizes.get(r.source, 0) + r.n
    want = water_fill(sizes)
    by_target = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        k = (r["source_size"], round(r["target"], 6))
        by_target[k] = by_target.get(k, 0) + r["taken"]
    assert {(n, round(want[s], 6)) for s, n in sizes.items()} == set(by_target)
    assert abs(sum(by_target.values()) - sum(want.values())) <= len(sizes) + slack
    return got


def test_targets_and_taken(spark):
    got = check(table(spark, SF01, "documents"))
    again = rows(mixing.mix(table(spark, SF01, "documents").repartition(7)))
    key = lambda r: tuple(r.values())
    assert sorted(got, key=key) == sorted(again, key=key)


def test_edges(spark):
    check(edge_docs(spark), slack=4)
    assert rows(mixing.mix(empty_docs(spark))) == []
    none = edge_docs(spark).where("text is null")
    assert [r["taken"] for r in rows(mixing.mix(none))] == [0]


def test_mixed_rows_hold_the_words_taken(spark):
    docs = edge_docs(spark)
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns
    words = out.select(mixing.word_count("text").alias("n")).agg({"n": "sum"}).first()[0]
    assert words == sum(r["taken"] for r in rows(mixing.mix(docs)))
    texts = [r.text for r in docs.collect() if r.text]
    assert all(any(t.startswith(r.text) for t in texts) for r in out.collect())


def test_capped_source_gives_three_passes(spark):
    docs = spark.createDataFrame([(1, "a b c", "a"), (2, "x " * 300, "b")], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in rows(mixing.mix(docs))}
    assert got[1]["taken"] == 9 and math.isclose(got[2]["target"], 294) and got[2]["taken"] == 294


def test_many_sources_take_the_salted_join(spark, monkeypatch):
    key = lambda r: tuple(map(str, r.values()))
    want = sorted(rows(mixing.mix(edge_docs(spark))), key=key)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(rows(mixing.mix(edge_docs(spark))), key=key) == want
