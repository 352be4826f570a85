from collections import Counter

import numpy as np

from pyspark.sql import functions as F

from hushwin.llm import langid
from hushwin.llm.common import table
from hushwin.llm.queries import op4_rank_order_language
from tests.conftest import SF01
from tests.llm.cases import edge_docs, empty_docs, rows


def grams(text):
    out, word = Counter(), ""
    for c in text.lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            padded = " " + word + " "
            out.update(word)
            out.update(padded[i:i + 2] for i in range(len(padded) - 1))
            out.update(padded[i:i + 3] for i in range(len(padded) - 2))
            word = ""
    return out


def test_keys_count_like_strings():
    for text in ("", "a", "The cat, the dog.", "x y", "Größe über 日本語 ab1cd", "   ", "É\n\nè"):
        want = grams(text)
        got = Counter(langid.gram_keys(text).tolist())
        assert sorted(got.values()) == sorted(want.values()), text


def test_distance_equals_definition():
    rng = np.random.default_rng(2)
    by = {x: (50_000 + rng.choice(1000, 50, replace=False)).astype(np.uint64) for x in ("aa", "bb", "cc")}
    model = langid.RankModel(by, 50)
    text = "some words that make a profile of their own"
    top = langid.ranked(langid.gram_keys(text), 50).tolist()
    by["bb"] = np.concatenate((np.array(top[5:25], np.uint64), by["bb"][20:]))
    model = langid.RankModel(by, 50)
    dist = {k: sum(abs(i - v.tolist().index(g)) if g in v.tolist() else 50 for i, g in enumerate(top)) for k, v in by.items()}
    best = min(dist, key=lambda k: (dist[k], k))
    assert model.predict(text) == (best, 1 - dist[best] / (50 * len(top)))


def test_held_out_accuracy(spark):
    docs = table(spark, SF01, "documents")
    got = {r["doc_id"]: r for r in rows(op4_rank_order_language(spark, SF01))}
    true = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [i for i, r in got.items() if r["held_out"]]
    assert len(got) == len(true) and len(held) > 100
    assert np.mean([got[i]["lang_pred"] == true[i] for i in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_edges(spark):
    got = rows(langid.identify(edge_docs(spark)))
    assert len(got) == 11
    und = {r["doc_id"] for r in got if r["lang_pred"] == "und"}
    assert und >= {2, 3, 4} and not und & {5, 7}
    assert rows(langid.identify(empty_docs(spark))) == []
    unlabelled = edge_docs(spark).selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r["lang_pred"] for r in rows(langid.identify(unlabelled))} == {"und"}


def test_rows_without_ids_and_of_one_id_are_sampled_each(spark):
    """All ids null, or one id for all rows: a bounded sample is learned, as with ids of their own."""
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    for one in (docs.withColumn("doc_id", F.lit(None).cast("long")), docs.withColumn("doc_id", F.lit(8).cast("long"))):
        assert set(langid.profiles(one, sample=300)) == {"de", "en", "es", "fr"}
    copies = spark.range(10_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same words of one text").alias("text"), F.lit("en").alias("lang"))
    assert set(langid.profiles(copies.union(docs.select("doc_id", "text", "lang")), sample=300)) == {"de", "en", "es", "fr"}


def test_languages_are_those_with_most_documents(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGS", 2)
    docs = table(spark, SF01, "documents")
    want = [r.lang for r in docs.where("lang is not null").where(~(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2))
            .groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(2).collect()]
    assert sorted(langid.profiles(docs)) == sorted(want)
