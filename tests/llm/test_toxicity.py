import itertools

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from hushwin.llm import toxicity
from hushwin.llm.common import table
from tests.llm.cases import edge_docs, empty_docs, rows

SF01 = "/root/testdata/sf0.01"
SF1 = "/root/testdata/sf0.1"


def brute_segments(score):
    """All maximal scoring subsequences by their recursive definition."""
    n = len(score)
    best = max(((sum(score[a:b]), a, b) for a, b in itertools.combinations(range(n + 1), 2)), key=lambda x: (x[0], x[1] - x[2]), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    _, a, b = best
    left, right = brute_segments(score[:a]), brute_segments(score[b:])
    return left + [(a, b, best[0])] + [(x + b, y + b, s) for x, y, s in right]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-6, 6).filter(bool), max_size=14))
def test_segments_equal_definition(score):
    got = toxicity.maximal_segments(np.array(score, float))
    assert sorted(s for *_, s in got) == sorted(float(s) for *_, s in brute_segments(score))
    assert all(sum(score[a:b]) == s for a, b, s in got)


def test_held_out_quality(spark):
    docs, labels = table(spark, SF1, "documents"), table(spark, SF1, "labels")
    judged = rows(toxicity.judge(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out"))
    pos, neg = ([r["score"] for r in judged if r["toxic"] == t] for t in (1, 0))
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.9
    assert np.mean([r["predicted"] for r in judged if r["toxic"]]) > 0.8
    assert np.mean([r["predicted"] for r in judged if not r["toxic"]]) < 0.05


def test_passages_lie_on_the_words():
    model = toxicity.Model({"foul": 5.0, "stink*": 4.0})
    (n, found), (_, none) = model.passages(pa.array(["a b foul, FOUL! c " + "d " * 30 + "stinking end", None]))
    assert n == 37 and none == []
    assert [(a, b) for a, b, _ in found] == [(2, 4), (35, 36)]


def test_edges(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (5, 0, 0), (6, None, None), (None, 1, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")
    got = rows(toxicity.judge(docs, labels))
    assert len(got) == 11 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (2, 3, 4)}) == 1
    assert rows(toxicity.judge(empty_docs(spark), labels)) == []
    assert len(rows(toxicity.judge(docs, labels.limit(0)))) == 11


def test_scores_do_not_read_labels_of_the_held_out_fold(spark):
    docs, labels = table(spark, SF01, "documents"), table(spark, SF01, "labels")
    other = labels.selectExpr("doc_id", "quality", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    key = lambda r: r["doc_id"]
    a, b = (sorted(rows(toxicity.judge(docs, x).select("doc_id", "score")), key=key) for x in (labels, other))
    assert a == b


def test_a_labelled_id_of_many_rows_brings_its_part(spark):
    """30,000 rows share labelled ids: the sample stays near its size, and repeated texts count once."""
    docs = spark.range(30_000).select((F.col("id") % 40 + 1).alias("doc_id"), F.concat(F.lit("text number "), F.col("id")).alias("text"))
    labels = spark.range(1, 60).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    n = toxicity.training_rows(docs, labels, sample=600).count()
    assert 450 < n < 750
    same = docs.withColumn("text", F.lit("one text"))
    assert toxicity.training_rows(same, labels, sample=10**6).count() == 2
    assert toxicity.training_rows(docs.withColumn("doc_id", F.lit(None).cast("long")), labels).count() == 0
