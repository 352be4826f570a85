import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushwin.llm import topk
from tests.llm.cases import rows

SCHEMA = "vec_id long, embedding array<float>, label int, dim long, length string"


def brute(data, is_query, k=5):
    vs = []
    for i, e in data:
        if i is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        vs.append((i, [math.floor(256 * float(np.float32(x))) for x in e]))
    out = []
    for i in sorted({i for i, _ in vs if is_query(i)}):
        mine = sorted((v for j, v in vs if j == i), key=lambda v: (len(v), v))
        q = mine[0]
        s = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in vs if j != i and len(v) == len(q))[:k]
        out += [(i, n + 1, j, -x) for n, (x, j) in enumerate(s)]
    return out


def check(spark, data, step=5):
    df = spark.createDataFrame([(i, e, 0, 1, "x") for i, e in data], SCHEMA)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows(topk.top_k(df, F.col("vec_id") % step == 0)))
    assert got == sorted(brute(data, lambda i: i % step == 0))


def vectors(rnd, n, dim, spread):
    out = []
    for i in range(n):
        length = math.exp(rnd.gauss(0, spread))
        v = [rnd.gauss(0, 1) for _ in range(dim)]
        s = length / math.sqrt(sum(x * x for x in v))
        out.append((i, [x * s for x in v]))
    return out


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_equal_to_brute_force_over_many_blocks(spark, monkeypatch, spread):
    monkeypatch.setattr(topk, "BLOCK", 40)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 20)
    data = vectors(random.Random(1), 400, 16, spread)
    data += [(1000 + i, data[7][1]) for i in range(60)]          # a common vector: ties
    check(spark, data)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (None, [1.0, 1.0]),
            (10, [0.0, 0.0]), (15, [-1.0, -1.0]), (15, [-1.0, -1.0]), (20, [1.0, 2.0, 3.0]), (25, []), (30, []), (35, [-0.001, 0.5])]
    check(spark, data)
    assert rows(topk.top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 5 == 0)) == []


def test_coordinate_pruning_loses_nothing():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(6, 12))
    c = np.floor(256 * (base[rng.integers(0, 6, 500)] + 0.1 * rng.normal(size=(500, 12)))).astype(np.int64)
    c = c[np.argsort(-(c.astype(float) ** 2).sum(1), kind="stable")]
    ids = np.arange(500)
    q, q_ids = c[::25], ids[::25]
    all_ = q @ c.T
    floor = np.array([sorted(np.delete(s, i), reverse=True)[4] for s, i in zip(all_, q_ids)], float)
    at, found, score = topk.search_block(q_ids, q, floor, ids, c, 5)
    for i in range(len(q)):
        want = sorted(((-s, j) for j, s in enumerate(all_[i]) if j != q_ids[i]))[:5]
        assert [(-s, j) for s, j in zip(score[at == i], found[at == i])] == want


def test_large_components_stay_exact():
    big = np.array([[2**40, 3], [2**40 + 1, -5]], np.int64)
    at, ids, score = topk.search_block(np.array([9]), big[:1], np.array([-np.inf]), np.array([1, 2]), big, 1)
    assert score.tolist() == [2**63 - 1]


def test_floors_take_a_block_once_and_repeated_rows_are_counted(spark, monkeypatch):
    """No group holds a block's bytes once per query, and a repeated row fills no block."""
    steps = {}

    def kept(df, name, real=topk.staged):
        out = real(df, name)
        steps[name] = (df._jdf.queryExecution().optimizedPlan().toString(), out)
        return out

    monkeypatch.setattr(topk, "staged", kept)
    monkeypatch.setattr(topk, "BLOCK", 40)
    data = vectors(random.Random(3), 200, 8, 0.5)
    data += [data[11]] * 150 + [(11, data[12][1])] * 7 + [data[10]] * 6 + [data[13]] * 2
    check(spark, data)
    assert "FlatMapGroupsInPandas" not in steps["floors"][0] and "MapInPandas" in steps["floors"][0]
    assert steps["floors"][1].count() == steps["query-blocks"][1].count()
    got = rows(steps["blocks"][1].select("ids", "count"))
    ids = [i for r in got for i in np.frombuffer(r["ids"], np.int64).tolist()]
    assert max(r["count"] for r in got) < 80
    assert (ids.count(11), ids.count(10), ids.count(13)) == (10, 5, 3)
