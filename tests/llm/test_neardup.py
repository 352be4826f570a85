import random
import re

import duckdb
import pyarrow as pa

from hushwin.llm import neardup
from hushwin.llm.common import table
from hushwin.llm.queries import ORACLE
from tests.conftest import SF01
from tests.llm.cases import edge_docs, empty_docs, rows


def shingles(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", lowered) if x]
    return frozenset([tuple(w[i:i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else []))


def brute(docs):
    """Every pair that shares a shingle, compared on full sets."""
    sets = [(i, shingles(t)) for i, t in docs]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = {}
    for x, (_, s) in enumerate(sets):
        for g in s:
            index.setdefault(g, []).append(x)
    tested = set()
    for xs in index.values():
        for k, x in enumerate(xs):
            for y in xs[k + 1:]:
                if (x, y) not in tested:
                    tested.add((x, y))
                    a, b = sets[x][1], sets[y][1]
                    if 100 * len(a & b) >= 75 * len(a | b):
                        parent[root(x)] = root(y)
    least = {}
    for x, (i, _) in enumerate(sets):
        r = root(x)
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted(((i, len(s), least.get(root(x)), i == least.get(root(x))) for x, (i, s) in enumerate(sets)), key=str)


def check(docs):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in rows(neardup.near_duplicates(docs))), key=str)
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert got == want
    return got


def test_components_equal_brute_force(spark):
    got = check(table(spark, SF01, "documents"))
    assert any(not r[3] for r in got)


def test_edges(spark):
    check(edge_docs(spark))
    assert rows(neardup.near_duplicates(empty_docs(spark))) == []
    kept = neardup.kept_rows(edge_docs(spark))
    assert kept.columns == edge_docs(spark).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "3", "4", "None", "5", "6", "7", "8", "8"])


def test_hub_copies_and_shared_passage(spark):
    """Copies that are similar to one original but less to each other, and
    many documents that share a passage."""
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(4000)]
    base = [rnd.choice(vocab) for _ in range(300)]
    docs = [(1000, " ".join(base))]
    for k in range(60):
        w = list(base)
        for _ in range(rnd.randint(1, 14)):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        docs.append((k, " ".join(w)))
    passage = [rnd.choice(vocab) for _ in range(80)]
    for k in range(80):
        docs.append((2000 + k, " ".join([rnd.choice(vocab) for _ in range(rnd.randint(5, 60))] + passage)))
    check(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))


def test_one_row_of_each_group_stays_where_ids_repeat_or_are_null(spark):
    text = {x: " ".join(f"{x}{i}" for i in range(60)) for x in "abcd"}
    docs = [(3, text["a"]), (8, text["a"] + " more"), (8, text["b"]), (9, text["b"] + " more"), (None, text["c"]), (None, text["c"] + " more"),
            (None, text["c"].upper()), (None, text["a"] + " and"), (8, text["d"]), (8, text["d"] + " more"), (8, ""), (None, None), (1, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in neardup.kept_rows(df).collect()]
    words = [t for _, t in kept if t]
    assert {(i, t) for i, t in kept if not t} == {(8, ""), (None, None), (1, "")} and len(kept) == 7
    assert sorted(t[0].lower() for t in words) == ["a", "b", "c", "d"]
    assert (3, text["a"]) in kept and (8, text["b"]) in kept


def test_no_link_of_small_sets_is_lost(spark):
    """Pairs at exactly the threshold, 3 of 4, 6 of 8 and 9 of 12 shingles, which bands alone would miss at times."""
    rnd = random.Random(11)
    docs = []
    for k in range(3000):
        w = [f"w{rnd.randrange(10**6)}" for _ in range(rnd.choice([7, 10, 13]))]
        docs += [(2 * k, " ".join(w)), (2 * k + 1, " ".join([*w, *(f"x{rnd.randrange(10**6)}" for _ in range((len(w) - 4) // 3))]))]
    got = rows(neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")))
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(i, i - i % 2) for i in range(6000)]


def test_sql_equals_operator(spark):
    """The query's SQL on awkward texts: short, empty, null, equal sets in another order, chains of links."""
    words = [f"w{i}" for i in range(40)]
    texts = [None, "", " \t\n", "One two", "one  TWO", "one two three four five", "ONE two\x0bthree four five", " ".join(words), " ".join(words[:-2]), " ".join(words[:-5]),
             " ".join(words[:-9]), " ".join(words + words), " ".join(words[20:] + words[:20]), "Ä ä x y z", "ä ä x y z"]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": list(range(len(texts), 0, -1)), "text": texts}))
    want = con.execute(ORACLE["op10_minmax_near_duplicates"]).fetchall()
    docs = spark.createDataFrame(list(zip(range(len(texts), 0, -1), texts)), "doc_id long, text string")
    got = neardup.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == sorted(want)
