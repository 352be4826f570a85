"""Exact top-k inner products by norm-bucketed retrieval.

Vectors become integers, are grouped into buckets of similar length and
cut into blocks of bounded size. A query first meets the block of the
longest vectors, which gives a score that its k-th best must reach. It then
visits only blocks whose length bound can still reach it; inside a block,
the local cosine threshold (that score over the product of the query's
length and the block's greatest) chooses how candidates are pruned: by
their own length, or by their largest query coordinates. What remains is
verified by exact integer products.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hushwin.llm.common import staged

SCALE = 256
BLOCK = 4096         # vectors of a block
QUERY_BLOCK = 1024   # queries of a block
BUCKET = 1.25        # ratio of the greatest to the least length in a bucket
FOCUS = 4            # coordinates that coordinate pruning looks at
COORDINATE_FROM = 0.6   # local cosine threshold from which coordinates prune more than length
_LONG = 2**63 - 1


def vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, v, dim, length): integer components floor(SCALE * x), for
    rows whose vector has no null and no non-finite component. Components
    beyond a long are clipped to it."""
    x = F.col("embedding").cast("array<double>")
    fine = F.col("embedding").isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    v = F.transform(x, lambda e: F.floor(e * SCALE).cast("long"))
    d = rows.where(fine & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return (d.withColumn("dim", F.size("v"))
            .withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, e: acc + e.cast("double") * e.cast("double")))))


def at_most(d: DataFrame, k: int) -> DataFrame:
    """``d`` with at most ``k`` rows of each (vec_id, v). Only rows whose id
    and hash of v occur more often are grouped, and counted map-side."""
    key = d.withColumn("v_hash", F.xxhash64("v"))
    many = staged(key.groupBy("vec_id", "v_hash").agg(F.count("*").alias("n")).where(F.col("n") > k).select("vec_id", "v_hash", F.lit(True).alias("many")), "repeated")
    key = key.join(many, ["vec_id", "v_hash"], "left")
    counted = (key.where("many").groupBy("vec_id", "v", "dim", "length").agg(F.count("*").alias("n"))
               .withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")))))
    return key.where("many is null").select(d.columns).union(counted.select(d.columns))


def blocks(d: DataFrame, size: int) -> DataFrame:
    """One packed row per block: dim, block, ids and components as bytes
    (longest vector first), the greatest length and the count. A bucket is
    dealt by hash over as many blocks as its count asks for."""
    bucket = F.when(F.col("length") > 0, F.floor(F.log(F.col("length")) / math.log(BUCKET))).otherwise(F.lit(-1)).cast("int")
    d = d.withColumn("bucket", bucket)
    shards = d.groupBy("dim", "bucket").agg(F.ceil(F.count("*") / size).cast("int").alias("shards"))
    dealt = d.join(shards, ["dim", "bucket"]).withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.col("shards")).cast("int"))

    def pack(key, rows: pd.DataFrame) -> pd.DataFrame:
        dim, bucket, shard = key
        rows = rows.sort_values(["length", "vec_id"], ascending=[False, True], kind="stable")
        m = np.stack([np.asarray(x, np.int64) for x in rows.v]) if dim else np.zeros((len(rows), 0), np.int64)
        return pd.DataFrame({"dim": [dim], "block": [f"{bucket}:{shard}"], "ids": [rows.vec_id.to_numpy(np.int64).tobytes()], "data": [m.tobytes()],
                             "longest": [float(rows.length.iloc[0])], "count": [len(rows)]})

    return dealt.groupBy("dim", "bucket", "shard").applyInPandas(pack, "dim int, block string, ids binary, data binary, longest double, count long")


def _matrix(ids: bytes, data: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(data, np.int64).reshape(len(i), dim)


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products; by float matrices where every sum is below 2**53."""
    top = lambda x: max(float(np.abs(x.astype(float)).max(initial=0)), 1.0)
    if top(q) * top(c) * max(q.shape[1], 1) < 2**53:
        return (q.astype(float) @ c.T.astype(float)).astype(np.int64)
    exact = q.astype(object) @ c.T.astype(object)
    return np.array([[max(-_LONG, min(_LONG, int(x))) for x in row] for row in exact], np.int64).reshape(len(q), len(c))


def search_block(q_ids, q, floor_, c_ids, c, k: int):
    """(query row, vec_id, score) of each query's best ``k`` candidates of
    the block, at least all that reach ``floor_`` (-inf: no bound known)."""
    q_len, c_len = (np.sqrt((x.astype(float) ** 2).sum(1)) for x in (q, c))
    unit_c = c / np.maximum(c_len, 1e-300)[:, None]
    rows, ids, scores = [], [], []
    longest = float(c_len[0])
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where((q_len > 0) & (floor_ > 0) & (longest > 0), floor_ / (q_len * longest), -np.inf)
    # Queries that no product of this block can satisfy are out, all others are grouped by the way they prune.
    alive = ~(local > 1 + 1e-9) & ~((floor_ > 0) & ((q_len == 0) | (longest == 0)))
    by_length = np.flatnonzero(alive & ~(local >= COORDINATE_FROM))
    for part in np.array_split(by_length, max(1, len(by_length) * len(c) >> 22)):
        if not len(part):
            continue
        # Lengths fall along the block: the shortest that any query of the part needs.
        need = np.where(floor_[part] > 0, floor_[part] / np.maximum(q_len[part], 1e-300), 0).min() * (1 - 1e-9)
        upto = int(np.searchsorted(-c_len, -need, "right")) if need > 0 else len(c)
        _best(part, q_ids, _products(q[part], c[:upto]), c_ids[:upto], floor_, k, rows, ids, scores)
    for i in np.flatnonzero(alive & (local >= COORDINATE_FROM)):
        unit = q[i] / q_len[i]
        # A cosine of at least t keeps each coordinate of the unit candidate on the query's side of t times its own, give or take.
        t = floor_[i] / (q_len[i] * c_len)
        keep = np.flatnonzero(t <= 1 + 1e-9)
        for f in np.argsort(-np.abs(unit))[:FOCUS]:
            cos = np.minimum(t[keep], 1)
            reach = np.sqrt(np.maximum(1 - cos**2, 0) * max(1 - unit[f] ** 2, 0)) + 1e-9
            x = unit_c[keep, f]
            keep = keep[x >= cos * unit[f] - reach] if unit[f] >= 0 else keep[x <= cos * unit[f] + reach]
        if len(keep):
            _best(np.array([i]), q_ids, _products(q[i:i + 1], c[keep]), c_ids[keep], floor_, k, rows, ids, scores)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(ids), np.concatenate(scores)


def _best(part, q_ids, products, c_ids, floor_, k, rows, ids, scores) -> None:
    for i, s in zip(part, products):
        fine = c_ids != q_ids[i]
        if floor_[i] > -np.inf:
            fine &= s >= floor_[i]
        at = np.flatnonzero(fine)
        if len(at) > k:
            least = np.partition(s[at], len(at) - k)[len(at) - k]
            at = at[s[at] >= least]
        at = at[np.lexsort((c_ids[at], -s[at]))][:k]
        rows.append(np.full(len(at), i))
        ids.append(c_ids[at])
        scores.append(s[at])


def _search(pairs: DataFrame, k: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for r in batch.to_dict("records"):
                q_ids, q = _matrix(r["q_ids"], r["q_data"], r["dim"])
                c_ids, c = _matrix(r["ids"], r["data"], r["dim"])
                at, ids, scores = search_block(q_ids, q, np.frombuffer(r["floors"], float), c_ids, c, k)
                yield pd.DataFrame({"query_id": q_ids[at], "vec_id": ids, "score": scores, "dim": r["dim"], "q_block": r["q_block"]})

    return pairs.select("dim", "q_block", "q_ids", "q_data", "floors", "ids", "data").mapInPandas(run, "query_id long, vec_id long, score long, dim int, q_block string")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(rows: DataFrame, is_query, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` greatest integer products
    of every query row with all rows but its own, ties to the smaller
    vec_id; fewer if there are fewer. Only vectors of equal dimension are
    compared. Rows that repeat an id are the id's own rows, as queries (each
    id answers once, with its first vector in order) and as candidates (each
    row counts). An empty table gives no rows.

    Queries meet rows in blocks: a block pair is one row of packed bytes, a
    few MB, and pairs that the length bound excludes are never joined."""
    d = staged(vectors(rows), "vectors")
    own = d.where(is_query).groupBy("vec_id", "dim").agg(F.min(F.struct("v", "length")).alias("first")).select("vec_id", F.col("first.v").alias("v"), "dim", F.col("first.length").alias("length"))
    first_dim = own.groupBy("vec_id").agg(F.min("dim").alias("dim"))
    own = own.join(first_dim, ["vec_id", "dim"])
    c = staged(blocks(at_most(d, k), BLOCK), "blocks")    # of equal rows a query needs no more
    q = blocks(own, QUERY_BLOCK).select("dim", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.col("longest").alias("q_longest"))
    q = staged(q, "query-blocks")
    # First the longest block of each dimension, for a floor under every query's k-th score.
    longest = c.groupBy("dim").agg(F.max(F.struct("longest", "block")).alias("m")).select("dim", F.col("m.block").alias("block"))
    no_floor = F.udf(lambda ids: np.full(len(ids) // 8, -np.inf).tobytes(), "binary")
    first = staged(_search(q.withColumn("floors", no_floor("q_ids")).join(longest, "dim").join(c, ["dim", "block"]), k), "first-scores")
    # A block's floors are one row of at most its queries' numbers; the bytes join that row once.
    kth = (_top(first, k).where(F.col("rank") == k).groupBy("dim", "q_block").agg(F.collect_list(F.struct("query_id", "score")).alias("kth"))
           .select("dim", "q_block", F.col("kth.query_id").alias("known"), F.col("kth.score").alias("scores")))

    def floors(batches):
        for batch in batches:
            for r in batch.to_dict("records"):
                ids, m = _matrix(r["q_ids"], r["q_data"], r["dim"])
                known = dict(zip(r["known"], r["scores"])) if r["known"] is not None else {}
                f = np.array([float(known.get(i, -np.inf)) for i in ids])
                # The block's weakest demand per unit of query length: what a candidate's length must reach.
                need = np.where(f > 0, f / np.maximum(np.sqrt((m.astype(float) ** 2).sum(1)), 1e-300), -np.inf)
                yield pd.DataFrame({"dim": [r["dim"]], "q_block": [r["q_block"]], "floors": [f.tobytes()], "need": [float(need.min())]})

    asked = (q.join(kth, ["dim", "q_block"], "left").select("dim", "q_block", "q_ids", "q_data", "known", "scores")
             .mapInPandas(floors, "dim int, q_block string, floors binary, need double"))
    asked = staged(asked, "floors")
    # Pairs of block names only; the bytes join after pruning.
    sizes = c.select("dim", "block", "longest").join(longest.select("dim", F.col("block").alias("done")), "dim")
    pairs = (asked.select("dim", "q_block", "need").join(sizes, "dim")
             .where((F.col("block") != F.col("done")) & (F.col("longest") >= F.col("need") * (1 - 1e-9))).select("dim", "q_block", "block"))
    rest = _search(pairs.join(q, ["dim", "q_block"]).join(asked.select("dim", "q_block", "floors"), ["dim", "q_block"]).join(c, ["dim", "block"]), k)
    return _top(first.union(rest), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
