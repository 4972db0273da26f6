"""Exact top-k search by integer inner product with MaxScore."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD, BLOCK = 16384, 2048


def maxscore(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int):
    """The k best rows of x (by inner product, ties to smaller id) for each row of q, itself (same id) left out.

    Terms are signed dimensions: a row is posted under (d, +) or (d, -) with the size of its component, longest
    first, and a query weighs only the postings that raise its score; the opposite signs are a debt that the
    bound ignores and the probe subtracts. Terms are ordered by their bound |q_d| * (largest posted size). Those
    whose bounds together stay below the k-th best score so far are non-essential: a row posted only there can't
    enter. Rows of essential postings are gathered, and dimensions are probed by falling bound while
    partial score + bounds of the dimensions left can still reach the k-th best, which rises as the best partial
    scores are completed. x and q may be of float64, where all sums of products are whole numbers below 2 ** 53.
    """
    n, dims = x.shape
    top, low = (x.max(axis=0), x.min(axis=0)) if n else (np.zeros(dims, np.int64), np.zeros(dims, np.int64))
    up, down = np.maximum(top, 0), np.maximum(-low, 0)
    by_dim = np.ascontiguousarray(x.T)
    order = np.argsort(-by_dim, axis=1, kind="stable").astype(np.int32)
    posted = {1: by_dim > 0, -1: by_dim < 0}  # the rows of each posting list
    for qi, w in zip(q_ids, q, strict=True):
        bound = np.where(w > 0, w * up, -w * down)
        terms = np.argsort(-bound, kind="stable")
        terms = terms[w[terms] != 0]
        left = np.concatenate([np.cumsum(bound[terms][::-1])[::-1], [0]])  # of the terms from here on
        head = [order[d, : 4 * k] if w[d] > 0 else order[d, n - min(n, 4 * k) :] for d in terms[:4]]
        seeds = np.unique(np.concatenate(head)) if head else np.arange(min(n, 2 * k + 1))
        seeds = seeds[ids[seeds] != qi]
        scores = x[seeds] @ w
        theta = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else None
        if theta is None:  # too few rows for a threshold: all take part
            alive, t = np.arange(n), 0
        else:
            essential = int(np.searchsorted(-left[:-1], -theta, side="right"))  # left[essential:] < theta
            if theta <= 0:  # rows of no posting reach it too
                alive = np.arange(n)
            else:
                lists = [posted[1 if w[d] > 0 else -1][d] for d in terms[:essential]]
                alive = np.flatnonzero(np.logical_or.reduce(lists)) if lists else np.zeros(0, int)
            t = 0
        part = np.zeros(len(alive), x.dtype)
        while t < len(terms):
            step = terms[t : t + 8]
            part += x[np.ix_(alive, step)] @ w[step] if len(alive) < n else x[:, step] @ w[step]
            t += len(step)
            if theta is not None and len(alive):
                if len(alive) > 4 * k and t < len(terms):
                    first = alive[np.argpartition(-part, 2 * k)[: 2 * k + 1]]
                    scores = x[first[ids[first] != qi]] @ w
                    if len(scores) >= k:
                        theta = max(theta, np.partition(scores, len(scores) - k)[len(scores) - k])
                keep = part + left[t] >= theta
                alive, part = alive[keep], part[keep]
        keep = ids[alive] != qi
        alive, part = alive[keep], part[keep]
        if len(alive) > k:
            cutoff = np.partition(part, len(part) - k)[len(part) - k]
            keep = part >= cutoff
            alive, part = alive[keep], part[keep]
        best = np.lexsort((ids[alive], -part))[:k]
        yield qi, ids[alive][best], part[best]


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.flatten() if not isinstance(flat, pa.ChunkedArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dims) if dims else np.zeros((len(column), 0), np.int64)


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: int = 256, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, id, score: the k rows of highest integer inner product for each query, itself left out.

    Components become floor(scale * x). Rows are dealt by a hash of the id to shards of about `shard` rows, queries
    to blocks of about `block`; each (shard, block) is one task's work, and its k best go on to a merge that sees k
    rows a shard for each query. Every query meets every shard, since search is exact. Shards hold
    a bounded number of rows at any input size.

    Vectors that are null, empty, or hold null or non-finite components take no part; vectors of another length
    than the query's count as zero where they have no component. Components so large that a score could pass 2 ** 63
    raise a ValueError. Repeated ids: each row is a candidate but for the
    query's own id, and equal queries count once. Fewer than k candidates: all. Empty table: no rows.
    """
    raw = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale))
    fine = F.col(id_col).isNotNull() & (F.size(vector_col) > 0) & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    rows = vectors.where(fine).select(F.col(id_col).cast("long").alias("id"), F.size(vector_col).alias("dims"), raw.alias("v"), is_query.alias("q"))
    n, n_q, dims, low, high = rows.agg(F.count("*"), F.count_if("q"), F.max("dims"), F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    dims = dims or 0
    most = dims * max(abs(low or 0), abs(high or 0)) ** 2
    if most >= 1 << 63:
        raise ValueError(f"scores of {dims} components between {low} and {high} don't fit in 63 bits")
    kind = np.float64 if most < 1 << 53 else np.int64  # whole numbers either way
    shards, blocks = max(1, -(-n // shard)), max(1, -(-n_q // block))
    wide = F.when(F.col("dims") == dims, F.col("v")).otherwise(F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.col("dims")))).alias("v")
    rows = rows.select("id", wide, "q", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("s"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int").alias("b"))
    left = rows.select("id", "v", "s", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    right = rows.where("q").select("id", "v", "b").distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("s"))

    def search(mine: pa.Table, asked: pa.Table) -> pa.Table:
        ids, q_ids = mine["id"].to_numpy(), asked["id"].to_numpy()
        out = [(np.full(len(i), qi), i, s.astype(np.int64)) for qi, i, s in maxscore(ids, _matrix(mine["v"], dims).astype(kind), q_ids, _matrix(asked["v"], dims).astype(kind), k)] if len(ids) and len(q_ids) else []
        names = ("query_id", "id", "score")
        return pa.table({c: pa.array(np.concatenate([o[j] for o in out]) if out else [], pa.int64()) for j, c in enumerate(names)})

    found = left.groupBy("s", "b").cogroup(right.groupBy("s", "b")).applyInArrow(search, "query_id long, id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


SQL_OP10 = """
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
