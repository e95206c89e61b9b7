"""Exact-bounded nearest neighbours by a block matrix join of int8 tiles.

Queries and candidates are dealt into a grid of blocks. In each tile an int8 product gives
every inner product with an error bound; a candidate survives when its upper bound reaches
the k-th largest lower bound, survivors are recomputed in double precision, and the tiles'
top k are merged per query. No true neighbour is lost, whatever the data.

Vectors that are null, empty, zero or hold null or non-finite components take no part. Rows
of one vec_id count as one vector (the smallest). Vectors are compared with vectors of the
same length only. Null vec_ids take no part. Ties go to the smaller vec_id. An empty table
gives no rows. Other columns are ignored.
"""
import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Window as W, functions as F

OUT = "query_id long, vec_id long, score double"
QUERY_BLOCK, ROW_BLOCK = 1024, 4096
#: Pairs recomputed at once, about.
SURVIVORS = 1 << 20


def quantise(x):
    """int8 codes, scales, and the norms of codes and of what the codes miss."""
    s = np.abs(x).max(axis=1) / 127.0
    s = np.where(s > 0, s, 1.0)
    c = np.rint(x / s[:, None])
    near = c * s[:, None]
    return c.astype(np.int8), s, np.linalg.norm(near, axis=1), np.linalg.norm(x - near, axis=1)


def dots(q, x, a, b):
    """Inner products of the row pairs a, b, summed in component order."""
    s = np.zeros(len(a))
    for i in range(q.shape[1]):
        s += q[a, i] * x[b, i]
    return s


def tile(qids, q, ids, x, k):
    qc, qs, qn, qe = quantise(q)
    xc, xs, xn, xe = quantise(x)
    # whole numbers below 2**53 are exact in double, so this is the int8 product itself
    est = (qc.astype(np.float64) @ xc.astype(np.float64).T) * qs[:, None] * xs[None, :]
    slack = qn[:, None] * xe[None, :] + qe[:, None] * (xn + xe)[None, :]
    slack = slack * (1 + 1e-9) + 1e-12 * (qn + qe)[:, None] * (xn + xe)[None, :] + 1e-300
    own = qids[:, None] == ids[None, :]
    low = np.where(own, -np.inf, est - slack)
    n = low.shape[1]
    bar = np.partition(low, n - k, axis=1)[:, n - k] if n > k else np.full(len(q), -np.inf)
    ok = (est + slack >= bar[:, None]) & ~own
    # survivors are recomputed a few queries at a time, so that equal vectors do not fill memory
    step = max(1, SURVIVORS // max(1, n))
    for lo in range(0, len(q), step):
        a, b = np.nonzero(ok[lo:lo + step])
        score = dots(q, x, a + lo, b)
        cuts = np.searchsorted(a, np.arange(min(step, len(q) - lo) + 1))
        for i, (l, r) in enumerate(zip(cuts[:-1], cuts[1:])):
            for s, neg in heapq.nlargest(k, zip(score[l:r], -ids[b[l:r]])):
                yield qids[lo + i], -neg, s


def search(emb, k=20, every=20, query_block=QUERY_BLOCK, row_block=ROW_BLOCK):
    """The k nearest by inner product of each vector whose vec_id is divisible by `every`."""
    e = emb.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(
        "vec_id is not null and size(v) > 0 and forall(v, c -> c is not null and not isnan(c) and abs(c) < double('inf')) and exists(v, c -> c != 0)")
    e = e.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    rows, asked = e.agg(F.count("*"), F.coalesce(F.sum((F.pmod("vec_id", F.lit(every)) == 0).cast("long")), F.lit(0))).first()
    nq, nx = max(1, math.ceil(asked / query_block)), max(1, math.ceil(rows / row_block))
    h = F.xxhash64("vec_id")
    q = e.where(F.pmod("vec_id", F.lit(every)) == 0).withColumn("qb", F.pmod(h, F.lit(nq))).withColumn("xb", F.explode(F.expr(f"sequence(0L, {nx - 1}L)")))
    x = e.withColumn("xb", F.pmod(h, F.lit(nx))).withColumn("qb", F.explode(F.expr(f"sequence(0L, {nq - 1}L)")))

    def join(l, r):
        if len(l) == 0 or len(r) == 0:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return pd.DataFrame(list(tile(l.vec_id.to_numpy(), np.vstack(l.v.to_numpy()), r.vec_id.to_numpy(), np.vstack(r.v.to_numpy()), k)), columns=["query_id", "vec_id", "score"])

    found = q.groupBy("qb", "xb", "dim").cogroup(x.groupBy("qb", "xb", "dim")).applyInPandas(join, OUT)
    return found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(
        F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE len(embedding) > 0
  AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.v, x.v) AS score
  FROM e q JOIN e x ON q.vec_id <> x.vec_id AND len(q.v) = len(x.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20"""
