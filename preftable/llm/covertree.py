"""Exact top-k inner products by dual-tree search over cover trees.

Queries and data are dealt to blocks of bounded size, and every query block meets every data block
in one task. There, both sides are indexed by a cover tree (a node's children are centres at
least a shrunken radius apart, until the rest lies within that of one of them; each node keeps its
true covering radius). Pairs of nodes are taken best first: with centres q, p and radii R, r no inner product
under the pair exceeds ``<q,p> + R|p| + r|q| + Rr``, so the pair is dropped if that is below the
worst k-th score of the query node's group. Leaves are compared exactly, in whole numbers. The best
k of each block are merged by a window for each query.

Defined cases: vectors that are null or empty or hold a null or non-finite component take no part;
rows that repeat an id count once (the least vector); vectors of different lengths don't meet; ties
go to the smaller id; a table without rows gives no rows; other columns are ignored. Inner products
must fit a long.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from preftable.llm.ship import ship_package

BLOCK_VECTORS = 16_384  # vectors in a data block, in expectation
BLOCK_QUERIES = 4_096
LEAF = 256
CHILDREN = 12  # centres of a node; the radii stay true whatever is left
SHRINK = 0.7
SCALE = 1024


class CoverTree:
    """Nodes hold points ``order[lo:hi]``; ``kids`` are node numbers (none: a leaf)."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x = x
        self.order = np.arange(len(x))
        self.lo, self.hi, self.centre, self.radius, self.kids = [], [], [], [], []
        todo = [(0, len(x), 0, -1)]
        while todo:
            lo, hi, c, parent = todo.pop()
            me = len(self.lo)
            if parent >= 0:
                self.kids[parent].append(me)
            own = self.order[lo:hi]
            d = np.sqrt(((x[own] - x[c]) ** 2).sum(axis=1))
            r = float(d.max())
            for name, v in (("lo", lo), ("hi", hi), ("centre", c), ("radius", r), ("kids", [])):
                getattr(self, name).append(v)
            if hi - lo <= leaf or r == 0:
                continue
            centres, near = [c], np.zeros(hi - lo, np.int64)
            while len(centres) < CHILDREN:
                far = int((d > SHRINK * r).argmax())
                if d[far] <= SHRINK * r:
                    break
                centres.append(int(own[far]))
                e = np.sqrt(((x[own] - x[own[far]]) ** 2).sum(axis=1))
                closer = e < d
                near[closer], d = len(centres) - 1, np.minimum(d, e)
            if len(centres) == 1:
                continue
            by = np.argsort(near, kind="stable")
            self.order[lo:hi] = own[by]
            ends = np.cumsum(np.bincount(near, minlength=len(centres)))
            for k, e in enumerate(ends.tolist()):
                s = 0 if k == 0 else int(ends[k - 1])
                if e > s:
                    todo.append((lo + s, lo + e, centres[k], me))
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)
        self.points = x[self.centre]
        self.norm = np.sqrt((self.points**2).sum(axis=1))


def top_k(qid: np.ndarray, q: np.ndarray, did: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query ids, ids, scores)`` of each query's best k of a block (its own id excluded)."""
    if not len(q) or not len(d):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    biggest = float(np.abs(q).max(initial=0)) * float(np.abs(d).max(initial=0)) * q.shape[1]
    exact = np.float64 if biggest < 2**53 else np.int64  # doubles hold whole numbers up to 2^53
    qt, dt = CoverTree(q.astype(np.float64)), CoverTree(d.astype(np.float64))
    qx, dx = q.astype(exact)[qt.order], d.astype(exact)[dt.order]
    qi, di = qid[qt.order], did[dt.order]
    low = np.iinfo(np.int64).min
    best_s, best_i = np.full((len(q), k), low), np.full((len(q), k), np.iinfo(np.int64).max)

    def worst(n: int) -> int:
        return int(best_s[qt.lo[n] : qt.hi[n], -1].min())

    def bounds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The most that any pair under the nodes a and b scores (with room for rounding)."""
        most = (qt.points[a] * dt.points[b]).sum(axis=1)
        slack = qt.radius[a] * dt.norm[b] + dt.radius[b] * qt.norm[a] + qt.radius[a] * dt.radius[b]
        return most + slack + 1e-9 * (np.abs(most) + slack) + 1e-6

    first = bounds(np.array([0]), np.array([0]))[0]
    heap = [(-first, 0, 0)]
    while heap:
        bound, a, b = heapq.heappop(heap)
        if -bound < worst(a):
            continue
        if qt.kids[a] and (qt.radius[a] >= dt.radius[b] or not dt.kids[b]):
            pa, pb = np.array(qt.kids[a]), np.full(len(qt.kids[a]), b)
        elif dt.kids[b]:
            pa, pb = np.full(len(dt.kids[b]), a), np.array(dt.kids[b])
        else:
            _compare(qx, qi, dx, di, slice(qt.lo[a], qt.hi[a]), slice(dt.lo[b], dt.hi[b]), best_s, best_i)
            continue
        for u, m, n in zip(bounds(pa, pb).tolist(), pa.tolist(), pb.tolist()):
            heapq.heappush(heap, (-u, m, n))
    real = best_s != low
    return np.repeat(qi, real.sum(axis=1)), best_i[real], best_s[real]


def _compare(qx, qi, dx, di, a: slice, b: slice, best_s: np.ndarray, best_i: np.ndarray) -> None:
    """All pairs of two leaves, into the best lists."""
    s = (qx[a] @ dx[b].T).astype(np.int64)
    own = qi[a][:, None] == di[b][None, :]
    s[own] = np.iinfo(np.int64).min
    rows = np.flatnonzero((s >= best_s[a, -1:]).any(axis=1))
    if not len(rows):
        return
    at = rows + a.start
    ids = np.broadcast_to(di[b], s.shape)[rows]
    ids = np.where(own[rows], np.iinfo(np.int64).max, ids)
    scores = np.concatenate([best_s[at], s[rows]], axis=1)
    ids = np.concatenate([best_i[at], ids], axis=1)
    order = np.lexsort((ids, -scores.astype(np.float64) if abs(scores[scores > np.iinfo(np.int64).min]).max(initial=0) < 2**53 else ~scores))[:, : best_s.shape[1]]
    best_s[at], best_i[at] = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def whole_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``id, v``: components as ``floor(scale * x)``, without vectors that take no part."""
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    good = df.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & ~bad)
    v = F.transform(vector_col, lambda x: F.floor(F.lit(scale) * x.cast("double")))
    return good.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).groupBy("id").agg(F.min("v").alias("v"))


def search(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score``: the best ``k`` other rows for each row of ``vectors`` (``id, v``)
    with ``is_query``."""
    ship_package(vectors.sparkSession)
    rows = vectors.withColumn("dim", F.size("v"))
    queries = rows.filter(is_query)
    n, m = rows.count(), queries.count()  # two numbers: how many blocks
    slabs, groups = max(1, -(-n // BLOCK_VECTORS)), max(1, -(-m // BLOCK_QUERIES))
    deal = lambda parts: F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    left = queries.select("dim", F.explode(F.sequence(F.lit(0), F.lit(slabs - 1))).alias("slab"), deal(groups).alias("part"), "id", "v")
    right = rows.select("dim", deal(slabs).alias("slab"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"), "id", "v")

    def block(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(d):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        q, d = q.sort_values("id"), d.sort_values("id")
        a, b, s = top_k(q["id"].to_numpy(np.int64), np.stack(q["v"].to_list()), d["id"].to_numpy(np.int64), np.stack(d["v"].to_list()), k)
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": s})

    keys = ["dim", "slab", "part"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(block, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
