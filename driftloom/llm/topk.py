"""Exact top-k by inner product with no-random-access aggregation over sorted lists.

Queries and candidates are dealt into blocks of bounded size and each pair of blocks is one task.  In a block each
dimension is a list of candidates sorted by its component, read from the end that suits the sign of the query's;
all queries of a block read the same lists to the same depth, so their bounds are sums of matrix products.
The lists are read down in parallel, ``ROUNDS`` times a stretch of equal length.  What has been met of a candidate gives a lower
bound of its score (the dimensions in which it wasn't met filled with the list's worst value) and an upper one (filled
with the value where the list stands).  Candidates whose upper bound is below the k-th best lower bound cannot qualify;
reading stops as soon as few others are left, or the lists end, and only then are these candidates' scores resolved.
Blocks of candidates that follow start from the k-th best score so far; results are merged per query.  Ties stay in
the running, so the result is exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries and candidates of a block, candidates whose lists are read together, and stretches in which lists are read.
QUERY_BLOCK, CANDIDATE_BLOCK, LIST_ROWS, ROUNDS = 512, 8192, 4096, 4


def quantised(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) per component, x as double; null if the vector or a component is null or not finite."""
    x = F.transform(vector, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(x, lambda v: F.floor(v * scale).cast("long")))


class SortedLists:
    """Candidates (n x d integers) as one ascending list per dimension."""

    def __init__(self, values: np.ndarray):
        # inner products of these are exact in double precision where they stay below 2**53
        top = float(np.abs(values).max(initial=0))
        self.values = values.astype(np.float64) if top * top * 4 * max(1, values.shape[1]) < 2**53 else values
        order = np.argsort(values, axis=0, kind="stable")
        self.sorted = np.take_along_axis(values, order, 0).astype(np.float64)
        self.place = np.empty(order.shape, np.int32)  # of each candidate in each list
        np.put_along_axis(self.place, order, np.arange(len(values), dtype=np.int32)[:, None], 0)
        self.read = 0

    def nra(self, queries: np.ndarray, k: int, skip: np.ndarray, least: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (a row): (candidates, exact scores) with all that can be among the k best and reach ``least``, its
        k-th best score so far; ``skip`` (queries x candidates) marks rows that take no part."""
        n, values = len(self.values), self.values.astype(np.float64)
        alive, open_ = ~skip, np.arange(len(queries))  # queries that still read
        for r in range(1, ROUNDS + 1):
            open_ = open_[alive[open_].sum(1) > 2 * k]  # of the others, no outsider can qualify any more
            if not len(open_):
                break
            upto = -(-n * r // ROUNDS)
            self.read = max(self.read, upto)
            up, down = np.maximum(queries[open_], 0).astype(np.float64), np.minimum(queries[open_], 0).astype(np.float64)
            high, low = self.place >= n - upto, self.place < upto  # met from the upper and from the lower end
            seen = up @ (values * high).T + down @ (values * low).T
            high, low = (~high).T.astype(np.float64), (~low).T.astype(np.float64)
            lower = seen + (up * self.sorted[0]) @ high + (down * self.sorted[-1]) @ low
            upper = seen + (up * self.sorted[n - upto]) @ high + (down * self.sorted[upto - 1]) @ low
            slack = 1e-9 * (1 + (up - down).sum(1) * float(np.abs(self.sorted).max(initial=0)))
            lower[~alive[open_]] = -np.inf
            bound = least[open_]
            if n >= k:
                bound = np.maximum(bound, np.partition(lower, n - k, axis=1)[:, n - k])
            alive[open_] &= upper + 2 * slack[:, None] >= bound[:, None]
        return [(at, self.scores(at, q)) for q, at in zip(queries, map(np.flatnonzero, alive), strict=True)]

    def scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Exact inner products."""
        small = self.values.dtype == np.float64 and float(np.abs(query).max(initial=0)) * float(np.abs(self.values).max(initial=0)) * len(query) < 2**53
        return (self.values[rows] @ query.astype(np.float64)).astype(np.int64) if small else self.values[rows].astype(np.int64) @ query


def _pair(k: int, n_dims: int):
    def run(key, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(rows):
            ids = rows["id"].to_numpy(np.int64)
            pad = lambda col: np.array([np.pad(np.asarray(v, np.int64), (0, n_dims - len(v))) for v in col]).reshape(len(col), n_dims)
            values = pad(rows["v"])
            lists = [(a, SortedLists(values[a : a + LIST_ROWS])) for a in range(0, len(ids), LIST_ROWS)]
            asked, vectors = queries["id"].to_numpy(np.int64), pad(queries["v"])
            least, parts = np.full(len(asked), -np.inf), [[] for _ in asked]
            for start, part in lists:
                own = asked[:, None] == ids[None, start : start + len(part.values)]
                for j, (at, score) in enumerate(part.nra(vectors, k, own, least)):
                    best = np.lexsort((ids[at + start], -score))[:k]
                    parts[j].append((at[best] + start, score[best]))
                    every = np.concatenate([x for _, x in parts[j]])
                    if len(every) >= k:
                        least[j] = np.partition(every, len(every) - k)[len(every) - k]
            for q, found in zip(asked, parts, strict=True):
                at, score = (np.concatenate(x) for x in zip(*found, strict=True))
                best = np.lexsort((ids[at], -score))[:k]
                out.append(pd.DataFrame({"query_id": q, "vec_id": ids[at][best], "score": score[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    return run


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for every query row, ties to the smaller id.

    Rows with a null id or a vector that is null or holds a null or non-finite component take no part; shorter vectors
    count as filled up with 0; rows that repeat an id and a vector count once; a query never finds its own id.
    """
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("v"), is_query.alias("q"))
    rows = rows.where(F.col("v").isNotNull()).dropDuplicates(["id", "v"])
    size = rows.agg(F.count("*").alias("n"), F.count_if("q").alias("q"), F.max(F.size("v")).alias("d")).first()
    many = lambda n, per: max(1, -(-n // per))
    nq, nc = many(size["q"], QUERY_BLOCK), many(size["n"], CANDIDATE_BLOCK)
    deal = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    span = lambda n: F.explode(F.array(*[F.lit(i) for i in range(n)]) if n < 64 else F.sequence(F.lit(0), F.lit(n - 1)))
    queries = rows.where("q").select("id", "v", deal(nq, 1).alias("qb"), span(nc).alias("cb"))
    candidates = rows.select("id", "v", deal(nc, 2).alias("cb"), span(nq).alias("qb"))
    found = queries.groupBy("qb", "cb").cogroup(candidates.groupBy("qb", "cb")).applyInPandas(_pair(k, size["d"] or 1), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
