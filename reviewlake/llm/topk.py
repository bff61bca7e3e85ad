"""Exact top-k inner products by no-random-access aggregation over sorted lists.

A block of candidate vectors has one list for each component, sorted by value. For a query a list is read from the end that
gives it the larger products, all lists one step further at a time. What has been read of a candidate counts as it is; what has not
contributes at most as much as the last entry read of its list, and at least as much as the list's other end. So every candidate
has an upper and a lower bound. Candidates whose upper bound is below the k-th best lower bound are out; when few enough are
left, or everything has been read, their final scores are resolved.

Queries and candidates meet in blocks: each task holds one block of either. The lists are read once for all queries of a block,
whose bounds are products of their positive and negative parts with what has been read from the top and from the bottom.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlake.llm.shared import keep

CANDIDATES = 4096
QUERIES = 256
STEPS = 16
"""Steps in which a list is read from end to end."""
FIRST_LOOK = 8
"""Step from which bounds are compared; with less than half read they are too wide to rule anything out."""
FEW = 16
"""Reading ends when no query has more than one candidate in so many left."""


class SortedLists:
    """The lists of a block of candidates: for each component its values in order."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[by_id], vectors[by_id]
        self.largest = int(np.abs(self.vectors).max(initial=0))
        self.order = np.argsort(self.vectors, axis=0, kind="stable")
        self.resolved = self.seen = 0

    def top(self, queries: np.ndarray, k: int, own: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query ids and scores of the k best candidates but ``own``, ties to the smaller id."""
        others = self.ids[None, :] != own[:, None]
        alive = self.read(queries, k, others) if len(self.ids) > 4 * k and queries.shape[1] else others
        self.resolved += int(alive.sum())
        self.seen += int(others.sum())
        out = []
        for query, left in zip(queries, alive, strict=True):
            at = np.flatnonzero(left)
            score = self.vectors[at] @ query
            best = np.lexsort((self.ids[at], -score))[:k]
            out.append((self.ids[at][best], score[best]))
        return out

    def read(self, queries: np.ndarray, k: int, others: np.ndarray) -> np.ndarray:
        """Which candidates may be among the k best of each query."""
        n = len(self.ids)
        # Whole numbers up to 2^53 are exact as doubles, and so are their sums and products.
        exact = self.largest * int(np.abs(queries).sum(axis=1).max(initial=0)) < 1 << 53
        kind = np.float64 if exact else np.int64
        values = self.vectors.astype(kind)
        ordered = np.take_along_axis(values, self.order, axis=0)
        least = np.iinfo(np.int64).min // 2
        up, down = np.maximum(queries, 0).astype(kind), np.minimum(queries, 0).astype(kind)
        from_top, from_bottom = np.zeros(values.shape, bool), np.zeros(values.shape, bool)
        alive, done = others, 0
        for step in range(1, STEPS):
            depth = n * step // STEPS
            np.put_along_axis(from_top, self.order[n - depth:n - done], True, axis=0)
            np.put_along_axis(from_bottom, self.order[done:depth], True, axis=0)
            done = depth
            if step < FIRST_LOOK or not depth:
                continue
            low = (up @ np.where(from_top, values, ordered[0]).T + down @ np.where(from_bottom, values, ordered[-1]).T)
            low = np.where(others, low, least)
            bar = np.partition(low, n - k, axis=1)[:, n - k]
            high = (up @ np.where(from_top, values, ordered[n - depth]).T
                    + down @ np.where(from_bottom, values, ordered[depth - 1]).T)
            # An equal bound may still win by its id.
            alive = alive & (high >= bar[:, None])
            if alive.sum(axis=1).max(initial=0) <= max(4 * k, n // FEW):
                break
        return alive


def search_block(key, queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    out = []
    for length, own in candidates.groupby(candidates.vector.map(len)):
        asked = queries[queries.vector.map(len) == length]
        if not len(asked):
            continue
        lists = SortedLists(own.vec_id.to_numpy(np.int64), np.stack(own.vector.to_numpy()).astype(np.int64))
        found = lists.top(np.stack(asked.vector.to_numpy()).astype(np.int64), k, asked.vec_id.to_numpy(np.int64))
        for q, n, (ids, scores) in zip(asked.vec_id, asked.copy_no, found, strict=True):
            out.append(pd.DataFrame({"query_id": q, "copy_no": n, "vec_id": ids, "score": scores}))
    return pd.concat(out) if out else pd.DataFrame(
        {c: np.zeros(0, np.int64) for c in ("query_id", "copy_no", "vec_id", "score")})


def whole_vectors(rows: DataFrame, scale: int = 1024) -> DataFrame:
    """``vec_id`` and the vector in steps of 1 / ``scale``; rows with nulls or numbers that are not finite go."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
            .filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad)
            .select("vec_id", F.transform("embedding", lambda x: F.floor(x * scale).cast("long")).alias("vector")))


def top_products(queries: DataFrame, candidates: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k highest inner products with candidates of another id.

    Both inputs: ``vec_id`` and ``vector`` (array of long). All candidates if there are fewer; ties go to the smaller
    vec_id. Vectors of another length than the query's, and empty vectors against any but empty ones, are not compared.
    A query that repeats is answered for each copy; a candidate that repeats can be in a result more than once. Without
    queries or candidates there are no rows. Vectors hold whole numbers whose products fit into 64 bits.
    """
    queries, candidates = keep(queries.withColumn("copy_no", F.monotonically_increasing_id())), keep(candidates)
    parts = max(1, -(-candidates.count() // CANDIDATES))
    groups = max(1, -(-queries.count() // QUERIES))
    spread = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = (queries.withColumn("part", every(parts)).withColumn("block", spread(groups)))
    given = (candidates.withColumn("part", spread(parts)).withColumn("block", every(groups)))
    found = (asked.groupBy("part", "block").cogroup(given.groupBy("part", "block"))
             .applyInPandas(lambda key, a, b: search_block(key, a, b, k),
                            "query_id long, copy_no long, vec_id long, score long"))
    order = Window.partitionBy("query_id", "copy_no").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def nearest_vectors(embeddings: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """The k best others for each row whose vec_id is divisible by ``every``."""
    vectors = whole_vectors(embeddings)
    return top_products(vectors.filter(F.col("vec_id") % every == 0), vectors, k)
