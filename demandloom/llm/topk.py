"""Exact top-k inner products with multi-resolution segment statistics.

Vectors are cut into 1, 4 and 16 segments; of each segment its mean and standard deviation are kept. For segments of
length L the squared distance of two vectors is at least ``sum L * ((mean - mean')**2 + (dev - dev')**2)``, so their
inner product is at most ``sum L * (mean * mean' + dev * dev')``: a product of short vectors. A query's candidates pass
these bounds from coarse to fine against the k-th best exact score seen so far; survivors get their exact score.

Queries and candidates meet in blocks: a cell holds at most about ``QUERY_BLOCK`` queries and ``ROW_BLOCK`` candidates,
and emits k rows per query, merged by a ranked window. Components are integers, so doubles hold all products exactly.

Vectors that are null or hold null or non-finite components take no part, nor do rows without a vec_id. Only
vectors of equal length are compared. Rows that share the query's vec_id count as its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 2048
ROW_BLOCK = 8192
LEVELS = (1, 4, 16)
SLACK = 1e-3


def usable(df: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v, dim): components as floor(scale * x)."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    good = df.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return good.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"), F.size("embedding").alias("dim")
    )


def summaries(x: np.ndarray, pieces: int) -> np.ndarray:
    """Means and deviations of the segments, times the root of the segments' lengths."""
    borders = np.linspace(0, x.shape[1], min(pieces, x.shape[1]) + 1).astype(int)
    lengths = np.diff(borders)
    mean = np.add.reduceat(x, borders[:-1], axis=1) / lengths
    square = np.add.reduceat(x * x, borders[:-1], axis=1) / lengths
    root = np.sqrt(lengths)
    return np.hstack([mean * root, np.sqrt(np.maximum(square - mean * mean, 0)) * root])


def best_of(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, candidate, score) of the k best candidates of each query; ties to the smaller id."""
    out: list[tuple[int, int, int]] = []
    if not x.size:
        return [(int(a), int(b), 0) for a in query_ids for b in np.sort(ids[ids != a])[:k]]
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    rows, asks = [summaries(x, n) for n in LEVELS], [summaries(q, n) for n in LEVELS]
    for at in range(0, len(q), 64):
        coarse = asks[0][at : at + 64] @ rows[0].T
        for r, bound in enumerate(coarse):
            own = ids == query_ids[at + r]
            bound[own] = -np.inf
            seeds = np.argpartition(-bound, min(8 * k, len(bound) - 1))[: 8 * k]
            seeds = seeds[~own[seeds]]
            if not len(seeds):
                continue
            first = np.sort(x[seeds] @ q[at + r])
            least = first[-k] if len(first) >= k else -np.inf
            left = np.flatnonzero((bound >= least - SLACK) & ~own)
            for level in range(1, len(LEVELS)):
                fine = rows[level][left] @ asks[level][at + r]
                if len(left) > 4 * k:  # a better k-th score from the most promising ones
                    top = left[np.argpartition(-fine, 2 * k)[: 2 * k]]
                    least = max(least, np.sort(x[top] @ q[at + r])[-k])
                left = left[fine >= least - SLACK]
            score = x[left] @ q[at + r]
            best = np.lexsort((ids[left], -score))[:k]
            out += [(int(query_ids[at + r]), int(ids[left[j]]), int(score[j])) for j in best]
    return out


def nearest(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of every query against all rows of ``vectors`` (vec_id, v, dim)."""
    queries = vectors.filter(is_query).dropDuplicates(["vec_id", "v"])
    n, m = vectors.count(), queries.count()
    row_blocks, query_blocks = max(1, -(-n // ROW_BLOCK)), max(1, -(-m // QUERY_BLOCK))
    spread = lambda blocks: F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    every = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    right = vectors.withColumn("row_block", spread(row_blocks)).withColumn("query_block", every(query_blocks))
    left = queries.withColumn("query_block", spread(query_blocks)).withColumn("row_block", every(row_blocks))
    cell = ["dim", "query_block", "row_block"]

    def work(asks: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(asks) and len(rows):
            x, q = (np.stack([np.asarray(v, dtype=float) for v in p["v"]]) for p in (rows, asks))
            found = best_of(rows["vec_id"].to_numpy(), x, asks["vec_id"].to_numpy(), q, k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(work, "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
