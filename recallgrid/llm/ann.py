"""Operator 8: approximate nearest neighbours by inner product, over few stable projections in kd-trees.

One more coordinate makes the largest inner product the least Euclidean distance: vectors are lifted to one norm.
Gaussian projections keep distances in law: a point at distance d is projected to d^2 times a chi-square value. The
vectors are dealt into blocks; a block's projections stand in a kd-tree, whose leaves are visited from the nearest on,
and a leaf's vectors are verified by their own inner products. A query leaves a block when a vector better than its
worst result so far would, with probability ``sure``, have been projected nearer than the next leaf.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Number of projections (even, for the closed form of the chi-square distribution), vectors in a leaf, leaves in a step.
PROJECTIONS, LEAF, STEP = 8, 128, 4


def chi_square(x: np.ndarray) -> np.ndarray:
    """P[chi-square with PROJECTIONS degrees of freedom <= x]."""
    half = np.minimum(x / 2, 700)
    return 1 - np.exp(-half) * sum(half**i / math.factorial(i) for i in range(PROJECTIONS // 2))


def kd_leaves(points: np.ndarray) -> list[np.ndarray]:
    """Row numbers by leaf: each split halves the rows at the median of the widest coordinate."""
    todo, leaves = [np.arange(len(points))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF:
            leaves.append(rows)
            continue
        own = points[rows]
        order = np.argpartition(own[:, np.argmax(np.ptp(own, axis=0))], len(rows) // 2)
        todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return leaves


def search_block(vectors: np.ndarray, queries: np.ndarray, norm: float, k: int, sure: float, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(row of the vector or -1, inner product) for the k best of each query in one block; all norms are at most ``norm``."""
    dims = vectors.shape[1] + 1
    plane = np.random.default_rng(seed).standard_normal((dims, PROJECTIONS))
    lift = np.sqrt(np.maximum(norm**2 - (vectors**2).sum(axis=1), 0))
    points = vectors @ plane[:-1] + lift[:, None] * plane[-1]
    leaves = kd_leaves(points)
    low, high = (np.stack([f(points[rows], axis=0) for rows in leaves]) for f in (np.min, np.max))
    rows_of = np.full((len(leaves), max(map(len, leaves))), -1)
    for i, rows in enumerate(leaves):
        rows_of[i, : len(rows)] = rows
    at = queries @ plane[:-1]
    gap = np.zeros((len(queries), len(leaves)))
    for d in range(PROJECTIONS):
        gap += np.maximum(np.maximum(low[:, d] - at[:, d, None], at[:, d, None] - high[:, d]), 0) ** 2
    order = np.argsort(gap, axis=1, kind="stable")
    sizes = (queries**2).sum(axis=1) + norm**2
    best = np.full((len(queries), k), -1)
    score = np.full((len(queries), k), -np.inf)
    active = np.arange(len(queries))
    for first in range(0, len(leaves), STEP):
        nearest = gap[active, order[active, first]]
        reach = sizes[active] - 2 * score[active].min(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            done = np.where(reach > 0, chi_square(nearest / reach) >= sure, nearest > 0)
        active = active[~(done & np.isfinite(reach))]
        if not len(active):
            break
        visited = order[active, first : first + STEP]
        found = np.full((len(active), visited.shape[1], rows_of.shape[1]), -np.inf)
        for leaf in np.unique(visited):
            who, slot = np.nonzero(visited == leaf)
            found[who, slot, : len(leaves[leaf])] = queries[active[who]] @ vectors[leaves[leaf]].T
        everything = np.concatenate([score[active], found.reshape(len(active), -1)], axis=1)
        names = np.concatenate([best[active], rows_of[visited].reshape(len(active), -1)], axis=1)
        top = np.argpartition(-everything, k - 1, axis=1)[:, :k]
        score[active] = np.take_along_axis(everything, top, axis=1)
        best[active] = np.take_along_axis(names, top, axis=1)
    return best, score


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part: an id, finite components, not all zero, the usual length."""
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    rows = rows.where(F.forall("v", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))) & F.exists("v", lambda x: x != 0))
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (usual["n"] if usual else 0))


def nearest(vectors: DataFrame, *, k: int = 20, every: int = 20, sure: float = 0.98, block: int = 16384, query_block: int = 8192, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id is divisible by ``every``.

    Rows with a null id, a null, zero or non-finite vector, or not of the most frequent length take no part. Equal
    vectors are searched once and stand with their k + 1 smallest ids; repeated rows count once; a query's own id is no
    candidate; ties go to the smaller id. A group holds at most about ``block`` vectors and ``query_block`` queries.
    """
    rows = usable(vectors, id_column, vector_column)
    ranked = rows.withColumn("r", F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    distinct = ranked.groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    queries = rows.where(F.col("vec_id") % every == 0).distinct()
    total, norm = rows.agg(F.count("*"), F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()
    n_queries = queries.count()
    blocks, parts = max(1, -(-total // block)), max(1, -(-n_queries // query_block))
    hashed = F.xxhash64("v")
    left = distinct.select(F.pmod(hashed, F.lit(blocks)).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("p"), "v", "ids")
    right = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("b"), F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("p"), "v", "vec_id")

    def search(data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(data) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        x, q = np.stack(data["v"].to_list()), np.stack(asked["v"].to_list())
        ids = data["ids"].to_list()
        out = []
        for a in range(0, len(q), 512):
            best, score = search_block(x, q[a : a + 512], norm * (1 + 1e-9), min(k + 1, len(x)), sure)
            for own, row, value in zip(asked["vec_id"].iloc[a : a + 512], best, score):
                found = sorted((-s, i) for j, s in zip(row.tolist(), value.tolist()) if j >= 0 for i in ids[j].tolist() if i != own)
                out += [(own, i, -s) for s, i in found[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = left.groupBy("b", "p").cogroup(right.groupBy("b", "p")).applyInPandas(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
