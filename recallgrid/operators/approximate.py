"""Approximate nearest vectors: inverted lists of a coarse quantiser, one-byte codes, and an exact re-score of the best."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .tables import dot, norm, unit

#: Vectors that the quantiser is fitted on at most, and rows of a list that are searched in one task.
SAMPLE, PART = 20_000, 16_384


@dataclass
class Index:
    """centres: a row a list. lists: a stored table (list, part, doc_id, code, scale), every usable row of the corpus in one list.
    parts: in how many parts each list is cut, so that a hot one is spread over tasks."""

    centres: np.ndarray
    lists: DataFrame
    parts: DataFrame


def _rows(column: pa.Array) -> np.ndarray:
    """A list column without nulls, of one length, as rows of length 1."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _centres(x: np.ndarray, lists: int, rounds: int, seed: int) -> np.ndarray:
    """Spherical k-means; an empty cluster keeps its centre."""
    c = x[np.random.default_rng(seed).permutation(len(x))[:lists]]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        c = np.where(length > 0, sums / np.where(length > 0, length, 1), c)
    return c


def encoded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One signed byte a component, and what a step is worth in each row."""
    scale = np.abs(x).max(axis=1) / 127
    return np.rint(x / scale[:, None]).astype(np.int8), scale


def build(corpus: DataFrame, *, lists: int = 128, rounds: int = 8, sample: int = SAMPLE, seed: int = 5) -> Index:
    """The index of corpus (doc_id, v). Vectors have one length; null, zero and non-finite ones take no part. The quantiser is
    fitted on the ``sample`` rows with the least hash; all rows are then dealt to the list of their nearest centre."""
    length = F.coalesce(norm(F.col("v")), F.lit(0.0))
    usable = corpus.where((length > 0) & (length < float("inf")) & ~F.exists("v", lambda x: x.isNull())).select(F.col("doc_id").cast("long").alias("doc_id"), "v")
    some = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("v").toArrow().column("v").combine_chunks()
    centres = _centres(_rows(some), lists, rounds, seed) if len(some) else np.empty((0, 0))
    held = corpus.sparkSession.sparkContext.broadcast(centres)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _rows(batch.column("v"))
                code, scale = encoded(x)
                near = (x @ held.value.T).argmax(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(near), batch.column("doc_id"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(scale)], names=["list", "doc_id", "code", "scale"])

    dealt = written(usable.mapInArrow(deal, "list int, doc_id long, code binary, scale double"), "lists")
    parts = dealt.groupBy("list").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    whole = dealt.join(parts, "list").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    return Index(centres, whole.select("list", "part", "doc_id", "code", "scale"), parts)


def probed(index: Index, queries: DataFrame, probes: int) -> DataFrame:
    """(query_id, q, list, part): each query (query_id, v) with the lists of its nearest centres, all their parts."""
    held = queries.sparkSession.sparkContext.broadcast(index.centres)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and len(held.value):
                lists = np.argsort(-(_rows(batch.column("q")) @ held.value.T), axis=1)[:, :probes]
                yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("q"), pa.array(lists.tolist(), pa.list_(pa.int32()))], names=["query_id", "q", "lists"])

    usable = queries.select(F.col("query_id").cast("long").alias("query_id"), unit(F.col("v")).alias("q")).where("q IS NOT NULL")
    near = usable.mapInArrow(nearest, "query_id long, q array<double>, lists array<int>").select("query_id", "q", F.explode("lists").alias("list"))
    return near.join(index.parts, "list").select("query_id", "q", "list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))


def _best_codes(most: int):
    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        out = {"query_id": [np.empty(0, np.int64)], "doc_id": [np.empty(0, np.int64)], "near": [np.empty(0)]}
        if len(asked) and len(rows):
            code = np.frombuffer(b"".join(rows.column("code").to_pylist()), dtype=np.int8).reshape(len(rows), -1).astype(np.float32)
            scale, ids = rows.column("scale").to_numpy(), rows.column("doc_id").to_numpy()
            mine, step = encoded(_rows(asked.column("q").combine_chunks()))
            for first in range(0, len(mine), 256):
                score = (mine[first : first + 256].astype(np.float32) @ code.T) * scale * step[first : first + 256, None]
                kept = np.argsort(-score, axis=1, kind="stable")[:, :most]
                out["query_id"].append(np.repeat(asked.column("query_id").to_numpy()[first : first + 256], kept.shape[1]))
                out["doc_id"].append(ids[kept].ravel())
                out["near"].append(np.take_along_axis(score, kept, axis=1).ravel())
        return pa.table({c: np.concatenate(x) for c, x in out.items()})

    return run


def by_code(index: Index, queries: DataFrame, *, probes: int, refine: int) -> DataFrame:
    """(query_id, doc_id): of the probed lists the ``refine`` best rows of each query by their codes."""
    asked = probed(index, queries, probes)
    near = asked.groupBy("list", "part").cogroup(index.lists.groupBy("list", "part")).applyInArrow(_best_codes(refine), "query_id long, doc_id long, near double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("near"), "doc_id"))
    return near.withColumn("n", rank).where(F.col("n") <= refine).select("query_id", "doc_id")


def approximate_top(index: Index, queries: DataFrame, corpus: DataFrame, k: int, *, probes: int, refine: int) -> DataFrame:
    """(query_id, doc_id, score, rank): the k nearest found. Lists are probed by nearness of their centres, their rows compared by
    codes, and the ``refine`` best scored exactly. Ties go to the smaller doc_id."""
    met = by_code(index, queries, probes=probes, refine=refine)
    sides = met.join(queries.select("query_id", unit(F.col("v")).alias("q")), "query_id").join(corpus.select("doc_id", unit(F.col("v")).alias("d")), "doc_id")
    scored = sides.select("query_id", "doc_id", F.round(dot(F.col("q"), F.col("d")), 9).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)
