"""Greedy batches over long sequences, and exact quantiles, without a key's rows in one task."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def _next(tokens: np.ndarray, most_items: int, most_tokens: int) -> np.ndarray:
    """Where the next batch starts if one starts at each item; one item too large is a batch by itself."""
    upto = np.cumsum(tokens)
    full = np.searchsorted(upto, upto - tokens + most_tokens, "right")
    at = np.arange(len(tokens))
    return np.maximum(np.minimum(full, at + most_items), at + 1)


def _placed(by: str):
    """Sorted rows: the task, and the place of each row among its key's rows there. A key's rows in one task are a run."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, key, at = TaskContext.get().partitionId(), None, 0
        for f in frames:
            starts = np.flatnonzero(f[by].ne(f[by].shift()).to_numpy())
            if len(f) and f[by].iloc[0] == key:
                starts = starts[1:]
            first = np.zeros(len(f), dtype=np.int64)
            first[:] = -at
            for s in starts:
                first[s:] = s
            place = np.arange(len(f)) - first
            if len(f):
                key, at = f[by].iloc[-1], int(place[-1]) + 1
            yield f.assign(__part=np.int32(part), __at=place)

    return run


def next_fit(items: DataFrame, order: str, tokens: str, *, most_items: int, most_tokens: int, by: str) -> DataFrame:
    """items with ``batch``: in order within ``by``, a batch is closed when the next item would pass either bound. Keys and orders
    aren't null; equal orders of a key go in any order.

    Rows are sorted over all tasks by range, so a key of any size is dealt out in runs. A batch holds ``most_items`` at most,
    so one of a run's first items starts a batch: for each of those the run tells how many batches it starts and what its last
    one holds. A stream over a key's runs, one row each, picks the start that the run before leads to, and the runs number
    their batches from it.
    """
    kinds = ", ".join(f"`{n}` {t}" for n, t in items.dtypes)
    dealt = items.repartitionByRange(by, order).sortWithinPartitions(by, order)
    placed = written(dealt.mapInPandas(_placed(by), f"{kinds}, __part int, __at long"), "items")
    key = f"`{by}` {dict(items.dtypes)[by]}"

    def summary(f: pd.DataFrame) -> pd.DataFrame:
        size = f.sort_values("__at")[tokens].to_numpy(dtype=np.int64)
        following, n = _next(size, most_items, most_tokens), len(size)
        count, last = np.ones(n, dtype=np.int64), np.arange(n)
        for i in range(n - 1, -1, -1):
            if following[i] < n:
                count[i], last[i] = count[following[i]] + 1, last[following[i]]
        starts = min(n, most_items)
        spent = np.concatenate([np.cumsum(size[::-1])[::-1], [0]])
        row = {by: f[by].iloc[0], "part": f["__part"].iloc[0], "n": n, "head": size[:starts].tolist(), "count": count[:starts].tolist(), "items": (n - last[:starts]).tolist(), "spent": spent[last[:starts]].tolist()}
        return pd.DataFrame([row])

    runs = placed.select(by, "__part", "__at", tokens).groupBy(by, "__part").applyInPandas(summary, f"{key}, part int, n long, head array<long>, count array<long>, items array<long>, spent array<long>")

    def stitched(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, spent, batch = None, 0, 0, -1
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                own = getattr(r, by)
                if own != now:
                    now, held, spent, batch = own, most_items, 0, -1
                upto = np.cumsum(r.head)
                closes = np.flatnonzero((held + np.arange(len(upto)) >= most_items) | (spent + upto > most_tokens))
                start = int(closes[0]) if len(closes) else r.n  # a run shorter than a batch may start none
                out.append((own, r.part, start, batch))
                if start < r.n:
                    held, spent, batch = r.items[start], r.spent[start], batch + r.count[start]
                else:
                    held, spent = held + r.n, spent + int(upto[-1])
            yield pd.DataFrame(out, columns=[by, "part", "start", "batch"])

    entries = runs.repartition(by).sortWithinPartitions(by, "part").mapInPandas(stitched, f"{key}, part int, start long, batch long")

    def numbered(f: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("__at")
        following, starts, at = _next(f[tokens].to_numpy(dtype=np.int64), most_items, most_tokens), np.zeros(len(f), dtype=np.int32), int(entry["start"].iloc[0])
        while at < len(f):
            starts[at] = 1
            at = following[at]
        return f.drop(columns=["__part", "__at"]).assign(batch=(int(entry["batch"].iloc[0]) + np.cumsum(starts)).astype(np.int32))

    return placed.groupBy(by, "__part").cogroup(entries.groupBy(by, "part")).applyInPandas(numbered, f"{kinds}, batch int")


def quantile(rows: DataFrame, key: str, value: str, share: str, *, parts: int = 1024) -> DataFrame:
    """(key, value): of each key's values the least that ``share`` (a decimal, as text) of them don't pass; nulls and NaN don't count.

    The range that holds the wanted rank is cut into parts, by turns by the values' logarithms and evenly, which are counted, with
    their least and largest values; the part with the rank is the next range, until it is one value. An even cut always parts
    the ends of a range. A round shuffles at most ``parts`` rows a key and task.
    """
    rows = rows.select(key, F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    rank = F.greatest(F.ceil(F.lit(Decimal(share)) * F.count("*")).cast("long"), F.lit(1).cast("long"))
    state = written(rows.groupBy(key).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), rank.alias("rank")), "ranges")
    scale = lambda x: F.signum(x) * (F.log(F.abs(x) + 1e-300) - float(np.log(1e-300)))
    even, by_scale = (lambda x: x / 2), True  # halves, so that differences don't overflow
    while not state.where("lo < hi").isEmpty():
        open_ = rows.join(state.where("lo < hi"), key).where("v BETWEEN lo AND hi")
        g, by_scale = (scale if by_scale else even), not by_scale
        wide = g(F.col("hi")) - g(F.col("lo"))
        part = F.when(wide > 0, F.floor(parts * (g(F.col("v")) - g(F.col("lo"))) / wide)).otherwise(0).cast("int")
        counted = open_.groupBy(key, "rank", part.alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b"))
        upto = F.sum("n").over(Window.partitionBy(key).orderBy("part"))
        met = counted.withColumn("upto", upto).where("upto >= rank").groupBy(key).agg(F.min(F.struct("part", "a", "b", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"))).alias("m"))
        state = written(state.where("lo = hi").union(met.select(key, "m.a", "m.b", "m.rank")), "ranges")
    return state.select(key, F.col("lo").alias(value))
