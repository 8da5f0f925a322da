"""Operator 11: ranked lexical search with range-maximum tables over posting lists.

Documents are indexed in blocks. A term's posting list holds the impacts of its documents, and a sparse table over it
gives the largest impact in any interval of documents. Weighted and summed over an item's terms these maxima bound
every score in the interval. The interval with the highest bound goes first: it is split at the document of its largest
impact, which is scored, and the two intervals left are bounded anew. It ends when no bound reaches the k-th
score so far. A task keeps an item's k best from block to block, so later blocks are bounded by what earlier ones gave.

Many intervals of many items are split at a time, so that the work is numpy's; that changes the order, not the result.
Documents of a block are in order of length, so that long ones, whose impacts differ, stand together.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, record_batch, slices, stored, texts
from .queryset import MARK, batch_words, item_blocks, words_of

#: Bytes of items searched at a time, postings in a block of documents, and intervals of an item split at a time.
ITEMS, POSTINGS, SPLITS = 1 << 20, 400_000, 24
NO_ID = np.iinfo(np.int64).max  # a null id stands after all others
FOUND = "item long, score long, doc_id long"


@dataclass
class Items:
    """Ids, and the distinct terms of each item with how often it has them; terms are numbered."""

    ids: list[int | None]
    terms: dict[bytes, int]
    first: np.ndarray
    term: np.ndarray
    times: np.ndarray


def items_of(block: list[tuple[int | None, list[str]]]) -> Items:
    terms: dict[bytes, int] = {}
    first, term, times = [0], [], []
    for _, item_texts in block:
        own: dict[int, int] = {}
        for t in item_texts:
            for w in words_of(t):
                i = terms.setdefault(w, len(terms))
                own[i] = own.get(i, 0) + 1
        term += own
        times += own.values()
        first.append(len(term))
    return Items([i for i, _ in block], terms, *(np.array(x, dtype=np.int64) for x in (first, term, times)))


def _postings(terms):
    """A document's number of terms, and the asked terms that it holds, with how often."""

    def run(batches):
        ids = terms.value | {MARK: -2}
        for batch in slices(batches, most=16 << 20):
            pieces = [np.fromiter(map(ids.get, words, itertools.repeat(-1)), dtype=np.int32, count=len(words)) for words in batch_words(texts(batch))]
            found = np.concatenate([np.empty(0, dtype=np.int32), *pieces])
            ends = np.flatnonzero(found == -2)
            n = np.diff(ends, prepend=-1) - 1
            asked = np.flatnonzero(found >= 0)
            key, tf = np.unique(np.searchsorted(ends, asked) << 32 | found[asked], return_counts=True)
            places = np.searchsorted(key >> 32, np.arange(len(n) + 1)).astype(np.int32)
            lists = {c: pa.ListArray.from_arrays(pa.array(places), pa.array(x.astype(np.int32))) for c, x in (("term", key & 0xFFFFFFFF), ("tf", tf))}
            yield record_batch({"doc_id": batch.column("doc_id"), "n": pa.array(n)} | lists)

    return run


def _holders(batches):
    """How many documents of the task hold each term."""
    held = np.zeros(0, dtype=np.int64)
    for batch in batches:
        n = np.bincount(batch.column("term").flatten().to_numpy(), minlength=len(held))
        n[: len(held)] += held
        held = n
    at = np.flatnonzero(held)
    yield record_batch({"term": pa.array(at.astype(np.int32)), "df": pa.array(held[at])})


@dataclass
class Corpus:
    """Numbers over all documents, and the weight of each asked term."""

    documents: int
    length: int
    weight: np.ndarray


def weights(documents: int, df: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)


class Block:
    """Posting lists of a block of documents, one after the other, under one sparse table of maxima.

    An entry of the table is an impact over the document's place, so that a maximum names its document.
    """

    PLACE = 24  # bits of a document's place in its block

    def __init__(self, doc_id: np.ndarray, n: np.ndarray, sizes: np.ndarray, term: np.ndarray, tf: np.ndarray, corpus: Corpus):
        order = np.lexsort((doc_id, n))
        self.doc_id, place = doc_id[order], np.empty(len(n), dtype=np.int64)
        place[order] = np.arange(len(n))
        doc, tf = np.repeat(place, sizes), tf.astype(np.int64)
        m = 25 + 75 * np.repeat(n, sizes) * corpus.documents // corpus.length
        impact = 1_000_000_000 * tf // (1000 * tf + 8 * m)
        self.key = term.astype(np.int64) << self.PLACE | doc
        by_term = np.argsort(self.key)
        self.key = self.key[by_term]
        self.impact = impact[by_term]
        level = self.impact << self.PLACE | self.key & (1 << self.PLACE) - 1
        longest = int(np.bincount(term).max()) if len(term) else 0
        self.table = [level]
        for k in range(max(longest.bit_length() - 1, 0)):
            level = np.maximum(level[: -(1 << k)], level[1 << k :])
            self.table.append(np.concatenate([level, np.full(len(self.key) - len(level), -1)]))
        self.flat = np.concatenate(self.table) if len(self.key) else np.empty(0, dtype=np.int64)

    def maxima(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest impact of each term among the places from low to before high, and its place; 0 and -1 for none."""
        a = np.searchsorted(self.key, term << self.PLACE | low)
        b = np.searchsorted(self.key, term << self.PLACE | high)
        some = np.flatnonzero(b > a)
        best = np.full(len(term), -1, dtype=np.int64)
        a, b = a[some], b[some]
        k = np.frexp(b - a)[1].astype(np.int64) - 1
        row = k * len(self.key)
        best[some] = np.maximum(self.flat[row + a], self.flat[row + b - (1 << k)])
        return np.where(best < 0, 0, best >> self.PLACE), np.where(best < 0, -1, best & (1 << self.PLACE) - 1)

    def impacts(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        key = term << self.PLACE | place
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.impact[at], 0)


class Search:
    """The k best documents of each item so far; add() searches a further block."""

    def __init__(self, items: Items, corpus: Corpus, k: int, splits: int):
        self.first, self.term, self.k, self.splits = items.first, items.term, k, splits
        self.gain = items.times * corpus.weight[items.term]
        n = len(items.first) - 1
        self.score, self.doc_id = np.zeros((n, k), dtype=np.int64), np.full((n, k), NO_ID)
        self.scored = 0

    def _ragged(self, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For rows of items: the row, the term's place in the items' terms, and where each row begins."""
        sizes = self.first[item + 1] - self.first[item]
        starts = np.cumsum(sizes) - sizes
        row = np.repeat(np.arange(len(item)), sizes)
        return row, self.first[item][row] + np.arange(len(row)) - starts[row], starts

    def _bounds(self, block: Block, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An upper bound of the scores in each interval, and the document of its largest weighted impact."""
        row, at, starts = self._ragged(item)
        best, place = block.maxima(self.term[at], low[row], high[row])
        worth = best * self.gain[at]
        top = np.maximum.reduceat(worth, starts)
        is_top = np.flatnonzero(worth == top[row])
        where = np.empty(len(item), dtype=np.int64)
        where[row[is_top]] = place[is_top]
        return np.add.reduceat(worth, starts), where

    def _scores(self, block: Block, item: np.ndarray, place: np.ndarray) -> np.ndarray:
        row, at, starts = self._ragged(item)
        return np.add.reduceat(block.impacts(self.term[at], place[row]) * self.gain[at], starts)

    def _keep(self, item: np.ndarray, score: np.ndarray, doc_id: np.ndarray) -> None:
        """The k highest scores of each item, equal ones by the smaller id."""
        own = np.unique(item)
        item = np.concatenate([item, np.repeat(own, self.k)])
        score, doc_id = np.concatenate([score, self.score[own].ravel()]), np.concatenate([doc_id, self.doc_id[own].ravel()])
        order = np.lexsort((doc_id, -score, item))
        item = item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        kept = order[rank < self.k]
        self.score[own], self.doc_id[own] = score[kept].reshape(-1, self.k), doc_id[kept].reshape(-1, self.k)

    def add(self, block: Block) -> None:
        if not len(block.key):
            return
        item = np.flatnonzero(np.diff(self.first))
        low, high = np.zeros(len(item), dtype=np.int64), np.full(len(item), len(block.doc_id))
        bound, where = self._bounds(block, item, low, high)
        while True:
            least = self.score[item, -1]  # an equal score may have a smaller id
            live = np.flatnonzero((bound > 0) & (bound >= least))
            if not len(live):
                return
            order = live[np.lexsort((-bound[live], item[live]))]
            rank = np.arange(len(order)) - np.searchsorted(item[order], item[order])
            now, later = order[rank < self.splits], order[rank >= self.splits]
            i, at, a, b = item[now], where[now], low[now], high[now]
            self.scored += len(now)
            self._keep(i, self._scores(block, i, at), block.doc_id[at])
            new_item, new_low, new_high = np.concatenate([i, i]), np.concatenate([a, at + 1]), np.concatenate([at, b])
            some = np.flatnonzero(new_high > new_low)
            new_item, new_low, new_high = new_item[some], new_low[some], new_high[some]
            new_bound, new_where = self._bounds(block, new_item, new_low, new_high) if len(some) else (new_low, new_low)
            item, low, high, bound, where = (np.concatenate([x[later], y]) for x, y in ((item, new_item), (low, new_low), (high, new_high), (bound, new_bound), (where, new_where)))


def _best(items, corpus, k: int, postings: int, splits: int):
    def run(batches):
        search = Search(items.value, corpus.value, k, splits)
        held: list[tuple] = []

        def search_held():
            search.add(Block(*(np.concatenate(x) for x in zip(*held)), corpus.value))
            held.clear()

        for batch in batches:
            column = lambda c: batch.column(c)  # noqa: B023, E731
            ids = column("doc_id").fill_null(int(NO_ID)).to_numpy()
            n, terms, tfs = column("n").to_numpy(), column("term"), column("tf")
            sizes = terms.value_lengths().to_numpy().astype(np.int64)
            term, tf = terms.flatten().to_numpy(), tfs.flatten().to_numpy()
            part = np.cumsum(sizes) // postings
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
            places = np.concatenate([[0], np.cumsum(sizes)])
            for a, b in zip(edges, edges[1:]):
                held.append((ids[a:b], n[a:b], sizes[a:b], term[places[a] : places[b]], tf[places[a] : places[b]]))
                if sum(len(x[3]) for x in held) >= postings or sum(len(x[0]) for x in held) >= 1 << Block.PLACE - 1:
                    search_held()
        if held:
            search_held()
        item, rank = np.nonzero(search.score > 0)
        doc_id = search.doc_id[item, rank]
        yield record_batch({"item": pa.array(item), "score": pa.array(search.score[item, rank]), "doc_id": pa.array(doc_id, mask=doc_id == NO_ID)})

    return run


def top_documents(docs: DataFrame, items: DataFrame, *, k: int = 10, block: int = ITEMS, postings: int = POSTINGS, splits: int = SPLITS, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents with the highest score above 0 for each item; ties by ascending doc_id.

    Null texts have no terms and don't count as documents. Repeated rows are documents of their own and rank beside
    each other; a null doc_id stands after all others. Rows of one item id are one item with the terms of all its
    distinct texts; items without terms find nothing. Empty tables give no rows; other columns are ignored.

    For each block of items, the documents are read once into a stored table of the asked terms' postings, and searched
    in blocks; a task passes on k rows an item. What is broadcast is bounded by the block of items. ``postings`` and
    ``splits`` say where the work is done: results don't depend on them.
    """
    spark = docs.sparkSession
    broadcast = spark.sparkContext.broadcast
    picked = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    results = []
    for found in item_blocks(items, block, id_column=item_column):
        asked = items_of(found)
        index = stored(map_arrow(picked, _postings(broadcast(asked.terms)), "doc_id long, n long, term array<int>, tf array<int>").where("n > 0"), "postings")
        documents, length = (int(x or 0) for x in index.agg(F.count("*"), F.sum("n")).first())
        holders = map_arrow(index.select("term"), _holders, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
        df = np.zeros(len(asked.terms), dtype=np.int64)
        for r in holders.collect():  # a number for each term of the block
            df[r["term"]] = r["df"]
        corpus = broadcast(Corpus(documents, max(length, 1), weights(documents, df)))
        best = map_arrow(index, _best(broadcast(asked), corpus, k, postings, splits), FOUND)
        ids = spark.createDataFrame(pa.table({"item": pa.array(range(len(asked.ids)), pa.int64()), "item_id": pa.array(asked.ids, pa.int64())}))
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        results.append(ranked.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score"))  # ids of this block
    out = results[0]
    for more in results[1:]:
        out = out.unionAll(more)
    return out
