"""Operator 13: benchmark decontamination by a generalised suffix automaton of the test items.

The automaton holds every run of consecutive words of every item. Documents stream through it word by word; it keeps
the longest run of an item that ends at the current word. Where that is at least a window long, the window is there,
and the state that holds exactly the window names the items. An item shorter than a window is a window by itself.

Two neighbouring words that no item has beside each other end every match, so a document is first cut there by a table
of hashed word pairs; only runs at least as long as the shortest window go through the automaton.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import list_array, map_arrow, record_batch, row_id, slices, texts, with_row_id
from .queryset import MARK, batch_words, item_blocks, words_of

#: Bytes of items in an automaton.
BLOCK = 2 << 20
PAIR_BITS = 22
SPANS = "rid long, doc_id long, n_words long, starts array<long>, ends array<long>, items array<long>"


class Automaton:
    """A generalised suffix automaton over words.

    items: (id, texts). A state stands for the runs of words of lengths (length of its link, its own length] that end
    at the same places.
    """

    def __init__(self, items: list[tuple[int | None, list[str]]], window: int):
        self.window, self.ids = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        found = [(item, words) for item, item_texts in items for words in map(words_of, item_texts) if words]
        numbered = [(item, [self.ids.setdefault(w, len(self.ids)) for w in words]) for item, words in found]
        for _, words in numbered:
            last = 0
            for w in words:
                last = self._append(last, w)
        self.least = min((min(window, len(words)) for _, words in numbered), default=window)
        self.owners: dict[int, set] = {}
        self.short: dict[int, tuple[int, set]] = {}
        self.at_window = functools.cache(self._at_window)
        self.next_short = functools.cache(self._next_short)
        pairs = [np.zeros(0, dtype=np.int64)]
        for item, words in numbered:
            state = 0
            for i, w in enumerate(words):
                state = self.next[state][w]
                if i + 1 >= window:
                    self.owners.setdefault(self.at_window(state), set()).add(item)
            if len(words) < window:
                self.short.setdefault(state, (len(words), set()))[1].add(item)
            x = np.array(words, dtype=np.int64)
            pairs.append(pair_place(x[:-1], x[1:]))
        self.pairs = np.zeros(1 << PAIR_BITS, dtype=bool)
        self.pairs[np.concatenate(pairs)] = True

    def _new(self, length: int, link: int, arcs: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(arcs)
        return len(self.length) - 1

    def _split(self, state: int, word: int, target: int) -> int:
        """The state of the runs that reach ``target`` from ``state``; a part of target is taken off if it holds longer ones."""
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self._new(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _append(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word, self.next[last][word])
        state, new = last, self._new(self.length[last] + 1, 0, {})
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, word, self.next[state][word])
        return new

    def _at_window(self, state: int) -> int:
        """The state of the last ``window`` words of a longer match."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def _next_short(self, state: int) -> int:
        """The nearest state, this one first, that ends an item shorter than a window; 0 for none."""
        while state > 0 and state not in self.short:
            state = self.link[state]
        return max(state, 0)

    def matches(self, words: list[int]):
        """(first, end, items) of each window that occurs in the words."""
        state = length = 0
        for end, w in enumerate(words, 1):
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if w in self.next[state]:
                state, length = self.next[state][w], length + 1
            if length >= self.window:
                yield end - self.window, end, self.owners[self.at_window(state)]
            if self.short:
                at = self.next_short(state)
                while at:
                    size, items = self.short[at]
                    if size <= length:
                        yield end - size, end, items
                    at = self.next_short(self.link[at])


def pair_place(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The place of two neighbouring words in the table of pairs."""
    mixed = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (mixed >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


@functools.lru_cache(maxsize=1)
def automaton_of(items: tuple, window: int) -> Automaton:
    return Automaton(items, window)


def _numbers(automaton: Automaton, rows: list[str]) -> np.ndarray:
    """The words of all texts as their numbers, -1 for words of no item, -2 after each text."""
    ids = automaton.ids | {MARK: -2}
    pieces = [np.fromiter(map(ids.get, words, itertools.repeat(-1)), dtype=np.int32, count=len(words)) for words in batch_words(rows)]
    return np.concatenate([np.empty(0, dtype=np.int32), *pieces])


def _runs(automaton: Automaton, ids: np.ndarray) -> list[tuple[int, int]]:
    """Where pairs of words that items have follow each other without a break, long enough for a window."""
    known = ids >= 0
    joined = np.zeros(len(ids) + 1, dtype=bool)  # to the word before
    both = np.flatnonzero(known[1:] & known[:-1]) + 1
    joined[both] = automaton.pairs[pair_place(ids[both - 1], ids[both])]
    first = np.flatnonzero(known & ~joined[:-1])
    end = np.flatnonzero(known & ~joined[1:]) + 1
    long = end - first >= automaton.least
    return list(zip(first[long].tolist(), end[long].tolist()))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _spans(items, window: int, all_rows: bool):
    """A row for each document, or only for those with a match: its maximal runs of hit words, and the items."""

    def run(batches):
        automaton = automaton_of(items.value, window)
        for batch in slices(batches, most=16 << 20):
            ids = _numbers(automaton, texts(batch))
            ends = np.flatnonzero(ids == -2)
            first = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
            spans: dict[int, list] = {}
            owners: dict[int, set] = {}
            for a, b in _runs(automaton, ids):
                doc = int(np.searchsorted(ends, a))
                for x, y, who in automaton.matches(ids[a:b].tolist()):
                    spans.setdefault(doc, []).append((int(a + x - first[doc]), int(a + y - first[doc])))
                    owners.setdefault(doc, set()).update(who)
            docs = range(batch.num_rows) if all_rows else sorted(spans)
            kept = [_merged(spans.get(d, [])) for d in docs]
            places = np.cumsum([0, *map(len, kept)])
            named = [sorted(owners.get(d, ()), key=lambda x: (x is not None, x or 0)) for d in docs]
            taken = pa.array(docs, pa.int64())
            yield record_batch({
                "rid": batch.column("rid").take(taken),
                "doc_id": batch.column("doc_id").take(taken),
                "n_words": pa.array((ends - first)[np.array(docs, dtype=np.int64)]),
                "starts": list_array(pa.array([a for x in kept for a, _ in x], pa.int64()), places),
                "ends": list_array(pa.array([b for x in kept for _, b in x], pa.int64()), places),
                "items": pa.array(named, pa.list_(pa.int64())),
            })

    return run


def _joined(batches):
    """The spans that several blocks of items found in a document, as one list."""
    for batch in batches:
        found = [_merged([*zip(a, b)]) for a, b in zip(batch.column("starts").to_pylist(), batch.column("ends").to_pylist())]
        places = np.cumsum([0, *map(len, found)])
        starts, ends = (list_array(pa.array([s[i] for x in found for s in x], pa.int64()), places) for i in (0, 1))
        yield record_batch({c: batch.column(c) for c in ("rid", "doc_id", "n_words")} | {"starts": starts, "ends": ends, "items": batch.column("items")})


def contaminated_spans(docs: DataFrame, items: DataFrame, *, window: int = 10, block: int = BLOCK, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(rid, doc_id, n_words, starts, ends, items) for each row of docs.

    starts and ends are the maximal runs of words inside an occurrence of a window, counted in words; items are the
    ids of the items whose windows occur, each once. Null and empty texts have no words. Repeated rows are judged
    apart; a null doc_id stays null. Items without words match nothing; rows of one item id are one item; no items or
    no documents give no matches or no rows. Other columns are ignored.

    One narrow pass over the documents for each block of items; what blocks find meets by row, and only of documents
    with a match. rid is the row number of ``row_id``.
    """
    picked = with_row_id(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")), "doc_id", "text")
    broadcast = docs.sparkSession.sparkContext.broadcast
    blocks = item_blocks(items, block)
    passes = []
    for found in blocks:
        held = broadcast(tuple((i, tuple(t)) for i, t in found))
        passes.append(map_arrow(picked, _spans(held, window, not passes), SPANS))
    if len(passes) == 1:
        return passes[0]
    every = functools.reduce(DataFrame.unionAll, passes).groupBy("rid")
    lists = (F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends"))
    whose = F.flatten(F.collect_list("items")).alias("items")  # an item is in one block only
    return map_arrow(every.agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), *lists, whose), _joined, SPANS)


def digests(spans: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of contaminated_spans; a null item id is an empty name."""
    n_hit = F.aggregate("ends", F.lit(0).cast("long"), lambda s, x: s + x) - F.aggregate("starts", F.lit(0).cast("long"), lambda s, x: s + x)
    names = F.array_join(F.array_sort(F.transform("items", lambda x: F.coalesce(x.cast("string"), F.lit("")))), ",")
    return spans.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.size("starts") > 0).alias("contaminated"))


WORD = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def cut_words(text: str, starts: list[int], ends: list[int]) -> str:
    """text without its words starts[i] to ends[i] and what stands between them."""
    places = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for a, b in zip(starts, ends):
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join([*out, text[at:]])


def remove_benchmark(docs: DataFrame, items: DataFrame, *, window: int = 10, length: int = 10, coverage: float = 0.5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs without what they share with the items; all columns stay.

    Hit runs of at least ``length`` words are cut from the text, and a document of whose words more than ``coverage``
    are hit goes. Texts without a match stay as they are, null ones too.
    """
    spans = contaminated_spans(docs, items, window=window, id_column=id_column, text_column=text_column).where("size(starts) > 0")
    n_hit = F.aggregate("ends", F.lit(0).cast("long"), lambda s, x: s + x) - F.aggregate("starts", F.lit(0).cast("long"), lambda s, x: s + x)
    long = F.filter(F.arrays_zip("starts", "ends"), lambda x: x["ends"] - x["starts"] >= length)
    found = spans.select(F.col("rid").alias("__rid"), long.alias("__cut"), (n_hit > coverage * F.col("n_words")).alias("__over"))
    joined = row_id(docs).join(found, "__rid", "left").where("coalesce(NOT __over, true)")

    @F.pandas_udf("string")
    def cut(text, starts, ends):
        return pd.Series([None if t is None else cut_words(t, a, b) for t, a, b in zip(text, starts, ends)], dtype=object)

    some = F.coalesce(F.size("__cut") > 0, F.lit(False))
    kept = F.when(some, cut(F.when(some, F.col(f"`{text_column}`")), "__cut.starts", "__cut.ends")).otherwise(F.col(f"`{text_column}`"))
    return joined.withColumn("__kept", kept).select(*(F.col("__kept").alias(c) if c == text_column else F.col(f"`{c}`") for c in docs.columns))
