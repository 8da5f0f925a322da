"""Operator 9: a toxicity classifier with a counterfactual penalty.

A linear model over words and word beginnings that the classes differ in. In labelled sentences, terms that name
groups of people are swapped for others of their kind, and the squared change of the score is part of the loss: a
neutral mention of a group then doesn't make a text toxic. The terms are a parameter.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bounded, give_back, map_arrow, record_batch, slices, texts
from .labelled import one_text_an_id, remainder, sample_labels, scored_schema

#: Groups of terms that may be swapped for one another.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "transgender"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("immigrants", "refugees", "natives", "citizens"),
    ("blind", "deaf", "disabled", "elderly", "young"),
    ("frauen", "männer"), ("muslime", "christen", "juden"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")
PREFIXES = range(3, 9)


def parts_of(word: str) -> list[str]:
    """A word and its beginnings, which are marked."""
    return [word, *(word[:n] + "-" for n in PREFIXES if n <= len(word))]


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


@dataclass
class Model:
    index: dict[str, int]
    weights: np.ndarray  # for how often a feature is there (up to 3), then for its share; the constant is last

    def columns(self) -> Bounded:
        return Bounded(lambda word: tuple(i for p in parts_of(word) if (i := self.index.get(p)) is not None), 200_000)

    def row(self, words: list[str], columns: Bounded) -> np.ndarray:
        k = len(self.index)
        out = np.zeros(2 * k + 1)
        for word, n in Counter(words).items():
            for i in columns[word]:
                out[i] += n
        if words:
            out[k : 2 * k] = np.sqrt(out[:k] / len(words)) * 5
        out[:k] = np.minimum(out[:k], 3) / 3
        out[-1] = 1
        return out

    def score(self, rows: list[str], columns: Bounded) -> np.ndarray:
        if not rows:
            return np.empty(0)
        margin = np.stack([self.row(words_of(t), columns) for t in rows]) @ self.weights
        columns.trim()
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def swapped(words: list[str], terms=IDENTITY_TERMS) -> list[list[str]]:
    """The words with each group term replaced by each other term of its group, one at a time; none without such terms."""
    group = {term: g for g in terms for term in g}
    return [[*words[:i], other, *words[i + 1 :]] for i, w in enumerate(words) if w in group for other in group[w] if other != w]


def _class_counts(batches):
    """In how many toxic and other texts a word or beginning is, per batch."""
    for batch in slices(batches, most=16 << 20):
        toxic, clean = Counter(), Counter()
        for text, label in zip(texts(batch), batch.column("label").to_pylist()):
            (toxic if label == 1 else clean).update({p for w in set(words_of(text)) for p in parts_of(w)})
        names = list(toxic.keys() | clean.keys())
        yield record_batch({"part": pa.array(names, pa.string()), "toxic": pa.array([toxic[p] for p in names], pa.int64()), "clean": pa.array([clean[p] for p in names], pa.int64())})


def select_features(sample: DataFrame, n_toxic: int, n_clean: int, most: int) -> list[str]:
    """The ``most`` words and beginnings whose presence tells most about the class, by the likelihood ratio statistic."""
    counts = map_arrow(sample, _class_counts, "part string, toxic long, clean long").groupBy("part").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    a, b = F.col("a"), F.col("b")
    share = (a + b) / float(n_toxic + n_clean)
    term = lambda n, expected: F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)
    gain = term(a, share * n_toxic) + term(b, share * n_clean) + term(n_toxic - a, (1 - share) * n_toxic) + term(n_clean - b, (1 - share) * n_clean)
    picked = counts.where("a + b >= 3").withColumn("gain", gain).orderBy(F.desc("gain"), "part").limit(most)
    return sorted(r["part"] for r in picked.collect())


class Rows:
    """Sparse rows: each entry's column and value, row by row. Products go by blocks of about ``block`` entries, so that beside the
    entries only a block is held in double precision."""

    def __init__(self, at: np.ndarray, value: np.ndarray, lengths: np.ndarray, width: int, block: int = 1 << 18):
        self.at, self.value, self.lengths, self.shape = at, value, lengths, (len(lengths), width)
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        edges = np.flatnonzero(np.diff(self.starts[:-1] // block)) + 1 if len(lengths) else []
        self.blocks = list(zip([0, *edges], [*edges, len(lengths)]))

    @classmethod
    def of(cls, dense: np.ndarray) -> Rows:
        row, at = np.nonzero(dense)
        return cls(at.astype(np.int32), dense[row, at], np.bincount(row, minlength=len(dense)), dense.shape[1])

    def times(self, w: np.ndarray) -> np.ndarray:
        """x w"""
        out = np.zeros(self.shape[0])
        for a, b in self.blocks:
            i, j = self.starts[a], self.starts[b]
            out[a:b] = np.bincount(np.repeat(np.arange(b - a), self.lengths[a:b]), self.value[i:j] * w[self.at[i:j]], b - a)
        return out

    def turned_times(self, r: np.ndarray) -> np.ndarray:
        """x' r"""
        out = np.zeros(self.shape[1])
        for a, b in self.blocks:
            i, j = self.starts[a], self.starts[b]
            out += np.bincount(self.at[i:j], self.value[i:j] * np.repeat(r[a:b], self.lengths[a:b]), self.shape[1])
        return out


def fit(model: Model, x: Rows | np.ndarray, y: np.ndarray, change: np.ndarray | None, *, penalty: float, decay: float, steps: int = 500, rate: float = 0.05) -> Model:
    """Logistic loss plus penalty * mean (score margin before - after a swap)^2 plus a ridge, by Adam on full batches.
    ``change`` is the mean of d d' over the swaps, d being the difference of a sentence's features; None without swaps."""
    x = x if isinstance(x, Rows) else Rows.of(x)
    w = np.zeros(x.shape[1])
    w[-1] = np.log(max(y.mean(), 1e-3) / max(1 - y.mean(), 1e-3)) if len(y) else -3.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1 if len(y) else 1):
        g = x.turned_times(1 / (1 + np.exp(-np.clip(x.times(w), -30, 30))) - y) / len(y)
        if change is not None:
            g += 2 * penalty * change @ w
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    model.weights = w
    return model


def _swaps(model, terms):
    """Labelled texts to one row a task: the number of swaps in their sentences and the sum of d d' over them."""

    def run(batches):
        own = model.value
        columns, width = own.columns(), 2 * len(own.index) + 1
        named = {t for g in terms for t in g}
        total, n = np.zeros((width, width)), 0
        for batch in slices(batches, most=4 << 20):
            for text in texts(batch):
                for sentence in SENTENCE.findall(text):
                    words = words_of(sentence)
                    if named.isdisjoint(words):
                        continue
                    before = own.row(words, columns)
                    for other in swapped(words, terms):
                        d = before - own.row(other, columns)
                        at = np.flatnonzero(d)
                        total[np.ix_(at, at)] += np.outer(d[at], d[at])
                        n += 1
        if n:
            yield record_batch({"n": pa.array([n], pa.int64()), "total": pa.array([total.tobytes()], pa.binary())})

    return run


def _added(batches):
    n, total = 0, None
    for batch in batches:
        for k, data in zip(batch.column("n").to_pylist(), batch.column("total").to_pylist()):
            one = np.frombuffer(data)
            n, total = n + k, one if total is None else total + one
    if n:
        yield record_batch({"n": pa.array([n], pa.int64()), "total": pa.array([total.tobytes()], pa.binary())})


def train(docs: DataFrame, labels: DataFrame, *, parts: int = 4, held: int = 2, most: int = 20_000, features: int = 400, terms=IDENTITY_TERMS, penalty: float = 1.0, decay: float = 1e-4, id_column: str = "doc_id", text_column: str = "text") -> Model:
    """Learns from at most ``most`` labelled rows outside the held-out fold, one an id: of repeated ids the text with the
    least hash. Null texts are empty. Without any labelled text, all texts score low alike. To the driver come one sparse
    row for each of them and the sum over all swaps, whose size is that of the features squared."""
    sample = one_text_an_id(docs, sample_labels(labels, "toxic", parts, held, most), id_column, text_column)
    per = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n_toxic, n = per.get(1, 0), sum(per.values())
    named = {t for g in terms for t in g}
    chosen_parts = select_features(sample, n_toxic, n - n_toxic, features) if n else []
    model = Model({p: i for i, p in enumerate(sorted({*chosen_parts, *named}))}, np.zeros(0))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        own = shared.value
        columns = own.columns()
        for batch in slices(batches, most=4 << 20):
            found = [own.row(words_of(t), columns) for t in texts(batch)]
            at, value = [np.flatnonzero(x).astype(np.int32) for x in found], [x[x != 0].astype(np.float32) for x in found]
            yield record_batch({"doc_id": batch.column("doc_id"), "label": batch.column("label"), "at": pa.array(at, pa.list_(pa.int32())), "value": pa.array(value, pa.list_(pa.float32()))})

    got = map_arrow(sample, rows, "doc_id long, label int, at array<int>, value array<float>").toArrow().sort_by("doc_id")
    lengths = pc.list_value_length(got.column("at")).to_numpy()
    x = Rows(*(pc.list_flatten(got.column(c)).to_numpy() for c in ("at", "value")), lengths, 2 * len(model.index) + 1)
    y = got.column("label").to_numpy() == 1
    sums = map_arrow(map_arrow(sample.select("text"), _swaps(shared, terms), "n long, total binary").repartition(1), _added, "n long, total binary").first()
    change = np.frombuffer(sums["total"]).reshape(x.shape[1], -1) / sums["n"] if sums else None
    fit(model, x, y.astype(float), change, penalty=penalty, decay=decay)
    del got, x
    give_back()  # the driver goes on with other stages
    return model


def score_documents(docs: DataFrame, model: Model, *, text_column: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs with ``score`` (0 to 1, higher: likelier toxic) and ``predicted`` (1 if score >= threshold) put last.

    Null and empty texts are scored alike; every row is scored from its whole text alone; rows stay as they are, but
    columns named score or predicted are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        columns = shared.value.columns()
        for batch in slices(batches, text_column, 4 << 20):
            score = shared.value.score(texts(batch, text_column), columns)
            fields = {c: batch.column(c) for c in batch.schema.names}
            yield record_batch(fields | {"score": pa.array(score), "predicted": pa.array((score >= threshold).astype(np.int32))})

    kept = docs.select(*[c for c in docs.columns if c not in ("score", "predicted")])
    return map_arrow(kept, run, scored_schema(kept))


def score_all(docs: DataFrame, labels: DataFrame, *, parts: int = 4, held: int = 2, most: int = 20_000) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs, learnt from the other folds' labels."""
    model = train(docs, labels, parts=parts, held=held, most=most)
    scored = score_documents(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select("doc_id", (remainder(F.col("doc_id"), parts) == held).alias("held_out"), "score", "predicted")
