"""Operator 2: a quality classifier learnt from trusted positives and unlabelled text.

The positives are rows labelled good; the unlabelled are documents of all kinds, whose labels are not looked at. The class prior is
estimated from the two samples, then a linear model minimises the non-negative unbiased risk: the positives' loss
weighted by the prior, plus the unlabelled loss as negatives less the positives' share of it, which is held at zero or
above. Features are shares and shapes of a text, none of them its language, source or id.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, map_arrow, record_batch, slices, texts
from .labelled import one_text_an_id, remainder, sample_ids, sample_labels, scored_schema

MARKS = "!?.,;:'\"()[]{}<>|%$#@&*+=/\\_-~^`"
_RUNS = re.compile(r"[^\w\s]{2,}")
_COUNTED = str.maketrans("", "", MARKS)


def features(text: str) -> np.ndarray:
    """Shares of characters and words, repetition and length of the whole text; zeros for an empty one."""
    words = text.split()
    out = np.zeros(len(MARKS) + 18)
    if not words:
        return out
    n, w = len(text), len(words)
    out[: len(MARKS)] = [text.count(mark) / w for mark in MARKS]
    distinct = set(words)
    lines = [x for x in text.split("\n") if x]
    counts = {}
    for x in words:
        counts[x] = counts.get(x, 0) + 1
    upper = sum(x.isupper() and len(x) > 1 for x in words)
    again = sum(a == b for a, b in zip(words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    rest = [
        upper / w,
        sum(x.istitle() for x in words) / w,
        sum(x.isalpha() for x in words) / w,
        sum(map(str.isdigit, text)) / n,
        (n - len(text.translate(_COUNTED))) / n,
        len(_RUNS.findall(text)) / w,
        again / w,
        len(distinct) / w,
        len(distinct) / w**0.75,
        1 - pairs / max(1, w - 1),
        max(counts.values()) / w,
        len(set(lines)) / len(lines),
        len(lines) / w,
        np.log1p(w) / 10,
        sum(map(len, words)) / w / 10,
        max(map(len, words)) / 50,
        float(upper > w / 4),
        float(again > w / 8),
    ]
    out[len(MARKS) :] = rest
    return out


def expanded(x: np.ndarray) -> np.ndarray:
    """The features, whether they are there at all, and their square roots: short and long texts then look alike."""
    return np.concatenate([x, np.sqrt(np.abs(x)), np.minimum(np.abs(x) * 20, 1)], axis=1)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, edges: int = 4) -> float:
    """Share of positives in the unlabelled, by a first model's scores: above a threshold that a share of the positives
    passes, the unlabelled hold at least the prior times that share. The least quotient over a few thresholds that nine
    tenths of the positives pass is taken: over more of them the least one falls below the prior by chance."""
    at = np.quantile(positive, np.linspace(0, 0.1, edges + 1)[1:])
    passing = [(unlabelled > e).mean() / max((positive > e).mean(), 1e-9) for e in at]
    return float(np.clip(min(passing), 0.05, 0.98))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((expanded(x) - self.mean) / self.scale, -8, 8)
        margin = z @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def _descend(gradient, size: int, steps: int, rate: float) -> np.ndarray:
    """Adam on a full-batch gradient."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def fit(positive: np.ndarray, unlabelled: np.ndarray, *, prior: float | None = None, decay: float = 1e-4, steps: int = 600, rate: float = 0.05) -> Model:
    """Non-negative risk over logistic losses: prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)]).

    Without positives everything scores one half; without unlabelled rows everything scores near the prior given.
    """
    width = 3 * (len(MARKS) + 18)
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(width), np.ones(width), np.zeros(width + 1), 0.5)
    both = np.ones((len(positive) + len(unlabelled), width + 1))  # the one matrix of all rows; the constant is last
    z, rows = both[:, :width], np.concatenate([positive, unlabelled])
    for i in range(0, len(z), 4096):
        z[i : i + 4096] = expanded(rows[i : i + 4096])
    mean, scale = z.mean(axis=0), z.std(axis=0) + 1e-6
    for i in range(0, len(z), 4096):
        z[i : i + 4096] = np.clip((z[i : i + 4096] - mean) / scale, -8, 8)
    p, u = both[: len(positive)], both[len(positive) :]
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    ridge = np.append(np.full(width, decay), 0)

    def plain(w):  # positives against unlabelled, for the prior
        return p.T @ (sig(p @ w) - 1) / len(p) + u.T @ sig(u @ w) / len(u) + ridge * w

    if prior is None:
        first = _descend(plain, width + 1, 200, rate)
        prior = estimate_prior(p @ first, u @ first)

    def risk(w):
        gp, gu = p @ w, u @ w
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        of_negative = u.T @ sig(gu) / len(u) - prior * p.T @ sig(gp) / len(p)
        of_positive = prior * p.T @ (sig(gp) - 1) / len(p)
        return (of_positive + of_negative if negative >= 0 else -of_negative) + ridge * w

    return Model(mean, scale, _descend(risk, width + 1, steps, rate), prior)


def _featured(batches):
    for batch in slices(batches, most=8 << 20):
        yield record_batch({"doc_id": batch.column("doc_id"), "label": batch.column("label"), "x": pa.array([features(t) for t in texts(batch)], pa.list_(pa.float64()))})


def train(docs: DataFrame, labels: DataFrame, *, parts: int = 5, held: int = 0, most: int = 20_000, id_column: str = "doc_id", text_column: str = "text") -> Model:
    """Learns from at most ``most`` labelled rows, of which the good ones are the trusted positives, and as unlabelled
    text from at most ``most`` documents outside the held-out fold, whose labels, if any, are not looked at.

    Repeated ids count once; null ids teach nothing; null texts are empty. Without positives all texts score one half.
    """
    chosen = sample_labels(labels, "quality", parts, held, most).where("label = 1")
    positive = one_text_an_id(docs, chosen, id_column, text_column)
    unlabelled = one_text_an_id(docs, sample_ids(docs, id_column, parts, held, most), id_column, text_column)
    rows = map_arrow(positive.union(unlabelled), _featured, "doc_id long, label int, x array<double>").toArrow().combine_chunks()  # two bounded samples
    if not rows.num_rows:
        return fit(np.empty((0, 1)), np.empty((0, 1)))
    x = pc.list_flatten(rows.column("x")).to_numpy().reshape(rows.num_rows, -1)
    good = rows.column("label").fill_null(0).to_numpy() == 1
    order = np.lexsort((~good, rows.column("doc_id").to_numpy()))
    positive, unlabelled = x[order[good[order]]], x[order[~good[order]]]
    del rows, x
    model = fit(positive, unlabelled)
    del positive, unlabelled
    give_back()  # the driver goes on with other stages
    return model


def score_documents(docs: DataFrame, model: Model, *, text_column: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs with ``score`` (0 to 1, higher: likelier good) and ``predicted`` (1 if score >= threshold) put last.

    Null and empty texts are scored alike; every row is scored from its whole text alone; rows stay as they are, but
    columns named score or predicted are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches, text_column, 8 << 20):
            rows = texts(batch, text_column)
            score = shared.value.score(np.stack([features(t) for t in rows]))
            fields = {c: batch.column(c) for c in batch.schema.names if c not in ("score", "predicted")}
            yield record_batch(fields | {"score": pa.array(score), "predicted": pa.array((score >= threshold).astype(np.int32))})

    kept = docs.select(*[c for c in docs.columns if c not in ("score", "predicted")])
    return map_arrow(kept, run, scored_schema(kept))


def score_all(docs: DataFrame, labels: DataFrame, *, parts: int = 5, held: int = 0, most: int = 20_000) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs, learnt from the other folds' labels."""
    model = train(docs, labels, parts=parts, held=held, most=most)
    scored = score_documents(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select("doc_id", (remainder(F.col("doc_id"), parts) == held).alias("held_out"), "score", "predicted")
