"""Toxicity: a chain of linear classifiers over hashed words.

Categories are predicted in order; each model sees the text's features and the probabilities of the categories before
it. In training those probabilities are out-of-fold: each fold's come from models that did not see it, so a later model
learns from probabilities as good as it will get.

Training reads a bounded sample of labelled documents (``sample`` rows, first in the order of a hash of the id);
scoring reads every document whole.

Defined results: a null text scores as an empty one; labels with a null id or a null in a category are ignored; a
category without both answers in the sample gets the probability of the one answer there is (0 without any); repeated
labels all count, and a labelled id that several documents share is learned from the least of their texts; repeated
documents are each scored; an empty table gives no rows; other columns, whatever their names and types, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.blocks import blocks
from tidemark.llm.features import DIM, dot, dot_t, minimise, sigmoid, word_features
from tidemark.llm.quality import training_rows

SAMPLE = 10_000
FOLDS = 4
RIDGE = 0.05
THRESHOLD = 0.4
#: A slot enters a model if its count among the positives is this many standard errors from the expected one.
SCREEN = 3.0


def _logit(p: np.ndarray) -> np.ndarray:
    return np.log(np.clip(p, 1e-4, 1 - 1e-4)) - np.log1p(-np.clip(p, 1e-4, 1 - 1e-4))


class Link:
    """One model of the chain: weights by slot, weights of the earlier categories' log odds, intercept."""

    def __init__(self, weights: np.ndarray, chain: np.ndarray, intercept: float):
        self.weights, self.chain, self.intercept = weights, chain, intercept

    def probability(self, ptr, slot, value, before: np.ndarray) -> np.ndarray:
        return sigmoid(dot(ptr, slot, value, self.weights) + _logit(before) @ self.chain + self.intercept)


def fit_link(ptr, column, value, before: np.ndarray, y: np.ndarray, width: int, ridge: float) -> Link:
    k = before.shape[1]
    if y.min(initial=1) == y.max(initial=0) or not len(y):
        rate = float(np.clip(y.mean() if len(y) else 0, 1e-9, 1 - 1e-9))
        return Link(np.zeros(width), np.zeros(k), float(np.log(rate / (1 - rate))))
    b = _logit(before)
    rate, total = y.mean(), np.bincount(column, minlength=width)
    apart = np.abs(np.bincount(column, np.repeat(y, np.diff(ptr)), width) - rate * total) >= SCREEN * np.sqrt(np.maximum(total, 1) * rate * (1 - rate))
    full, kept = width, np.flatnonzero(apart)
    ptr, column, value = narrow(ptr, column, value, kept, width)
    width = len(kept)

    def loss(p):
        z = dot(ptr, column, value, p[:width]) + b @ p[width : width + k] + p[-1]
        q = sigmoid(z)
        d = q - y
        value_ = -np.log(np.maximum(np.where(y > 0, q, 1 - q), 1e-15)).sum() + 0.5 * ridge * (p[:-1] @ p[:-1])
        return value_, np.concatenate([dot_t(ptr, column, value, d, width) + ridge * p[:width], b.T @ d + ridge * p[width : width + k], [d.sum()]])

    got = minimise(loss, np.zeros(width + k + 1))
    weights = np.zeros(full)
    weights[kept] = got[:width]
    return Link(weights, got[width : width + k], float(got[-1]))


def narrow(ptr, column, value, kept: np.ndarray, width: int):
    """The CSR of the kept columns, numbered anew."""
    number = np.full(width, -1)
    number[kept] = np.arange(len(kept))
    inside = number[column] >= 0
    return np.concatenate([[0], np.cumsum(inside)])[ptr], number[column[inside]], value[inside]


def take(ptr, column, value, rows: np.ndarray):
    """The named rows of a CSR."""
    n = ptr[rows + 1] - ptr[rows]
    at = np.repeat(ptr[rows] - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(rows) else ptr[:0], n) + np.arange(n.sum())
    return np.concatenate([[0], np.cumsum(n)]), column[at], value[at]


def fit_chain(ptr, column, value, slots: np.ndarray, labels: np.ndarray, folds: int = FOLDS, ridge: float = RIDGE, dim: int = DIM) -> list[Link]:
    """Links over all slots. ``labels``: a column for each category, in chain order."""
    n, width = len(labels), len(slots)
    fold = np.arange(n) % folds
    before, chain = np.empty((n, 0)), []
    for k in range(labels.shape[1]):
        y = labels[:, k]
        link = fit_link(ptr, column, value, before, y, width, ridge)
        weights = np.zeros(dim, np.float32)
        weights[slots] = link.weights
        chain.append(Link(weights, link.chain, link.intercept))
        if k + 1 < labels.shape[1]:
            held_out = np.zeros(n)
            for f in range(folds):
                inside, outside = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
                part = fit_link(*take(ptr, column, value, inside), before[inside], y[inside], width, ridge)
                held_out[outside] = part.probability(*take(ptr, column, value, outside), before[outside])
            before = np.hstack([before, held_out[:, None]])
    return chain


def fit(docs: DataFrame, labels: DataFrame, categories: list[str], sample: int = SAMPLE, folds: int = FOLDS, ridge: float = RIDGE) -> list[Link]:
    answers, (ptr, column, value, slots) = training_rows(docs, labels, word_features, categories, sample)
    return fit_chain(ptr, column, value, slots, answers, folds, ridge)


def chain_probabilities(raw: np.ndarray, off: np.ndarray, chain: list[Link]) -> np.ndarray:
    x = word_features(raw, off)
    p = np.empty((len(off) - 1, 0))
    for link in chain:
        p = np.hstack([p, link.probability(*x, p)[:, None]])
    return p


def predict(docs: DataFrame, labels: DataFrame, categories: list[str], threshold: float = THRESHOLD, sample: int = SAMPLE, chain: list[Link] | None = None) -> DataFrame:
    """doc_id and p_<category> in chain order, and is_<category>. The chain (1 MB a category, fixed) is broadcast."""
    chain = chain or fit(docs, labels, categories, sample)
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, off in blocks(batches):
            p = chain_probabilities(raw, off, shared.value)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), *(pa.array(p[:, k], pa.float64()) for k in range(p.shape[1])), *(pa.array(p[:, k] >= threshold) for k in range(p.shape[1]))],
                names=["doc_id", *(f"p_{c}" for c in categories), *(f"is_{c}" for c in categories)],
            )

    types = "doc_id long, " + ", ".join(f"p_{c} double" for c in categories) + ", " + ", ".join(f"is_{c} boolean" for c in categories)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(score, types)
