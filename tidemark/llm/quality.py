"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade >= k) = sigmoid(w . x - theta_k) with one weight vector w over hashed style features and ordered thresholds
theta_1 < theta_2 < .. (kept in order by learning the logarithms of their gaps). A document gets its expected grade and
its tail probability P(grade >= ``pass_grade``), by which it is selected.

Training reads a bounded sample of the rated documents (``sample`` rows, the first in the order of a hash of the id;
the bound is a parameter); scoring reads every document whole.

Defined results: a null text scores as an empty one; ratings of unknown documents or null ratings are ignored; without
any rating (or with one grade alone) every document passes with tail probability 1 and the grade that there is, else 0;
repeated ratings of a document all count, and a rated id that several documents share is learned from the least of their
texts, so that training never reads more than ``sample`` rows; repeated documents are each scored; an empty table gives no
rows. Other columns, whatever their names and types, are ignored by ``classify`` and returned as they are by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.blocks import blocks, settle
from tidemark.llm.features import DIM, compact, dot, dot_t, feature_rows, minimise, sigmoid, style_features

SAMPLE = 8_000
RIDGE = 1.0
PASS = 0.5


class Ordinal:
    """A fitted model: weights by slot, thresholds by grade step, and the grades themselves."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, grades: np.ndarray):
        self.weights, self.thresholds, self.grades = weights.astype(np.float32), thresholds, grades

    def tails(self, eta: np.ndarray) -> np.ndarray:
        """P(grade >= grades[k + 1]) in column k."""
        return sigmoid(eta[:, None] - self.thresholds[None, :])

    def expected(self, tails: np.ndarray) -> np.ndarray:
        return self.grades[0] + tails @ np.diff(self.grades) if len(self.grades) else np.zeros(len(tails))

    def tail(self, tails: np.ndarray, pass_grade: float) -> np.ndarray:
        """P(grade >= pass_grade)."""
        k = int(np.searchsorted(self.grades, pass_grade))
        if k == 0 or not len(self.thresholds):
            return np.ones(len(tails))
        return tails[:, k - 1] if k < len(self.grades) else np.zeros(len(tails))


def fit_ordinal(ptr, column, value, grade: np.ndarray, slots: np.ndarray, ridge: float = RIDGE, dim: int = DIM) -> Ordinal:
    grades, y = np.unique(np.asarray(grade, np.float64), return_inverse=True)
    steps, width = len(grades) - 1, len(slots)
    if steps < 1:
        return Ordinal(np.zeros(dim), np.empty(0), grades)

    def thresholds(p):
        return np.concatenate([[p[0]], p[0] + np.cumsum(np.exp(p[1:]))])

    def loss(p):
        w, th = p[:width], thresholds(p[width:])
        eta = dot(ptr, column, value, w)
        cum = np.hstack([np.ones((len(eta), 1)), sigmoid(eta[:, None] - th[None, :]), np.zeros((len(eta), 1))])
        rows = np.arange(len(eta))
        prob = np.maximum(cum[rows, y] - cum[rows, y + 1], 1e-12)
        slope = cum * (1 - cum)
        upper, lower = slope[rows, y] / prob, slope[rows, y + 1] / prob  # of the two tails that bound the grade
        d_eta = -(upper - lower)
        d_th = np.zeros(steps)
        np.add.at(d_th, y[y > 0] - 1, upper[y > 0])
        np.add.at(d_th, y[y < steps], -lower[y < steps])
        d_raw = np.concatenate([[d_th.sum()], np.exp(p[width + 1 :]) * np.cumsum(d_th[::-1])[::-1][1:]])
        return -np.log(prob).sum() + 0.5 * ridge * (w @ w), np.concatenate([dot_t(ptr, column, value, d_eta, width) + ridge * w, d_raw])

    got = minimise(loss, np.zeros(width + steps))
    weights = np.zeros(dim)
    weights[slots] = got[:width]
    return Ordinal(weights, thresholds(got[width:]), grades)


def training_rows(docs: DataFrame, ratings: DataFrame, features, columns: list[str], sample: int) -> tuple[np.ndarray, tuple]:
    """(answers, features) of at most ``sample`` rated documents: a CSR over the slots that enough of them have.

    Features come to the driver as Arrow columns, about 6 KB a document.
    """
    rated = ratings.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("rated_id"), *columns)
    for c in columns:
        rated = rated.where(F.col(c).isNotNull())
    # the sample is bounded by the parameter, and only then broadcast; equal ratings of an id are one row with a count
    chosen = rated.orderBy(F.xxhash64("rated_id"), "rated_id", *columns).limit(sample).groupBy("rated_id", *columns).agg(F.count("*").alias("times"))
    text = docs.select(F.col("doc_id").alias("own_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    joined = text.join(F.broadcast(chosen), text["own_id"] == chosen["rated_id"]).groupBy("rated_id", "times", *columns).agg(F.min("text").alias("text"))
    joined = joined.select("rated_id", *[F.col(c).cast("double").alias(c) for c in columns], "times", "text")
    types = ", ".join(f"{c} double" for c in columns)
    got = joined.mapInArrow(lambda it: feature_rows(it, features, 2 + len(columns)), f"rated_id long, {types}, times long, slot array<int>, value array<float>")
    got = got.toArrow().combine_chunks()
    # the order is found on the short columns; the long ones are copied once
    short = got.drop_columns(["slot", "value"])
    times = np.repeat(np.arange(got.num_rows), got.column("times").to_numpy())
    order = pc.sort_indices(short.take(pa.array(times)), [("rated_id", "ascending"), *((c, "ascending") for c in columns)]).to_numpy()
    got = got.take(pa.array(times[order]))
    answers = np.stack([got.column(c).to_numpy() for c in columns], 1) if got.num_rows else np.empty((0, len(columns)))
    return answers, compact(got)


def fit(docs: DataFrame, ratings: DataFrame, grade: str = "grade", sample: int = SAMPLE, ridge: float = RIDGE) -> Ordinal:
    answers, (ptr, column, value, slots) = training_rows(docs, ratings, style_features, [grade], sample)
    model = fit_ordinal(ptr, column, value, answers[:, 0], slots, ridge)
    del answers, ptr, column, value
    settle()  # the driver goes on for long with the model alone
    return model


def _score(batches: Iterator[pa.RecordBatch], model: Ordinal, pass_grade: float, at_least: float) -> Iterator[pa.RecordBatch]:
    for rows, raw, off in blocks(batches):
        tails = model.tails(dot(*style_features(raw, off), model.weights))
        tail = model.tail(tails, pass_grade)
        yield pa.RecordBatch.from_arrays(
            [rows.column(0), pa.array(model.expected(tails), pa.float64()), pa.array(tail, pa.float64()), pa.array(tail >= at_least)], names=["doc_id", "expected_grade", "p_pass", "keep"]
        )


def classify(docs: DataFrame, ratings: DataFrame, grade: str = "grade", pass_grade: float = 1, at_least: float = PASS, sample: int = SAMPLE, model: Ordinal | None = None) -> DataFrame:
    """doc_id, expected_grade, p_pass = P(grade >= pass_grade), keep = (p_pass >= at_least). The model (1 MB, fixed) is broadcast."""
    model = model or fit(docs, ratings, grade, sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        lambda it: _score(it, shared.value, pass_grade, at_least), "doc_id long, expected_grade double, p_pass double, keep boolean"
    )


def keep_good(docs: DataFrame, ratings: DataFrame, **how) -> DataFrame:
    """The documents that pass, with all their columns as they are."""
    grade = how.pop("grade", "grade")
    model = fit(docs, ratings, grade, how.pop("sample", SAMPLE))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    pass_grade, at_least = how.pop("pass_grade", 1), how.pop("at_least", PASS)

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, off in blocks(batches):
            tails = shared.value.tails(dot(*style_features(raw, off), shared.value.weights))
            yield rows.filter(pa.array(shared.value.tail(tails, pass_grade) >= at_least))

    return docs.mapInArrow(passing, docs.schema)
