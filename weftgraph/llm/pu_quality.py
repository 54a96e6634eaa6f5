"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled texts, no negatives: the negative risk is the unlabelled risk less
the positives' part of it by the class prior, and where the estimate of it falls below zero its
gradient is reversed (non-negative unbiased risk). The prior comes from the scores of a classifier
of positives against unlabelled texts: where positives are densest, unlabelled texts are at most
that dense times the prior.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import textcore, textstats

#: Documented bounds of the samples that the model is fitted on.
FIT_POSITIVE, FIT_UNLABELLED = 5000, 10000
ROUNDS, RATE, DECAY, THRESHOLD = 1500, 0.05, 1e-4, 0.5
FEATURES = 11


def features(stats: dict[str, np.ndarray]) -> np.ndarray:
    """Rates of a text's counts, a row for each text."""
    c = {k: v.astype(np.float64) for k, v in stats.items()}
    words, chars, lines = (np.maximum(c[k], 1) for k in ("n_words", "word_chars", "n_lines"))
    return np.column_stack(
        [
            np.log(words),
            np.log(chars / words),
            np.log1p(100 * c["n_symbols"] / chars),
            np.log1p(100 * c["n_bars"] / words),
            np.log1p(100 * c["n_shouts"] / words),
            np.log1p(10 * c["n_marks"] / words),
            np.log1p(20 * c["n_upper"] / chars),
            np.log1p(20 * c["n_digits"] / chars),
            np.log1p(10 * c["n_repeat_words"] / words),
            np.log1p(10 * c["n_dup_lines"] / lines),
            np.log1p(c["n_lines"] / words * 10),
        ]
    )


class Model(NamedTuple):
    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    prior: float


def expanded(x: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Standardised rates, how far each lies above and below, squashed, and a constant."""
    z = (x - centre) / spread
    t = 2 * np.sign(z) * np.log1p(np.abs(z))
    return np.column_stack([t, np.maximum(t - 1.5, 0), np.maximum(-1.5 - t, 0), np.maximum(t - 5, 0), np.ones(len(z))])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def descend(gradient, size: int, rounds: int = ROUNDS) -> np.ndarray:
    """Adam on a full-batch gradient."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, rounds + 1):
        g = gradient(w) + DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def prior_of(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """An estimate of the share of positives among unlabelled texts, from scores that rank positives high.

    The least ratio of unlabelled to positive mass above a threshold, over thresholds that keep a
    tenth of the positives, each with its sampling error.
    """
    thresholds = np.quantile(positive, np.linspace(0, 0.9, 181))
    above = lambda x: 1 - np.searchsorted(np.sort(x), thresholds, "left") / len(x)
    p, u = above(positive), above(unlabelled)
    error = np.sqrt(u * (1 - u) / len(unlabelled) + 1e-12) + np.sqrt(p * (1 - p) / len(positive) + 1e-12)
    return float(np.clip(np.min((u + error) / np.maximum(p, 1e-9)), 0.02, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray) -> Model:
    """nnPU with the logistic loss on a linear model of the expanded rates."""
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(4 * FEATURES + 1), 0.5)
    centre = np.median(positive, axis=0)
    spread = np.maximum(1.4826 * np.median(np.abs(positive - centre), axis=0), 0.05)
    p, u = expanded(positive, centre, spread), expanded(unlabelled, centre, spread)

    # Each half is ranked by a classifier of the other, so that no text is ranked by what it taught.
    rng = np.random.default_rng(0)
    p2, u2 = p[rng.permutation(len(p))], u[rng.permutation(len(u))]
    scored: list[tuple[np.ndarray, np.ndarray]] = []
    for half in (0, 1):
        a, b = p2[1 - half :: 2], u2[1 - half :: 2]
        if len(p2) > 1 and len(u2) > 1:
            w = descend(lambda w, a=a, b=b: -(a.T @ (1 - sigmoid(a @ w))) / len(a) / 2 + b.T @ sigmoid(b @ w) / len(b) / 2, p.shape[1], 400)
            scored.append((sigmoid(p2[half::2] @ w), sigmoid(u2[half::2] @ w)))
    prior = prior_of(*[np.concatenate(x) for x in zip(*scored)]) if scored else 0.5

    def risk_gradient(w: np.ndarray) -> np.ndarray:
        sp, su = sigmoid(p @ w), sigmoid(u @ w)
        negative_risk = np.logaddexp(0, u @ w).mean() - prior * np.logaddexp(0, p @ w).mean()
        negative = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
        if negative_risk < 0:
            return -negative
        return -prior * (p.T @ (1 - sp)) / len(p) + negative

    return Model(centre, spread, descend(risk_gradient, p.shape[1]), prior)


def _rates(batch: pa.RecordBatch) -> np.ndarray:
    out = np.zeros((len(batch), FEATURES))
    for first, after, data, offsets in textcore.steps(batch.column("text")):
        out[first:after] = features(textstats.counts(data, offsets))
    return out


def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rates = pa.array(list(_rates(batch)), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("positive"), rates], names=["doc_id", "positive", "x"])


def scorer(model: Model):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = sigmoid(expanded(_rates(batch), model.centre, model.spread) @ model.weights)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return of


def fitted(docs: DataFrame, labels: DataFrame, training: Column | None = None, n_positive: int = FIT_POSITIVE, n_unlabelled: int = FIT_UNLABELLED) -> Model:
    """A model from at most n_positive trusted texts and n_unlabelled others, in order of the md5 of their id."""
    h = F.md5(F.col("doc_id").cast("string"))
    trusted = labels.where(F.lit(True) if training is None else training).where("quality = 1").select("doc_id").dropDuplicates().orderBy(h, "doc_id").limit(n_positive)
    other = docs.where("doc_id is not null").select("doc_id").dropDuplicates().orderBy(F.md5(F.concat(F.lit("u"), h)), "doc_id").limit(n_unlabelled)
    # At most the sum of the bounds, so small enough to broadcast.
    chosen = trusted.withColumn("positive", F.lit(True)).unionByName(other.withColumn("positive", F.lit(False)))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "positive")
    got = rows.mapInArrow(rated, "doc_id long, positive boolean, x array<double>").collect()
    got.sort(key=lambda r: (r.doc_id, r.x))
    part = lambda flag: np.array([r.x for r in got if r.positive == flag]).reshape(-1, FEATURES)
    return fit(part(True), part(False))


def score_quality(docs: DataFrame, labels: DataFrame, training: Column | None = None, **bounds: int) -> DataFrame:
    """A quality score from 0 to 1 for each document, from its text alone.

    docs: doc_id, text; labels: doc_id, quality, of which rows where training holds and quality is 1
    are the trusted positives. A null text is empty; an empty text is scored like any other. Without
    positives all texts score 0.5. Rows stay rows. Returns doc_id, score.
    """
    model = fitted(docs, labels, training, **bounds)
    return docs.select("doc_id", "text").mapInArrow(scorer(model), "doc_id long, score double")
