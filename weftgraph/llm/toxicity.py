"""Toxicity by a character n-gram linear classifier on naive Bayes log-count ratios.

A text's features are the distinct character n-grams of its lower-cased form, white space as one
kind of character, hashed to buckets. Each bucket's value is its naive Bayes log-count ratio between
the classes, times 0 or 1 as the text has it; an L1-penalised logistic regression weighs these. The
penalty leaves few buckets with a weight, so scoring a whole text is one pass of table lookups.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import textcore
from weftgraph.llm.storage import scratch, written

ORDERS, BUCKET_BITS = (4, 5, 6), 20
#: Documented bounds of the labelled sample that the model is fitted on, by class.
FIT_POSITIVE, FIT_NEGATIVE = 800, 1600
LEAST_TEXTS, LEAST_RATIO, PENALTY, ROUNDS, THRESHOLD = 3, 1.5, 2e-4, 300, 0.3
STEP_BYTES = 300_000  # a step holds several numbers for each character
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Model(NamedTuple):
    weights: np.ndarray  # by bucket: regression weight times log-count ratio
    bias: float
    orders: tuple[int, ...]


def lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.fill_null(""))


def ngrams(data: np.ndarray, offsets: np.ndarray, orders: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: (bucket of each n-gram, its text)."""
    whole = data.copy()
    whole[textcore.is_space(data)] = 32
    codes = np.frombuffer(whole.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.uint64)
    chars = textcore.per_text((data & 0xC0) != 0x80, offsets)
    text = np.repeat(np.arange(len(chars)), chars)
    for n in orders:
        if len(codes) < n:
            continue
        h = codes[: len(codes) - n + 1]
        for k in range(1, n):
            h = (h + np.uint64(1)) * _FACTOR + codes[k : len(codes) - n + 1 + k]
        h = textcore.mixed(h + np.uint64(n)) >> np.uint64(64 - BUCKET_BITS)
        inside = text[: len(h)] == text[n - 1 :]
        yield h[inside].astype(np.int64), text[: len(h)][inside]


def present(column: pa.Array, orders: tuple[int, ...], of_interest: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, texts, buckets): each bucket once for each text of a step."""
    for first, after, data, offsets in textcore.steps(lowered(column), STEP_BYTES):
        keys = []
        for bucket, text in ngrams(data, offsets, orders):
            if of_interest is not None:
                hit = of_interest[bucket]
                bucket, text = bucket[hit], text[hit]
            keys.append((text << BUCKET_BITS) + bucket)
        key = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        yield first, after, key >> BUCKET_BITS, key & ((1 << BUCKET_BITS) - 1)


def ratios(in_1: np.ndarray, in_0: np.ndarray, n1: int, n0: int) -> tuple[np.ndarray, np.ndarray]:
    """Each bucket's naive Bayes log-count ratio, and whether it tells the classes apart."""
    ratio = np.log((in_1 + 1) / (n1 + 2)) - np.log((in_0 + 1) / (n0 + 2))
    return ratio, (in_1 + in_0 >= LEAST_TEXTS) & (np.abs(ratio) > LEAST_RATIO)


def fit(texts: list[str | None], labels: np.ndarray, shares: tuple[float, float], orders: tuple[int, ...] = ORDERS) -> Model:
    """shares: the classes' shares of all labelled texts, which a sample by class doesn't show."""
    size, column, positive = 1 << BUCKET_BITS, pa.array(texts, pa.string()), labels.astype(bool)
    in_1, in_0 = np.zeros(size), np.zeros(size)
    for first, _, text, bucket in present(column, orders):
        of_1 = positive[first + text]
        in_1 += np.bincount(bucket[of_1], minlength=size)
        in_0 += np.bincount(bucket[~of_1], minlength=size)
    ratio, used = ratios(in_1, in_0, max(int(positive.sum()), 1), max(int((~positive).sum()), 1))
    held: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
    for first, after, text, bucket in present(column, orders, used):
        held[first:after] = np.split(bucket, np.searchsorted(text, np.arange(1, after - first)))
    return weighed(held, labels, shares, ratio, used, orders)


def weighed(held: list[np.ndarray], labels: np.ndarray, shares: tuple[float, float], ratio: np.ndarray, used: np.ndarray, orders: tuple[int, ...]) -> Model:
    """The regression: held has each text's buckets among the used ones."""
    size, positive, texts = 1 << BUCKET_BITS, labels.astype(bool), held
    n1, n0 = max(int(positive.sum()), 1), max(int((~positive).sum()), 1)
    if not positive.any() or positive.all():
        return Model(np.zeros(size), np.log(max(shares[1], 1e-6) / max(shares[0], 1e-6)), orders)
    number = np.full(size, -1, np.int32)
    number[used] = np.arange(int(used.sum()))
    row = np.repeat(np.arange(len(held), dtype=np.int32), [len(x) for x in held])
    col = number[np.concatenate([*held, np.zeros(0, np.int64)]).astype(np.int64)]
    r = ratio[used]
    # Each text weighs so that classes have their shares of all labelled texts.
    weight = np.where(positive, shares[1] / n1, shares[0] / n0)
    x_scale = r[col].astype(np.float32)
    w, b, y = np.zeros(len(r)), float(np.log(shares[1] / shares[0])), positive.astype(float)
    lipschitz = 0.25 * max(float((weight * np.bincount(row, x_scale**2, len(texts))).sum()), 1e-9)
    step, v, momentum = 1.0 / lipschitz, w.copy(), 1.0
    for _ in range(ROUNDS):
        z = np.bincount(row, x_scale * v[col], len(texts)) + b
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        fresh = v - step * np.bincount(col, x_scale * g[row], len(r))
        fresh = np.sign(fresh) * np.maximum(np.abs(fresh) - step * PENALTY, 0)
        b -= min(step * 50, 4.0) * g.sum()
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        v = fresh + (momentum - 1) / after * (fresh - w)
        w, momentum = fresh, after
    weights = np.zeros(size)
    weights[used] = w * r
    return Model(weights, float(b), orders)


def scores(column: pa.Array, model: Model, weights: np.ndarray) -> np.ndarray:
    score = np.zeros(len(column))
    for first, after, text, bucket in present(column, model.orders, weights != 0):
        z = np.bincount(text, weights[bucket], after - first) + model.bias
        score[first:after] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return score


def sparse(model: Model) -> tuple[Model, np.ndarray, np.ndarray]:
    """The model without its table of weights, and the buckets that have one, to send to executors."""
    hit = np.flatnonzero(model.weights)
    return model._replace(weights=np.zeros(0)), hit, model.weights[hit]


def dense(hit: np.ndarray, values: np.ndarray) -> np.ndarray:
    weights = np.zeros(1 << BUCKET_BITS)
    weights[hit] = values
    return weights


def scorer(model: Model):
    """A mapInArrow function: (doc_id, text) to doc_id and score."""
    model, hit, values = sparse(model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = dense(hit, values)
        for batch in batches:
            score = pa.array(scores(batch.column("text"), model, weights))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), score], names=["doc_id", "score"])

    return of


def keeper(model: Model, threshold: float):
    """A mapInArrow function: the rows whose text scores below the threshold, all columns."""
    model, hit, values = sparse(model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = dense(hit, values)
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column("text"), model, weights) < threshold))

    return of


def counter(orders: tuple[int, ...]):
    """A mapInArrow function: labelled texts to how many of each class have each bucket."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << BUCKET_BITS
        both = np.zeros((2, size), np.int64)
        for batch in batches:
            positive = batch.column("y").to_numpy(zero_copy_only=False) == 1
            for first, _, text, bucket in present(batch.column("text"), orders):
                for y in (0, 1):
                    both[y] += np.bincount(bucket[positive[first + text] == y], minlength=size)
        some = np.flatnonzero(both.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(both[1, some]), pa.array(both[0, some])], names=["bucket", "in_1", "in_0"])

    return of


def holder(used: np.ndarray, orders: tuple[int, ...]):
    """A mapInArrow function: labelled texts to their buckets among the used ones."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[np.ndarray] = []
            for first, after, text, bucket in present(batch.column("text"), orders, used):
                held += np.split(bucket.astype(np.int32), np.searchsorted(text, np.arange(1, after - first)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(held, pa.list_(pa.int32()))], names=["doc_id", "y", "held"])

    return of


def fitted(docs: DataFrame, labels: DataFrame, label: str, fold: Column | None, bounds: dict[int, int], orders: tuple[int, ...] = ORDERS) -> Model:
    """A model from bounded labelled texts by class, in order of the md5 of their id.

    Only rows of labels for which fold holds and whose label is 0 or 1 are seen; an id labelled both
    ways counts as 1. Of several texts under one id the least is learnt. Texts stay on the executors:
    the driver gets the counts of the buckets, and each text's buckets among those that tell the
    classes apart.
    """
    seen = labels.where(F.lit(True) if fold is None else fold).where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    n = {r.y: r.n for r in seen.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = max(sum(n.values()), 1)
    share = lambda y: min(max(n.get(y, 0) / total, 1e-6), 1 - 1e-6)
    chosen = None
    for y, most in bounds.items():
        part = seen.where(F.col("y") == y).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most the sum of the bounds, so small enough to broadcast.
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    with scratch():
        rows = written(rows.groupBy("doc_id", "y").agg(F.min("text").alias("text")), "labelled-texts")
        size = 1 << BUCKET_BITS
        in_1, in_0 = np.zeros(size), np.zeros(size)
        # At most one row for each bucket.
        counts = rows.mapInArrow(counter(orders), "bucket long, in_1 long, in_0 long").groupBy("bucket").agg(F.sum("in_1").alias("in_1"), F.sum("in_0").alias("in_0"))
        told = counts.where(F.col("in_1") + F.col("in_0") >= LEAST_TEXTS).toPandas()
        in_1[told["bucket"]], in_0[told["bucket"]] = told["in_1"], told["in_0"]
        m = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
        ratio, used = ratios(in_1, in_0, max(m.get(1, 0), 1), max(m.get(0, 0), 1))
        got = rows.mapInArrow(holder(used, orders), "doc_id long, y int, held array<int>").toPandas().sort_values("doc_id")
    return weighed([np.asarray(x, np.int64) for x in got["held"]], got["y"].to_numpy(int), (share(0), share(1)), ratio, used, orders)


def outside_fold(modulus: int, held: int) -> Column:
    """Whether a doc_id's row may be learnt from: crc32 of the id as text, modulo, is not the held-out remainder."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus != held, F.lit(False))


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    training: Column | None = None,
    orders: tuple[int, ...] = ORDERS,
    bounds: dict[int, int] = {1: FIT_POSITIVE, 0: FIT_NEGATIVE},  # noqa: B006
) -> DataFrame:
    """A toxicity score from 0 to 1 for each document, from its text alone.

    docs: doc_id, text; labels: doc_id, toxic, of which rows where training holds are learnt, at
    most `bounds` of each class. A null text is empty; an empty text scores what the bias says.
    Without labels of both classes all texts score their share. Rows stay rows. Returns doc_id, score.
    """
    model = fitted(docs, labels, "toxic", training, bounds, orders)
    return docs.select("doc_id", "text").mapInArrow(scorer(model), "doc_id long, score double")


def without_toxic(docs: DataFrame, labels: DataFrame, training: Column | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns, without the rows that score_toxicity puts at the threshold or above."""
    model = fitted(docs, labels, "toxic", training, {1: FIT_POSITIVE, 0: FIT_NEGATIVE})
    return docs.mapInArrow(keeper(model, threshold), docs.schema)
