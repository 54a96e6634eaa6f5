import random

import numpy as np
import pyarrow as pa

from weftgraph.llm import pu_quality, toxicity

RUDE = ["grobian", "lumpenhund", "schuft"]


def corpus(n=900, seed=1):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghilmnoprstué") for _ in range(rng.randint(2, 8))) for _ in range(800)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.choice([20, 80, 300]))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(RUDE) + rng.choice(["", ".", "e", "isch"]))
        good = i % 4 != 1
        if not good:
            words = [w + "***" for w in words] if i % 8 == 1 else [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), int(toxic), int(good)))
    return rows


def frames(spark):
    rows = corpus()
    extra = [(5000, None), (5001, ""), (5002, "x"), (None, rows[0][1]), (0, rows[0][1]), (5003, "long text " * 20_000)]
    docs = spark.createDataFrame([(d, t, 9) for d, t, _, _ in rows] + [(*e, 9) for e in extra], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(d, x, g) for d, _, x, g in rows] + [(0, 1, 1), (7777, 1, 1), (None, 1, 1), (3, None, None)], "doc_id long, toxic int, quality int")
    return rows, docs, labels


def test_toxicity_held_out(spark):
    rows, docs, labels = frames(spark)
    training = toxicity.outside_fold(4, 2)
    got = toxicity.score_toxicity(docs, labels, training).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    score = {r.doc_id: r.score for r in got}
    import zlib

    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    right = [(score[d] >= toxicity.THRESHOLD) == bool(x) for d, _, x, _ in held]
    assert np.mean(right) > 0.95
    kept = {r.doc_id for r in toxicity.without_toxic(docs, labels).collect()}
    assert {5000, 5001, 5003} <= kept and toxicity.without_toxic(docs, labels).columns == docs.columns


def test_toxicity_scores_match_a_plain_sum(spark):
    rows = corpus(200)
    model = toxicity.fit([t for _, t, _, _ in rows], np.array([x for _, _, x, _ in rows]), (0.8, 0.2))
    texts = ["Grobian!  und\n\nschuft", "", None, "é" * 10]
    got = toxicity.scores(pa.array(texts), model, model.weights)
    for t, s in zip(texts, got):
        raw = (t or "").lower().encode()
        buckets = set()
        for bucket, _ in toxicity.ngrams(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), model.orders):
            buckets |= set(bucket.tolist())
        assert abs(s - 1 / (1 + np.exp(-(sum(model.weights[b] for b in buckets) + model.bias)))) < 1e-9


def test_toxicity_fit_is_that_of_plain_descent():
    """The same penalised risk, by slow descent with small steps on a dense table of n-grams."""
    rows = corpus(150, 3)
    texts, y = [t for _, t, _, _ in rows], np.array([x for _, _, x, _ in rows])
    shares = (0.8, 0.2)
    model = toxicity.fit(texts, y, shares)
    held = []
    for t in texts:
        raw = t.lower().encode()
        held.append({b for bucket, _ in toxicity.ngrams(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), model.orders) for b in bucket.tolist()})
    every = sorted(set().union(*held))
    in_1 = {b: sum(b in h for h, k in zip(held, y) if k) for b in every}
    in_0 = {b: sum(b in h for h, k in zip(held, y) if not k) for b in every}
    n1, n0 = y.sum(), (1 - y).sum()
    ratio = {b: np.log((in_1[b] + 1) / (n1 + 2)) - np.log((in_0[b] + 1) / (n0 + 2)) for b in every}
    used = [b for b in every if in_1[b] + in_0[b] >= toxicity.LEAST_TEXTS and abs(ratio[b]) > toxicity.LEAST_RATIO]
    x = np.array([[ratio[b] * (b in h) for b in used] for h in held])
    weight = np.where(y == 1, shares[1] / n1, shares[0] / n0)
    w, bias = np.zeros(len(used)), np.log(shares[1] / shares[0])
    step = 4 / (weight @ (x**2).sum(1))
    for _ in range(6000):
        g = weight * (1 / (1 + np.exp(-(x @ w + bias))) - y)
        w = w - step * (x.T @ g)
        w = np.sign(w) * np.maximum(np.abs(w) - step * toxicity.PENALTY, 0)
        bias -= g.sum()
    risk = lambda v, c: weight @ np.logaddexp(0, np.where(y == 1, -1, 1) * (x @ v + c)) + toxicity.PENALTY * np.abs(v).sum()
    own = np.array([model.weights[b] / ratio[b] for b in used])
    assert set(np.flatnonzero(model.weights)) <= set(used)
    start = risk(0 * w, np.log(shares[1] / shares[0]))
    assert risk(own, model.bias) - risk(w, bias) <= 0.01 * start
    chance = lambda v, c: 1 / (1 + np.exp(-(x @ v + c)))
    assert np.abs(chance(own, model.bias) - chance(w, bias)).max() < 0.05


def test_an_id_labelled_both_ways_is_toxic(spark):
    rows, docs, labels = frames(spark)
    other = spark.createDataFrame([(d, 1 - x, g) for d, _, x, g in rows if x], "doc_id long, toxic int, quality int")
    a, b = (toxicity.fitted(docs, x, "toxic", None, {1: 400, 0: 400}) for x in (labels, labels.unionByName(other)))
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_negative_risk_is_not_let_below_zero():
    """Positives and unlabelled texts of two kinds in known shares: the prior is found, the risk of negatives stays above zero."""
    rng = np.random.default_rng(2)
    make = lambda n, at: rng.normal(at, 1, (n, pu_quality.FEATURES))
    positive = make(300, 1.5)
    unlabelled = np.vstack([make(400, 1.5), make(200, -1.5)])
    model = pu_quality.fit(positive, unlabelled)
    assert abs(model.prior - 2 / 3) < 0.1
    z = lambda x: pu_quality.expanded(x, model.centre, model.spread) @ model.weights
    of_u, of_p = np.logaddexp(0, z(unlabelled)).mean(), np.logaddexp(0, z(positive)).mean()
    assert of_u - model.prior * of_p > -0.05
    assert np.mean(z(make(500, 1.5)) > 0) > 0.95 and np.mean(z(make(500, -1.5)) < 0) > 0.95


def test_without_labels(spark):
    _, docs, labels = frames(spark)
    assert len({r.score for r in toxicity.score_toxicity(docs, labels.limit(0)).collect()}) == 1
    assert {r.score for r in pu_quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0
    assert pu_quality.score_quality(docs.limit(0), labels).count() == 0


def test_quality_held_out(spark):
    import zlib

    rows, docs, labels = frames(spark)
    got = pu_quality.score_quality(docs, labels, toxicity.outside_fold(3, 1)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    score = {r.doc_id: r.score for r in got}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert np.mean([(score[d] >= 0.5) == bool(g) for d, _, _, g in held]) > 0.93


def test_class_prior():
    rng = np.random.default_rng(0)
    positive = rng.normal(2, 1, 4000)
    unlabelled = np.concatenate([rng.normal(2, 1, 6000), rng.normal(-2, 1, 4000)])
    assert abs(pu_quality.prior_of(positive, unlabelled) - 0.6) < 0.05
