import math
import random

import pytest
from pyspark.sql import functions as F

from weftgraph.llm import mixing


def water(sizes, weights, limit=3):
    total, capped = sum(sizes), set()
    while True:
        level = (total - sum(limit * sizes[i] for i in capped)) / max(1e-300, sum(w for i, w in enumerate(weights) if i not in capped))
        over = {i for i in range(len(sizes)) if i not in capped and level * weights[i] > limit * sizes[i]}
        if not over:
            return [limit * s if i in capped else level * weights[i] for i, s in enumerate(sizes)]
        capped |= over


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 300])), rng.choice(["a", "b", "c", "é", None, "hot", "hot"])) for i in range(400)]
    rows += [(900, None, "a"), (901, "", "zero"), (None, "some words here", "b"), (3, *rows[3][1:]), (950, "x\ty\nz", "tiny")]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), 7) for r in rows], "doc_id long, text string, source string, n_chars long, size int")
    plan = mixing.mix_plan(docs).collect()
    assert len(plan) == len(rows)
    names = sorted({r[2] for r in rows if r[2] is not None}, key=lambda s: [ord(c) for c in s]) + [None]
    sizes = [sum(len((t or "").split()) for _, t, s in rows if s == n) for n in names]
    want = water(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))])
    for n, size, target in zip(names, sizes, want):
        mine = [r for r in plan if r.source == n]
        assert {r.source_size for r in mine} == {size}
        assert all(math.isclose(r.target, target, rel_tol=1e-12) for r in mine)
        assert abs(sum(r.taken for r in mine) - target) <= 0.5
        assert all(r.taken <= 3 * r.size for r in mine)
        times = sorted((p.copy, p.position) for r in mine for p in r.passes)
        assert all(0 <= t <= 1 for _, t in times)
    out = mixing.mix(docs).collect()
    assert sum(len(r.text.split()) for r in out) <= sum(r.taken for r in plan)
    assert out and list(out[0].asDict()) == docs.columns
    again = [r for r in mixing.mix_plan(docs.orderBy(F.rand())).collect()]
    key = lambda r: str((r.doc_id, r.source, r.size, r.taken))
    assert sorted(map(key, plan)) == sorted(map(key, again))


def test_training_order_follows_the_schedules(spark):
    """By any time, each source has been asked for its schedule's share of its target, to about one document."""
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, " ".join(["w"] * rng.randrange(1, 30)), rng.choice("abc")) for i in range(600)], "doc_id long, text string, source string")
    plan = mixing.mix_plan(docs, per_range=1)
    for points, name in zip(mixing.SCHEDULES, "abc"):
        mine = [r for r in plan.collect() if r.source == name]
        passes = sorted((p.position, p.words) for r in mine for p in r.passes)
        for t in (0.1, 0.25, 0.5, 0.9):
            asked = sum(w for at, w in passes if at < t)
            (t0, w0), (t1, w1) = points
            share = (w0 * t + (w1 - w0) * t * t / 2) / mixing.integral(points)
            assert abs(asked - share * mine[0].target) <= 31
    ordered = mixing.in_training_order(plan).collect()
    places = [r.first_position for r in ordered]
    some = [x for x in places if x is not None]
    assert some == sorted(some) and places[: len(some)] == some
    assert all(r.first_position <= r.last_position for r in ordered if r.passes)


def test_position_inverts_the_integral(spark):
    schedules = [((0.0, 1.0), (0.5, 3.0), (1.0, 0.0)), ((0.0, 0.0), (1.0, 2.0))]
    for k, points in enumerate(schedules):
        rows = spark.range(0, 101).select((F.col("id") / 100).alias("s")).select("s", mixing.position(F.col("s"), F.lit(k), schedules).alias("t")).collect()
        for r in rows:
            area = 0.0
            for (t0, w0), (t1, w1) in zip(points, points[1:]):
                x = min(max(r.t, t0), t1)
                area += (x - t0) * (w0 + (w0 + (w1 - w0) * (x - t0) / (t1 - t0))) / 2
            assert area / mixing.integral(points) == pytest.approx(r.s, abs=1e-9)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_plan(empty).count() == 0
    assert mixing.mix(empty).count() == 0
