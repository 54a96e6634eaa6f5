import random
import re

import numpy as np
from pyspark.sql import functions as F

from weftgraph.llm import superkmer


def brute(rows, width=13):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    ids = [2**63 - 1 if d is None else d for d, _ in rows]
    least = {}
    for d, w in zip(ids, words):
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            least[k] = min(least.get(k, d), d)
    out = []
    for (doc, _), d, w in zip(rows, ids, words):
        gone = set()
        for i in range(len(w) - width + 1):
            if least[tuple(w[i : i + width])] < d:
                gone |= set(range(i, i + width))
        out.append((doc, " ".join(x for i, x in enumerate(w) if i not in gone), len(w), len(gone)))
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocab = ["a", "b", "ça", "日本", "x" * 40] + [f"v{i}" for i in range(60)]
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage = words(60)
    rows = [(50, None), (51, ""), (52, " \n\t"), (53, "a b c")]
    for i in range(60):
        w = words(rng.choice([5, 12, 13, 14, 40, 300]))
        if i % 3 == 0:
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage[rng.randrange(20) : rng.randrange(30, 60)]
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(w)))
    rows += [(100 + i, rows[10][1]) for i in range(40)]
    rows += [(7, rows[12][1]), (7, rows[12][1]), (None, rows[12][1]), (-5, "z " + " ".join(passage)), (200, " ".join(["same"] * 500)), (201, " ".join(["same"] * 20))]
    docs = spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id long, text string, start int, doc string").repartition(5)
    got = [tuple(r) for r in superkmer.dedup_substrings(docs).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)
    got = [tuple(r) for r in superkmer.dedup_substrings(docs, 4, 2, 3).collect()]
    assert sorted(got, key=str) == sorted(brute(rows, 4), key=str)


def test_windows_under_one_hash_are_told_apart():
    raw = b"abcabdabc"
    low, high = np.array([0, 3, 6]), np.array([3, 6, 9])
    number = superkmer.same_windows(raw, low, high, np.zeros(3, np.uint64))
    assert number[0] == number[2] != number[1]


def test_no_rows(spark):
    assert superkmer.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hot_minimisers_are_dealt_over_parts(spark, monkeypatch):
    """The run with the least hash of all stands in every window of most texts, so its bucket is hot."""
    monkeypatch.setattr(superkmer, "HOT_SAMPLE", 1)
    rng = random.Random(6)
    words = [f"v{i}" for i in range(400)]
    runs = [f"{a} {b}".encode() for a in words[:40] for b in words[:40]]
    hashes = [int(superkmer.textcore.RangeHash(np.frombuffer(r, np.uint8))(np.array([0]), np.array([len(r)]))[0]) for r in runs]
    hot = runs[int(np.argmin(hashes))].decode().split()
    rows = []
    for i in range(150):
        w = []
        while len(w) < 120:
            w += hot + [rng.choice(words) for _ in range(rng.randrange(3, 9))]
        if i % 5 == 0:
            w[40:40] = rows[0][1].split()[10:40] if rows else []
        rows.append((i, " ".join(w)))
    rows += [(None, rows[3][1]), (None, "q " + rows[4][1]), (2**62, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert superkmer.hot_parts(docs, 32, 13, 2)
    got = [tuple(r) for r in superkmer.dedup_substrings(docs, buckets=32).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)
