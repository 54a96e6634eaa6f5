import itertools
import random
import re

import numpy as np
import xxhash

from weftgraph.llm import simhash


def brute_fp(text, width=3):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(items, radius=3):
    parent = list(range(len(items)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations(enumerate(f for _, f in items), 2):
        if bin(a ^ b).count("1") <= radius:
            parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(items):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(items))]


def test_masks_cover_every_pair_within_the_radius():
    for turn in range(4):
        ms = simhash.masks(3, turn=turn)
        for bits in itertools.combinations(range(64), 3):
            x = sum(1 << b for b in bits)
            assert any(not m & x for m in ms)


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocab = ["w%d" % i for i in range(300)] + ["Ünï", "A"]
    texts = [None, "", " \t", "one", "Two words", "two WORDS"]
    for _ in range(40):
        base = [rng.choice(vocab) for _ in range(rng.randint(3, 400))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            other = list(base)
            other[rng.randrange(len(other))] = "changed"
            texts.append("\n".join(other))
    texts += [texts[10]] * 20
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "null id"), (7, texts[7])]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    got = [(r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    items = [(i, brute_fp(t)) for i, t in rows]
    want = [(i, f, c) for (i, f), c in zip(items, brute_components(items))]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = simhash.one_of_each(docs).select("doc_id").collect()
    assert sorted(str(r[0]) for r in kept) == sorted({str(c) for _, _, c in want})


def test_large_bucket_is_covered_again():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 700, dtype=np.uint64)
    flip = np.uint64(1) << rng.integers(0, 64, (700, 3)).astype(np.uint64)
    values = np.unique(np.concatenate([base] + [base ^ np.bitwise_xor.reduce(flip[:, :k], axis=1) for k in (1, 2, 3)]))
    edges = simhash._forest(values, 3, 1)
    parent = {int(v): int(v) for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        assert bin(a ^ b).count("1") <= 3
        parent[find(a)] = find(b)
    for k in (1, 2, 3):
        for a, b in zip(base, base ^ np.bitwise_xor.reduce(flip[:, :k], axis=1)):
            assert find(int(a)) == find(int(b))


def test_no_rows(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ids_do_not_choose_the_documents_that_stay(spark):
    rng = random.Random(8)
    texts = [" ".join("w%d" % rng.randrange(3000) for _ in range(60)) for _ in range(6)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (9, texts[3]), (None, texts[4]), (7, texts[4]), (3, texts[5])]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string")
    got = [(r.doc_id, r.text, r.fp) for r in simhash.one_of_each(docs).collect()]
    want = [(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (7, texts[4]), (3, texts[5])]
    assert sorted(got, key=str) == sorted([(*r, "x") for r in want], key=str)
