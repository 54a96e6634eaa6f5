import random
import re
from collections import Counter

import numpy as np

from weftgraph.llm import outliers


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def corpus():
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdeéfghi") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    rows = []
    for i in range(500):
        rows.append((i, " ".join(words(rng.choice([60, 120, 400]))), rng.choice(["en", "de", None]), rng.choice(["a", "b"])))
    junk = [" ".join(w + "***" for w in words(150)), " ".join(w.upper() + "!!" for w in words(150)), "\n".join(["same line here"] * 3 + [" ".join(words(3)) + " | " for _ in range(60)])]
    rows += [(1000 + i, t, "en", "a") for i, t in enumerate(junk)]
    rows += [(2000, None, "en", "a"), (2001, "", None, None), (2002, "few words", "xx", "rare"), (2003, "a b c " * 100, "en", "a"), (2004, "x\n\nx\n y\nx \nx", "en", "b"), (None, rows[0][1], "en", "a"), (1, rows[1][1], "de", "b"), (2005, " ".join(words(9000)), "zz", "lonely")]
    return rows


def test_statistics_and_verdicts(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, lang string, source string, kept int")
    got = outliers.quality_rules(docs).collect()
    have = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=str)
    want = []
    for d, t, _, _ in rows:
        n, c, s, dup, rep = brute(t)
        want.append((d, n, c, s, dup, rep, n < 50 or 100 * rep > 50 * n))
    assert have == sorted(want, key=str)
    kept = {r.doc_id: r.kept for r in got}
    assert not any(kept[i] for i in (1000, 1001, 1002, 2000, 2001, 2002, 2003))
    assert kept[2005] and np.mean([kept[i] for i in range(500)]) > 0.99
    assert outliers.quality_rules(docs.limit(0)).count() == 0


def test_estimate_resists_outliers(spark):
    rng = np.random.default_rng(3)
    n = 4000
    x = rng.normal(0, 1, (n, outliers.P)) * np.array([3, 1, 2, 1, 1, 4.0]) + 5
    x[: n // 8] += 100
    rows = [(*map(float, r), "en", "a") for r in x]
    vectors = spark.createDataFrame(rows, [*outliers.VECTOR, "lang", "source"])
    found = {r.key: r for r in outliers.estimates(vectors).collect()}
    r = next(v for k, v in found.items() if k.startswith("2"))
    assert r.n == n and np.allclose(r.params[: outliers.P], 5, atol=0.4)
    white = np.array(r.params[outliers.P :]).reshape(outliers.P, outliers.P)
    spread = np.sqrt(np.diag(np.linalg.inv(white.T @ white)))
    assert np.all(spread / np.array([3, 1, 2, 1, 1, 4.0]) < 1.25) and np.all(spread / np.array([3, 1, 2, 1, 1, 4.0]) > 0.75)


def test_chi_square():
    assert abs(outliers.chi2_cdf(outliers.chi2_quantile(0.975, 6), 6) - 0.975) < 1e-9
    assert abs(outliers.chi2_quantile(0.95, 6) - 12.5916) < 1e-3


def plain_mcd(x, support, starts, rng):
    """The least determinant that C-steps from random starts reach, with its mean."""
    h, best = int(np.ceil(support * len(x))), (np.inf, None)
    for _ in range(starts):
        near = rng.choice(len(x), 8, replace=False)
        for _ in range(40):
            mean, cov = x[near].mean(0), np.cov(x[near].T, bias=True) + 1e-9 * np.eye(x.shape[1])
            fresh = np.argsort(((x - mean) @ np.linalg.inv(cov) * (x - mean)).sum(1))[:h]
            if set(fresh) == set(near):
                break
            near = fresh
        mean, cov = x[near].mean(0), np.cov(x[near].T, bias=True)
        best = min(best, (np.linalg.slogdet(cov)[1], tuple(mean)))
    return best


def test_determinants_are_those_of_many_random_starts(spark):
    """Contaminated groups of several shapes: scattered far points, and one tight cluster of outliers."""
    rng = np.random.default_rng(9)
    rows, groups = [], {}
    for name, share, shift, tight in (("far", 0.2, 12, 4.0), ("cluster", 0.2, 8, 0.2), ("clean", 0.0, 0, 1.0)):
        n = 900
        mix = np.eye(outliers.P) + 0.4 * np.tri(outliers.P, k=-1)
        x = rng.normal(0, 1, (n, outliers.P)) @ mix.T * 2
        bad = int(share * n)
        x[:bad] = rng.normal(shift, tight, (bad, outliers.P))
        groups[name] = x
        rows += [(*map(float, r), "en", name) for r in x]
    vectors = spark.createDataFrame(rows, [*outliers.VECTOR, "lang", "source"])
    found = {r.key: r for r in outliers.estimates(vectors).collect()}
    for name, x in groups.items():
        r = next(v for k, v in found.items() if k.startswith("2") and k.endswith(name))
        det, mean = plain_mcd(x, outliers.SUPPORT, 60, rng)
        scaled = det + outliers.P * np.log(outliers.consistency(outliers.SUPPORT))
        if name == "cluster":
            # The least determinant itself takes the tight cluster in; the robust start ends at the honest documents.
            assert r.det > scaled and np.allclose(r.params[: outliers.P], 0, atol=0.4)
            continue
        # Bins take up to a sixteenth of a doubling more than the share, and the floors add to the variances.
        assert -0.3 < r.det - scaled < 0.8, (name, r.det, scaled)
        assert np.allclose(r.params[: outliers.P], mean, atol=0.3), name
