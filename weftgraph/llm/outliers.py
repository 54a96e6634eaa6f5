"""Quality rules with robust multivariate outliers.

A document that passes the base rules becomes a vector of transformed statistics. The minimum
covariance determinant of each language and source is found over all its documents by C-steps: from
a robust start, each step takes the share `support` of documents with the least Mahalanobis
distances and makes mean and covariance of them, until the determinants no longer fall. One step is one aggregation: moments by group and
distance bin, so the least distances are a prefix of a group's bins and no group is ever collected.
A group with too few documents for an estimate uses its language's, or that of all documents.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm import textstats
from weftgraph.llm.storage import Written, written

#: The vector, each with the least standard deviation it is taken to have: what an honest short text varies by.
VECTOR = {"word_length": 0.12, "symbols": 0.35, "dup_lines": 0.12, "repeats": 0.12, "upper": 0.05, "marks": 0.3}
P = len(VECTOR)
SUPPORT, QUANTILE, STEPS, LEAST_GROUP = 0.75, 0.9999, 8, 100
#: C-steps end once no group's log-determinant moves by more.
SETTLED = 0.01
BINS = 16  # of distance to a doubling


def chi2_cdf(x: float, dof: int) -> float:
    """For an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dof // 2))


def chi2_quantile(q: float, dof: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, dof) < q else (low, mid)
    return low


def consistency(support: float) -> float:
    """What the covariance of the nearest share of normal vectors is multiplied by."""
    return support / chi2_cdf(chi2_quantile(support, P), P + 2)


def vector() -> dict[str, Column]:
    c = F.col
    words, chars = F.greatest(c("n_words"), F.lit(1)), F.greatest(c("word_chars"), F.lit(1))
    return {
        "word_length": F.log(chars / words),
        "symbols": F.log1p(100 * c("n_symbols") / chars),
        "dup_lines": c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1)),
        "repeats": c("n_repeat_words") / words,
        "upper": c("n_upper") / chars,
        "marks": F.log1p(10 * c("n_marks") / words),
    }


def _key(level: int) -> Column:
    name = lambda k: F.coalesce(F.concat(F.lit("="), F.col(k)), F.lit("null"))
    return F.concat_ws("\x00", F.lit(str(level)), *[name(k) for k in ("lang", "source")[:level]])


def _distance(params: str = "params") -> Column:
    """Squared Mahalanobis distance: params holds the centre, then the whitening matrix by rows."""
    x = [F.col(k) - F.col(params)[i] for i, k in enumerate(VECTOR)]
    out = F.lit(0.0)
    for i in range(P):
        row = F.lit(0.0)
        for j in range(i + 1):  # lower triangular
            row = row + x[j] * F.col(params)[P + i * P + j]
        out = out + row * row
    return out


def _finish(support: float):
    """A group's moments by bin, least distances first, to centre and whitening matrix."""
    pairs = [(i, j) for i in range(P) for j in range(i + 1)]
    floor = np.diag([s * s for s in VECTOR.values()])

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin", kind="stable")
        n = pdf["n"].to_numpy(np.float64)
        upto = int(np.searchsorted(np.cumsum(n), support * n.sum() - 1e-9)) + 1
        took = pdf.iloc[:upto]
        m = took["n"].sum()
        mean = np.array([took[f"s{i}"].sum() for i in range(P)]) / m
        cov = np.zeros((P, P))
        for i, j in pairs:
            cov[i, j] = cov[j, i] = took[f"p{i}_{j}"].sum() / m - mean[i] * mean[j]
        share = m / n.sum()
        cov = cov * (consistency(share) if share < 1 - 1e-9 else 1.0) + floor
        root = np.linalg.cholesky(cov)
        det, white = 2 * np.log(np.diag(root)).sum(), np.linalg.inv(root)
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "n": [int(n.sum())], "det": [det], "params": [np.concatenate([mean, white.ravel()])]})

    return of


def estimates(vectors: DataFrame, support: float = SUPPORT, steps: int = STEPS) -> DataFrame:
    """Centre and whitening matrix for each key: key, n, det (the covariance's log-determinant), params.

    vectors: VECTOR's columns, lang, source. Keys are all documents, each language, and each
    language and source; a null language or source is one of its own. At most `steps` C-steps.
    """
    keyed = vectors.withColumn("key", F.explode(F.array(*[_key(k) for k in (0, 1, 2)])))
    names = list(VECTOR)
    moments = [F.count("*").alias("n")] + [F.sum(k).alias(f"s{i}") for i, k in enumerate(names)]
    moments += [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"p{i}_{j}") for i in range(P) for j in range(i + 1)]
    schema = "key string, n long, det double, params array<double>"
    table = None
    for _ in range(steps + 1):
        if table is None:
            # The start: distance from a fixed centre of an honest text's rates, in units of the floors.
            centre = vectors.groupBy().agg(*[F.percentile_approx(k, 0.5, 1000).alias(f"m_{k}") for k in names])
            far = sum((((F.col(k) - F.col(f"m_{k}")) / s) ** 2 for k, s in VECTOR.items()), F.lit(0.0))
            seen = keyed.join(F.broadcast(centre))  # one row
        else:
            known = table.read().select(F.col("key").alias("k"), "params")
            seen, far = keyed.join(known, F.col("key") == F.col("k")), _distance()
        binned = seen.withColumn("bin", F.floor(F.log2(far + 1e-6) * BINS).cast("int"))
        summed = binned.groupBy("key", "bin").agg(*moments)
        fresh = Written(summed.groupBy("key").applyInPandas(_finish(support), schema), "mcd")
        moved = None
        if table is not None:
            before = table.read().select(F.col("key").alias("k"), F.col("det").alias("was"))
            moved = fresh.read().join(before, F.col("key") == F.col("k")).agg(F.max(F.abs(F.col("det") - F.col("was")))).first()[0]
            table.drop()
        table = fresh
        if moved is not None and moved <= SETTLED:
            break
    assert table is not None
    return table.read()


def quality_rules(
    docs: DataFrame, support: float = SUPPORT, quantile: float = QUANTILE, steps: int = STEPS, least_group: int = LEAST_GROUP
) -> DataFrame:
    """Statistics of each document, whether it fails the base rules, and whether it is kept.

    docs: doc_id, text, lang, source; other columns are ignored. A null text has no words and fails
    the base rules: fewer than 50 words, or more than half of its words in repeated 3-word windows.
    Others are kept if their squared distance is at most the chi-square quantile. Estimates are over
    all documents that pass the base rules; rows stay rows, repeated or null ids too. A group of
    fewer than least_group documents uses its language's estimate, or else that of all. Returns
    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept.
    """
    keep = ("doc_id", "lang", "source")
    schema = "doc_id long, lang string, source string, " + ", ".join(f"{k} long" for k in textstats.COUNTS)
    stats = docs.select(*keep, "text").mapInArrow(textstats.counted(keep), schema)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = written(stats.withColumn("base_failed", failed).withColumns(vector()), "rules")
    params = estimates(stats.where("not base_failed").select("lang", "source", *VECTOR), support, steps)
    enough = params.where((F.col("n") >= least_group) | (F.col("key") == "0")).select("key", "params")
    at = stats.withColumns({f"k{level}": _key(level) for level in (0, 1, 2)})
    for level in (2, 1, 0):
        known = enough.select(F.col("key").alias("k"), F.col("params").alias(f"params{level}"))
        at = at.join(known, F.col(f"k{level}") == F.col("k"), "left").drop("k")
    at = at.withColumn("params", F.coalesce("params2", "params1", "params0"))
    distance = F.when(~F.col("base_failed"), _distance())
    at = at.withColumn("distance", distance)
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= chi2_quantile(quantile, P), F.lit(False))
    return at.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", kept.alias("kept")
    )
