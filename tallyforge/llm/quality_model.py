"""Operator 5, quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a Gaussian over the transformed statistics, its covariance shrunk towards the pooled one and then towards
a multiple of the identity. The fit needs only counts, sums and sums of products by class, so it reads every labelled row
in one aggregation and two rows reach the driver. The Cholesky factor of each covariance is inverted once; a score is the
difference of two Mahalanobis log-densities, a column expression.

Edge cases: null and empty texts have all counts 0 and are scored like any other; a class with fewer than two rows leaves
the share of label 1 (0.5 without labels) as everyone's score; repeated rows and labels count as often as they occur;
rows without a label are scored but not learnt from; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import materialize
from tallyforge.llm.statistics import document_statistics

#: Counts to roughly symmetric figures: logarithms of sizes, square roots of shares.
FEATURES: tuple[str, ...] = (
    "ln(1 + n_words)",
    "ln(1 + n_words / (1 + n_lines))",
    "word_chars / (1 + n_words)",
    "sqrt(n_symbols / (1 + word_chars))",
    "sqrt(n_dup_lines / (1 + n_lines))",
    "sqrt(n_repeat_words / (1 + n_words))",
    "n_distinct_words / (1 + n_words)",
    "sqrt(n_upper / (1 + word_chars))",
    "sqrt(n_digits / (1 + word_chars))",
    "sqrt(n_marks / (1 + word_chars))",
    "sqrt(n_stops / (1 + word_chars))",
    "sqrt(n_wide / (1 + word_chars))",
)


@dataclass(frozen=True)
class Gaussian:
    mean: np.ndarray
    factor: np.ndarray  # inverse of the Cholesky factor
    offset: float  # log prior minus half the log determinant

    def log_density(self, x: list[str]) -> F.Column:
        squares = None
        for row in self.factor:
            z = F.lit(float(-row @ self.mean))
            for name, weight in zip(x, row, strict=True):
                if weight:
                    z = z + F.col(name) * F.lit(float(weight))
            squares = z * z if squares is None else squares + z * z
        return F.lit(self.offset) - squares / 2


def fit(rows: DataFrame, label: str, x: list[str], pooled: float = 0.1, ridge: float = 0.01) -> dict[int, Gaussian]:
    """A Gaussian for each of the labels 0 and 1, from one aggregation of ``rows``."""
    k = len(x)
    at = [(i, j) for i in range(k) for j in range(i + 1)]
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(x)] + [F.sum(F.col(x[i]) * F.col(x[j])).alias(f"p{i}_{j}") for i, j in at]
    got = {r[label]: r for r in rows.where(F.col(label).isin(0, 1)).groupBy(label).agg(F.count("*").alias("n"), *sums).collect()}
    if len(got) < 2 or min(r["n"] for r in got.values()) < 2:
        return {}
    means, scatter = {}, {}
    for c, r in got.items():
        means[c] = np.array([r[f"s{i}"] for i in range(k)]) / r["n"]
        m = np.zeros((k, k))
        for i, j in at:
            m[i, j] = m[j, i] = r[f"p{i}_{j}"]
        scatter[c] = m - r["n"] * np.outer(means[c], means[c])
    total = sum(r["n"] for r in got.values())
    within = sum(scatter.values()) / total
    scale = np.sqrt(np.maximum(np.diag(within), 1e-9))  # the identity is that of standardised figures
    out = {}
    for c, r in got.items():
        s = ((1 - pooled) * scatter[c] / r["n"] + pooled * within) / np.outer(scale, scale)
        s = (1 - ridge) * s + ridge * max(np.trace(s) / k, 1e-6) * np.eye(k)
        low = np.linalg.cholesky(s)
        factor = np.linalg.inv(low) / scale
        out[c] = Gaussian(means[c], factor, float(np.log(r["n"] / total) - np.log(np.diag(low)).sum()))
    return out


def score_quality(docs: DataFrame, labels: DataFrame, learn: F.Column, label: str = "quality", threshold: float = 0.7) -> DataFrame:
    """doc_id, score (probability of label 1) and predicted; ``learn`` tells by doc_id which labels may be read."""
    x = [f"x{i}" for i in range(len(FEATURES))]
    figures = document_statistics(docs).select("doc_id", *[F.expr(e).cast("double").alias(n) for e, n in zip(FEATURES, x, strict=True)])
    figures = materialize(figures, "figures")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), label).where(learn)
    model = fit(figures.join(known, "doc_id"), label, x)
    if model:
        gap = F.greatest(F.lit(-500.0), F.least(F.lit(500.0), model[1].log_density(x) - model[0].log_density(x)))
        score = 1 / (1 + F.exp(-gap))
    else:
        share = known.agg(F.avg(label)).first()[0]
        score = F.lit(0.5 if share is None else float(share))
    return figures.select("doc_id", score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
