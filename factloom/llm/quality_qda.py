"""Quality classifier: a regularised quadratic discriminant.

Each class has a mean and a covariance of transformed statistics (log of sizes, square root of shares), shrunk towards the
pooled covariance and towards a multiple of its diagonal. The score is the logistic of the difference of the two log
densities, from Mahalanobis distances by the Cholesky factors that the fit keeps.

Defined results: an empty or null text is scored by its zero counts; with rows of fewer than two classes the score is the
share of class 1 (0.5 without labels). Rows without a usable label teach nothing; repeated rows each get a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from factloom.llm import text_stats
from factloom.llm.quality_rules import sampled

#: Labelled rows that the fit reads, at most (a uniform sample by hash of the doc_id beyond that).
TRAIN_ROWS = 40_000
TO_POOLED = 0.1
TO_DIAGONAL = 0.05


def transformed() -> dict[str, Column]:
    sizes = {"words", "mean_word", "longest", "line_words"}
    return {k: (F.log1p(c) if k in sizes else F.sqrt(c)).alias(k) for k, c in text_stats.shares().items()}


@dataclass(frozen=True)
class Model:
    prior: float
    means: np.ndarray | None = None  # 2 x features
    inverse: np.ndarray | None = None  # 2 x features x features: inverses of the Cholesky factors
    log_det: np.ndarray | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.prior)
        log = [-0.5 * (((x - m) @ inv.T) ** 2).sum(axis=1) - 0.5 * d for m, inv, d in zip(self.means, self.inverse, self.log_det, strict=True)]
        diff = log[1] - log[0] + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(diff, -500, 500)))


def fit_model(x: np.ndarray, y: np.ndarray) -> Model:
    n1 = int(y.sum())
    if min(n1, len(y) - n1) < 2:
        return Model(n1 / len(y) if len(y) else 0.5)
    parts = [x[y == c] for c in (0, 1)]
    covs = [np.cov(p.T, bias=True) for p in parts]
    pooled = sum(c * len(p) for c, p in zip(covs, parts, strict=True)) / len(x)
    inverse, log_det = [], []
    for c in covs:
        c = (1 - TO_POOLED) * c + TO_POOLED * pooled
        c = (1 - TO_DIAGONAL) * c + TO_DIAGONAL * np.diag(np.diag(pooled) + 1e-6)
        factor = np.linalg.cholesky(c)
        inverse.append(np.linalg.inv(factor))
        log_det.append(2 * np.log(np.diag(factor)).sum())
    return Model(n1 / len(y), np.array([p.mean(axis=0) for p in parts]), np.array(inverse), np.array(log_det))


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """Learn from stats (doc_id, COUNTS) and labels (doc_id, quality)."""
    usable = labels.where("quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("y"))
    rows = sampled(stats.join(usable, "doc_id"), TRAIN_ROWS).select("doc_id", "y", *transformed().values()).toPandas().sort_values(["doc_id", "y"], kind="stable")
    return fit_model(rows[list(transformed())].to_numpy(float), rows["y"].to_numpy())


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["doc_id", "score"])


def score(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1, higher: class 1 likelier)."""
    return stats.select("doc_id", *transformed().values()).mapInArrow(partial(_score, model=model), "doc_id long, score double")
