"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance that is shrunk towards its diagonal and towards the
pooled covariance; a score is the logistic of the difference of the log densities, which are
Mahalanobis distances taken with the Cholesky factors that are computed once and kept in
the model. The difference is tempered by a slope and offset fitted on the training rows
(Platt's scaling), since the normal densities are too sure of themselves.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import stats
from lectern.llm.common import forget, written

#: Shrinkage towards the pooled covariance and towards the diagonal; labelled rows for the slope and offset at most.
TO_POOLED, TO_DIAGONAL, SCALING_SAMPLE = 0.1, 0.1, 20_000
#: Ids that are broadcast at most.
BROADCAST_IDS = 2_000_000
#: A document is good from this score on.
GOOD = 0.7

#: The statistics, each transformed towards a bell shape: rates by their square root, counts are logarithms already.
FEATURES = {s: (F.sqrt if s.endswith("_rate") else None) for s in stats.SHAPE}


def features() -> list[Column]:
    return [(f(F.greatest(F.col(s), F.lit(0.0))) if f else F.col(s)).cast("double") for s, f in FEATURES.items()]


@dataclass
class Discriminant:
    """means[c]; factors[c]: inverse Cholesky factor; logs[c]: log determinant; slope and offset of the score."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    logs: list[float]
    slope: float = 1.0
    offset: float = 0.0

    def densities(self, x: np.ndarray) -> np.ndarray:
        z = [np.sum(((x - m) @ f.T) ** 2, axis=1) for m, f in zip(self.means, self.factors)]
        return 0.5 * ((z[0] + self.logs[0]) - (z[1] + self.logs[1]))

    def _mahalanobis(self, c: int) -> Column:
        x = [f - float(m) for f, m in zip(features(), self.means[c])]
        rows = [sum((x[j] * float(a) for j, a in enumerate(row[: i + 1])), F.lit(0.0)) for i, row in enumerate(self.factors[c])]
        return sum((r * r for r in rows), F.lit(float(self.logs[c])))

    def score(self) -> Column:
        t = F.lit(self.offset) + F.lit(self.slope * 0.5) * (self._mahalanobis(0) - self._mahalanobis(1))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(t, F.lit(500.0)), F.lit(-500.0))))


def _scaling(t: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic by Newton's method on the standardised difference."""
    t = np.clip(t, -500, 500)
    mid, wide = float(np.mean(t)), float(np.std(t)) or 1.0
    a, w = np.column_stack([(t - mid) / wide, np.ones_like(t)]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -50, 50)))
        h = a.T @ (a * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, a.T @ (y - p) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return (float(w[0] / wide), float(w[1] - w[0] * mid / wide)) if w[0] > 0 else (1.0, 0.0)


def fit(rows: DataFrame, labels: DataFrame, to_pooled: float = TO_POOLED, to_diagonal: float = TO_DIAGONAL) -> Discriminant:
    """The discriminant of all labelled rows outside the held-out fold.

    rows: doc_id and the statistics of stats.shape(). Counts, sums and products are one aggregate
    over the labelled ones. A class without rows takes the
    other's moments, so that without labels every score is one half.
    """
    known = stats.labelled(rows, labels, "quality").select("doc_id", "label", F.array(*features()).alias("x"))
    known = written(known, "classifier-rows")
    k = len(FEATURES)
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    moments = [F.sum(F.col("x")[i]) for i in range(k)] + [F.sum(F.col("x")[i] * F.col("x")[j]) for i, j in pairs]
    n, mean, cov = [0, 0], [np.zeros(k)] * 2, [np.eye(k)] * 2
    for row in known.groupBy("label").agg(F.count("*"), *moments).collect():
        c, n[row[0]] = row[0], row[1]
        m, s = np.array(row[2 : 2 + k]) / row[1], np.zeros((k, k))
        for (i, j), v in zip(pairs, row[2 + k :]):
            s[i, j] = s[j, i] = v / row[1]
        mean[c], cov[c] = m, s - np.outer(m, m)
    if 0 in n:
        c = int(n[1] > 0)
        mean, cov = [mean[c]] * 2, [cov[c]] * 2
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / max(1, sum(n))
    if not sum(n):
        pooled = np.eye(k)
    factors, logs = [], []
    for c in (0, 1):
        s = (1 - to_pooled) * cov[c] + to_pooled * pooled
        s = (1 - to_diagonal) * s + to_diagonal * np.diag(np.diag(s)) + np.diag(1e-4 * np.diag(pooled) + 1e-6)
        low = np.linalg.cholesky(s)
        factors.append(np.linalg.inv(low))
        logs.append(float(2 * np.log(np.diag(low)).sum()))
    model = Discriminant(mean, factors, logs)
    if 0 not in n:
        share = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("scaling")), F.lit(1_000_000)) < min(1.0, SCALING_SAMPLE / sum(n)) * 1_000_000
        rows = known.filter(share).select("x", "label").collect()
        x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
        if len(rows) and 0 < y.sum() < len(y):
            model.slope, model.offset = _scaling(model.densities(x), y)
    forget(known)
    return model


def fit_texts(docs: DataFrame, labels: DataFrame) -> Discriminant:
    """fit() from texts (doc_id, text): statistics are taken of the labelled rows outside the held-out fold alone.

    Their ids are broadcast up to BROADCAST_IDS of them; with more, texts are shuffled to meet them.
    """
    ids = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~stats.held_out()).select("doc_id").distinct()
    ids = written(ids, "labelled-ids")
    ids_of = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("merge")
    model = fit(stats.shape(docs.select("doc_id", "text").join(ids_of, "doc_id", "left_semi"), ["doc_id"]), labels)
    forget(ids)
    return model


def scored(rows: DataFrame, model: Discriminant) -> DataFrame:
    """rows, which have doc_id and the statistics of stats.shape(), with held_out, score and predicted.

    Only the text is an input of the score; a null text is empty and gets the score of the empty
    text. Equal texts get equal scores, an empty table gives an empty result.
    """
    out = rows.withColumn("held_out", stats.held_out()).withColumn("score", model.score())
    return out.withColumn("predicted", F.when(F.col("score") >= GOOD, 1).otherwise(0))
