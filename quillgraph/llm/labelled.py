"""A bounded sample of labelled training rows, and a small logistic fit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def classes(labels: DataFrame, label: str, train: Column, id_col: str) -> DataFrame:
    """(__id, y) of all training rows: null labels are left out, an id labelled more than once has its greatest label."""
    return labels.where(train).where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label).cast("int").alias("y"))


def sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, per_class: int, *, id_col: str = "doc_id") -> tuple[DataFrame, dict[int, int]]:
    """Up to per_class training rows (id, text columns of docs, y) of each class, by a hash of the id, and the classes' sizes.

    `train` is a condition on the labels' rows. The sample's ids, at most 2 * per_class, are broadcast; the documents aren't shuffled.
    """
    own = classes(labels, label, train, id_col)
    sizes = {r["y"]: r["count"] for r in own.groupBy("y").count().collect()}
    some = [own.where(F.col("y") == y).orderBy(F.xxhash64("__id", F.lit(5)), "__id").limit(per_class) for y in (0, 1)]
    return docs.join(F.broadcast(some[0].unionByName(some[1])), F.col(id_col) == F.col("__id")).drop("__id"), sizes


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, steps: int = 60) -> np.ndarray:
    """Coefficients that maximise the weighted log likelihood less ridge/2 |w|^2, by Newton steps with halving."""
    w = np.zeros(x.shape[1])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + ridge / 2 * w @ w)

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        gradient = x.T @ (weight * (p - y)) + ridge * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        scale = 1.0
        while scale > 1e-6 and loss(w - scale * step) > now:
            scale /= 2
        w = w - scale * step
        after = loss(w)
        if now - after < 1e-10 * (1 + abs(now)):
            break
        now = after
    return w
