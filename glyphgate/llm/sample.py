"""Bounded, repeatable samples of labelled rows and checks that a classifier is fitted on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


def labels_of(labels: DataFrame, column: str, id_col: str = "doc_id") -> DataFrame:
    """One row per id: the smallest 0/1 label; null ids and other values don't count."""
    return (labels.select(F.col(id_col).alias("__id"), F.col(column).cast("int").alias("__label"))
            .where("__id IS NOT NULL AND __label IN (0, 1)").groupBy("__id").agg(F.min("__label").alias("__label")))


def balanced(labels: DataFrame, column: str, per_class: int, id_col: str = "doc_id", where: Column | None = None) -> DataFrame:
    """At most ``per_class`` labelled ids of each class: those with the smallest hashes (``__id``, ``__label``)."""
    rows = labels_of(labels, column, id_col)
    rows = rows if where is None else rows.where(where)
    order = [F.xxhash64("__id"), F.col("__id")]
    one, zero = (rows.where(F.col("__label") == k).orderBy(*order).limit(per_class) for k in (1, 0))
    return one.unionByName(zero)


def class_counts(labels: DataFrame, column: str, id_col: str = "doc_id", where: Column | None = None) -> dict[int, int]:
    rows = labels_of(labels, column, id_col)
    rows = rows if where is None else rows.where(where)
    return {r["__label"]: r["n"] for r in rows.groupBy("__label").agg(F.count("*").alias("n")).collect()}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def platt(score: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic curve from raw scores to probabilities (weighted Newton steps).

    Targets are pulled off 0 and 1 by the class sizes, so that separable scores stay finite.
    """
    up, down = max(1.0, float(weight[label == 1].sum())), max(1.0, float(weight[label == 0].sum()))
    target = np.where(label == 1, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack([score, np.ones_like(score)], 1)
    beta = np.array([0.0, np.log(up / down)])

    def loss(b):
        p = np.clip(sigmoid(x @ b), 1e-12, 1 - 1e-12)
        return -(weight * (target * np.log(p) + (1 - target) * np.log(1 - p))).sum()

    for _ in range(60):
        p = sigmoid(x @ beta)
        grad = x.T @ (weight * (p - target))
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + 1e-9 * np.eye(2), grad)
        size = 1.0
        while size > 1e-6 and loss(beta - size * step) > loss(beta):
            size /= 2
        beta = beta - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])
