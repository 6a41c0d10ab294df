"""Labelled samples, logistic fits and calibration that the two classifiers share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_training(doc_id: Column) -> Column:
    """Documents whose labels may be learned: crc32 of the id as text, modulo 3, is not 1; never a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1, F.lit(False))


def sample(documents: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(doc_id, text, y, weight) of a bounded sample of the labelled training documents.

    Of each class about ``per_class`` labels are chosen by a hash of doc_id; ``weight`` is by how much the class was
    thinned. Labels other than 0 and 1 are left out, as are contradictory or repeated labels of an id but the largest. The chosen ids, bounded
    so, are broadcast.
    """
    rows = labels.filter(is_training(F.col("doc_id")) & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    total = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30))
    below = F.when(F.col("y") == 1, F.lit(min(1.0, per_class / total.get(1, 1)))).otherwise(F.lit(min(1.0, per_class / total.get(0, 1))))
    weight = F.when(F.col("y") == 1, F.lit(max(1.0, total.get(1, 1) / per_class))).otherwise(F.lit(max(1.0, total.get(0, 1) / per_class)))
    chosen = rows.filter(place < below * F.lit(1 << 30)).withColumn("weight", weight)
    return documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Coefficients of a weighted logistic regression, the constant last, by Newton steps."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = sigmoid(a @ w)
        grad = a.T @ (weight * (p - y)) + ridge * np.append(w[:-1], 0)
        hess = (a * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + ridge * np.diag(np.append(np.ones(len(w) - 1), 1e-6))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
