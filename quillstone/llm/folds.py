"""Labelled training rows, held-out folds and small numeric helpers of the two classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, most: int) -> list[tuple[str, int]]:
    """(text, label) of labelled rows outside the held-out fold, at most ``most`` of them: the first by a hash of the id, so every
    run takes the same ones. The sort keeps ``most`` rows a task and comes before texts are joined. Of rows that repeat an id the lesser label
    and the least text count, so reruns agree."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter("doc_id is not null and y is not null")
    known = known.filter(F.coalesce(fold(F.col("doc_id"), folds), F.lit(held)) != held).groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(known), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    return [(r.text, r.y) for r in sorted(rows.collect(), key=lambda r: r.doc_id)]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Weights (the last one is the offset) of ridge logistic regression, by Newton steps."""
    a = np.c_[x, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w -= np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + penalty, a.T @ (p - y) + penalty @ w)
    return w
