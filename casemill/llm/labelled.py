"""What the two labelled operators share: the labels of rows that may be learnt from, and calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A label table up to this many rows is broadcast (two numbers a row); a larger one is joined by shuffle.
BROADCAST_LABELS = 2_000_000


def crc_of_id():
    return F.crc32(F.col("doc_id").cast("string").cast("binary"))


def learnable(labels: DataFrame, column: str, kept, bound: int | None = None) -> DataFrame:
    """(doc_id, y) of the rows whose label may be learnt; one row for each doc_id, the larger label where they differ.

    bound: about so many rows at most. The same rows every time: those whose id has a hash below the share that is wanted.
    """
    if bound is not None and (n := labels.count()) > bound:
        kept = kept & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * bound / n))
    rows = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull()).where(kept).groupBy("doc_id").agg(F.max(column).cast("int").alias("y"))
    return F.broadcast(rows) if labels.count() <= BROADCAST_LABELS else rows


def logistic(x: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of P(1 | x), from counts of both classes at the values x; lightly regularised Newton steps."""
    w = np.zeros(2)
    a = np.stack([x, np.ones_like(x)], 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (ones - (zeros + ones) * p) - np.array([0.05, 0.01]) * w
        hessian = (a * ((zeros + ones) * p * (1 - p))[:, None]).T @ a + np.diag([0.05, 0.01])
        step = np.linalg.solve(hessian, gradient)
        w += np.clip(step, -2, 2)
    return float(w[0]), float(w[1])
