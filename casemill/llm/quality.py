"""Operator 4: quality by regularised quadratic discriminant analysis of document statistics.

Every document becomes a short vector of transformed statistics of its whole text. Class means and covariances come
from sums over all learnable rows, added up in Spark. Each covariance is shrunk towards the pooled one and that
towards its diagonal; the score is the logistic of the difference of the two log densities, from Mahalanobis distances
by cached Cholesky factors, plus the log prior odds.

Cases: null and empty texts have the statistics of no text and get a score. Without usable labels of both classes every
score is 0.5. A null doc_id has no label, is not held out and is scored like any other; repeated rows and tied doc_ids each give a row. Extra columns are not read; labels of unknown documents are ignored,
of several labels of one document the larger counts. Very long texts are measured whole.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm.common import pieces, staged, texts_of
from casemill.llm.labelled import crc_of_id, learnable

CLASS_SHRINKAGE = 0.1
DIAGONAL_SHRINKAGE = 0.05

#: Kind of each byte: 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 sentence mark, 7 bracket or quote, 8 symbol, 9 beyond ASCII.
KIND = np.zeros(256, np.uint8)
KIND[97:123], KIND[65:91], KIND[48:58], KIND[[9, 11, 12, 13, 32]], KIND[10] = 1, 2, 3, 4, 5
KIND[list(b".,;:?!")], KIND[list(b"()[]{}\"'-/")], KIND[list(b"#$%&*+<=>@\\^_`|~")], KIND[128:] = 6, 7, 8, 9
NAMES = ("bytes", "words", "word_length", "upper", "digits", "lines", "marks", "brackets", "symbols", "beyond", "distinct", "again", "odd_ends", "compressed", "line_copies", "capitals", "bars")


def logit(a: float, b: float) -> float:
    """Smoothed log odds of a of b."""
    return float(np.log((a + 0.5) / (max(b - a, 0) + 0.5)))


def statistics(text: str) -> list[float]:
    raw = text.encode()
    n = np.bincount(KIND[np.frombuffer(raw, np.uint8)], minlength=10).tolist()
    words, lines = text.split(), text.split("\n")
    w, size = len(words), len(raw)
    distinct = len(set(words))
    again = sum(a == b for a, b in zip(words, words[1:]))
    odd = sum(not x[-1].isalnum() and x[-1] not in ".,;:?!" or x.endswith("!!") for x in words)
    capitals = sum(x[0].isupper() for x in words)
    letters = n[1] + n[2] + n[9]
    packed = len(zlib.compress(raw, 1))
    return [
        np.log1p(size), np.log1p(w), np.log((letters + 1) / (w + 1)), logit(n[2], n[1] + n[2]), logit(n[3], size), logit(n[5], w), logit(n[6], size), logit(n[7], size), logit(n[8], size), logit(n[9], size),
        float(np.log((distinct + 1) / (w + 1)) + 0.15 * np.log1p(w)), logit(again, w), logit(odd, w), float(np.log((packed + 20) / (size + 20))), logit(len(lines) - len(set(lines)), len(lines)), logit(capitals, w), logit(text.count("|"), w),
    ]


def statistics_table(docs: DataFrame) -> DataFrame:
    """doc_id, x: the statistics of every document."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([statistics(t) for t in texts_of(part)], pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<double>")


def forward(factor: np.ndarray, b: np.ndarray) -> np.ndarray:
    """z with factor @ z = b for a lower triangular factor, by substitution."""
    z = np.empty_like(b)
    for i in range(len(factor)):
        z[i] = (b[i] - factor[i, :i] @ z[:i]) / factor[i, i]
    return z


class Discriminant:
    """Means, Cholesky factors and log prior odds of the two classes."""

    def __init__(self, counts: np.ndarray, sums: np.ndarray, squares: np.ndarray):
        means = sums / counts[:, None]
        scatter = squares - counts[:, None, None] * means[:, :, None] * means[:, None, :]
        pooled = scatter.sum(0) / counts.sum()
        self.odds, self.means, self.factors = float(np.log(counts[1] / counts[0])), means, []
        for k in (0, 1):
            weight = counts[k] / (counts[k] + 5 * len(pooled))
            cov = (1 - CLASS_SHRINKAGE) * weight * scatter[k] / counts[k] + (1 - (1 - CLASS_SHRINKAGE) * weight) * pooled
            cov = (1 - DIAGONAL_SHRINKAGE) * cov + DIAGONAL_SHRINKAGE * np.diag(np.diag(cov)) + 1e-4 * np.eye(len(cov))
            self.factors.append(np.linalg.cholesky(cov))

    def score(self, x: np.ndarray) -> np.ndarray:
        """P(class 1) of the rows of x."""
        logs = []
        for mean, factor in zip(self.means, self.factors):
            z = forward(factor, (x - mean).T)
            logs.append(-0.5 * (z * z).sum(0) - np.log(np.diag(factor)).sum())
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0] + self.odds, -30, 30)))


def fit(vectors: DataFrame) -> Discriminant | None:
    """The model from rows (x, y): each task sends sums of fixed size, added up before they reach the driver."""
    d = len(NAMES)

    def run(batches):
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x, y = np.array(batch.column(0).to_pylist()).reshape(-1, d), batch.column(1).to_numpy()
            for k in (0, 1):
                own = x[y == k]
                total[k] += np.r_[len(own), own.sum(0), (own.T @ own).ravel()]
        cells = np.arange(total.size)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total.ravel())], ["cell", "v"])

    sums = vectors.select("x", "y").mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).orderBy("cell").collect()
    total = np.array([r["v"] for r in sums]).reshape(2, -1) if sums else np.zeros((2, 1 + d + d * d))
    if (total[:, 0] < 2).any():
        return None
    return Discriminant(total[:, 0], total[:, 1 : d + 1], total[:, d + 1 :].reshape(2, d, d))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    held_out = F.coalesce(crc_of_id() % 5 == 0, F.lit(False))
    vectors = staged(statistics_table(docs), "document-statistics")
    model = fit(vectors.join(learnable(labels, "quality", ~held_out), "doc_id"))

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            scores = model.score(np.array(batch.column(1).to_pylist()).reshape(n, -1)) if model and n else np.full(n, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    scored = vectors.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
