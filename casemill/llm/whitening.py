"""Operator 12: whitening of embeddings by the exact characteristic polynomial of their scatter.

Components become whole numbers, x = floor(64 * c) + 1000000. Over the n distinct vectors the scatter
M = n * sum(x x') - S S' is a matrix of whole numbers (n * n times the covariance), summed in parts without rounding. Its
characteristic polynomial is found modulo primes in tasks and joined on the driver (width + 1 numbers); roots and
vectors see eigen.py. The driver holds matrices of width x width, nothing that grows with the rows.

Cases: rows whose vector is null or empty, holds a null or non-finite entry (or one beyond
vectors.LIMIT), or has another length than most rows (of equally common lengths the longer counts) are dropped. Repeated rows, tied and
null vec_ids each give their own result rows. Components without variance cannot be whitened and are left out, so one
distinct vector alone, or an empty table, gives no rows. A deviation beyond a long is null. Other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm.common import staged
from casemill.llm.eigen import Matrix, leading, polynomial_modulo, primes_for, remainders_joined
from casemill.llm.vectors import common_size, matrix, products, whole, whole_vectors

SHIFT = 1_000_000
#: Sums of whole numbers of any size travel as this many limbs of 31 bits, the last one with the sign.
LIMBS = 9


def limbs(values: list[int]) -> list[list[int]]:
    """One list for each limb, the least first."""
    return [[v >> 31 * k & (2**31 - 1) if k < LIMBS - 1 else v >> 31 * k for v in values] for k in range(LIMBS)]


def exact_sums(vectors: DataFrame, size: int) -> tuple[int, list[int], Matrix]:
    """Number of rows, sum and sum of outer products of floor(64 * c), exact: partial sums in tasks, then by Spark."""

    def run(batches):
        n, first, second = 0, whole(np.zeros(size)), whole(np.zeros((size, size)))
        for batch in batches:
            x = matrix(batch.column(0), size)
            for k in range(0, len(x), 8192):
                own = np.ascontiguousarray(x[k : k + 8192].T)
                n += own.shape[1]
                first += whole(products(own, np.ones((1, own.shape[1]))))[:, 0]
                second += whole(products(own, own))
        if n:
            values = [n, *first, *second[np.triu_indices(size)]]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), *(pa.array(x, pa.int64()) for x in limbs(values))], ["place", *(f"l{k}" for k in range(LIMBS))])

    schema = "place int, " + ", ".join(f"l{k} long" for k in range(LIMBS))
    sums = vectors.select("x").mapInArrow(run, schema).groupBy("place").agg(*(F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS)))
    values = {r[0]: sum(v << 31 * k for k, v in enumerate(r[1:])) for r in sums.collect()}  # one row for each entry of the matrix
    if not values:
        return 0, [0] * size, [[0] * size for _ in range(size)]
    second = [[0] * size for _ in range(size)]
    for place, (i, j) in enumerate(zip(*(x.tolist() for x in np.triu_indices(size))), size + 1):
        second[i][j] = second[j][i] = values[place]
    return values[0], [values[k] for k in range(1, size + 1)], second


def scatter(n: int, first: list[int], second: Matrix) -> Matrix:
    """n * n times the covariance (divisor n)."""
    return [[n * v - a * b for v, b in zip(row, first)] for row, a in zip(second, first)]


def characteristic(spark, m: Matrix) -> list[int]:
    """Coefficients of det(x I - m), the constant one first; one prime is one row of a Spark job."""
    primes = primes_for(m)

    def run(batches):
        for batch in batches:
            own = batch.column(0).to_pylist()
            found = [polynomial_modulo(np.array([[v % p for v in row] for row in m], np.int64), p).tolist() for p in own]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["p", "residues"])

    tasks = max(1, min(len(primes) // 4, spark.sparkContext.defaultParallelism))
    rows = spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks).mapInArrow(run, "p long, residues array<long>").collect()
    return remainders_joined({r.p: r.residues for r in rows})


class Whitener:
    """What the fit gives: number and sum of distinct vectors, directions over root eigenvalues, shares of the variance."""

    def __init__(self, spark, n: int, first: list[int], second: Matrix, wanted: int):
        m = scatter(n, first, second)
        found = leading(m, characteristic(spark, m), wanted)
        trace = sum(m[k][k] for k in range(len(m)))
        self.n, self.first = n, first
        self.explained = [float(root / trace) for root, _ in found]
        # eigenvalue e of the covariance is root / n**2, and (x - S/n) is (n x - S) / n
        self.directions = np.array([[float(v / root.sqrt()) for v in vector] for root, vector in found]).reshape(len(found), len(m))

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S: long, or Python integers where it does not fit in doubles without loss."""
        most = self.n * float(np.abs(x).max(initial=0)) + max(map(abs, self.first), default=0)
        if most < 2**53:
            return self.n * x - np.array(self.first, float)
        return self.n * whole(x) - np.array(self.first, object)

    def whitened(self, deviations: np.ndarray) -> np.ndarray:
        return deviations.astype(float) @ self.directions.T

    def squares(self, deviations: np.ndarray) -> list[int | None]:
        """Sum of squares of each row, exact; null beyond a long."""
        if deviations.dtype == float:
            most = float(np.abs(deviations).max(initial=0))
            if most * most * deviations.shape[1] < 2**62:
                own = deviations.astype(np.int64)
                return (own * own).sum(axis=1).tolist()
            deviations = whole(deviations)
        return [v if v < 2**63 else None for v in (int(row @ row) for row in deviations)]


def identity_error(vectors: DataFrame, size: int, w: Whitener) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    k = len(w.directions)

    def run(batches):
        for batch in batches:
            x = w.whitened(w.deviations(matrix(batch.column(0), size)))
            values = np.r_[x.sum(axis=0), (x.T @ x).ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(values)], ["place", "value"])

    sums = vectors.select("x").mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).orderBy("place").collect()
    values = np.array([r.value for r in sums]) / w.n
    # rows are centred exactly before they are multiplied, so the mean is rounding only
    covariance = values[k:].reshape(k, k) - np.outer(values[:k], values[:k])
    return float(np.abs(covariance - np.eye(k)).max())


@dataclass(frozen=True)
class Fit:
    """A whitening fitted on the distinct vectors of a table: the length of its vectors, its directions, its error."""

    size: int
    whitener: Whitener
    error: float

    @property
    def components(self) -> int:
        return len(self.whitener.directions)


def fit(table: DataFrame, components: int = 16) -> Fit:
    """The whitening of a vector table (vec_id, embedding) by up to so many components with the largest variance."""
    rows = whole_vectors(table)
    size = common_size(rows)
    distinct = staged(rows.where(F.col("size") == size).select("x").distinct(), "distinct-vectors")
    w = Whitener(table.sparkSession, *exact_sums(distinct, size), components)
    error = identity_error(distinct, size, w) if len(w.directions) else 0.0
    if math.isnan(error):
        raise ArithmeticError("whitened values are not finite")
    return Fit(size, w, error)


def whitened_vectors(table: DataFrame, fitted: Fit) -> DataFrame:
    """vec_id, whitened (array): every usable row of a table, which need not be the one that was fitted, as whitened vector."""
    w, size = fitted.whitener, fitted.size

    def run(batches):
        for batch in batches:
            x = w.whitened(w.deviations(matrix(batch.column(1), size)))
            ends = pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], ["vec_id", "whitened"])

    return whole_vectors(table).where(F.col("size") == size).select("vec_id", "x").mapInArrow(run, "vec_id long, whitened array<double>")


def whitening(table: DataFrame, components: int = 16) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable row and component."""
    fitted = fit(table, components)
    w, size, k, error = fitted.whitener, fitted.size, fitted.components, fitted.error
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not k:
        return table.sparkSession.createDataFrame([], schema)
    rows = whole_vectors(table).where(F.col("size") == size)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                deviations = w.deviations(matrix(part.column(1), size))
                own = pa.array(np.repeat(np.arange(part.num_rows), k))
                n = len(own)
                columns = [
                    part.column(0).take(own),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), part.num_rows)),
                    pa.array(np.full(n, w.n)),
                    pa.array(w.squares(deviations), pa.int64()).take(own),
                    pa.array(w.whitened(deviations).ravel()),
                    pa.array(np.tile(w.explained, part.num_rows)),
                    pa.array(np.full(n, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "x").mapInArrow(run, schema)
