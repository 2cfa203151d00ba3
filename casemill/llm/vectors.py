"""Vectors as whole numbers: each component c, as double, becomes floor(64 * c)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 64
#: Entries whose size times 64 is beyond this, more than any four-byte number gives, count as not finite.
LIMIT = 2.0**134


def scaled(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that are usable, their lengths, and floor(64 * c) of all their components, one after the other.

    A row is left out if its vector is null or empty or holds a null or non-finite entry (or one beyond LIMIT).
    """
    flat = lists.flatten()
    values = np.floor(flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) * SCALE)
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    bad = np.r_[0, np.cumsum(~(np.abs(values) <= LIMIT))]
    ends = np.cumsum(sizes)
    good = (sizes > 0) & (bad[ends] == bad[ends - sizes])
    return np.flatnonzero(good), sizes[good], values[np.repeat(good, sizes)] + 0.0


def whole_vectors(table: DataFrame) -> DataFrame:
    """vec_id, size, x: usable rows of a vector table, x the components' floor(64 * c) as bytes of doubles (exact)."""

    def run(batches):
        for batch in batches:
            rows, sizes, values = scaled(batch.column(1))
            ends = np.r_[0, np.cumsum(sizes)] * 8
            blobs = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values.astype("<f8"))])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(sizes.astype(np.int32)), blobs], ["vec_id", "size", "x"])

    return table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "vec_id long, size int, x binary")


def common_size(rows: DataFrame) -> int:
    """The length that most vectors have; of equally common ones the longer; 1 where there are none."""
    sizes = rows.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    return sizes[0]["size"] if sizes else 1


def matrix(blobs: pa.Array, size: int) -> np.ndarray:
    """The vectors of a binary column, all of `size` components, as rows."""
    _, offsets, data = blobs.buffers()
    if not len(blobs):
        return np.zeros((0, size))
    ends = np.frombuffer(offsets, np.int32)[blobs.offset : blobs.offset + len(blobs) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view("<f8").reshape(len(blobs), size)


def whole(values: np.ndarray) -> np.ndarray:
    """Whole numbers stored as doubles, as Python integers of any size."""
    out = np.empty(values.shape, object)
    out.ravel()[:] = [int(v) for v in values.ravel()]
    return out


def exact_kind(most: float, size: int) -> str:
    """The numbers in which inner products of vectors of that length with entries up to `most` are exact."""
    largest = most * most * size
    return "float32" if largest < 2**24 else "float64" if largest < 2**53 else "int64" if largest < 2**62 else "object"


def products(left: np.ndarray, right: np.ndarray, kind: str | None = None) -> np.ndarray:
    """Inner products of all rows of whole numbers (as doubles) with one another, without loss: doubles, longs or Python integers."""
    kind = kind or exact_kind(float(max(np.abs(left).max(initial=0), np.abs(right).max(initial=0))), left.shape[1])
    if kind == "object":
        return whole(left) @ whole(right).T
    found = left.astype(kind, copy=False) @ right.astype(kind, copy=False).T
    return found if kind == "int64" else found.astype(np.float64, copy=False)
