"""Operator 13: exact top-k inner products by norm-bucketed retrieval.

Vectors (components floor(64 * c)) are dealt out by falling length into buckets. Each query first meets the bucket of the longest
vectors, whose k-th score is a bound that its results cannot fall below. Queries go in blocks, sorted by the length that
a partner needs for that bound; a block meets only the groups of buckets that reach it (its cells). In a cell, buckets
come longest first and the bound rises. From the bound follows each query's local cosine threshold in a bucket:

- beyond 1: the bucket is skipped;
- if it is so high that few vectors lie in the feasible range of the query's largest coordinate (coordinate pruning): the
  range is read from the sorted coordinate, cut by the next largest coordinate, and the rest is verified;
- else the bucket's vectors down to the length needed are verified (length pruning), many queries at once.

Scores are computed in numbers that hold them without loss. Each query has at most k rows from each cell; Spark ranks them.

Cases: vectors that are null, empty, hold a null or non-finite entry (or one beyond vectors.LIMIT) or have another
length than most rows (of equally common lengths the longer counts) take no part. Rows of a query's own vec_id are its own; each of
tied query rows has its own result. A null vec_id is no query; as a candidate it comes last among ties. Repeated candidates count
each. A score beyond a long is null, but ranked by its value. An empty table, or one without queries, gives no rows. Other columns
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casemill.llm.common import partitions, staged
from casemill.llm.vectors import common_size, exact_kind, matrix, products, whole, whole_vectors

#: Vectors of a bucket, queries compared with it at once, and queries of a block.
BUCKET, TOGETHER, BLOCK = 1024, 1024, 65536
#: A null id in arrays: after all others.
NO_ID = 2**63 - 1
#: Below every score, where scores are not doubles.
LEAST = {"int64": -(2**63), "object": -(2**400)}
SLACK = 1e-9
VECTORS = "vec_id long, x binary, norm double, most double"
#: Coordinate pruning is chosen below this share of a bucket's pairs.
FEW = 1 / 16


class Bucket:
    """Vectors in order of falling length."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.norms = np.linalg.norm(x, axis=1)
        self.high = float(self.norms.max(initial=0))
        self._unit = self._orders = None

    def unit(self) -> np.ndarray:
        if self._unit is None:
            self._unit, self._orders = self.x / np.where(self.norms > 0, self.norms, 1)[:, None], {}
        return self._unit

    def sorted_by(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """The order of the unit vectors by coordinate f, and the coordinate in that order."""
        unit = self.unit()
        if f not in self._orders:
            order = np.argsort(unit[:, f], kind="stable")
            self._orders[f] = order, unit[order, f]
        return self._orders[f]


class Queries:
    """Queries with their best k so far; bounds start at what the first bucket gave."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, bounds: np.ndarray, k: int, kind: str):
        self.ids, self.x, self.k, self.kind = ids, x, k, kind
        self.norms = np.linalg.norm(x, axis=1)
        self.unit = x / np.where(self.norms > 0, self.norms, 1)[:, None]
        self.focus = np.argsort(-np.abs(self.unit), axis=1, kind="stable")[:, :2]
        self.dtype = {"int64": np.int64, "object": object}.get(kind, np.float64)
        #: Below every score.
        self.least = LEAST.get(kind, -np.inf)
        self.scores = np.full((len(ids), k), self.least, self.dtype)
        self.found = np.full((len(ids), k), NO_ID, np.int64)
        self.bounds = bounds.astype(self.dtype)  # the least score that may still enter

    def meet(self, bucket: Bucket) -> None:
        floors = self.bounds.astype(float)
        live = np.flatnonzero(floors <= self.norms * bucket.high * (1 + SLACK) + SLACK)
        for at in range(0, len(live), TOGETHER):
            rows = live[at : at + TOGETHER]
            rest = self._by_coordinate(bucket, rows, floors[rows])
            if len(rest):
                self._by_length(bucket, rest, floors[rest])

    def _by_coordinate(self, bucket: Bucket, rows: np.ndarray, floors: np.ndarray) -> np.ndarray:
        """Answer the rows whose feasible range is short; the others are returned."""
        cosine = np.where(floors > 0, floors / np.maximum(self.norms[rows] * bucket.high, 1e-300), 0) - SLACK
        chosen = np.flatnonzero(cosine > 0)
        if not len(chosen):
            return rows
        near, t = rows[chosen], np.minimum(cosine[chosen], 1)
        ranges = []
        for j in range(self.focus.shape[1]):
            own = self.unit[near, self.focus[near, j]]
            spread = np.sqrt(np.maximum(1 - own * own, 0) * (1 - t * t)) + SLACK
            # where the coordinate's own axis is nearer than t, the range is open on that side
            ranges.append((np.where(own <= -t, -2, own * t - spread), np.where(own >= t, 2, own * t + spread)))
        first, last = np.zeros(len(near), np.int64), np.zeros(len(near), np.int64)
        coordinates = self.focus[near, 0]
        for f in np.unique(coordinates):
            own = np.flatnonzero(coordinates == f)
            _, values = bucket.sorted_by(int(f))
            first[own] = np.searchsorted(values, ranges[0][0][own], "left")
            last[own] = np.searchsorted(values, ranges[0][1][own], "right")
        short = np.flatnonzero(last - first <= FEW * len(bucket.ids))
        if len(short):
            sizes = (last - first)[short]
            pair = np.repeat(short, sizes)
            place = np.arange(len(pair)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[pair]
            partner = np.zeros(len(pair), np.int64)
            for f in np.unique(coordinates[short]):
                own = coordinates[pair] == f
                partner[own] = bucket.sorted_by(int(f))[0][place[own]]
            if self.focus.shape[1] > 1:
                other = bucket.unit()[partner, self.focus[near[pair], 1]]
                keep = (other >= ranges[1][0][pair]) & (other <= ranges[1][1][pair])
                pair, partner = pair[keep], partner[keep]
            if self.kind == "object":
                scores = (whole(self.x[near[pair]]) * whole(bucket.x[partner])).sum(axis=1) if len(pair) else np.zeros(0, object)
            else:
                numbers = np.int64 if self.kind == "int64" else np.float64
                scores = np.einsum("ij,ij->i", self.x[near[pair]].astype(numbers), bucket.x[partner].astype(numbers))
            self._enter(near[pair], bucket.ids[partner], scores)
        return np.delete(rows, chosen[short])

    def _by_length(self, bucket: Bucket, rows: np.ndarray, floors: np.ndarray) -> None:
        needed = np.where(floors > 0, floors / np.maximum(self.norms[rows], 1e-300), 0) * (1 - SLACK)
        n = int(np.searchsorted(-bucket.norms, -needed.min(), "right"))
        if not n:
            return
        scores = products(self.x[rows], bucket.x[:n], self.kind)
        own = self.ids[rows][:, None] == bucket.ids[None, :n]
        scores[own] = self.least
        bounds = self.bounds[rows]
        if n >= self.k and (bounds == self.least).any():
            bounds = np.maximum(bounds, np.partition(scores, n - self.k, axis=1)[:, n - self.k])
        enter = (scores > bounds[:, None]) | (scores == bounds[:, None]) & (bucket.ids[None, :n] <= self.found[rows, -1][:, None])
        enter &= ~own
        i, j = np.nonzero(enter)
        self._enter(rows[i], bucket.ids[j], scores[i, j])

    def _enter(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Take scores of partners in; the best k of each row stay, of equal scores the smallest ids."""
        own = self.ids[rows] == ids
        if own.any():
            rows, ids, scores = rows[~own], ids[~own], scores[~own]
        if not len(rows):
            return
        touched = np.unique(rows)
        old = np.repeat(touched, self.k)
        rows, ids, scores = np.r_[old, rows], np.r_[self.found[touched].ravel(), ids], np.r_[self.scores[touched].ravel(), scores]
        rank = np.unique(scores, return_inverse=True)[1] if self.kind == "object" else scores
        empty = scores == self.least
        order = np.lexsort((ids, empty, -rank, rows))
        rows, ids, scores = rows[order], ids[order], scores[order]
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        best = (starts[:, None] + np.arange(self.k)).ravel()
        self.scores[touched] = scores[best].reshape(-1, self.k)
        self.found[touched] = ids[best].reshape(-1, self.k)
        full = self.scores[touched, -1]
        self.bounds[touched] = np.maximum(self.bounds[touched], full)


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False)


def buckets_of(vectors: DataFrame, size: int) -> DataFrame:
    """place, part, high, ids, x: buckets in order of falling length (place); null ids are NO_ID."""

    def run(batches):
        part, serial = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, BUCKET):
                own = batch.slice(at, BUCKET)
                values = [(part << 33) + serial, part, own.column(1)[0].as_py()]
                serial += 1
                blob = matrix(own.column(2), size).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in values] + [pa.array([_ids(own.column(0))], pa.list_(pa.int64())), pa.array([blob], pa.binary())], ["place", "part", "high", "ids", "x"])

    order = [F.desc("norm"), F.asc_nulls_last("vec_id")]
    dealt = vectors.repartitionByRange(partitions(vectors.sparkSession), *order).sortWithinPartitions(*order)
    return dealt.select("vec_id", "norm", "x").mapInArrow(run, "place long, part long, high double, ids array<long>, x binary")


def bounded(queries: DataFrame, size: int, first: Bucket, k: int, kind: str) -> DataFrame:
    """query_id, x, bound (k-th score in the first bucket, null where it has fewer), reach (the length a partner needs for it)."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                own = Queries(_ids(part.column(0)), matrix(part.column(1), size), np.full(part.num_rows, LEAST.get(kind, -np.inf)), k, kind)
                own.meet(first)
                bounds = own.scores[:, -1]
                known = bounds != own.least
                # as a double, and a little less: the bound is for pruning, whatever enters is compared exactly
                values = np.array([float(v) if ok else -np.inf for v, ok in zip(bounds, known)])
                reach = np.where(known & (values > 0), values / np.maximum(own.norms, 1e-300), 0) * (1 - SLACK)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(values), pa.array(reach)], ["query_id", "x", "bound", "reach"])

    return queries.select("vec_id", "x").mapInArrow(run, "query_id long, x binary, bound double, reach double")


def blocks_of(queries: DataFrame, size: int, blocks: int) -> DataFrame:
    """block, place, reach (the least in it), ids, bounds, x: up to BUCKET queries a row."""

    def run(batches):
        block, serial = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, BUCKET):
                own = batch.slice(at, BUCKET)
                values = [block, (block << 33) + serial, min(own.column(3).to_pylist())]
                serial += BUCKET
                lists = [pa.array([own.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([own.column(2).to_pylist()], pa.list_(pa.float64())), pa.array([matrix(own.column(1), size).tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in values] + lists, ["block", "place", "reach", "ids", "bounds", "x"])

    dealt = queries.repartitionByRange(blocks, F.desc("reach"), "query_id").select("query_id", "x", "bound", "reach")
    return dealt.mapInArrow(run, "block long, place long, reach double, ids array<long>, bounds array<double>, x binary")


def top_products(table: DataFrame, k: int = 20, every: int = 20, block: int = BLOCK, asking: DataFrame | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each vec_id divisible by `every` its k largest inner products with other rows.

    asking: queries of a table of their own (vec_id, embedding) instead, each with all rows of another vec_id; a
    null vec_id is no query there either, and vectors of another length than the candidates' take no part.
    """
    spark = table.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    rows = whole_vectors(table)
    size = common_size(rows)

    def measured(batches):
        for batch in batches:
            x = matrix(batch.column(1), size)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.linalg.norm(x, axis=1)), pa.array(np.abs(x).max(axis=1))], ["vec_id", "x", "norm", "most"])

    vectors = staged(rows.where(F.col("size") == size).select("vec_id", "x").mapInArrow(measured, VECTORS), "vectors")
    if asking is None:
        asked = vectors.where(F.col("vec_id") % every == 0)
    else:
        asked = staged(whole_vectors(asking).where((F.col("size") == size) & F.col("vec_id").isNotNull()).select("vec_id", "x").mapInArrow(measured, VECTORS), "asking")
    most, n = vectors.agg(F.max("most"), F.count("*")).first()
    most_asked, n_queries = asked.agg(F.max("most"), F.count("*")).first()
    if not n or not n_queries:
        return spark.createDataFrame([], schema)
    kind = exact_kind(max(most, most_asked), size)
    buckets = staged(buckets_of(vectors, size), "buckets")
    top = buckets.orderBy("place").limit(1).first()
    first = Bucket(np.array(top["ids"], np.int64), np.frombuffer(top["x"], "<f8").reshape(-1, size))
    blocks = -(-n_queries // block)
    queries = staged(blocks_of(bounded(asked, size, first, k, kind), size, blocks), "query-blocks")

    # cells: which groups of buckets, contiguous in length, a block of queries meets; a row for each block, group and cell
    tasks = partitions(spark)
    groups = min(tasks, -(-4 * tasks // blocks))
    parts = {r["part"]: r["high"] for r in buckets.groupBy("part").agg(F.max("high").alias("high")).collect()}
    group_of = {part: at * groups // len(parts) for at, part in enumerate(sorted(parts))}
    highs: dict[int, float] = {}
    for part, high in parts.items():
        highs[group_of[part]] = max(high, highs.get(group_of[part], 0))
    needs = {r["block"]: r["reach"] for r in queries.groupBy("block").agg(F.min("reach").alias("reach")).collect()}
    cells = [(b, g) for b, reach in sorted(needs.items()) for g, high in sorted(highs.items()) if high >= reach * (1 - SLACK)]
    met = spark.createDataFrame(cells, "block long, of long")
    members = spark.createDataFrame(list(group_of.items()), "part long, of long")
    ask = queries.join(F.broadcast(met), "block").select("block", "of", F.lit(0).alias("kind"), "place", "ids", "bounds", "x")
    answer = buckets.join(F.broadcast(members), "part").join(F.broadcast(met), "of").select("block", "of", F.lit(1).alias("kind"), "place", "ids", F.lit(None).cast("array<double>").alias("bounds"), "x")

    def run(batches):
        cell, waiting, places, now = None, [], [], None

        def result():
            i, j = np.nonzero(now.scores != now.least)
            ids, scores = now.found[i, j], now.scores[i, j]
            columns = [
                pa.array(np.concatenate(places)[i]),
                pa.array(now.ids[i]),
                pa.array(ids, mask=ids == NO_ID),
                pa.array([int(v) if -(2**63) <= v < 2**63 else None for v in scores], pa.int64()) if kind == "object" else pa.array(scores.astype(np.int64)),
                pa.array([_sortable(int(v)) for v in scores], pa.string()) if kind == "object" else pa.nulls(len(i), pa.string()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["query", "query_id", "vec_id", "score", "size"])

        for batch in batches:
            for r in range(batch.num_rows):
                key = batch.column(0)[r].as_py(), batch.column(1)[r].as_py()
                if key != cell:
                    if now is not None:
                        yield result()
                    cell, waiting, places, now = key, [], [], None
                ids = batch.column(4)[r].values.to_numpy()
                x = np.frombuffer(batch.column(6)[r].as_buffer(), "<f8").reshape(-1, size)
                if batch.column(2)[r].as_py() == 0:
                    waiting.append((ids, x, batch.column(5)[r].values.to_numpy()))
                    places.append(batch.column(3)[r].as_py() + np.arange(len(ids)))
                    continue
                if now is None:
                    ids_, x_, bounds = (np.concatenate(v) for v in zip(*waiting))
                    now, waiting = Queries(ids_, x_, _at_most(bounds, kind), k, kind), []
                now.meet(Bucket(ids, x))
        if now is not None:
            yield result()

    both = ask.union(answer).repartition("block", "of").sortWithinPartitions("block", "of", "kind", "place")
    found = both.mapInArrow(run, "query long, query_id long, vec_id long, score long, size string")
    order = Window.partitionBy("query").orderBy(F.desc("size"), F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _at_most(bounds: np.ndarray, kind: str) -> np.ndarray:
    """Bounds as scores of that kind, no larger than the doubles say."""
    if kind in ("float32", "float64"):
        return bounds
    out = np.array([LEAST[kind] if b == -np.inf else int(b) - abs(int(b)) // 2**40 - 1 for b in bounds], object)
    return out.astype(np.int64) if kind == "int64" else out


def _sortable(value: int) -> str:
    """A text that sorts like the number (of less than 400 bits)."""
    return f"{value + 2**400:0121d}"


#: DuckDB SQL of the query.
ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(64 * c::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""
