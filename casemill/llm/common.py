"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is configured, a temporary one in local mode (tests), else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir is not set: executors need a shared folder for intermediate tables")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Intermediate tables of this process that nobody has removed yet: (folder, name in the catalog or None).
_TABLES: list[tuple[str, str | None]] = []


def made(path: str, table: str | None = None) -> str:
    """Note a folder as an intermediate table that workspace() removes."""
    _TABLES.append((path, table))
    return path


def removed(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def workspace(spark: SparkSession):
    """Intermediate tables made inside are removed at its end, so results that read them are to be written inside."""
    first = len(_TABLES)
    try:
        yield
    finally:
        for path, table in _TABLES[first:]:
            if table:
                spark.sql(f"drop table if exists {table}")
            removed(spark, path)
        del _TABLES[first:]


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: it cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = made(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def looked_up(rows: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """Inner join of rows to a lookup with one row for each key, safe where one key has very many rows.

    Both are read twice, so they should be tables. Keys with more than a quarter of a task's fair share of rows, at
    most four for each shuffle partition by that rule, are broadcast; only the rest is shuffled by key.
    """
    tasks = partitions(rows.sparkSession)
    counts = rows.groupBy(key).count()
    often = staged(counts.where(F.col("count") > max(1, rows.count() // (4 * tasks))).join(lookup, key).drop("count"), "often")
    calm = rows.join(F.broadcast(often.select(key)), key, "left_anti").join(lookup, key)
    return calm.unionByName(rows.join(F.broadcast(often), key))


def ordered_key(column: str, descending: bool = False):
    """A string that sorts like the long column: ascending with null first, or descending with null last."""
    flipped = F.col(column).bitwiseXOR(F.lit(2**63 - 1 if descending else -(2**63)))
    digits = F.lpad(F.hex(flipped), 16, "0")
    return F.when(F.col(column).isNull(), F.lit("1" if descending else "0")).otherwise(F.concat(F.lit("0" if descending else "1"), digits))


def cut_points(rows: DataFrame, size: int, tasks: int | None = None) -> list[str]:
    """The first keys of ranges of rows (key string, bytes long) in key order, of about `size` bytes; equal keys share a range.

    Rows are dealt out by Spark's sampled ranges and measured there, so what reaches the driver is one key for
    each range, whatever the number of rows.
    """

    def run(batches):
        total, before = None, None
        for batch in batches:
            cuts = []
            for key, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if total is None or total >= size and key != before:
                    cuts.append(key)
                    total = 0
                total, before = total + n, key
            if cuts:
                yield pa.RecordBatch.from_arrays([pa.array(cuts, pa.string())], ["key"])

    dealt = rows.select("key", "bytes").repartitionByRange(tasks or partitions(rows.sparkSession), "key").sortWithinPartitions("key")
    return sorted(r["key"] for r in dealt.mapInArrow(run, "key string").collect())


def range_number(key, cuts: list[str]):
    """The number of the range (0 to len(cuts) - 1) that a key is in, by binary search."""
    if len(cuts) < 2:
        return F.lit(0)
    table = F.split(F.lit(",".join(cuts[1:])), ",")
    steps = [1 << k for k in range((len(cuts) - 1).bit_length() - 1, -1, -1)]

    def step(at, width):
        # at: cuts that are known to be no larger than the key
        after = at + width
        return F.when((after <= len(cuts) - 1) & (F.get(table, after - 1) <= key), after).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The strings of a batch, null as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


SPACE = re.compile(rb"[ \t-\r]")


def word_slices(text: str, size: int = 1 << 18):
    """The words of a text, A-Z lower-cased, as lists of bytes: slices of about `size` bytes cut at white space."""
    raw = text.encode()
    at = 0
    while at < len(raw):
        space = SPACE.search(raw, at + size)
        end = space.start() if space else len(raw)
        yield raw[at:end].lower().split()
        at = end


def flat_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string array as one uint8 array, with n + 1 offsets; null as empty."""
    array = array.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = array.buffers()
    offs = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    if data is None or len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = 4_000_000):
    """Slices of a batch with about `limit` bytes of text each (one row at least)."""
    lengths = _lengths(batch, column)
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield batch.slice(start)


def _lengths(batch: pa.RecordBatch, column: str) -> np.ndarray:
    _, offs = flat_bytes(batch.column(batch.schema.get_field_index(column)))
    return np.diff(offs)


def doc_bucket(column: str, parts: int):
    """crc32 of the id's decimal text, modulo parts: the held-out rule of the labelled operators."""
    return F.crc32(F.col(column).cast("string")) % parts
