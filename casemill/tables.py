"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set: executors need a shared folder for intermediate tables")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Folders of this process that workspace() removes.
_FOLDERS: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A name in the shared folder that nobody else has."""
    _FOLDERS.append(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return _FOLDERS[-1]


@contextmanager
def workspace(spark: SparkSession):
    """Intermediate tables made inside are removed at its end. Operators are lazy, so results are to be written inside."""
    first = len(_FOLDERS)
    try:
        yield
    finally:
        for path in _FOLDERS[first:]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        del _FOLDERS[first:]


def table(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table: it cuts lineage and survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
