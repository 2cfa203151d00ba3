"""From raw documents to token digests: five stages, each on all that the one before has kept.

Stages tell rows apart by doc_id and content, so null and tied doc_ids neither drop nor save another row; of repeated
rows (equal in all columns) the near-copy stage keeps one. Null texts are empty texts: never toxic or contaminated, near copies
of one another. Empty tables give no rows. Columns beyond those of documents are not read and not kept.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.llm.bpe import bpe_digests
from casemill.llm.common import read_table, removed, shared_dir, workspace
from casemill.llm.decontamination import contamination
from casemill.llm.simhash import near_representatives
from casemill.llm.suffix_dedup import without_repeats
from casemill.llm.toxicity import toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keyed(docs: DataFrame) -> DataFrame:
    """The rows with a key of doc_id and content (128 bits, never null): rows of one key are equal in all columns."""
    sizes = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("doc_id", "n_chars")] + [F.coalesce(F.length(c).cast("string"), F.lit("-")) for c in ("lang", "source", "text")]
    return docs.select(*COLUMNS, F.md5(F.concat_ws(",", *sizes, "lang", "source", "text")).alias("key"))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator predicts to be toxic go."""
    docs = keyed(docs)
    rejected = toxicity(docs, read_table(spark, sf_dir, "labels"), carried=("key",)).where("predicted = 1").select("key").distinct()
    return docs.join(rejected, "key", "left_anti").select(*COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: the smallest doc_id (null after all others), then the smallest key."""
    docs = keyed(docs)
    return docs.join(near_representatives(docs, "key"), "key", "left_semi").dropDuplicates(["key"]).select(*COLUMNS)


def without_long_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by an earlier 100-byte string go; every document stays, n_chars counts what is left."""
    return without_repeats(docs, ("lang", "source")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    docs = keyed(docs)
    hit = contamination(docs, read_table(spark, sf_dir, "benchmark"), ("key",)).where("contaminated").select("key").distinct()
    return docs.join(hit, "key", "left_anti").select(*COLUMNS)


def token_digests(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what is left."""
    return bpe_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("simhash_near_dedup", without_near_copies),
    ("suffix_array_dedup", without_long_repeats),
    ("benchmark_decontamination", without_benchmark),
    ("bpe", token_digests),
]

#: Toxicity scores, fingerprint groups and token ids have no SQL form; tests/llm hold the run against a brute-force one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table. What a stage read and what it made on its way is removed once its result is written."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = read_table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        with workspace(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            removed(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {}
