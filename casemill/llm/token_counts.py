"""Operator 2: token counts through a digest cache.

A count is stored under (tokenizer digest, content digest). Content is normalised first: the vocabulary's
normaliser is the identity, so that is the text's UTF-8 bytes, null as empty. Documents are joined to the cache by
digest; only the distinct digests that miss are encoded, one text for each, and appended to the cache. Counts go back
to the rows by digest; a digest with very many rows (copies of one text) gets its count by broadcast, see looked_up().

Cases: null and empty texts count 0 tokens. Repeated texts are encoded once; repeated rows, null and tied doc_ids
each keep their row. Extra columns are not read. An empty table gives no rows. A very long text is encoded whole.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.llm.common import looked_up, pieces, staged, texts_of

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """The stored counts; none yet where the folder is new."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache)


def token_counts(docs: DataFrame, model: str, cache: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document; new counts are appended to the folder `cache`."""
    spark, version = docs.sparkSession, tokenizer_digest(model)
    text = F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")
    rows = staged(docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), digest), "digests")
    known = read_cache(spark, cache).where(F.col("tokenizer") == version).select("digest", "n_tokens")

    def encode(batches):
        import sentencepiece

        counter = sentencepiece.SentencePieceProcessor(model_file=model)
        for batch in batches:
            for part in pieces(batch):
                counts = [len(x) for x in counter.encode(texts_of(part), num_threads=1)]
                yield pa.RecordBatch.from_arrays([pa.array([version] * len(counts)), part.column(0), pa.array(counts, pa.int64())], ["tokenizer", "digest", "n_tokens"])

    # copies are reduced in their tasks, before the shuffle
    distinct = docs.select(digest, text.alias("text")).groupBy("digest").agg(F.first("text").alias("text"))
    misses = distinct.join(known, "digest", "left_anti")
    misses.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache)
    counted = read_cache(spark, cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.first("n_tokens").alias("n_tokens"))
    return looked_up(rows, counted, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
