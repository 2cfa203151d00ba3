"""Incremental forms: matching arriving URLs, idempotent run sinks, daily counts under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.operators.matching import match_hashes, match_patterns
from casemill.sources.readers import replace_partition


def matched_feed(urls: DataFrame, rules: list[tuple[str, int, str, str]]) -> DataFrame:
    """R-1: matches of a stream of (id, url)."""
    return match_patterns(urls, "url", rules)


def run_sink(feed: DataFrame, path: str, checkpoint: str, by: list[str]):
    """R-2: a micro-batch overwrites its own part (column batch_id) of the runs it has rows for.

    A repeated batch changes nothing, and a run that spans several batches keeps the rows of all. To ingest a run anew,
    empty its partitions first (replace_partition with keys) or use another path.
    """
    return feed.writeStream.foreachBatch(lambda batch, n: replace_partition(batch.withColumn("batch_id", F.lit(n)), path, [*by, "batch_id"])).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_feed(events: DataFrame, late: str = "2 days") -> DataFrame:
    """R-3: counts by day and kind; events later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "kind").agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "kind", "n")


def once(feed: DataFrame, key: list[str], time: str, late: str) -> DataFrame:
    """R-2: rows that are delivered again within the watermark's delay are left out; a key is held no longer than that."""
    return feed.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def daily_sink(events: DataFrame, path: str, checkpoint: str, late: str = "2 days", key: list[str] | None = None):
    """R-3: (day, kind, n) of days that the watermark has closed, appended to files; open days stay in the state until then.

    A row that comes after its day was closed is left out (by the watermark that the batch before it began with); so is, where a key is given, a row that was delivered before.
    The state holds the open days only (and the keys of the delay), however long the stream runs.
    """
    rows = once(events, key, "ts", late) if key else events.withWatermark("ts", late)
    counts = rows.groupBy(F.window("ts", "1 day").alias("w"), "kind").agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "kind", "n")
    return counts.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hash_feed(files: DataFrame, entries, path: str, checkpoint: str, columns: tuple[str, ...] = ("md5", "sha1", "sha256")):
    """R-1: matches of arriving files (id and hash columns) against a list that may grow between batches, in `path`/matches.

    entries(): the list as it is now, (list_name, hash, version), versions growing with every import. A batch matches its
    own files with the whole list, and the files of earlier batches with what the list has got since; so each match comes
    once. Files and the list's version of each batch are kept beside the matches (files, versions), and a batch that is
    run again reads the version that it had and overwrites its own part.
    """

    def part(df: DataFrame, name: str, n: int) -> None:
        replace_partition(df.withColumn("batch_id", F.lit(n).cast("long")), f"{path}/{name}", ["batch_id"], [(n,)])

    def before(spark, name: str, schema: str, n: int) -> DataFrame:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            return spark.createDataFrame([], f"{schema}, batch_id long")
        return spark.read.schema(f"{schema}, batch_id long").parquet(f"{path}/{name}").where(F.col("batch_id") <= n)

    def run(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        known, versions = entries(), before(spark, "versions", "version long", n).orderBy(F.desc("batch_id")).limit(2).collect()
        if versions and versions[0]["batch_id"] == n:
            now, last = versions[0]["version"], versions[1]["version"] if len(versions) > 1 else None
        else:
            now, last = known.agg(F.max("version")).first()[0], versions[0]["version"] if versions else None
            part(spark.createDataFrame([(now,)], "version long"), "versions", n)
        arrived = batch.select(F.col("id").cast("long").alias("id"), *columns)
        part(arrived, "files", n)
        listed = known.where(F.col("version") <= now)
        found = match_hashes(arrived, listed, columns)
        earlier = before(spark, "files", "id long, " + ", ".join(f"{c} string" for c in columns), n - 1)
        # what an older file matches now but did not at the last version
        grown = match_hashes(earlier, listed.where(F.col("version") > (last if last is not None else -(2**63))), columns)
        grown = grown.join(match_hashes(earlier, listed.where(F.col("version") <= last), columns).select("id", "list_name"), ["id", "list_name"], "left_anti") if last is not None else grown.limit(0)
        part(found.select("id", "list_name", "hash").union(grown.select("id", "list_name", "hash")), "matches", n)

    return files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
