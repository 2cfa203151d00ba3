"""URL statistics, de-duplication and domain rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casemill.functions import scalars as S


def url_stats(urls: DataFrame) -> DataFrame:
    """A-2: total and distinct domains, over all and by source, in one pass of grouping sets."""
    return urls.rollup("discovered_by").agg(F.count("*").alias("urls"), F.count_distinct("domain").alias("domains"))


def top_domains(urls: DataFrame, n: int) -> DataFrame:
    """A-3: the commonest domains; the total counts the empty one, the items do not."""
    counts = urls.groupBy("domain").agg(F.count("*").alias("urls"))
    total = counts.agg(F.count("*").alias("total_domains"))
    items = counts.where((F.col("domain") != "") & F.col("domain").isNotNull()).orderBy(F.desc("urls"), "domain").limit(n)
    return items.crossJoin(F.broadcast(total)).withColumn("truncated", F.col("total_domains") > n)  # one row beside n


def duplicate_analysis(urls: DataFrame, key: list[str]) -> DataFrame:
    """A-4."""
    groups = urls.groupBy(*key).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("distinct_urls"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def merge_duplicates(urls: DataFrame, key: list[str]) -> DataFrame:
    """A-5: one row for each key: lowest id, widest times, united paths, added occurrences."""
    aggs = [F.min("id").alias("id")]
    aggs += [f(c).alias(c) for c, f in (("first_seen", F.min), ("last_seen", F.max)) if c not in key]
    aggs.append(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("source_path", ","))))), ",").alias("source_path"))
    aggs.append(F.sum(F.coalesce("occurrences", F.lit(1))).alias("occurrences"))
    return urls.groupBy(*key).agg(*aggs)


def kept_ids(urls: DataFrame, key: list[str]) -> DataFrame:
    """A-5: (id, kept): matches and tags of merged rows are re-pointed by this."""
    return urls.join(urls.groupBy(*key).agg(F.min("id").alias("kept")), key).select("id", "kept")


def url_summary(urls: DataFrame) -> DataFrame:
    """A-6."""
    return urls.groupBy("url").agg(F.sum(F.coalesce("occurrences", F.lit(1))).alias("occurrences"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def by_registered_domain(urls: DataFrame) -> DataFrame:
    """A-7."""
    rows = urls.withColumn("site", S.registered_domain(F.col("domain")))
    return rows.groupBy("site").agg(F.count_distinct("url").alias("urls"), F.sum(F.coalesce("occurrences", F.lit(1))).alias("occurrences"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def by_plain_domain(urls: DataFrame) -> DataFrame:
    """A-8: domains without www."""
    return urls.groupBy(S.without_www(F.col("domain")).alias("site")).agg(F.count("*").alias("urls"), F.min("url").alias("lowest"))


def domain_activity(events: DataFrame, at_least: int) -> DataFrame:
    """A-9: events of each domain, by two levels so that a popular domain is added up before it is shuffled."""
    per_url = events.groupBy("domain", "url").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return per_url.groupBy("domain").agg(F.sum("n").alias("events"), F.count("*").alias("urls"), F.min("first").alias("first"), F.max("last").alias("last")).where(F.col("events") >= at_least)


def activity_summary(events: DataFrame) -> DataFrame:
    """A-10."""
    return events.agg(F.count("*").alias("events"), F.count_distinct("domain").alias("domains"), F.count_distinct("url").alias("urls"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def top_urls(urls: DataFrame, n: int) -> DataFrame:
    """W-2: the n commonest URLs of each domain and how many more it has."""
    counts = urls.groupBy("domain", "url").agg(F.count("*").alias("hits"))
    order = Window.partitionBy("domain").orderBy(F.desc("hits"), "url")
    # a rank with a limit keeps n rows of each domain in a task before the shuffle; all of them are counted apart
    top = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
    size = counts.groupBy(F.col("domain").alias("of")).agg(F.greatest(F.count("*") - n, F.lit(0)).alias("hidden"))
    return top.join(size, F.col("domain").eqNullSafe(F.col("of"))).select("domain", "url", "hits", "place", "hidden")
