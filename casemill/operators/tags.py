"""Tag algebra over associations (tag, artifact_type, artifact_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tag_text(associations: DataFrame, kind: str) -> DataFrame:
    """J-1: the tags of each artifact as sorted text."""
    own = associations.where(F.col("artifact_type") == kind)
    return own.groupBy(F.col("artifact_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("tag")), ", ").alias("tags"))


def with_all(associations: DataFrame, kind: str, tags: list[str]) -> DataFrame:
    """J-23: artifacts that have every one of the tags."""
    own = associations.where((F.col("artifact_type") == kind) & F.col("tag").isin(*tags))
    return own.groupBy(F.col("artifact_id").alias("id")).agg(F.count_distinct("tag").alias("n")).where(F.col("n") == len(set(tags))).select("id")


def with_any(associations: DataFrame, kind: str, tags: list[str] | None = None) -> DataFrame:
    """J-23, J-24: artifacts that have one of the tags, or any tag."""
    own = associations.where(F.col("artifact_type") == kind)
    own = own.where(F.col("tag").isin(*tags)) if tags else own
    return own.select(F.col("artifact_id").alias("id")).distinct()


def by_type(associations: DataFrame, tag: str) -> DataFrame:
    """J-24: number and range of the artifacts of a tag, by type."""
    return associations.where(F.col("tag") == tag).groupBy("artifact_type").agg(F.count_distinct("artifact_id").alias("n"), F.min("artifact_id").alias("lowest"), F.max("artifact_id").alias("highest"))


def merge_tags(associations: DataFrame, sources: list[str], target: str) -> DataFrame:
    """J-25: associations of the source tags go to the target, once each."""
    return associations.withColumn("tag", F.when(F.col("tag").isin(*sources), target).otherwise(F.col("tag"))).dropDuplicates(["tag", "artifact_type", "artifact_id"])


def usage(associations: DataFrame) -> DataFrame:
    """A-42: tags with the number of their associations."""
    return associations.groupBy("tag").agg(F.count("*").alias("n"))


def inherited(associations: DataFrame, links: DataFrame, source: str, target: str) -> DataFrame:
    """J-26: tags of the linked (source_id) artifact pass to the other (id), beside its own."""
    passed = links.join(associations.where(F.col("artifact_type") == source), F.col("source_id") == F.col("artifact_id")).select("tag", F.lit(target).alias("artifact_type"), F.col("id").alias("artifact_id"))
    return associations.where(F.col("artifact_type") == target).select("tag", "artifact_type", "artifact_id").union(passed).distinct()


def difference(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """U-4: (id, tag, change): what to add and what to remove."""
    return wanted.exceptAll(present).withColumn("change", F.lit("add")).union(present.exceptAll(wanted).withColumn("change", F.lit("remove")))
