"""A-5: merging duplicate URLs with all that hangs on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tag_list(text: Column) -> Column:
    """The tags of a text: the members of a JSON list, a JSON string, or the text itself if it is no JSON."""
    value = F.try_parse_json(text)
    kind = F.schema_of_variant(value)
    return (
        F.when(text.isNull() | (text == ""), F.array().cast("array<string>"))
        .when(value.isNull(), F.array(text))
        .when(kind.startswith("ARRAY"), F.filter(F.try_variant_get(value, "$", "array<string>"), lambda x: x.isNotNull()))
        .when(kind == "STRING", F.array(F.try_variant_get(value, "$", "string")))
        .otherwise(F.array().cast("array<string>"))
    )


def _united(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))


@dataclass(frozen=True)
class Merge:
    """What a merge gives: URLs, re-pointed matches and tag associations, the four counts (one row)."""

    urls: DataFrame
    matches: DataFrame
    associations: DataFrame
    counts: DataFrame


def merged_urls(urls: DataFrame, matches: DataFrame, associations: DataFrame, key: list[str], evidence: int | None = None, sources: list[str] | None = None, kind: str = "url") -> Merge:
    """URLs of one evidence and some sources that agree in the key are merged into the row with the lowest id; all others stay.

    Merged rows have the earliest first and latest last time (unless in the key), all paths (lists joined by ", "), tags
    (tag_list) as a JSON list, notes joined by "; ", and added occurrences (absent or 0 counts as 1). Rows without a duplicate stay as
    they are. matches (id, list_name) and associations (tag, artifact_type, artifact_id) of merged rows go to the row that
    stays, once each. Groups are aggregated before the shuffle; what meets in one row is its distinct paths, tags and notes.
    """
    inside = F.lit(True)
    inside = inside & (F.col("evidence_id") == evidence) if evidence is not None else inside
    inside = inside & F.col("discovered_by").isin(*sources) if sources is not None else inside
    inside = F.coalesce(inside, F.lit(False))
    # null key fields are equal to one another, as in a grouping
    group = F.struct("evidence_id", *[c for c in key if c != "evidence_id"])
    scoped = urls.where(inside)
    paths = F.filter(F.transform(F.split("source_path", ", "), lambda x: F.trim(x)), lambda x: x != "")
    merged = scoped.groupBy(group.alias("group")).agg(
        F.count("*").alias("n"), F.min("id").alias("kept"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.nullif(F.array_join(_united(F.coalesce(paths, F.array().cast("array<string>"))), ", "), F.lit("")).alias("source_path"),
        _united(tag_list(F.col("tags"))).alias("all_tags"),
        F.nullif(F.array_join(F.array_sort(F.collect_set(F.nullif("notes", F.lit("")))), "; "), F.lit("")).alias("notes"),
        F.sum(F.when(F.col("occurrences") != 0, F.col("occurrences")).otherwise(1)).alias("occurrences"),
    ).where("n > 1")
    changed = {"source_path": F.col("source_path"), "tags": F.when(F.size("all_tags") > 0, F.to_json("all_tags")), "notes": F.col("notes"), "occurrences": F.col("occurrences").cast(urls.schema["occurrences"].dataType)}
    changed |= {c: F.col(c) for c in ("first_seen", "last_seen") if c not in key}
    new = merged.select(F.col("kept").alias("id"), F.struct(*[c.alias(name) for name, c in changed.items()]).alias("new"))
    of = scoped.select("id", group.alias("group")).join(merged.select("group", "kept"), "group").select("id", "kept")
    gone = of.where("id <> kept").select("id")
    rows = urls.join(gone, "id", "left_anti").join(new, "id", "left")
    rows = rows.select(*[F.when(F.col("new").isNotNull(), F.col("new")[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in urls.columns])
    moved = matches.join(of, "id", "left").select(F.coalesce("kept", "id").alias("id"), *[c for c in matches.columns if c != "id"]).distinct()
    own = associations.join(of.select(F.col("id").alias("artifact_id"), "kept", F.lit(kind).alias("artifact_type")), ["artifact_id", "artifact_type"], "left")
    tags = own.select(*[F.coalesce("kept", "artifact_id").alias(c) if c == "artifact_id" else F.col(c) for c in associations.columns]).distinct()
    sums = merged.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates_removed"), F.count("*").alias("unique_urls_affected"))
    total = scoped.agg(F.count("*").alias("total_before"))
    counts = total.crossJoin(F.broadcast(sums)).select("total_before", (F.col("total_before") - F.col("duplicates_removed")).alias("total_after"), "duplicates_removed", "unique_urls_affected")  # one row each
    return Merge(rows, moved, tags, counts)
