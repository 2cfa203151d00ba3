"""Timeline fusion from many sources, its statistics, gaps and daily counts."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemill.functions import scalars as S


@dataclass(frozen=True)
class Source:
    """P-4: how a table becomes events: (timestamp column, kind) pairs, confidence, note template, epoch or timestamp."""

    table: str
    moments: tuple[tuple[str, str], ...]
    confidence: str
    template: str
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    epoch: bool = False
    own_confidence: bool = False


# Kinds, confidences and notes of the event sources (U-1a to U-1n).
SOURCES = {
    "U-1a": Source("browser_history", (("ts_utc", "browser_visit"),), "high", "{browser} visit: {what}", (("what", ("title", "url")),)),
    "U-1b": Source("urls", (("first_seen_utc", "url_discovered"),), "medium", "URL: {url} (via {discovered_by})"),
    "U-1c": Source("images", (("ts_utc", "image_extracted"),), "medium", "Image: {filename}"),
    "U-1d": Source("image_discoveries", (("ts_utc", "image_discovered"),), "medium", "Image: {filename} (via {discovered_by})"),
    "U-1e": Source("os_indicators", (("detected_at_utc", "os_artifact"),), "low", "OS: {type} - {name}", own_confidence=True),
    "U-1f": Source("cookies", (("creation_utc", "cookie_created"), ("last_access_utc", "cookie_accessed")), "medium", "Cookie: {name} ({domain})"),
    "U-1g": Source("bookmarks", (("date_added_utc", "bookmark_added"),), "high", "Bookmark: {what}", (("what", ("title", "url")),)),
    "U-1h": Source("browser_downloads", (("start_time_utc", "download_started"), ("end_time_utc", "download_completed")), "high", "Download: {filename}"),
    "U-1i": Source("session_tabs", (("last_accessed_utc", "tab_accessed"),), "medium", "Tab: {what}", (("what", ("title", "url")),)),
    "U-1j": Source("autofill", (("date_created_utc", "autofill_created"), ("date_last_used_utc", "autofill_used")), "medium", "Autofill: {name}"),
    "U-1k": Source("credentials", (("date_created_utc", "credential_saved"), ("date_last_used_utc", "credential_used")), "high", "Credential: {origin_url}"),
    "U-1l": Source("media_playback", (("last_played_utc", "media_played"),), "medium", "Media: {url} ({watch_time_seconds}s)"),
    "U-1m": Source("hsts_entries", (("sts_observed", "hsts_observed"), ("expiry", "hsts_expiry")), "low", "HSTS: {host}", (("host", ("decoded_host", "hashed_host")),), epoch=True),
    "U-1n": Source("jump_list_entries", (("lnk_access_time", "jumplist_accessed"), ("lnk_creation_time", "jumplist_created")), "medium", "Jump list: {what}", (("what", ("url", "target_path")),)),
}
CONFIDENCES = ("high", "medium", "low")


def mapped(df: DataFrame, source: Source) -> DataFrame:
    """Events of one source: one row for each moment that is not null."""
    columns: dict[str, Column] = {c: F.col(c) for c in df.columns}
    columns |= {name: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in names], F.lit("unknown")) for name, names in source.fields}
    text = S.note(source.template, columns)
    time = lambda c: S.from_seconds(F.col(c)) if source.epoch else F.col(c).cast("timestamp")
    moments = F.array(*[F.struct(time(c).alias("ts"), F.lit(kind).alias("kind")) for c, kind in source.moments])
    confidence = F.coalesce(F.col("confidence"), F.lit(source.confidence)) if source.own_confidence else F.lit(source.confidence)
    rows = df.select("evidence_id", F.lit(source.table).alias("ref_table"), F.col("id").alias("ref_id"), confidence.alias("confidence"), text.alias("note"), F.explode(moments).alias("m"))
    return rows.where("m.ts is not null").select("evidence_id", "m.ts", "m.kind", "ref_table", "ref_id", "confidence", "note")


def fuse(tables: dict[str, DataFrame], names: list[str] | None = None) -> DataFrame:
    """U-1: the union of the events of all sources that have a table."""
    specs = [SOURCES[n] for n in names or [n for n in SOURCES if n != "U-1d"]]
    return reduce(DataFrame.unionByName, [mapped(tables[s.table], s) for s in specs if s.table in tables])


def in_order(events: DataFrame) -> DataFrame:
    """K-1."""
    return events.orderBy("ts", "ref_table", "ref_id")


def filtered(events: DataFrame, kinds=None, confidences=None, start=None, last_day=None) -> DataFrame:
    """F-8: the last day counts as a whole."""
    for column, values in (("kind", kinds), ("confidence", confidences)):
        events = events.where(F.col(column).isin(*values)) if values else events
    events = events.where(F.col("ts") >= F.lit(start).cast("timestamp")) if start else events
    return events.where(F.col("ts") < F.lit(last_day).cast("timestamp") + F.expr("interval 1 day")) if last_day else events


def at_least_confidence(events: DataFrame, level: str, groups: dict[str, str] | None = None, group: str | None = None) -> DataFrame:
    """F-22: events at or above a confidence, of one group of kinds."""
    events = events.where(F.col("confidence").isin(*CONFIDENCES[: CONFIDENCES.index(level) + 1]))
    return events.where(F.col("kind").isin(*[k for k, g in groups.items() if g == group])) if groups and group else events


def activity_stats(events: DataFrame) -> DataFrame:
    """A-11."""
    days = F.datediff(F.max("ts"), F.min("ts")) + 1
    return events.agg(F.count("*").alias("total"), F.min("ts").alias("earliest"), F.max("ts").alias("latest"), days.alias("span_days"), F.round(F.count("*") / days, 1).alias("per_day"))


def daily_counts(events: DataFrame, days: int) -> DataFrame:
    """A-12, W-10: counts of the first days, with bars of square-root height against the highest of them, 10 at least."""
    counts = events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).orderBy("day").limit(days)
    most = Window.partitionBy(F.lit(1))  # a few days only
    return counts.withColumn("height", F.greatest(F.lit(10), F.floor(F.sqrt(F.col("n") / F.max("n").over(most)) * 100)).cast("long"))


def breakdown(events: DataFrame) -> DataFrame:
    """A-13."""
    return events.groupBy(F.initcap(F.replace("kind", F.lit("_"), F.lit(" "))).alias("kind")).agg(F.count("*").alias("n"))


def stats(events: DataFrame) -> DataFrame:
    """A-14: counts over all, by kind, by confidence and by table, in one pass."""
    return events.groupingSets([[], [F.col("kind")], [F.col("confidence")], [F.col("ref_table")]], "kind", "confidence", "ref_table").agg(F.count("*").alias("n"), F.min("ts").alias("earliest"), F.max("ts").alias("latest"))


def gaps(events: DataFrame, hours: float, by: list[str], latest: int = 20) -> DataFrame:
    """W-1: pauses of at least so many hours (rounded to two places), newest first.

    Time is cut into spans a little shorter than such a pause, so a pause lies between two spans. Events are brought down
    to the first and last of each span before anything is shuffled or put in order; one source with all the rows
    is no more than its spans.
    """
    span = int((hours - 0.005) * 3600)
    if span < 1:
        raise ValueError("pauses are of 0.006 hours at least")
    spans = events.where("ts is not null").groupBy(*by, F.floor(F.unix_timestamp("ts") / span).alias("span")).agg(F.min("ts").alias("end"), F.max("ts").alias("last"))
    before = F.lag("last").over(Window.partitionBy(*by).orderBy("span"))
    rows = spans.select(*by, before.alias("start"), "end").where("start is not null")
    return rows.withColumn("hours", F.round((F.unix_timestamp("end") - F.unix_timestamp("start")) / 3600, 2)).where(F.col("hours") >= hours).orderBy(F.desc("end"), *by).limit(latest)
