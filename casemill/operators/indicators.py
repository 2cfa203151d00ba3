"""Lists and sections of system indicators (id, type, name, value, path, hive, extra_json) and of other report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.functions.browser import entry_name

# Indicator types of the sections, sources of images that are browsers' caches.
SOFTWARE, EXECUTION, SERVICE, HELPER = "system:installed_software", "execution:user_assist", "startup:service", "startup:bho"
RUN_KEYS = ("startup:run_key", "startup:run_once_key")
BROWSER_SOURCES = ("cache_simple", "cache_blockfile", "cache_firefox", "browser_storage_indexeddb", "safari")
FILE_SOURCE = "filesystem_images"


def _field(name: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.try_parse_json("extra_json"), f"$.{name}", kind)


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _chosen(rows: DataFrame, columns: tuple[str, ...], search: str | None, forensic_only: bool) -> DataFrame:
    if search:
        found = F.lit(False)
        for c in columns:
            found = found | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(search.lower()))
        rows = rows.where(found)
    return rows.where("forensic_interest") if forensic_only else rows


def installed_software(indicators: DataFrame, search: str | None = None, forensic_only: bool = False) -> DataFrame:
    """F-25: (id, name, publisher, version, install_date, size_kb, forensic_interest, forensic_category, path, hive), by name without case.

    search: a text in the name or publisher, without case. Fields that the JSON lacks are empty, broken JSON has none.
    """
    text = lambda name: F.coalesce(_field(name), F.lit(""))
    rows = indicators.where(F.col("type") == SOFTWARE).select(
        "id", F.coalesce(_filled(F.col("value")), _field("name"), F.lit("Unknown")).alias("name"), text("publisher").alias("publisher"), text("version").alias("version"),
        F.coalesce(_filled(_field("install_date_formatted")), _field("install_date"), F.lit("")).alias("install_date"), _field("size_kb", "bigint").alias("size_kb"),
        F.coalesce(_field("forensic_interest", "boolean"), F.lit(False)).alias("forensic_interest"), text("forensic_category").alias("forensic_category"), "path", "hive",
    )
    return _chosen(rows, ("name", "publisher"), search, forensic_only).orderBy(F.lower("name"), "id")


def app_executions(indicators: DataFrame, search: str | None = None, forensic_only: bool = False) -> DataFrame:
    """F-25: (id, decoded_path, run_count, focus_count, focus_time_ms, last_run, forensic_interest, path, hive), by stored value without case.

    search: a text in the decoded path, without case.
    """
    rows = indicators.where(F.col("type") == EXECUTION).orderBy(F.lower("value"), "id").select(
        "id", F.coalesce(_field("decoded_path"), "value", F.lit("")).alias("decoded_path"), _field("run_count", "bigint").alias("run_count"), _field("focus_count", "bigint").alias("focus_count"),
        _field("focus_time_ms", "bigint").alias("focus_time_ms"), F.coalesce(_field("last_run_utc"), F.lit("")).alias("last_run"), F.coalesce(_field("forensic_interest", "boolean"), F.lit(False)).alias("forensic_interest"), "path", "hive",
    )
    return _chosen(rows, ("decoded_path",), search, forensic_only)


def run_entries(indicators: DataFrame) -> DataFrame:
    """A-47: (name, command, scope, is_run_once, path): programs of run keys once for each name and command without case.

    The row with the lowest id gives name, path and kind; the scope names both hives where rows of both were seen.
    """
    name = entry_name(F.col("name"), F.col("type"), F.col("extra_json"), F.col("path"))
    upper = F.upper(F.coalesce("path", F.lit("")))
    user = F.contains(upper, F.lit("NTUSER")) | F.contains(upper, F.lit("HKU")) | F.contains(upper, F.lit("HKCU"))
    once = (F.col("type") == RUN_KEYS[1]) | F.contains(F.coalesce("path", F.lit("")), F.lit("RunOnce"))
    rows = indicators.where(F.col("type").isin(*RUN_KEYS)).select("id", name.alias("name"), F.coalesce("value", F.lit("")).alias("command"), F.when(user, "HKCU").otherwise("HKLM").alias("scope"), once.alias("is_run_once"), "path")
    rows = rows.where("name not in ('Run', 'RunOnce', '') and command <> ''")
    first = F.min_by(F.struct("name", "command", "is_run_once", "path"), "id").alias("f")
    merged = rows.groupBy(F.lower("name").alias("n"), F.lower("command").alias("c")).agg(first, F.min("scope").alias("low"), F.max("scope").alias("high"))
    return merged.select("f.name", "f.command", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise("HKLM+HKCU").alias("scope"), "f.is_run_once", "f.path")


def helper_objects(indicators: DataFrame) -> DataFrame:
    """A-47: (clsid, path) of browser helper objects, each class once, with the path of the lowest id."""
    rows = indicators.where((F.col("type") == HELPER) & (F.col("value") != ""))
    return rows.groupBy(F.col("value").alias("clsid")).agg(F.min_by(F.struct("path"), "id").alias("f")).select("clsid", "f.path")


def services(indicators: DataFrame) -> DataFrame:
    """A-47: (id, name, command, path) of services that have a name."""
    name = entry_name(F.col("name"), F.col("type"), F.col("extra_json"), F.col("path"))
    return indicators.where(F.col("type") == SERVICE).select("id", name.alias("name"), F.coalesce("value", F.lit("")).alias("command"), "path").where("name <> ''")


def stored_sites(sites: DataFrame, evidence: int, ids: list[int] | None = None, tagged_only: bool = False) -> DataFrame:
    """F-23: stored sites of an evidence for a report, most keys first: all or those of some ids, all or tagged ones; browsers (JSON list) as an array."""
    rows = sites.where(F.col("evidence_id") == evidence)
    rows = rows.where(F.col("id").isin(*ids)) if ids else rows
    rows = rows.where("tags is not null and tags <> ''") if tagged_only else rows
    browsers = F.coalesce(F.from_json("browsers", "array<string>"), F.array().cast("array<string>"))
    return rows.withColumn("browsers", F.filter(browsers, lambda b: b.isNotNull())).orderBy(F.desc_nulls_last("total_keys"), "id")


def image_sources(discoveries: DataFrame) -> DataFrame:
    """A-38: for each image of an evidence the first source, all sources, their number, that of discoveries, a path, browser sources.

    discoveries: evidence_id, image_id, discovered_by, discovered_at, fs_path. The first source is that of the earliest
    time (null before all), of equal times the smallest name; the path is the largest of the file system's.
    """
    by = F.col("discovered_by")
    browser = by.isin(*BROWSER_SOURCES)
    joined = lambda c: _filled(F.array_join(F.array_sort(F.collect_set(c)), ","))
    order = F.struct(F.coalesce(F.col("discovered_at").isNotNull(), F.lit(False)).alias("known"), "discovered_at", by.alias("by"))
    return discoveries.groupBy("evidence_id", "image_id").agg(
        F.min(order)["by"].alias("first_discovered_by"), joined(by).alias("sources"), F.count_distinct("discovered_by").alias("source_count"), F.count("*").alias("total_discoveries"),
        F.max(F.when(by == FILE_SOURCE, F.col("fs_path"))).alias("fs_path"), F.max(F.coalesce(browser, F.lit(False))).alias("has_browser_source"), joined(F.when(browser, by)).alias("browser_sources"),
    )


def image_urls(discoveries: DataFrame) -> DataFrame:
    """W-8: (image_id, urls, file_date): the URLs of an image once each in the order of their first discovery (id for equal times), and its file date.

    The date is that of the first discovery in the file system (lowest id) that has a creation or else a change time. URLs are brought
    down to one row for each image and URL before they meet.
    """
    order = F.struct("discovered_at", "id")
    first = discoveries.where("cache_url <> ''").groupBy("image_id", "cache_url").agg(F.min(order).alias("at"))
    urls = first.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "cache_url"))), lambda x: x["cache_url"]).alias("urls"))
    dated = discoveries.where(F.col("discovered_by") == FILE_SOURCE).withColumn("best", F.coalesce("fs_crtime", "fs_mtime")).where("best is not null")
    dates = dated.groupBy("image_id").agg(F.min_by("best", "id").alias("file_date"))
    return urls.join(dates, "image_id", "full").select("image_id", F.coalesce("urls", F.array().cast("array<string>")).alias("urls"), "file_date")


def tab_histories(tabs: DataFrame, history: DataFrame) -> DataFrame:
    """A-43: every tab with the number of its navigation entries, 0 where it has none."""
    counts = history.groupBy(F.col("tab_id").alias("of")).agg(F.count("*").alias("entries"))
    return tabs.join(counts, F.col("id") == F.col("of"), "left").drop("of").fillna(0, ["entries"])


def purge_order(parents: dict[str, list[str]]) -> list[str]:
    """S-15: tables with children before their parents; parents: the tables that each one refers to."""
    order: list[str] = []

    def visit(name: str, way: tuple[str, ...]) -> None:
        if name in way:
            raise ValueError(f"tables refer to one another: {' '.join((*way, name))}")
        if name not in order:
            for child in sorted(c for c, own in parents.items() if name in own):
                visit(child, (*way, name))
            order.append(name)

    for name in sorted({*parents, *(p for own in parents.values() for p in own)}):
        visit(name, ())
    return order


def purge(spark, folder: str, parents: dict[str, list[str]], evidence: int, only: list[str] | None = None) -> DataFrame:
    """S-15: (place, name, removed): the evidence's partition of each table below a folder is dropped, children before parents.

    Tables are folders of files partitioned by evidence_id. Other evidences are not read or written anew; a table that
    is not there has 0 rows. A purge that broke off is finished by another.
    """
    system = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    rows = []
    for place, name in enumerate(n for n in purge_order(parents) if only is None or n in only):
        part = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/evidence_id={evidence}")
        n = spark.read.parquet(str(part)).count() if system.exists(part) else 0
        system.delete(part, True)
        rows.append((place, name, n))
    return spark.createDataFrame(rows, "place int, name string, removed long")
