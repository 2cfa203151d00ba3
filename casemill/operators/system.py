"""Rollups of operating-system indicators (id, type, name, value, path, extra_json)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.functions.browser import app_path, entry_name, profile_key

# Profiles of the system itself; order of the facts of a system.
SYSTEM_PROFILES = ("systemprofile", "localservice", "networkservice", "public", "default", "default user")
FACTS = (
    "computer_name", "os_version", "os_display_version", "os_build", "install_date", "registered_owner", "timezone_standard", "timezone_key",
    "last_shutdown", "rdp_status", "default_browser", "downloads_path", "pictures_path", "videos_path", "documents_path", "desktop_path",
)


def extra(field: str):
    return F.try_variant_get(F.try_parse_json("extra_json"), f"$.{field}", "string")


def users(indicators: DataFrame, with_system: bool = False) -> DataFrame:
    """A-45: (username, profile_path, path, local): profiles and accounts merged by name, the first profile of a name."""
    kind = F.col("type")
    own = indicators.where(kind.isin("system:user_profile", "system:user_account", "system:local_user"))
    last_part = F.regexp_extract(F.rtrim(F.translate("value", "\\", "/"), F.lit("/")), "([^/]*)$", 1)
    rows = own.select(
        "id", F.when(kind == "system:user_account", last_part).otherwise(F.col("value")).alias("username"), F.when(kind == "system:user_account", F.col("value")).when(kind == "system:user_profile", F.coalesce(extra("profile_path"), F.lit(""))).alias("profile_path"),
        "path", (kind == "system:local_user").alias("local"),
    ).where("username <> ''")
    rows = rows if with_system else rows.where(~F.lower("username").isin(*SYSTEM_PROFILES))
    profile = F.min_by(F.struct("profile_path", "path"), F.when(~F.col("local"), F.col("id")))
    merged = rows.groupBy("username").agg(profile.alias("p"), F.bool_or("local").alias("local"))
    return merged.select("username", F.coalesce("p.profile_path", F.lit("")).alias("profile_path"), F.coalesce("p.path", F.lit("")).alias("path"), "local")


def software(indicators: DataFrame) -> DataFrame:
    """A-46: (name, version, installed, publisher, interest, path), the first entry of each name."""
    rows = indicators.where("type = 'system:installed_software'").withColumn("name", F.coalesce(F.nullif("value", F.lit("")), "name")).where("name <> ''")
    first = rows.groupBy("name").agg(F.min_by(F.struct("extra_json", "path"), "id").alias("r")).select("name", "r.*")
    return first.select("name", extra("version").alias("version"), F.coalesce(F.nullif(extra("install_date_formatted"), F.lit("")), extra("install_date")).alias("installed"), extra("publisher").alias("publisher"), F.coalesce(extra("forensic_interest") == "true", F.lit(False)).alias("interest"), "path")


def network_profiles(indicators: DataFrame, types: list[str]) -> DataFrame:
    """A-48: one row for each key path, a column for each type with its last value."""
    rows = indicators.where(F.col("type").isin(*types)).withColumn("profile", profile_key(F.col("path")))
    return rows.groupBy("profile").agg(*[F.max_by("value", F.when(F.col("type") == t, F.col("id"))).alias(t) for t in types])


def facts(indicators: DataFrame, types: tuple[str, ...] = tuple(f"system:{f}" for f in FACTS)) -> DataFrame:
    """A-49: (place, type, value): the first value of each type, in the given order of types."""
    place = F.coalesce(*[F.when(F.col("type") == t, k) for k, t in enumerate(types)])
    return indicators.where(F.col("type").isin(*types)).groupBy("type").agg(F.min_by("value", "id").alias("value")).select(place.alias("place"), "type", "value")


# Indicator types of the browser and activity sections with their group (and label).
BROWSER_TYPES = {
    "browser:registered_browser": ("registered", ""), "browser:app_path": ("app_path", ""), "browser:home_page": ("setting", "Home Page"), "browser:search_page": ("setting", "Search Page"), "browser:search_scope": ("setting", "Search Scope: "),
}
ACTIVITY_TYPES = {
    "recent_documents": "recent_docs", "recent_documents:image": "recent_images", "browser:typed_url": "typed_urls", "typed_paths": "typed_paths", "open_save_dialog_mru": "open_save_mru",
    "open_save_dialog_last_visited": "open_save_last_visited", "user_activity:explorer_search": "explorer_searches",
}


def detected_browsers(indicators: DataFrame) -> DataFrame:
    """A-49: (id, section, name, value, path): registered browsers, programs with an application path, home and search settings.

    A registered browser is named by its value and left out without one; a program by the file in its key path, else
    by its entry; a search scope by its entry.
    """
    kind = F.col("type")
    section = F.coalesce(*[F.when(kind == t, g) for t, (g, _) in BROWSER_TYPES.items()])
    entry = F.coalesce(entry_name(F.col("name"), kind, F.col("extra_json"), F.col("path")), F.lit(""))
    value, path = F.coalesce("value", F.lit("")), F.coalesce("path", F.lit(""))
    name = F.when(section == "registered", value).when(section == "app_path", F.coalesce(F.nullif(app_path(path), F.lit("")), entry))
    for t, (_, text) in BROWSER_TYPES.items():
        if text:
            name = name.when(kind == t, F.concat(F.lit(text), entry) if text.endswith(": ") else F.lit(text))
    rows = indicators.where(kind.isin(*BROWSER_TYPES)).select("id", section.alias("section"), name.alias("name"), F.when(section == "registered", F.lit("")).otherwise(value).alias("value"), path.alias("path"))
    return rows.where("section <> 'registered' or name <> ''")


def user_activity(indicators: DataFrame) -> DataFrame:
    """A-49: (id, section, name, value, path) of recent documents, typed places, dialogs and searches."""
    kind = F.col("type")
    section = F.coalesce(*[F.when(kind == t, g) for t, g in ACTIVITY_TYPES.items()])
    entry = F.coalesce(entry_name(F.col("name"), kind, F.col("extra_json"), F.col("path")), F.lit(""))
    return indicators.where(kind.isin(*ACTIVITY_TYPES)).select("id", section.alias("section"), entry.alias("name"), F.coalesce("value", F.lit("")).alias("value"), F.coalesce("path", F.lit("")).alias("path"))


def assisted_runs(indicators: DataFrame) -> DataFrame:
    """A-49: (path, runs, focus_count, focus_time, last_run) of execution records; what executions() ranks."""
    path = F.coalesce(extra("decoded_path"), F.col("value"), F.lit(""))
    rows = indicators.where("type = 'execution:user_assist'")
    return rows.select(path.alias("path"), *[F.expr("try_variant_get(try_parse_json(extra_json), '$.%s', 'long')" % f).alias(n) for f, n in (("run_count", "runs"), ("focus_count", "focus_count"), ("focus_time", "focus_time"))], extra("last_run").alias("last_run"))


def executions(runs: DataFrame, top: int | None = None) -> DataFrame:
    """A-49: (path, runs, last_run): programs by their runs, most first; top: a report's length."""
    ranked = runs.groupBy("path").agg(F.sum("runs").alias("runs"), F.max("last_run").alias("last_run")).orderBy(F.desc_nulls_last("runs"), "path")
    return ranked if top is None else ranked.limit(top)
