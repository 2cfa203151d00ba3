"""Browse filters, joins, pivots and rollups of single artifact types, each with the columns it works on as parameters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Schemes whose URLs are no places to go to.
INLINE_SCHEMES = "^(javascript|data):"


# -- browse filters
def browse_urls(urls: DataFrame, domain: str | None = None, sources: tuple[str, ...] = (), evidence: int | None = None) -> DataFrame:
    """F-3: URLs by a LIKE pattern of the domain without case, sources and evidence, with the time that they were seen at."""
    urls = urls.where(F.col("domain").ilike(domain)) if domain else urls
    urls = urls.where(F.col("discovered_by").isin(*sources)) if sources else urls
    urls = urls.where(F.col("evidence_id") == evidence) if evidence is not None else urls
    return urls.withColumn("seen", F.coalesce("first_seen", "last_seen"))


def browse_files(files: DataFrame, path: str | None = None, least: int | None = None, most: int | None = None, deleted: bool | None = None) -> DataFrame:
    """F-7: files by a LIKE pattern of the path without case, size and deletion state."""
    files = files.where(F.col("file_path").ilike(path)) if path else files
    files = files.where(F.col("size_bytes") >= least) if least is not None else files
    files = files.where(F.col("size_bytes") <= most) if most is not None else files
    return files.where(F.col("deleted") == F.lit(deleted)) if deleted is not None else files


def of_types(rows: DataFrame, column: str, prefixes: tuple[str, ...]) -> DataFrame:
    """F-21: rows whose type begins with one of the prefixes, without case."""
    return rows.where(reduce(Column.__or__, [F.lower(column).startswith(p.lower()) for p in prefixes], F.lit(False)))


def chosen(rows: DataFrame, column: str, values: list) -> DataFrame:
    """F-23: rows of a fixed choice of values."""
    return rows.where(F.col(column).isin(*values))


def with_field(rows: DataFrame, column: str, field: str, name: str) -> DataFrame:
    """F-25: rows whose JSON column has the field, with its text."""
    return rows.withColumn(name, F.try_variant_get(F.try_parse_json(column), f"$.{field}", "string")).where(F.col(name).isNotNull())


def sorted_by(rows: DataFrame, order: list[tuple[str, str, str]], limit: int | None = None) -> DataFrame:
    """K-3: rows in the order of (column, ASC or DESC, FIRST or LAST for nulls)."""
    ways = {("ASC", "FIRST"): Column.asc_nulls_first, ("ASC", "LAST"): Column.asc_nulls_last, ("DESC", "FIRST"): Column.desc_nulls_first, ("DESC", "LAST"): Column.desc_nulls_last}
    rows = rows.orderBy(*[ways[way, nulls](F.col(c)) for c, way, nulls in order])
    return rows.limit(limit) if limit is not None else rows


# -- joins
def attached(rows: DataFrame, other: DataFrame, key: str, other_key: str, columns: dict[str, str], how: str = "left") -> DataFrame:
    """J-11 to J-13, J-17b, J-17c: rows with columns (name: source) of another table by an equal key."""
    looked = other.select(F.col(other_key).alias("__key"), *[F.col(c).alias(n) for n, c in columns.items()])
    return rows.join(looked, F.col(key) == F.col("__key"), how).drop("__key")


def url_downloads(urls: DataFrame, downloads: DataFrame) -> DataFrame:
    """J-8: by URL and domain the lowest id, the number of sources and of downloads (url, download)."""
    counts = downloads.groupBy("url").agg(F.count("download").alias("downloads"))
    groups = urls.groupBy("url", "domain").agg(F.min("id").alias("id"), F.count_distinct("discovered_by").alias("sources"), F.count("*").alias("copies"))
    # every row of a URL meets each of its downloads
    return groups.join(counts, "url", "left").select("url", "domain", "id", "sources", (F.col("copies") * F.coalesce("downloads", F.lit(0))).alias("downloads"))


def events_of(events: DataFrame, marked: DataFrame, reference: str = "ref_id", key: str = "id") -> DataFrame:
    """J-10: events that refer to a marked row."""
    return events.join(marked.select(F.col(key).alias(reference)).distinct(), reference, "left_semi")


def with_source_rows(events: DataFrame, sources: dict[str, DataFrame], columns: tuple[str, ...]) -> DataFrame:
    """J-9: every event with columns of the row it refers to, looked up in the table that ref_table names; null where there is none."""
    rows = [df.select(F.lit(name).alias("ref_table"), F.col("id").alias("ref_id"), *columns) for name, df in sources.items()]
    return events.join(reduce(DataFrame.unionByName, rows), ["ref_table", "ref_id"], "left")


def referrers(nodes: DataFrame, parent: str = "parent", name: str = "name") -> DataFrame:
    """J-14: (id, referrer) of nodes whose parent is known."""
    above = nodes.select(F.col("id").alias("__id"), F.col(name).alias("referrer"))
    return nodes.select("id", parent).join(above, F.col(parent) == F.col("__id")).select("id", "referrer")


def pivoted(rows: DataFrame, key: str, attribute: str, values: list[str]) -> DataFrame:
    """J-15: a column with the number of rows for each of the attribute's values."""
    return rows.groupBy(key).agg(*[F.count_if(F.col(attribute) == v).alias(v) for v in values])


def chains(hops: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """J-16: (key, chain, final): the values of each key in order, joined by ">", and the last one."""
    ordered = F.array_sort(F.collect_list(F.struct(order, value)))
    return hops.groupBy(key).agg(ordered.alias("hops")).select(key, F.array_join(F.transform("hops", lambda x: x[value]), ">").alias("chain"), F.element_at("hops", -1)[value].alias("final"))


def only_known(rows: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """J-17d: rows whose key is known."""
    return rows.join(known.select(F.col(known_key).alias(key)).distinct(), key, "left_semi")


def best_effort(rows: DataFrame, by: dict[str, Column]) -> DataFrame:
    """J-22: the lowest id for each combination of what a link can be made by."""
    return rows.groupBy(*[c.alias(n) for n, c in by.items()]).agg(F.min("id").alias("id"))


def with_auto_flag(associations: DataFrame, kind: str, automatic: tuple[str, ...]) -> DataFrame:
    """J-27: (artifact_id, tag, auto) of one artifact type; auto is 1 for tags that are set without a user."""
    return associations.where(F.col("artifact_type") == kind).select("artifact_id", "tag", F.col("tag").isin(*automatic).cast("int").alias("auto"))


# -- rollups
def distinct_rows(rows: DataFrame, *columns: str) -> DataFrame:
    """A-15."""
    return rows.select(*columns).distinct()


def zero_filled(rows: DataFrame, column: str, values: list[str], name: str) -> DataFrame:
    """A-30: (name, n) for every value, 0 where no row has it."""
    known = rows.sparkSession.createDataFrame([(v,) for v in values], f"{name} string")
    counts = rows.where(F.col(column).isin(*values)).groupBy(F.col(column).alias(name)).agg(F.count("*").alias("n"))
    return known.join(F.broadcast(counts), name, "left").fillna(0, ["n"])  # one row for each value


def summary(figures: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """A-34: one row with an aggregate of each table."""
    parts = [df.agg(c.alias(name)) for name, (df, c) in figures.items()]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)  # one row each


def provenance(rows: DataFrame, content: str, order: str, source: str) -> DataFrame:
    """A-38: by content the first source in order, all sources as text, the number of rows."""
    return rows.groupBy(content).agg(F.min_by(source, order).alias("first_source"), F.array_join(F.array_sort(F.collect_set(source)), ",").alias("sources"), F.count("*").alias("n"))


def content_addressed(rows: DataFrame, content: str, order: str, columns: tuple[str, ...]) -> DataFrame:
    """S-14: one row for each content: the first in order, and how often it was found."""
    return rows.groupBy(content).agg(F.min(order).alias(order), *[F.min_by(c, order).alias(c) for c in columns], F.count("*").alias("discoveries"))


def counted(rows: DataFrame, key: str, name: str) -> DataFrame:
    """A-43."""
    return rows.groupBy(key).agg(F.count("*").alias(name))


def autostarts(rows: DataFrame, name: str, command: str, scope: str) -> DataFrame:
    """A-47: programs once for each name and command without case, with all their scopes."""
    return rows.groupBy(F.lower(name).alias("name"), F.lower(command).alias("command")).agg(F.array_join(F.array_sort(F.collect_set(F.col(scope).cast("string"))), "+").alias("scopes"))


def run_totals(runs: DataFrame, categories: tuple[str, ...] = ("discovered", "ingested", "failed", "skipped")) -> DataFrame:
    """A-39: (category, item, n): the counters of all runs added up; each category is a JSON map from item to count."""
    maps = F.array(*[F.struct(F.lit(c).alias("category"), F.from_json(c, "map<string,long>").alias("counts")) for c in categories])
    cells = runs.select(F.explode(maps).alias("m")).select("m.category", F.explode("m.counts").alias("item", "n"))
    return cells.groupBy("category", "item").agg(F.sum("n").alias("n"))


def values_in_order(rows: DataFrame, key: str, order: str, value: str, name: str) -> DataFrame:
    """W-8: (key, lowest order, values once each in the order of their first row)."""
    first = rows.groupBy(key, value).agg(F.min(order).alias("__at"))
    return first.groupBy(key).agg(F.min("__at").alias(order), F.transform(F.array_sort(F.collect_list(F.struct("__at", value))), lambda x: x[value]).alias(name))


def first_rows(rows: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """W-9: the first n rows of each key with their place; a rank with a limit, so a task keeps n rows of a key."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= n)


def most_used(rows: DataFrame, key: str, value: str) -> DataFrame:
    """W-11: (key, most): the value with most rows, the larger one where they tie."""
    return rows.groupBy(key, value).agg(F.count("*").alias("uses")).groupBy(key).agg(F.max_by(value, F.struct("uses", value)).alias("most"))


# -- unions
def cross_posted(artifacts: list[tuple[DataFrame, str, Column, Column]]) -> DataFrame:
    """U-2: (url, discovered_by, first_seen, last_seen) of every URL of tables (with a url), source name, and times; inline URLs are left out."""
    rows = [df.select("url", F.lit(source).alias("discovered_by") if isinstance(source, str) else source.alias("discovered_by"), first.alias("first_seen"), last.alias("last_seen")) for df, source, first, last in artifacts]
    return reduce(DataFrame.unionByName, rows).where(F.col("url").isNotNull() & ~F.col("url").rlike(INLINE_SCHEMES))


def merged(matches: list[DataFrame], key: list[str]) -> DataFrame:
    """U-5: matches of several searches, each key once."""
    return reduce(DataFrame.unionByName, [m.select(*key) for m in matches]).distinct()


# -- sessions
ENTRY = "struct<url:string,title:string,referrer:string>"
TAB = f"struct<entries:array<{ENTRY}>,index:int,pinned:boolean,lastAccessed:bigint>"
SESSION = f"windows array<struct<selected:int,tabs:array<{TAB}>,_closedTabs:array<struct<state:{TAB},title:string,closedAt:bigint>>>>"


def session_tabs(documents: DataFrame) -> DataFrame:
    """N-6: (id, window, tab, closed, url, title, pinned, selected, at, entries) of session documents (id, doc).

    A tab shows the entry that its 1-based index names (1 where it has none; no URL where there is no such entry). Tabs
    that were closed follow the open ones of their window; their time is that of the closing.
    """
    windows = documents.select("id", F.posexplode(F.from_json("doc", SESSION)["windows"]).alias("window", "w"))
    open_tabs = windows.select("id", "window", F.posexplode("w.tabs").alias("tab", "t"), F.lit(False).alias("closed"), F.col("w.selected").alias("chosen"), F.lit(None).cast("string").alias("own"), F.lit(None).cast("long").alias("ended"))
    shut = windows.select("id", "window", F.posexplode(F.col("w._closedTabs")).alias("tab", "c"), F.col("w.selected").alias("chosen")).select("id", "window", "tab", F.col("c.state").alias("t"), F.lit(True).alias("closed"), "chosen", F.col("c.title").alias("own"), F.col("c.closedAt").alias("ended"))
    rows = open_tabs.unionByName(shut).withColumn("entry", F.get("t.entries", F.coalesce("t.index", F.lit(1)) - 1))
    selected = ~F.col("closed") & (F.col("chosen") - 1 == F.col("tab"))
    return rows.select("id", "window", "tab", "closed", F.coalesce("entry.url", F.lit("")).alias("url"), F.coalesce("own", "entry.title", F.lit("")).alias("title"), F.coalesce("t.pinned", F.lit(False)).alias("pinned"), F.coalesce(selected, F.lit(False)).alias("selected"), F.timestamp_millis(F.coalesce("ended", "t.lastAccessed")).alias("at"), F.size(F.coalesce("t.entries", F.array())).alias("entries"))
