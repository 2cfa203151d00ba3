"""Reference lists, listings, body files and feature files as DataFrames; CSV and partitioned sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.functions import scalars as S
from casemill.operators.tags import tag_text
from casemill.operators.textmine import is_noise, normal_feature
from casemill.operators.timeline import filtered
from casemill.sources.raw import SPLIT, raw_urls

# Columns of a listing by fragments of their header, feature types by file name.
COLUMNS = {
    "file_path": ("full path", "fullpath", "path", "location"), "file_name": ("filename", "file name", "name"), "size_bytes": ("size",), "created_ts": ("created", "creation"),
    "modified_ts": ("modified", "written"), "accessed_ts": ("accessed",), "md5_hash": ("md5",), "sha1_hash": ("sha1", "sha-1"), "sha256_hash": ("sha256", "sha-256"), "deleted": ("deleted",), "extension": ("ext",),
}
FEATURES = {"url": "url", "email": "email", "domain": "domain", "ip": "ip", "telephone": "telephone", "bitcoin": "bitcoin", "ether": "ether"}


def hash_list(spark: SparkSession, path: str) -> DataFrame:
    """S-2: (list_name, hash, kind, note) of text files with a hash a line; comments and other lines are left out."""
    lines = spark.read.text(path).select(F.trim("value").alias("v"), S.file_name(F.col("_metadata.file_path")).alias("file"))
    rows = lines.where("v <> '' and not startswith(v, '#')").select(F.regexp_replace("file", r"\.[^.]*$", "").alias("list_name"), F.lower(F.regexp_extract("v", r"^([0-9a-fA-F]+)(?:[,\s]|$)", 1)).alias("hash"), F.regexp_extract("v", r"^[0-9a-fA-F]+[,\s]+(.*)$", 1).alias("note"))
    return rows.where(F.length("hash").isin(32, 40, 64)).withColumn("kind", F.when(F.length("hash") == 32, "md5").when(F.length("hash") == 40, "sha1").otherwise("sha256"))


def pattern_list(spark: SparkSession, path: str) -> DataFrame:
    """S-3: (list_name, idx, pattern, is_regex) in file order; the header says whether patterns are regular expressions."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_replace(S.file_name(F.col("_metadata.file_path")), r"\.[^.]*$", "").alias("list_name"), F.split("value", r"\r?\n").alias("lines"))
    flag = F.exists("lines", lambda x: x.rlike(r"(?i)^#\s*regex:\s*(true|yes|1)\s*$"))
    rows = files.select("list_name", flag.alias("is_regex"), F.posexplode("lines").alias("idx", "pattern"))
    return rows.where("trim(pattern) <> '' and not startswith(ltrim(pattern), '#')").select("list_name", "idx", F.trim("pattern").alias("pattern"), "is_regex")


def suffix_rules(spark: SparkSession, path: str) -> list[str]:
    """H-7: the rules of a public suffix list file, for registered_domain(); comments and empty lines are left out."""
    lines = spark.read.text(path).select(F.lower(F.regexp_extract(F.trim("value"), r"^(\S*)", 1)).alias("rule"))
    return [r.rule for r in lines.where("rule <> '' and not startswith(rule, '//')").distinct().orderBy("rule").collect()]  # some thousand lines


def list_versions(spark: SparkSession, path: str, present: DataFrame) -> DataFrame:
    """S-4: (list_name, file, version, state): the digest of each list file, and whether it is new, changed or unchanged.

    present: (list_name, version) of the lists imported before.
    """
    files = spark.read.format("binaryFile").load(path).select(F.regexp_replace(S.file_name(F.col("path")), r"\.[^.]*$", "").alias("list_name"), F.col("path").alias("file"), F.sha2("content", 256).alias("version"))
    old = present.select("list_name", F.col("version").alias("old"))
    state = F.when(F.col("old").isNull(), "new").when(F.col("old") == F.col("version"), "unchanged").otherwise("changed")
    return files.join(old, "list_name", "left").select("list_name", "file", "version", state.alias("state"))


def imported(spark: SparkSession, path: str, entries: DataFrame, present: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S-4: (entries, versions) after an import: new and changed lists replace theirs, other lists stay."""
    versions = list_versions(spark, path, present)
    fresh = versions.where("state <> 'unchanged'").select("list_name")
    rows = hash_list(spark, path).join(F.broadcast(fresh), "list_name", "left_semi")
    kept = entries.join(F.broadcast(fresh), "list_name", "left_anti")
    now = versions.select("list_name", "version")
    return kept.unionByName(rows), present.join(now, "list_name", "left_anti").unionByName(now)


def batch_status(spark: SparkSession, path: str, names: DataFrame, policy: str) -> DataFrame:
    """S-5: (list_name, target, entries, bad, status) of list files against the names in use; policy: skip, overwrite or rename.

    A file without a valid entry is refused. A renamed list gets the lowest free number.
    """
    if policy not in ("skip", "overwrite", "rename"):
        raise ValueError(f"no such policy: {policy}")
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace(S.file_name(F.col("_metadata.file_path")), r"\.[^.]*$", "").alias("list_name"), F.split("value", r"\r?\n").alias("lines"))
    lines = F.filter(F.transform("lines", lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))
    good = F.filter("lines", lambda x: F.length(F.regexp_extract(x, r"^([0-9a-fA-F]+)(?:[,\s]|$)", 1)).isin(32, 40, 64))
    files = text.withColumn("lines", lines).select("list_name", F.size(good).alias("entries"), (F.size("lines") - F.size(good)).alias("bad"))
    stems = F.array_distinct(F.array("list_name", F.regexp_replace("list_name", r"_\d+$", "")))
    taken = names.select(F.explode(stems).alias("stem"), "list_name").groupBy("stem").agg(F.collect_set("list_name").alias("numbered"))
    free = F.get(F.filter(F.transform(F.sequence(F.lit(1), F.size("numbered") + 1), lambda k: F.concat("list_name", F.lit("_"), k.cast("string"))), lambda n: ~F.array_contains("numbered", n)), 0)
    joined = files.join(names.select("list_name", F.lit(True).alias("used")).distinct(), "list_name", "left").join(taken, F.col("list_name") == F.col("stem"), "left")
    clash, bad = F.coalesce("used", F.lit(False)), F.col("entries") == 0
    status = F.when(bad, "invalid").when(~clash, "imported").otherwise({"skip": "skipped", "overwrite": "overwritten", "rename": "renamed"}[policy])
    target = F.when(bad | (clash & F.lit(policy == "skip")), None).when(clash & F.lit(policy == "rename"), free).otherwise(F.col("list_name"))
    return joined.select("list_name", target.alias("target"), "entries", "bad", status.alias("status"))


def purged(tables: dict[str, DataFrame], evidence: int) -> dict[str, DataFrame]:
    """S-15: the tables without the rows of one evidence."""
    return {name: df.where(~F.col("evidence_id").eqNullSafe(F.lit(evidence))) for name, df in tables.items()}


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """S-15: (name, n) of all tables."""
    return reduce(DataFrame.union, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()])


def column_mapping(header: list[str]) -> dict[str, str]:
    """S-7: the listing column of each header field, by the first fragment that it holds; each column once."""
    found: dict[str, str] = {}
    for column, fragments in COLUMNS.items():
        for fragment in fragments:
            hit = next((h for h in header if fragment in h.lower() and h not in found.values()), None)
            if hit and column not in found:
                found[column] = hit
    return found


def listing(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """S-6: a delimited file listing with the columns of one schema; rows without a path are left out."""
    raw = spark.read.csv(path, sep=sep, header=True, mode="DROPMALFORMED", multiLine=False)
    names = column_mapping(raw.columns)
    value = lambda c: F.nullif(F.trim(F.col(f"`{names[c]}`")), F.lit("")) if c in names else F.lit(None).cast("string")
    rows = raw.select(*[value(c).alias(c) for c in COLUMNS])
    file_path = F.coalesce("file_path", "file_name")
    return rows.select(
        file_path.alias("file_path"), F.coalesce("file_name", S.file_name(file_path)).alias("file_name"), F.try_to_number(F.regexp_replace("size_bytes", ",", ""), F.lit("999999999999999999")).cast("long").alias("size_bytes"),
        *[S.parsed(F.col(c)).alias(c) for c in ("created_ts", "modified_ts", "accessed_ts")], "md5_hash", "sha1_hash", "sha256_hash", S.truth(F.col("deleted")).alias("deleted"),
    ).where("file_path is not null")


BODY = r"^([^|]*)\|(.*)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)$"


def body_rows(lines: DataFrame) -> DataFrame:
    """S-8: files of a body file (column value); the path may hold bars; attribute rows and directories are left out."""
    field = lambda k: F.regexp_extract("value", BODY, k)
    rows = lines.where(F.col("value").rlike(BODY)).select(field(2).alias("raw"), field(3).alias("inode"), field(4).alias("mode"), field(7).alias("size"), *[field(k).alias(n) for k, n in ((8, "accessed"), (9, "modified"), (10, "changed"), (11, "created"))])
    rows = rows.where(~F.col("raw").rlike(r"(?i)\s*\(\$[A-Z0-9_]+\)\s*(?:\(deleted(?:-realloc)?\))?$|:\$[A-Z0-9_]+$") & ~F.col("mode").rlike("^d/|/d"))
    deleted = F.col("raw").startswith("*") | F.col("raw").rlike(r"(?i)\s*\(deleted(?:-realloc)?\)$")
    file_path = F.regexp_replace(F.regexp_replace("raw", r"^\*\s*", ""), r"(?i)\s*\(deleted(?:-realloc)?\)$", "")
    number = lambda c: F.expr(f"try_cast({c} as bigint)")
    return rows.select(file_path.alias("file_path"), S.file_name(file_path).alias("file_name"), S.inode(F.col("inode")).alias("inode"), number("size").alias("size_bytes"), *[S.from_seconds(number(c)).alias(f"{c}_ts") for c in ("created", "modified", "accessed")], deleted.alias("deleted"))


def body_file(spark: SparkSession, path: str) -> DataFrame:
    return body_rows(spark.read.text(path))


def feature_file(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """S-9: (kind, offset, feature, context) of tab-separated feature files; the kind, where none is given, comes from the file's name."""
    lines = spark.read.text(path).select("value", F.regexp_extract(S.file_name(F.col("_metadata.file_path")), r"^([a-z]+)", 1).alias("file")).where("not startswith(value, '#')")
    parts = F.split("value", "\t")
    kind = F.lit(kind) if kind else F.coalesce(*[F.when(F.col("file").startswith(k), v) for k, v in FEATURES.items()])
    rows = lines.select(kind.alias("kind"), F.expr("try_cast(split(value, '\\t')[0] as bigint)").alias("offset"), normal_feature(kind, F.get(parts, 1)).alias("feature"), F.get(parts, 2).alias("context"))
    return rows.where("kind is not null and offset is not null and feature is not null")


def urls_in_files(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """S-10: (path, offset, url) swept out of raw files, large ones in ranges of `split` bytes; noise is left out."""
    return raw_urls(spark, path, split).where(~is_noise(F.col("url")))


def write_csv(df: DataFrame, path: str, quote_all: bool = False) -> None:
    """S-18: any table as CSV files with a header, in the order that it has."""
    df.write.mode("overwrite").csv(path, header=True, quoteAll=quote_all)


def export_rows(df: DataFrame, path: str, columns: dict[str, str], order: list[str]) -> None:
    """S-18: columns of a table under the names of their report, in order; times and flags as text."""
    write_csv(df.orderBy(*order).select(*[F.col(c).cast("string").alias(n) for n, c in columns.items()]), path)


def export_timeline(events: DataFrame, associations: DataFrame, path: str, kinds=None, confidences=None, start=None, last_day=None) -> None:
    """S-16: events that pass the filter, with the tags of the row they refer to, by time, table and row."""
    marks = associations.groupBy(F.col("artifact_type").alias("ref_table"), F.col("artifact_id").alias("ref_id")).agg(F.array_join(F.array_sort(F.collect_set("tag")), ", ").alias("tags"))
    rows = filtered(events, kinds, confidences, start, last_day).join(marks, ["ref_table", "ref_id"], "left").orderBy("ts", "ref_table", "ref_id")
    write_csv(rows.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "kind", "confidence", "ref_table", "ref_id", F.coalesce("tags", F.lit("")).alias("tags")), path)


def export_urls(urls: DataFrame, matches: DataFrame, associations: DataFrame, path: str, kind: str = "url") -> None:
    """S-17: URLs by first-or-last time seen, URL and id, with the lists that they match and their tags; all cells quoted."""
    lists = matches.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("list_name")), ", ").alias("lists"))
    rows = urls.join(lists, "id", "left").join(tag_text(associations, kind), "id", "left").orderBy(F.coalesce("first_seen", "last_seen").asc_nulls_first(), "url", "id")
    write_csv(rows.select("id", "url", "domain", "discovered_by", "first_seen", "last_seen", F.coalesce("lists", F.lit("")).alias("matches"), F.coalesce("tags", F.lit("")).alias("tags")), path, quote_all=True)


def replace_partition(df: DataFrame, path: str, by: list[str], keys: list[tuple] = ()) -> None:
    """S-12, S-19: the partitions that df has rows for are written anew, others stay.

    keys: partitions (values of the columns by) that are replaced even where df has no row for them: they are emptied.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    filled = {tuple(map(str, r)) for r in df.select(*by).distinct().collect()} if keys else ()  # one row for each partition
    for key in keys:
        if tuple(map(str, key)) not in filled:
            spark = df.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path("/".join([path, *[f"{c}={v}" for c, v in zip(by, key)]]))
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
