"""Rows out of nested documents: JSON maps and trees, state lines, cookie and shortcut texts (N-*)."""

from __future__ import annotations

import json
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.functions import scalars as S
from casemill.functions.browser import slashed
from casemill.functions.codes import label

# Bookmark roots and their names, states of security entries, internal schemes.
BOOKMARK_ROOTS = {"bookmark_bar": "Bookmarks Bar", "other": "Other Bookmarks", "synced": "Mobile Bookmarks", "account": "Account Bookmarks"}
STATES = {0: "force-https", 1: "knockout"}
INTERNAL = ("about:", "chrome:", "moz-extension:", "resource:")
END_OF_2100 = 4_102_444_800


def named(codes: dict[int, str], code: Column) -> Column:
    return F.coalesce(*[F.when(code == k, v) for k, v in codes.items()])


def bookmark_rows(doc_id, text: str | None):
    """The nodes of one bookmark file, each with the path of its folder; any depth, nothing for text that is no JSON."""
    try:
        roots = json.loads(text or "").get("roots") or {}
    except (ValueError, AttributeError):
        return
    stack = [(roots[key], name) for key, name in reversed(BOOKMARK_ROOTS.items()) if isinstance(roots, dict) and isinstance(roots.get(key), dict)]
    while stack:
        node, folder = stack.pop()
        kind, name = node.get("type") or "", node.get("name") or ""
        added = str(node.get("date_added") or "")
        yield {"id": doc_id, "name": name, "url": node.get("url"), "kind": kind, "folder": folder, "added": int(added) if added.isdecimal() else None}
        if kind == "folder":
            inner = f"{folder}/{name}" if folder else name
            stack += [(child, inner) for child in reversed(node.get("children") or []) if isinstance(child, dict)]


def bookmarks(docs: DataFrame) -> DataFrame:
    """N-1: (id, name, url, kind, folder, added) of bookmark trees; trees have no bounded depth, so each file is walked in a task."""
    schema = pa.schema([("id", pa.int64()), ("name", pa.string()), ("url", pa.string()), ("kind", pa.string()), ("folder", pa.string()), ("added", pa.int64())])

    def run(batches):
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = list(bookmark_rows(doc_id, text))
                for k in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_pylist(rows[k : k + 10_000], schema)

    rows = docs.select(F.col("id").cast("long"), "doc").mapInArrow(run, "id long, name string, url string, kind string, folder string, added long")
    return rows.withColumn("added", S.from_webkit(F.col("added")))


def exploded(df: DataFrame, value: str, key: str, inner: str) -> DataFrame:
    """Each row once for each entry of the JSON object (or list) in a variant column."""
    inside = df.sparkSession.tvf.variant_explode(F.col(value).outer()).select(F.col("key").alias(key), F.col("value").alias(inner))
    return df.lateralJoin(inside)


def settings(docs: DataFrame, path: str = "$") -> DataFrame:
    """N-2, N-3: (id, kind, origin, entry) of a map type -> origin -> setting."""
    top = docs.select("id", F.try_variant_get(F.try_parse_json("doc"), path, "variant").alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    origins = exploded(top, "v", "kind", "o").where(F.schema_of_variant("o").startswith("OBJECT"))
    return exploded(origins, "o", "origin", "entry").where(F.schema_of_variant("entry").startswith("OBJECT")).select("id", "kind", "origin", "entry")


def moment(entry: str, path: str) -> Column:
    return S.from_webkit(F.try_variant_get(F.col(entry), path, "string").try_cast("long"))


def engagement(docs: DataFrame, kinds: list[str], path: str = "$") -> DataFrame:
    """N-2: scores of origins; entries whose setting is no object are left out."""
    rows = settings(docs, path).where(F.col("kind").isin(*kinds)).where(F.schema_of_variant(F.try_variant_get("entry", "$.setting", "variant")).startswith("OBJECT"))
    score = F.try_variant_get(F.col("entry"), "$.setting.rawScore", "double")
    return rows.select("id", "kind", "origin", score.alias("score"), moment("entry", "$.last_modified").alias("modified"), moment("entry", "$.expiration").alias("expires"))


def permissions(docs: DataFrame, path: str = "$") -> DataFrame:
    """N-3: permissions of origins; entries whose setting is no number are left out, a missing one is 0."""
    setting = F.try_variant_get(F.col("entry"), "$.setting", "variant")
    form, text = F.schema_of_variant(setting), F.try_variant_get(setting, "$", "string")
    code = F.when(setting.isNull(), 0).when(form == "BOOLEAN", (text == "true").cast("int")).when(~form.startswith("OBJECT") & ~form.startswith("ARRAY") & text.rlike(r"^\s*-?\d+(\.0*)?\s*$"), text.try_cast("double").cast("int"))
    rows = settings(docs, path).withColumn("code", code).where("code is not null")
    return rows.select("id", "kind", "origin", "code", label("chromium_permission", F.col("code")).alias("permission"), moment("entry", "$.last_modified").alias("modified"), moment("entry", "$.expiration").alias("expires"))


STS = "sts array<struct<host:string,sts_observed:double,expiry:double,mode:string,sts_include_subdomains:boolean>>"


def strict_transport(docs: DataFrame) -> DataFrame:
    """N-4: (id, host, observed, expires, mode, subdomains) of a transport-security file; entries without a host are left out."""
    rows = docs.select("id", F.explode(F.from_json("doc", STS)["sts"]).alias("e")).where("e.host <> ''")
    return rows.select("id", "e.host", S.from_seconds(F.col("e.sts_observed")).alias("observed"), S.from_seconds(F.col("e.expiry")).alias("expires"), F.coalesce("e.mode", F.lit("force-https")).alias("mode"), F.coalesce("e.sts_include_subdomains", F.lit(False)).alias("subdomains"))


def listed(docs: DataFrame, path: str, fields: dict[str, str]) -> DataFrame:
    """N-5, N-9: a row for each element of the JSON list at a path; fields: column name -> path inside the element."""
    rows = docs.select("id", F.try_variant_get(F.try_parse_json("doc"), path, "variant").alias("v")).where(F.schema_of_variant("v").startswith("ARRAY"))
    inside = rows.sparkSession.tvf.variant_explode(F.col("v").outer()).select(F.col("pos"), F.col("value").alias("e"))
    return rows.lateralJoin(inside).select("id", "pos", *[F.try_variant_get("e", p, "string").alias(c) for c, p in fields.items()])


def with_metadata(extensions: DataFrame, store: DataFrame, columns: list[str]) -> DataFrame:
    """N-5: columns that are empty are filled from the store's row of the same extension."""
    own = store.select(F.col("extension").alias("store_extension"), *[F.col(c).alias(f"store_{c}") for c in columns])
    joined = extensions.join(own, F.col("extension") == F.col("store_extension"), "left")
    return joined.withColumns({c: F.coalesce(F.nullif(c, F.lit("")), f"store_{c}") for c in columns}).drop("store_extension", *[f"store_{c}" for c in columns])


def form_fields(entries: DataFrame) -> DataFrame:
    """N-7: (id, url, field_type, name, value) of the form data of session entries; empty values are left out."""
    base = entries.select("id", F.try_parse_json("doc").alias("v")).select("id", F.try_variant_get("v", "$.url", "string").alias("url"), F.try_variant_get("v", "$.formdata", "variant").alias("form"))
    parts = [base.select("id", "url", F.lit(k).alias("field_type"), F.try_variant_get("form", f"$.{k}", "variant").alias("f")) for k in ("id", "xpath")]
    rows = exploded(reduce(DataFrame.union, parts).where(F.schema_of_variant("f").startswith("OBJECT")), "f", "name", "x")
    return rows.select("id", "url", "field_type", "name", F.coalesce(F.try_variant_get("x", "$", "string"), F.to_json("x")).alias("value")).where("value not in ('', 'null', 'false', '0', '{}', '[]')")


def session_urls(sources: dict[str, DataFrame]) -> DataFrame:
    """N-8: (url, title, seen, source) of tabs, history and closed tabs; internal schemes are left out, copies stay."""
    rows = reduce(DataFrame.unionByName, [df.select("url", "title", "seen", F.lit(kind).alias("source")) for kind, df in sources.items()])
    internal = reduce(lambda a, b: a | b, [F.col("url").startswith(s) for s in INTERNAL])
    return rows.where((F.col("url") != "") & ~internal).withColumn("title", F.coalesce("title", F.lit("")))


def security_states(lines: DataFrame) -> DataFrame:
    """N-10: (host, kind, score, accessed, expires, state, mode, subdomains) of tab-separated state lines (column value)."""
    parts, data = F.split("value", "\t"), F.split(F.get(F.split("value", "\t"), 3), ",")
    number = lambda c: F.trim(c).try_cast("long")
    days, ms, state = number(F.get(parts, 2)), number(F.get(data, 0)), number(F.get(data, 1))
    rows = lines.where((F.size(parts) >= 4) & F.get(parts, 0).rlike("^.+:[^:]+$"))
    return rows.select(
        F.regexp_extract(F.get(parts, 0), "^(.+):([^:]+)$", 1).alias("host"), F.regexp_extract(F.get(parts, 0), "^(.+):([^:]+)$", 2).alias("kind"), number(F.get(parts, 1)).alias("score"),
        F.when((days > 0) & (days * 86_400 <= END_OF_2100), F.timestamp_seconds(days * 86_400)).alias("accessed"), F.when((ms > 0) & (ms <= END_OF_2100 * 1000), F.timestamp_millis(ms)).alias("expires"),
        state.alias("state"), named(STATES, state).alias("mode"), F.coalesce(number(F.get(data, 2)), F.lit(0)).alias("subdomains"),
    )


def config_lines(lines: DataFrame) -> DataFrame:
    """N-11: columns directive and setting of key-value lines (column value); comments and blank lines are left out."""
    text = F.trim(F.regexp_replace("value", r"\s+#.*$", ""))
    rows = lines.withColumn("value", F.regexp_replace("value", r"^\s+|\s+$", "")).where("value <> '' and not startswith(value, '#')")
    return rows.select(*[c for c in lines.columns if c != "value"], F.regexp_extract(text, r"^(\S+)", 1).alias("directive"), F.regexp_extract(text, r"^\S+\s+(.*)$", 1).alias("setting"))


def guard(line: Column) -> Column:
    """N-11: struct (name, fingerprint, sampled_on) of a guard line; a bare fingerprint may stand second."""
    first = lambda p: F.nullif(F.regexp_extract(line, p, 1), F.lit(""))
    at = F.try_to_timestamp(F.translate(first(r"(?:^|\s)sampled_on=(\S+)"), "TZ", " "), F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.struct(first(r"(?:^|\s)in=(\S+)").alias("name"), F.coalesce(first(r"(?:^|\s)rsa_id=(\S+)"), first(r"^\s*\S+\s+([0-9A-Fa-f]{40})(?:\s|$)")).alias("fingerprint"), at.alias("sampled_on"))


def cookie_blocks(texts: DataFrame) -> DataFrame:
    """N-13: cookies of files with a line for each field, blocks parted by a line with a star (columns id, text)."""
    lines = F.transform(F.split(F.trim("block", F.lit(" \t\r\n")), "\n"), lambda x: F.trim(x, F.lit(" \t\r")))
    rows = texts.select("id", F.explode(F.split("text", r"\r?\n\*\r?\n")).alias("block")).select("id", lines.alias("l")).where("size(l) >= 3")
    low, high, flags = (F.get("l", k).try_cast("long") for k in (3, 4, 7))
    place, flag = F.get("l", 2), F.coalesce(flags, F.lit(0))
    return rows.select(
        "id", F.get("l", 0).alias("name"), F.get("l", 1).alias("value"), F.substring_index(place, "/", 1).alias("domain"), F.concat(F.lit("/"), F.regexp_extract(place, "^[^/]*/(.*)$", 1)).alias("path"),
        F.when(high > 0, S.from_filetime(F.shiftleft(high, 32).bitwiseOR(low))).alias("expires"), (flag.bitwiseAND(F.lit(1)) != 0).alias("secure"), (flag.bitwiseAND(F.lit(2)) != 0).alias("http_only"),
    )


def cookie_lines(texts: DataFrame) -> DataFrame:
    """N-13: cookies of files with one tab-separated line each (columns id, text)."""
    rows = texts.select("id", F.explode(F.split("text", r"\r?\n")).alias("line")).select("id", F.trim("line", F.lit(" \r\n")).alias("line")).where("line <> '' and not startswith(line, '#')")
    rows = rows.select("id", F.split("line", "\t").alias("p")).where("size(p) >= 7")
    until = F.get("p", 4).try_cast("long")
    return rows.select("id", F.get("p", 5).alias("name"), F.get("p", 6).alias("value"), F.get("p", 0).alias("domain"), F.get("p", 2).alias("path"), F.when(until > 0, F.timestamp_seconds(until)).alias("expires"), (F.lower(F.get("p", 3)) == "true").alias("secure"), F.lit(False).alias("http_only"))


def shortcuts(files: DataFrame) -> DataFrame:
    """N-14: (path, title, url, folder) of shortcut files (columns path, text); files without a URL are left out."""
    path = slashed(F.col("path"))
    url = F.trim(F.regexp_extract("text", r"(?im)^[ \t]*url[ \t]*[=:]([^\r\n]*)", 1))
    rows = files.select("path", F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"(?i)\.url$", "").alias("title"), url.alias("url"), F.regexp_extract(path, "(?i)/favorites/(?:(.*)/)?[^/]*$", 1).alias("folder"))
    return rows.where("url <> ''")
