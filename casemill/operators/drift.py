"""A-50: what the data holds and the parsers do not know: tables, columns, values, JSON keys."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.operators.matching import small
from casemill.tables import table

#: Tables of the stores themselves. Fixed values.
SYSTEM = ("sqlite_", "android_")
SAMPLE = 50
KINDS = {"OBJECT": "dict", "ARRAY": "list", "STRING": "str", "BOOLEAN": "bool", "BIGINT": "int", "DECIMAL": "float", "DOUBLE": "float", "VOID": "NoneType"}


def unknown_tables(tables: dict[str, DataFrame], known: set[str], patterns: list[str] = ()) -> list[tuple[str, str]]:
    """(name, columns) of tables that are not known; with patterns only those that one of them is found in, without case."""
    fits = re.compile("|".join(patterns), re.I) if patterns else None
    return [(name, ",".join(df.columns)) for name, df in sorted(tables.items()) if name not in known and not name.startswith(SYSTEM) and (not fits or fits.search(name))]


def unknown_columns(df: DataFrame, known: set[str]) -> list[tuple[str, str]]:
    """(name, type) of columns that are not known."""
    return sorted((c, kind) for c, kind in df.dtypes if c not in known)


def unknown_values(df: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """(value, n): values of a column that the known ones (column value) lack; nulls are none."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    return counts.join(small(known.select(F.col("value").cast("string").alias("value")).distinct()), "value", "left_anti")


def json_keys(df: DataFrame, column: str, depth: int = 3) -> DataFrame:
    """(path, type, n, sample) of the keys of JSON objects, those inside objects by dotted paths, down to `depth` levels below the top.

    Lists are not entered. n: how many values stand under the path with that type; sample: the smallest of them as text, cut
    to 50 characters (<dict>, <list> for nested ones). Keys are added up at every level before they are shuffled.
    """
    current, levels = df.select(F.try_parse_json(column).alias("v"), F.lit("").alias("at")), []
    for level in range(depth + 1):
        objects = current.where(F.schema_of_variant("v").startswith("OBJECT"))
        if level and objects.isEmpty():
            break
        each = objects.lateralJoin(objects.sparkSession.tvf.variant_explode(F.col("v").outer()).select("key", F.col("value").alias("inner")))
        path = F.when(F.col("at") == "", F.col("key")).otherwise(F.concat("at", F.lit("."), "key"))
        kind = F.regexp_extract(F.schema_of_variant("inner"), "^([A-Z]+)", 1)
        rows = table(each.select(path.alias("path"), kind.alias("kind"), F.to_json("inner").alias("json"), F.try_variant_get("inner", "$", "string").alias("text")), "json-keys")
        name = reduce(lambda c, k: c.when(F.col("kind") == k, KINDS[k]), KINDS, F).otherwise(F.lower("kind"))
        sample = F.when(F.col("kind") == "OBJECT", "<dict>").when(F.col("kind") == "ARRAY", "<list>").otherwise(F.substring(F.coalesce("text", F.lit("None")), 1, SAMPLE))
        levels.append(rows.groupBy("path", name.alias("type")).agg(F.count("*").alias("n"), F.min(sample).alias("sample")))
        current = rows.where("kind = 'OBJECT'").select(F.try_parse_json("json").alias("v"), F.col("path").alias("at"))
    return reduce(DataFrame.union, levels)


def unknown_json_keys(df: DataFrame, column: str, known: DataFrame, depth: int = 3) -> DataFrame:
    """(path, type, n, sample) of JSON keys whose path the known ones (column path) lack."""
    return json_keys(df, column, depth).join(small(known.select("path").distinct()), "path", "left_anti").select("path", "type", "n", "sample")


def drift_report(tables: dict[str, DataFrame], known_columns: dict[str, set[str]], values: list[tuple[str, str, DataFrame]] = (), json: list[tuple[str, str, DataFrame]] = (), patterns: list[str] = ()) -> DataFrame:
    """(what, source, item, detail, n): one warning for each distinct unknown table, column, value and JSON key.

    known_columns: the columns of each known table; values, json: (table, column, known) with the known ones as a table.
    n is null for tables and columns, whose names come from the catalog.
    """
    spark = next(iter(tables.values())).sparkSession
    named = [("unknown_table", name, name, columns) for name, columns in unknown_tables(tables, set(known_columns), patterns)]
    named += [("unknown_column", name, c, kind) for name, known in sorted(known_columns.items()) if name in tables for c, kind in unknown_columns(tables[name], known)]
    parts = [spark.createDataFrame(named, "what string, source string, item string, detail string").withColumn("n", F.lit(None).cast("long"))]
    for name, column, known in values:
        parts.append(unknown_values(tables[name], column, known).select(F.lit("unknown_enum_value").alias("what"), F.lit(f"{name}.{column}").alias("source"), F.col("value").alias("item"), F.lit(None).cast("string").alias("detail"), "n"))
    for name, column, known in json:
        parts.append(unknown_json_keys(tables[name], column, known).select(F.lit("unknown_json_key").alias("what"), F.lit(f"{name}.{column}").alias("source"), F.col("path").alias("item"), F.concat_ws(" ", "type", "sample").alias("detail"), "n"))
    return reduce(DataFrame.union, parts)
