"""Whitelisted filters, orders and paging over one artifact table (F-1, F-2 and the typed filters built on them)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TableSpec:
    """Columns of an artifact table, those that may be filtered and sorted by, its key, and its tag type."""

    name: str
    filters: dict[str, tuple[str, ...]]
    sorts: tuple[str, ...]
    key: tuple[str, ...] = ("id",)
    excluded: tuple[str, ...] = field(default=())


def condition(spec: TableSpec, column: str, op: str, value):
    if op not in spec.filters.get(column, ()):
        raise ValueError(f"{spec.name}: no filter {op} on {column}")
    c = F.col(column)
    return {"EQ": lambda: c == value, "LIKE": lambda: c.ilike(value), "GTE": lambda: c >= value, "LTE": lambda: c <= value, "IN": lambda: c.isin(*value)}[op]()


def get_rows(df: DataFrame, spec: TableSpec, filters=(), order=(), limit: int | None = None, offset: int = 0) -> DataFrame:
    for column, op, value in filters:
        df = df.where(condition(spec, column, op, value))
    if unknown := [c for c, _ in order if c not in spec.sorts]:
        raise ValueError(f"{spec.name}: no order by {unknown}")
    if order:
        df = df.orderBy(*[F.col(c).asc_nulls_first() if way == "ASC" else F.col(c).desc_nulls_last() for c, way in order])
    df = df.offset(offset) if offset else df
    df = df.limit(limit) if limit is not None else df
    return df.drop(*spec.excluded)


def count_rows(df: DataFrame, spec: TableSpec, filters=()) -> DataFrame:
    return get_rows(df, spec, filters).agg(F.count("*").alias("n"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column)


def tagged(df: DataFrame, associations: DataFrame, kind: str, tags: list[str] | None = None) -> DataFrame:
    """Rows with any tag, or with one of the named ones (F-5, F-10)."""
    own = associations.where(F.col("artifact_type") == kind)
    own = own.where(F.lower("tag").isin(*[t.lower() for t in tags])) if tags else own
    return df.join(own.select(F.col("artifact_id").alias("id")), "id", "left_semi")


def matched(df: DataFrame, matches: DataFrame, state: str) -> DataFrame:
    """Rows that a list matches, that none does, or that the named list does (F-4)."""
    ids = matches.select("id") if state in ("matched", "unmatched") else matches.where(F.col("list_name") == state).select("id")
    return df.join(ids, "id", "left_anti" if state == "unmatched" else "left_semi")


def tag_and_match(df: DataFrame, associations: DataFrame, kind: str, tags: list[str], matches: DataFrame, lists: list[str], both: bool) -> DataFrame:
    """Rows with one of the tags and (or) a match of one of the lists (F-9)."""
    t = associations.where((F.col("artifact_type") == kind) & F.col("tag").isin(*tags)).select(F.col("artifact_id").alias("id")).distinct().withColumn("t", F.lit(True))
    m = matches.where(F.col("list_name").isin(*lists)).select("id").distinct().withColumn("m", F.lit(True))
    flagged = df.join(t, "id", "left").join(m, "id", "left")
    has = (F.coalesce("t", F.lit(False)), F.coalesce("m", F.lit(False)))
    return flagged.where(has[0] & has[1] if both else has[0] | has[1]).drop("t", "m")
