"""Windows, rollups and keyed writes over artifact records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemill.tables import table


def grouped_stats(df: DataFrame, by: list[str], aggs: dict[str, Column]) -> DataFrame:
    """A-14 to A-33: one aggregate over all and by each of the columns, in one pass of grouping sets."""
    sets = [[], *[[F.col(c)] for c in by]]
    return df.groupingSets(sets, *by).agg(*[a.alias(n) for n, a in aggs.items()])


def first_by(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """W-4, W-12: the first row of each key."""
    return df.groupBy(*key).agg(F.min_by(F.struct(*[c for c in df.columns if c not in key]), F.struct(*order)).alias("r")).select(*key, "r.*")


def last_by(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """W-5, W-6, S-13: the last row of each key."""
    return df.groupBy(*key).agg(F.max_by(F.struct(*[c for c in df.columns if c not in key]), F.struct(*order)).alias("r")).select(*key, "r.*")


def replayed(log: DataFrame, key: str, order: str, attributes: list[str], closing: Column) -> DataFrame:
    """W-7: the last value of each attribute since the latest close; keys that end closed are out."""
    place = F.struct(order, "seq")
    closed = log.where(closing).groupBy(key).agg(F.max(place).alias("closed"))
    live = log.join(closed, key, "left").where(F.col("closed").isNull() | (place > F.col("closed")))
    return live.groupBy(key).agg(*[F.max_by(a, F.when(F.col(a).isNotNull(), place)).alias(a) for a in attributes], F.count("*").alias("commands"))


def store_rollup(stores: dict[str, DataFrame], key: str) -> DataFrame:
    """A-28: counts of each store by key, their total and the stores that have it."""
    rows = reduce(DataFrame.unionByName, [df.select(key, F.lit(kind).alias("kind")) for kind, df in stores.items()])
    counts = [F.count_if(F.col("kind") == k).alias(k) for k in stores]
    return rows.groupBy(key).agg(*counts, F.count("*").alias("total"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("stores"))


def facets(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """A-36: (facet, value, n) of several columns."""
    cells = F.array(*[F.struct(F.lit(name).alias("facet"), F.col(c).cast("string").alias("value")) for name, c in columns.items()])
    return df.select(F.explode(cells).alias("x")).where("x.value is not null").groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


def drift(df: DataFrame, column: str, known: list[str]) -> DataFrame:
    """A-50: values that the known set lacks, with their number of rows."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(*known)).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def count_check(df: DataFrame, expected: DataFrame, run: str, tolerance: float) -> DataFrame:
    """A-40: runs with their number of rows, the expected one, and whether it is within the tolerance."""
    have = df.groupBy(run).agg(F.count("*").alias("n"))
    joined = expected.join(have, run, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return joined.withColumn("within", F.abs(F.col("n") - F.col("expected")) <= tolerance * F.col("expected"))


def roots(signals: DataFrame, known: list[str], at_least: int = 2) -> DataFrame:
    """A-44: application roots with several distinct signals that no known one explains."""
    found = signals.groupBy("root").agg(F.array_join(F.array_sort(F.collect_set("signal")), ",").alias("signals"), F.count_distinct("signal").alias("n"))
    return found.where((F.col("n") >= at_least) & ~F.col("root").isin(*known))


def appended(present: DataFrame, new: DataFrame, key: list[str], action: str) -> DataFrame:
    """S-11: rows after an append that ignores, replaces or refuses what is there already."""
    once = new.dropDuplicates(key)
    if action == "FAIL":
        if new.count() != once.count() or not present.join(new, key, "left_semi").isEmpty():
            raise ValueError(f"duplicate key {key}")
        return present.unionByName(new)
    if action == "IGNORE":
        return present.unionByName(once.join(present, key, "left_anti").select(*present.columns))
    return present.join(once, key, "left_anti").select(*present.columns).unionByName(once.select(*present.columns))


def upserted(present: DataFrame, new: DataFrame, key: list[str], keep: list[str] = ()) -> DataFrame:
    """S-13: the new row of a key wins, but for the columns to keep."""
    p, n = present.alias("p"), new.alias("n")
    joined = p.join(n, [F.col(f"p.{k}") == F.col(f"n.{k}") for k in key], "full_outer")
    choose = lambda c: F.coalesce(f"p.{c}", f"n.{c}") if c in keep else F.coalesce(f"n.{c}", f"p.{c}")
    return joined.select(*[choose(c).alias(c) for c in present.columns])


def paths(nodes: DataFrame) -> DataFrame:
    """J-18: (id, path): names from the root to each node by parent pointers, at any depth; null on a cycle or below one.

    A node that is its own parent, or whose parent is unknown, is a root. Each round doubles the part of the way that a
    path covers, so there are as many rounds as the depth has binary digits; each is a table in the shared folder.
    """
    known = nodes.select(F.col("id").alias("up"))
    linked = nodes.join(known, F.col("parent") == F.col("up"), "left")
    at = F.when(F.col("up") != F.col("id"), F.col("up"))
    now = table(linked.select("id", at.alias("at"), F.col("name").cast("string").alias("path")), "paths")
    rounds, n = 0, max(1, now.count())
    while 1 << rounds <= n and not now.where("at is not null").isEmpty():
        above = now.select(F.col("id").alias("up"), F.col("at").alias("next"), F.col("path").alias("before"))
        going = now.where("at is not null").join(above, F.col("at") == F.col("up"))
        now = table(now.where("at is null").union(going.select("id", F.col("next").alias("at"), F.concat("before", F.lit("/"), "path").alias("path"))), "paths")
        rounds += 1
    return now.select("id", F.when(F.col("at").isNull(), F.col("path")).alias("path"))


#: Lines of a log file that are numbered in one task.
LINES = 100_000


def log_entries(lines: DataFrame, header: Column, numbered_by_line: bool = False) -> DataFrame:
    """N-12: continuation lines joined to the header line before them; numbered_by_line adds the number of that line.

    A file is numbered in blocks of lines: headers are counted by block, the counts added up along the file's few
    blocks, and the lines of a block numbered on from there. So a very long file is not one task.
    """
    block = F.floor(F.col("line") / LINES).alias("block")
    marked = lines.select("path", "line", "text", block, F.coalesce(header, F.lit(False)).cast("long").alias("is_header"))
    along = Window.partitionBy("of").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    before = marked.groupBy(F.col("path").alias("of"), F.col("block").alias("at")).agg(F.sum("is_header").alias("n")).select("of", "at", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("before"))
    order = Window.partitionBy("path", "block").orderBy("line")
    running = marked.withColumn("inside", F.sum("is_header").over(order)).join(before, F.col("path").eqNullSafe(F.col("of")) & (F.col("block") == F.col("at")))
    numbered = running.select("path", "line", "text", (F.col("before") + F.col("inside")).alias("entry")).where("entry > 0")
    return numbered.groupBy("path", "entry").agg(*([F.min("line").alias("line")] if numbered_by_line else []), F.count("*").alias("lines"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"))
