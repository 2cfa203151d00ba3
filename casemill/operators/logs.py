"""N-12: browser debug logs: lines of text files with their numbers, entries with their fields, URLs with their first and last time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casemill.operators.records import log_entries
from casemill.tables import table

# The header of an entry, "source: URL (line)" at the end of console messages, URLs in a text.
HEADER = r"^\[(\d{4})/(\d{6})(?:\.(\d+))?:(?:(\d+):(\d+):)?(\w+):([^\]]+)\]\s?"
CONSOLE = r",?\s*source:\s+(https?://\S+)\s+\((\d+)\)\s*$"
HTTP_URL = r"https?://[^\s\p{Z}\x1c-\x1f\x85<>\"'`,;\]{}]+"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, text) of text files, lines from 1 on. A file of any size is read in blocks, numbered by adding up their lines."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.rtrim(F.col("value"), F.lit("\r")).alias("text"))
    lines = table(raw, "log-lines")
    sizes = lines.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("path", "block", "first", before.alias("before"))
    return lines.join(starts, ["path", "block"]).select("path", (F.col("at") - F.col("first") + F.col("before") + 1).alias("line"), "text")


def _cleaned(url):
    return F.regexp_replace(url, "[.,;:]+$", "")


def debug_entries(lines: DataFrame) -> DataFrame:
    """(path, line, date, time, milliseconds, pid, tid, severity, source, message, console_url, console_line, urls) of each entry.

    lines: path, line, text. Lines without a header belong to the entry before them; those before the first header are left
    out. urls: what the message names besides its console source, in order, repeats included.
    """
    field = lambda k: F.nullif(F.regexp_extract("text", HEADER, k), F.lit(""))
    rows = log_entries(lines, F.col("text").rlike(HEADER), numbered_by_line=True).select(
        "path", "line", field(1).alias("date"), field(2).alias("time"), field(3).alias("milliseconds"), field(4).cast("long").alias("pid"), field(5).cast("long").alias("tid"),
        field(6).alias("severity"), field(7).alias("source"), F.regexp_replace("text", HEADER, "").alias("message"),
    )
    console = F.upper("source").startswith("CONSOLE")
    rows = rows.withColumns({
        "console_url": F.when(console, F.nullif(_cleaned(F.regexp_extract("message", CONSOLE, 1)), F.lit(""))),
        "console_line": F.when(console, F.nullif(F.regexp_extract("message", CONSOLE, 2), F.lit("")).cast("long")),
    })
    found = F.transform(F.regexp_extract_all("message", F.lit(HTTP_URL), F.lit(0)), _cleaned)
    return rows.withColumn("urls", F.filter(found, lambda u: (u != "") & ~u.eqNullSafe(F.col("console_url"))))


def debug_urls(entries: DataFrame) -> DataFrame:
    """(path, url, context, severity, source, first_seen, last_seen, n): each URL of a file once.

    Context, severity and source are those of its first appearance; within an entry the console source comes before the
    message. Times are the log's own texts (month, day / time), which hold no year, so first and last go by line.
    """
    kind = lambda url, context: F.struct(url.alias("url"), F.lit(context).alias("context"))
    console = F.filter(F.array(kind(F.col("console_url"), "console_source")), lambda x: x["url"].isNotNull())
    uses = entries.select("path", "line", "severity", "source", F.concat_ws("/", "date", "time").alias("time"), F.posexplode(F.concat(console, F.transform("urls", lambda u: kind(u, "message_body")))).alias("pos", "x"))
    order = F.struct("line", "pos")
    first = lambda c, name: F.min_by(c, order).alias(name)
    return uses.groupBy("path", F.col("x.url").alias("url")).agg(first("x.context", "context"), first("severity", "severity"), first("source", "source"), first("time", "first_seen"), F.max_by("time", order).alias("last_seen"), F.count("*").alias("n"))
