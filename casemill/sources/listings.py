"""S-6, S-7: file listings of many tools: encoding, delimiter and profile found for each file, all read to one schema."""

from __future__ import annotations

import csv
import io
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casemill.functions import scalars as S
from casemill.sources.readers import column_mapping

# The columns of the known listings, by what separates them.
PROFILES = {
    "tab": ("\t", {"file_name": "Filename", "file_path": "Full Path", "size_bytes": "Size (bytes)", "created_ts": "Created", "modified_ts": "Modified", "accessed_ts": "Accessed", "deleted": "Is Deleted"}),
    "comma": (",", {"file_name": "Name", "file_path": "Full Path", "size_bytes": "File Size", "created_ts": "Created Date", "modified_ts": "Modified Date", "accessed_ts": "Accessed Date", "deleted": "Deleted"}),
}
#: A header with so many of a profile's columns is of that profile.
ENOUGH = 4
COLUMNS = ("file_path", "file_name", "size_bytes", "created_ts", "modified_ts", "accessed_ts", "md5_hash", "sha1_hash", "sha256_hash", "deleted")
MARKS = {"UTF-16LE": b"\xff\xfe", "UTF-16BE": b"\xfe\xff", "UTF-8": b"\xef\xbb\xbf"}
LINE_ENDS = {"UTF-16LE": "\n\0", "UTF-16BE": "\0\n"}


@dataclass(frozen=True)
class Layout:
    """How a file is read: encoding, delimiter, profile (tab, comma, generic) and its header fields."""

    encoding: str
    delimiter: str
    profile: str
    header: tuple[str, ...]

    def mapping(self) -> dict[str, str]:
        """The header field of each column that the file has."""
        if self.profile == "generic":
            return column_mapping(list(self.header))
        known = {c: name for c, name in PROFILES[self.profile][1].items() if name in self.header}
        return column_mapping([h for h in self.header if h not in known.values()]) | known


def encoding_of(head: bytes, valid: bool) -> str:
    """By the byte order mark, else by where the zero bytes of a first line stand, else by whether all lines are UTF-8."""
    for name, mark in MARKS.items():
        if head.startswith(mark):
            return name
    zeros = [k % 2 for k, b in enumerate(head[:200]) if b == 0]
    if len(zeros) * 4 > len(head[:200]):
        return "UTF-16LE" if sum(zeros) * 2 > len(zeros) else "UTF-16BE"
    return "UTF-8" if valid else "ISO-8859-1"


def fields(line: str, delimiter: str) -> tuple[str, ...]:
    return tuple(next(csv.reader(io.StringIO(line), delimiter=delimiter), ()))


def layout_of(head: bytes, valid: bool) -> Layout:
    """The layout that a file's first line (bytes) asks for."""
    encoding = encoding_of(head, valid)
    if encoding in LINE_ENDS and len(head) % 2:  # with the first byte of its line end
        head = head[:-1]
    line = head.decode({"ISO-8859-1": "latin-1"}.get(encoding, encoding.lower()), "replace").lstrip("﻿").rstrip("\r\n\0")
    for profile, (delimiter, columns) in PROFILES.items():
        header = fields(line, delimiter)
        if sum(name in header for name in columns.values()) >= ENOUGH:
            return Layout(encoding, delimiter, profile, header)
    delimiter = max((",", "\t", ";"), key=lambda d: len(fields(line, d)))
    return Layout(encoding, delimiter, "generic", fields(line, delimiter))


def layouts(spark: SparkSession, path: str) -> dict[Layout, list[str]]:
    """The files below a path by their layout; one row for each file reaches the driver."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    first = F.min_by(F.col("value").cast("binary"), F.struct("block", "at"))
    files = lines.groupBy("file").agg(first.alias("head"), F.min(F.is_valid_utf8("value")).alias("valid"))
    out: dict[Layout, list[str]] = {}
    for r in files.orderBy("file").collect():
        out.setdefault(layout_of(bytes(r["head"]), r["valid"]), []).append(r["file"])
    return out


def file_of(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def profiles(spark: SparkSession, path: str) -> DataFrame:
    """S-7: (file, encoding, delimiter, profile, columns) of each file; columns: those of the one schema that it has."""
    rows = [(file_of(file), x.encoding, x.delimiter, x.profile, ",".join(c for c in COLUMNS if c in x.mapping())) for x, files in layouts(spark, path).items() for file in files]
    return spark.createDataFrame(rows, "file string, encoding string, delimiter string, profile string, columns string")


def whole_lines(lines: DataFrame, end: str) -> DataFrame:
    """(file, raw) of lines of two-byte characters that were cut at the bytes of a line end.

    Such bytes also stand across two characters; then a part has an odd number of bytes, and goes on up to the next
    odd one. Only files that have such parts, rare as they are, are put in order.
    """
    odd = F.octet_length("raw") % 2
    cut = F.broadcast(lines.where(odd == 1).select("file").distinct())  # a row for each file at most
    order = Window.partitionBy("file").orderBy("block", "at")
    parts = lines.join(cut, "file", "left_semi").withColumn("begins", 1 - F.coalesce(F.sum(odd).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2)
    parts = parts.withColumn("line", F.sum("begins").over(order))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", F.hex("raw").alias("hex")))), lambda x: x["hex"]), end.encode().hex())
    joined = parts.groupBy("file", "line").agg(F.unhex(text).alias("raw"))
    return lines.join(cut, "file", "left_anti").select("file", "raw").union(joined.select("file", "raw"))


def decoded(lines: DataFrame, encoding: str) -> DataFrame:
    """(file, text) of lines in UTF-16; what is broken becomes a replacement character."""

    def run(batches):
        for batch in batches:
            texts = [raw.decode(encoding, "replace") for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["file", "text"])

    return lines.mapInArrow(run, "file string, text string")


def _rows(spark: SparkSession, layout: Layout, files: list[str]) -> DataFrame:
    wide = layout.encoding in LINE_ENDS
    end = LINE_ENDS.get(layout.encoding, "\n")
    lines = spark.read.option("lineSep", end).text(files).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("raw"))
    lines = decoded(whole_lines(lines, end), layout.encoding) if wide else lines.select("file", (F.decode("raw", layout.encoding) if layout.encoding == "ISO-8859-1" else F.col("raw").cast("string")).alias("text"))
    lines = lines.select("file", F.rtrim(F.ltrim("text", F.lit("\ufeff")), F.lit("\r\n")).alias("line")).where("trim(line) <> ''")
    names = [f"c{k}" for k in range(len(layout.header))]
    cells = F.from_csv("line", ", ".join(f"{n} string" for n in names), {"sep": layout.delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE"})
    at = {c: names[layout.header.index(h)] for c, h in layout.mapping().items()}
    value = lambda c: F.nullif(F.trim(F.col("cells")[at[c]]), F.lit("")) if c in at else F.lit(None).cast("string")
    parsed = lines.select("file", cells.alias("cells"))
    is_header = reduce(Column.__and__, [F.coalesce(F.col("cells")[n], F.lit("")) == h for n, h in zip(names, layout.header)])
    return parsed.where(~is_header).select(F.substring_index("file", "/", -1).alias("file"), F.lit(layout.profile).alias("profile"), *[value(c).alias(c) for c in COLUMNS])


def listings(spark: SparkSession, path: str) -> DataFrame:
    """S-6: (file, profile, file_path, file_name, size_bytes, times, hashes, deleted) of every row of the listings below a path.

    Files may differ in encoding (UTF-8, UTF-16 of either order with or without a mark, Latin-1), delimiter and columns.
    Lines that repeat the header, empty ones and rows without path and name are left out; a size that is no number and
    a time of unknown form are null. A quoted field does not go over lines.
    """
    found = layouts(spark, path)
    if not found:
        return spark.createDataFrame([], "file string, profile string, file_path string, file_name string, size_bytes long, created_ts timestamp, modified_ts timestamp, accessed_ts timestamp, md5_hash string, sha1_hash string, sha256_hash string, deleted boolean")
    rows = reduce(DataFrame.union, [_rows(spark, layout, files) for layout, files in found.items()])
    file_path = F.coalesce("file_path", "file_name")
    return rows.where(file_path.isNotNull()).select(
        "file", "profile", file_path.alias("file_path"), F.coalesce("file_name", S.file_name(file_path)).alias("file_name"),
        F.expr("try_cast(replace(size_bytes, ',', '') as bigint)").alias("size_bytes"), *[S.parsed(F.col(c)).alias(c) for c in ("created_ts", "modified_ts", "accessed_ts")],
        "md5_hash", "sha1_hash", "sha256_hash", S.truth(F.col("deleted")).alias("deleted"),
    )
