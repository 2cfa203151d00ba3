"""S-10: URLs swept out of raw files of any size, by byte ranges of a Python data source."""

from __future__ import annotations

import re

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: What a URL looks like in raw bytes.
CHARACTERS = rb"a-zA-Z0-9\-._~:/?#\[\]@!$&'()*+,;=%"
START = re.compile(rb"(?i)https?://[a-z0-9][" + CHARACTERS + rb"]")
URL = re.compile(rb"(?i)https?://[a-z0-9][" + CHARACTERS + rb"]+")
RUN = re.compile(rb"[" + CHARACTERS + rb"]*")
MEMBERS = bytes(b for b in range(256) if RUN.fullmatch(bytes([b])))

#: Longer ones are no URLs, so a range reads so far beyond its end and a little more.
LONGEST = 2048
#: Bytes that are looked at first, and at most, in one step backwards; bytes of a range.
GLANCE, LOOK, SPLIT = 1 << 8, 1 << 16, 64 << 20
#: No URL begins in more bytes.
HEAD = 16
#: Bytes that a task gets at least, where there are that many; the opening of a file counts as so many; rows handed over together.
TOGETHER, OPENING, ROWS = 8 << 20, 1 << 16, 10_000


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path)) if re.match(r"^[a-z][a-z0-9+.-]*:/", path) else (fs.LocalFileSystem(), path)


def files_of(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of the files below a folder; names that begin with a dot or an underscore are left out."""
    system, inside = opened(path)
    info = system.get_file_info(inside)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else [i for i in system.get_file_info(fs.FileSelector(inside, recursive=True)) if i.is_file]
    depth = len(inside.rstrip("/"))
    return sorted((i.path, i.size) for i in found if info.is_file or not re.search(r"(^|/)[._]", i.path[depth:]))


def swept(read, size: int, start: int, end: int):
    """(offset, url) of the URLs that begin in [start, end); read(at, n) gives n bytes at a place.

    A run of URL characters holds one URL at most: the first that begins in it goes on to its end. So where a run crosses
    `start`, what lies before decides whether one has begun already; it is read backwards, in parts, as far as needed.
    """
    data = read(start, min(size, end + LONGEST + HEAD) - start)
    crossing = start > 0 and not read(start - 1, 1).rstrip(MEMBERS)
    run = RUN.match(data).end()
    for m in URL.finditer(data):
        if start + m.start() >= end:
            return
        if len(m.group()) >= LONGEST:
            continue
        if crossing and m.start() <= run and begun(read, start, data[:HEAD]):
            continue
        yield start + m.start(), m.group().decode("latin-1")


def begun(read, start: int, after: bytes) -> bool:
    """Whether a URL begins before `start` in the run of URL characters that goes on there; after: the bytes from there on."""
    at, rest, look = start, after, GLANCE
    while at > 0:
        n, look = min(look, at), min(LOOK, 4 * look)
        part = read(at - n, n)
        run = len(part.rstrip(MEMBERS))
        first = START.search(part[run:] + rest)
        if first and first.start() < n - run:
            return True
        if run > 0:
            return False
        at, rest = at - n, (part + rest)[:HEAD]
    return False


class Share(InputPartition):
    """What one task sweeps: (path, size, start, end) of stretches, each cut into its ranges by the task."""

    def __init__(self, stretches: list[tuple[str, int, int, int]]):
        self.stretches = stretches


def shares(files: list[tuple[str, int]], split: int) -> list[Share]:
    """Files dealt to tasks by their bytes: stretches of whole ranges of large ones, small ones together."""
    step, out, held, n = split * max(1, TOGETHER // split), [], [], 0
    for path, size in files:
        for at in range(0, size, step):
            end = min(size, at + step)
            held.append((path, size, at, end))
            n += end - at + OPENING
            if n >= TOGETHER:
                out.append(Share(held))
                held, n = [], 0
    return [*out, Share(held)] if held else out


class RawUrlReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self):
        return shares(files_of(self.path), self.split)

    def read(self, partition):
        system, _ = opened(self.path)
        found = []
        for path, size, first, last in partition.stretches:
            with system.open_input_file(path) as f:

                def read(at, n):
                    f.seek(at)
                    return f.read(n)

                for at in range(first, last, self.split):
                    found += [(path, o, u) for o, u in swept(read, size, at, min(last, at + self.split))]
                    if len(found) >= ROWS:
                        yield batch_of(found)
                        found = []
        yield batch_of(found)


def batch_of(found: list[tuple[str, int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.string()))], ["path", "offset", "url"])


class RawUrls(DataSource):
    """Format "raw_urls": path (a file or folder of a file system that all executors see), split (bytes of a range; a task has many small ones)."""

    @classmethod
    def name(cls):
        return "raw_urls"

    def schema(self):
        return "path string, offset long, url string"

    def reader(self, schema):
        return RawUrlReader(self.options["path"], int(self.options.get("split", SPLIT)))


def raw_urls(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """(path, offset, url) of all URLs, noise included, each once, whatever the ranges."""
    spark.dataSource.register(RawUrls)
    return spark.read.format("raw_urls").option("split", split).load(path)
