"""Matching against reference lists: URL and file-name patterns, hashes, known names."""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.functions import scalars as S

#: A list up to this many rows is broadcast.
BROADCAST_ROWS = 100_000
#: The expression of a rule that fits nothing.
NOTHING = "(?!)"
#: Up to so many rules become CASE expressions, in groups of so many behind one folded test.
FLAT, GROUP = 200, 50


def small(lists: DataFrame) -> DataFrame:
    return F.broadcast(lists) if lists.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else lists


def literal(text: str) -> str:
    return "".join(c if c.isalnum() else "\\" + c if ord(c) < 128 else c for c in text)


def url_rule(pattern: str, is_regex: bool) -> str:
    """The regular expression of a URL pattern: as it is, anchored wildcards, or a substring; without case. A broken one fits nothing.

    Regular expressions are Python's, whatever the length of the list.
    """
    if is_regex:
        try:
            compiled(f"(?i){pattern}")
        except (re.error, RecursionError, OverflowError):
            return NOTHING
        return f"(?i){pattern}" if pattern.isascii() else f"(?i){pattern}(?:)"  # not to be taken for a substring, which folds ASCII only
    return S.fnmatch_regex(pattern) if "*" in pattern or "?" in pattern else f"(?i){literal(pattern)}"


def is_plain(pattern: str, regex: str) -> bool:
    """Whether a rule is a substring or a wildcard without classes, which mean the same to Spark and to Python."""
    return regex == f"(?i){literal(pattern)}" or "[" not in pattern and regex == S.fnmatch_regex(pattern)


def match_patterns(rows: DataFrame, text: str, rules: list[tuple[str, int, str, str]]) -> DataFrame:
    """J-2, J-4, W-3: (id, list_name, pattern): the first pattern in file order of each list that fits.

    rules: (list_name, idx, pattern, regular expression); letters are compared without case where they are ASCII (in
    regular expressions all are). Rows are neither joined nor shuffled. Lists of substrings and wildcards become flat CASE
    expressions as long as they are short; longer ones, and every list with a regular expression, go through Python
    in Arrow batches: an automaton finds all literal patterns in one pass, and regular expressions share one alternation.
    """
    other = {name for name, _, pattern, regex in rules if not is_plain(pattern, regex)}
    short = [r for r in rules if r[0] not in other]
    if len(short) > FLAT:
        return _by_automaton(rows, text, rules)
    if not other:
        return _by_cases(rows, text, rules)
    rest = _by_automaton(rows, text, [r for r in rules if r[0] in other])
    return _by_cases(rows, text, short).union(rest) if short else rest


def _by_cases(rows: DataFrame, text: str, rules: list[tuple[str, int, str, str]]) -> DataFrame:
    found = [F.struct(F.lit("").alias("list_name"), F.lit(None).cast("string").alias("pattern"))]
    for name in sorted({r[0] for r in rules}):
        own = sorted((r for r in rules if r[0] == name), key=lambda r: r[1])
        groups = []
        for k in range(0, len(own), GROUP):
            case = F
            for _, _, pattern, regex in own[k : k + GROUP]:
                case = case.when(F.col(text).rlike(regex), F.lit(pattern))
            groups.append(F.when(F.col(text).rlike("|".join(f"(?:{r[3]})" for r in own[k : k + GROUP])), case))
        found.append(F.struct(F.lit(name).alias("list_name"), F.coalesce(*groups).alias("pattern")))
    return rows.select("id", F.explode(F.array(*found)).alias("m")).where("m.pattern is not null").select("id", "m.*")


def compiled(regex: str) -> re.Pattern:
    """A rule's expression; its leading mark is the flag, so that flags of its own may follow."""
    return re.compile(regex[4:], re.I) if regex.startswith("(?i)") else re.compile(regex)


class Rules:
    """The rules of one list: an automaton over literal patterns and literal parts of wildcards, and what has no such part."""

    def __init__(self, own: list[tuple[int, str, str]]):
        import ahocorasick

        self.patterns = [pattern for _, pattern, _ in sorted(own, key=lambda r: r[0])]
        self.tests: list = []
        anchors: dict[str, list[int]] = {}
        self.free: list[int] = []
        joined: list[int] = []
        for place, (_, pattern, regex) in enumerate(sorted(own, key=lambda r: r[0])):
            plain = regex == f"(?i){literal(pattern)}"
            wild = regex == S.fnmatch_regex(pattern)
            anchor = pattern if plain else max(re.split(r"[*?\[\]]", pattern), key=len) if wild and "[" not in pattern else ""
            test = None if plain else re.compile(regex, re.A) if wild else compiled(regex)
            self.tests.append(test)
            if anchor:
                anchors.setdefault(lowered(anchor), []).append(place)
            elif regex == NOTHING:
                continue
            elif test is not None and not wild and regex.startswith("(?i)") and not test.groups and not re.match(r"\(\?[a-zA-Z]+\)", regex[4:]):
                joined.append(place)  # no groups and no flags of its own: it means the same inside an alternation
            else:
                self.free.append(place)
        self.automaton = ahocorasick.Automaton()
        for anchor, places in anchors.items():
            self.automaton.add_word(anchor, places)
        if anchors:
            self.automaton.make_automaton()
        by_place = {place: regex[4:] for place, (_, _, regex) in enumerate(sorted(own, key=lambda r: r[0]))}
        self.joined = [(part, re.compile("|".join(f"(?:{by_place[p]})" for p in part), re.I)) for part in (joined[k : k + GROUP] for k in range(0, len(joined), GROUP))]

    def first(self, text: str) -> str | None:
        candidates = set(self.free)
        for _, places in self.automaton.iter(lowered(text)) if len(self.automaton) else ():
            candidates.update(places)
        best = next((p for p in sorted(candidates) if self.tests[p] is None or self.tests[p].search(text)), None)
        for part, any_of in self.joined:  # in file order; single expressions are tried where one of the part fits
            if best is not None and part[0] > best:
                break
            if any_of.search(text):
                hit = next(p for p in part if self.tests[p].search(text))
                best = hit if best is None else min(best, hit)
                break
        return None if best is None else self.patterns[best]


def lowered(text: str) -> str:
    """ASCII letters in lower case."""
    return text.lower() if text.isascii() else "".join(c.lower() if c.isascii() else c for c in text)


def _by_automaton(rows: DataFrame, text: str, rules: list[tuple[str, int, str, str]]) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast(rules)  # lists are read by the caller, so their size is known
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        lists = {name: Rules([r[1:] for r in held.value if r[0] == name]) for name in sorted({r[0] for r in held.value})}
        for batch in batches:
            at, names, found = [], [], []
            for k, value in enumerate(batch.column(1).to_pylist()):
                for name, own in lists.items():
                    if value is not None and (pattern := own.first(value)) is not None:
                        at.append(k), names.append(name), found.append(pattern)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(names, pa.string()), pa.array(found, pa.string())], ["id", "list_name", "pattern"])

    return rows.select("id", text).mapInArrow(run, f"id {kind}, list_name string, pattern string")


def match_hashes(files: DataFrame, hashes: DataFrame, columns: tuple[str, ...] = ("md5", "sha1", "sha256")) -> DataFrame:
    """J-3, J-5: (id, list_name, hash) by the first of the hash columns that the list has."""
    entries = F.array(*[F.struct(F.lit(k).alias("rank"), F.lower(c).alias("hash")) for k, c in enumerate(columns)])
    long = files.select("id", F.explode(entries).alias("e")).where("e.hash is not null and e.hash <> ''").select("id", "e.*")
    hits = long.join(small(hashes.select("list_name", F.lower("hash").alias("hash")).distinct()), "hash")
    return hits.groupBy("id", "list_name").agg(F.min_by("hash", "rank").alias("hash"))


def lookup(files: DataFrame, entries: DataFrame) -> DataFrame:
    """J-6: the first entry by (list_name, entry id) whose md5 or sha256 is the file's: two equal joins, no OR."""
    by = [files.join(entries.select("entry_id", "list_name", F.lower(c).alias("h")), F.lower(F.col(c)) == F.col("h")).select("id", "list_name", "entry_id") for c in ("md5", "sha256")]
    return reduce(DataFrame.union, by).groupBy("id").agg(F.min(F.struct("list_name", "entry_id")).alias("m")).select("id", "m.*")


def match_file_names(files: DataFrame, lists: DataFrame) -> DataFrame:
    """J-4: (id, list_name, pattern): the first pattern in file order of each list that a file's name fits.

    files: id, file_name; lists: list_name, idx, pattern, is_regex. Names without wildcards, however many, are met by an
    equal join in lower case; only wildcards and regular expressions are rules that each name is tried with. A null name
    fits nothing. A regular expression may fit anywhere in the name, other patterns the whole of it.
    """
    plain = ~F.col("is_regex") & ~F.col("pattern").rlike(r"[*?\[]")
    exact = lists.where(plain).groupBy("list_name", F.lower("pattern").alias("name")).agg(F.min(F.struct("idx", "pattern")).alias("m"))
    hits = files.select("id", F.lower("file_name").alias("name")).join(small(exact), "name").select("id", "list_name", "m.idx", "m.pattern")
    rest = lists.where(~plain).orderBy("list_name", "idx").collect()  # reference lists, as the caller has read them
    rules = [(r["list_name"], r["idx"], r["pattern"], url_rule(r["pattern"], True) if r["is_regex"] else S.fnmatch_regex(r["pattern"])) for r in rest]
    places = lists.where(~plain).groupBy("list_name", "pattern").agg(F.min("idx").alias("idx"))
    tried = match_patterns(files.select("id", "file_name"), "file_name", rules).join(small(places), ["list_name", "pattern"]).select("id", "list_name", "idx", "pattern")
    return hits.union(tried).groupBy("id", "list_name").agg(F.min(F.struct("idx", "pattern")).alias("m")).select("id", "list_name", "m.pattern")


def match_stats(urls: DataFrame, matches: DataFrame) -> DataFrame:
    """A-41: by list and over all: matched URLs and records, beside the number of URLs."""
    total = urls.agg(F.count("*").alias("urls"))
    per = matches.rollup("list_name").agg(F.count_distinct("id").alias("matched"), F.count("*").alias("records"))
    return per.crossJoin(F.broadcast(total))  # one row


def known_names(rows: DataFrame, known: DataFrame, rules: list[tuple[str, int, str, str]]) -> DataFrame:
    """J-20: exact id first, else the first name pattern; (id, name)."""
    exact = rows.join(small(known), "key", "left").select("id", "label", "name")
    by_name = match_patterns(exact.where("name is null"), "label", rules).select("id", F.col("pattern").alias("by_name"))
    return exact.join(by_name, "id", "left").select("id", F.coalesce("name", "by_name").alias("name"))


def applications(rows: DataFrame, registry: DataFrame, unknown: str = "Unknown") -> DataFrame:
    """J-21: (id, appid, application, category, is_browser) by the application's id in any case; registry: (appid, application, category)."""
    known = registry.select(F.lower("appid").alias("known_appid"), "application", "category").dropDuplicates(["known_appid"])
    joined = rows.join(small(known), F.lower("appid") == F.col("known_appid"), "left")
    return joined.select("id", "appid", F.coalesce("application", F.lit(unknown)).alias("application"), F.coalesce("category", F.lit("unknown")).alias("category"), F.coalesce(F.col("category") == "browsers", F.lit(False)).alias("is_browser"))
