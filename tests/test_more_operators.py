"""Long lists, exact roundings, sinks over several batches, deep trees and odd cases, on literal rows."""

import random

import pytest
from pyspark.sql import functions as F

from casemill.functions import codes
from casemill.functions import scalars as S
from casemill.operators import artifacts, matching, records, textmine
from casemill.sources import readers
from casemill.streaming import feeds


def rules_of(name, patterns, regex=False):
    return [(name, k, p, matching.url_rule(p, regex)) for k, p in enumerate(patterns)]


def test_long_lists(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(2, 6)))
    hosts = [f"{word()}.{word()}" for _ in range(60)]
    urls = [(k, f"HTTP://{rng.choice(hosts)}/{word()}?q={word()}") for k in range(200)] + [(900, None), (901, "")]
    plain = [word() + rng.choice(["", ".", "/"]) + word() for _ in range(5000)]
    wild = [f"*{a}*{b}" + rng.choice(["*", "?", ""]) for a, b in ((word(), word()) for _ in range(300))] + ["*", "http://?*"]
    odd = ["[a-c]{3}\\.", "(broken", "^http://a", "\\d"]
    rules = rules_of("plain", plain) + rules_of("wild", wild[:300]) + rules_of("odd", odd, True) + rules_of("all", ["zz", "*"]) + rules_of("http", ["http://?*"])
    rows = spark.createDataFrame(urls, "id long, url string")
    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t)
    import fnmatch
    import re

    expected = []
    for i, u in urls:
        for name, patterns in (("plain", plain), ("wild", wild[:300]), ("odd", odd), ("all", ["zz", "*"]), ("http", ["http://?*"])):
            for p in patterns if u is not None else ():
                if name == "odd":
                    hit = p != "(broken" and re.search(p, u, re.I | re.A)
                else:
                    hit = fnmatch.fnmatchcase(lower(u), lower(p)) if "*" in p or "?" in p else lower(p) in lower(u)
                if hit:
                    expected.append((i, name, p))
                    break
    assert sorted(map(tuple, matching.match_patterns(rows, "url", rules).collect())) == sorted(expected)
    few = rules_of("wild", wild[:60]) + rules_of("plain", plain[:70]) + rules_of("odd", odd, True)
    ways = [sorted(map(tuple, way(rows, "url", few).collect())) for way in (matching._by_cases, matching._by_automaton)]
    assert ways[0] == ways[1] and len(few) <= matching.FLAT
    assert matching.match_patterns(rows, "url", []).count() == 0


def test_exact_roundings(spark):
    values = [0, 1, 1023, 1024, 1280, 1331, 1536, 1587, 1638, 52480, 1048576, 1310720, 1363149, 5 * 1024**3 + 12345678, 3 * 1024**4]
    rows = spark.createDataFrame([(v,) for v in values], "n long").select("n", S.size_text(F.col("n")).alias("t")).collect()
    def text(n):
        for unit in ("B", "KB", "MB", "GB"):
            if n < 1024:
                return f"{n} B" if unit == "B" else f"{n:.1f} {unit}"
            n /= 1024
        return f"{n:.1f} TB"
    assert [r.t for r in rows] == [text(v) for v in values] and text(1280) == "1.2 KB"
    seconds = list(range(0, 90_000, 180)) + list(range(90_000, 2_000_000, 7560))
    rows = spark.createDataFrame([(v,) for v in seconds], "n long").select(S.duration_text(F.col("n")).alias("t"), S.span_text(F.col("n")).alias("s")).collect()
    for v, r in zip(seconds, rows):
        h = v / 3600
        assert r.t == (f"{h:.1f} hours" if h < 24 else f"{h / 24:.1f} days" if h < 168 else f"{h / 168:.1f} weeks"), v
        parts = [(v // 3600, "h"), (v % 3600 // 60, "m"), (v % 60, "s")]
        assert r.s == (" ".join(f"{n}{u}" for n, u in parts if n) or "0s")
    assert spark.range(1).select(S.span_text(F.lit(-5)).alias("s"), S.span_text(F.lit(3661)).alias("t")).first()[:] == ("0s", "1h 1m 1s")


def test_local_dates(spark):
    cases = [
        ("2024-01-02T03:04:05Z", "02.01.2024 03:04:05", "01/02/2024"), ("2024-01-02 03:04:05.123456+00:00", "02.01.2024 03:04:05", "01/02/2024"), ("2024-01-02", "02.01.2024", "01/02/2024"), ("31.12.2023 23:59", "31.12.2023 23:59:00", "12/31/2023"),
        ("12/31/2023 23:59:58 UTC", "31.12.2023 23:59:58", "12/31/2023"), ("soon", "soon", "soon"), ("", "", ""), (None, "", ""), (" 2024-01-02T03:04 ", "02.01.2024 03:04:00", "01/02/2024"),
    ]
    got = spark.createDataFrame([(c[0],) for c in cases], "t string").select(S.local_date_text(F.col("t")).alias("eu"), S.local_date_text(F.col("t"), "us", time=False).alias("us")).collect()
    assert [tuple(r) for r in got] == [c[1:] for c in cases]


def test_public_suffix_rules(spark):
    rules = ["com", "uk", "co.uk", "ck", "*.ck", "!www.ck", "compute.amazonaws.example", "example"]
    cases = {"a.b.example.com": "example.com", "x.shop.co.uk": "shop.co.uk", "co.uk": "co.uk", "a.b.c.ck": "b.c.ck", "www.ck": "www.ck", "x.www.ck": "www.ck", "vm.eu.compute.amazonaws.example:80": "eu.compute.amazonaws.example", "localhost": "localhost", "10.0.0.1": "10.0.0.1", "a.unknown": "a.unknown"}
    got = spark.createDataFrame([(h,) for h in cases], "h string").select(S.registered_domain(F.col("h"), rules).alias("s")).collect()
    assert [r.s for r in got] == list(cases.values())


def test_sinks_keep_and_replace(spark, tmp_path):
    runs = spark.createDataFrame([(1, 10), (1, 11), (2, 20)], "run long, v long")
    for k in range(3):
        runs.offset(k).limit(1).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    feed = spark.readStream.schema("run long, v long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    feeds.run_sink(feed, str(tmp_path / "out"), str(tmp_path / "cp"), ["run"]).awaitTermination()
    assert sorted((r.run, r.v) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 10), (1, 11), (2, 20)]
    path = str(tmp_path / "t")
    readers.replace_partition(runs, path, ["run"])
    readers.replace_partition(runs.limit(0), path, ["run"], [(1,), (7,)])
    assert [(r.run, r.v) for r in spark.read.parquet(path).collect()] == [(2, 20)]


def test_raw_urls(spark, tmp_path):
    (tmp_path / "raw").write_bytes(b"\0HTTPS://Www.Example.com/A<b>\xffhttp://x.example/a|b http://localhost/abcdefgh\0http://-bad.example/ ")
    assert sorted(r.url for r in readers.urls_in_files(spark, str(tmp_path / "raw")).collect()) == ["HTTPS://Www.Example.com/A", "http://x.example/a"]


def test_paths_at_any_depth(spark):
    chain = [(k, k - 1 if k else 0, f"n{k}") for k in range(40)]
    rows = chain + [(100, 101, "a"), (101, 100, "b"), (102, 100, "c"), (200, None, "root"), (201, 999, "orphan"), (202, 201, "x")]
    got = {r.id: r.path for r in records.paths(spark.createDataFrame(rows, "id long, parent long, name string")).collect()}
    assert got[39] == "/".join(f"n{k}" for k in range(40)) and got[0] == "n0"
    assert got[100] is got[101] is got[102] is None and got[200] == "root" and got[202] == "orphan/x" and len(got) == len(rows)
    assert records.paths(spark.createDataFrame([], "id long, parent long, name string")).count() == 0


def test_log_blocks(spark, monkeypatch):
    lines = [("f", k, ("H" if k % 7 == 3 else " ") + str(k)) for k in range(60)] + [(None, 0, "Hx"), (None, 1, " y"), ("g", 0, None)]
    rows = spark.createDataFrame(lines, "path string, line long, text string")
    whole = sorted(map(tuple, records.log_entries(rows, F.col("text").startswith("H")).collect()), key=str)
    monkeypatch.setattr(records, "LINES", 4)
    assert sorted(map(tuple, records.log_entries(rows, F.col("text").startswith("H")).collect()), key=str) == whole
    assert ("f", 1, 7, "\n".join(("H" if k == 3 else " ") + str(k) for k in range(3, 10))) in whole and (None, 1, 2, "Hx\n y") in whole


def test_json_walk(spark):
    docs = [(1, '{"a":{"b":{"c":{"d":[1,[2,{"url":"u"}]],"exp":7,"x":null}}},"email":"m"}'), (2, "[true]"), (3, "no json"), (4, None), (5, "{}"), (6, '"text"')]
    got = {(r.id, r.path): (r.value, r.kind, r.at) for r in textmine.json_fields(spark.createDataFrame(docs, "id long, doc string"), "doc").collect()}
    assert got == {(1, "a.b.c.d[0]"): ("1", None, None), (1, "a.b.c.d[1][0]"): ("2", None, None), (1, "a.b.c.d[1][1].url"): ("u", "url", None), (1, "a.b.c.exp"): ("7", None, "7"), (1, "a.b.c.x"): (None, None, "7"), (1, "email"): ("m", "email", None), (2, "[0]"): ("true", None, None)}


def test_labels(spark):
    value = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert value(codes.label("block_list_type", F.lit(None).cast("int"))) == "Unknown" and value(codes.label("block_list_type", F.lit(2))) == "Type 2"
    assert value(codes.icon_flags(F.lit(9))) == "FAVICON|WEB_MANIFEST_ICON" and value(codes.icon_flags(F.lit(16))) == "UNKNOWN_16"
    assert value(codes.label("profile_token_type", F.lit(8))) == "UNKNOWN_8" and value(codes.label("content_preference", F.lit("x.y"))) == "x.y"


def test_sessions(spark):
    doc = '{"windows":[{"selected":1,"tabs":[{"entries":[{"url":"a"},{"url":"b","title":"B"}],"index":2,"lastAccessed":1000},{"entries":[],"index":1},{"entries":[{"url":"c"}],"index":9}],"_closedTabs":[{"state":{"entries":[{"url":"d"}],"index":1},"title":"D","closedAt":2000}]}]}'
    rows = artifacts.session_tabs(spark.createDataFrame([(1, doc), (2, "{}"), (3, None)], "id long, doc string")).orderBy("closed", "tab").collect()
    assert [(r.tab, r.closed, r.url, r.title, r.selected, r.entries) for r in rows] == [(0, False, "b", "B", True, 2), (1, False, "", "", False, 0), (2, False, "", "", False, 1), (0, True, "d", "D", False, 1)]


def test_sort_options(spark):
    rows = spark.createDataFrame([(1, None), (2, "b"), (3, "a")], "id long, v string")
    order = lambda *o: [r.id for r in artifacts.sorted_by(rows, [("v", *o)]).collect()]
    assert order("ASC", "LAST") == [3, 2, 1] and order("ASC", "FIRST") == [1, 3, 2] and order("DESC", "FIRST") == [1, 2, 3]
    with pytest.raises(KeyError):
        order("UP", "LAST")


def test_entry_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); assert 'A-3' in q and set(o) <= set(q); print(len(q), len(o))"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, check=True)


def test_workspace_leaves_nothing(spark):
    import os

    from casemill.operators import similarity
    from casemill.tables import shared_folder, workspace

    images = spark.createDataFrame([(k, f"{k % 7:016x}") for k in range(40)], "id int, phash string")
    before = set(os.listdir(shared_folder(spark)))
    with workspace(spark):
        assert similarity.leader_clusters(images, 3).count() == 40
        assert set(os.listdir(shared_folder(spark))) != before
    assert set(os.listdir(shared_folder(spark))) == before
