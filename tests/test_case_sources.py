"""Raw sweeps in ranges, listing profiles, suffix tables, drift and streams on small inputs against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from casemill.functions import scalars as S
from casemill.operators import domains, drift
from casemill.sources import listings, raw, readers
from casemill.streaming import feeds


def one_pass(data: bytes):
    return [(m.start(), m.group().decode()) for m in raw.URL.finditer(data) if len(m.group()) < raw.LONGEST]


@pytest.mark.parametrize("seed", range(6))
def test_ranges_give_what_one_pass_gives(seed, monkeypatch):
    monkeypatch.setattr(raw, "LOOK", 16 + seed)
    rng = random.Random(seed)
    parts = [b"http://", b"HTTPS://", b"a", b"b.com/x", b"\0", b" ", b"http", b"://", b"q" * 30, b"h", b"http://http://x", b"\xff\n", b"z" * (2030 if seed % 2 else 40)]
    data = b"".join(rng.choice(parts) for _ in range(400))
    for split in (1, 2, 3, 7, 50, 333, 10**6):
        if split < 7 and seed % 2:
            continue
        found = [x for at in range(0, len(data), split) for x in raw.swept(lambda a, n: data[a : a + n], len(data), at, min(len(data), at + split))]
        assert found == one_pass(data)


def test_raw_files(spark, tmp_path):
    data = b"".join(b"\0https://host%d.example.com/path/%d\x01" % (k, k) for k in range(500)) + b"http://localhost/abcdefghij "
    (tmp_path / "sub").mkdir()
    (tmp_path / "one.bin").write_bytes(data)
    (tmp_path / "sub" / "two.bin").write_bytes(data[:100])
    (tmp_path / "empty.bin").write_bytes(b"")
    (tmp_path / "_SUCCESS").write_bytes(data)
    rows = readers.urls_in_files(spark, str(tmp_path), 64).collect()
    expected = [(str(tmp_path / name), o, u) for name, own in (("one.bin", data), ("sub/two.bin", data[:100])) for o, u in one_pass(own) if "localhost" not in u]
    assert sorted(tuple(r) for r in rows) == sorted(expected)
    assert readers.urls_in_files(spark, "file:" + str(tmp_path / "one.bin")).count() == 500
    with pytest.raises(Exception, match="none.bin"):
        readers.urls_in_files(spark, str(tmp_path / "none.bin")).count()


def test_listing_profiles(spark, tmp_path):
    tab = "Filename\tFull Path\tSize (bytes)\tCreated\tIs Deleted\tMD5\nä.txt\t/x/ä.txt\t1,024\t2024-01-02 03:04:05\tYes\tabc\n\tC:\\only\\path.doc\tx\t\t\t\n\t\t5\t\t\t\n"
    comma = 'Name,Full Path,File Size,Created Date,Deleted\r\n"a, ""b"".txt","/y/a, b.txt",7,01/02/2024 03:04:05,no\r\n'
    files = {"le.txt": "﻿" + tab, "be.txt": tab, "latin.csv": comma.replace("a, ", "é, "), "bom.csv": "﻿" + comma, "odd.csv": "Location path;Modified;sha-256 sum\n/z/ĊĀ.bin;2024-01-02;FF\n", "wide.csv": "Path\tSize\tName of file\tCreated\n/ĊĀ/਀Ā.bin\t3\tn\t\n", "empty.csv": "", "header.csv": "Full Path,Size\n"}
    codes = {"le.txt": "utf-16-le", "be.txt": "utf-16-be", "latin.csv": "latin-1", "wide.csv": "utf-16-le"}
    for name, text in files.items():
        (tmp_path / name).write_bytes(text.encode(codes.get(name, "utf-8")))
    kinds = {r.file: (r.encoding, r.delimiter, r.profile) for r in listings.profiles(spark, str(tmp_path)).collect()}
    assert kinds == {"le.txt": ("UTF-16LE", "\t", "tab"), "be.txt": ("UTF-16BE", "\t", "tab"), "latin.csv": ("ISO-8859-1", ",", "comma"), "bom.csv": ("UTF-8", ",", "comma"), "odd.csv": ("UTF-8", ";", "generic"), "wide.csv": ("UTF-16LE", "\t", "generic"), "header.csv": ("UTF-8", ",", "generic")}
    rows = sorted(((r.file, r.file_path, r.file_name, r.size_bytes, str(r.created_ts), r.md5_hash, r.deleted) for r in listings.listings(spark, str(tmp_path)).collect()), key=str)
    assert rows == sorted([
        *[(f, "/x/ä.txt", "ä.txt", 1024, "2024-01-02 03:04:05", "abc", True) for f in ("be.txt", "le.txt")], *[(f, "C:\\only\\path.doc", "path.doc", None, "None", None, False) for f in ("be.txt", "le.txt")],
        ("latin.csv", "/y/é, b.txt", 'é, "b".txt', 7, "2024-01-02 03:04:05", None, False), ("bom.csv", "/y/a, b.txt", 'a, "b".txt', 7, "2024-01-02 03:04:05", None, False),
        ("odd.csv", "/z/ĊĀ.bin", "ĊĀ.bin", None, "None", None, False), ("wide.csv", "/ĊĀ/਀Ā.bin", "n", 3, "None", None, False),
    ], key=str)
    (tmp_path / "none").mkdir()
    assert listings.listings(spark, str(tmp_path / "none")).count() == 0


def test_suffix_table(spark, tmp_path):
    lines = ["// comment", "", "com", "uk", "CO.uk  trailing", "*.ck", "!www.ck", "*.kawasaki.jp", "!city.kawasaki.jp", "jp", "github.io", ".dotted.org"]
    rules = ["com", "uk", "co.uk", "*.ck", "!www.ck", "*.kawasaki.jp", "!city.kawasaki.jp", "jp", "github.io", "dotted.org"]
    (tmp_path / "psl.dat").write_text("\n".join(lines))
    hosts = ["a.b.co.uk", "co.uk", "uk", "WWW.Example.COM:80", "x.y.ck", "www.ck", "a.www.ck", "y.ck", "a.city.kawasaki.jp", "a.b.c.kawasaki.jp", "kawasaki.jp", "user.github.io", "github.io", "10.0.0.1", "10.0.0.1:8080", "localhost", "", "a.b.unknown", "s.dotted.org", None]
    frame = spark.createDataFrame([(i, h) for i, h in enumerate(hosts)], "id int, domain string")
    got = {r.id: r.site for r in domains.with_sites(frame, "domain", domains.suffix_table(spark, str(tmp_path / "psl.dat"))).collect()}
    expected = {r.id: r.site for r in frame.select("id", S.registered_domain(F.col("domain"), rules).alias("site")).collect()}
    assert got == expected and got[0] == "b.co.uk" and got[5] == "www.ck" and got[4] == "x.y.ck" and got[8] == "city.kawasaki.jp"
    many = domains.rule_table(spark.range(10_000).select(F.concat(F.lit("r"), F.col("id").cast("string"), F.lit(".com")).alias("rule")))
    plans = [len(domains.with_sites(frame, "domain", r)._jdf.queryExecution().toString()) for r in (many, many.limit(10))]
    assert plans[0] < 20_000 and abs(plans[0] - plans[1]) < 2_000


def test_site_summary(spark):
    rows = [(1, "u1", "www.a.com", 3, 1, 5), (2, "u1", "www.a.com", None, 0, 9), (3, "u2", "a.com", 4, 2, 2), (4, "u3", "b.com", 1, 7, 7), (5, None, None, 1, None, None)]
    got = {r.site: tuple(r)[1:] for r in domains.site_summary(spark.createDataFrame(rows, "id int, url string, domain string, occurrences int, first_seen int, last_seen int"), shown=1).collect()}
    assert got["a.com"] == (2, 8, 0, 9, "u1 (4)") and got["b.com"] == (1, 1, 7, 7, "u3 (1)") and got[None][:2] == (1, 1)


def brute_keys(docs, depth=3):
    out = {}

    def walk(value, at, level):
        for k, v in value.items():
            path = f"{at}.{k}" if at else k
            kind = {dict: "dict", list: "list", str: "str", bool: "bool", int: "int", float: "float", type(None): "NoneType"}[type(v)]
            sample = f"<{kind}>" if kind in ("dict", "list") else {True: "true", False: "false"}.get(v, str(v))[:50] if kind == "bool" else str(v)[:50]
            n, s = out.get((path, kind), (0, None))
            out[path, kind] = n + 1, sample if s is None else min(s, sample)
            if kind == "dict" and level < depth:
                walk(v, path, level + 1)

    for d in docs:
        walk(d, "", 0)
    return sorted((p, k, n, s) for (p, k), (n, s) in out.items())


def test_drift(spark):
    import json

    docs = [{"a": 1, "b": {"c": {"d": {"e": {"f": 1}}}, "list": [{"x": 1}]}}, {"a": "t" * 60, "b": None, "z": True}, {"a": 1.5, "b": {}}, {}]
    frame = spark.createDataFrame([(json.dumps(d), i) for i, d in enumerate(docs)] + [("broken{", 9), (None, 9), ("[1]", 9), ("5", 9)], "doc string, kind int")
    assert sorted(map(tuple, drift.json_keys(frame, "doc").collect())) == brute_keys(docs)
    known = spark.createDataFrame([("a",), ("b",), ("b.c",)], "path string")
    assert {r.path for r in drift.unknown_json_keys(frame, "doc", known).collect()} == {"b.c.d", "b.c.d.e", "b.list", "z"}
    values = drift.unknown_values(frame, "kind", spark.createDataFrame([(0,), (1,)], "value int"))
    assert sorted(map(tuple, values.collect())) == [("2", 1), ("3", 1), ("9", 4)]
    other = spark.createDataFrame([(1,)], "x int")
    tables = {"docs": frame, "autofill_new": other, "thing": other, "sqlite_master": other, "android_meta": other}
    assert drift.unknown_tables(tables, {"docs"}) == [("autofill_new", "x"), ("thing", "x")] and drift.unknown_tables(tables, {"docs"}, ["AUTOFILL"]) == [("autofill_new", "x")]
    report = drift.drift_report(tables, {"docs": {"doc"}}, [("docs", "kind", spark.createDataFrame([(9,)], "value int"))], [("docs", "doc", known)])
    assert sorted({r.what for r in report.collect()}) == ["unknown_column", "unknown_enum_value", "unknown_json_key", "unknown_table"]
    assert drift.json_keys(frame.limit(0), "doc").count() == 0


def test_hashes_of_a_growing_list(spark, tmp_path):
    path, source = str(tmp_path / "out"), str(tmp_path / "in")
    schema = "id long, md5 string, sha1 string, sha256 string"
    entries = spark.createDataFrame([("l", "aa", 1), ("l", "bb", 2), ("k", "AA", 2), ("l", "cc", 3), ("l", "dd", 9)], "list_name string, hash string, version long")
    state = {"version": 1}

    def go(rows, version):
        state["version"] = version
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        feed = spark.readStream.schema(schema).parquet(source)
        feeds.hash_feed(feed, lambda: entries.where(F.col("version") <= state["version"]), path, str(tmp_path / "check")).awaitTermination()
        return sorted((r.id, r.list_name, r.hash, r.batch_id) for r in spark.read.schema("id long, list_name string, hash string, batch_id long").parquet(f"{path}/matches").collect())

    assert go([(1, "aa", None, None), (2, "bb", "x", None)], 1) == [(1, "l", "aa", 0)]
    first = [(1, "k", "aa", 1), (1, "l", "aa", 0), (2, "l", "bb", 1), (3, "l", "bb", 1)]
    assert go([(3, None, "BB", None)], 2) == first  # the list has grown: older files match what is new, and only that
    assert go([(4, "dd", None, "cc")], 3) == sorted([*first, (4, "l", "cc", 2)])
    assert go([(5, None, None, None)], 3) == sorted([*first, (4, "l", "cc", 2)])


def test_days_close_and_late_rows_are_left_out(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [[(1, "2024-01-01 10:00:00", "a"), (2, "2024-01-01 23:59:59", "a"), (3, "2024-01-02 01:00:00", "b")], [(2, "2024-01-01 23:59:59", "a"), (4, "2024-01-06 00:00:00", "a")], [(4, "2024-01-06 00:00:00", "a")], [(5, "2024-01-01 12:00:00", "a"), (6, "2024-01-05 00:00:00", "c"), (6, "2024-01-05 00:00:00", "c")]]
    for rows in batches:
        spark.createDataFrame(rows, "id int, ts string, kind string").selectExpr("id", "cast(ts as timestamp) ts", "kind").coalesce(1).write.mode("append").parquet(source)
    feed = spark.readStream.schema("id int, ts timestamp, kind string").option("maxFilesPerTrigger", 1).parquet(source)
    query = feeds.daily_sink(feed, path, str(tmp_path / "check"), "1 day", ["id"])
    query.awaitTermination()
    assert sorted((str(r.day), r.kind, r.n) for r in spark.read.parquet(path).collect()) == [("2024-01-01", "a", 2), ("2024-01-02", "b", 1)]
    kept = [o["numRowsTotal"] for o in query.lastProgress["stateOperators"]]
    dropped = sum(o.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for o in p["stateOperators"])
    assert dropped >= 1 and max(kept) <= 3  # only what the watermark leaves open is held
