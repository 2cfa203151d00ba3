"""Path rules, nested documents and list imports on literal rows: nulls, odd forms, ties."""

import json

import pytest
from pyspark.sql import functions as F

from casemill.functions import browser as B
from casemill.functions import codes
from casemill.operators import nested, system
from casemill.sources import readers


def values(spark, columns, rows, schema):
    return [tuple(r) for r in spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"place int, {schema}").orderBy("place").select(*columns).collect()]


def test_paths(spark):
    rows = [
        ("Users\\john\\AppData\\Local\\Google\\Chrome\\User Data\\Profile 1\\History",), ("home/u/.config/google-chrome/Default/History",), ("/x/User Data/History",), ("/home/u/.config/chromium/work/y",),
        ("/home/u/Opera Stable/x",), ("/plain/file",), ("/a/User Data",), (None,), ("",),
    ]
    got = values(spark, [B.browser(F.col("p")), B.profile(F.col("p"))], rows, "p string")
    assert got == [("chrome", "Profile 1"), ("chrome", "Default"), (None, "Default"), ("chromium", "work"), (None, "Opera Stable"), (None, None), (None, None), (None, None), (None, None)]


def test_signals_and_roots(spark):
    rows = [("/a/Default/Network/Cookies", "Cookies"), ("/app/cache/Cache/index", "index"), ("/r/Local Storage/x.localstorage", "x"), ("/r/Session Storage/1.log", "1.log"), ("Web Data", "Web Data"), (None, None)]
    kind = B.signal(F.col("p"), F.col("n"))
    root = B.profile_root(F.col("p"), kind)
    got = values(spark, [kind, root, B.application_root(root)], rows, "p string, n string")
    assert got == [("cookies", "/a/Default", "/a"), ("cache", "/app/cache/Cache", "/app/cache/Cache"), ("local_storage", "/r", "/r"), ("session_storage", "/r", "/r"), ("web_data", None, None), (None, None, None)]


def test_values(spark):
    rows = [(["x", "storage"], None), (None, ["*://b/*"]), (["tabs"], []), (None, None), (["proxy"], ["*://b/*"])]
    assert [r[0] for r in values(spark, [B.extension_risk(F.col("p"), F.col("h"))], rows, "p array<string>, h array<string>")] == ["medium", "high", "high", "low", "critical"]
    data = "00000000" + "0A000000" + "03000000" + "E8030000" + "00" * 44 + "0080D5DEB19DDA01" + "00" * 4
    runs = values(spark, [B.run_history(F.col("n"), F.col("d"))], [("P:\\sbb.rkr", data), ("HRZR_x", data), ("a", "00"), (None, data)], "n string, d string")
    assert runs[0][0].path == "C:\\foo.exe" and (runs[0][0].runs, runs[0][0].focus, runs[0][0].focus_ms) == (10, 3, 1000) and runs[0][0].last_run.year == 2024
    assert [r[0] for r in runs[1:]] == [None, None, None]
    attributes = values(spark, [B.origin_attributes(F.col("t"))], [("^userContextId=1&userContextId=2&firstPartyDomain=",), ("^partitionKey=(https,a=b)",), (None,)], "t string")
    assert [tuple(a[0]) for a in attributes] == [(2, None, None, None), (None, None, None, "(https,a=b)"), (None, None, None, None)]
    clean = values(spark, [B.network_value(F.col("v"), F.col("k"))], [("['10.0.0.1', '']", "network:dhcp_ip"), (None, None), ("0", "network:domain"), ("0", "other")], "v string, k string")
    assert [c[0] for c in clean] == ["10.0.0.1", "", "", "0"]
    links = values(spark, [B.shortcut_url(F.col("u"), F.col("d"), F.col("a"), F.col("t"))], [("", "http://d/%20", None, None), (None, "x%zz", "-url http://a b", "http://t"), (None, None, None, None)], "u string, d string, a string, t string")
    assert [x[0] for x in links] == ["http://d/%20", "http://a", None]


def test_bookmarks_of_any_depth(spark):
    node = {"type": "url", "name": "end", "url": "http://x", "date_added": "13000000000000000"}
    for k in range(400):
        node = {"type": "folder", "name": f"f{k}", "children": [node, "odd"]}
    docs = spark.createDataFrame([(1, json.dumps({"roots": {"other": node, "sync_version": 1}})), (2, "no json"), (3, None), (4, "[]")], "id long, doc string")
    rows = nested.bookmarks(docs).collect()
    assert len(rows) == 401 and [r.folder.count("/") for r in rows if r.kind == "url"] == [400] and {r.id for r in rows} == {1}


def test_nested_rows_skip_what_is_odd(spark):
    docs = spark.createDataFrame([(1, '{"geo": {"http://a,*": {"setting": "1"}, "http://b": {"setting": {}}, "http://c": {}, "d": 3}, "x": []}'), (2, "{"), (3, None)], "id long, doc string")
    assert sorted((r.origin, r.code, r.permission) for r in nested.permissions(docs).collect()) == [("http://a,*", 1, "allow"), ("http://c", 0, "default")]
    forms = spark.createDataFrame([(1, '{"url": "u", "formdata": {"id": {"a": "", "b": {"c": 1}}, "xpath": 5}}'), (2, None)], "id long, doc string")
    assert [(r.name, r.value) for r in nested.form_fields(forms).collect()] == [("b", '{"c":1}')]
    lines = spark.createDataFrame([("a.b:HSTS\t0\tx\t9999999999999999,1",), ("nohost\t0\t1\t1,0,1",), ("",), (None,)], "value string")
    assert [(r.host, r.accessed, r.expires, r.mode, r.subdomains) for r in nested.security_states(lines).collect()] == [("a.b", None, None, "knockout", 0)]
    cookies = spark.createDataFrame([(1, "n\r\nv\r\nd.example/p/q\r\n1\r\n0\r\n*\r\nshort"), (2, None), (3, "")], "id long, text string")
    assert [tuple(r) for r in nested.cookie_blocks(cookies).collect()] == [(1, "n", "v", "d.example", "/p/q", None, False, False)]


def test_users_merge(spark):
    rows = [(1, "system:local_user", "Ann", None, None), (2, "system:user_profile", "Ann", "p2", '{"profile_path": "C:/Users/Ann"}'), (3, "system:user_account", "C:\\Users\\Bob\\", "p3", None), (4, "system:user_profile", "Public", "p", "odd"), (5, "system:local_user", "Eve", None, None), (6, "other", "x", None, None)]
    got = system.users(spark.createDataFrame(rows, "id long, type string, value string, path string, extra_json string")).collect()
    assert sorted(tuple(r) for r in got) == [("Ann", "C:/Users/Ann", "p2", True), ("Bob", "C:\\Users\\Bob\\", "p3", False), ("Eve", "", "", True)]


def test_list_imports(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a" * 32 + "\nbad line\n")
    (tmp_path / "b_1.txt").write_text("b" * 40 + "\n")
    (tmp_path / "c.txt").write_text("# nothing\n")
    path = str(tmp_path)
    no_entries = spark.createDataFrame([], "list_name string, hash string, note string, kind string")
    entries, versions = readers.imported(spark, path, no_entries, spark.createDataFrame([], "list_name string, version string"))
    assert sorted(r.list_name for r in entries.collect()) == ["a", "b_1"] and versions.count() == 3
    held = spark.createDataFrame(versions.collect(), versions.schema).where("list_name <> 'a'").unionByName(spark.createDataFrame([("a", "old"), ("z", "1")], "list_name string, version string"))
    assert sorted((r.list_name, r.state) for r in readers.list_versions(spark, path, held).collect()) == [("a", "changed"), ("b_1", "unchanged"), ("c", "unchanged")]
    names = spark.createDataFrame([("a",), ("a_1",), ("b_1",)], "list_name string")
    status = lambda policy: sorted((r.list_name, r.target, r.entries, r.bad, r.status) for r in readers.batch_status(spark, path, names, policy).collect())
    assert status("rename") == [("a", "a_2", 1, 1, "renamed"), ("b_1", "b_1_1", 1, 0, "renamed"), ("c", None, 0, 0, "invalid")]
    assert [s[4] for s in status("skip")] == ["skipped", "skipped", "invalid"]
    with pytest.raises(ValueError):
        readers.batch_status(spark, path, names, "merge")


def test_code_labels(spark):
    row = [codes.label(d, F.lit(c)) for d, c in (("visit_type", 2), ("visit_type", 77), ("chromium_samesite", -1), ("expire_type", 9), ("firefox_permission_type", "geo"), ("firefox_permission_type", "own"))]
    got = spark.range(1).select(*row, codes.label("hidden", F.lit(None).cast("int")), codes.unsigned_or_broken(F.lit(-1)), codes.unsigned_or_broken(F.lit(2))).first()
    assert tuple(got) == ("typed", "unknown_77", "unspecified", "permanent", "geolocation", "own", None, True, False)
