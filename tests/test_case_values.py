"""Stored values, indicators, accounts, bookmark trees and purges on small rows."""

import base64
import datetime
import json

import pytest
from pyspark.sql import functions as F

from casemill.functions import browser as B
from casemill.functions import scalars as S
from casemill.operators import accounts, indicators, stored_values


def jwt(claims):
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x, separators=(",", ":")).encode()).decode().rstrip("=")
    return f"{part({'alg': 'none'})}.{part(claims)}.sig"


def test_stored_values(spark):
    token = jwt({"iss": "me", "sub": "s1", "aud": ["a", "b"], "iat": 1_600_000_000, "exp": 1_700_000_000, "upn": "who@x.org"})
    oauth = "EwA" + "z" * 60
    values = [
        (1, "state", json.dumps({"access_token": token, "visitTime": "2024-01-02T03:04:05Z", "url": "https://a.com/x?y=1).", "nested": [{"email": "Me@Mail.org", "uid": "u1", "n": 5}, "https://in.list.com/z"]})),
        (2, "sessionToken", "abc123def456ghi789jkl012mno345pqr"),
        (3, "plain", "see http%3A%2F%2Fb.com%2Fp%3Fq at 1600000000123 and user@example.com or real@site.net"),
        (4, "other", json.dumps({"email": "o@x.org", "tok": oauth})),
        (5, "refresh_me", "short"),
        (6, "a", ""),
        (7, None, None),
        (8, "auth", json.dumps({"auth": "k" * 33})),
        (9, "list", '["http://c.com/"]'),
        (10, "bad", '{"url": "https://broken.com/'),
        (11, "k", json.dumps({"sid": "x", "trackingId": 7, "email": "no mail", "href": "ftp://x", "link": "https:///none"})),
    ]
    a = stored_values.Analysis(spark.createDataFrame([(i, "o", k, v) for i, k, v in values], "id int, origin string, key string, value string"))
    when = datetime.datetime(2024, 1, 2, 3, 4, 5)
    urls = sorted((r.id, r.url, r.seen, r.context) for r in a.urls.collect())
    assert (1, "https://a.com/x?y=1", when, "json:url") in urls and (1, "https://a.com/x?y=1", when, "regex:key=state") in urls
    assert {(i, u) for i, u, *_ in urls} == {(1, "https://a.com/x?y=1"), (1, "https://in.list.com/z"), (3, "http://b.com/p?q"), (9, "http://c.com/"), (10, "https://broken.com/")}
    assert [s for i, _, s, _ in urls if i == 3] == [datetime.datetime(2020, 9, 13, 12, 26, 40, 123000)]
    emails = sorted((r.id, r.email, r.context) for r in a.emails.collect())
    assert emails == [(1, "me@mail.org", "json:nested[0].email"), (1, "me@mail.org", "regex:key=state"), (3, "real@site.net", "regex:key=plain"), (4, "o@x.org", "json:email"), (4, "o@x.org", "regex:key=other")]
    assert sorted((r.id, r.identifier_type, r.name, r.value) for r in a.identifiers.collect()) == [(1, "user_id", "uid", "u1"), (11, "session_id", "sid", "x")]
    tokens = {(r.id, r.token_type, r.risk): r for r in a.tokens.collect()}
    assert set(tokens) == {(1, "jwt", "high"), (2, "session", "medium"), (4, "microsoft_oauth", "high"), (8, "unknown", "low"), (8, "unknown", "low")} | {k for k in tokens if k[0] == 8}
    found = tokens[1, "jwt", "high"]
    assert (found.issuer, found.subject, found.audience, found.email, found.user_id) == ("me", "s1", "a, b", "who@x.org", "s1")
    assert found.issued == datetime.datetime(2020, 9, 13, 12, 26, 40) and tokens[4, "microsoft_oauth", "high"].email == "o@x.org"
    late = stored_values.expired_tokens(a.tokens, F.lit("2030-01-01").cast("timestamp")).where("id = 1").first()
    assert late.is_expired
    assert a.everything.where("kind = 'identifier'").count() == 2
    assert stored_values.Analysis(a.values.limit(0)).everything.count() == 0


def test_moments(spark):
    texts = ["2024-01-02T03:04:05.5Z", "2024-01-02T03:04:05+00:00", "2024-01-02 03:04:05", "2024-01-02", "1600000000", "1600000000500", "999", "1e10", "x-y", None, "1600000000.5", "99999999999999"]
    got = [r.m and r.m.isoformat() for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", stored_values.moment(F.col("t")).alias("m")).orderBy("i").collect()]
    assert got == ["2024-01-02T03:04:05.500000", "2024-01-02T03:04:05", "2024-01-02T03:04:05", "2024-01-02T00:00:00", "2020-09-13T12:26:40", "2020-09-13T12:26:40.500000", None, None, None, None, "2020-09-13T12:26:40.500000", None]


INDICATOR = "id int, type string, name string, value string, path string, hive string, extra_json string"


def test_software_executions_and_autostarts(spark):
    soft, run, once = indicators.SOFTWARE, *indicators.RUN_KEYS
    rows = [
        (1, soft, "x", "Zip Tool", "p", "h", '{"publisher":"Acme","forensic_interest":true,"size_kb":5}'), (2, soft, "x", "", "p", "h", '{"name":"acme reader","install_date":"d"}'), (3, soft, "x", None, "p", "h", "broken{"), (4, soft, "x", "Other", "p", "h", None),
        (5, indicators.EXECUTION, "x", "raw", "p", "h", '{"decoded_path":"C:/Tor/Browser.exe","run_count":3,"forensic_interest":true}'), (6, indicators.EXECUTION, "x", "plain.exe", "p", "h", None),
        (10, run, "Upd", "C:/U.exe", "HKLM/Run/Upd", "h", None), (11, run, "UPD", "c:/u.EXE", "NTUSER.DAT/Run/Upd", "h", None), (12, once, once, "x.exe", "SOFTWARE/RunOnce/Real", "h", '{"value_name":"Named"}'), (13, run, "Run", "y", "p", "h", None), (14, run, "Empty", "", "p", "h", None),
        (20, indicators.HELPER, "b", "{C1}", "one", "h", None), (21, indicators.HELPER, "b", "{C1}", "two", "h", None), (22, indicators.HELPER, "b", "", "x", "h", None), (30, indicators.SERVICE, "svc", "s.exe", "p", "h", None), (31, indicators.SERVICE, "svc", None, "p", "h", None),
    ]
    df = spark.createDataFrame(rows, INDICATOR)
    names = lambda **k: [(r.id, r.name) for r in indicators.installed_software(df, **k).collect()]
    assert names() == [(2, "acme reader"), (4, "Other"), (3, "Unknown"), (1, "Zip Tool")]
    assert names(search="ACME") == [(2, "acme reader"), (1, "Zip Tool")] and names(search="acme", forensic_only=True) == [(1, "Zip Tool")]
    paths = lambda **k: [r.decoded_path for r in indicators.app_executions(df, **k).collect()]
    assert sorted(paths()) == ["C:/Tor/Browser.exe", "plain.exe"] and paths(search="tor/b") == ["C:/Tor/Browser.exe"] == paths(forensic_only=True)
    assert sorted(map(tuple, indicators.run_entries(df).collect())) == [("Named", "x.exe", "HKLM", True, "SOFTWARE/RunOnce/Real"), ("Upd", "C:/U.exe", "HKLM+HKCU", False, "HKLM/Run/Upd")]
    assert [tuple(r) for r in indicators.helper_objects(df).collect()] == [("{C1}", "one")]
    assert sorted((r.id, r.command) for r in indicators.services(df).collect()) == [(30, "s.exe"), (31, "")]


def test_sites_images_and_tabs(spark):
    sites = spark.createDataFrame([(1, 1, 5, "t", '["chrome",null]'), (2, 1, None, "", None), (3, 1, 9, None, "x"), (4, 2, 9, "t", None), (5, 1, 7, "u", "[]")], "id int, evidence_id int, total_keys int, tags string, browsers string")
    assert [(r.id, r.browsers) for r in indicators.stored_sites(sites, 1).collect()] == [(3, []), (5, []), (1, ["chrome"]), (2, [])]
    assert [r.id for r in indicators.stored_sites(sites, 1, [1, 3], True).collect()] == [1]
    rows = [(1, 7, "filesystem_images", 5, "/b", "", None, 30), (2, 7, "safari", 3, None, "u2", None, None), (3, 7, "cache_simple", 9, None, "u1", None, None), (4, 7, "safari", 1, None, "u1", None, None), (5, 7, "filesystem_images", 6, "/a", None, 20, None), (6, 8, "carver", None, None, None, None, None)]
    d = spark.createDataFrame([(i, 1, *r) for i, *r in rows], "id int, evidence_id int, image_id int, discovered_by string, discovered_at int, fs_path string, cache_url string, fs_crtime int, fs_mtime int")
    view = {r.image_id: tuple(r)[2:] for r in indicators.image_sources(d).collect()}
    assert view == {7: ("safari", "cache_simple,filesystem_images,safari", 3, 5, "/b", True, "cache_simple,safari"), 8: ("carver", "carver", 1, 1, None, False, None)}
    assert [tuple(r) for r in indicators.image_urls(d).collect()] == [(7, ["u1", "u2"], 30)]
    tabs = indicators.tab_histories(spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(1,), (1,), (9,)], "tab_id int"))
    assert sorted(map(tuple, tabs.collect())) == [(1, 2), (2, 0)]


def test_purge(spark, tmp_path):
    parents = {"matches": ["urls"], "urls": [], "tags": ["urls", "matches"], "images": []}
    order = indicators.purge_order(parents)
    assert order.index("tags") < order.index("matches") < order.index("urls") and sorted(order) == sorted(parents)
    with pytest.raises(ValueError, match="one another"):
        indicators.purge_order({"a": ["b"], "b": ["a"]})
    for name in ("matches", "urls"):
        spark.createDataFrame([(k, k % 2) for k in range(6)], "id int, evidence_id int").write.partitionBy("evidence_id").parquet(str(tmp_path / name))
    assert [(r.name, r.removed) for r in indicators.purge(spark, str(tmp_path), parents, 1, ["urls", "matches", "tags"]).orderBy("place").collect()] == [("tags", 0), ("matches", 3), ("urls", 3)]
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "urls")).collect()) == [0, 2, 4]
    assert indicators.purge(spark, str(tmp_path), parents, 1).agg(F.sum("removed")).first()[0] == 0


def test_sync_records(spark):
    prefs = {"account_info": [{"account_id": "1", "email": "a@x", "full_name": "A", "gaia": "g", "hd": "corp", "is_child_account": True}, {"email": "b@x", "given_name": "B"}], "google": {"services": {"username": "a@x", "account_id": "9"}}, "sync": {"has_setup_completed": True, "bookmarks": True, "tabs": False, "last_synced_time": "13300000000000000", "devices": {"d1": {"name": "Phone", "type": "phone", "os": "android", "last_updated_timestamp": "13300000000000000", "send_tab_to_self_receiving_enabled": True}, "d2": {}}}}
    bare = {"google": {"services": {"username": "c@x", "last_gaia_id": "gg", "signin": {"allowed": False}}}}
    docs = spark.createDataFrame([(1, json.dumps(prefs)), (2, json.dumps(bare)), (3, "{}"), (4, "broken"), (5, None), (6, '{"account_info": 5, "sync": []}')], "id int, doc string")
    rows = {(r.id, r.email): r for r in accounts.preference_accounts(docs).collect()}
    assert set(rows) == {(1, "a@x"), (1, "b@x"), (2, "c@x")}
    a, c = rows[1, "a@x"], rows[2, "c@x"]
    assert (a.display_name, a.hosted_domain, a.is_child, a.sync_enabled, a.synced_types) == ("A", "corp", True, True, "bookmarks,has_setup_completed") and rows[1, "b@x"].display_name == "B"
    assert (c.person_id, c.sync_enabled, c.synced_types, c.last_sync) == ("gg", False, "", None) and str(a.last_sync) == "2022-06-18 04:26:40"
    devices = {r.device_id: r for r in accounts.preference_devices(docs).collect()}
    assert set(devices) == {"d1", "d2"} and (devices["d1"].name, devices["d1"].account_id, devices["d1"].receives_tabs, devices["d2"].name) == ("Phone", "1", True, "Unknown")
    user = {"accountData": {"email": "f@x", "uid": "u", "verified": True, "sessionToken": "t", "keyFetchToken": "", "kSync": "k", "displayName": "F", "device": {"id": "dd", "name": "Fox", "pushEndpointExpired": True, "availableCommands": {"send": 1, "close": 2}}}, "profilePath": "/p"}
    docs = spark.createDataFrame([(1, json.dumps(user)), (2, '{"accountData": null}'), (3, '{"accountData": {"device": {}}}'), (4, "x")], "id int, doc string")
    (row,) = accounts.signed_in_accounts(docs).collect()
    assert tuple(row) == (1, "u", "f@x", "F", "/p", True, "active_session,sync_encryption_ready,remote_commands")
    (device,) = accounts.signed_in_devices(docs).collect()
    assert tuple(device) == (1, "dd", "Fox", "desktop", "u", True, "close,send")


def test_place_trees(spark):
    place = lambda name, uri: {"type": accounts.PLACE, "title": name, "uri": uri, "guid": "g", "dateAdded": 1_600_000_000_000_000}
    tree = {"type": accounts.CONTAINER, "title": "", "children": [{"type": accounts.CONTAINER, "title": "Toolbar", "children": [place("a", "http://a"), {"type": accounts.CONTAINER, "title": "Mine", "children": [place("b", "http://b")]}, {"type": "text/x-moz-place-separator"}]}, place("top", "http://t"), place("none", ""), "odd", {"type": accounts.CONTAINER, "title": "unfiled", "children": "odd"}]}
    deep = place("deep", "http://d")
    for k in range(300):
        deep = {"type": accounts.CONTAINER, "title": f"f{k % 3}", "children": [deep]}
    docs = spark.createDataFrame([(1, json.dumps(tree)), (2, "broken"), (3, None), (4, "[]"), (5, json.dumps(deep))], "id int, doc string")
    rows = {r.name: (r.id, r.url, r.folder) for r in accounts.place_bookmarks(docs).collect()}
    assert {n: rows[n] for n in ("a", "b", "top")} == {"a": (1, "http://a", "Bookmarks Toolbar"), "b": (1, "http://b", "Bookmarks Toolbar/Mine"), "top": (1, "http://t", "")}
    assert set(rows) == {"a", "b", "top", "deep"} and rows["deep"][2].count("/") == 299
    assert str(accounts.place_bookmarks(docs).where("name = 'a'").first().added) == "2020-09-13 12:26:40"


def test_hinted_times_and_embedded_roots(spark):
    values = [(0.0, None, None), (45000.5, None, "2023-03-15 12:00:00"), (1.6e9, None, "2020-09-13 12:26:40"), (1.6e12, None, "2020-09-13 12:26:40"), (1.32e17, None, "2019-04-17 18:40:00"), (1.33e16, None, "2022-06-18 04:26:40"), (5e9, None, None), (-5.0, None, None), (1.32e17, "filetime", "2019-04-17 18:40:00"), (1.33e16, "webkit", "2022-06-18 04:26:40"), (2.0, "ole", "1900-01-01 00:00:00"), (1.5, "unix", "1970-01-01 00:00:01.500000"), (0.0, "unix", None)]
    for x, hint, expected in values:
        got = spark.range(1).select(S.hinted(F.lit(x), hint).alias("t")).first().t
        assert (None if got is None else str(got)) == expected, (x, hint)
    paths = [(1, "C:\\Apps\\Tool\\Cache"), (2, "c:/apps/toolbox/x"), (3, "/Users/a/Google/Chrome/User Data/x"), (4, "C:/Apps//TOOL"), (5, None), (6, "/other")]
    df = spark.createDataFrame(paths, "id int, path string")
    by_list = {r.id: r.b for r in df.select("id", B.embedded_browser(F.col("path"), ["C:\\Apps\\Tool\\", "", "/"]).alias("b")).collect()}
    by_table = {r.id: r.browser for r in B.in_roots(df, spark.createDataFrame([("C:\\Apps\\Tool\\",), ("",), ("/",)], "root string")).collect()}
    assert by_list == by_table == {1: "chromium_embedded", 2: None, 3: "chrome", 4: "chromium_embedded", 5: None, 6: None}
