"""Links, merges, near fingerprints, pauses and debug logs on small rows against brute force."""

import datetime
import itertools
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from casemill.operators import links, logs, matching, merging, similarity, timeline


def test_download_links(spark):
    urls = [(1, 1, "a.com", "http://a.com/x/File.zip"), (2, 1, "a.com", "http://a.com/y/file.ZIP"), (3, 1, "b.com", "http://b.com/file.zip"), (4, 2, "a.com", "http://a.com/file.zip"), (5, 1, "a.com", "http://a.com/q?100%.zip"), (6, 1, "a.com", "http://a.com/d/e_1.zip"), (7, 1, "a.com", "http://a.com/dXe_1.zip"), (8, 1, None, "http://n/file.zip"), (9, 1, "a.com", None), (10, 1, "a.com", "http://a.com/dir/")]
    downloads = [(1, 1, "a.com", "file.zip"), (2, 1, "b.com", "FILE.zip"), (3, 1, "c.com", "file.zip"), (4, 1, "a.com", "q?100%.zip"), (5, 1, "a.com", "d/e_1.zip"), (6, 1, "a.com", "e%1.zip"), (7, 1, None, "file.zip"), (8, 1, "a.com", None), (9, 2, "a.com", "file.zip"), (10, 1, "a.com", ""), (11, 1, "a.com", "ile.zip"), (11, 1, "a.com", "x/file.zip")]
    got = links.download_links(spark.createDataFrame(downloads, "id int, evidence_id int, domain string, filename string"), spark.createDataFrame(urls, "id int, evidence_id int, domain string, url string"))
    expected = [(d, min((u for u, e2, m2, t in urls if e2 == e and m is not None and m2 == m and n is not None and t and t.lower().endswith("/" + n.lower())), default=None)) for d, e, m, n in downloads]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)
    assert dict(expected)[4] == 5 and dict(expected)[6] is None


def brute_merge(urls, key, evidence, sources):
    groups, out = {}, []
    for r in urls:
        if r["evidence_id"] == evidence and r["discovered_by"] in sources:
            groups.setdefault(tuple(r[c] for c in key), []).append(r)
    kept = {}
    for rows in groups.values():
        rows.sort(key=lambda r: r["id"])
        for r in rows:
            kept[r["id"]] = rows[0]["id"]
        if len(rows) > 1:
            first = dict(rows[0])
            paths = {p.strip() for r in rows if r["source_path"] for p in r["source_path"].split(", ") if p.strip()}
            tags = set()
            for r in rows:
                if r["tags"]:
                    try:
                        value = json.loads(r["tags"])
                        tags |= set(value) if isinstance(value, list) else {value} if isinstance(value, str) else set()
                    except json.JSONDecodeError:
                        tags.add(r["tags"])
            first["source_path"] = ", ".join(sorted(paths)) or None
            first["tags"] = json.dumps(sorted(tags), separators=(",", ":")) if tags else None
            first["notes"] = "; ".join(sorted({r["notes"] for r in rows if r["notes"]})) or None
            first["occurrences"] = sum(r["occurrences"] or 1 for r in rows)
            for c, f in (("first_seen", min), ("last_seen", max)):
                if c not in key:
                    first[c] = f((r[c] for r in rows if r[c] is not None), default=None)
            out.append(first)
    gone = {i for i, k in kept.items() if i != k}
    merged = {r["id"] for r in out}
    return out + [r for r in urls if r["id"] not in gone | merged], kept, len(kept), len(gone), len(out)


@pytest.mark.parametrize("key", [["url"], ["url", "first_seen"], ["url", "last_seen", "discovered_by"]])
def test_merge(spark, key):
    rng = random.Random(len(key))
    pick = rng.choice
    columns = ["id", "evidence_id", "url", "discovered_by", "first_seen", "last_seen", "source_path", "tags", "notes", "occurrences"]
    urls = [dict(zip(columns, (i, pick([1, 1, 1, 2]), pick(["u1", "u2", "u3", None]), pick(["a", "b", "c", None]), pick([None, 1, 2]), pick([None, 5, 6]), pick([None, "", "p1", "p2, p1", " p3 ,p4"]), pick([None, "", '["x","y"]', '"z"', "plain, text", "5", "[]", '{"a":1}']), pick([None, "", "n1", "n2; n1"]), pick([None, 0, 1, 7])))) for i in range(120)]
    frame = spark.createDataFrame([tuple(r[c] for c in columns) for r in urls], "id int, evidence_id int, url string, discovered_by string, first_seen int, last_seen int, source_path string, tags string, notes string, occurrences int")
    matches = [(i, pick("lm")) for i in range(0, 130, 2)]
    tags = [(pick("st"), pick(["url", "image"]), i) for i in range(0, 130, 3)]
    m = merging.merged_urls(frame, spark.createDataFrame(matches, "id int, list_name string"), spark.createDataFrame(tags, "tag string, artifact_type string, artifact_id int"), key, 1, ["a", "b"])
    expected, kept, total, removed, affected = brute_merge(urls, key, 1, ["a", "b"])
    assert sorted(map(tuple, m.urls.select(*columns).collect()), key=str) == sorted((tuple(r[c] for c in columns) for r in expected), key=str)
    assert sorted(map(tuple, m.matches.collect())) == sorted({(kept.get(i, i), n) for i, n in matches})
    assert sorted(map(tuple, m.associations.collect())) == sorted({(t, k, kept.get(i, i) if k == "url" else i) for t, k, i in tags})
    assert tuple(m.counts.first()) == (total, total - removed, removed, affected)
    assert tuple(merging.merged_urls(frame.limit(0), spark.createDataFrame([], "id int, list_name string"), spark.createDataFrame([], "tag string, artifact_type string, artifact_id int"), key).counts.first()) == (0, 0, 0, 0)


@pytest.mark.parametrize("radius,group", [(0, 1000), (2, 3), (3, 5), (7, 4), (10, 6), (10, 1000)])
def test_near_pairs_with_crowded_bands(spark, radius, group):
    rng = random.Random(radius)
    hashes = {0xABCD << 48 | 0x77 << 40 | rng.getrandbits(6) << rng.randrange(40) for _ in range(40)} | {rng.getrandbits(64) for _ in range(30)}
    hashes |= {h ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 12))) for h in list(hashes) for _ in range(2)} | {0, 2**64 - 1, 2**63, 2**63 - 1}
    texts = sorted(f"{h:016x}" for h in hashes)
    expected = sorted((a, b, d) for a, b in itertools.combinations(texts, 2) if (d := (int(a, 16) ^ int(b, 16)).bit_count()) <= radius)
    images = spark.createDataFrame([(i, t.upper() if i % 2 else t) for i, t in enumerate(texts * 2)] + [(-1, None), (-2, "xyz")], "id int, phash string")
    assert sorted(map(tuple, similarity.near_pairs(images, radius, group).collect())) == expected


def test_crowded_band_is_cut(spark):
    """Two thousand hashes with equal front bits: no join key keeps them together."""
    images = spark.range(2000).select("id", F.concat(F.lit("abcdabcd"), F.lower(F.lpad(F.hex(F.col("id") * 2097143), 8, "0"))).alias("phash"))
    plan = similarity.near_pairs(images, 1, 50)._jdf.queryExecution().toString()
    assert plan.count("Join") > 4  # more than the first level's join
    brute = images.select(F.col("phash").alias("a"), F.col("id").alias("i")).join(images.select(F.col("phash").alias("b"), F.col("id").alias("j")), F.expr("a < b and bit_count((i * 2097143) ^ (j * 2097143)) <= 1"))
    assert similarity.near_pairs(images, 1, 50).count() == brute.count()


def test_cluster_sources(spark):
    images = spark.createDataFrame([(1, "0" * 16), (2, "0" * 15 + "1"), (3, "f" * 16), (4, None)], "id int, phash string")
    got = similarity.cluster_sources(similarity.leader_clusters(images, 10), spark.createDataFrame([(2,), (2,), (9,)], "id int"))
    assert sorted(map(tuple, got.collect())) == [("0" * 16, 2, True), ("f" * 16, 1, False)]


@pytest.mark.parametrize("hours", [0.01, 0.5, 1, 12, 24])
def test_gaps(spark, hours):
    rng = random.Random(3)
    start = datetime.datetime(2024, 1, 1)
    rows = [(rng.choice([1, 1, 2, None]), start + datetime.timedelta(seconds=rng.choice([rng.randrange(10**6), rng.randrange(100) * 43200 + rng.choice([-1, 0, 1, 18]), rng.randrange(3600)]))) for _ in range(400)] + [(1, None), (3, start)]
    expected = []
    for e in (None, 1, 2, 3):
        times = sorted(t for k, t in rows if k == e and t)
        for a, b in itertools.pairwise(times):
            h = round((b - a).total_seconds() / 3600 + 1e-12, 2)
            if h >= hours:
                expected.append((e, a, b, h))
    expected.sort(key=lambda r: (-r[2].timestamp(), -1 if r[0] is None else r[0]))
    got = [tuple(r) for r in timeline.gaps(spark.createDataFrame(rows, "evidence_id int, ts timestamp"), hours, ["evidence_id"], 500).collect()]
    assert [r[:3] for r in got] == [r[:3] for r in expected]
    with pytest.raises(ValueError):
        timeline.gaps(spark.createDataFrame(rows, "evidence_id int, ts timestamp"), 0.005, ["evidence_id"])


LOG = """before any header http://lost.com/
[0607/155418:INFO:CONSOLE(3)] "Hello", source: https://a.com/app.js (12)
[0607/155419.123:77:88:ERROR:backend_impl.cc(1037)] Unable: http://b.com/x, http://b.com/x.
  and https://a.com/app.js;
[0608/000000:WARNING:CONSOLE(9)] "see https://c.com/'q'", source: http://b.com/x (1)

[not a header] http://d.com/1
[0608/000001:INFO:CONSOLE(1)] no source: ftp://x (1)
"""


def test_debug_log(spark, tmp_path):
    (tmp_path / "debug.log").write_bytes(LOG.replace("\n", "\r\n").encode())
    (tmp_path / "other.log").write_text("[0101/000000:INFO:x(1)] http://b.com/x\n")
    lines = logs.numbered_lines(spark, str(tmp_path))
    own = {r.line: r.text for r in lines.where("path like '%debug.log'").collect()}
    assert own == dict(enumerate(LOG.split("\n")[:-1], 1))
    entries = logs.debug_entries(lines).cache()
    got = {r.line: r for r in entries.where("path like '%debug.log'").collect()}
    assert sorted(got) == [2, 3, 5, 8]
    assert (got[2].date, got[2].time, got[2].severity, got[2].source, got[2].console_url, got[2].console_line, got[2].urls) == ("0607", "155418", "INFO", "CONSOLE(3)", "https://a.com/app.js", 12, [])
    assert (got[3].milliseconds, got[3].pid, got[3].tid, got[3].urls) == ("123", 77, 88, ["http://b.com/x", "http://b.com/x", "https://a.com/app.js"])
    # the source stands at the end of an entry, and this one has lines after it
    assert (got[5].console_url, got[5].urls) == (None, ["https://c.com/", "http://b.com/x", "http://d.com/1"]) and got[8].console_url is None
    urls = {r.url: tuple(r)[2:] for r in logs.debug_urls(entries).where("path like '%debug.log'").collect()}
    assert urls == {
        "https://a.com/app.js": ("console_source", "INFO", "CONSOLE(3)", "0607/155418", "0607/155419", 2), "http://b.com/x": ("message_body", "ERROR", "backend_impl.cc(1037)", "0607/155419", "0608/000000", 3),
        "https://c.com/": ("message_body", "WARNING", "CONSOLE(9)", "0608/000000", "0608/000000", 1), "http://d.com/1": ("message_body", "WARNING", "CONSOLE(9)", "0608/000000", "0608/000000", 1),
    }
    assert logs.debug_urls(entries).where("path like '%other.log'").count() == 1


def test_log_numbered_in_blocks(spark, tmp_path):
    (tmp_path / "long.log").write_text("".join(f"line {k}\n" for k in range(20000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = logs.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.line, r.text) for r in rows) == [(k + 1, f"line {k}") for k in range(20000)]


def test_visits_annotations_and_chains(spark):
    visits = spark.createDataFrame([(1, 10, None, 1), (2, 11, 1, 7), (3, 11, 99, 7), (4, 12, 2, 1), (5, 11, 4, 7), (6, 13, 1, 7)], "id int, place_id int, from_visit int, visit_type int")
    places = spark.createDataFrame([(10, "p"), (11, "d"), (12, "q")], "id int, url string")
    assert sorted(map(tuple, links.download_referrers(visits, places).collect())) == [(2, "d", "p"), (5, "d", "q")]
    assert [tuple(r) for r in links.referrer_map(visits, places).collect()] == [("d", "q")]
    annos = spark.createDataFrame([(1, 10, 1, "file:///a"), (2, 10, 2, '{"state":1,"endTime":1500,"fileSize":7}'), (3, 11, 2, "x"), (4, 12, 1, "file:///old"), (5, 12, 1, "file:///new"), (6, 12, 2, "broken"), (7, 12, 9, "other")], "id int, place_id int, attribute_id int, content string")
    kinds = spark.createDataFrame([(1, "dest"), (2, "meta"), (9, "else")], "id int, name string")
    got = links.download_metadata(links.annotated(places, annos, kinds, {"target": "dest"}, {"meta": "meta"}), "meta")
    assert sorted(tuple(r) for r in got.select("id", "target", "state", F.unix_millis("ended"), "file_size").collect()) == [(10, "file:///a", 1, 1500, 7), (12, "file:///new", None, None, None)]
    hops = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "b"), (2, 1, ""), (3, 0, None)], "k int, i int, url string")
    assert sorted(map(tuple, links.chain_urls(hops, "k", "i", "url", "redirect").select("url", "downloads", "first_place").collect())) == [("a", 1, 0), ("b", 2, 0)]


REGEXES = [r"(?P<n>abc)\d", "a(?#c)bc", "a{,3}bc", "(?P<n>b)?x", "[a&&b]", "[[a]bc]", r"\p{L}+1", "(a)(b)\\2", "(?x) q w e", "(?i)ZZ", "(?x) ü # c", "^http://m", r"\Dend$", "Ünï", "(broken", "a|", "(?=look)l", "x++y", r"(\w)\1{3}", "(?-i:Case)"]
TEXTS = ["abc1", "ABC7", "abc", "aaabc", "bx", "x", "a&", "&", "b", "[a]bc", "ab", "L1", "é1", "abb", "qwe", "q w e", "zz", "http://M.acme.com/", "xend", "1end", "ünï", "look", "xxy", "", "aaaa", "case", "Case", None, "nothing here 42"]


@pytest.mark.parametrize("more", [0, 150, 181, 182, 10_000])
def test_regex_lists_of_any_length(spark, more):
    """The same rows whatever stands in the list besides, for each construct alone and all together."""
    filler = [("filler", k, f"no-such-text-{k}", matching.url_rule(f"no-such-text-{k}", False)) for k in range(more // 2)] + [("regexes", 1000 + k, f"never{k}[0-9]", matching.url_rule(f"never{k}[0-9]", True)) for k in range(more - more // 2)]
    alone = [(f"list{k:02}", 0, p, matching.url_rule(p, True)) for k, p in enumerate(REGEXES)]
    together = [("regexes", k, p, matching.url_rule(p, True)) for k, p in enumerate(REGEXES)]
    plain = [("plain", k, p, matching.url_rule(p, False)) for k, p in enumerate(["ACME", "a?c*", "[a&&b]", "*[ab]x"])]
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id int, url string")

    def hits(p, t):
        try:
            return re.search(p, t, re.I) is not None
        except re.error:
            return False

    expected = []
    for i, t in enumerate(TEXTS):
        if t is None:
            continue
        fits = [p for p in REGEXES if hits(p, t)]
        expected += [(i, f"list{REGEXES.index(p):02}", p) for p in fits] + [(i, "regexes", p) for p in fits[:1]]
        wild = [("ACME", "acme" in t.lower()), ("a?c*", re.fullmatch("a.c.*", t, re.I)), ("[a&&b]", "[a&&b]" in t), ("*[ab]x", re.fullmatch(".*[ab]x", t, re.I))]
        expected += [(i, "plain", p) for p, hit in wild if hit][:1]
    got = matching.match_patterns(rows, "url", alone + together + plain + filler)
    assert sorted(map(tuple, got.collect())) == sorted(expected)


def test_file_names(spark):
    lists = [("l", 0, "B*.exe", False), ("l", 1, "Beta.EXE", False), ("l", 2, "alpha.exe", False), ("l", 3, "ALPHA.exe", False), ("r", 0, "tool[0-9]+", True), ("r", 1, "(bad", True), ("k", 0, "x[12].txt", False), ("k", 1, "plain", False)]
    names = ["beta.exe", "ALPHA.EXE", "my-Tool42.zip", "x1.txt", "x3.txt", "plain", "plainer", None, "", "tool"]
    files = spark.createDataFrame([(i, n, "f") for i, n in enumerate(names)], "id int, file_name string, pattern string")
    got = matching.match_file_names(files, spark.createDataFrame(lists, "list_name string, idx int, pattern string, is_regex boolean"))
    assert sorted(map(tuple, got.collect())) == [(0, "l", "B*.exe"), (1, "l", "alpha.exe"), (2, "r", "tool[0-9]+"), (3, "k", "x[12].txt"), (5, "k", "plain")]
    assert matching.match_file_names(files, spark.createDataFrame(lists[1:2], "list_name string, idx int, pattern string, is_regex boolean")).count() == 1
