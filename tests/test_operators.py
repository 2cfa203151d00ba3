"""Sources, sinks, scalars, similarity and streams on literal rows."""

import random

import pytest
from pyspark.sql import functions as F

from casemill.functions import scalars as S
from casemill.operators import filters, matching, records, similarity, textmine
from casemill.sources import readers
from casemill.streaming import feeds


def test_lists(spark, tmp_path):
    (tmp_path / "bad.txt").write_text("# NAME: x\nD41D8CD98F00B204E9800998ECF8427E, empty\n\nzz\n" + "a" * 64 + "\n")
    rows = sorted((r.list_name, r.kind, r.note) for r in readers.hash_list(spark, str(tmp_path / "bad.txt")).collect())
    assert rows == [("bad", "md5", "empty"), ("bad", "sha256", "")]
    (tmp_path / "p.txt").write_text("# REGEX: true\n^a+$\n# other\nb\n")
    assert [(r.idx, r.pattern, r.is_regex) for r in readers.pattern_list(spark, str(tmp_path / "p.txt")).orderBy("idx").collect()] == [(1, "^a+$", True), (3, "b", True)]


def test_body_file(spark, tmp_path):
    lines = [
        "0|/Users/john/file|name.txt|12345-128-1|r/rrwxrwxrwx|0|0|1024|1609459200|1609459200|1609459200|1609459200",
        "0|* /gone.txt|5|r/r|0|0|x|0|0|0|0",
        "0|/old.txt (deleted-realloc)|6|r/r|0|0|1|1|1|1|1",
        "0|/a ($FILE_NAME)|7|r/r|0|0|1|1|1|1|1",
        "0|/dir|8|d/drwx|0|0|1|1|1|1|1",
        "short|line",
    ]
    (tmp_path / "body").write_text("\n".join(lines))
    rows = sorted((r.file_path, r.file_name, r.inode, r.size_bytes, r.deleted) for r in readers.body_file(spark, str(tmp_path / "body")).collect())
    assert rows == [("/Users/john/file|name.txt", "file|name.txt", 12345, 1024, False), ("/gone.txt", "gone.txt", 5, None, True), ("/old.txt", "old.txt", 6, 1, True)]


def test_listing_and_features(spark, tmp_path):
    (tmp_path / "l.csv").write_text('Filename,Full Path,Size (bytes),Created,Is Deleted\na.txt,/x/a.txt,"1,024",2024-01-02 03:04:05,yes\n,,1,,\n')
    (row,) = readers.listing(spark, str(tmp_path / "l.csv")).collect()
    assert (row.file_path, row.file_name, row.size_bytes, row.deleted, str(row.created_ts)) == ("/x/a.txt", "a.txt", 1024, True, "2024-01-02 03:04:05")
    (tmp_path / "url.txt").write_text("# banner\n17940236\twww.example.com/path\tsome context\nx\thttp://b.c\ty\n")
    assert [tuple(r) for r in readers.feature_file(spark, str(tmp_path / "url.txt")).collect()] == [("url", 17940236, "http://www.example.com/path", "some context")]
    (tmp_path / "raw.bin").write_bytes(b"\0\xffhttps://www.acmeshop.com/sports\0http://localhost/abcdefgh ")
    assert [r.url for r in readers.urls_in_files(spark, str(tmp_path / "raw.bin")).collect()] == ["https://www.acmeshop.com/sports"]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    readers.replace_partition(spark.createDataFrame([(1, "a"), (2, "b")], "run int, v string"), path, ["run"])
    readers.replace_partition(spark.createDataFrame([(2, "c")], "run int, v string"), path, ["run"])
    assert sorted((r.run, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c")]
    readers.write_csv(spark.createDataFrame([(1, 'x"y')], "a int, b string"), str(tmp_path / "c"), True)
    assert spark.read.csv(str(tmp_path / "c"), header=True, escape="\\").first().a == "1"


def test_filters_refuse_unknown(spark):
    spec = filters.TableSpec("t", {"a": ("EQ",)}, ("a",))
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    for bad in ([("b", "EQ", 1)], [("a", "LIKE", "x")]):
        with pytest.raises(ValueError):
            filters.get_rows(df, spec, bad)
    with pytest.raises(ValueError):
        filters.get_rows(df, spec, order=[("b", "ASC")])
    with pytest.raises(ValueError):
        records.appended(df, df, ["a"], "FAIL")
    assert records.appended(df, df.withColumn("b", F.lit(9)), ["a"], "REPLACE").first().b == 9


def greedy(hashes, radius):
    leaders, out = [], {}
    for h in sorted(hashes):
        near = [x for x in leaders if (int(x, 16) ^ int(h, 16)).bit_count() <= radius]
        if not near:
            leaders.append(h)
        out[h] = near[0] if near else h
    return out


@pytest.mark.parametrize("radius", [4, 10])
def test_clusters_equal_the_greedy_loop(spark, radius):
    rng = random.Random(radius)
    values = []
    for _ in range(20):
        v = rng.getrandbits(64)
        for _ in range(8):
            values.append(f"{v:016x}")
            for _ in range(rng.randrange(1, 6)):
                v ^= 1 << rng.randrange(64)
    images = spark.createDataFrame(list(enumerate(values + ["bad", None])), "id long, phash string")
    assert {r.phash: r.leader for r in similarity.leader_clusters(images, radius).collect()} == greedy(set(values), radius)
    pairs = {(r.a, r.b) for r in similarity.near_pairs(images, radius).collect()}
    assert pairs == {(a, b) for a in values for b in values if a < b and (int(a, 16) ^ int(b, 16)).bit_count() <= radius}


def test_text(spark):
    value = '{"access_token": "x"} see https%3A%2F%2Fa.example%2Fb%3Fc, http://b.example/x. mail me@b.example user@example.com'
    row = spark.createDataFrame([(value,)], "v string").select(textmine.urls_in(F.col("v")).alias("u"), textmine.emails_in(F.col("v")).alias("e")).first()
    assert row.u == ["https://a.example/b?c", "http://b.example/x"] and row.e == ["me@b.example"]
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJpc3MiOiJtZSIsImV4cCI6MTAwfQ.sig"
    got = spark.createDataFrame([(jwt,)], "v string").select(textmine.token_type(F.lit("k"), F.col("v")).alias("t"), textmine.jwt_claims(F.col("v")).alias("c")).select("t", "c.iss", "c.exp").first()
    assert tuple(got) == ("jwt", "me", 100)


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    assert value(S.extension(F.lit("http://example.com"))) == ".com" and value(S.extension(F.lit("/a/.hidden"))) == "" and value(S.extension(F.lit("a/b.tar.GZ?x=1.2"))) == ".gz"
    assert value(S.registered_domain(F.lit("www.shop.co.uk"))) == "shop.co.uk" and value(S.registered_domain(F.lit("192.168.1.100"))) == "192.168.1.100"
    assert value(S.transition(F.lit(0x01000001))) == "TYPED|FROM_ADDRESS_BAR" and value(S.from_webkit(F.lit(0))) is None
    assert value(S.image_type(F.lit(bytes.fromhex("89504E470D0A1A0A00")))) == "png" and value(S.duration_text(F.lit(7200))) == "2.0 hours"
    assert str(value(S.from_fat(F.lit(0x5821), F.lit(0x1884)))) == "2024-01-01 03:04:08"
    assert value(S.user_of_path(F.lit("C:\\Users\\Ann\\x"))) == "Ann"


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, "http://m.x/"), (2, "no")], "id long, url string").write.parquet(str(tmp_path / "in"))
    rules = [("l", 0, "http://m.*", matching.url_rule("http://m.*", False))]
    feed = spark.readStream.schema("id long, url string").parquet(str(tmp_path / "in"))
    feeds.run_sink(feeds.matched_feed(feed, rules), str(tmp_path / "out"), str(tmp_path / "cp"), ["list_name"]).awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("id", "pattern").collect()] == [(1, "http://m.*")]
    events = spark.createDataFrame([("2024-01-01 05:00:00", "click"), ("2024-01-01 06:00:00", "click"), ("2024-01-09 00:00:00", "view")], "t string, kind string").select(F.col("t").cast("timestamp").alias("ts"), "kind")
    events.write.parquet(str(tmp_path / "ev"))
    q = feeds.daily_feed(spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))).writeStream.outputMode("append").format("memory").queryName("daily").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(str(r.day), r.kind, r.n) for r in spark.table("daily").collect()][:1] == [("2024-01-01", "click", 2)]


def test_times_near_every_url(spark):
    import re

    fill = "lorem ipsum é " * 60
    times = ["1700000000123", "1700000001", "2024-05-06T07:08:09"]
    texts = [None, "", fill, f"http://a.example/x {times[0]}", fill + f"{times[1]} <a href='HTTPS://b.example/y'>" + fill + f"http://c.example {fill}" + f"http://d.example/ {times[2]} {times[1]}"]
    texts += [" " * n + times[2] + " " * 180 + "http://e.example/" + " " * (170 + n) + times[0] for n in (0, 5)] + ["http://f.example/" + " " * 190 + times[0]]
    expected = []
    for i, t in enumerate(texts):
        for m in re.finditer(r"https?://[^\s\"'<>\]})\\,]+", t or "", re.I):
            near = t[max(0, m.start() - 200) : m.start() + 200]
            found = [re.search(p, near) for p in (r"\b1[0-9]{12}\b", r"\b1[0-9]{9}\b", r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}")]
            expected.append((i, m.start() + 1, next((f[0] for f in found if f), None)))
    got = textmine.url_times(spark.createDataFrame(list(enumerate(texts)), "id long, text string")).collect()
    assert sorted(map(tuple, got)) == expected and {e[2] for e in expected} >= {None, *times}
