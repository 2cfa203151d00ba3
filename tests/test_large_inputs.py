"""Work that has to be dealt to more tasks, or to fewer, as the tables grow."""

import glob

from pyspark.sql import functions as F

from casemill import queries_case, tables
from casemill.operators import stored_values, textmine
from casemill.sources import raw


def test_arriving_tables_are_not_written_by_one_task(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries_case.QUERIES["R-1hashes"](spark, str(tmp_path)).collect()
    wanted = queries_case.QUERIES["R-1hashes"](spark, "/root/testdata/sf0.001").collect()
    turns = [f for f in tables._FOLDERS if "/turns-" in f][-2]
    assert len(glob.glob(f"{turns}/*.parquet")) > 3
    assert sorted(got) == sorted(wanted) and {r.batch_id for r in got} == {0, 1, 2}


def test_small_ranges_and_files_share_tasks(spark, tmp_path):
    texts = [b"".join(b"https://h%d.example.com/p%d\x00" % (k, i) for i in range(3_000 * (k < 2) + 3)) for k in range(40)]
    for k, text in enumerate(texts):
        (tmp_path / f"f{k:02}").write_bytes(text)
    wanted = sorted((f"{tmp_path}/f{k:02}", text.index(b"https://h%d.example.com/p%d\x00" % (k, i)), f"https://h{k}.example.com/p{i}") for k, text in enumerate(texts) for i in range(3_000 * (k < 2) + 3))
    for split in (7, 997, 1 << 20):
        got = raw.raw_urls(spark, str(tmp_path), split)
        assert got.rdd.getNumPartitions() == 1
        assert sorted(map(tuple, got.collect())) == wanted
    size = 3 * raw.TOGETHER + 5
    dealt = raw.shares([("a", size), ("b", 10), ("c", 10)], 997)
    stretches = [x for share in dealt for x in share.stretches]
    assert len(dealt) == 4 and [x[2:] for x in stretches if x[0] == "a"] == [(k * 8413 * 997, min(size, (k + 1) * 8413 * 997)) for k in range(4)] and raw.TOGETHER // 997 == 8413
    assert {x[0] for x in dealt[-1].stretches} == {"a", "b", "c"}


def test_urls_of_many_texts_go_on_together(spark, monkeypatch):
    batches = []
    frame = type(spark.range(1))
    plain = frame.mapInArrow

    def kept(self, run, schema, *more):
        batches.append(run)
        return plain(self, run, schema, *more)

    monkeypatch.setattr(frame, "mapInArrow", kept)
    rows = spark.range(25_000).select("id", F.lit("o").alias("origin"), F.lit("k").alias("key"), F.concat(F.lit("x http://h"), "id", F.lit(".example.com 1600000000")).alias("value"))
    assert stored_values._url_uses(rows).where("raw = concat('http://h', id, '.example.com') and inner = 3").count() == 25_000
    assert textmine.url_times(rows.selectExpr("id", "value as text")).where("found = '1600000000' and at = 3").count() == 25_000
    table = rows.toArrow()
    for run, names in zip(batches, (["id", "origin", "key", "value"], ["id", "value"])):
        assert [b.num_rows for b in run(iter(table.select(names).to_batches(max_chunksize=1_000)))] == [10_000, 10_000, 5_000]
