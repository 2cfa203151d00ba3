"""Nulls, ties, repeats, clashing columns, hot keys and very long texts; what the operators leave behind."""

import os
import random

import public_tokenizers
import pytest
from test_decontamination import brute as brute_contamination
from test_simhash import brute_fingerprint, grouped

import corpus_pipeline
from casemill.llm import common, simhash
from casemill.llm.decontamination import contamination
from casemill.llm.html_text import main_text
from casemill.llm.simhash import near_duplicates, text_fingerprint
from casemill.llm.suffix_dedup import repeat_digests
from casemill.llm.token_counts import token_counts

SF = "/root/testdata/sf0.001"


def test_frequent_keys_are_joined_whole(spark):
    rows = common.staged(spark.createDataFrame([(7 if k < 900 else k, k) for k in range(1500)] + [(None, -1)], "key long, v long"), "rows")
    lookup = spark.createDataFrame([(k, str(k)) for k in range(1, 1400)], "key long, name string")
    got = sorted((r.v, r.name) for r in common.looked_up(rows, lookup, "key").collect())
    assert got == [(k, "7" if k < 900 else str(k)) for k in range(1400)]


def test_ranges(spark):
    rng = random.Random(1)
    ids = [rng.choice([None, -(2**63), 2**63 - 1, 0, 7, rng.randrange(-50, 50)]) for _ in range(400)]
    docs = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    for descending in (False, True):
        keys = docs.select("doc_id", common.ordered_key("doc_id", descending).alias("key"), (common.F.lit(10).cast("long")).alias("bytes"))
        order = [r.doc_id for r in keys.orderBy("key").collect()]
        assert order == sorted(ids, key=lambda i: (i is None, -(i or 0)) if descending else (i is not None, i or 0))
        cuts = common.cut_points(keys, 300, 3)
        assert cuts == sorted(cuts) and len(cuts) == len(set(cuts)) and len(cuts) > 3
        for r in keys.select("key", common.range_number(common.F.col("key"), cuts).alias("n")).collect():
            assert r.n == sum(c <= r.key for c in cuts) - 1
    assert common.cut_points(docs.limit(0).selectExpr("'' as key", "1L as bytes"), 10) == []


def test_no_shared_folder_on_a_cluster(spark, monkeypatch):
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        common.shared_dir(Session)


def test_null_and_tied_ids(spark, tmp_path):
    texts = ["one two three four five six seven", "one two three four five six seven", None, "", "other words stand here", "One TWO three four five six seven eight nine ten"]
    rows = [(i, t) for t in texts for i in (None, None, 5)] + [(9, t) for t in texts]
    docs = spark.createDataFrame([(i, t, "c", 1, "d") for i, t in rows], "doc_id long, text string, fp string, row int, digest string")
    root = grouped([brute_fingerprint(t) for _, t in rows], lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for r, (i, _) in zip(root, rows):
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    expected = sorted(((i, f"{brute_fingerprint(t):016x}", least[r]) for r, (i, t) in zip(root, rows)), key=str)
    assert sorted(map(tuple, near_duplicates(docs).collect()), key=str) == expected
    alone = spark.createDataFrame([(None, "only here")], "doc_id long, text string")
    assert near_duplicates(alone).first().component_id is None
    items = [(1, "three four five six"), (None, "OTHER words"), (2, None)]
    got = contamination(docs, spark.createDataFrame(items, "item_id long, text string")).drop("item_ids").collect()
    assert sorted(map(tuple, got), key=str) == sorted(expected_hits(rows, items), key=str)
    counts = token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"), str(tmp_path / "cache")).collect()
    assert sorted((str(r.doc_id), r.n_bytes) for r in counts) == sorted((str(i), len((t or "").encode())) for i, t in rows)
    assert len(repeat_digests(docs).collect()) == len(rows)
    pages = spark.createDataFrame([(None, None, "<article>a</article>"), (None, None, "<article>a</article>"), (3, "x", None)], "page_id long, url string, html string")
    assert sorted((str(r.page_id), r.text) for r in main_text(pages).collect()) == [("3", ""), ("None", "a"), ("None", "a")]


def expected_hits(rows, items):
    """Items without an id hit like others but have no id to report."""
    named = brute_contamination(rows, [(i, t) for i, t in items if i is not None])
    every = brute_contamination(rows, [("-" if i is None else i, t) for i, t in items])
    by = {(str(r[0]), r[1]): r for r in named}
    return [(r[0], r[1], r[2], by[str(r[0]), r[1]][3], by[str(r[0]), r[1]][4], r[5]) for r in every]


def test_long_texts_in_slices(spark, monkeypatch):
    rng = random.Random(2)
    text = rng.choice([" ", "\n"]).join("".join(rng.choice("abcÀ") for _ in range(rng.randrange(1, 5))) for _ in range(4000))
    for t in (text, text[:7], "a b", "", "word" * 500):
        for size in (3, 64, 1 << 18):
            monkeypatch.setattr(simhash, "word_slices", lambda x, size=size: common.word_slices(x, size))
            assert text_fingerprint(t, 3) == brute_fingerprint(t)
    monkeypatch.undo()
    long = "This is a very long text of many words . " * 150_000  # beyond a piece
    got = {r.doc_id: r.fingerprint for r in near_duplicates(spark.createDataFrame([(1, long), (2, long[: len(long) // 2])], "doc_id long, text string")).collect()}
    assert got[1] == f"{text_fingerprint(long, 3):016x}" and got[1] == got[2]
    docs = spark.createDataFrame([(1, long + "the hidden answer is forty two"), (2, "the answer")], "doc_id long, text string")
    hits = {r.doc_id: (r.n_words, r.n_hit) for r in contamination(docs, spark.createDataFrame([(1, "Hidden answer is")], "item_id long, text string")).collect()}
    assert hits == {1: (150_000 * 9 + 6, 3), 2: (2, 0)}


def test_pipeline_leaves_its_result_only(spark):
    before = set(os.listdir(common.shared_dir(spark)))
    tables = {t.name for t in spark.catalog.listTables()}
    rows = corpus_pipeline.run(spark, SF).count()
    new = [x for x in os.listdir(common.shared_dir(spark)) if x not in before]
    assert rows > 0 and len(new) == 1 and os.listdir(f"{common.shared_dir(spark)}/{new[0]}") == ["4-bpe"]
    assert {t.name for t in spark.catalog.listTables()} == tables


def test_stages_on_clashing_columns_and_empty_tables(spark):
    texts = ["some words stand here " * 3, None, "some words stand here " * 3, "others do not", ""]
    rows = [(k if k != 3 else None, t, "en", "s", 1, "clash", b"x") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, fp binary")
    kept = {"toxicity": 5, "simhash_near_dedup": 3, "suffix_array_dedup": 5, "benchmark_decontamination": 5}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == list(corpus_pipeline.COLUMNS) and out.count() == kept[name], name
    none = spark.createDataFrame([], docs.schema)
    assert all(stage(spark, none, SF).count() == 0 for _, stage in corpus_pipeline.STAGES)
