import hashlib
import random

import public_tokenizers
from test_decontamination import brute as brute_contamination
from test_simhash import brute_fingerprint, grouped
from test_suffix_dedup import brute as brute_repeats
from tokenizers import Tokenizer

import corpus_pipeline
from casemill.llm.common import read_table
from casemill.llm.suffix_dedup import without_repeats
from casemill.llm.toxicity import toxicity

SF = "/root/testdata/sf0.001"


def test_pipeline_against_brute_force(spark):
    docs = read_table(spark, SF, "documents")
    toxic = {r.doc_id for r in toxicity(docs, read_table(spark, SF, "labels")).collect() if r.predicted}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id not in toxic)
    fps = [brute_fingerprint(t) for _, t in rows]
    root = grouped(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    rows = [r for k, r in enumerate(rows) if root[k] == k]
    kept = {r.doc_id: r.text for r in without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    expected = {r[0]: r[4] for r in brute_repeats(rows)}
    whole = {i: t for i, t in kept.items() if hashlib.sha256(t.encode()).hexdigest() == expected[i]}
    assert len(whole) > 0.8 * len(rows)  # the rest lost a cut character
    items = [(r.item_id, r.text) for r in read_table(spark, SF, "benchmark").collect()]
    clean = {r[0] for r in brute_contamination(sorted(kept.items()), items) if not r[5]}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    result = []
    for i in clean:
        ids = library.encode(kept[i], add_special_tokens=False).ids
        result.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert 0 < len(clean) < len(kept)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(result)


def test_stages_keep_columns(spark):
    docs = read_table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == list(corpus_pipeline.COLUMNS)


def test_null_and_tied_ids_in_every_stage(spark, tmp_path):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    text = lambda *more: " ".join([rng.choice(words) for _ in range(60)] + [*more])
    train = [(i, text(*(["vile", "nasty"] * 4 if i % 5 == 0 else [])), "en", "s", 1) for i in range(600)]
    toxic, passage = text(*["vile", "nasty"] * 6), text()
    copy, clean = text(), [text() for _ in range(6)]
    rows = [
        (None, clean[0], "en", "s", 1), (None, clean[1], "en", "s", 1), (None, toxic, "en", "s", 1),
        (7000, clean[2], "en", "s", 1), (7000, toxic, "en", "s", 1), (None, clean[3] + " " + passage, "en", "s", 1),
        (7001, clean[4], "en", "s", 1), (7001, passage, "en", "s", 1), (7002, copy, "en", "s", 1), (None, copy, "en", "s", 1),
        (7003, copy, "en", "s", 1), (7003, clean[5], "en", "s", 1), (None, None, None, None, None),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(600)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def left(stage, docs):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == list(corpus_pipeline.COLUMNS)
        return sorted([(r.doc_id, r.text) for r in out.collect() if r.doc_id is None or r.doc_id >= 7000], key=str)

    own = lambda keep: sorted([r[:2] for r in rows if keep(*r[:2])], key=str)
    docs = spark.createDataFrame(rows, schema)
    assert left(corpus_pipeline.without_toxic, docs.union(spark.createDataFrame(train, schema))) == own(lambda i, t: t != toxic)
    assert left(corpus_pipeline.without_near_copies, docs.union(docs)) == own(lambda i, t: (t != copy or i == 7002) and (t != toxic or i == 7000))
    assert left(corpus_pipeline.without_benchmark, docs) == own(lambda i, t: passage not in (t or ""))
    assert len(left(corpus_pipeline.without_long_repeats, docs)) == len(rows)
