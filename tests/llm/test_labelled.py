import itertools
import random
import zlib

import numpy as np

from pyspark.sql import functions as F

from casemill.llm.labelled import learnable
from casemill.llm.quality import quality
from casemill.llm.toxicity import count_tokens, segments, toxic_segments, toxicity


def brute_segments(s):
    """The definition: take the best segment, then go on left and right of it."""
    def go(a, b):
        best = max(((sum(s[i:j]), -(j - i), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
        if not best or best[0] <= 0:
            return []
        return go(a, best[2]) + [(best[2], best[3])] + go(best[3], b)
    return go(0, len(s))


def test_segments():
    rng = random.Random(1)
    for _ in range(200):
        s = [rng.choice([-3.1, -1.07, 0.53, 1.31, 2.77]) + rng.random() * 1e-3 for _ in range(rng.randrange(14))]
        assert [x[:2] for x in segments(np.array(s))] == brute_segments(s)


def corpus():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    bad = ["vile", "nasty", "awful", "rotten"]
    docs, labels = [], []
    for i in range(1200):
        w = [rng.choice(words) for _ in range(rng.randrange(20, 200))]
        toxic, good = i % 7 == 0, i % 5 != 0
        for _ in range(5 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        text = " ".join(w)
        docs.append((i, text if good else " ".join(x.upper() + "!! |" for x in w), "c"))
        labels.append((i, int(good), int(toxic)))
    docs += [(5000, None, "c"), (5001, "", "c"), (5002, "12 34", "c"), (5003, "vile " * 30_000, "c"), (5003, "vile", "c")]
    labels += [(9999, 1, 1), (0, 0, 1), (1, None, None)]
    return docs, labels


def test_operators(spark):
    rows, marks = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    for op, parts, rest, column in ((toxicity, 3, 1, 2), (quality, 5, 0, 1)):
        got = op(docs, labels).collect()
        assert len(got) == len(rows)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == rest) and 0 <= r.score <= 1 for r in got)
        truth = {m[0]: m[column] for m in marks[:1200]}
        held = [(r.score, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth and r.doc_id > 1]
        pairs = [(a > b) + 0.5 * (a == b) for (a, x), (b, y) in itertools.product(held, held) if x and not y]
        assert sum(pairs) / len(pairs) > 0.97, op
        assert op(docs.limit(0), labels).count() == 0
        assert op(docs, labels.limit(0)).count() == len(rows)
    model = count_tokens(docs, labels.where("toxic is not null").selectExpr("doc_id", "toxic y").dropDuplicates(["doc_id"]))
    found = [r for r in toxic_segments(docs, model).collect() if r.doc_id < 1200]
    assert found and all({"vile", "nasty", "awful", "rotten"} & set(r.passage.split()) for r in found)


def test_words_keep_their_own_counts(spark):
    """A word that no labelled document has scores like any other such word, whatever hash it shares in part."""
    cells, strangers = {zlib.crc32(b"vile") & 0x7FFFF: "vile"}, []
    for n in itertools.count():
        word = "zz" + "".join(chr(97 + int(c)) for c in str(n))
        if zlib.crc32(word.encode()) & 0x7FFFF in cells:
            strangers.append(word)
            break
    rows = [(i, "some plain words here" + " vile" * (i % 2)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = count_tokens(docs, spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, y int"))
    vile, stranger, other, plain = model.scores(["vile", strangers[0], "zzz", "plain"])
    assert stranger == other and vile > 1 + stranger
    assert np.isclose(plain, np.log((30 + 12 * 0.5) / (30 + 12 * 0.5)) - 0.7)


def test_toxicity_has_no_ties_of_strong_documents_and_a_bound(spark):
    docs = [(i, "some plain words here" + (" vile" * (i // 2)) * (i % 2)) for i in range(400)]
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(400)], "doc_id long, quality int, toxic int")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity(frame, labels).collect()}
    strong = [got[i] for i in range(101, 400, 2)]
    assert all(a < b for a, b in zip(strong, strong[1:])) and max(got[i] for i in range(0, 400, 2)) < min(strong)
    assert learnable(labels, "toxic", F.lit(True), 100).count() in range(60, 140) and learnable(labels, "toxic", F.lit(True), 400).count() == 400
    few = {r.doc_id: r.score for r in toxicity(frame, labels, fit_documents=100).collect()}
    assert all(few[i] > few[j] for i in range(101, 400, 2) for j in range(0, 400, 20))
