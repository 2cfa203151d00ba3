"""Second implementations of the two labelled scores, document by document, from their definitions."""

import math
import random
import zlib

import numpy as np
import pytest
from test_labelled import brute_segments

from casemill.llm.quality import forward, quality, statistics
from casemill.llm.toxicity import segments, toxicity


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(120)]
    docs, labels = [], []
    for i in range(500):
        w = [rng.choice(words) for _ in range(rng.randrange(0, 25))]
        for _ in range(3 * (i % 4 == 0)):
            w.insert(rng.randrange(len(w) + 1), rng.choice(["vile", "nasty", "awful", "Rotten"]))
        docs.append((i, " ".join(w) if i % 3 else " ".join(x.upper() + "!! |" for x in w)))
        if i % 7:
            labels.append((i, int(i % 3 > 0), int(i % 4 == 0)))
    docs += [(None, "vile nasty vile awful words"), (None, None), (600, ""), (600, "12 34"), (601, "vile " * 300), (601, "vile " * 300)]
    labels += [(9999, 1, 1), (0, 0, 0), (1, None, None), (None, 1, 1)]
    return docs, labels


def usable(labels, column, keep):
    known = {}
    for row in labels:
        if row[0] is not None and row[column] is not None and keep(zlib.crc32(str(row[0]).encode())):
            known[row[0]] = max(row[column], known.get(row[0], 0))
    return known


def letters(text):
    return "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()


def brute_toxicity(docs, labels):
    fit = usable(labels, 2, lambda c: c % 3 != 1 and c / 3 % 4 >= 1)
    tune = usable(labels, 2, lambda c: c % 3 != 1 and c / 3 % 4 < 1)
    size, words, stems = [0, 0], {}, {}
    for i, t in docs:
        if i in fit:
            size[fit[i]] += 1
            for table, own in ((words, set(letters(t))), (stems, {w[:4] for w in letters(t)})):
                for w in own:
                    table.setdefault(w, [0, 0])[fit[i]] += 1
    rate = (size[1] + 0.5) / (sum(size) + 1)
    base = math.log(rate / (1 - rate))

    def odds(w):
        s0, s1 = stems.get(w[:4], (0, 0))
        prior = 12 * (s1 + 12 * rate) / (s0 + s1 + 12)
        n0, n1 = words.get(w, (0, 0))
        return math.log((n1 + prior) / (n0 + 12 - prior)) - base - 0.7

    plain = [(n0, math.log((n1 + 12 * rate) / (n0 + 12 * (1 - rate))) - base - 0.7) for n0, n1 in words.values()]
    total = sum(n for n, _ in plain)
    low, high = 0.0, 20.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(n / total * math.exp(min(mid * s, 50)) for n, s in plain) < 1 else (low, mid)
    decay = max(low, 0.2)

    def value(t):
        s = [odds(w) for w in letters(t)]
        found = brute_segments(s) if len(s) < 40 else [x[:2] for x in segments(np.array(s))]
        logs = [math.log(max(1, len(s))) - decay * sum(s[a:b]) for a, b in found]
        return sum(math.log(0.5) - x for x in logs if x < math.log(0.5))

    sure = lambda t: min(value(t), 50)
    points = [(math.log1p(round(sure(t) * 4) / 4), tune[i]) for i, t in docs if i in tune]
    w = np.zeros(2)
    for _ in range(400):  # ridge-regularised logistic regression, plain Newton steps
        x, y = np.array([(a, 1.0) for a, _ in points]), np.array([b for _, b in points])
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag([0.05, 0.01]), x.T @ (y - p) - np.array([0.05, 0.01]) * w)
        w += np.clip(step, -2, 2)
    return [1 / (1 + math.exp(-(math.log1p(sure(t)) * w[0] + w[1]))) for _, t in docs]


def brute_quality(docs, labels):
    known = usable(labels, 1, lambda c: c % 5)
    x = [np.array(statistics(t or "")) for _, t in docs]
    own = [np.array([v for v, (i, _) in zip(x, docs) if known.get(i) == k]) for k in (0, 1)]
    d, scatter = len(x[0]), [(o - o.mean(0)).T @ (o - o.mean(0)) for o in own]
    pooled = sum(scatter) / sum(map(len, own))
    logs = []
    for o, s in zip(own, scatter):
        share = 0.9 * len(o) / (len(o) + 5 * d)
        cov = share * s / len(o) + (1 - share) * pooled
        cov = 0.95 * cov + 0.05 * np.diag(np.diag(cov)) + 1e-4 * np.eye(d)
        inverse, (_, det) = np.linalg.inv(cov), np.linalg.slogdet(cov)
        logs.append([-0.5 * (v - o.mean(0)) @ inverse @ (v - o.mean(0)) - 0.5 * det for v in x])
    return [1 / (1 + math.exp(-min(30, max(-30, b - a + math.log(len(own[1]) / len(own[0])))))) for a, b in zip(*logs)]


@pytest.mark.parametrize("operator, brute, parts, rest, threshold", [(toxicity, brute_toxicity, 3, 1, 0.7), (quality, brute_quality, 5, 0, 0.3)])
def test_scores(spark, operator, brute, parts, rest, threshold):
    docs, labels = corpus(8)
    expected = []
    for (i, _), s in zip(docs, brute(docs, labels)):
        expected.append((str(i), i is not None and zlib.crc32(str(i).encode()) % parts == rest, round(s, 4), int(s >= threshold)))
    frame = spark.createDataFrame([(i, t, 1.0, "c") for i, t in docs], "doc_id long, text string, score double, y string")
    got = operator(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    near = lambda a, b: a[:2] == b[:2] and abs(a[2] - b[2]) < 2e-3 and (a[3] == b[3] or abs(a[2] - threshold) < 2e-3)
    rows = sorted((str(r.doc_id), r.held_out, round(r.score, 4), r.predicted) for r in got)
    assert len(rows) == len(expected) and all(near(a, b) for a, b in zip(rows, sorted(expected)))
    assert 0 < sum(r.predicted for r in got) < len(got)


def test_score_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, "vile " * 100)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity(docs, none).collect()} == {0.5} == {r.score for r in quality(docs, none).collect()}
    clean = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    many = docs.union(spark.createDataFrame([(i, f"plain words {i}") for i in range(3, 40)], docs.schema))
    assert all(0 <= r.score < 0.2 for r in toxicity(many, clean).collect())


def test_strong_segments_stay_finite(spark):
    docs = [(i, "some plain words here" + " vile" * (i % 2)) for i in range(400)] + [(1000, "vile " * 40_000), (1001, "vile " * 400_000)]
    labels = [(i, 0, i % 2) for i in range(400)]
    got = {r.doc_id: r.score for r in toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert 0.9 < got[1000] <= got[1001] <= 1


def test_segments_of_a_million_tokens():
    scores = np.where(np.random.default_rng(3).random(1_000_000) < 0.25, 0.1, -0.05) * np.random.default_rng(4).random(1_000_000)
    found = segments(scores)
    assert found and all(a < b <= c for (_, a, _), (b, c, _) in zip(found, found[1:]))


def test_forward():
    rng = np.random.default_rng(5)
    factor, b = np.tril(rng.random((7, 7))) + np.eye(7), rng.random((7, 30))
    assert np.allclose(factor @ forward(factor, b), b)
