"""Phrases against a brute-force count; quotient filters give back what was put in."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from casemill.llm import collocations as module
from casemill.llm.collocations import collocations, slices
from casemill.llm.quotient_filter import Grams, loaded, segments


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows, least=10, inside=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in (1, 2, 3):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()):
                continue
            score, k = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def texts(seed, n):
    rng = random.Random(seed)
    words = [rng.choice(["ab", "Öl", "cd\x00", "É", "the", "of", "x\x0by", "naïve", " ", "𝔘n", "z" * 40]) + str(i) for i in range(60)] + ["the", "The", "of", "a"] * 8
    return [(rng.choice(["en", "en", "en", "de", None, "und", "xx"]), rng.choice([None, "", "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "?!"]) for _ in range(rng.randrange(300)))])) for _ in range(n)]


@pytest.mark.parametrize("bits,segment,chunk", [(None, module.SEGMENT, module.CHUNK), (22, 50, 500), (42, 7, 90)])
def test_against_brute_force(spark, bits, segment, chunk):
    rows = texts(7, 250)
    docs = spark.createDataFrame([(k % 5 or None, t, lang, "w", 1) for k, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, word string, id int")
    got = sorted(map(tuple, collocations(docs.repartition(3), chunk=chunk, bits=bits, segment=segment).collect()))
    assert got == brute(rows) and len(got) > 50


def test_limits_ties_and_cuts(spark):
    rows = [("en", "b a. " * 12 + "c d, " * 12 + "e f; g h i " * 10 + "g h. " * 9), (None, "x x x x x x x x x x x x"), ("short", "a b")]
    docs = spark.createDataFrame([(t, lang) for lang, t in rows], "text string, lang string")
    assert sorted(map(tuple, collocations(docs).collect())) == brute(rows)
    assert sorted(map(tuple, collocations(docs, top=2).collect())) == brute(rows, top=2)
    assert sorted(map(tuple, collocations(docs, least=1, inside=101).collect())) == brute(rows, 1, 101)
    assert collocations(docs.limit(0)).collect() == []
    assert collocations(docs.where("lang = 'short'")).collect() == []


def test_large_counts_stay_exact(spark):
    from pyspark.sql import functions as F

    big = [(3_000_000_000_000_001, 3_000_000_000_000_003, 9_999_999_999_999_999), (10, 11, 12), (7, 7, 7)]
    got = spark.createDataFrame(big, "a long, l long, r long").select(module._score(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()
    assert [r.s for r in got] == [1_000_000 * a * a // (left * right) for a, left, right in big]


def test_slices_end_behind_pieces():
    rng = random.Random(3)
    for _ in range(200):
        raw = bytes(rng.choice(b"abc .,\n") for _ in range(rng.randrange(80))) + b"q" * rng.choice([0, 30])
        parts = list(slices(raw, rng.randrange(1, 20)))
        assert b"".join(parts) == raw and all(module.KIND[p[-1]] == 2 for p in parts[:-1])


@pytest.mark.parametrize("bits", [1, 2, 7, 20, 21, 22, 33, 42])
def test_filters_lose_nothing(bits):
    rng = np.random.default_rng(bits)
    grams = Grams(bits)
    ids = rng.integers(0, 1 << bits, (3, 5000), dtype=np.int64)
    high, low = grams.pack(*ids)
    assert all((a == b).all() for a, b in zip(grams.unpack(high, low), ids))
    assert int(max(high.max(), low.max())) < 1 << grams.half
    expected = Counter(zip(*ids.tolist()))
    for k in list(expected)[:20]:
        expected[k] += 1000
    keys = np.array(list(expected), np.int64).T
    counts = np.array(list(expected.values()), np.int64)
    for segment_bits in {0, 1, min(4, grams.half), min(9, grams.half)}:
        entries = [grams.counted(*(x[part] for x in (*grams.pack(*keys), counts))) for part in (slice(None, None, 2), slice(1, None, 2))]
        stored = [x for e in entries for x in segments(grams, segment_bits, *e)]
        parts = [loaded(grams, segment_bits, s, blob) for s, blob in stored]
        merged = grams.counted(*(np.concatenate(x) for x in zip(*parts)))
        assert Counter(dict(zip(zip(*(x.tolist() for x in grams.unpack(*merged[:2]))), merged[2].tolist()))) == expected
    with pytest.raises(ValueError):
        Grams(43)
