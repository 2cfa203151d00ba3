"""Second implementations of the weighted fingerprint, the edited order with nulls and ties, and the search."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import xxhash

from casemill.llm import fingerprints as module
from casemill.llm.common import staged, word_slices
from casemill.llm.fingerprints import BITS, edited_fingerprints, fingerprint, near_search, with_near_counts


def brute_fingerprint(text):
    w = [x for x in text.translate({k: k + 32 for k in range(65, 91)}).encode().split()]
    terms = Counter(w) + Counter(a + b" " + b for a, b in zip(w, w[1:]))
    votes = [0.0] * BITS
    for term, n in terms.items():
        h = xxhash.xxh3_128_intdigest(term)
        for k in range(BITS):
            votes[k] += (1 if h >> (BITS - 1 - k) & 1 else -1) * (1 + math.log(n))
    return sum(1 << (BITS - 1 - k) for k in range(BITS) if votes[k] > 1e-6), min(map(abs, votes), default=1)


def test_fingerprint(monkeypatch):
    rng = random.Random(2)
    words = [f"Wört{i}" for i in range(200)] + ["a", "É"]
    for n in (0, 1, 2, 7, 90, 1500):
        for _ in range(4):
            text = rng.choice([" ", "\n", " \t"]).join(rng.choice(words) for _ in range(n))
            expected, margin = brute_fingerprint(text)
            if margin > 1e-3:  # no bit is a tie
                assert fingerprint(text).tobytes().hex() == f"{expected:032x}"
                monkeypatch.setattr(module, "LONG", 0)
                monkeypatch.setattr(module, "word_slices", lambda t: word_slices(t, 64))
                assert fingerprint(text).tobytes().hex() == f"{expected:032x}"
                monkeypatch.undo()


def test_order_with_nulls_and_ties(spark):
    rng = random.Random(3)
    text = lambda: " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(30)))
    rows = [(rng.choice([None, None, 5, 5, 5, -3, 2**63 - 1, -(2**63), 40, 60]), rng.choice([None, "same", text(), text(), "common beginning of texts " + text()])) for _ in range(120)]
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    expected = []
    for (i, t), (_, u) in zip(ordered, ordered[1:] + ordered[:1]):
        k = len(t) // 2
        expected.append((str(i), len(t), hashlib.sha256((t[: len(t) - k] + u[:k]).encode()).hexdigest()))
    docs = spark.createDataFrame([(i, t, "c", True) for i, t in rows], "doc_id long, text string, part string, halo boolean")
    for tasks in (1, 3, 50):
        got = edited_fingerprints(docs, tasks).collect()
        assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted(expected)


def test_search(spark):
    rng = random.Random(4)
    values = [rng.getrandbits(BITS) for _ in range(30)]
    dense = rng.getrandbits(BITS)
    values += [v ^ (1 << rng.randrange(BITS)) ^ (1 << rng.randrange(BITS)) for v in values for _ in range(4)]
    values += [dense ^ (k << 3) for k in range(40)]  # one block value for all, in the first tables
    values = sorted({f"{v:032x}" for v in values} | {"0" * 32})
    near = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    fps, queries = (spark.createDataFrame([(v,) for v in x] * 2, "fp string") for x in (values, values[::3]))
    for radius in (3, 6):
        expected = sorted((a, b, near(a, b)) for a in values[::3] for b in values if a != b and near(a, b) <= radius)
        for group in (1000, 5):
            assert sorted(map(tuple, near_search(queries, fps, radius, group).collect())) == expected
    rows = [(k if k % 9 else None, rng.choice(values)) for k in range(300)]
    table = staged(spark.createDataFrame([(i, f) for i, f in rows], "doc_id long, fingerprint string"), "rows")
    expected = [(i, f, None if i is None or i % 20 else sum(near(f, g) <= 3 for _, g in rows) - 1) for i, f in rows]
    assert sorted(map(tuple, with_near_counts(table).collect()), key=str) == sorted(expected, key=str)


def test_memory_of_a_long_text():
    import tracemalloc

    rng = np.random.default_rng(1)
    text = " ".join(np.char.mod("%x", rng.integers(0, 1 << 20, 1_500_000)).tolist())
    tracemalloc.start()
    fingerprint(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * len(text)
