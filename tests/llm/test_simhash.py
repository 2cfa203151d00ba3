import random

import numpy as np
import pytest
import xxhash

from casemill.llm.components import components
from casemill.llm.simhash import near_duplicates, near_links, trie_links


def brute_fingerprint(text):
    words = ("" if text is None else text).encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def grouped(values, near):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def planted(rng, n):
    base = [rng.getrandbits(64) for _ in range(n // 4)]
    out = {0, 1, 3, 2**64 - 1}
    while len(out) < n:
        v = rng.choice(base)
        for _ in range(rng.randrange(6)):
            v ^= 1 << rng.randrange(64)
        out.add(v)
    return sorted(out)


def test_trie_equals_brute_force():
    rng = random.Random(1)
    for dense in (0, 1):
        values = planted(rng, 600) if not dense else sorted({rng.getrandbits(12) for _ in range(900)})
        i, j = trie_links(np.zeros(len(values), np.int64), np.array(values, np.uint64), 3)
        root = np.arange(len(values))
        root[i] = j
        assert root.tolist() == grouped(values, lambda a, b: (a ^ b).bit_count() <= 3)


@pytest.mark.parametrize("group", [100_000, 40])
def test_links_and_components(spark, group):
    values = planted(random.Random(group), 500)
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = {r.node: r.component for r in components(near_links(frame, 3, group)).collect()}
    expected = grouped(values, lambda a, b: (a ^ b).bit_count() <= 3)
    mine = [found.get(v, v) for v in signed]
    assert len({*zip(mine, expected)}) == len({*mine}) == len({*expected})


def test_near_duplicates(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(50)] + ["É", "Ab", "日本"]
    texts = [None, "", " \t\x0b", "one", "one two", "one two THREE", "one  two\nthree", "x\xa0y", "a" * 50_000]
    for _ in range(25):
        t = [rng.choice(words) for _ in range(rng.randrange(3, 400))]
        texts.append(" ".join(t))
        for _ in range(3):
            t[rng.randrange(len(t))] = "edit"
            texts.append("  ".join(t))
    texts += texts[:12]
    rows = [(i, t, "c", 0) for i, t in enumerate(texts)] + [(3, "other text here", "c", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, fp int")
    fps = [brute_fingerprint(r[1]) for r in rows]
    root = grouped(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for r, row in zip(root, rows):
        least[r] = min(least.get(r, 10**9), row[0])
    expected = sorted((row[0], f"{f:016x}", least[r]) for row, f, r in zip(rows, fps, root))
    assert sorted(map(tuple, near_duplicates(docs).collect())) == expected
    assert near_duplicates(docs.limit(0)).count() == 0
