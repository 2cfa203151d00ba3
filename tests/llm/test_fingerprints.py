import hashlib
import random

from casemill.llm.fingerprints import BITS, edited_fingerprints, fingerprint, fingerprint_table, likeness, near_pairs


def test_edited(spark):
    rng = random.Random(5)
    words = [f"wörd{i}" for i in range(3000)]
    texts = [None, "", "a", "日本語😀"] + [" ".join(rng.choice(words) for _ in range(rng.randrange(400))) for _ in range(60)] + ["same text here"] * 3
    rows = [(i * 3, t, "c") for i, t in enumerate(texts)] + [(6, "tie", "c"), (6, "tie", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    order = sorted(rows, key=lambda r: (-r[0], (r[1] or "").encode()))
    expected = []
    for a, b in zip(order, order[1:] + order[:1]):
        t, u = a[1] or "", b[1] or ""
        k = len(t) // 2
        e = t[: len(t) - k] + u[:k]
        x, y, z = fingerprint(t), fingerprint(e), fingerprint(u)
        expected.append((a[0], len(t), hashlib.sha256(e.encode()).hexdigest(), x.tobytes().hex(), y.tobytes().hex(), likeness(x, y), likeness(x, z)))
    for parts in (1, 7, 200):
        assert sorted(map(tuple, edited_fingerprints(docs, parts).collect())) == sorted(expected)
    assert edited_fingerprints(docs.limit(0)).count() == 0
    one = edited_fingerprints(docs.where("doc_id = 9")).first()
    assert one.near_next == 1.0
    long = [r for r in expected if r[1] > 800]
    assert sum(r[5] for r in long) / len(long) > 0.4 > 0.2 > sum(r[6] for r in long) / len(long)
    table = {r.doc_id: r.fp for r in fingerprint_table(docs).collect()}
    assert table[9] == fingerprint("日本語😀").tobytes().hex() and len(table[9]) * 4 == BITS


def test_near_pairs(spark):
    rng = random.Random(6)
    values = set()
    for _ in range(40):
        v = rng.getrandbits(BITS)
        for _ in range(6):
            values.add(v)
            for _ in range(rng.randrange(4)):
                v ^= 1 << rng.randrange(BITS)
    values = sorted(f"{v:032x}" for v in values)
    fps = spark.createDataFrame([(v, 1) for v in values] * 2, "fp string, a int")
    expected = sorted((a, b, n) for a in values for b in values if a < b and (n := (int(a, 16) ^ int(b, 16)).bit_count()) <= 7)
    assert sorted(map(tuple, near_pairs(fps, 7).collect())) == expected
