import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from casemill.llm import suffix_dedup
from casemill.llm.suffix_dedup import repeat_digests


def brute(rows):
    least, out = {}, []
    rows = [(-1 if i is None else i, t) for i, t in rows]
    for doc_id, text in rows:
        raw = (text or "").encode()
        for i in range(len(raw) - 99):
            least[raw[i : i + 100]] = min(doc_id, least.get(raw[i : i + 100], doc_id))
    for doc_id, text in rows:
        raw, own = (text or "").encode(), set()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            w = raw[i : i + 100]
            if least[w] < doc_id or w in own:
                gone[i : i + 100] = b"\1" * 100
            own.add(w)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((None if doc_id < 0 else doc_id, len(raw), sum(gone), len(bytes(gone).replace(b"\0", b" ").split()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = ["the", "of", "é", "wörld", "日本", "x"] + ["".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 9))) for _ in range(80)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [text(rng.randrange(5, 80)) for _ in range(8)] + ["ab" * 90, "a" * 104, *["".join(random.Random(n).choice("pqrs") for _ in range(n)) * 5 for n in (21, 61, 69)], "line repeated\n" * 30]
    docs = [None, "", "short", "a" * 99, "a" * 100, "a" * 101, "abc" * 400, "x" * 3000]
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            parts.append(text(rng.randrange(0, 60)))
            own = rng.choice(shared)
            k = rng.randrange(len(own))
            parts.append(own[k : k + rng.randrange(50, 400)])
        docs.append(rng.choice([" ", ""]).join(parts))
    docs += [docs[20], docs[21][:-1], "z" + docs[22]]
    rows = [(i, t) for i, t in enumerate(docs)]
    return rows + [(None, docs[33] + "tail"), (30, docs[31]), (30, docs[31]), (31, docs[31])]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed, monkeypatch):
    rows = corpus(seed)
    if seed == 2:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, places string")
        assert sorted(map(tuple, repeat_digests(docs).collect()), key=str) == brute(rows)
        assert repeat_digests(docs.limit(0)).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_units_cover_all_windows_in_any_chunks(monkeypatch):
    texts = [t for _, t in corpus(3)]
    data, offsets = suffix_dedup.flat_bytes(pa.array(texts))
    whole = suffix_dedup.text_units(data, offsets)
    assert whole["windows"].sum() == sum(max(0, n - 99) for n in np.diff(offsets))
    monkeypatch.setattr(suffix_dedup, "CHUNK", 501)
    cut = suffix_dedup.text_units(data, offsets)
    assert cut["windows"].sum() == whole["windows"].sum() and cut["windows"].max() <= 100


def test_texts_of_one_id_with_equal_low_hash_bits(spark):
    rng = random.Random(6)
    shared = "".join(rng.choice("abcdef") for _ in range(130))
    texts = [(shared + f" {k}" if k % 2 else f"{k} begins " * 9 + shared) for k in range(24_000)]
    marks = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, text string").selectExpr("k", "xxhash64(text) & 8388607 row").collect()
    seen = {r.row: r.k for r in marks if r.k % 2}
    pairs = [(seen[r.row], r.k) for r in marks if r.k % 2 == 0 and r.row in seen]
    assert pairs
    for doc_id in (None, 7):
        rows = [(doc_id, texts[k]) for k in pairs[0]]
        got = repeat_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted(map(tuple, got), key=str) == brute(rows)
        assert not any(r.n_removed for r in got)


@pytest.mark.parametrize("seed", [1, 4])
def test_every_name_frequent(spark, seed, monkeypatch):
    """The way of names with very many units, taken by all names."""
    rows = corpus(seed)
    monkeypatch.setattr(suffix_dedup, "often", lambda names: sorted({r["name"] for r in names.where("name is not null").collect()}))
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, places string")
    assert sorted(map(tuple, repeat_digests(docs).collect()), key=str) == brute(rows)


def test_frequent_names(spark):
    """A common line in ever other surroundings: its name is found, names below a share are not needed."""
    rng = random.Random(7)
    line = "".join(rng.choice("abcdef") for _ in range(120))
    texts = ["".join(rng.choice("ghijkl") for _ in range(150)) + line + "".join(rng.choice("mnopqr") for _ in range(150)) for _ in range(400)]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, row long")
    names = suffix_dedup.often(suffix_dedup.unit_names(docs))
    data, offsets = suffix_dedup.flat_bytes(pa.array(texts))
    own, n = np.unique(suffix_dedup.text_units(data, offsets)["name"].view(np.int64), return_counts=True)
    tasks = 4
    assert set(own[n > n.sum() / (4 * tasks)]) <= set(names) <= set(own[n > n.sum() / (8 * tasks)]) and names
    got = repeat_digests(docs.drop("row")).collect()
    assert sorted(map(tuple, got), key=str) == brute(list(enumerate(texts)))


def test_smallest_id_is_not_null(spark):
    rng = random.Random(8)
    text = "".join(rng.choice("abcdef") for _ in range(150))
    rows = [(None, text), (-(2**63), text), (-(2**63) + 1, text), (5, text)]
    got = {r.doc_id: r.n_removed for r in repeat_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {None: 0, -(2**63): 0, -(2**63) + 1: 150, 5: 150}
