import hashlib
import random
import re

import duckdb

from casemill.llm.decontamination import ORACLE, contamination


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(docs, items):
    windows = set()
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        windows |= {(str(item), tuple(w[i : i + n])) for i in range(len(w) - n + 1) if n}
    out = []
    for doc_id, text in docs:
        w, hit, ids = words(text), set(), set()
        for item, win in windows:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    ids.add(item)
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_contamination(spark):
    rng = random.Random(2)
    vocabulary = ["the", "of", "É", "zü", "x1", "日本", "a", "b", "c"] + [f"t{i}" for i in range(30)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randrange(10, 40))) for i in range(12)] + [(100, "Two words"), (101, "single"), (102, ""), (103, None), (104, "the the the the the the the the the the the the"), (3, "four words are here"), (105, "...")]
    docs = [(0, None), (1, ""), (2, "!!! -- \0"), (3, "two WORDS, single"), (3, "another text"), (3, "another text"), (4, "the " * 500), (5, "four words are"), (6, "Four-words:are here")]
    for i in range(40):
        parts = [text(rng.randrange(30))]
        for _ in range(rng.randrange(4)):
            own = words(rng.choice(items)[1])
            k = rng.randrange(len(own) + 1)
            parts += [" ".join(own[k : k + rng.randrange(4, 25)]).upper(), text(rng.randrange(5))]
        docs.append((10 + i, ", ".join(parts)))
    d = spark.createDataFrame([(i, t, "c", 1) for i, t in docs], "doc_id long, text string, n_hit string, item_id int")
    b = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, doc_id long")
    got = contamination(d, b).drop("item_ids")
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)
    assert contamination(d.limit(0), b).count() == 0
    assert {r.n_hit for r in contamination(d, b.limit(0)).collect()} == {0}
    unique = list({i: (i, t) for i, t in docs}.values())
    con = duckdb.connect()
    documents, benchmark = (con.from_arrow(spark.createDataFrame(x, s).toArrow()) for x, s in ((unique, "doc_id long, text string"), (items, "item_id long, text string")))
    documents.create_view("documents"), benchmark.create_view("benchmark")
    assert sorted(con.sql(ORACLE).fetchall(), key=str) == brute(unique, items)
