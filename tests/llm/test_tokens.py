import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from casemill.llm.bpe import Vocabulary, bpe_digests, bpe_round_trip, encode_texts
from casemill.llm.token_counts import token_counts

TEXTS = [None, "", "  a b  ", "a<|endoftext|>b <|startoftext|>", "ΑΣ Σ σΣ.", "İstanbul ǅ ½ Ⅷ x² \x1c\x1d a\x85b", "it's IT'S we'll 'sx'", "aaaaaaaaaaa aaaa", "日本語 😀😀 é é", "<|endoftext|", " \0 a\0b", "the the the the " * 4000, "x" * 20000, "same", "same"]
SCHEMA = "doc_id long, text string, n_tokens string, digest int"


def frame(spark, texts):
    return spark.createDataFrame([(i // 2, t, "clash", 1) for i, t in enumerate(texts)], SCHEMA)


def test_bpe_equals_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    expected, plain = [], []
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        expected.append((i // 2, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        plain.append((i // 2, ids, text))
    assert sorted(map(tuple, bpe_digests(frame(spark, TEXTS), path).collect())) == sorted(expected)
    assert sorted((r.doc_id, r.ids, r.decoded) for r in bpe_round_trip(frame(spark, TEXTS), path).collect()) == sorted(plain)
    assert bpe_digests(frame(spark, []), path).count() == 0


def same_as_library(texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    library, vocabulary = Tokenizer.from_file(path), Vocabulary(path)
    for at in range(0, len(texts), 50_000):
        part = texts[at : at + 50_000]
        flat, ends = encode_texts(vocabulary, pa.array(part, pa.string()))
        expected = library.encode_batch(part, add_special_tokens=False)
        different = [t for t, a, b, e in zip(part, ends, ends[1:], expected) if flat[a:b].tolist() != e.ids]
        assert not different, (len(different), different[:5])


@pytest.mark.parametrize("around", ["{}", "a{}b", "A{0} {0}B", ". {}.", "1{}2", "e{}\u0301", "\u0130{}\u03a3", "{0}{0}'s"])
def test_every_code_point(around):
    same_as_library([around.format(chr(c)) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x33480 or 0xE0000 <= c < 0xE0200 or c % 997 == 0)])


def test_random_unicode():
    rng = random.Random(9)
    sets = [range(0x20, 0x7F), range(0xA0, 0x300), range(0x300, 0x370), range(0x370, 0x600), range(0x1100, 0x1200), range(0x2000, 0x2200), range(0xA640, 0xA830), range(0x10D40, 0x10D90), range(0x16EA0, 0x16EC0), range(0x1F300, 0x1F650), [0x20, 0x0A, 0x3C, 0x7C, 0x3A3, 0x130, 0x1C, 0x85]]
    same_as_library(["".join(chr(rng.choice(rng.choice(sets))) for _ in range(rng.randrange(1, 40))) for _ in range(20_000)])


def test_counts_and_cache(spark, tmp_path):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    cache = str(tmp_path / "cache")
    for texts in (TEXTS[:5], TEXTS, TEXTS):
        got = sorted(map(tuple, token_counts(frame(spark, texts), path, cache).collect()))
        n = [len(library.encode(t or "")) for t in texts]
        assert got == sorted((i // 2, len((t or "").encode()), k, k > 4096) for i, (t, k) in enumerate(zip(texts, n)))
    assert spark.read.parquet(cache).count() == len({t or "" for t in TEXTS})
    assert token_counts(frame(spark, []), path, str(tmp_path / "none")).count() == 0
