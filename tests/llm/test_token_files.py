import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from casemill.llm import token_files
from casemill.llm.token_files import Coder, pack, read_token_files, scaled, unpack, write_token_files


def test_coder_round_trip():
    rng = np.random.default_rng(1)
    ids = [rng.geometric(0.02, n).astype(np.uint32) for n in (1, 5, 127, 128, 129, 70_000, 33_000)]
    counts = np.bincount(np.concatenate(ids))
    frequencies = scaled(counts)
    assert frequencies.sum() == 1 << token_files.SCALE and ((frequencies > 0) == (counts > 0)).all()
    coder = Coder(frequencies)
    blocks = [([1, None], ids[:2]), ([2], ids[2:3]), ([3, 4, 5, 6], ids[3:])]
    payloads = pack(blocks, coder)
    for (doc_ids, docs), got in zip(blocks, unpack(payloads, coder)):
        assert [g[0] for g in got] == doc_ids and all((a == b[1]).all() for a, b in zip(docs, got))
    entropy = -(counts[counts > 0] * np.log2(counts[counts > 0] / counts.sum())).sum() / 8
    assert sum(map(len, payloads)) < 1.15 * entropy + 1200 * 9
    broken = bytearray(payloads[2])
    broken[-20_000] ^= 1
    with pytest.raises(ValueError):
        unpack([bytes(broken)], coder)
    assert (scaled(np.array([5, 0, 10**12, 1])) > 0).tolist() == [True, False, True, True]


@pytest.mark.parametrize("parts", [1, 5])
def test_files(spark, tmp_path, parts, monkeypatch):
    rng = random.Random(parts)
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = [None, "", "<|endoftext|>", "x " * 90_000] + [" ".join(rng.choice(["one", "Two", "thrée", "4!"]) for _ in range(rng.randrange(50))) for _ in range(80)]
    rows = [(i * 7 % 61, t, "c") for i, t in enumerate(texts)] + [(None, "no id", "c"), (3, "same", "c"), (3, "same", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string")
    write_token_files(docs, str(tmp_path / "files"), path, 2, parts)
    coded = [(d, library.encode(t or "", add_special_tokens=False).ids + [2]) for d, t, _ in rows]
    coded.sort(key=lambda r: (r[0] is not None, r[0] or 0, np.array(r[1], "<u2").tobytes()))
    expected, at = [], 0
    for d, ids in coded:
        expected.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    assert sorted(map(tuple, read_token_files(spark, str(tmp_path / "files")).collect()), key=lambda r: r[1]) == expected
    write_token_files(docs.limit(0), str(tmp_path / "none"), path, 2, parts)
    assert read_token_files(spark, str(tmp_path / "none")).count() == 0
