"""Operator 10: byte-pair encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array. Each round finds every word's lowest-rank pair, by binary
search over sorted pair keys, and merges all its occurrences in that word; words without a known pair leave.
Text is prepared as the vocabulary file says: NFC, white space to one space, lower case, then words by
pattern; the two special strings are cut out first and keep their ids, as the library does by default. Letters, numbers,
lower case and composition follow the library's own Unicode version: runs with a code point outside the STABLE ones,
on which all versions agree, are normalised and cut into words by the library, each distinct run once.

Cases: null and empty texts have no tokens (digests of the empty string). A very long text is one row of a
piece of its own; a very long word takes more rounds over its own symbols only. Repeated rows and tied
doc_ids each give their own result row. Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from casemill.llm.common import flat_bytes, pieces

# The word pattern of the vocabulary file, with its white space spelt out.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+")
WORDS_AND_ENDS = regex.compile(rf"{WORDS.pattern}|\n")
RUNS = regex.compile(rf"[^{SPACE}]+")
#: White space to str.split(), but not to the pattern.
SEPARATORS = regex.compile(r"[\x1c-\x1f]")

#: Code points that no Unicode version composes, classes or lower-cases otherwise: Latin, punctuation and the euro sign.
STABLE = r"\x{00}-\x{2ff}\x{2010}-\x{2027}\x{2030}-\x{205e}\x{20ac}"

NO_PAIR = np.int32(2**31 - 1)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where visible, else the next from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


class Vocabulary:
    """Vocabulary, merges and special strings of a tokenizer file, as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids = model["vocab"]
        self.end = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*ids.values(), *self.special.values()]) + 1)
        for token, i in [*ids.items(), *self.special.items()]:
            self.tokens[i] = token
        symbols = byte_symbols()
        self.inner = np.array([ids[s] for s in symbols], np.int64)
        self.last = np.array([ids[s + self.end] for s in symbols], np.int64)
        self.size = len(self.tokens)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([ids[a] * self.size + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        self.byte_of = {ord(c): b for b, c in enumerate(symbols)}

    def library_words(self, run: str) -> list[bytes]:
        """The words of a run as the library normalises and cuts it."""
        return [word.translate(self.byte_of).encode("latin-1") for word, _ in self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(run))]

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair; NO_PAIR where the file has none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_PAIR)

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and the n + 1 offsets of the words in it."""
        data, offsets = flat_bytes(words)
        sizes = np.diff(offsets)
        ends = np.cumsum(sizes)
        symbols = self.inner[data]
        symbols[ends[sizes > 0] - 1] = self.last[data[ends[sizes > 0] - 1]]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        same = owner[1:] == owner[:-1]
        rank = np.full(len(symbols), NO_PAIR, np.int32)
        at = np.flatnonzero(same)
        rank[at] = self.rank_of(symbols[at], symbols[at + 1])
        done_ids, done_owner = [], []
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            least = np.minimum.reduceat(rank, starts)
            length = np.diff(np.r_[starts, len(symbols)])
            live = np.repeat(least != NO_PAIR, length)
            if not live.all():
                done_ids.append(symbols[~live])
                done_owner.append(owner[~live])
                if not live.any():
                    break
                least = np.repeat(least, length)[live]
                symbols, owner, rank = symbols[live], owner[live], rank[live]
            else:
                least = np.repeat(least, length)
            hit = np.flatnonzero(rank == least)
            # in a chain of overlapping equal pairs every other one merges, from the left
            first = np.r_[True, np.diff(hit) != 1]
            place = np.arange(len(hit)) - np.maximum.accumulate(np.where(first, np.arange(len(hit)), 0))
            hit = hit[place % 2 == 0]
            symbols[hit] = self.merged[rank[hit]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            rank[hit] = rank[hit + 1]  # NO_PAIR where the word ends; else ranked anew below
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            hit = hit - np.arange(len(hit))
            beside = np.zeros(len(symbols), bool)
            beside[hit] = True
            beside[hit[hit > 0] - 1] = True
            beside[:-1] &= owner[1:] == owner[:-1]
            beside[-1] = False
            inside = np.flatnonzero(beside)
            rank[inside] = self.rank_of(symbols[inside], symbols[inside + 1])
        ids = np.concatenate(done_ids) if done_ids else np.zeros(0, np.int64)
        owner = np.concatenate(done_owner) if done_owner else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        return ids[order], np.r_[0, np.cumsum(np.bincount(owner, minlength=len(sizes)))]

    def runs_of(self, text: str) -> list[str]:
        """The runs of a text between white space, in order; special strings are runs of their own behind a space."""
        if self.cut is None or "<|" not in text:
            return text.split() if not SEPARATORS.search(text) else RUNS.findall(text)
        runs, end = [], 0
        for m in self.cut.finditer(text):
            runs += RUNS.findall(text[end : m.start()])
            runs.append(" " + m.group())
            end = m.end()
        return runs + RUNS.findall(text[end:])


def prepared(text: str) -> str:
    """NFC and lower case, character by character (so no form of sigma that depends on its neighbours)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:
            text = text.replace("Σ", "σ")
    return text.lower()


def ragged_take(flat: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The given rows of a ragged array (flat values, n + 1 offsets), again as flat values and offsets."""
    sizes = np.diff(offsets)[rows]
    ends = np.cumsum(sizes)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets[rows] - (ends - sizes), sizes)
    return flat[at], np.r_[0, ends]


def encode_texts(v: Vocabulary, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one array, and the offsets of the texts in it. Each distinct word is encoded once."""
    texts = texts.fill_null("") if texts.null_count else texts
    if pc.any(pc.match_substring_regex(texts, r"[\x1c-\x1f]|<\|")).as_py():
        runs = pa.array([v.runs_of(t) for t in texts.to_pylist()], pa.list_(pa.string()))
    else:
        runs = pc.utf8_split_whitespace(texts)
    coded = runs.flatten().dictionary_encode()
    ids, offsets = encode_runs(v, coded.dictionary)
    flat, ends = ragged_take(ids, offsets, coded.indices.to_numpy().astype(np.int64))
    return flat, ends[runs.offsets.to_numpy()]


def encode_runs(v: Vocabulary, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of runs without white space, with the n + 1 offsets of the runs; a special string is marked by a space before it."""
    if not len(runs):
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    marked = np.flatnonzero(pc.starts_with(runs, " ").to_numpy(zero_copy_only=False))
    special = [v.special[runs[int(k)].as_py()[1:]] for k in marked]
    plain = pc.if_else(pc.starts_with(runs, " "), "", runs) if special else runs
    odd = np.flatnonzero(pc.match_substring_regex(plain, f"[^{STABLE}]").to_numpy(zero_copy_only=False))
    if len(odd):
        own = [v.library_words(plain[int(k)].as_py()) for k in odd]
        mask = np.zeros(len(plain), bool)
        mask[odd] = True
        plain = pc.if_else(pa.array(mask), "", plain)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(plain)], pa.int32()), plain.cast(pa.string())), "\n")[0].as_py()
    words = pa.array(WORDS_AND_ENDS.findall(prepared(joined) + "\n"), pa.string()).dictionary_encode()
    codes = words.indices.to_numpy().astype(np.int64)
    stops = np.flatnonzero(codes == pc.index(words.dictionary, "\n").as_py())
    ids, offsets = v.encode_words(words.dictionary)
    flat, ends = ragged_take(ids, offsets, np.delete(codes, stops))
    ends = np.r_[0, ends[stops - np.arange(len(stops))]]
    if len(odd):
        theirs, places = v.encode_words(pa.array([w for words in own for w in words], pa.binary()))
        sizes = np.zeros(len(plain), np.int64)
        sizes[odd] = np.diff(places[np.r_[0, np.cumsum([len(words) for words in own])]])
        flat = np.insert(flat, np.repeat(ends[:-1], sizes), theirs)
        ends = ends + np.r_[0, np.cumsum(sizes)]
    if special:
        flat = np.insert(flat, ends[marked], special)
        ends = ends + np.searchsorted(marked, np.arange(len(ends)), side="left")
    return flat, ends


def decode(ids: list[int], v: Vocabulary) -> str:
    """The token strings joined by one space: what the library gives for a file without a decoder."""
    return " ".join([v.tokens[i] for i in ids])


def bpe_round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, token ids and decoded text of every document."""

    def run(batches):
        v = Vocabulary(path)
        for batch in batches:
            for part in pieces(batch):
                flat, offsets = encode_texts(v, part.column(1))
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array([decode(x, v) for x in ids.to_pylist()], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document, without keeping ids as rows."""

    def run(batches):
        v = Vocabulary(path)
        names, tokens = (pa.array(x, pa.string()) for x in (map(str, range(v.size)), v.tokens))
        for batch in batches:
            for part in pieces(batch):
                flat, offsets = encode_texts(v, part.column(1))
                columns = [part.column(0), pa.array(np.diff(offsets), pa.int64())]
                for strings in (names, tokens):
                    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), strings.take(pa.array(flat)))
                    columns.append(pa.array([hashlib.sha256(x).hexdigest() for x in pc.binary_join(lists, " ").cast(pa.binary()).to_pylist()], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
