"""Operator 5: toxicity by maximum-scoring segments of token log-odds.

A token's odds of standing in a toxic document are smoothed twice with Dirichlet priors: the base rate is the prior
of its first letters, and those are the prior of the word. Words and first letters are counted by document, each by
a 64-bit hash of its own, in tables that grow with the labelled vocabulary. A segment's score is the sum of its tokens' log-odds less a drift, so
neutral text scores below zero; one linear scan (Ruzzo and Tompa, with their back pointers) finds all maximal segments. Their significance
follows extreme-value statistics: lambda solves sum p exp(lambda s) = 1 over the tokens of clean documents, and a
document of n tokens expects n exp(-lambda S) segments of score S by chance, kept as a log. The logs of all significant
segments add up to one value, and a logistic curve, fitted on learnable rows that the counts did not use, turns it
into a score.

Cases: null and empty texts, and texts without letters, have no segment and the score of the value 0. Without a toxic
label to tune with every score is the smoothed base rate, (toxic + 0.5) / (labels + 1), so 0.5 without any label. A null
doc_id has no label, is not held out and is scored like any other row; repeated rows and tied doc_ids each give a
row. Extra columns are not read; labels of unknown documents are ignored, of several labels of one document the larger
counts. Very long texts are scanned whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm.common import pieces, staged, texts_of
from casemill.llm.labelled import crc_of_id, learnable, logistic

LETTERS = re.compile(r"[^\W\d_]+")
STEM = 4
#: A task adds up the counts of so many words before it passes them on.
HELD = 1_000_000
#: Lists that words of equal counts are cut into.
LISTS = 1024
PRIOR = 12.0
DRIFT = 0.7
#: A segment is significant if fewer than so many (a half) as good are expected by chance.
LOG_EXPECTED = float(np.log(0.5))
#: Bins of the calibration histogram for each unit of the value, up to a value that is as good as certain. Beyond it the
#: curve flattens, but it never stops rising: larger values come as near to SURE + MORE as they are large.
BINS, SURE, MORE = 4, 50.0, 0.25
#: Labelled documents that words are counted in: so many at most but for the spread of a hash, chosen by the hash of their id.
#: What reaches the driver and every task, the words' counts, is bounded by them.
FIT_DOCUMENTS = 100_000
CLASSES = 4  # of the learnable rows, one in so many fits the curve only


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words)).view(np.int64)


def stem_hashes(words: list[str]) -> np.ndarray:
    return word_hashes([w[:STEM] for w in words])


def summed(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order with the sums of their counts (n, 2)."""
    distinct, at = np.unique(hashes, return_inverse=True)
    return distinct, np.stack([np.bincount(at, counts[:, c], len(distinct)) for c in (0, 1)], 1).astype(np.int64)


class Counts:
    """Documents of class 0 and 1 by hash; zero for a hash that was not counted. Most words share their counts with many others."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        """hashes, counts (n, 2) of all words."""
        order = np.argsort(hashes)
        kinds, code = np.unique(counts[:, 0].astype(np.int64) << 32 | counts[:, 1], return_inverse=True)
        self.hashes, self.code = hashes[order], code[order].astype(np.uint16 if len(kinds) < 1 << 16 else np.uint32)
        self.kinds = np.stack([kinds >> 32, kinds & 0xFFFFFFFF], 1).astype(np.float32)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros((len(hashes), 2), np.float32)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where((self.hashes[at] == hashes)[:, None], self.kinds[self.code[at]], np.float32(0))


def coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Codes of all tokens of the texts, the n + 1 offsets of the texts, the distinct words."""
    words = [LETTERS.findall(t.lower()) for t in texts]
    offsets = np.r_[0, np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))]
    table = pa.array([w for own in words for w in own], pa.large_string()).dictionary_encode()
    return table.indices.to_numpy().astype(np.int64), offsets, table.dictionary.to_pylist()


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in time linear in the tokens.

    Every open segment points back to the last one before it with a smaller sum to its left, so the search for a
    partner never looks twice at a segment that it has passed.
    """
    at = np.flatnonzero(scores > 0)
    total = np.r_[0.0, np.cumsum(scores)]
    first: list[int] = []
    last: list[int] = []
    left: list[float] = []  # sum before the segment
    right: list[float] = []  # sum up to its end
    back: list[int] = []
    for start, low, high in zip(at.tolist(), total[at].tolist(), total[at + 1].tolist()):
        end, j = start + 1, len(first) - 1
        while True:
            while j >= 0 and left[j] >= low:
                j = back[j]
            if j < 0 or right[j] >= high:
                break
            start, low, after = first[j], left[j], back[j]
            for column in (first, last, left, right, back):
                del column[j:]
            j = after
        first.append(start), last.append(end), left.append(low), right.append(high), back.append(j)
    return [(a, b, y - x) for a, b, x, y in zip(first, last, left, right)]


class Model:
    """Token log-odds from the counts of words and first letters, and the decay of chance scores."""

    def __init__(self, words: Counts, stems: Counts, docs: np.ndarray):
        """words, stems: documents of class 0 and 1 with the word; docs: documents of each class."""
        self.rate = (docs[1] + 0.5) / (docs.sum() + 1.0)
        self.stems, self.words = stems, words
        base = np.log(self.rate / (1 - self.rate))
        kinds, times = words.kinds.astype(np.float64), np.bincount(words.code, minlength=len(words.kinds))  # words of equal counts score alike
        s = np.log((kinds[:, 1] + PRIOR * self.rate) / (kinds[:, 0] + PRIOR * (1 - self.rate))) - base - DRIFT
        p = kinds[:, 0] * times / max(1.0, (kinds[:, 0] * times).sum())
        low, high = 0.0, 20.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if (p * np.exp(np.minimum(mid * s, 50))).sum() < 1 else (low, mid)
        self.decay = max(low, 0.2)

    def scores(self, distinct: list[str]) -> np.ndarray:
        stem = self.stems.of(stem_hashes(distinct)).astype(np.float64)
        prior = PRIOR * ((stem[:, 1] + PRIOR * self.rate) / (stem.sum(1) + PRIOR)).astype(np.float32)
        seen = self.words.of(word_hashes(distinct))
        return np.log((seen[:, 1] + prior) / (seen[:, 0] + PRIOR - prior)) - np.log(self.rate / (1 - self.rate)) - DRIFT

    def significant(self, scores: np.ndarray) -> list[tuple[int, int, float, float]]:
        """(start, end, score, log of the expected number) of the segments that chance explains badly."""
        size = float(np.log(max(1, len(scores))))
        out = [(a, b, s, size - self.decay * s) for a, b, s in segments(scores)]
        return [x for x in out if x[3] < LOG_EXPECTED]


def count_tokens(docs: DataFrame, labels: DataFrame) -> Model:
    """The model from documents with a label y (a bounded number); counts by word and by first letters are all that reaches the driver."""

    def run(batches):
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
        docs_of = np.zeros((1, 2), np.int64)

        def table(kind, hashes, counts):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(hashes), kind, np.int32)), pa.array(hashes), pa.array(counts[:, 0]), pa.array(counts[:, 1])], ["kind", "word", "n0", "n1"])

        def added(kind):
            out = summed(*(np.concatenate(x) for x in zip(*held[kind])))
            held[kind] = []
            return out

        for batch in batches:
            for part in pieces(batch):
                codes, offsets, distinct = coded(texts_of(part))
                y = part.column(2).to_numpy()
                docs_of += np.bincount(y, minlength=2)
                if not distinct:
                    continue
                owner = np.repeat(np.arange(len(y)), np.diff(offsets))
                for kind, hashes in enumerate((word_hashes(distinct), stem_hashes(distinct))):
                    names, own = np.unique(hashes, return_inverse=True)
                    once = np.unique(owner << 32 | own[codes])
                    of, toxic = once & 0xFFFFFFFF, y[once >> 32]
                    held[kind].append((names, np.stack([np.bincount(of, toxic == c, len(names)) for c in (0, 1)], 1).astype(np.int64)))
                    if sum(len(x) for x, _ in held[kind]) > HELD:
                        total = added(kind)
                        if len(total[0]) > HELD // 2:
                            yield table(kind, *total)
                        else:
                            held[kind] = [total]
        for kind in (0, 1):
            if held[kind]:
                yield table(kind, *added(kind))
        yield table(2, np.zeros(1, np.int64), docs_of)

    rows = docs.select("doc_id", "text").join(labels, "doc_id").select("doc_id", "text", "y").mapInArrow(run, "kind int, word long, n0 long, n1 long")
    sums = rows.groupBy("kind", "word").agg(F.sum("n0").cast("int").alias("n0"), F.sum("n1").cast("int").alias("n1"))
    # words of equal counts go to the driver in lists, cut by their hash: little more than eight bytes a word
    lists = sums.groupBy("kind", "n0", "n1", F.pmod("word", F.lit(LISTS))).agg(F.collect_list("word").alias("words")).select("kind", "n0", "n1", "words").toArrow().combine_chunks()
    words = lists["words"].combine_chunks()
    sizes = words.value_lengths().to_numpy()
    word, kind = words.flatten().to_numpy(), np.repeat(lists["kind"].to_numpy(), sizes)
    counts = np.stack([np.repeat(lists[c].to_numpy(), sizes) for c in ("n0", "n1")], 1)
    return Model(*(Counts(word[kind == k], counts[kind == k]) for k in (0, 1)), counts[kind == 2].sum(0).astype(np.float64))


def toxic_segments(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, first, last (words), score, log_expected, passage of every significant segment."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = held.value
        for batch in batches:
            for part in pieces(batch):
                texts, rows = texts_of(part), []
                codes, offsets, distinct = coded(texts)
                scores = model.scores(distinct)
                for doc_id, text, a, b in zip(part.column(0).to_pylist(), texts, offsets, offsets[1:]):
                    found = model.significant(scores[codes[a:b]])
                    words = LETTERS.findall(text.lower()) if found else []
                    rows += [(doc_id, first, last - 1, float(score), expected, " ".join(words[first:last])) for first, last, score, expected in found]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string()))], ["doc_id", "first", "last", "score", "log_expected", "passage"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, first long, last long, score double, log_expected double, passage string")


def segment_values(docs: DataFrame, model: Model, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_segments, value: how unlikely the significant segments of a document are, as a sum of logs; carried string columns."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = held.value
        for batch in batches:
            for part in pieces(batch):
                codes, offsets, distinct = coded(texts_of(part))
                scores = model.scores(distinct).astype(np.float64)[codes] if distinct else np.zeros(0)
                found = [model.significant(scores[a:b]) for a, b in zip(offsets, offsets[1:])]
                values = [sum(LOG_EXPECTED - x[3] for x in own) for own in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(map(len, found)), pa.int64()), pa.array([float(v) for v in values], pa.float64()), *part.columns[2:]], ["doc_id", "n_segments", "value", *carried])

    return docs.select("doc_id", "text", *carried).mapInArrow(run, "doc_id long, n_segments long, value double" + "".join(f", {c} string" for c in carried))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, carried: tuple[str, ...] = (), fit_documents: int = FIT_DOCUMENTS) -> DataFrame:
    """doc_id, held_out, score, predicted, n_segments of every document, carried string columns.

    fit_documents bounds the labelled documents that words are counted in, and those that the curve is fitted on.
    """
    held_out = F.coalesce(crc_of_id() % 3 == 1, F.lit(False))
    fit, tune = crc_of_id() / 3 % CLASSES >= 1, crc_of_id() / 3 % CLASSES < 1
    model = count_tokens(docs, learnable(labels, "toxic", ~held_out & fit, fit_documents))
    values = staged(segment_values(docs, model, carried), "toxicity")
    value = F.col("value")
    bins = values.join(learnable(labels, "toxic", ~held_out & tune, fit_documents), "doc_id").groupBy(F.round(F.least(value, F.lit(SURE)) * BINS).alias("x")).agg(F.sum(1 - F.col("y")).alias("n0"), F.sum("y").alias("n1")).collect()
    if bins and sum(r["n1"] for r in bins):
        x, n0, n1 = (np.array([r[c] for r in bins], float) for c in ("x", "n0", "n1"))
        slope, cut = logistic(np.log1p(x / BINS), n0, n1)
    else:
        slope, cut = 0.0, float(np.log(max(model.rate, 1e-6) / (1 - model.rate)))
    rising = F.when(value <= SURE, value).otherwise(SURE + MORE * (1 - SURE / value))
    score = 1 / (1 + F.exp(-(F.log1p(rising) * slope + cut)))
    return values.select("doc_id", held_out.alias("held_out"), score.alias("score"), (score >= threshold).cast("int").alias("predicted"), "n_segments", *carried)
