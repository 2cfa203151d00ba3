"""Operator 11: phrase collocations by counting quotient filters.

1. Tasks cut texts into words, some megabytes of one language at a time (a chunk): its distinct words with their
   counts, and its words as places in that list, 0 between pieces. Chunks are a table.
2. Words with the least count of a candidate or more get dense ids, by a join on (lang, word) in which a chunk
   has one row for a word, however often it stands there. No phrase with a rarer word can be a candidate.
3. Each chunk's 2- and 3-word sequences of ids fill a counting quotient filter; its segments (by the top bits of the permuted
   keys) are shuffled, and the filters of one segment are merged in key order. Keys are kept whole, so counts are exact.
4. Frequent phrases get their parts' counts, score and place by DataFrame joins and windows.

Cases: a null lang is `und`, together with a lang of that name; a null or empty text has no words. Texts of any
length are read in slices cut between pieces. Repeated rows count each. Languages without candidates give no rows, as does an empty
table. Ties in score and count go by the phrase's bytes. Other columns and null doc_ids are not read. Counts up to
9,999,999,999,999,999 keep the arithmetic exact (decimals of 38 digits).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casemill.llm.common import staged
from casemill.llm.quotient_filter import Grams, loaded, segments

#: Bytes of text of a chunk, and entries of one segment before the filters are merged, both about.
CHUNK = 8_000_000
SEGMENT = 4_000_000

#: What a byte is: 0 part of a word, 1 white space, 2 end of a piece. Fixed values of the contract.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def words_of(raw: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of UTF-8 bytes (A-Z lower-cased), and for each the number of its piece. A few bytes of memory for each byte of text."""
    kind = KIND[raw]
    inside = kind == 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    starts = np.flatnonzero(begins).astype(np.int32)
    pieces = np.searchsorted(np.flatnonzero(kind == 2).astype(np.int32), starts).astype(np.int32)
    data = LOWER[raw[inside]]
    # a word's place in the data: its place in the text less the bytes between words before it
    offsets = np.empty(len(starts) + 1, np.int32)
    offsets[:-1] = starts - np.searchsorted(np.flatnonzero(~inside).astype(np.int32), starts)
    offsets[-1] = len(data)
    return pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]), pieces


def encoded(raw: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, their counts, and the text as places in them from 1 on, with 0 between pieces."""
    words, piece = words_of(np.frombuffer(raw, np.uint8))
    coded = words.dictionary_encode()
    places = coded.indices.to_numpy().astype(np.int32) + 1
    stream = np.insert(places, np.flatnonzero(piece[1:] != piece[:-1]) + 1, 0)
    return coded.dictionary, np.bincount(places, minlength=len(coded.dictionary) + 1)[1:], stream


def slices(raw: bytes, size: int):
    """A text in parts of about `size` bytes, cut behind the end of a piece."""
    at = 0
    while len(raw) - at > size:
        ends = np.frombuffer(raw, np.uint8, offset=at + size)
        found = next((k + int(hit[0]) for k in range(0, len(ends), size) if len(hit := np.flatnonzero(KIND[ends[k : k + size]] == 2))), None)
        if found is None:
            break
        yield raw[at : at + size + found + 1]
        at += size + found + 1
    yield raw[at:]


def chunks(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """chunk, lang, n, words, counts, stream: see encoded()."""

    def run(batches):
        place, serial = TaskContext.get().partitionId(), 0
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def flush(lang):
            nonlocal serial
            raw = b"\n".join(held.pop(lang))
            del sizes[lang]
            words, counts, stream = encoded(raw)
            serial += 1
            row = [[(place << 33) + serial], [lang], [int(counts.sum())], [words], [counts], [stream.tobytes()]]
            types = [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types)], ["chunk", "lang", "n", "words", "counts", "stream"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if not text:
                    continue
                for part in slices(text.encode(), size):
                    held.setdefault(lang, []).append(part)
                    sizes[lang] = sizes.get(lang, 0) + len(part)
                    if sizes[lang] >= size:
                        yield flush(lang)
                if len(sizes) > 1 and sum(sizes.values()) >= 2 * size:
                    yield flush(max(sizes, key=sizes.get))
        for lang in sorted(held):
            yield flush(lang)

    schema = "chunk long, lang string, n long, words array<string>, counts array<long>, stream binary"
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(run, schema)


def vocabulary(parts: DataFrame, least: int) -> tuple[DataFrame, int]:
    """(lang, word, f, id) of the words with f >= least, ids dense from 1 on, and their number."""
    pairs = parts.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x"))
    counts = pairs.groupBy("lang", F.col("x.words").alias("word")).agg(F.sum("x.counts").alias("f")).where(F.col("f") >= least)
    words = staged(counts.withColumn("place", F.monotonically_increasing_id()), "words")
    part = F.shiftright("place", 33)
    sizes = sorted((r.part, r.n) for r in words.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # one row for each partition
    starts, total = {}, 0
    for k, n in sizes:
        starts[k], total = total, total + n
    first = words.sparkSession.createDataFrame([(k, v) for k, v in starts.items()], "part long, start long")
    named = words.withColumn("part", part.cast("long")).join(F.broadcast(first), "part")
    return named.select("lang", "word", "f", (F.col("start") + F.col("place") % (1 << 33) + 1).alias("id")), total


def frequent_phrases(parts: DataFrame, words: DataFrame, n_words: int, least: int, bits: int | None = None, segment: int = SEGMENT) -> DataFrame:
    """(first, second, third, a): word-id sequences of 2 (third 0) and 3 words that occur `least` times or more."""
    occurrences = parts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    grams = Grams(bits or max(1, n_words.bit_length()))
    segment_bits = min(grams.half, max(4, (2 * occurrences // segment).bit_length()))

    def fill(key, named: pa.Table, stream: pa.Table) -> pa.Table:
        # named: the ids of one chunk's frequent words; stream: its one row
        rows: list[tuple[int, bytes]] = []
        if stream.num_rows and named.num_rows:
            raw = stream.column("stream")[0].as_buffer()
            places = np.frombuffer(raw, np.int32)
            ids = np.zeros(int(places.max()) + 1, np.int64)
            ids[named.column("place").to_numpy() + 1] = named.column("id").to_numpy()
            x = ids[places]
            two = np.flatnonzero((x[:-1] > 0) & (x[1:] > 0))
            three = two[:-1][(np.diff(two) == 1)]
            ends = np.r_[np.zeros(len(two), np.int64), x[three + 2]]
            at = np.r_[two, three]
            rows = segments(grams, segment_bits, *grams.counted(*grams.pack(x[at], x[at + 1], ends)))
        return pa.table({"segment": pa.array([s for s, _ in rows], pa.int64()), "filter": pa.array([b for _, b in rows], pa.binary())})

    def merge(batches):
        segment, held, waiting = None, [], 0

        def joined():
            return grams.counted(*(np.concatenate(x) for x in zip(*held)))

        def result():
            high, low, counts = joined()
            often = counts >= least
            columns = [*grams.unpack(high[often], low[often]), counts[often]]
            return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["first", "second", "third", "a"])

        for batch in batches:
            for s, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if s != segment:
                    if held:
                        yield result()
                    segment, held, waiting = s, [], 0
                keys = loaded(grams, segment_bits, s, blob.as_py())
                held.append(keys)
                waiting += len(keys[0])
                if waiting > max(1_000_000, len(held[0][0])):
                    held, waiting = [joined()], 0
        if held:
            yield result()

    places = parts.select("chunk", "lang", F.posexplode("words").alias("place", "word"))
    named = places.join(words, ["lang", "word"]).select("chunk", "place", "id")
    streams = parts.select(F.col("chunk").alias("of"), "stream")
    filters = named.groupBy("chunk").cogroup(streams.groupBy("of")).applyInArrow(fill, "segment long, filter binary")
    return filters.repartition("segment").sortWithinPartitions("segment").mapInArrow(merge, "first long, second long, third long, a long")


def _score(a, left, right):
    exact = [c.cast("decimal(16,0)") for c in (a, left, right)]
    return F.call_function("div", exact[0] * exact[0] * F.lit(1_000_000).cast("decimal(7,0)"), exact[1] * exact[2])


def collocations(docs: DataFrame, least: int = 10, inside: int = 50, top: int = 2000, chunk: int = CHUNK, bits: int | None = None, segment: int = SEGMENT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 or 3 words.

    least: a candidate's least count; inside: a candidate goes if a longer one that holds it has that percentage of its count.
    """
    parts = staged(chunks(docs, chunk), "chunks")
    named, n_words = vocabulary(parts, least)
    words = staged(named, "vocabulary")
    phrases = staged(frequent_phrases(parts, words, n_words, least, bits, segment), "phrases")
    totals = parts.groupBy("lang").agg(F.sum("n").alias("n"))
    two = phrases.where("third = 0").select("first", "second", "a")
    three = phrases.where("third > 0")

    def word(name, end):
        return words.select(F.col("id").alias(name), F.col("word").alias(f"word_{end}"), F.col("f").alias(f"f_{end}"), *(["lang"] if end == 1 else []))

    longer = three.select(F.explode(F.array(F.struct("first", "second", "a"), F.struct(F.col("second").alias("first"), F.col("third").alias("second"), "a"))).alias("x"))
    longer = longer.groupBy("x.first", "x.second").agg(F.max("x.a").alias("longest"))
    pairs = two.join(longer, ["first", "second"], "left").where(F.col("longest").isNull() | (F.col("longest") * 100 < F.col("a") * inside))
    pairs = pairs.join(word("first", 1), "first").join(word("second", 2), "second")
    pairs = pairs.select("lang", F.concat_ws(" ", "word_1", "word_2").alias("phrase"), "a", F.col("f_1").alias("l"), F.col("f_2").alias("r"))
    triples = three.join(two.select("first", "second", F.col("a").alias("front")), ["first", "second"])
    triples = triples.join(two.select(F.col("first").alias("second"), F.col("second").alias("third"), F.col("a").alias("back")), ["second", "third"])
    triples = triples.join(word("first", 1), "first").join(word("second", 2), "second").join(word("third", 3), "third")
    triples = triples.withColumns({"cut_1": _score(F.col("a"), F.col("f_1"), F.col("back")), "cut_2": _score(F.col("a"), F.col("front"), F.col("f_3"))})
    early = F.col("cut_1") <= F.col("cut_2")
    triples = triples.select("lang", F.concat_ws(" ", "word_1", "word_2", "word_3").alias("phrase"), "a", F.when(early, F.col("f_1")).otherwise(F.col("front")).alias("l"), F.when(early, F.col("back")).otherwise(F.col("f_3")).alias("r"))
    scored = pairs.unionByName(triples).withColumn("score", _score(F.col("a"), F.col("l"), F.col("r")))
    # a language's best are among the best of each of its 64 shares, so no task sorts a whole language
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    shares = scored.withColumn("share", F.pmod(F.hash("phrase"), F.lit(64)))
    shares = shares.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    ranked = shares.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: DuckDB SQL of the query.
ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), listed AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM listed, (VALUES (1), (2), (3)) AS sizes(k) WHERE len(w) >= k)
), f AS (
  SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL
), n AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), candidates AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10
), cuts AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.w, x.cut, array_to_string(c.w[1:x.cut], ' ') AS front, array_to_string(c.w[x.cut + 1:], ' ') AS back
  FROM candidates c JOIN (VALUES (1), (2)) AS x(cut) ON x.cut < c.k
), scored AS (
  SELECT c.lang, c.k, c.phrase, c.a, l.f AS l, r.f AS r, c.cut, ((1000000::HUGEINT * c.a * c.a) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.front JOIN f r ON r.lang = c.lang AND r.phrase = c.back
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), covered AS (
  SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a AS longer FROM candidates WHERE k = 3
), longest AS (
  SELECT lang, phrase, max(longer) AS longer FROM covered GROUP BY ALL
), kept AS (
  SELECT b.* FROM best b LEFT JOIN longest x ON x.lang = b.lang AND x.phrase = b.phrase WHERE x.longer IS NULL OR 100 * x.longer < 50 * b.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, n.n, r.score FROM ranked r JOIN n ON n.lang = r.lang WHERE r.rank <= 2000
"""
