"""Operator 8: document fingerprints by SimHash with weighted terms, and search within a Hamming radius.

Terms are words and pairs of neighbouring words of the lower-cased text; a term seen c times weighs 1 + ln c and
votes with its 128 hash bits, +weight or -weight each. The likeness of two fingerprints is the cosine that their
differing bits stand for, max(0, cos(pi * bits / 128)). near_search() finds all fingerprints within a radius r of given
ones by permuted block tables; the query counts them for every row whose doc_id is divisible by 20, against all rows.

Cases: null and empty texts have the zero fingerprint, like one another (1) and unlike texts (0). Null doc_ids come
after all others. Ties in doc_id are put in order by text. Repeated rows each give a row. One row is its own next.
Extra columns are not read. Empty tables give no rows. Texts are taken whole.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm.common import cut_points, looked_up, ordered_key, pieces, range_number, staged, texts_of, word_slices

BITS = 128
#: Longer texts (code points) are read in slices.
LONG = 1 << 20
#: Bytes of text in a range, which is what one task sorts and fingerprints.
RANGE_BYTES = 64_000_000
#: A block value that more fingerprints share is cut again.
GROUP = 1000


def fingerprint(text: str) -> np.ndarray:
    """The fingerprint as 16 bytes; all zero without a word."""
    if len(text) > LONG:
        return _long_fingerprint(text)
    words = text.encode().lower().split()
    if not words:
        return np.zeros(BITS // 8, np.uint8)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    terms = Counter(words)
    terms.update([joined[a:b] for a, b in zip(starts, ends[1:].tolist())])
    return _elected([(_digests(terms), np.fromiter(terms.values(), np.int64, len(terms)))])


def _digests(terms) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, terms)), np.uint8).reshape(-1, BITS // 8)


def _elected(groups) -> np.ndarray:
    """The bits with over half of the weight, from groups of distinct terms (digests, counts)."""
    votes, total = np.zeros(BITS, np.float64), 0.0
    for digests, counts in groups:
        weight = 1 + np.log(counts.astype(np.float32))
        total += weight.sum(dtype=np.float64)
        for k in range(0, len(counts), 8192):
            votes += weight[k : k + 8192] @ np.unpackbits(digests[k : k + 8192], axis=1).astype(np.float32)
    return np.packbits(votes * 2 > total)


def _long_fingerprint(text: str) -> np.ndarray:
    """The same for a very long text: 16 bytes a term are held, in groups by first bits, and counted group by group."""
    held: list[list[np.ndarray]] = [[] for _ in range(64)]
    before: list[bytes] = []
    for words in word_slices(text):
        if not words:
            continue
        own = before + words
        digests = _digests(words + [a + b" " + b for a, b in zip(own, own[1:])])
        group = digests[:, 0] >> 2
        order = np.argsort(group, kind="stable")
        for k, part in enumerate(np.split(digests[order], np.searchsorted(group[order], np.arange(1, 64)))):
            held[k].append(part)
        before = words[-1:]

    def groups():
        for k, parts in enumerate(held):
            if parts:
                values = np.concatenate(parts).view(">u8")
                held[k] = []
                values = values[np.lexsort((values[:, 1], values[:, 0]))]
                starts = np.flatnonzero(np.r_[True, (values[1:] != values[:-1]).any(axis=1)])[: len(values)]
                yield np.ascontiguousarray(values[starts]).view(np.uint8).reshape(-1, BITS // 8), np.diff(np.r_[starts, len(values)])

    return _elected(groups())


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not a.any() or not b.any():
        return float(not a.any() and not b.any())
    return max(0.0, float(np.cos(np.pi * int(np.bitwise_count(a ^ b).sum()) / BITS)))


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """doc_id, fp: the fingerprint of every document as 32 hex digits."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([fingerprint(t).tobytes().hex() for t in texts_of(part)], pa.string())], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp string")


def _tables(rows: DataFrame, radius: int, digits: int) -> tuple[DataFrame, int]:
    """Each row (key, fp, rest) once for each of radius + 1 blocks of rest, that block moved to its key; digits left at least."""
    cuts = [round(k * digits / (radius + 1)) for k in range(radius + 2)]
    blocks = F.array(*[F.struct(F.concat("key", F.lit(f"/{k}:"), F.substring("rest", a + 1, b - a)).alias("key"), F.concat(F.substring("rest", 1, a), F.substring("rest", b + 1, digits)).alias("rest")) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))])
    width = max(b - a for a, b in zip(cuts, cuts[1:]))
    cut = rows.select("fp", F.explode(blocks).alias("x")).select("fp", "x.key", F.substring("x.rest", 1, digits - width).alias("rest"))
    return cut, digits - width


def near_search(queries: DataFrame, fps: DataFrame, radius: int = 3, group: int = GROUP) -> DataFrame:
    """(a, b, bits): fingerprints a of queries and others b of fps (columns fp, 32 hex digits) that differ in at most `radius` bits.

    Permuted block tables: of radius + 1 blocks one at least is equal, so each table has its block in front and is joined on
    it. A block value that more than `group` fingerprints share is cut again by the same rule, twice at most.
    """
    half = lambda c, k: F.conv(F.substring(c, k, 8), 16, 10).cast("long")
    bits = sum((F.bit_count(half("a", k).bitwiseXOR(half("b", k))) for k in range(1, BITS // 4, 8)), F.lit(0))
    start = lambda df: df.select("fp").distinct().select("fp", F.lit("").alias("key"), F.col("fp").alias("rest"))
    asked, known, digits, found = start(queries), start(fps), BITS // 4, None
    for last in (False, False, True):
        (asked, _), (known, digits) = _tables(asked, radius, digits), _tables(known, radius, digits)
        hot = None
        if not last:
            large = staged(known.groupBy("key").count().where(F.col("count") > group).select("key"), "large-blocks")
            if not large.isEmpty():
                hot = [staged(x.join(large, "key", "left_semi"), "hot-blocks") for x in (asked, known)]
                asked, known = asked.join(large, "key", "left_anti"), known.join(large, "key", "left_anti")
        pairs = asked.select("key", F.col("fp").alias("a")).join(known.select("key", F.col("fp").alias("b")), "key").where("a <> b").select("a", "b", bits.alias("bits")).where(F.col("bits") <= radius)
        found = pairs if found is None else found.union(pairs)
        if hot is None:
            break
        asked, known = hot
    return found.distinct()


def near_pairs(fps: DataFrame, radius: int = 7, group: int = GROUP) -> DataFrame:
    """(a, b, bits), a < b: pairs of distinct values of column fp within the radius. Copies share one fingerprint."""
    return near_search(fps, fps, radius, group).where("a < b")


def with_near_counts(rows: DataFrame, radius: int = 3, every: int = 20) -> DataFrame:
    """rows (a table with doc_id, fingerprint) with n_near: for doc_ids divisible by `every`, the other rows within the radius."""
    asked = F.coalesce(F.col("doc_id") % every == 0, F.lit(False))
    held = staged(rows.groupBy(F.col("fingerprint").alias("fp")).agg(F.count("*").alias("n")), "distinct-fingerprints")
    queries = staged(rows.where(asked).select(F.col("fingerprint").alias("fp")).distinct(), "queries")
    others = near_search(queries, held, radius).join(held.withColumnRenamed("fp", "b"), "b").groupBy(F.col("a").alias("fp")).agg(F.sum("n").alias("others"))
    near = queries.join(held, "fp").join(others, "fp", "left").select(F.col("fp").alias("fingerprint"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).cast("long").alias("n_near"))
    told = looked_up(rows.where(asked), staged(near, "near-counts"), "fingerprint").unionByName(rows.where(~asked).withColumn("n_near", F.lit(None).cast("long")))
    return told.select(*rows.columns, "n_near")


def with_next(docs: DataFrame, tasks: int | None = None) -> tuple[DataFrame, int]:
    """doc_id, text, part, halo, and the number of parts: rows in ranges of descending doc_id, null last, each followed by the next.

    Ranges hold about RANGE_BYTES of text; rows that tie are ordered by text and may take several ranges. What a range
    needs from the one after it is a copy (halo) of that one's first text; the last range gets the first text of all.
    """
    text = F.coalesce("text", F.lit(""))
    key = F.concat(ordered_key("doc_id", descending=True), F.hex(F.substring(text, 1, 16)))
    cuts = cut_points(docs.select(key.alias("key"), F.octet_length(text).cast("long").alias("bytes")), RANGE_BYTES, tasks)
    placed = docs.select("doc_id", text.alias("text"), range_number(key, cuts).alias("part"), key.alias("key"))
    firsts = placed.where(F.col("key") == F.get(F.split(F.lit(",".join(cuts)), ","), F.col("part"))).groupBy("part").agg(F.min("text").alias("text"))
    n = max(1, len(cuts))
    halos = firsts.select(F.lit(None).cast("long").alias("doc_id"), "text", F.pmod(F.col("part") - 1, F.lit(n)).alias("part"), F.lit(True).alias("halo"))
    return placed.select("doc_id", "text", "part", F.lit(False).alias("halo")).union(halos), n


def edited_fingerprints(docs: DataFrame, tasks: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edit: the second half replaced by the start of the next document."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    placed, parts = with_next(docs, tasks)

    def run(batches):
        names = [x.split()[0] for x in schema.split(", ")]
        held = None

        def row(doc_id, text, fp, after, after_fp):
            k = len(text) // 2
            edited = text[: len(text) - k] + after[:k]
            other = fingerprint(edited)
            return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), fp.tobytes().hex(), other.tobytes().hex(), likeness(fp, other), likeness(fp, after_fp)

        for batch in batches:
            for part in pieces(batch):
                rows = []
                for doc_id, text, where, halo in zip(part.column(0).to_pylist(), texts_of(part), part.column(2).to_pylist(), part.column(3).to_pylist()):
                    if held and held[0] != where:
                        held = None
                    if halo and not held:
                        continue
                    fp = fingerprint(text)
                    if held:
                        rows.append(row(*held[1:], text, fp))
                    held = None if halo else (where, doc_id, text, fp)
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)

    laid = placed.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "halo", F.col("doc_id").desc_nulls_last(), "text")
    return laid.mapInArrow(run, schema)
