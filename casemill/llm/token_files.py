"""Operator 7: token ids in binary files, coded by a static range asymmetric numeral system.

One frequency table, counted over all ids of all documents, is shared by all blocks. Documents are dealt by ranges of
doc_id, of RANGE_BYTES each however many there are, one range a task, and laid out in ascending order; a block holds
whole documents (about BLOCK ids) and is coded on its own.
Inside a block, segments of up to SEGMENT ids have a checkpoint each (the states of their interleaved lanes and the
place of their words), so that all segments are decoded side by side. A block carries the crc32 of its ids and is
checked when read. Files are Parquet tables of blocks, so Spark's commit protocol covers lost executors:

    path/blocks       part, block, first (ids of the part before it), n_ids, payload
    path/frequencies  id, frequency (they add up to 2**SCALE)

Payload, little-endian: magic "RANS", u32 documents, u32 segments, u32 crc32 of the ids; for every document i64 doc_id
(and u32: 1 if there is one), u32 ids; for every segment u32 ids, u32 words, LANES u64 states; then the u32 words.

Ids are those of the tokenizers library for the file; bpe.encode_texts gives the same ones (tested) several times faster.

Cases: null and empty texts are the end id alone. Null doc_ids come first. Tied doc_ids, null ones too, follow one another
in the order of their ids, and may take several ranges; repeated rows are kept. Extra columns are not read. An empty table gives no files' rows and no result rows. A very long
text makes one long block.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.llm.bpe import Vocabulary, encode_texts
from casemill.llm.common import cut_points, ordered_key, pieces, range_number, staged

BLOCK, SEGMENT, LANES, SCALE = 1 << 17, 1 << 15, 128, 20
#: Bytes of ids (two or four each) in a range, which is what one task sorts and codes.
RANGE_BYTES = 32_000_000
LOW = np.uint64(1 << 31)
MAGIC = b"RANS"


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies that add up to 2**SCALE, at least 1 for every id that occurs."""
    total, size = counts.sum(), 1 << SCALE
    if not total:
        return np.zeros(len(counts), np.int64)
    out = np.where(counts > 0, np.maximum(1, np.floor(counts / total * size)), 0).astype(np.int64)
    order = np.argsort(-counts, kind="stable")
    over = int(out.sum()) - size
    for i in order:  # the commonest ids take what rounding left or lacks
        if over == 0:
            break
        step = max(over, -size) if over < 0 else min(over, int(out[i]) - 1)
        out[i] -= step
        over -= step
    return out


class Coder:
    def __init__(self, frequencies: np.ndarray):
        self.f = frequencies.astype(np.uint64)
        self.c = (np.cumsum(frequencies) - frequencies).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(frequencies), dtype=np.uint32), frequencies)

    def encode(self, segments: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(states, words) of each segment; all are coded together, longest first."""
        order = sorted(range(len(segments)), key=lambda k: -len(segments[k]))
        steps = np.array([-(-len(segments[k]) // LANES) for k in order])
        top = int(steps[0]) if len(steps) else 0
        ids = np.zeros((len(order), top * LANES), np.uint32)
        for row, k in enumerate(order):
            ids[row, : len(segments[k])] = segments[k]
            ids[row, len(segments[k]) : steps[row] * LANES] = segments[k][-1]
        ids = ids.reshape(len(order), top, LANES)
        state = np.full((len(order), LANES), LOW, np.uint64)
        words, sent = np.zeros((len(order), top, LANES), np.uint32), np.zeros((len(order), top, LANES), bool)
        shift = np.uint64(32)
        for t in range(top - 1, -1, -1):
            live = int(np.searchsorted(-steps, -t, side="left"))  # rows with more than t steps
            s, x = ids[:live, t], state[:live]
            f = self.f[s]
            full = x >= f << np.uint64(63 - SCALE)
            words[:live, t], sent[:live, t] = x & np.uint64(0xFFFFFFFF), full
            x = np.where(full, x >> shift, x)
            q = x // f
            state[:live] = (q << np.uint64(SCALE)) + (x - q * f) + self.c[s]
        out: list = [None] * len(order)
        for row, k in enumerate(order):
            out[k] = (state[row], words[row][sent[row]])
        return out

    def decode(self, sizes: list[int], states: np.ndarray, words: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
        """The ids of segments with these sizes, states and places of their first word."""
        order = sorted(range(len(sizes)), key=lambda k: -sizes[k])
        steps = np.array([-(-sizes[k] // LANES) for k in order])
        top = int(steps[0]) if len(steps) else 0
        out = np.zeros((len(order), top, LANES), np.uint32)
        state, at = states[order], place[order].astype(np.int64)
        words = np.append(words, np.uint32(0))
        mask = np.uint64((1 << SCALE) - 1)
        for t in range(top):
            live = int(np.searchsorted(-steps, -t, side="left"))
            x = state[:live]
            slot = x & mask
            s = self.symbol[slot]
            out[:live, t] = s
            x = self.f[s] * (x >> np.uint64(SCALE)) + slot - self.c[s]
            need = x < LOW
            nth = np.cumsum(need, axis=1)
            where = np.where(need, at[:live, None] + nth - 1, len(words) - 1)
            state[:live] = np.where(need, (x << np.uint64(32)) | words[where], x)
            at[:live] += nth[:, -1]
        ids: list = [None] * len(order)
        for row, k in enumerate(order):
            ids[k] = out[row].ravel()[: sizes[k]]
        return ids


def pack(blocks: list[tuple[list, list[np.ndarray]]], coder: Coder) -> list[bytes]:
    """Payloads of blocks (doc_ids, ids of each document)."""
    flat = [np.concatenate(docs).astype(np.uint32) for _, docs in blocks]
    cuts = [[x[i : i + SEGMENT] for i in range(0, len(x), SEGMENT)] for x in flat]
    coded = iter(coder.encode([s for own in cuts for s in own]))
    out = []
    for (doc_ids, docs), ids, own in zip(blocks, flat, cuts):
        parts = [next(coded) for _ in own]
        head = [MAGIC, struct.pack("<III", len(docs), len(own), zlib.crc32(ids.astype("<u4").tobytes()))]
        head += [struct.pack("<qII", d if d is not None else 0, d is not None, len(x)) for d, x in zip(doc_ids, docs)]
        head += [struct.pack("<II", len(s), len(w)) + st.astype("<u8").tobytes() for s, (st, w) in zip(own, parts)]
        out.append(b"".join(head + [w.astype("<u4").tobytes() for _, w in parts]))
    return out


def unpack(payloads: list[bytes], coder: Coder) -> list[list[tuple[int | None, np.ndarray]]]:
    """(doc_id, ids) of the documents of each block; raises where a checksum is wrong."""
    heads, sizes, states, words, place, total = [], [], [], [], [], 0
    for raw in payloads:
        if raw[:4] != MAGIC:
            raise ValueError("not a block of token ids")
        n_docs, n_segments, crc = struct.unpack_from("<III", raw, 4)
        docs = [struct.unpack_from("<qII", raw, 16 + 16 * k) for k in range(n_docs)]
        at, first = 16 + 16 * n_docs, len(sizes)
        for _ in range(n_segments):
            size, n_words = struct.unpack_from("<II", raw, at)
            sizes.append(size)
            states.append(np.frombuffer(raw, "<u8", LANES, at + 8))
            place.append(total)
            total += n_words
            at += 8 + 8 * LANES
        words.append(np.frombuffer(raw, "<u4", offset=at))
        heads.append((docs, crc, first, len(sizes)))
    ids = coder.decode(sizes, np.array(states, np.uint64).reshape(-1, LANES), np.concatenate(words) if words else np.zeros(0, np.uint32), np.array(place, np.int64))
    out = []
    for docs, crc, a, b in heads:
        own = np.concatenate(ids[a:b])
        if zlib.crc32(own.astype("<u4").tobytes()) != crc:
            raise ValueError("checksum of a block of token ids is wrong")
        ends = np.cumsum([n for *_, n in docs])
        out.append([(d if real else None, own[e - n : e]) for (d, real, n), e in zip(docs, ends)])
    return out


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end: int, tasks: int | None = None) -> None:
    """The files of all documents; `tasks` look for the bounds of the ranges (as many as a shuffle has, by default)."""
    spark = docs.sparkSession

    def encode(batches):
        v = Vocabulary(tokenizer)
        for batch in batches:
            for part in pieces(batch, limit=8_000_000):
                flat, offsets = encode_texts(v, part.column(1))
                kind = "<u2" if v.size <= 1 << 16 else "<u4"
                flat = np.insert(flat, offsets[1:], end).astype(kind)
                offsets = offsets + np.arange(len(offsets))
                raw = pa.array([flat[a:b].tobytes() for a, b in zip(offsets, offsets[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([kind] * len(raw)), raw], ["doc_id", "kind", "ids"])

    encoded = docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, kind string, ids binary")
    key = F.concat(ordered_key("doc_id"), F.hex(F.substring("ids", 1, 8)))
    ids = staged(encoded.select("doc_id", "kind", "ids", key.alias("key"), F.octet_length("ids").cast("long").alias("bytes")), "token-ids")

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for kind, raw in zip(batch.column(0).to_pylist()[:1], [b"".join(batch.column(1).to_pylist())]):
                own = np.bincount(np.frombuffer(raw, kind))
                total, own = (total, own) if len(total) >= len(own) else (own, total)
                total[: len(own)] += own
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], ["id", "n"])

    counts = ids.select("kind", "ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(int(max(counts["id"].to_pylist(), default=-1)) + 1, np.int64)
    table[counts["id"].to_numpy()] = counts["n"].to_numpy()
    frequencies = scaled(table)
    seen = np.flatnonzero(frequencies)
    spark.createDataFrame(pa.table({"id": pa.array(seen), "frequency": pa.array(frequencies[seen])})).coalesce(1).write.parquet(f"{path}/frequencies")

    def code(batches):
        coder = Coder(frequencies)
        full, doc_ids, own, size, place = [], [], [], 0, (None, 0, 0)

        def flush(full):
            payloads = pack([b[3] for b in full], coder)
            cols = [[b[k] for b in full] for k in range(3)] + [[sum(map(len, b[3][1])) for b in full], payloads]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["part", "block", "first", "n_ids", "payload"])

        for batch in batches:
            for part, doc_id, kind, raw in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if own and (part != place[0] or size >= BLOCK):
                    full.append((*place, (doc_ids, own)))
                    place = (place[0], place[1] + 1, place[2] + size)
                    doc_ids, own, size = [], [], 0
                    if len(full) >= 16:
                        yield flush(full)
                        full = []
                if part != place[0]:
                    place = (part, 0, 0)
                doc_ids.append(doc_id)
                own.append(np.frombuffer(raw, kind))
                size += len(own[-1])
        if own:
            full.append((*place, (doc_ids, own)))
        if full:
            yield flush(full)

    cuts = cut_points(ids, RANGE_BYTES, tasks)
    laid = ids.select(range_number(F.col("key"), cuts).alias("part"), "doc_id", "kind", "ids").repartitionById(max(1, len(cuts)), F.col("part")).sortWithinPartitions("part", "doc_id", "ids")
    laid.mapInArrow(code, "part int, block int, first long, n_ids long, payload binary").write.option("compression", "none").parquet(f"{path}/blocks")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, ids of every document in the files."""
    rows = spark.read.parquet(f"{path}/frequencies").collect()  # as many as the vocabulary has ids
    frequencies = np.zeros(max([r["id"] for r in rows], default=-1) + 1, np.int64)
    for r in rows:
        frequencies[r["id"]] = r["frequency"]
    blocks = spark.read.parquet(f"{path}/blocks")
    before, total = {}, 0
    for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():  # one row for each range
        before[r["part"]], total = total, total + r["n"]

    def run(batches):
        coder = Coder(frequencies)
        for batch in batches:
            for k in range(0, batch.num_rows, 16):
                part, first, payload = (batch.column(c).slice(k, 16).to_pylist() for c in range(3))
                doc_ids, starts, sizes, crcs, ids = [], [], [], [], []
                for p, at, docs in zip(part, first, unpack(payload, coder)):
                    at += before[p]
                    for doc_id, own in docs:
                        doc_ids.append(doc_id), starts.append(at), sizes.append(len(own)), crcs.append(zlib.crc32(own.astype("<u4").tobytes())), ids.append(own)
                        at += len(own)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(np.concatenate(ids).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64()), lists], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return blocks.select("part", "first", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>")


def token_file_digests(spark: SparkSession, path: str) -> DataFrame:
    return read_token_files(spark, path).drop("ids")
