"""Operator 3: near-duplicates by SimHash, linked by a binary trie self-join.

Fingerprints within three bits agree on one quarter of their bits at least. Each distinct fingerprint enters
four binary tries, one for each quarter brought to the top; pairs of nodes descend together only below an equal
quarter, add up the bits in which they differ, and are dropped beyond the error budget. A quarter that very
many fingerprints share is cut again in the same way (quarters of the remaining bits), so no task gets an
unbounded group. A task gives a spanning set of its links, not all pairs; groups come from connected
components over the links of all tasks.

Cases: null and empty texts, and texts of white space, have fingerprint zero and are linked like any other.
Repeated rows and tied doc_ids each give a row. A row with a null doc_id gets a fingerprint and is linked, but names a
component (null) only where no row of it has a doc_id. Extra columns are not read. Empty tables give no rows. A text
beyond a piece (4 MB) is hashed and voted on in slices.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm.common import looked_up, pieces, staged, texts_of, word_slices
from casemill.llm.components import components

SEED = 42
#: A group with more fingerprints is cut into smaller ones.
GROUP = 100_000
#: Times that a group may be cut; then twelve bits are left to differ, so no group has more than 4,096 fingerprints.
CUTS = 6


def shingle_hashes(words: list[bytes], width: int) -> list[int]:
    """Hashes of all runs of `width` words; of all words together where there are fewer."""
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1)
    starts = (ends - sizes - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())]


def text_fingerprint(text: str, width: int) -> int:
    """The fingerprint of one text of any length: read, hashed and voted on slice by slice."""
    votes, total, held = np.zeros(64, np.int64), 0, []
    for own in word_slices(text):
        held += own
        if len(held) >= width:
            hashes = np.array(shingle_hashes(held, width), ">u8")
            votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
            total += len(hashes)
            held = held[len(held) - width + 1 :]
    if not total:
        return next(iter(shingle_hashes(held, width)), 0)
    return int(np.packbits(votes * 2 > total).view(">u8")[0])


def majority(hashes: list[list[int]]) -> np.ndarray:
    """For each list of 64-bit hashes the value whose bits are those set in over half of them."""
    sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
    out = np.zeros(len(hashes), ">u8")
    full = np.flatnonzero(sizes)
    if len(full):
        flat = np.fromiter((h for own in hashes for h in own), np.uint64, sizes.sum()).astype(">u8")
        bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1)
        starts = np.r_[0, np.cumsum(sizes[full])[:-1]]
        votes = np.add.reduceat(bits, starts, axis=0, dtype=np.uint32)
        out[full] = np.packbits(votes * 2 > sizes[full][:, None], axis=1).view(">u8").ravel()
    return out.astype(np.uint64)


def fingerprints(docs: DataFrame, width: int = 3, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp: the 64-bit fingerprint as a signed long; carried string columns."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                texts = texts_of(part)
                if len(texts) == 1:  # a very long text is a piece of its own
                    fps = np.array([text_fingerprint(texts[0], width)], np.uint64)
                else:
                    fps = majority([shingle_hashes(t.encode().lower().split(), width) for t in texts])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64)), *part.columns[2:]], ["doc_id", "fp", *carried])

    return docs.select("doc_id", "text", *carried).mapInArrow(run, "doc_id long, fp long" + "".join(f", {c} string" for c in carried))


def trie_links(group: np.ndarray, fp: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of the links within `budget` bits between fingerprints of the same group.

    Rows are sorted by (group, fp), fp unsigned. A trie node is a range of rows; pairs of nodes go down bit by
    bit. Small pairs of nodes are compared row by row. Pairs of nodes already in one component are dropped.
    """
    n = len(fp)
    comp = np.arange(n)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, np.int64)
    last = np.r_[first[1:], n] if n else first
    many = last - first > 1
    stack = [(64, first[many], last[many], first[many], last[many], np.zeros(many.sum(), np.int64))]
    ones: dict[int, np.ndarray] = {}
    changes, stale = None, True
    while stack:
        bit, alo, ahi, blo, bhi, spent = stack.pop()
        if len(alo) > 200_000:
            half = len(alo) // 2
            stack += [(bit, *(x[:half] for x in (alo, ahi, blo, bhi, spent))), (bit, *(x[half:] for x in (alo, ahi, blo, bhi, spent)))]
            continue
        if stale:
            changes, stale = np.r_[0, np.cumsum(comp[1:] != comp[:-1])] if n else np.zeros(0, np.int64), False
        joined = (changes[ahi - 1] == changes[alo]) & (changes[bhi - 1] == changes[blo]) & (comp[alo] == comp[blo])
        size = (ahi - alo) * (bhi - blo)
        small = (size <= 64) | (bit == 0)
        now = np.flatnonzero(small & ~joined)
        if len(now):
            count = size[now]
            ends = np.cumsum(count)
            at = np.arange(ends[-1]) - np.repeat(ends - count, count)
            width = np.repeat((bhi - blo)[now], count)
            i, j = np.repeat(alo[now], count) + at // width, np.repeat(blo[now], count) + at % width
            near = (i < j) & (np.bitwise_count(fp[i] ^ fp[j]) <= budget)
            i, j = i[near], j[near]
            while len(i):
                ci, cj = comp[i], comp[j]
                apart = ci != cj
                if not apart.any():
                    break
                i, j, stale = i[apart], j[apart], True
                np.minimum.at(comp, np.maximum(ci, cj)[apart], np.minimum(ci, cj)[apart])
                while (up := comp[comp]).tobytes() != comp.tobytes():
                    comp = up
        rest = ~small & ~joined
        if not rest.any():
            continue
        alo, ahi, blo, bhi, spent, bit = alo[rest], ahi[rest], blo[rest], bhi[rest], spent[rest], bit - 1
        if bit not in ones:
            ones[bit] = np.r_[0, np.cumsum((fp >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)]
        amid, bmid = ahi - (ones[bit][ahi] - ones[bit][alo]), bhi - (ones[bit][bhi] - ones[bit][blo])
        own = alo == blo
        pairs = [(alo, amid, blo, bmid, spent), (amid, ahi, bmid, bhi, spent), (alo, amid, bmid, bhi, spent + 1), tuple(x[~own] for x in (amid, ahi, blo, bmid, spent + 1))]
        alo, ahi, blo, bhi, spent = (np.concatenate(x) for x in zip(*pairs))
        keep = (ahi > alo) & (bhi > blo) & (spent <= budget) & ((alo != blo) | (ahi - alo > 1))
        stack.append((bit, *(x[keep] for x in (alo, ahi, blo, bhi, spent))))
    linked = np.flatnonzero(comp != np.arange(n))
    return linked, comp[linked]


def _cut(rows: DataFrame, fixed: int) -> DataFrame:
    """Each row once for each quarter of its bits below the `fixed` top ones, that quarter brought up beside them."""
    rest, step = 64 - fixed, (64 - fixed) // 4
    mask = (1 << rest) - 1
    low = F.col("bits").bitwiseAND(F.lit(mask if mask < 2**63 else -1))
    high = F.col("bits").bitwiseAND(F.lit(-1 - mask if fixed else 0))
    turned = [low] + [F.shiftleft(low, k * step).bitwiseOR(F.shiftrightunsigned(low, rest - k * step)).bitwiseAND(F.lit(mask if mask < 2**63 else -1)) for k in (1, 2, 3)]
    paths = F.array(*[F.struct((F.col("path") * 4 + k).alias("path"), high.bitwiseOR(t).alias("bits")) for k, t in enumerate(turned)])
    return rows.select("fp", F.explode(paths).alias("x")).select("fp", "x.path", "x.bits")


def near_links(distinct: DataFrame, budget: int = 3, group: int = GROUP) -> DataFrame:
    """Links (u, v) that connect all fingerprints (column fp, distinct) within `budget` <= 3 bits of one another."""

    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            now = tuple(batch.column(k).to_numpy() for k in range(4))
            if not len(now[0]):
                continue
            within = held and held[-1][1][-1] == now[1][-1] and held[-1][2][-1] == now[2][-1]
            held.append(now)
            if within:  # rows come in order, so all of them are of the group that is being read
                continue
            fp, key, path, bits = (np.concatenate(x) for x in zip(*held))
            ends = np.flatnonzero((key[1:] != key[:-1]) | (path[1:] != path[:-1]))
            whole = ends[-1] + 1 if len(ends) else 0
            if whole >= 20_000:
                yield joined(fp[:whole], key[:whole], path[:whole], bits[:whole])
                fp, key, path, bits = fp[whole:], key[whole:], path[whole:], bits[whole:]
            held = [(fp, key, path, bits)]
        if held:
            yield joined(*(np.concatenate(x) for x in zip(*held)))

    def joined(fp, key, path, bits):
        bits = bits.view(np.uint64)
        order = np.lexsort((bits, key, path))
        fp, key, path, bits = fp[order], key[order], path[order], bits[order]
        group_of = np.cumsum(np.r_[True, (key[1:] != key[:-1]) | (path[1:] != path[:-1])]) if len(fp) else key
        i, j = trie_links(group_of, bits, budget)
        return pa.RecordBatch.from_arrays([pa.array(fp[i]), pa.array(fp[j])], ["u", "v"])

    rows, fixed, out = distinct.select("fp", F.lit(0).cast("long").alias("path"), F.col("fp").alias("bits")), 0, None
    for level in range(CUTS):
        rows = _cut(rows, fixed)
        fixed += (64 - fixed) // 4
        rows = rows.withColumn("key", F.shiftrightunsigned("bits", 64 - fixed))
        calm, hot = rows, None
        if level + 1 < CUTS:
            large = rows.groupBy("path", "key").count().where(F.col("count") > group).select("path", "key")
            if not large.isEmpty():
                hot = staged(rows.join(large, ["path", "key"], "left_semi").select("fp", "path", "bits"), "hot-groups")
                calm = rows.join(large, ["path", "key"], "left_anti")
        found = calm.select("fp", "key", "path", "bits").repartition("path", "key").sortWithinPartitions("path", "key").mapInArrow(run, "u long, v long")
        out = found if out is None else out.union(found)
        if hot is None:
            break
        rows = hot
    return out


def _rooted(distinct: DataFrame, budget: int, group: int) -> DataFrame:
    """fp, least of the distinct fingerprints, with the root of their component."""
    found = components(near_links(distinct, budget, group))
    return distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))


def near_representatives(docs: DataFrame, key: str, width: int = 3, budget: int = 3, group: int = GROUP) -> DataFrame:
    """One value of the key column (a string, not null) for each component: of the smallest doc_id, null last, then the smallest."""
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col(key).alias("key"))
    distinct = staged(fingerprints(docs, width, (key,)).groupBy("fp").agg(F.min(order).alias("least")), "distinct-fingerprints")
    return _rooted(distinct, budget, group).groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.key").alias(key))


def near_duplicates(docs: DataFrame, width: int = 3, budget: int = 3, group: int = GROUP) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id that links reach, itself included.

    One fingerprint with very many rows, and one component with very many fingerprints, are joined by broadcast.
    """
    fps = staged(fingerprints(docs, width), "fingerprints")
    distinct = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = staged(_rooted(distinct, budget, group), "rooted-fingerprints")
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = staged(looked_up(roots, least, "root").select("fp", "component_id"), "named-fingerprints")
    return looked_up(fps, named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
