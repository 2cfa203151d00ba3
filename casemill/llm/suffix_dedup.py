"""Operator 1: removal of long repeats by sampled suffixes, sorted externally and induced onto the rest.

A byte goes if a 100-byte string that covers it also starts earlier: in a smaller doc_id, or in the same row. The
full order of all suffixes is never needed for that. As in induced sorting, a sparse set of suffixes is chosen by
content alone, sorted and named, and everything else follows from it:

1. A window (100 bytes) is named by the least hash of the 32-byte strings in it. Neighbouring windows of one name
   make a unit, about 35 windows long; equal texts are cut into equal units. Unit tuples (name, content, place) go
   through Spark's shuffle and disk-backed sort, and one pass in sorted order finds the units that occur earlier.
2. Units that do not, but share their name with a different unit (or repeat within themselves), are where repeats begin
   and end. Only their windows go one level down: named by 80-byte strings, cut into smaller units, sorted, passed.
3. What is open still goes down once more, as single windows.
4. Repeated units and windows induce the covered bytes of each document.

The levels below the first, and the result, need texts beside places found by sorting. The texts are written once,
bucketed by doc_id, and joined there each time without another shuffle.

Contents are compared by two keyed 64-bit hashes of all their bytes, beside the name. Tasks hold a bounded piece of text,
or one sorted batch and the state at its edge, never a whole group; equal units are reduced before the shuffle. Names of
very many units (a common line in ever other surroundings) are counted first, and their contents sorted apart.

Cases: null and empty texts, and texts below 100 bytes, lose nothing. A null doc_id comes before all others. Rows with tied doc_ids do not count as
earlier than one another (null and the smallest long tie) and are told apart by a 64-bit hash of their text; repeated rows (same doc_id and text) get the same result each. Extra columns are not read.
An empty table gives no rows. A very long text is cut into ranges of windows with the bytes that these need.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm.common import flat_bytes, made, partitions, pieces, shared_dir, staged

WINDOW = 100
PROBES = (32, 80)  # bytes of the strings that name a window, by level; single windows come below
#: Files of the bucketed texts that tasks may write without a shuffle before.
FILES = 4096
CHUNK = 1 << 18
#: A null doc_id has the place of the smallest id.
NO_ID = -(2**63)

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _joined(x: np.ndarray, y: np.ndarray, factor: np.uint64 = _A) -> np.ndarray:
    z = x * factor
    z += y
    z ^= z >> np.uint64(29)
    return z


def _byte_table(key: int) -> np.ndarray:
    z = (np.arange(256, dtype=np.uint64) + np.uint64(key)) * _A
    for shift in (30, 27, 31):
        z ^= z >> np.uint64(shift)
        z *= _B
    return z


#: Two keyed hashes: the first names and orders, both together stand for a content.
BYTES, CHECK_BYTES = _byte_table(1), _byte_table(0x51ED270B)


def _sliding(x: np.ndarray, width: int, least) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        x = least(x[:-done], x[done:])
        done *= 2
    return least(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def check_hashes(data: np.ndarray) -> np.ndarray:
    """For every window start a second hash of its bytes, by other keys."""
    h = CHECK_BYTES[data]
    for step in (1, 2, 4, 8, 16, 32):
        h = _joined(h[:-step], h[step:], _B)
    return _joined(h[: len(data) - WINDOW + 1], h[WINDOW - 64 : len(data) - 63], _B)


def window_hashes(data: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window start: its name by strings of `width` bytes, the hash of its bytes; then a running count of tied names."""
    h, n, span = BYTES[data], len(data), WINDOW - width + 1
    for step in (1, 2, 4, 8, 16):
        h = _joined(h[:-step], h[step:])
    half = h
    h = _joined(h[:-32], h[32:])
    base, short = (h, 64) if width >= 64 else (half, 32)
    probe = _joined(base[: n - width + 1], base[width - short : n - short + 1])
    probe *= _B
    probe ^= probe >> np.uint64(32)
    whole = _joined(h[: n - WINDOW + 1], h[WINDOW - 64 : n - 63])
    name = _sliding(probe, span, np.minimum)
    edge = np.zeros(span - 1, np.uint64)
    anchors = np.flatnonzero(_sliding(np.concatenate([edge, name, edge]), span, np.maximum) == probe)
    tie = np.zeros(len(probe) + 1, np.int32)
    tie[1:][anchors[1:][(probe[anchors[1:]] == probe[anchors[:-1]]) & (np.diff(anchors) <= span)]] = 1
    return name, whole, np.cumsum(tie)


def text_units(data: np.ndarray, offsets: np.ndarray, width: int = PROBES[0], checked: bool = True) -> dict[str, np.ndarray]:
    """Units of all texts of a piece: text index, start, windows, name, content, check, and whether it may repeat in itself."""
    owner = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    out = []
    for a in range(0, max(0, len(data) - WINDOW + 1), CHUNK):
        b = min(a + CHUNK, len(data) - WINDOW + 1)
        name, whole, ties = window_hashes(data[a : b + WINDOW - 1], width)
        valid = np.flatnonzero(owner[a:b] == owner[a + WINDOW - 1 : b + WINDOW - 1])
        if not len(valid):
            continue
        named, own = name[valid], owner[a:b][valid]
        new = np.r_[True, (named[1:] != named[:-1]) | (own[1:] != own[:-1])]
        starts = np.flatnonzero(new)
        if np.diff(np.r_[starts, len(valid)]).max() > WINDOW:
            new |= (np.arange(len(valid)) - starts[np.cumsum(new) - 1]) % WINDOW == 0
            starts = np.flatnonzero(new)
        first, last = valid[starts], valid[np.r_[starts[1:], len(valid)] - 1]
        content = _joined(whole[first], whole[last])
        content ^= (last - first).astype(np.uint64) * _B
        check = content
        if checked:
            second = check_hashes(data[a : b + WINDOW - 1])
            check = _joined(second[first], second[last], _B)
        out.append((own[starts], first + a - offsets[own[starts]], last - first + 1, named[starts], content, check, ties[last + WINDOW - width + 1] > ties[first]))
    columns = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, t) for t in (np.int32, np.int64, np.int64, np.uint64, np.uint64, np.uint64, bool)]
    return dict(zip(("text", "start", "windows", "name", "content", "check", "tied"), columns))


def placed(start: np.ndarray, windows: np.ndarray, tied: np.ndarray) -> np.ndarray:
    """Start (32 bits), windows (7) and whether the unit may repeat in itself (1) as one number, in this order."""
    return (start.astype(np.int64) << 8) | (windows.astype(np.int64) << 1) | tied.astype(np.int64)


def earlier_flags(name, content, check, doc, row, place) -> tuple[np.ndarray, np.ndarray]:
    """For tuples in sorted order: whether an equal one is earlier; whether its name has different contents."""
    n = len(name)
    if not n:
        return np.zeros(0, bool), np.zeros(0, bool)
    new_name = np.r_[True, name[1:] != name[:-1]]
    new = new_name | np.r_[True, (content[1:] != content[:-1]) | (check[1:] != check[:-1])]
    start = place >> 8
    new_row = new | np.r_[True, (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])]
    least = doc[np.maximum.accumulate(np.where(new, np.arange(n), 0))]
    first = start[np.maximum.accumulate(np.where(new_row, np.arange(n), 0))]
    earlier = (doc != least) | (start != first)
    group = np.cumsum(new_name) - 1
    return earlier, (np.bincount(group, new) > 1)[group]


def _tuples(*columns) -> pa.RecordBatch:
    """Tuples of a piece, reduced: one that is equal to an earlier one of the piece loses name, content and check (all 0)."""
    order = np.lexsort(columns[::-1])
    name, content, check, doc, row, place = (x.astype(np.int64)[order] for x in columns)
    kept = ~earlier_flags(name, content, check, doc, row, place)[0]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (name * kept, content * kept, check * kept, doc, row, place)], ["name", "content", "check", "doc_id", "row", "place"])


TUPLES = "name long, content long, check long, doc_id long, row long, place long"


def unit_tuples(docs: DataFrame) -> DataFrame:
    """Tuples of the units of all texts (doc_id, text, row)."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, limit=12_000_000):
                data, offsets = flat_bytes(part.column(1))
                u = text_units(data, offsets)
                doc, row = part.column(0).to_numpy(), part.column(2).to_numpy()
                yield _tuples(u["name"].view(np.int64), u["content"].view(np.int64), u["check"].view(np.int64), doc[u["text"]], row[u["text"]], placed(u["start"], u["windows"], u["tied"]))

    return docs.mapInArrow(run, TUPLES)


def often(names: DataFrame) -> list[int]:
    """The names of more than an eighth of a task's share of all tuples; every name of more than a quarter is among them.

    names has counts of pieces (name, n), where a piece leaves out what is below an eighth of a share of its own, and
    a row without a name for its total. By this rule there are at most eight names for each shuffle partition.
    """
    sums = staged(names.groupBy("name").agg(F.sum("n").alias("n")), "names")
    total = sums.where("name is null").agg(F.sum("n")).first()[0] or 0
    return sorted(r["name"] for r in sums.where("name is not null").where(F.col("n") > total / (8 * partitions(names.sparkSession))).select("name").collect())


def _counted(name: np.ndarray, tasks: int) -> pa.RecordBatch:
    names, n = np.unique(name.view(np.int64), return_counts=True)
    many = n > len(name) / (8 * tasks)
    return pa.RecordBatch.from_arrays([pa.array([*names[many].tolist(), None], pa.int64()), pa.array([*n[many].tolist(), len(name)], pa.int64())], ["name", "n"])


def unit_names(docs: DataFrame) -> DataFrame:
    """What often() needs of the units of all texts (doc_id, text, row)."""
    tasks = partitions(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in pieces(batch, limit=12_000_000):
                yield _counted(text_units(*flat_bytes(part.column(1)), checked=False)["name"], tasks)

    return docs.mapInArrow(run, "name long, n long")


def repeated_tuples(tuples: DataFrame, hot: list[int]) -> DataFrame:
    """doc_id, row, place, again: tuples equal to an earlier one (again), and first ones whose name has other contents or ties.

    A name goes to one task, but for those in `hot`: their contents go to tasks of their own, and count as different.
    """
    hot_names = np.array(hot, np.int64)

    def run(batches):
        held = None
        for batch in batches:
            own = [batch.column(k).to_numpy() for k in range(6)] + [np.zeros(batch.num_rows, bool)]
            name, content, check, doc, row, place, done = (np.concatenate(x) for x in zip(held, own)) if held else own
            reduced = (name == 0) & (content == 0)
            earlier, mixed = earlier_flags(name, content, check, doc, row, place)
            mixed |= np.isin(name, hot_names)
            earlier |= reduced
            open_group = (name == name[-1]) & ~mixed & ~reduced  # may still meet other contents
            ready = ~done & (earlier | ~open_group & (mixed | (place & 1 == 1)))
            yield result(doc[ready], row[ready], place[ready], earlier[ready])
            # what the next batch needs: the edge of the last group, and first ones not decided yet
            keep = np.zeros(len(name), bool)
            last_name = np.flatnonzero(name == name[-1])
            last_content = last_name[(content[last_name] == content[-1]) & (check[last_name] == check[-1])]
            keep[[last_name[0], last_content[0]]] = True
            last_row = last_content[(doc[last_content] == doc[-1]) & (row[last_content] == row[-1])]
            keep[last_row[0]] = True
            keep |= open_group & ~earlier
            held = [x[keep] for x in (name, content, check, doc, row, place, done | ~open_group | earlier)]
        if held:
            *_, doc, row, place, done = held
            left = ~done & (place & 1 == 1)
            yield result(doc[left], row[left], place[left], np.zeros(left.sum(), bool))

    def result(doc, row, place, again):
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(row), pa.array(place), pa.array(again)], ["doc_id", "row", "place", "again"])

    route = F.when((F.col("name") == 0) & (F.col("content") == 0), F.xxhash64("doc_id", "row", "place")).when(F.col("name").isin(hot), F.xxhash64("name", "content", "check")).otherwise(F.col("name"))
    return tuples.repartition(route).sortWithinPartitions("name", "content", "check", "doc_id", "row", "place").mapInArrow(run, "doc_id long, row long, place long, again boolean")


def _windows(part: pa.RecordBatch):
    """The bytes of the units in places of rows (doc_id, text, row, places), in turns: doc_id, row, start, windows of each, bytes, their ends."""
    data, offsets = flat_bytes(part.column(1))
    doc, row, lists = part.column(0).to_numpy(), part.column(2).to_numpy(), part.column(3)
    places = lists.flatten().to_numpy()
    text = np.repeat(np.arange(len(doc)), lists.value_lengths().to_numpy())
    for a in range(0, len(places), 20_000):
        p, t = places[a : a + 20_000], text[a : a + 20_000]
        start, windows = (p >> 8) & 0xFFFFFFFF, (p >> 1) & 127
        size = windows + WINDOW - 1
        ends = np.cumsum(size)
        yield doc[t], row[t], start, windows, data[np.arange(ends[-1]) + np.repeat(start + offsets[t] - (ends - size), size)], ends


def deeper_names(docs: DataFrame, width: int) -> DataFrame:
    """What often() needs of the smaller units of the units in places."""
    tasks = partitions(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in pieces(batch, limit=4_000_000):
                for *_, own, ends in _windows(part):
                    yield _counted(text_units(own, np.r_[0, ends], width, checked=False)["name"], tasks)

    return docs.mapInArrow(run, "name long, n long")


def deeper_tuples(docs: DataFrame, width: int | None) -> DataFrame:
    """Tuples of smaller units (of single windows without a width) of the units in places of rows (doc_id, text, row, places)."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, limit=4_000_000):
                for doc, row, start, windows, own, ends in _windows(part):
                    if width:
                        u = text_units(own, np.r_[0, ends], width)
                        name, content, check, f, at, n, tied = (u[k] for k in ("name", "content", "check", "text", "start", "windows", "tied"))
                    else:
                        least, whole, _ = window_hashes(own, PROBES[0])
                        f = np.repeat(np.arange(len(doc)), windows)
                        at = np.arange(len(f)) - np.repeat(np.cumsum(windows) - windows, windows)
                        first = np.r_[0, ends[:-1]][f] + at
                        name, content, check = whole[first], least[first], check_hashes(own)[first]
                        n, tied = np.ones(len(f), np.int64), np.zeros(len(f), np.int64)
                    yield _tuples(name.view(np.int64), content.view(np.int64), check.view(np.int64), doc[f], row[f], placed(start[f] + at, n, tied))

    return docs.mapInArrow(run, TUPLES)


def bucketed(rows: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, bucketed by doc_id and row for joins without a shuffle."""
    spark = rows.sparkSession
    buckets = partitions(spark)
    if rows.rdd.getNumPartitions() * buckets > FILES:
        rows = rows.repartition(buckets, "doc_id", "row")
    name = f"texts_{uuid.uuid4().hex}"
    rows.write.bucketBy(buckets, "doc_id", "row").option("compression", "zstd").option("path", made(f"{shared_dir(spark)}/{name}", name)).saveAsTable(name)
    return spark.table(name)


def by_document(places: DataFrame) -> DataFrame:
    return places.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("place")).alias("places"))


def repeats(docs: DataFrame, carried: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, text, row, no_id, carried columns), and places by (doc_id, row): starts of repeated windows, in runs."""
    text = F.coalesce("text", F.lit(""))
    no_id = F.col("doc_id").isNull()
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), text.alias("text"), F.xxhash64(text, no_id).alias("row"), no_id.alias("no_id"), *carried)
    plain = rows.select("doc_id", "text", "row")
    found = [staged(repeated_tuples(unit_tuples(plain), often(unit_names(plain))), "units")]
    texts = bucketed(rows)
    for width in (*PROBES[1:], None):
        open_units = texts.join(by_document(found[-1].where("not again")), ["doc_id", "row"]).select("doc_id", "text", "row", "places")
        hot = often(deeper_names(open_units, width)) if width else []  # equal windows have one content
        found.append(staged(repeated_tuples(deeper_tuples(open_units, width), hot), "units"))
    again = found[0].where("again")
    for f in found[1:]:
        again = again.union(f.where("again"))
    return texts, by_document(again)


def removed_spans(size: int, places: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    if not len(places):
        return []
    start = (places >> 8) & 0xFFFFFFFF
    end = start + ((places >> 1) & 127) + WINDOW - 1
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    cut = np.flatnonzero(start[1:] > end[:-1])
    return list(zip(start[np.r_[0, cut + 1]].tolist(), np.minimum(end[np.r_[cut, len(end) - 1]], size).tolist()))


def without_repeats(docs: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, spans (start, end) removed, kept (binary), text, carried columns: every row with what is left of it.

    text is kept as a string, without the bytes of characters that were cut in part.
    """
    rows, places = repeats(docs, carried)

    def run(batches):
        for batch in batches:
            for part in pieces(batch, limit=8_000_000):
                data, offsets = flat_bytes(part.column(1))
                spans, kept = [], []
                for a, b, own in zip(offsets[:-1].tolist(), offsets[1:].tolist(), part.column(2)):
                    raw = data[a:b].tobytes()
                    found = removed_spans(b - a, own.values.to_numpy()) if own.is_valid else []
                    ends = [0] + [y for _, y in found]
                    kept.append(b"".join(raw[x:y] for x, y in zip(ends, [x for x, _ in found] + [len(raw)])))
                    spans.append([{"start": x, "end": y} for x, y in found])
                columns = [part.column(0), pa.array(np.diff(offsets)), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary()), pa.array([k.decode(errors="ignore") for k in kept], pa.string())]
                yield pa.RecordBatch.from_arrays(columns + part.columns[3:], ["doc_id", "n_bytes", "spans", "kept", "text", *carried])

    carried = ("no_id", *carried)
    matched = rows.join(places, ["doc_id", "row"], "left").select("doc_id", "text", "places", *carried)
    kinds = "".join(f", {c} {matched.schema[c].dataType.simpleString()}" for c in carried)
    out = matched.mapInArrow(run, f"doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary, text string{kinds}")
    return out.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")


def repeat_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    return without_repeats(docs).select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
