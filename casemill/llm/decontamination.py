"""Operator 6: benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

A window (ten consecutive item words, or a shorter item as a whole) is the set of its three-word shingles. To
contain a window a document must contain its rarest shingle, so that one token is its whole necessary
prefix. Texts are read once: of each document only the positions whose shingle may be in a window (a bit table,
tested inside the row) are kept, with the words around them. Rarity is counted over the kept positions of all
documents; then they are joined to the prefix tokens, the window's length and place must fit, and its words are
compared one by one.

Cases: null and empty texts have no words and are clean (item digest of the empty string). Items without words
are ignored; items of one or two words are windows with shorter shingles. Rows are told apart by a row number, so
repeated rows give repeated results and null and tied doc_ids are kept apart. Extra columns are not read. Empty
tables give clean or no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.llm.common import staged

WINDOW = 10
SHINGLE = 3
#: Tables up to this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000
#: Bits of the table that tests a shingle before the join: at least, at most.
TABLE_BITS = (1 << 18, 1 << 26)

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())
    return F.array_remove(F.split(lowered, SEPARATOR), "")


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingle(words: Column, at: Column, k: int) -> Column:
    """Hash of the k words from 0-based `at`."""
    return F.xxhash64(F.lit(k), *[F.get(words, at + j) for j in range(k)])


def positions(words: Column, k: int) -> Column:
    n = F.size(words)
    return F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def bit_table(hashes: DataFrame, rows: int) -> tuple[Column, int]:
    """A table of bits, set for every hash, as a constant array of longs; its number of longs."""
    bits = TABLE_BITS[0]
    while bits < 64 * rows and bits < TABLE_BITS[1]:
        bits *= 2
    longs = bits // 64
    cells = hashes.select(F.pmod("h", F.lit(longs)).alias("cell"), F.shiftrightunsigned("h", 58).alias("bit")).distinct()
    filled = {r["cell"]: r["v"] for r in cells.groupBy("cell").agg(F.sum(F.expr("shiftleft(1L, cast(bit as int))")).alias("v")).collect()}
    text = ",".join(str(filled.get(i, 0)) for i in range(longs))
    return F.split(F.lit(text), ",").cast("array<bigint>"), longs


def possible(h: Column, table: Column, longs: int) -> Column:
    return F.getbit(F.get(table, F.pmod(h, F.lit(longs)).cast("int")), F.shiftrightunsigned(h, 58).cast("int")) == 1


def benchmark_windows(items: DataFrame) -> DataFrame:
    """(window, items, length): distinct windows as word arrays with the ids of the items that have them."""
    words = items.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    length = F.least(F.lit(WINDOW), F.size("words"))
    starts = words.withColumn("length", length).select("item_id", "words", "length", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)).alias("start"))
    return starts.groupBy(F.slice("words", F.col("start"), F.col("length")).alias("window")).agg(F.collect_set("item_id").alias("items")).withColumn("length", F.size("window"))


def contamination(docs: DataFrame, items: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, item_ids for every document, carried columns."""
    windows = staged(benchmark_windows(items), "windows")
    lengths = [r["length"] for r in windows.select("length").distinct().collect()]
    sizes = sorted({min(SHINGLE, n) for n in lengths})
    if not sizes:
        n_words = F.size(words_of(F.col("text"))).cast("long").alias("n_words")
        return _result(docs.select("doc_id", n_words, *carried).withColumns({"n_hit": F.lit(0).cast("long"), "item_ids": F.array().cast("array<string>")}), carried)

    tokens = None
    for k in sizes:
        these = windows.where(F.least("length", F.lit(SHINGLE)) == k)
        own = these.select("window", "items", "length", F.explode(F.transform(positions(F.col("window"), k), lambda i: F.struct(i.alias("offset"), F.lit(k).alias("k")))).alias("x")).select("window", "items", "length", "x.offset", "x.k", shingle(F.col("window"), F.col("x.offset"), k).alias("h"))
        tokens = own if tokens is None else tokens.union(own)
    distinct = tokens.select("h").distinct()
    n_tokens = distinct.count()
    table, longs = bit_table(distinct, n_tokens)

    def hits(words, k):
        """The positions whose shingle may be a token."""
        return F.transform(F.filter(positions(words, k), lambda i: possible(shingle(words, i, k), table, longs)), lambda i: F.struct(i.alias("i"), F.lit(k).alias("k")))

    # texts are read once; all that follows works on the few positions that are kept, each with the words around it
    mark = F.array(F.struct(F.lit(-1).alias("i"), F.lit(0).alias("k")))  # one row more stands for the document itself
    read = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", *carried, let(words_of(F.col("text")), lambda words: F.struct(words.alias("words"), F.concat(mark, *[hits(words, k) for k in sizes]).alias("hits"))).alias("f"))
    each = read.select("row", "doc_id", *carried, F.col("f.words").alias("words"), F.explode("f.hits").alias("x")).select("row", "doc_id", *carried, "words", "x.*")
    hashes = F.lit(None).cast("long")
    for k in sizes:
        hashes = F.when(F.col("k") == k, shingle(F.col("words"), F.col("i"), k)).otherwise(hashes)
    first = F.greatest(F.col("i") - WINDOW + 1, F.lit(0))
    near = F.when(F.col("i") >= 0, F.slice("words", first + 1, F.lit(2 * WINDOW)))
    kept = staged(each.select("row", "doc_id", *carried, F.size("words").cast("long").alias("n_words"), "i", "k", hashes.alias("h"), first.alias("first"), near.alias("near")), "positions")
    rows, places = kept.where("i < 0").select("row", "doc_id", "n_words", *carried), kept.where("i >= 0").select("row", "n_words", "i", "k", "h", "first", "near")

    counts = places.groupBy("h").count().join(small(distinct, n_tokens), "h")
    rarest = F.min_by(F.struct("offset", "k", "h"), F.struct(F.coalesce("count", F.lit(0)), "h"))
    chosen = tokens.join(counts, "h", "left").groupBy("window").agg(rarest.alias("t"), F.first("items").alias("items"), F.first("length").alias("length"))
    prefix = staged(chosen.select("window", "items", F.col("length").cast("int").alias("length"), "t.*"), "prefix-tokens")

    start = F.col("i") - F.col("offset")
    fits = (start >= F.col("first")) & (start + F.col("length") <= F.col("n_words"))
    same = F.slice("near", F.when(fits, start - F.col("first") + 1).otherwise(1), F.col("length")) == F.col("window")
    verified = places.join(small(prefix, prefix.count()), ["h", "k"]).where(fits & same)
    spans = F.array_sort(F.collect_set(F.struct(start.alias("a"), (start + F.col("length")).alias("b"))))
    found = verified.groupBy("row").agg(spans.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("hit"))
    covered = F.aggregate("spans", zero, lambda acc, s: F.struct(F.greatest(acc["end"], s["b"]).alias("end"), (acc["hit"] + F.greatest(s["b"] - F.greatest(acc["end"], s["a"]), F.lit(0))).alias("hit")))
    found = found.select("row", covered["hit"].alias("n_hit"), "item_ids")
    joined = rows.join(found, "row", "left")
    return _result(joined.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "item_ids": F.coalesce("item_ids", F.array().cast("array<string>"))}), carried)


def _result(rows: DataFrame, carried: tuple[str, ...]) -> DataFrame:
    return rows.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "item_ids", *carried)


#: The same rows in DuckDB SQL.
ORACLE = f"""
with item as (select cast(item_id as varchar) item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{SEPARATOR}'), lambda x: x <> '') w from benchmark),
win as (select distinct item_id, list_slice(w, s, s + least({WINDOW}, len(w)) - 1) win from (select item_id, w, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) s from item where len(w) > 0)),
doc as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{SEPARATOR}'), lambda x: x <> '') w from documents),
hit as (select distinct doc_id, s, n, item_id from (select doc_id, s, n, list_slice(w, s, s + n - 1) win from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) s from doc, (select distinct len(win) n from win))) join win using (win)),
pos as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(s, s + n)) p from hit) group by doc_id),
its as (select doc_id, count(distinct item_id) n_items, string_agg(distinct item_id, ',' order by item_id) ids from hit group by doc_id)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from doc left join pos using (doc_id) left join its using (doc_id)
"""
