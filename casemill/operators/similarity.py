"""Fingerprint search within a Hamming radius, all pairs by probed bands, and greedy leader clusters."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.tables import table


def _half(c: str, at: int):
    return F.conv(F.substring(c, at, 8), 16, 10).cast("long")


def distance(a: str, b: str):
    """Differing bits of two 16-digit hashes; 64 if one is not such a hash."""
    bits = sum((F.bit_count(_half(a, k).bitwiseXOR(_half(b, k))) for k in (1, 9)), F.lit(0))
    valid = F.col(a).rlike("^[0-9a-fA-F]{16}$") & F.col(b).rlike("^[0-9a-fA-F]{16}$")
    return F.when(valid, bits).otherwise(64)


def prefix(c: str):
    """C-2: the first 16 bits as a number; null if they are not hex."""
    return F.when(F.col(c).rlike("^[0-9a-fA-F]{4}"), F.conv(F.substring(c, 1, 4), 16, 10).cast("int"))


def near(images: DataFrame, target: DataFrame, radius: int) -> DataFrame:
    """J-7: (id, phash, distance) within the radius of the target (one row)."""
    one = target.select(F.col("phash").alias("target")).limit(1)
    return images.crossJoin(F.broadcast(one)).withColumn("distance", distance("phash", "target")).where(F.col("distance") <= radius).drop("target")


#: Bits that are still compared, and the bands they are cut into; a band's bits are fixed for the level below.
LEVELS = ((64, 4), (48, 4), (36, 4), (27, 3), (18, 3), (12, 2))
#: Hashes that may lie under one value of a band before it is cut again.
GROUP = 1000


def _flips(width: int, most: int) -> list[int]:
    return [sum(1 << i for i in c) for k in range(most + 1) for c in combinations(range(width), k)]


def _budgets(radius: int, bands: int) -> list[int]:
    """Bits that each band may differ in: hashes within the radius keep to the budget of one band at least (-1: not this one)."""
    return [(radius + 1) // bands - 1 + (k < (radius + 1) % bands) for k in range(bands)]


def _cut(rest: str, bits: int, bands: int) -> list[tuple]:
    """(value, what is left) of each band of the low `bits` bits."""
    width, out = bits // bands, []
    for k in range(bands):
        shift = bits - width * (k + 1)
        value = F.shiftrightunsigned(rest, shift).bitwiseAND(F.lit((1 << width) - 1))
        above = F.shiftrightunsigned(rest, shift + width) if k else F.lit(0).cast("long")
        out.append((value, F.shiftleft(above, shift).bitwiseOR(F.col(rest).bitwiseAND(F.lit((1 << shift) - 1)))))
    return out


def _place(k: int, value, rest, width: int, *more):
    return F.struct((F.col("path") * 4 + k).alias("path"), F.shiftleft("fixed", width).bitwiseOR(value).alias("fixed"), rest.alias("rest"), *more)


def _probe(k: int, value, rest, width: int):
    return lambda f: _place(k, value.bitwiseXOR(f), rest, width, (F.col("left") - F.bit_count(f)).alias("left"))


def near_pairs(images: DataFrame, radius: int, group: int = GROUP) -> DataFrame:
    """J-7: (a, b, distance) of distinct hashes within the radius: one of four bands keeps to its budget of differing bits.

    One side probes each band with every value that near, the other lies under its own; copies share a hash. A value
    that more than `group` hashes share is cut again: the bits beside it into bands, with the budget that the probe has
    left, and so on, so no join key holds more than that (or 64, when all other bits are fixed).
    """
    hashes = images.where(F.col("phash").rlike("^[0-9a-fA-F]{16}$")).select(F.lower("phash").alias("phash")).distinct()
    start = hashes.select(F.shiftleft(_half("phash", 1), 32).bitwiseOR(_half("phash", 9)).alias("h"))
    # few bytes, but each hash makes a thousand probes at a radius of 12: a number of its own keeps adaptive plans from putting them into one task
    start = start.repartition(int(images.sparkSession.conf.get("spark.sql.shuffle.partitions")), "h")
    own = start.select("h", F.lit(0).cast("long").alias("path"), F.lit(0).cast("long").alias("fixed"), F.col("h").alias("rest"))
    probes, found = own.withColumn("left", F.lit(radius)), []
    for level, (bits, bands) in enumerate(LEVELS):
        width = bits // bands
        cut = _cut("rest", bits, bands)
        own = own.select("h", F.explode(F.array(*[_place(k, v, rest, width) for k, (v, rest) in enumerate(cut)])).alias("x")).select("h", "x.*")
        ways = []
        for k, (value, rest) in enumerate(cut):
            tries = F
            for left in range(radius + 1):
                tries = tries.when(F.col("left") == left, F.array(*[F.lit(f).cast("long") for f in _flips(width, _budgets(left, bands)[k])]).cast("array<bigint>"))
            ways.append(F.transform(tries, _probe(k, value, rest, width)))
        probes = probes.select("h", F.explode(F.flatten(F.array(*ways))).alias("x")).select("h", "x.*")
        calm_own, calm_probes, hot = own, probes, None
        if level + 1 < len(LEVELS):
            large = own.groupBy("path", "fixed").count().where(F.col("count") > group).select("path", "fixed")
            if not large.isEmpty():
                hot = [table(df.join(large, ["path", "fixed"], "left_semi"), "hot-bands") for df in (own, probes)]
                calm_own, calm_probes = (df.join(large, ["path", "fixed"], "left_anti") for df in (own, probes))
        a, b = calm_probes.select(F.col("h").alias("a"), "path", "fixed"), calm_own.select(F.col("h").alias("b"), "path", "fixed")
        order = [F.col(c).bitwiseXOR(F.lit(-(2**63))) for c in ("a", "b")]
        pairs = a.join(b, ["path", "fixed"]).where(order[0] < order[1]).withColumn("distance", F.bit_count(F.col("a").bitwiseXOR(F.col("b"))))
        found.append(pairs.where(F.col("distance") <= radius).select("a", "b", "distance"))
        if hot is None:
            break
        own, probes = hot
    text = lambda c: F.lower(F.lpad(F.hex(c), 16, "0")).alias(c)
    return reduce(DataFrame.union, found).distinct().select(text("a"), text("b"), "distance")


def leader_clusters(images: DataFrame, radius: int) -> DataFrame:
    """C-1: (id, phash, leader, distance) as the greedy loop over sorted hashes gives them, by rounds.

    A hash without a smaller open neighbour leads; neighbours of leaders are covered; each takes its smallest leader.
    """
    pairs = table(near_pairs(images, radius), "near-pairs")
    state = table(images.where(F.col("phash").rlike("^[0-9a-fA-F]{16}$")).select(F.lower("phash").alias("h")).distinct().withColumn("role", F.lit("open")), "clusters")
    while not state.where("role = 'open'").isEmpty():
        roles = pairs.join(state.select(F.col("h").alias("a"), F.col("role").alias("above")), "a")
        above = roles.groupBy(F.col("b").alias("h")).agg(F.max(F.col("above") == "open").alias("waits"), F.max(F.col("above") == "leader").alias("led"))
        new = F.when(F.col("role") != "open", F.col("role")).when(F.col("led"), "covered").when(F.coalesce("waits", F.lit(False)), "open").otherwise("leader")
        state = table(state.join(above, "h", "left").select("h", new.alias("role")), "clusters")
    leaders = state.where("role = 'leader'").select(F.col("h").alias("a"))
    nearest = pairs.join(leaders, "a").groupBy(F.col("b").alias("h")).agg(F.min("a").alias("by"))
    named = state.join(nearest, "h", "left").select("h", F.when(F.col("role") == "leader", F.col("h")).otherwise(F.col("by")).alias("leader"))
    return images.withColumn("h", F.lower("phash")).join(named, "h").select("id", "phash", "leader", distance("h", "leader").alias("distance"))


def cluster_sources(clusters: DataFrame, browser: DataFrame) -> DataFrame:
    """C-1: clusters with their number of members and whether one of them (browser: its ids) came from a browser."""
    marked = clusters.join(browser.select("id", F.lit(True).alias("of_browser")).distinct(), "id", "left")
    return marked.groupBy("leader").agg(F.count("*").alias("n"), F.max(F.coalesce("of_browser", F.lit(False))).alias("has_browser_source"))


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    """K-4."""
    return clusters.groupBy("leader").agg(F.count("*").alias("n"), F.max("distance").alias("widest")).orderBy(F.desc("n"), "leader")
