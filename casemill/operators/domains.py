"""H-7: registered domains by a table of public suffix rules, without a list in the plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casemill.functions import scalars as S
from casemill.operators.matching import small


def suffix_table(spark: SparkSession, path: str) -> DataFrame:
    """(base, kind, size) of the rules of a public suffix list file."""
    return rule_table(spark.read.text(path).withColumnRenamed("value", "rule"))


def rule_table(rules: DataFrame) -> DataFrame:
    """(base, kind, size) of rules (column rule): the labels after "*." or "!", what the rule is, how many labels its suffix has.

    Comments, empty lines and what follows white space are left out; rules are compared in lower case.
    """
    rule = F.ltrim(F.lower(F.regexp_extract(F.trim("rule"), r"^(\S*)", 1)), F.lit("."))
    rows = rules.select(rule.alias("rule")).where("rule <> '' and not startswith(rule, '//')").distinct()
    kind = F.when(F.col("rule").startswith("*."), "wild").when(F.col("rule").startswith("!"), "except").otherwise("plain")
    base = F.regexp_replace("rule", r"^(\*\.|!)", "")
    labels = F.size(F.split(base, r"\."))
    return rows.select(base.alias("base"), kind.alias("kind"), F.when(kind == "wild", labels + 1).when(kind == "except", labels - 1).otherwise(labels).alias("size"))


def registered_domains(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, site) of distinct hosts (column host): the label before the public suffix, with it.

    The longest rule wins, exceptions before all; without one the last label is the suffix. An address of numbers and a
    single label are their own site; a port is left out. Each host meets the rules by its label suffixes, in an equal join.
    """
    distinct = hosts.select("host").where("host is not null").distinct()
    name = F.lower(F.regexp_replace("host", r":[0-9]+$", ""))
    split = distinct.select("host", F.split(name, r"\.").alias("labels"))
    n = F.size("labels")
    ends = split.select("host", n.alias("n"), F.explode(F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice("labels", -k, k), "."))).alias("base"))
    met = ends.join(small(rules), "base").where("size <= n")
    sizes = met.groupBy("host").agg(F.max(F.when(F.col("kind") == "except", F.col("size"))).alias("exception"), F.max(F.when(F.col("kind") != "except", F.col("size"))).alias("longest"))
    size = F.coalesce("exception", "longest", F.lit(1))
    own = F.array_join(F.slice("labels", F.greatest(n - size, F.lit(1)), F.least(size + 1, n)), ".")
    alone = F.col("host").rlike(r"^[0-9.]+(:[0-9]+)?$") | (n < 2)
    return split.join(sizes, "host", "left").select("host", F.when(alone, F.lower("host")).otherwise(own).alias("site"))


def with_sites(rows: DataFrame, host: str, rules: DataFrame) -> DataFrame:
    """Rows with the site of their host (null for a null host)."""
    sites = registered_domains(rows.select(F.col(host).alias("host")), rules).select(F.col("host").alias("__host"), "site")
    return rows.join(sites, F.col(host) == F.col("__host"), "left").drop("__host")


def site_summary(urls: DataFrame, rules: DataFrame | None = None, shown: int = 10) -> DataFrame:
    """A-7: (site, urls, occurrences, first_seen, last_seen, sub_urls): registered domains with their commonest URLs.

    sub_urls: the `shown` URLs with most occurrences, each with its own number, ties by URL. URLs are added up before
    anything is ranked, and ranks have a limit, so a popular site is not gathered.
    """
    sited = urls.withColumn("site", S.registered_domain(F.col("domain"))) if rules is None else with_sites(urls, "domain", rules)
    per = sited.groupBy("site", "url").agg(F.sum(F.coalesce("occurrences", F.lit(1))).alias("n"), F.min("first_seen").alias("first"), F.max("last_seen").alias("last"))
    sites = per.groupBy("site").agg(F.count("*").alias("urls"), F.sum("n").alias("occurrences"), F.min("first").alias("first_seen"), F.max("last").alias("last_seen"))
    place = F.row_number().over(Window.partitionBy("site").orderBy(F.desc("n"), "url"))
    top = per.where("url is not null").withColumn("place", place).where(F.col("place") <= shown).groupBy(F.col("site").alias("of")).agg(F.array_sort(F.collect_list(F.struct("place", "url", "n"))).alias("top"))
    joined = sites.join(top, F.col("site").eqNullSafe(F.col("of")), "left")
    return joined.select("site", "urls", "occurrences", "first_seen", "last_seen", F.array_join(F.transform("top", lambda x: F.concat(x["url"], F.lit(" ("), x["n"].cast("string"), F.lit(")"))), "\n").alias("sub_urls"))
