"""Links between artifact tables: downloads to URLs, download visits to their referrers, annotations to places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.operators.matching import small

#: The visit type of a download. Fixed value.
DOWNLOAD_VISIT = 7


def last_part(c: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(c, "/", -1)


def download_links(downloads: DataFrame, urls: DataFrame) -> DataFrame:
    """J-22: (id, url_id): for each download the lowest URL id of its evidence and domain whose text ends in "/" and the file's name.

    downloads: id, evidence_id, domain, filename; urls: id, evidence_id, domain, url. ASCII letters and others are compared in
    lower case; every other character stands for itself. Without a URL, or a null domain or name, url_id is null.

    URLs are brought down to one row for each evidence, domain and last part before they are joined, so a popular domain
    is no large group. Names that hold a slash take the way by their own last part, with the rest verified.
    """
    place = ["evidence_id", "domain"]
    name = F.lower("filename")
    asked = downloads.select("id", *place, name.alias("name"))
    known = urls.where(F.col("url").contains("/")).select(*place, F.lower("url").alias("text"), "id")
    lowest = known.groupBy(*place, last_part(F.col("text")).alias("name")).agg(F.min("id").alias("url_id"))
    plain = asked.where(~F.coalesce(F.contains("name", F.lit("/")), F.lit(False))).join(lowest, [*place, "name"], "left").select("id", "url_id")
    deep = asked.where(F.contains("name", F.lit("/"))).withColumn("end", last_part(F.col("name")))
    ends = known.withColumn("end", last_part(F.col("text"))).withColumnRenamed("id", "url_id")
    wanted = deep.select(*place, "end").distinct()
    near = ends.join(wanted, [*place, "end"], "left_semi")  # few names hold a slash, so few URLs are left
    found = deep.join(near, [*place, "end"], "left").groupBy("id").agg(F.min(F.when(F.endswith("text", F.concat(F.lit("/"), "name")), F.col("url_id"))).alias("url_id"))
    return plain.union(found)


def download_referrers(visits: DataFrame, places: DataFrame, visit_type: int = DOWNLOAD_VISIT) -> DataFrame:
    """J-14: (visit_id, download_url, referrer_url) of download visits: visit, its place, the visit it came from, and that one's place.

    visits: id, place_id, from_visit, visit_type; places: id, url. Visits without a known origin are left out.
    """
    urls = places.select(F.col("id").alias("place_id"), "url")
    down = visits.where(F.col("visit_type") == visit_type).select(F.col("id").alias("visit_id"), "place_id", "from_visit")
    down = down.join(urls.withColumnRenamed("url", "download_url"), "place_id").select("visit_id", "download_url", "from_visit")
    origin = visits.select(F.col("id").alias("from_visit"), F.col("place_id").alias("origin"))
    above = urls.select(F.col("place_id").alias("origin"), F.col("url").alias("referrer_url"))
    return down.join(origin, "from_visit").join(above, "origin").select("visit_id", "download_url", "referrer_url")


def referrer_map(visits: DataFrame, places: DataFrame, visit_type: int = DOWNLOAD_VISIT) -> DataFrame:
    """J-14: (download_url, referrer_url): the referrer of each URL's last download visit (the largest id)."""
    return download_referrers(visits, places, visit_type).groupBy("download_url").agg(F.max_by("referrer_url", "visit_id").alias("referrer_url"))


def annotated(places: DataFrame, annotations: DataFrame, attributes: DataFrame, needed: dict[str, str], others: dict[str, str]) -> DataFrame:
    """J-15: places with the values of their annotations: a column for each attribute (column: attribute name).

    places: id and more; annotations: id, place_id, attribute_id, content; attributes: id, name. Places without one of the
    needed attributes are left out, others are null where they are absent. Of several annotations of one kind
    the latest (largest id) counts.
    """
    columns = needed | others
    kinds = attributes.where(F.col("name").isin(*columns.values())).select(F.col("id").alias("attribute_id"), "name")
    own = annotations.join(small(kinds), "attribute_id").groupBy("place_id").agg(*[F.max_by("content", F.when(F.col("name") == name, F.col("id"))).alias(c) for c, name in columns.items()])
    own = own.where(" and ".join(f"{c} is not null" for c in needed) or "true")
    return places.join(own, F.col("id") == F.col("place_id")).drop("place_id")


def download_metadata(rows: DataFrame, column: str) -> DataFrame:
    """J-15: the state, end time and size that a download's metadata (JSON) holds; null where it is absent or broken."""
    held = F.from_json(column, "struct<state:int,endTime:bigint,fileSize:bigint,deleted:boolean>")
    return rows.withColumns({"state": held["state"], "ended": F.timestamp_millis(held["endTime"]), "file_size": held["fileSize"], "deleted": held["deleted"]})


def chain_urls(hops: DataFrame, key: str, order: str, value: str, source: str) -> DataFrame:
    """J-16: (url, discovered_by, downloads, first_place): every link of redirect chains as a URL of its own, once, with the number of chains it is in."""
    rows = hops.where(F.col(value).isNotNull() & (F.col(value) != ""))
    return rows.groupBy(F.col(value).alias("url")).agg(F.count_distinct(key).alias("downloads"), F.min(order).alias("first_place")).withColumn("discovered_by", F.lit(source))


def url_states(urls: DataFrame, downloads: DataFrame) -> DataFrame:
    """J-8: (url, domain, id, sources, source_count, status): URLs once, with the status of their download.

    downloads: url_id, status, of one row for each URL; the status is that of the lowest URL id that has one.
    """
    joined = urls.join(downloads.select(F.col("url_id").alias("id"), "status"), "id", "left")
    groups = joined.groupBy("url", "domain").agg(
        F.min("id").alias("id"), F.array_join(F.array_sort(F.collect_set("discovered_by")), ",").alias("sources"), F.count_distinct("discovered_by").alias("source_count"),
        F.min_by("status", F.when(F.col("status").isNotNull(), F.col("id"))).alias("status"),
    )
    return groups
