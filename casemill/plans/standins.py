"""Evidence tables as views over the given tables, each as Spark SQL and as DuckDB SQL.

The texts are portable but for a few spellings, given as {names}.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPELLINGS = {
    "spark": {"epoch": "unix_timestamp(ts)", "day": "to_date(ts)", "order_epoch": "unix_timestamp(o_orderdate)", "ship_epoch": "unix_timestamp(l_shipdate)", "div10": "p_partkey div 10", "string": "string"},
    "duckdb": {"epoch": "floor(epoch(ts))::bigint", "day": "ts::date", "order_epoch": "floor(epoch(o_orderdate))::bigint", "ship_epoch": "floor(epoch(l_shipdate))::bigint", "div10": "p_partkey // 10", "string": "varchar"},
}

HOST = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"

VIEWS = {
    "urls": f"""select page_id as id, page_id % 3 as evidence_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) as scheme, {HOST} as domain,
        case page_id % 3 when 0 then 'history' when 1 then 'cache' else 'carved' end as discovered_by, page_id * 3600 % 1000003 as first_seen, page_id * 3600 % 1000003 + 60 * (page_id % 7) as last_seen,
        concat('p', cast(page_id % 4 as {{string}})) as source_path, case when page_id % 5 = 0 then null else page_id % 7 end as occurrences from pages""",
    "copies": "select * from urls union all select id + 1000000, evidence_id, replace(url, 'www.', ''), scheme, replace(domain, 'www.', ''), discovered_by, first_seen + 30, last_seen + 90, 'p9', occurrences from urls where id % 2 = 0",
    "associations": "select distinct o_orderpriority as tag, 'customer' as artifact_type, o_custkey as artifact_id from orders union all select distinct l_returnflag as tag, 'part' as artifact_type, l_partkey as artifact_id from lineitem",
    "matches": "select p_partkey as id, 'small' as list_name from part where p_size < 15 union all select p_partkey as id, 'even' as list_name from part where p_size % 2 = 0",
    "timeline": "select user_id as evidence_id, ts, {epoch} as epoch, event_type as kind, 'events' as ref_table, event_id as ref_id, case event_type when 'purchase' then 'high' when 'signup' then 'high' when 'error' then 'low' else 'medium' end as confidence from events",
    "files": "select doc_id as id, concat('/', source, '/', lang, '/f', cast(doc_id as {string}), case doc_id % 4 when 0 then '.jpg' when 1 then '.PDF' when 2 then '.zip' else '' end) as file_path, n_chars as size_bytes, md5(text) as md5, cast(null as {string}) as sha1, sha256(text) as sha256, doc_id % 9 = 0 as deleted, source from documents",
    "hashes": "select distinct 'toxic' as list_name, md5(text) as hash from documents join labels using (doc_id) where toxic = 1 union all select distinct 'poor' as list_name, sha256(text) as hash from documents join labels using (doc_id) where quality = 0",
    "nodes": "select p_partkey as id, {div10} as parent, p_partkey as name from part",
    "log": "select user_id as tab, event_id as seq, {epoch} as moment, case when event_type = 'view' then props end as url, case when event_type = 'click' then round(value, 3) end as title, event_type from events",
}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a view over given ones."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name].format(**SPELLINGS["spark"]).replace("sha256(text)", "sha2(text, 256)")
    needed = {t: frame(spark, sf_dir, t) for t in ("pages", "orders", "lineitem", "part", "events", "documents", "labels", "urls") if f"from {t}" in text or f"join {t}" in text}
    for table in needed:
        text = text.replace(f"from {table}", f"from {{{table}}}").replace(f"join {table}", f"join {{{table}}}")
    return spark.sql(text, **needed)


def with_views(sql: str, *names: str) -> str:
    """The DuckDB query with the views it needs before it."""
    names = ("urls", *names) if "copies" in names and "urls" not in names else names
    return "with " + ", ".join(f"{n} as ({VIEWS[n].format(**SPELLINGS['duckdb'])})" for n in names) + " " + sql
