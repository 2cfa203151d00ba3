"""Registered queries of the evidence operators, each with the DuckDB SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from casemill.functions import scalars as S
from casemill.operators import artifacts, filters, matching, records, similarity, tags, textmine, timeline, urls
from casemill.operators.filters import TableSpec
from casemill.plans.standins import frame, with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, run, sql: str | None = None, *views: str) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = with_views(sql, *views) if views else sql


def quoted(value) -> str:
    return "'" + value + "'" if isinstance(value, str) else str(value)


SQL_OPS = {"EQ": "{c} = {v}", "LIKE": "{c} ilike {v}", "GTE": "{c} >= {v}", "LTE": "{c} <= {v}"}
ALL_OPS = ("EQ", "LIKE", "GTE", "LTE", "IN")


def typed(name: str, table: str, columns: dict[str, str], conditions, order=(), limit=None, offset=0, kind=None, tag_names=None, prefilter="true") -> None:
    """A filter over one artifact table, given by its spec: columns, whitelisted conditions, order, paging, tags."""
    spec = TableSpec(name, {c: ALL_OPS for c in columns}, tuple(columns))

    def run(spark, sf_dir):
        df = frame(spark, sf_dir, table).where(prefilter).selectExpr(*[f"{e} as {c}" for c, e in columns.items()])
        df = filters.tagged(df, frame(spark, sf_dir, "associations"), kind, tag_names) if kind else df
        return filters.get_rows(df, spec, conditions, order, limit, offset)

    where = " and ".join(f"{c} in ({', '.join(map(quoted, v))})" if op == "IN" else SQL_OPS[op].format(c=c, v=quoted(v)) for c, op, v in conditions) or "true"
    if kind:
        own = f" and lower(tag) in ({', '.join(quoted(t.lower()) for t in tag_names)})" if tag_names else ""
        where += f" and id in (select artifact_id from associations where artifact_type = '{kind}'{own})"
    by = ", ".join(f"{c} {'asc nulls first' if way == 'ASC' else 'desc nulls last'}" for c, way in order)
    sql = f"select * from (select {', '.join(f'{e} as {c}' for c, e in columns.items())} from {table} where {prefilter}) where {where}" + (f" order by {by}" if by else "") + (f" limit {limit}" if limit else "") + (f" offset {offset}" if offset else "")
    register(name, run, sql, *[v for v in (table if table in ("urls", "files", "timeline") else None, "associations" if kind else None) if v])


CUSTOMER = {"id": "c_custkey", "name": "c_name", "nation": "c_nationkey", "balance": "c_acctbal", "browser": "c_mktsegment"}
PART = {"id": "p_partkey", "name": "p_name", "brand": "p_brand", "type": "p_type", "size": "p_size", "price": "p_retailprice"}
SUPPLIER = {"id": "s_suppkey", "name": "s_name", "nation": "s_nationkey", "balance": "s_acctbal"}
ORDERS = {"id": "o_orderkey", "owner": "o_custkey", "state": "o_orderstatus", "bytes": "o_totalprice", "priority": "o_orderpriority"}
LINES = {"id": "l_orderkey", "line": "l_linenumber", "flag": "l_returnflag", "status": "l_linestatus", "score": "l_quantity"}
EVENTS = {"id": "event_id", "owner": "user_id", "kind": "event_type", "value": "value", "extra": "props"}
DOCS = {"id": "doc_id", "lang": "lang", "source": "source", "size": "n_chars"}
TALK = {"id": "conv_id", "turn": "turn", "role": "role", "text": "text"}
PAGES = {"id": "page_id", "url": "url"}

for name, table, columns, conditions, extra in (
    ("S-1", "customer", CUSTOMER, [], {}),
    ("F-1", "part", PART, [("brand", "LIKE", "%1%"), ("size", "GTE", 5), ("size", "LTE", 40), ("type", "LIKE", "%a%")], {}),
    ("F-2", "orders", ORDERS, [("state", "IN", ("F", "O"))], {"order": [("bytes", "DESC"), ("id", "ASC")], "limit": 25, "offset": 10}),
    ("F-12", "orders", ORDERS, [("priority", "LIKE", "%high%")], {}),
    ("F-14", "files", {"id": "id", "file_path": "file_path", "source": "source"}, [("file_path", "LIKE", "%/en/%"), ("source", "LIKE", "%1%")], {}),
    ("F-15", "conversations", TALK, [("text", "LIKE", "%th%"), ("role", "EQ", "user")], {}),
    ("F-17a", "customer", CUSTOMER, [("browser", "EQ", "BUILDING"), ("name", "LIKE", "%7%")], {}),
    ("F-17b", "part", PART, [("brand", "LIKE", "brand%"), ("type", "LIKE", "%b%")], {}),
    ("F-17c", "orders", ORDERS, [("state", "EQ", "O")], {}),
    ("F-17d", "part", PART, [("size", "GTE", 20), ("brand", "LIKE", "%2%")], {}),
    ("F-17e", "conversations", TALK, [("role", "EQ", "assistant")], {}),
    ("F-17f", "supplier", SUPPLIER, [("balance", "GTE", 0)], {}),
    ("F-17g", "events", EVENTS, [("kind", "EQ", "signup")], {}),
    ("F-17h", "events", EVENTS, [("kind", "EQ", "view"), ("value", "GTE", 1)], {}),
    ("F-17i", "lineitem", LINES, [("flag", "EQ", "R"), ("score", "GTE", 45)], {}),
    ("F-17j", "events", EVENTS, [("kind", "IN", ("click", "purchase")), ("owner", "LTE", 8)], {}),
    ("F-17k", "documents", DOCS, [("source", "LIKE", "%2%")], {}),
    ("F-17l", "documents", DOCS, [("lang", "EQ", "de"), ("size", "GTE", 2000)], {}),
    ("F-17m", "conversations", TALK, [("turn", "GTE", 2)], {}),
    ("F-17n", "pages", PAGES, [("url", "LIKE", "%.example.net/%")], {}),
    ("F-17o", "customer", CUSTOMER, [("nation", "IN", (1, 4, 9))], {}),
    ("F-17p", "pages", PAGES, [("url", "LIKE", "https:%")], {}),
    ("F-17q", "lineitem", LINES, [("status", "EQ", "F"), ("line", "EQ", 1)], {}),
    ("F-17r", "events", EVENTS, [("owner", "EQ", 3)], {}),
    ("F-18", "orders", ORDERS, [("priority", "LIKE", "1%"), ("bytes", "GTE", 100000)], {"order": [("bytes", "DESC"), ("id", "ASC")], "limit": 40}),
    ("F-19", "files", {"id": "id", "deleted": "deleted", "source": "source", "size_bytes": "size_bytes"}, [("deleted", "EQ", True), ("size_bytes", "GTE", 100)], {}),
    ("F-20", "events", EVENTS, [("kind", "EQ", "error")], {}),
    ("F-27", "events", EVENTS, [("kind", "IN", ("error", "signup"))], {"order": [("id", "DESC")], "limit": 30}),
    ("K-2", "orders", ORDERS, [], {"order": [("bytes", "DESC"), ("id", "ASC")], "limit": 10}),
    ("F-10a", "customer", CUSTOMER, [], {"kind": "customer", "tag_names": ["1-URGENT"], "order": [("balance", "DESC")]}),
    ("F-10b", "customer", CUSTOMER, [("balance", "GTE", 100)], {"kind": "customer"}),
    ("F-10c", "customer", CUSTOMER, [("browser", "EQ", "MACHINERY")], {"kind": "customer", "tag_names": ["5-low"]}),
    ("F-10d", "part", PART, [], {"kind": "part", "tag_names": ["r"], "order": [("price", "DESC"), ("name", "ASC")]}),
    ("F-10e", "part", PART, [("price", "GTE", 1200)], {"kind": "part"}),
    ("F-10erows", "part", PART, [("brand", "LIKE", "%1%"), ("price", "GTE", 950)], {"kind": "part", "order": [("price", "DESC"), ("id", "ASC")]}),
    ("F-10f", "part", PART, [], {"kind": "part", "tag_names": ["A", "N"], "prefilter": "p_size < 10"}),
    ("F-10g", "part", PART, [("brand", "EQ", "Brand#11")], {"kind": "part"}),
    ("F-10h", "customer", CUSTOMER, [("name", "LIKE", "%9%"), ("browser", "IN", ("BUILDING", "FURNITURE"))], {"kind": "customer"}),
    ("F-10i", "customer", CUSTOMER, [], {"kind": "customer", "tag_names": ["2-HIGH", "3-MEDIUM"]}),
    ("F-10j", "customer", CUSTOMER, [("browser", "LIKE", "a%")], {"kind": "customer", "tag_names": ["4-not specified", "2-high"]}),
    ("F-10k", "part", PART, [("size", "LTE", 20)], {"kind": "part", "tag_names": ["N"]}),
    ("F-10l", "part", PART, [], {"kind": "part", "tag_names": ["R"], "order": [("id", "ASC")], "limit": 50}),
    ("F-10m", "part", PART, [("name", "LIKE", "%e%"), ("size", "GTE", 30)], {"kind": "part", "tag_names": ["A"]}),
):
    typed(name, table, columns, conditions, **extra)

# -- filters beyond one table
URL_COLUMNS = ("id", "url", "domain", "discovered_by")
register("F-3", lambda s, d: artifacts.browse_urls(frame(s, d, "urls"), "%example%", ("history", "cache")).select(*URL_COLUMNS, "seen"),
         "select id, url, domain, discovered_by, coalesce(first_seen, last_seen) seen from urls where domain ilike '%example%' and discovered_by in ('history', 'cache')", "urls")
register("F-4", lambda s, d: filters.matched(frame(s, d, "part").withColumnRenamed("p_partkey", "id"), frame(s, d, "matches"), "unmatched").select("id", "p_name"), "select p_partkey id, p_name from part where p_partkey not in (select id from matches)", "matches")
register("F-5", lambda s, d: filters.tagged(frame(s, d, "customer").withColumnRenamed("c_custkey", "id"), frame(s, d, "associations"), "customer", ["1-urgent"]).select("id", "c_name"),
         "select c_custkey id, c_name from customer where c_custkey in (select artifact_id from associations where artifact_type = 'customer' and lower(tag) = '1-urgent')", "associations")
register("F-6", lambda s, d: filters.matched(frame(s, d, "part").withColumnRenamed("p_partkey", "id"), frame(s, d, "matches"), "small").where(F.col("p_size").isNull() | (F.col("p_size") >= 5)).select("id", "p_size"),
         "select p_partkey id, p_size from part where p_partkey in (select id from matches where list_name = 'small') and (p_size is null or p_size >= 5)", "matches")
register("F-7", lambda s, d: artifacts.browse_files(frame(s, d, "files"), "%f1%", 500, deleted=False).select("id", "file_path", "size_bytes"), "select id, file_path, size_bytes from files where file_path ilike '%f1%' and size_bytes >= 500 and not deleted", "files")
register("F-8", lambda s, d: timeline.filtered(frame(s, d, "timeline"), ["click", "view"], ["medium"], "2024-01-05", "2024-01-09").select("ref_id", "epoch", "kind"),
         "select ref_id, epoch, kind from timeline where kind in ('click', 'view') and confidence = 'medium' and ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-10'", "timeline")
for name, both in (("F-9", True), ("F-9or", False)):
    register(name, lambda s, d, both=both: filters.tag_and_match(frame(s, d, "part").withColumnRenamed("p_partkey", "id"), frame(s, d, "associations"), "part", ["R", "A"], frame(s, d, "matches"), ["small"], both).select("id", "p_name"),
             f"select p_partkey id, p_name from part where p_partkey in (select artifact_id from associations where artifact_type = 'part' and tag in ('R', 'A')) {'and' if both else 'or'} p_partkey in (select id from matches where list_name = 'small')", "associations", "matches")
EXT = r"regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^/.][^/]*?([.][^/.]+)$', 1)"
register("F-13", lambda s, d: frame(s, d, "files").where(F.col("file_path").rlike(S.glob_regex("**/en/f*[05].jpg")) & ~F.coalesce("deleted", F.lit(False))).select("id", "file_path"), "select id, file_path from files where regexp_matches(lower(file_path), '/en/f[^/]*[05][.]jpg$') and not coalesce(deleted, false)", "files")
register("F-16", lambda s, d: frame(s, d, "lineitem").withColumn("visit", S.transition_core(F.col("l_linenumber"))).where(F.lower("visit") == "typed").groupBy("visit").agg(F.count("*").alias("n")), "select 'TYPED' visit, count(*) n from lineitem where l_linenumber = 1")
register("F-21", lambda s, d: artifacts.of_types(frame(s, d, "part"), "p_type", ("STANDARD", "SMALL", "LARGE")).select("p_partkey", "p_type"), "select p_partkey, p_type from part where regexp_matches(lower(p_type), '^(standard|small|large)')")
register("F-22", lambda s, d: timeline.at_least_confidence(frame(s, d, "timeline"), "medium", {"click": "browser", "view": "browser", "purchase": "downloads"}, "browser").select("ref_id", "kind"),
         "select ref_id, kind from timeline where confidence in ('high', 'medium') and kind in ('click', 'view')", "timeline")
register("F-24", lambda s, d: filters.distinct_values(frame(s, d, "urls"), "domain"), "select distinct domain from urls where domain is not null", "urls")
register("F-25", lambda s, d: artifacts.with_field(frame(s, d, "events"), "props", "page", "page").select("event_id", "page"), "select event_id, json_extract_string(props, '$.page') page from events where json_extract_string(props, '$.page') is not null")
register("F-25k", lambda s, d: artifacts.with_field(frame(s, d, "events"), "props", "k", "k").select("event_id", "k"), "select event_id, json_extract_string(props, '$.k') k from events where json_extract_string(props, '$.k') is not null")
register("F-26", lambda s, d: records.last_by(frame(s, d, "files").select("md5", "id", "source"), ["md5"], ["id"]), "select md5, max(id) id, arg_max(source, id) source from files group by md5", "files")
register("F-23", lambda s, d: artifacts.chosen(frame(s, d, "supplier"), "s_suppkey", [1, 2, 3, 5]).select("s_suppkey", "s_name"), "select s_suppkey, s_name from supplier where s_suppkey in (1, 2, 3, 5)")

# -- tags
ASSOCIATED = "associations"
register("J-1", lambda s, d: tags.tag_text(frame(s, d, ASSOCIATED), "customer"), "select artifact_id id, string_agg(distinct tag, ', ' order by tag) tags from associations where artifact_type = 'customer' group by 1", ASSOCIATED)
register("J-23", lambda s, d: tags.with_all(frame(s, d, ASSOCIATED), "customer", ["1-URGENT", "2-HIGH"]), "select artifact_id id from associations where artifact_type = 'customer' and tag in ('1-URGENT', '2-HIGH') group by 1 having count(distinct tag) = 2", ASSOCIATED)
register("J-23any", lambda s, d: tags.with_any(frame(s, d, ASSOCIATED), "part", ["R", "A"]), "select distinct artifact_id id from associations where artifact_type = 'part' and tag in ('R', 'A')", ASSOCIATED)
register("J-24", lambda s, d: tags.with_any(frame(s, d, ASSOCIATED), "customer"), "select distinct artifact_id id from associations where artifact_type = 'customer'", ASSOCIATED)
register("J-24types", lambda s, d: tags.by_type(frame(s, d, ASSOCIATED), "R"), "select artifact_type, count(distinct artifact_id) n, min(artifact_id) lowest, max(artifact_id) highest from associations where tag = 'R' group by 1", ASSOCIATED)
register("J-25", lambda s, d: tags.merge_tags(frame(s, d, ASSOCIATED), ["2-HIGH", "3-MEDIUM"], "1-URGENT"), "select distinct case when tag in ('2-HIGH', '3-MEDIUM') then '1-URGENT' else tag end tag, artifact_type, artifact_id from associations", ASSOCIATED)
register("J-26", lambda s, d: tags.inherited(frame(s, d, ASSOCIATED), frame(s, d, "orders").selectExpr("o_custkey as source_id", "o_orderkey as id"), "customer", "order"),
         "select distinct tag, 'order' artifact_type, o_orderkey artifact_id from orders join associations on artifact_type = 'customer' and artifact_id = o_custkey", ASSOCIATED)
register("J-27", lambda s, d: artifacts.with_auto_flag(frame(s, d, ASSOCIATED), "part", ("R",)), "select artifact_id, tag, case when tag = 'R' then 1 else 0 end auto from associations where artifact_type = 'part'", ASSOCIATED)
register("A-42", lambda s, d: tags.usage(frame(s, d, ASSOCIATED)), "select tag, count(*) n from associations group by tag", ASSOCIATED)
register("U-4", lambda s, d: tags.difference(frame(s, d, ASSOCIATED).where("tag = 'R'").select("artifact_id", F.lit("x").alias("tag")), frame(s, d, ASSOCIATED).where("tag = 'A'").select("artifact_id", F.lit("x").alias("tag"))),
         "select artifact_id, 'x' tag, 'add' change from associations where tag = 'R' and artifact_id not in (select artifact_id from associations where tag = 'A') union all select artifact_id, 'x', 'remove' from associations where tag = 'A' and artifact_id not in (select artifact_id from associations where tag = 'R')", ASSOCIATED)

# -- URLs
register("A-1", lambda s, d: filters.count_rows(frame(s, d, "part").selectExpr("p_size as size"), TableSpec("part", {"size": ("GTE",)}, ()), [("size", "GTE", 10)]), "select count(*) n from part where p_size >= 10")
register("A-2", lambda s, d: urls.url_stats(frame(s, d, "urls")), "select discovered_by, count(*) urls, count(distinct domain) domains from urls group by rollup (discovered_by)", "urls")
register("A-3", lambda s, d: urls.top_domains(frame(s, d, "urls"), 10), "select domain, count(*) urls, (select count(distinct domain) from urls) total_domains, (select count(distinct domain) from urls) > 10 truncated from urls where domain <> '' group by domain order by urls desc, domain limit 10", "urls")
KEY = ["url"]
register("A-4", lambda s, d: urls.duplicate_analysis(frame(s, d, "copies"), KEY), "select sum(n)::bigint total, count(*) distinct_urls, sum(n - 1)::bigint duplicates from (select count(*) n from copies group by url)", "copies")
register("A-4source", lambda s, d: urls.duplicate_analysis(frame(s, d, "copies"), ["url", "discovered_by", "first_seen"]), "select sum(n)::bigint total, count(*) distinct_urls, sum(n - 1)::bigint duplicates from (select count(*) n from copies group by url, discovered_by, first_seen)", "copies")
register("A-5", lambda s, d: urls.merge_duplicates(frame(s, d, "copies"), KEY), "select url, min(id) id, min(first_seen) first_seen, max(last_seen) last_seen, string_agg(distinct source_path, ',' order by source_path) source_path, sum(coalesce(occurrences, 1))::bigint occurrences from copies group by url", "copies")
register("A-5kept", lambda s, d: urls.kept_ids(frame(s, d, "copies"), KEY), "select id, min(id) over (partition by url) kept from copies", "copies")
register("A-6", lambda s, d: urls.url_summary(frame(s, d, "copies")), "select url, sum(coalesce(occurrences, 1))::bigint occurrences, min(first_seen) first_seen, max(last_seen) last_seen from copies group by url", "copies")
SITE = "array_to_string(string_split(lower(domain), '.')[-2:], '.')"
register("A-7", lambda s, d: urls.by_registered_domain(frame(s, d, "urls")), f"select {SITE} site, count(distinct url) urls, sum(coalesce(occurrences, 1))::bigint occurrences, min(first_seen) first_seen, max(last_seen) last_seen from urls group by 1", "urls")
register("A-8", lambda s, d: urls.by_plain_domain(frame(s, d, "urls")), "select regexp_replace(domain, '^[wW]{3}[.]', '') site, count(*) urls, min(url) lowest from urls group by 1", "urls")
VISITS = lambda s, d: frame(s, d, "timeline").join(frame(s, d, "urls").select("id", "domain", "url"), F.col("ref_id") % 97 == F.col("id")).selectExpr("domain", "url", "epoch as ts")
VISITED = "(select domain, url, epoch ts from timeline join urls on ref_id % 97 = id)"
register("A-9", lambda s, d: urls.domain_activity(VISITS(s, d), 5), f"select domain, count(*)::bigint events, count(distinct url) urls, min(ts) \"first\", max(ts) \"last\" from {VISITED} group by domain having count(*) >= 5", "urls", "timeline")
register("A-10", lambda s, d: urls.activity_summary(VISITS(s, d)), f"select count(*) events, count(distinct domain) domains, count(distinct url) urls, min(ts) \"first\", max(ts) \"last\" from {VISITED}", "urls", "timeline")
register("J-9", VISITS, f"select * from {VISITED}", "urls", "timeline")
register("J-10", lambda s, d: artifacts.events_of(frame(s, d, "timeline"), frame(s, d, "urls").where("discovered_by = 'cache'")).select("ref_id", "kind"), "select ref_id, kind from timeline where ref_id in (select id from urls where discovered_by = 'cache')", "urls", "timeline")
register("W-2", lambda s, d: urls.top_urls(frame(s, d, "copies"), 3),
         "select * from (select domain, url, hits, row_number() over (partition by domain order by hits desc, url)::int place, greatest(count(*) over (partition by domain) - 3, 0) hidden from (select domain, url, count(*) hits from copies group by 1, 2)) where place <= 3", "copies")
register("H-6", lambda s, d: frame(s, d, "pages").select("page_id", S.scheme(F.col("url")).alias("scheme"), S.domain(F.col("url")).alias("domain")), "select id page_id, scheme, domain from urls", "urls")
register("H-7", lambda s, d: frame(s, d, "urls").select("id", S.registered_domain(F.col("domain")).alias("site")), f"select id, {SITE} site from urls", "urls")
register("H-8", lambda s, d: frame(s, d, "urls").select("id", S.without_www(F.col("domain")).alias("site")), "select id, regexp_replace(domain, '^[wW]{3}[.]', '') site from urls", "urls")
register("H-9", lambda s, d: frame(s, d, "files").select("id", S.extension(F.col("file_path")).alias("ext"), S.file_type(S.extension(F.col("file_path"))).alias("type")),
         "select id, case id % 4 when 0 then '.jpg' when 1 then '.pdf' when 2 then '.zip' else '' end ext, case id % 4 when 0 then 'image' when 1 then 'document' when 2 then 'archive' else 'other' end \"type\" from files", "files")
register("H-10", lambda s, d: frame(s, d, "pages").select("page_id", S.extension(F.col("url")).alias("ext")), f"select page_id, lower({EXT}) ext from pages")
register("A-51", lambda s, d: frame(s, d, "pages").select(F.nullif(S.extension(F.col("url")), F.lit("")).alias("e")).agg(F.count("*").alias("total"), F.count("e").alias("filled"), (F.count("*") - F.count("e")).alias("pending")), f"select count(*) total, count(e) filled, count(*) - count(e) pending from (select nullif({EXT}, '') e from pages)")
register("H-11", lambda s, d: frame(s, d, "files").select("id", S.file_name(F.col("file_path")).alias("name"), S.inode(F.concat(F.col("id").cast("string"), F.lit("-128-1"))).alias("inode")), "select id, regexp_extract(file_path, '([^/]*)$', 1) name, id inode from files", "files")
register("H-13", lambda s, d: frame(s, d, "files").select("id", S.normal_path(F.concat(F.lit("C:\\"), F.col("file_path"))).alias("path")), "select id, file_path path from files", "files")

# -- timeline
register("A-11", lambda s, d: timeline.activity_stats(frame(s, d, "timeline")).select("total", F.unix_timestamp("earliest").alias("earliest"), F.unix_timestamp("latest").alias("latest"), "span_days", "per_day"),
         "select count(*) total, min(epoch) earliest, max(epoch) latest, (max(ts)::date - min(ts)::date + 1)::int span_days, round(count(*) / (max(ts)::date - min(ts)::date + 1), 1) per_day from timeline", "timeline")
register("A-12", lambda s, d: timeline.daily_counts(frame(s, d, "timeline"), 14), "select \"day\", n, greatest(10, floor(sqrt(n / max(n) over ()) * 100))::bigint height from (select ts::date \"day\", count(*) n from timeline group by 1 order by 1 limit 14)", "timeline")
QUERIES["W-10"], ORACLES["W-10"] = QUERIES["A-12"], ORACLES["A-12"]
register("A-13", lambda s, d: timeline.breakdown(frame(s, d, "timeline")), "select concat(upper(kind[1]), kind[2:]) kind, count(*) n from timeline group by 1", "timeline")
register("A-14", lambda s, d: timeline.stats(frame(s, d, "timeline")).select("kind", "confidence", "ref_table", "n", F.unix_timestamp("earliest").alias("earliest")), "select kind, confidence, ref_table, count(*) n, min(epoch) earliest from timeline group by grouping sets ((), (kind), (confidence), (ref_table))", "timeline")
register("A-15", lambda s, d: artifacts.distinct_rows(frame(s, d, "timeline"), "kind", "confidence"), "select distinct kind, confidence from timeline", "timeline")
GAPS = "select evidence_id, a \"start\", epoch \"end\", round((epoch - a) / 3600, 2) \"hours\" from (select evidence_id, epoch, lag(epoch) over (partition by evidence_id order by ts) a from timeline) where a is not null and round((epoch - a) / 3600, 2) >= 12 order by epoch desc, evidence_id limit 20"
register("W-1", lambda s, d: timeline.gaps(frame(s, d, "timeline").withColumn("ts", F.date_trunc("second", "ts")), 12, ["evidence_id"]).select("evidence_id", F.unix_timestamp("start").alias("start"), F.unix_timestamp("end").alias("end"), "hours"), GAPS, "timeline")
register("K-1", lambda s, d: timeline.in_order(frame(s, d, "timeline")).select("epoch", "ref_table", "ref_id"), "select epoch, ref_table, ref_id from timeline", "timeline")
#: For each source: a given table and what its columns stand for; times are epochs.
MAPPED = {
    "U-1a": ("events", {"ts_utc": "{epoch}", "browser": "event_type", "title": "case when event_id % 3 > 0 then 'page' end", "url": "cast(event_id as {string})"}, "event_id", "event_type || ' visit: ' || case when event_id % 3 > 0 then 'page' else event_id::varchar end"),
    "U-1b": ("events", {"first_seen_utc": "{epoch}", "url": "event_type", "discovered_by": "cast(user_id as {string})"}, "event_id", "'URL: ' || event_type || ' (via ' || user_id || ')'"),
    "U-1c": ("orders", {"ts_utc": "{order_epoch}", "filename": "o_orderpriority"}, "o_orderkey", "'Image: ' || o_orderpriority"),
    "U-1d": ("orders", {"ts_utc": "{order_epoch}", "filename": "o_orderpriority", "discovered_by": "o_orderstatus"}, "o_orderkey", "'Image: ' || o_orderpriority || ' (via ' || o_orderstatus || ')'"),
    "U-1e": ("events", {"detected_at_utc": "{epoch}", "type": "event_type", "name": "cast(user_id as {string})", "confidence": "case when user_id % 2 = 0 then '0.90' end"}, "event_id", "'OS: ' || event_type || ' - ' || user_id"),
    "U-1f": ("orders", {"creation_utc": "{order_epoch}", "last_access_utc": "case when o_orderkey % 2 = 0 then {order_epoch} + 60 end", "name": "o_orderstatus", "domain": "o_orderpriority"}, "o_orderkey", "'Cookie: ' || o_orderstatus || ' (' || o_orderpriority || ')'"),
    "U-1g": ("orders", {"date_added_utc": "{order_epoch}", "title": "cast(null as {string})", "url": "o_orderpriority"}, "o_orderkey", "'Bookmark: ' || o_orderpriority"),
    "U-1h": ("orders", {"start_time_utc": "{order_epoch}", "end_time_utc": "{order_epoch} + 5", "filename": "o_orderstatus"}, "o_orderkey", "'Download: ' || o_orderstatus"),
    "U-1i": ("events", {"last_accessed_utc": "{epoch}", "title": "event_type", "url": "event_type"}, "event_id", "'Tab: ' || event_type"),
    "U-1j": ("orders", {"date_created_utc": "{order_epoch}", "date_last_used_utc": "case when o_orderkey % 3 = 0 then {order_epoch} + 9 end", "name": "o_orderstatus"}, "o_orderkey", "'Autofill: ' || o_orderstatus"),
    "U-1k": ("orders", {"date_created_utc": "{order_epoch}", "date_last_used_utc": "{order_epoch} + 7", "origin_url": "o_orderstatus"}, "o_orderkey", "'Credential: ' || o_orderstatus"),
    "U-1l": ("events", {"last_played_utc": "{epoch}", "url": "event_type", "watch_time_seconds": "user_id"}, "event_id", "'Media: ' || event_type || ' (' || user_id || 's)'"),
    "U-1m": ("orders", {"sts_observed": "{order_epoch}", "expiry": "case when o_orderkey % 2 = 0 then 0 else {order_epoch} + 11 end", "decoded_host": "case when o_orderkey % 5 > 0 then o_orderstatus end", "hashed_host": "o_orderpriority"}, "o_orderkey", "'HSTS: ' || case when o_orderkey % 5 > 0 then o_orderstatus else o_orderpriority end"),
    "U-1n": ("orders", {"lnk_access_time": "{order_epoch}", "lnk_creation_time": "{order_epoch} + 3", "url": "case when o_orderkey % 2 = 0 then o_orderstatus end", "target_path": "case when o_orderkey % 3 = 0 then o_orderpriority end"}, "o_orderkey",
             "'Jump list: ' || case when o_orderkey % 2 = 0 then o_orderstatus when o_orderkey % 3 = 0 then o_orderpriority else 'unknown' end"),
}


def mapped_table(spark, sf_dir, name):
    from casemill.plans.standins import SPELLINGS

    table, columns, key, _ = MAPPED[name]
    source = timeline.SOURCES[name]
    exprs = [f"{e.format(**SPELLINGS['spark'])} as {c}" for c, e in columns.items()]
    df = frame(spark, sf_dir, table).selectExpr("1 as evidence_id", f"{key} as id", *exprs)
    return df if source.epoch else df.withColumns({c: F.timestamp_seconds(c) for c, _ in source.moments})


def mapped_sql(name):
    from casemill.plans.standins import SPELLINGS

    table, columns, key, text = MAPPED[name]
    source = timeline.SOURCES[name]
    confidence = f"coalesce({columns['confidence']}, 'low')" if source.own_confidence else quoted(source.confidence)
    parts = []
    for c, kind in source.moments:
        at = columns[c].format(**SPELLINGS["duckdb"])
        parts.append(f"select ({at})::bigint epoch, '{kind}' kind, '{source.table}' ref_table, {key} ref_id, {confidence} confidence, {text} note from {table} where ({at}) > 0")
    return " union all ".join(parts)


EVENT_COLUMNS = (F.unix_timestamp, ("kind", "ref_table", "ref_id", "confidence", "note"))


def event_rows(df):
    return df.select(F.unix_timestamp("ts").alias("epoch"), "kind", "ref_table", "ref_id", "confidence", "note")


for name in MAPPED:
    register(name, lambda s, d, name=name: event_rows(timeline.mapped(mapped_table(s, d, name), timeline.SOURCES[name])), mapped_sql(name))
register("U-1", lambda s, d: event_rows(timeline.fuse({timeline.SOURCES[n].table: mapped_table(s, d, n) for n in MAPPED if n != "U-1d"})), " union all ".join(f"({mapped_sql(n)})" for n in MAPPED if n != "U-1d"))

# -- matching
PATTERNS = [("tld", 0, "*.example.net/*"), ("tld", 1, ".example.com"), ("tld", 2, "example"), ("odd", 0, "ref=x"), ("odd", 1, "http://m.*"), ("odd", 2, "/en/1")]
RULES = [(n, i, p, matching.url_rule(p, False)) for n, i, p in PATTERNS]


def pattern_sql(column: str) -> str:
    out = []
    for name in ("odd", "tld"):
        whens = []
        for n, _, p in PATTERNS:
            if n == name:
                like = p.replace("%", "\\%").replace("*", "%") if "*" in p else f"%{p}%"
                whens.append(f"when {column} ilike '{like}' then '{p}'")
        out.append(f"select id, '{name}' list_name, case {' '.join(whens)} end pattern from urls")
    return "select * from (" + " union all ".join(out) + ") where pattern is not null"


register("J-2", lambda s, d: matching.match_patterns(frame(s, d, "urls"), "url", RULES), pattern_sql("url"), "urls")
QUERIES["W-3"], ORACLES["W-3"] = QUERIES["J-2"], ORACLES["J-2"]
register("A-41", lambda s, d: matching.match_stats(frame(s, d, "urls"), matching.match_patterns(frame(s, d, "urls"), "url", RULES)), f"select list_name, count(distinct id) matched, count(*) records, (select count(*) from urls) urls from ({pattern_sql('url')}) group by rollup (list_name)", "urls")
HASH_SQL = "select id, list_name, coalesce(max(case when hash = md5 then md5 end), max(case when hash = sha256 then sha256 end)) hash from files join hashes on hash = md5 or hash = sha256 group by 1, 2"
register("J-3", lambda s, d: matching.match_hashes(frame(s, d, "files"), frame(s, d, "hashes")), HASH_SQL, "files", "hashes")
register("J-5", lambda s, d: matching.match_hashes(frame(s, d, "files"), frame(s, d, "hashes"), ("md5", "sha256")), HASH_SQL, "files", "hashes")
FILE_RULES = [("images", 0, "*.jpg", S.fnmatch_regex("*.jpg")), ("images", 1, "*f1*", S.fnmatch_regex("*f1*")), ("papers", 0, "*/de/*.pdf", S.fnmatch_regex("*/de/*.pdf"))]
register("J-4", lambda s, d: matching.match_patterns(frame(s, d, "files"), "file_path", FILE_RULES),
         "select id, 'images' list_name, case when file_path ilike '%.jpg' then '*.jpg' else '*f1*' end pattern from files where file_path ilike '%.jpg' or file_path ilike '%f1%' union all select id, 'papers', '*/de/*.pdf' from files where file_path ilike '%/de/%.pdf'", "files")
register("J-6", lambda s, d: matching.lookup(frame(s, d, "files"), frame(s, d, "files").where("id % 5 = 0").selectExpr("id as entry_id", "source as list_name", "md5", "sha256")),
         "select f.id, arg_min(e.source, (e.source, e.id)) list_name, arg_min(e.id, (e.source, e.id)) entry_id from files f join files e on e.id % 5 = 0 and f.md5 = e.md5 group by f.id", "files")
register("J-7", lambda s, d: similarity.near(prints(s, d), prints(s, d).where("id = 0"), 22).select("id", "distance"), "select id, distance from (select a.id, (bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)))::int distance from prints a, (select * from prints where id = 0) b) where distance <= 22")
register("C-2", lambda s, d: prints(s, d).select("id", similarity.prefix("phash").alias("prefix")), "select id, (hi >> 16)::int prefix from prints")
PAIR_RADIUS = 10
register("J-7pairs", lambda s, d: similarity.near_pairs(prints(s, d), PAIR_RADIUS),
         "select distinct a.phash a, b.phash b, (bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)))::int distance from prints a join prints b on a.phash < b.phash and bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 10")
register("C-1", lambda s, d: similarity.leader_clusters(prints(s, d), PAIR_RADIUS))
register("K-4", lambda s, d: similarity.cluster_sizes(similarity.leader_clusters(prints(s, d), PAIR_RADIUS)))
WORD = "list_sum([case when embedding[{o} + i] > 0 then (1::bigint << (32 - i)) else 0 end for i in range(1, 33)])::bigint"
for name in ("J-7", "C-2", "J-7pairs"):
    halves = f"select vec_id id, {WORD.format(o=0)} hi, {WORD.format(o=32)} lo from embeddings"
    ORACLES[name] = f"with prints as (select *, lower(lpad(printf('%x', hi), 8, '0') || lpad(printf('%x', lo), 8, '0')) phash from ({halves})) {ORACLES[name]}"


def prints(spark, sf_dir):
    """64 signs of each embedding as a 16-digit hash."""
    digit = lambda k: F.aggregate(F.transform(F.slice("embedding", 4 * k + 1, 4), lambda x: (x > 0).cast("int")), F.lit(0), lambda a, b: a * 2 + b)
    return frame(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.concat(*[F.lower(F.hex(digit(k).cast("long"))) for k in range(16)]).alias("phash"))


# -- records, windows, rollups
register("J-8", lambda s, d: artifacts.url_downloads(frame(s, d, "urls"), frame(s, d, "copies").where("id >= 1000000").selectExpr("url", "id as download")),
         "select url, domain, min(u.id) id, count(distinct discovered_by) sources, count(download) downloads from urls u left join (select url, id download from copies where id >= 1000000) c using (url) group by 1, 2", "copies")
register("J-11", lambda s, d: artifacts.attached(frame(s, d, "orders"), frame(s, d, "customer"), "o_custkey", "c_custkey", {"c_name": "c_name"}).select("o_orderkey", "c_name"), "select o_orderkey, c_name from orders left join customer on o_custkey = c_custkey")
register("J-12", lambda s, d: artifacts.attached(frame(s, d, "lineitem"), frame(s, d, "part"), "l_partkey", "p_partkey", {"p_name": "p_name"}, "inner").select("l_orderkey", "l_linenumber", "p_name"), "select l_orderkey, l_linenumber, p_name from lineitem join part on l_partkey = p_partkey")
register("J-13", lambda s, d: artifacts.attached(frame(s, d, "conversations"), frame(s, d, "documents"), "conv_id", "doc_id", {"lang": "lang"}).select("conv_id", "turn", "lang"), "select conv_id, turn, lang from conversations left join documents on conv_id = doc_id")
register("J-14", lambda s, d: artifacts.referrers(frame(s, d, "nodes")), "select a.id, b.name referrer from nodes a join nodes b on a.parent = b.id", "nodes")
register("J-15", lambda s, d: artifacts.pivoted(frame(s, d, "lineitem"), "l_orderkey", "l_returnflag", ["A", "N", "R"]), "select l_orderkey, count_if(l_returnflag = 'A') A, count_if(l_returnflag = 'N') N, count_if(l_returnflag = 'R') R from lineitem group by 1")
register("J-16", lambda s, d: artifacts.chains(frame(s, d, "conversations"), "conv_id", "turn", "role"),
         "select conv_id, string_agg(role, '>' order by turn, role) chain, arg_max(role, (turn, role)) final from conversations group by 1")
register("J-17a", lambda s, d: artifacts.attached(artifacts.attached(frame(s, d, "customer"), frame(s, d, "nation"), "c_nationkey", "n_nationkey", {"n_name": "n_name", "n_regionkey": "n_regionkey"}), frame(s, d, "region"), "n_regionkey", "r_regionkey", {"r_name": "r_name"}).select("c_custkey", "n_name", "r_name"),
         "select c_custkey, n_name, r_name from customer left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey")
register("J-17d", lambda s, d: artifacts.only_known(frame(s, d, "supplier"), "s_nationkey", frame(s, d, "nation").where("n_regionkey = 1"), "n_nationkey").select("s_suppkey"), "select s_suppkey from supplier where s_nationkey in (select n_nationkey from nation where n_regionkey = 1)")
register("J-18", lambda s, d: records.paths(frame(s, d, "nodes")),
         with_views("select * from way", "nodes").replace("with nodes", "with recursive nodes").replace(" select * from way", ", way as (select id, name::varchar path from nodes where parent = id or parent not in (select id from nodes) union all select n.id, way.path || '/' || n.name from way join nodes n on n.parent = way.id and n.id <> way.id) select id, path from way"))
register("J-19", lambda s, d: records.last_by(frame(s, d, "files").select("md5", "id", "file_path"), ["md5"], ["id"]).join(frame(s, d, "hashes").where("list_name = 'toxic'").select(F.col("hash").alias("md5")), "md5"), "select md5, max(id) id, arg_max(file_path, id) file_path from files where md5 in (select hash from hashes where list_name = 'toxic') group by md5", "files", "hashes")
register("J-22", lambda s, d: artifacts.best_effort(frame(s, d, "urls"), {"domain": F.col("domain"), "name": S.file_name(F.col("url"))}), "select domain, regexp_extract(url, '([^/]*)$', 1) as name, min(id) id from urls group by 1, 2", "urls")
STATS = lambda table, by, aggs: (lambda s, d: records.grouped_stats(frame(s, d, table), by, aggs()))
for name, table, by, aggs, sql in (
    ("A-16", "events", ["event_type"], lambda: {"visits": F.count("*"), "users": F.count_distinct("user_id")}, "count(*) visits, count(distinct user_id) users"),
    ("A-17", "orders", ["o_orderstatus", "o_orderpriority"], lambda: {"n": F.count("*"), "bytes": F.sum(F.col("o_orderkey"))}, "count(*) n, sum(o_orderkey)::bigint bytes"),
    ("A-18", "customer", ["c_nationkey"], lambda: {"n": F.count("*"), "browsers": F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",")}, "count(*) n, string_agg(distinct c_mktsegment, ',' order by c_mktsegment) browsers"),
    ("A-19", "part", ["p_brand", "p_size"], lambda: {"n": F.count("*")}, "count(*) n"),
    ("A-20", "supplier", ["s_nationkey"], lambda: {"n": F.count("*")}, "count(*) n"),
    ("A-21", "urls", ["scheme", "domain"], lambda: {"n": F.count("*")}, "count(*) n"),
    ("A-22", "lineitem", ["l_returnflag", "l_linestatus"], lambda: {"n": F.count("*"), "first_lines": F.count_if(F.col("l_linenumber") == 1)}, "count(*) n, count_if(l_linenumber = 1)::bigint first_lines"),
    ("A-23", "events", ["event_type"], lambda: {"seconds": F.sum("user_id"), "views": F.count_if(F.col("event_type") == "view")}, "sum(user_id)::bigint \"seconds\", count_if(event_type = 'view')::bigint views"),
    ("A-24", "part", ["p_brand"], lambda: {"big": F.sum(F.when(F.col("p_size") > 25, 1).otherwise(0)), "types": F.count_distinct("p_type"), "most": F.max("p_size"), "average": F.round(F.avg("p_size"), 4)}, "sum(case when p_size > 25 then 1 else 0 end)::bigint big, count(distinct p_type) types, max(p_size) most, round(avg(p_size), 4) average"),
    ("A-25", "conversations", ["role"], lambda: {"n": F.count("*"), "talks": F.count_distinct("conv_id")}, "count(*) n, count(distinct conv_id) talks"),
    ("A-26", "customer", ["c_mktsegment"], lambda: {"n": F.count("*"), "nations": F.count_distinct("c_nationkey")}, "count(*) n, count(distinct c_nationkey) nations"),
    ("A-27", "documents", ["lang"], lambda: {"n": F.count("*"), "origins": F.count_distinct("source")}, "count(*) n, count(distinct source) origins"),
    ("A-29", "files", ["source", "deleted"], lambda: {"n": F.count("*"), "bytes": F.sum("size_bytes")}, "count(*) n, sum(size_bytes)::bigint bytes"),
    ("A-31", "files", ["source"], lambda: {"n": F.count("*"), "removed": F.count_if("deleted")}, "count(*) n, count_if(deleted)::bigint removed"),
    ("A-32", "orders", ["o_orderstatus"], lambda: {"n": F.count("*")}, "count(*) n"),
    ("A-33", "lineitem", ["l_linestatus", "l_linenumber"], lambda: {"n": F.count("*")}, "count(*) n"),
    ("A-35", "files", ["source"], lambda: {"n": F.count("*"), "bytes": F.sum("size_bytes"), "most": F.max("size_bytes"), "deleted_files": F.count_if("deleted")}, "count(*) n, sum(size_bytes)::bigint bytes, max(size_bytes) most, count_if(deleted)::bigint deleted_files"),
    ("A-37", "files", ["source"], lambda: {"n": F.count("*"), "contents": F.count_distinct("md5")}, "count(*) n, count(distinct md5) contents"),
):
    sets = ", ".join(["()", *[f"({c})" for c in by]])
    register(name, STATS(table, by, aggs), f"select {', '.join(by)}, {sql} from {table} group by grouping sets ({sets})", *([table] if table in ("urls", "files") else []))
register("A-28", lambda s, d: records.store_rollup({"local": frame(s, d, "lineitem").where("l_returnflag = 'N'").select("l_suppkey"), "session": frame(s, d, "lineitem").where("l_returnflag = 'A'").select("l_suppkey"), "indexed": frame(s, d, "lineitem").where("l_returnflag = 'R'").select("l_suppkey")}, "l_suppkey"),
         "select l_suppkey, count_if(l_returnflag = 'N')::bigint \"local\", count_if(l_returnflag = 'A')::bigint \"session\", count_if(l_returnflag = 'R')::bigint indexed, count(*) total, string_agg(distinct case l_returnflag when 'N' then 'local' when 'A' then 'session' else 'indexed' end, ',' order by case l_returnflag when 'N' then 'local' when 'A' then 'session' else 'indexed' end) stores from lineitem group by 1")
register("A-30", lambda s, d: artifacts.zero_filled(frame(s, d, "events"), "event_type", ["info", "view", "error", "fatal"], "severity"),
         "select severity, coalesce(n, 0) n from (values ('info'), ('view'), ('error'), ('fatal')) v(severity) left join (select event_type severity, count(*) n from events group by 1) using (severity)")
register("A-34", lambda s, d: artifacts.summary({"urls": (frame(s, d, "urls"), F.count("*")), "files": (frame(s, d, "files"), F.count("*")), "latest": (frame(s, d, "timeline"), F.max("epoch"))}), "select (select count(*) from urls) urls, (select count(*) from files) files, (select max(epoch) from timeline) latest", "urls", "files", "timeline")
register("A-36", lambda s, d: records.facets(frame(s, d, "files"), {"source": "source", "deleted": "deleted"}), "select 'source' facet, source \"value\", count(*) n from files group by 2 union all select 'deleted', deleted::varchar, count(*) from files group by 2", "files")
register("A-38", lambda s, d: artifacts.provenance(frame(s, d, "files"), "md5", "id", "source"), "select md5, arg_min(source, id) first_source, string_agg(distinct source, ',' order by source) sources, count(*) n from files group by 1", "files")
register("W-4", lambda s, d: records.first_by(frame(s, d, "files").select("md5", "id", "source"), ["md5"], ["id"]), "select md5, min(id) id, arg_min(source, id) source from files group by 1", "files")
register("S-14", lambda s, d: artifacts.content_addressed(frame(s, d, "files"), "md5", "id", ("file_path",)), "select md5, min(id) id, arg_min(file_path, id) file_path, count(*) discoveries from files group by 1", "files")
register("A-39", lambda s, d: artifacts.run_totals(frame(s, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).selectExpr("to_json(map(event_type, n)) as discovered"), ("discovered",)).select(F.col("item").alias("event_type"), "n"), "select event_type, count(*)::bigint n from events group by 1")
register("A-40", lambda s, d: records.count_check(frame(s, d, "lineitem"), frame(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(4).alias("expected")), "l_orderkey", 0.3), "select o_orderkey l_orderkey, 4 expected, coalesce(n, 0) n, abs(coalesce(n, 0) - 4) <= 1.2 \"within\" from orders left join (select l_orderkey, count(*) n from lineitem group by 1) on l_orderkey = o_orderkey")
register("A-43", lambda s, d: artifacts.counted(frame(s, d, "conversations"), "conv_id", "entries"), "select conv_id, count(*) entries from conversations group by 1")
register("A-44", lambda s, d: records.roots(frame(s, d, "orders").selectExpr("o_custkey as root", "o_orderpriority as signal"), [1, 4, 7], 3), "select o_custkey root, string_agg(distinct o_orderpriority, ',' order by o_orderpriority) signals, count(distinct o_orderpriority) n from orders where o_custkey not in (1, 4, 7) group by 1 having count(distinct o_orderpriority) >= 3")
register("A-47", lambda s, d: artifacts.autostarts(frame(s, d, "part"), "p_brand", "p_type", "p_size"), "select lower(p_brand) \"name\", lower(p_type) command, string_agg(distinct p_size::varchar, '+' order by p_size::varchar) scopes from part group by 1, 2")
register("A-50", lambda s, d: records.drift(frame(s, d, "events"), "event_type", ["click", "view"]), "select event_type \"value\", count(*) n from events where event_type not in ('click', 'view') group by 1")
register("A-52", lambda s, d: records.store_rollup({"orders": frame(s, d, "orders").selectExpr("o_custkey as who"), "customers": frame(s, d, "customer").selectExpr("c_custkey as who")}, "who"), "select who, count_if(k = 'orders')::bigint orders, count_if(k = 'customers')::bigint customers, count(*) total, string_agg(distinct k, ',' order by k) stores from (select o_custkey who, 'orders' k from orders union all select c_custkey, 'customers' from customer) group by 1")
register("W-5", lambda s, d: records.last_by(frame(s, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"]), "select user_id, max(event_id) event_id, arg_max(event_type, event_id) event_type from events group by 1")
register("W-6", lambda s, d: records.last_by(frame(s, d, "events").where("event_type = 'purchase'").select("user_id", "event_id"), ["user_id"], ["event_id"]), "select user_id, max(event_id) event_id from events where event_type = 'purchase' group by 1")
register("W-7", lambda s, d: records.replayed(frame(s, d, "log"), "tab", "moment", ["url", "title"], F.col("event_type") == "error"),
         "select tab, arg_max(url, (moment, seq)) filter (where url is not null) url, arg_max(title, (moment, seq)) filter (where title is not null) title, count(*) commands from log left join (select tab, max((moment, seq)) c from log where event_type = 'error' group by 1) using (tab) where c is null or (moment, seq) > c group by 1", "log")
register("W-8", lambda s, d: artifacts.values_in_order(frame(s, d, "files"), "md5", "id", "source", "sources").select("md5", "id", F.size("sources").alias("n")), "select md5, min(id) id, count(distinct source)::int n from files group by 1", "files")
register("W-9", lambda s, d: artifacts.first_rows(frame(s, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber"), "l_suppkey", ["l_orderkey", "l_linenumber"], 3), "select * from (select l_suppkey, l_orderkey, l_linenumber, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber)::int place from lineitem) where place <= 3")
register("W-11", lambda s, d: artifacts.most_used(frame(s, d, "lineitem"), "l_partkey", "l_suppkey"), "select l_partkey, arg_max(l_suppkey, (uses, l_suppkey)) most from (select l_partkey, l_suppkey, count(*) uses from lineitem group by 1, 2) group by 1")
register("W-12", lambda s, d: records.first_by(frame(s, d, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"]), "select conv_id, min(turn) turn, arg_min(role, turn) role from conversations group by 1")
register("S-11", lambda s, d: records.appended(frame(s, d, "customer").where("c_custkey % 2 = 0").select("c_custkey", "c_name"), frame(s, d, "customer").selectExpr("c_custkey", "upper(c_name) as c_name"), ["c_custkey"], "IGNORE"), "select c_custkey, case when c_custkey % 2 = 0 then c_name else upper(c_name) end c_name from customer")
register("S-13", lambda s, d: records.upserted(frame(s, d, "customer").where("c_custkey % 2 = 0").select("c_custkey", "c_name", "c_mktsegment"), frame(s, d, "customer").where("c_custkey % 3 = 0").selectExpr("c_custkey", "lower(c_name) as c_name", "'new' as c_mktsegment"), ["c_custkey"], ["c_mktsegment"]),
         "select c_custkey, case when c_custkey % 3 = 0 then lower(c_name) else c_name end c_name, case when c_custkey % 2 = 0 then c_mktsegment else 'new' end c_mktsegment from customer where c_custkey % 2 = 0 or c_custkey % 3 = 0")
register("U-2", lambda s, d: posted(s, d).select("url", "discovered_by"), "select url, discovered_by from urls union all select url, 'copy' from copies where id >= 1000000", "copies")
register("U-5", lambda s, d: artifacts.merged([frame(s, d, "files").where("source like '%1%'"), frame(s, d, "files").where("deleted")], ["id"]), "select id from files where source like '%1%' union select id from files where deleted", "files")
register("K-3", lambda s, d: artifacts.sorted_by(frame(s, d, "part").select("p_partkey", F.lower("p_name").alias("sort_name")), [("sort_name", "ASC", "LAST"), ("p_partkey", "ASC", "FIRST")], 30), "select p_partkey, lower(p_name) sort_name from part order by 2 nulls last, 1 limit 30")



def posted(s, d):
    """The URLs of two artifact tables as the common table gets them."""
    copies = frame(s, d, "copies").where("id >= 1000000")
    return artifacts.cross_posted([(frame(s, d, "urls"), F.col("discovered_by"), F.col("first_seen"), F.col("last_seen")), (copies, "copy", F.col("first_seen"), F.col("last_seen"))])


# -- text
TEXT_URL = "https?://[^ \\t\\n\\r\"''<>\\]})\\\\,]+"
register("X-4", lambda s, d: frame(s, d, "documents").select("doc_id", F.explode(textmine.emails_in(F.col("text"))).alias("email")), None)
register("X-4n", lambda s, d: frame(s, d, "documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit(f"({textmine.EMAIL})"), F.lit(1))).alias("n")), "select doc_id, len(regexp_extract_all(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+[.][a-zA-Z]{2,}'))::int n from documents")
register("X-3", lambda s, d: frame(s, d, "pages").select("page_id", F.explode(textmine.urls_in(F.concat_ws(" ", "url", "html"))).alias("found")), None)
register("X-5", lambda s, d: frame(s, d, "events").select("event_id", textmine.token_type(F.lit("session"), F.col("props")).alias("token")), "select event_id, case when length(props) >= 20 then 'session' end token from events")
register("X-1", lambda s, d: textmine.analysed(frame(s, d, "conversations").selectExpr("cast(conv_id as string) as origin", "role as key", "text as value")), None)
register("X-2", lambda s, d: textmine.json_fields(frame(s, d, "events").withColumnRenamed("event_id", "id"), "props"), None)
register("X-7", lambda s, d: textmine.tokens(frame(s, d, "events").selectExpr("cast(user_id as string) as origin", "'session' as key", "props as value")).select("token_hash"), "select distinct sha256(props) token_hash from events where length(props) >= 20")
register("X-8", lambda s, d: textmine.url_times(frame(s, d, "pages").selectExpr("page_id as id", "html as text")).withColumnRenamed("id", "page_id"), None)
register("X-9", lambda s, d: frame(s, d, "pages").select("page_id", textmine.normal_feature(F.lit("domain"), F.col("url")).alias("feature")), "select page_id, regexp_replace(trim(url), '^(http|https|ftp)://', '') feature from pages")
register("X-10", lambda s, d: frame(s, d, "pages").select("page_id", textmine.is_noise(F.col("url")).alias("noise")), "select page_id, len(list_distinct(string_split(url, ''))) < 10 or length(url) <= 10 or length(url) >= 2048 noise from pages")
LINES_OF = lambda s, d: frame(s, d, "documents").select(F.col("doc_id").alias("path"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
register("N-12", lambda s, d: records.log_entries(LINES_OF(s, d), F.col("text").rlike("^[A-Z]")).select("path", "entry", "lines", F.md5("text").alias("digest")),
         "select path, entry, count(*) \"lines\", md5(string_agg(text, chr(10) order by line)) digest from (select *, sum(case when regexp_matches(text, '^[A-Z]') then 1 else 0 end) over (partition by path order by line)::bigint entry from (select doc_id path, unnest(string_split(text, chr(10))) text, generate_subscripts(string_split(text, chr(10)), 1) line from documents)) where entry > 0 group by 1, 2")
register("N-6", lambda s, d: frame(s, d, "conversations").groupBy("conv_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("turn", "role")))).alias("doc")).select("conv_id", F.explode(F.from_json("doc", "array<struct<turn:long,role:string>>")).alias("e")).select("conv_id", "e.turn", "e.role"), "select conv_id, turn, role from conversations")

# -- scalars
TIMES = {
    "H-1": (lambda x: S.from_webkit(x), "(o_orderkey + 13000000000) * 1000000", "o_orderkey + 13000000000 - 11644473600"),
    "H-2": (lambda x: S.from_prtime(x), "(o_orderkey + 1500000000) * 1000000", "o_orderkey + 1500000000"),
    "H-2ms": (lambda x: S.from_millis(x), "(o_orderkey + 1500000000) * 1000", "o_orderkey + 1500000000"),
    "H-2cocoa": (lambda x: S.from_cocoa(x), "o_orderkey - 100", "o_orderkey - 100 + 978307200"),
    "H-3": (lambda x: S.from_filetime(x), "(o_orderkey + 13000000000) * 10000000", "o_orderkey + 13000000000 - 11644473600"),
    "H-3ole": (lambda x: S.from_ole_days(x), "o_orderkey % 9000 + 30000", "(o_orderkey % 9000 + 30000 - 25569) * 86400"),
    "H-3auto": (lambda x: S.detected(x), "case o_orderkey % 3 when 0 then o_orderkey + 1500000000 when 1 then (o_orderkey + 1500000000) * 1000 else (o_orderkey + 13000000000) * 1000000 end", "case o_orderkey % 3 when 2 then o_orderkey + 13000000000 - 11644473600 else o_orderkey + 1500000000 end"),
}
for name, (function, value, seconds) in TIMES.items():
    register(name, lambda s, d, function=function, value=value: frame(s, d, "orders").select("o_orderkey", F.unix_timestamp(function(F.expr(value))).alias("epoch")), f"select o_orderkey, ({seconds})::bigint epoch from orders")
register("H-4", lambda s, d: frame(s, d, "orders").select("o_orderkey", F.unix_timestamp(S.parsed(F.date_format("o_orderdate", "dd.MM.yyyy HH:mm:ss"))).alias("epoch")), "select o_orderkey, floor(epoch(o_orderdate))::bigint epoch from orders")
register("H-5", lambda s, d: frame(s, d, "documents").select("doc_id", S.size_text(F.col("n_chars")).alias("size")), "select doc_id, case when n_chars >= 1048576 then printf('%.1f MB', n_chars / 1048576) when n_chars >= 1024 then printf('%.1f KB', n_chars / 1024) else n_chars || ' B' end size from documents")
register("H-12", lambda s, d: frame(s, d, "files").select("id", F.col("file_path").rlike(S.glob_regex("/*/en/*.jpg")).alias("hit")), "select id, regexp_matches(file_path, '^/[^/]*/en/[^/]*[.]jpg$') hit from files", "files")
register("H-21", lambda s, d: frame(s, d, "lineitem").select("l_orderkey", "l_linenumber", S.transition(F.col("l_linenumber").cast("long").bitwiseOR(F.lit(0x01000000))).alias("visit")),
         "select l_orderkey, l_linenumber, case l_linenumber when 1 then 'TYPED' when 2 then 'AUTO_BOOKMARK' when 3 then 'AUTO_SUBFRAME' when 4 then 'MANUAL_SUBFRAME' when 5 then 'GENERATED' when 6 then 'AUTO_TOPLEVEL' when 7 then 'FORM_SUBMIT' end || '|FROM_ADDRESS_BAR' visit from lineitem")
register("H-24", lambda s, d: frame(s, d, "orders").select("o_orderkey", S.note("{a} of {b}", {"a": F.col("o_orderstatus"), "b": F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority"))}).alias("note")), "select o_orderkey, o_orderstatus || ' of ' || case when o_orderkey % 2 = 0 then o_orderpriority else '{b}' end note from orders")


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
