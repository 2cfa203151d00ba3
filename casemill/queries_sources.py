"""Registered queries of sources, sinks, streams, long lists, JSON walks and labels, each with the DuckDB SQL of the same rows.

Files that a source reads are written from the given tables by Spark, into the shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from casemill.functions import codes
from casemill.functions import scalars as S
from casemill.operators import artifacts, filters, matching, similarity, system, tags, textmine, urls
from casemill.operators.filters import TableSpec
from casemill.plans.standins import frame, with_views
from casemill.queries import ALL_OPS, RULES, pattern_sql, posted
from casemill.sources import readers
from casemill.streaming import feeds
from casemill.tables import new_folder

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, run, sql: str | None = None, *views: str) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = with_views(sql, *views) if views else sql


def written(lines, name: str) -> str:
    """A folder of text files with the column value of lines."""
    path = new_folder(lines.sparkSession, name)
    lines.select("value").write.text(path)
    return path


# -- long pattern lists
LANGS = "select distinct lang, doc_id % 2500 k from documents"


def long_rules(s, d):
    """Two lists of up to 10,000 patterns each, read from the documents table: paths, and wildcards over hosts and paths."""
    rows = frame(s, d, "documents").where("lang is not null").select("lang", (F.col("doc_id") % 2500).alias("k")).distinct().collect()  # a reference list, 10,000 entries at most
    plain = [("paths", r.k * 10 + ord(r.lang[0]), f"/{r.lang}/{r.k}") for r in rows]
    wild = [("hosts", r.k * 10 + ord(r.lang[0]), f"*EXAMPLE.*/{r.lang}/{r.k}*") for r in rows]
    return [(n, i, p, matching.url_rule(p, False)) for n, i, p in plain + wild]


LONG = f"with docs as ({LANGS}), rules as (select k * 10 + ascii(lang) idx, '/' || lang || '/' || k path, '*EXAMPLE.*/' || lang || '/' || k || '*' wild, '%example.%/' || lang || '/' || k || '%' form from docs)"
register("J-2many", lambda s, d: matching.match_patterns(frame(s, d, "urls"), "url", long_rules(s, d)),
         f"{LONG} select page_id id, 'paths' list_name, arg_min(path, idx) pattern from pages join rules on contains(lower(url), lower(path)) group by 1 union all select page_id, 'hosts', arg_min(wild, idx) from pages join rules on url ilike form group by 1")
register("A-41many", lambda s, d: matching.match_stats(frame(s, d, "urls"), matching.match_patterns(frame(s, d, "urls"), "url", long_rules(s, d))),
         f"{LONG}, found as (select distinct page_id id, 'paths' list_name from pages join rules on contains(lower(url), lower(path)) union all select distinct page_id, 'hosts' from pages join rules on url ilike form) select list_name, count(distinct id) matched, count(*) records, (select count(*) from pages) urls from found group by rollup (list_name)")

# -- timeline rows and what they refer to: every page is reached
SPREAD = "(select epoch, kind, case when ref_id % 3 = 0 then 'files' else 'urls' end ref_table, ref_id // 2 ref_id from timeline)"


def spread(s, d):
    return frame(s, d, "timeline").select("epoch", "kind", F.when(F.col("ref_id") % 3 == 0, "files").otherwise("urls").alias("ref_table"), F.floor(F.col("ref_id") / 2).alias("ref_id"))


def seen(s, d):
    sources = {"urls": frame(s, d, "urls").select("id", "url", "domain"), "files": frame(s, d, "files").select("id", F.col("file_path").alias("url"), F.col("source").alias("domain"))}
    return artifacts.with_source_rows(spread(s, d), sources, ("url", "domain"))


JOINED = f"(select t.*, case t.ref_table when 'urls' then u.url else f.file_path end url, case t.ref_table when 'urls' then u.domain else f.source end domain, epoch ts from {SPREAD} t left join urls u on t.ref_table = 'urls' and t.ref_id = u.id left join files f on t.ref_table = 'files' and t.ref_id = f.id)"
VISITED = ("timeline", "urls", "files")
register("J-9all", lambda s, d: seen(s, d).select("ref_table", "ref_id", "kind", "epoch", "url"), f"select ref_table, ref_id, kind, epoch, url from {JOINED}", *VISITED)
register("A-9all", lambda s, d: urls.domain_activity(seen(s, d).where("domain is not null").withColumnRenamed("epoch", "ts"), 3), f"select domain, count(*)::bigint events, count(distinct url) urls, min(ts) \"first\", max(ts) \"last\" from {JOINED} where domain is not null group by domain having count(*) >= 3", *VISITED)
register("A-10all", lambda s, d: urls.activity_summary(seen(s, d).withColumnRenamed("epoch", "ts")), f"select count(*) events, count(distinct domain) domains, count(distinct url) urls, min(ts) \"first\", max(ts) \"last\" from {JOINED}", *VISITED)

# -- parameters that give rows
register("F-17brows", lambda s, d: filters.get_rows(frame(s, d, "part").selectExpr("p_partkey as id", "p_brand as brand", "p_type as type"), TableSpec("part", {"brand": ALL_OPS, "type": ALL_OPS}, ("id",)), [("brand", "LIKE", "brand%"), ("type", "LIKE", "%a%")]), "select p_partkey id, p_brand brand, p_type \"type\" from part where p_brand ilike 'brand%' and p_type ilike '%a%'")
MOST = "select p_partkey, l_returnflag, count(*) n from part join lineitem on l_partkey = p_partkey group by 1, 2"
FEW = lambda s, d, flag: frame(s, d, "lineitem").where(F.col("l_returnflag") == flag).groupBy("l_partkey").agg(F.count("*").alias("n")).where("n > 9").select(F.col("l_partkey").alias("artifact_id"), F.lit("x").alias("tag"))
register("U-4rows", lambda s, d: tags.difference(FEW(s, d, "R"), FEW(s, d, "A")),
         f"with m as ({MOST} having count(*) > 9), r as (select p_partkey id from m where l_returnflag = 'R'), a as (select p_partkey id from m where l_returnflag = 'A') select id artifact_id, 'x' tag, 'add' change from r where id not in (select id from a) union all select id, 'x', 'remove' from a where id not in (select id from r)")

# -- fingerprints with planted near ones: each order's key, hashed, and a neighbour of every fifth
PLANTED = """orders_near as (select o_orderkey id, md5(cast(o_custkey as varchar))[:16] base, o_orderkey % 5 k from orders),
    prints as (select id, case when k = 0 then base[:15] || substr('0123456789abcdef', ((strpos('0123456789abcdef', base[16:16]) - 1) ^ 1) + 1, 1) else base end phash from orders_near)"""
PLANTED = PLANTED.replace("((strpos('0123456789abcdef', base[16:16]) - 1) ^ 1) + 1", "xor(strpos('0123456789abcdef', base[16:16]) - 1, 1)::bigint + 1")


def planted(s, d):
    base = F.substring(F.md5(F.col("o_custkey").cast("string").cast("binary")), 1, 16)
    last = F.lower(F.hex(F.conv(F.substring(base, 16, 1), 16, 10).cast("long").bitwiseXOR(F.lit(1))))
    return frame(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.substring(base, 1, 15), last)).otherwise(base).alias("phash"))


# a group is a customer's hash and its neighbour, so the smaller of those that occur leads
LEADERS = f"with {PLANTED}, named as (select p.id, p.phash, min(p.phash) over (partition by o_custkey) leader from prints p join orders on o_orderkey = p.id)"
register("C-1near", lambda s, d: similarity.leader_clusters(planted(s, d), 4).select("id", "phash", "leader", "distance"), f"{LEADERS} select id, phash, leader, case when phash = leader then 0 else 1 end distance from named")
register("K-4near", lambda s, d: similarity.cluster_sizes(similarity.leader_clusters(planted(s, d), 4)), f"{LEADERS} select leader, count(*) n, max(case when phash = leader then 0 else 1 end) widest from named group by 1")
register("J-7near", lambda s, d: similarity.near_pairs(planted(s, d), 4), f"with {PLANTED} select distinct least(a.phash, b.phash) a, greatest(a.phash, b.phash) b, 1 distance from prints a join prints b on a.phash[:15] = b.phash[:15] and a.phash < b.phash")

# -- texts and stored values
EMAIL_SQL = "[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+[.][a-zA-Z]{2,}"
NOT_SQL = " and ".join(f"not contains(lower(email), '{v}')" for v in textmine.NOT_EMAILS)
register("X-4all", lambda s, d: frame(s, d, "documents").select("doc_id", F.explode(textmine.emails_in(F.col("text"))).alias("email")), f"select doc_id, email from (select doc_id, unnest(regexp_extract_all(text, '{EMAIL_SQL}')) email from documents) where {NOT_SQL} and length(regexp_extract(email, '[^@]*$')) >= 4")
URL_SQL = "https?://[^\\s\"''<>\\]})\\\\,]+"
register("X-3all", lambda s, d: frame(s, d, "pages").select("page_id", F.explode(textmine.urls_in(F.concat_ws(" ", "url", "html"))).alias("found")), f"select page_id, rtrim(u, '.,;:!?') found from (select page_id, unnest(regexp_extract_all(concat_ws(' ', url, html), '{URL_SQL}', 0, 'i')) u from pages)")
STORED = lambda s, d: frame(s, d, "documents").selectExpr("cast(doc_id as string) as origin", "concat('session_', lang) as key", "text as value")
register("X-5all", lambda s, d: STORED(s, d).select("origin", textmine.token_type(F.col("key"), F.col("value")).alias("token")), "select doc_id::varchar origin, case when length(text) >= 20 then case when regexp_matches(text, 'eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]*') then 'jwt' when regexp_matches(text, 'Ew[AB][A-Za-z0-9+/=_-]{50,}') then 'ms_oauth' when lang is not null then 'session' when regexp_matches(text, '^[A-Za-z0-9_-]{64,}$') then 'unknown' end end token from documents")
register("X-7all", lambda s, d: textmine.tokens(STORED(s, d)).select("token_hash", "origin"), "select sha256(text) token_hash, min(doc_id::varchar) origin from documents where length(text) >= 20 and lang is not null group by 1")
FOUND = f"select doc_id, 'url' kind, rtrim(u, '.,;:!?') found from (select doc_id, unnest(regexp_extract_all(text, '{URL_SQL}', 0, 'i')) u from documents)"
register("X-1all", lambda s, d: textmine.analysed(STORED(s, d)).select("origin", "kind", F.md5(F.col("found").cast("binary")).alias("digest")),
         f"select doc_id::varchar origin, kind, md5(found) digest from ({FOUND} union all select doc_id, 'email', email from (select doc_id, unnest(regexp_extract_all(text, '{EMAIL_SQL}')) email from documents) where {NOT_SQL} and length(regexp_extract(email, '[^@]*$')) >= 4 union all select doc_id, 'token', text from documents where length(text) >= 20 and lang is not null)")
SEEN = "concat(repeat('pad ', o_orderkey % 80), case o_orderkey % 3 when 0 then '1700000000123 ' when 1 then '1700000001 ' else '2024-05-06T07:08:09 ' end, repeat('.', o_orderkey % 7 * 60), ' http://x.example/', o_orderkey)"
register("X-8near", lambda s, d: textmine.url_times(frame(s, d, "orders").selectExpr("o_orderkey as id", f"{SEEN} as text")),
         f"select id, strpos(text, 'http')::int at_, case when strpos(text, 'http') - 1 - p <= 200 then found end found from (select o_orderkey id, {SEEN} as text, o_orderkey % 80 * 4 p, case o_orderkey % 3 when 0 then '1700000000123' when 1 then '1700000001' else '2024-05-06T07:08:09' end found from orders)".replace("at_", '\"at\"'))
JSON = "concat('{\"a\":{\"b\":{\"c\":{\"d\":', o_orderkey, ',\"time\":', o_orderkey + 5, ',\"userId\":\"u', o_custkey, '\"}}},\"list\":[', o_custkey, ',{\"url\":\"http://x/', o_orderkey, '\"},[]],\"n\":null}')"
register("X-2deep", lambda s, d: textmine.json_fields(frame(s, d, "orders").selectExpr("o_orderkey as id", f"{JSON} as doc"), "doc"), """
    select o_orderkey id, 'a.b.c.d' path, o_orderkey::varchar "value", null::varchar kind, (o_orderkey + 5)::varchar "at" from orders union all select o_orderkey, 'a.b.c.time', (o_orderkey + 5)::varchar, null, (o_orderkey + 5)::varchar from orders
    union all select o_orderkey, 'a.b.c.userId', 'u' || o_custkey, 'user_id', (o_orderkey + 5)::varchar from orders union all select o_orderkey, 'list[0]', o_custkey::varchar, null, null from orders
    union all select o_orderkey, 'list[1].url', 'http://x/' || o_orderkey, 'url', null from orders union all select o_orderkey, 'n', null, null, null from orders""")  # fmt: skip
CLAIMS = "concat('{\"iss\":\"me\",\"sub\":\"', o_custkey, '\",\"iat\":', o_orderkey, ',\"exp\":', o_orderkey + 60, '}')"
register("X-6", lambda s, d: frame(s, d, "orders").select("o_orderkey", textmine.jwt_claims(F.concat(F.lit("eyJhbGciOiJub25lIn0."), F.rtrim(F.translate(F.base64(F.expr(CLAIMS).cast("binary")), "+/", "-_"), F.lit("=")), F.lit(".x"))).alias("c")).select("o_orderkey", "c.iss", "c.sub", "c.iat", "c.exp", textmine.expired(F.col("c"), 1000).alias("expired")),
         "select o_orderkey, 'me' iss, o_custkey::varchar sub, o_orderkey iat, o_orderkey + 60 \"exp\", o_orderkey + 60 < 1000 expired from orders")
HEADS = ("FFD8FFE0", "89504E470D0A1A0A00", "474946383961", "424D00", "0000")
register("H-15", lambda s, d: frame(s, d, "orders").select("o_orderkey", S.image_type(F.concat(F.unhex(F.get(F.array(*map(F.lit, HEADS)), F.pmod("o_orderkey", F.lit(len(HEADS))).cast("int"))), F.col("o_orderpriority").cast("binary"))).alias("image")),
         "select o_orderkey, case o_orderkey % 5 when 0 then 'jpeg' when 1 then 'png' when 2 then 'gif' when 3 then 'bmp' end image from orders")

# -- labels and texts
CODE = "o_orderkey % 90 - 3"


def label_sql(domain: str) -> str:
    whens = " ".join(f"when {k} then '{v}'" for k, v in codes.LABELS[domain].items())
    return f"case when o_orderkey % 7 = 0 then {repr(codes.NULLS[domain]) if domain in codes.NULLS else 'null'} else case {CODE} {whens} else '{codes.PREFIXES[domain]}' || ({CODE}) end end label"


for name, domain in (("H-22i", "block_list_type"), ("H-22j", "profile_token_type")):
    register(name, lambda s, d, domain=domain: frame(s, d, "orders").select("o_orderkey", codes.label(domain, F.expr(f"case when o_orderkey % 7 > 0 then {CODE} end")).alias("label")), f"select o_orderkey, {label_sql(domain)} from orders")
register("H-22hflags", lambda s, d: frame(s, d, "orders").select("o_orderkey", codes.icon_flags(F.col("o_orderkey") % 40).alias("label")),
         "select o_orderkey, case when c = 0 then 'INVALID' when c & 15 = 0 then 'UNKNOWN_' || c else concat_ws('|', case when c & 1 > 0 then 'FAVICON' end, case when c & 2 > 0 then 'TOUCH_ICON' end, case when c & 4 > 0 then 'TOUCH_PRECOMPOSED' end, case when c & 8 > 0 then 'WEB_MANIFEST_ICON' end) end label from (select o_orderkey, o_orderkey % 40 c from orders)")
PREFERENCES = list(codes.LABELS["content_preference"].items())
register("H-22fprefs", lambda s, d: frame(s, d, "orders").select("o_orderkey", codes.label("content_preference", F.get(F.array(*[F.lit(k) for k, _ in PREFERENCES], F.lit("other")), F.pmod("o_orderkey", F.lit(len(PREFERENCES) + 1)).cast("int"))).alias("label")),
         f"select o_orderkey, case o_orderkey % {len(PREFERENCES) + 1} {' '.join(f'when {k} then {v!r}' for k, (_, v) in enumerate(PREFERENCES))} else 'other' end label from orders")
register("H-5ties", lambda s, d: frame(s, d, "documents").select("doc_id", S.size_text(F.col("doc_id") * 256).alias("size"), S.duration_text(F.col("doc_id") * 180).alias("duration"), S.span_text(F.col("doc_id") * 37).alias("span")),
         "select doc_id, case when doc_id * 256 >= 1048576 then printf('%.1f MB', doc_id * 256 / 1048576) when doc_id * 256 >= 1024 then printf('%.1f KB', doc_id * 256 / 1024) else doc_id * 256 || ' B' end size, case when h < 24 then printf('%.1f hours', h) when h < 168 then printf('%.1f days', h / 24) else printf('%.1f weeks', h / 168) end duration, case when doc_id = 0 then '0s' else concat_ws(' ', case when t // 3600 > 0 then t // 3600 || 'h' end, case when t % 3600 // 60 > 0 then t % 3600 // 60 || 'm' end, case when t % 60 > 0 then t % 60 || 's' end) end span from (select doc_id, doc_id * 180 / 3600 h, doc_id * 37 t from documents)")
register("H-5dates", lambda s, d: frame(s, d, "orders").select("o_orderkey", *[S.local_date_text(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'+02:00'"), form, time).alias(name) for form, time, name in (("eu", True, "eu"), ("us", True, "us"), ("eu", False, "eu_day"))]),
         "select o_orderkey, strftime(o_orderdate, '%d.%m.%Y %H:%M:%S') eu, strftime(o_orderdate, '%m/%d/%Y %H:%M:%S') us, strftime(o_orderdate, '%d.%m.%Y') eu_day from orders")
register("H-7rules", lambda s, d: frame(s, d, "urls").select("id", S.registered_domain(F.col("domain"), ["com", "net", "org", "example.org", "*.example.net", "!www.example.net"]).alias("site")), """
    select id, case when n >= 2 and two = 'example.org' then case when n > 2 then three else two end when n >= 3 and two = 'example.net' and three <> 'www.example.net' then case when n > 3 then four else three end when n >= 3 and three = 'www.example.net' then three else two end site
    from (select id, lower(domain) host, len(string_split(domain, '.')) n, array_to_string(string_split(lower(domain), '.')[-2:], '.') two, array_to_string(string_split(lower(domain), '.')[-3:], '.') three, array_to_string(string_split(lower(domain), '.')[-4:], '.') four from urls)""", "urls")  # fmt: skip

# -- the system report
SYSTEM = "case o_orderkey % 9 when 0 then 'browser:registered_browser' when 1 then 'browser:app_path' when 2 then 'browser:home_page' when 3 then 'browser:search_scope' when 4 then 'recent_documents' when 5 then 'typed_paths' when 6 then 'execution:user_assist' when 7 then 'browser:typed_url' else 'other' end"


def indicators(s, d):
    return frame(s, d, "orders").selectExpr(
        "o_orderkey as id", f"{SYSTEM} as type", "'n' as name", "case when o_orderkey % 2 = 0 then o_orderstatus else '' end as value", "concat('A/App Paths/', o_orderstatus, '.exe/v') as path",
        "case when o_orderkey % 9 = 6 then concat('{\"decoded_path\":\"p', o_custkey, '\",\"run_count\":', o_orderkey, ',\"last_run\":\"d\"}') end as extra_json",
    )


VALUE = "case when o_orderkey % 2 = 0 then o_orderstatus else '' end"
register("A-49browsers", lambda s, d: system.detected_browsers(indicators(s, d)).select("id", "section", "name", "value"), f"""
    select * from (select o_orderkey id, case o_orderkey % 9 when 0 then 'registered' when 1 then 'app_path' else 'setting' end section, case o_orderkey % 9 when 0 then {VALUE} when 1 then o_orderstatus || '.exe' when 2 then 'Home Page' else 'Search Scope: n' end "name",
    case o_orderkey % 9 when 0 then '' else {VALUE} end "value" from orders where o_orderkey % 9 < 4) where section <> 'registered' or "name" <> ''""")  # fmt: skip
register("A-49activity", lambda s, d: system.user_activity(indicators(s, d)).select("id", "section", "name", "value"), f"select o_orderkey id, case o_orderkey % 9 when 4 then 'recent_docs' when 5 then 'typed_paths' else 'typed_urls' end section, 'n' \"name\", {VALUE} \"value\" from orders where o_orderkey % 9 in (4, 5, 7)")
register("A-49assist", lambda s, d: system.executions(system.assisted_runs(indicators(s, d))), "select 'p' || o_custkey path, sum(o_orderkey)::bigint runs, 'd' last_run from orders where o_orderkey % 9 = 6 group by 1")
register("H-7file", lambda s, d: frame(s, d, "urls").select("id", S.registered_domain(F.col("domain"), readers.suffix_rules(s, written(frame(s, d, "urls").select(F.regexp_extract("domain", "([^.]*)$", 1).alias("value")).distinct(), "suffixes"))).alias("site")), "select id, array_to_string(string_split(lower(domain), '.')[-2:], '.') site from urls", "urls")

# -- counters and sessions
COUNTERS = "to_json(map(event_type, n))"
register("A-39maps", lambda s, d: artifacts.run_totals(frame(s, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).selectExpr(f"{COUNTERS} as discovered", "to_json(map(event_type, n - 1, 'all', n)) as ingested", "'{}' as failed", "cast(null as string) as skipped")),
         "with c as (select user_id, event_type, count(*) n from events group by 1, 2) select 'discovered' category, event_type item, sum(n)::bigint n from c group by 2 union all select 'ingested', event_type, sum(n - 1)::bigint from c group by 2 union all select 'ingested', 'all', sum(n)::bigint from c")


def session_documents(s, d):
    """A session document for each conversation: its turns are the entries of one tab, a second tab has none, a third is closed."""
    entries = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: F.struct(F.concat(F.lit("http://t/"), x["turn"].cast("string")).alias("url"), x["role"].alias("title")))
    docs = frame(s, d, "conversations").groupBy("conv_id").agg(entries.alias("entries"))
    tab = lambda e, at: F.struct(e.alias("entries"), at.alias("index"), (F.col("conv_id") % 2 == 0).alias("pinned"), (F.col("conv_id") * 1000).alias("lastAccessed"))
    empty = F.slice("entries", 1, 0)
    window = F.struct((F.col("conv_id") % 3).alias("selected"), F.array(tab(F.col("entries"), (F.col("conv_id") % 4).cast("int")), tab(empty, F.lit(1))).alias("tabs"), F.array(F.struct(tab(F.col("entries"), F.lit(1)).alias("state"), F.lit("gone").alias("title"), F.lit(5000).cast("long").alias("closedAt"))).alias("_closedTabs"))
    return docs.select(F.col("conv_id").alias("id"), F.to_json(F.struct(F.array(window).alias("windows"))).alias("doc"))


register("N-6windows", lambda s, d: artifacts.session_tabs(session_documents(s, d)).withColumn("at", F.unix_timestamp("at")), """
    with c as (select conv_id id, list(struct_pack(url := 'http://t/' || turn, title := role) order by turn, role) e from conversations group by 1)
    select id, 0 "window", 0 tab, false closed, coalesce(case when id % 4 > 0 then e[id % 4].url end, '') url, coalesce(case when id % 4 > 0 then e[id % 4].title end, '') title, id % 2 = 0 pinned, id % 3 = 1 selected, id "at", len(e) entries from c
    union all select id, 0, 1, false, '', '', id % 2 = 0, id % 3 = 2, id, 0 from c union all select id, 0, 0, true, e[1].url, 'gone', id % 2 = 0, false, 5, len(e) from c""")  # fmt: skip
register("U-2seen", lambda s, d: posted(s, d), "select url, discovered_by, first_seen, last_seen from urls union all select url, 'copy', first_seen, last_seen from copies where id >= 1000000", "copies")

# -- sources: files written from the tables
register("S-2", lambda s, d: readers.hash_list(s, written(frame(s, d, "hashes").select(F.concat(F.upper("hash"), F.lit(", of "), "list_name").alias("value")), "hashes")).select("hash", "kind", "note"),
         "select hash, case length(hash) when 32 then 'md5' else 'sha256' end kind, 'of ' || list_name note from hashes", "hashes")
def one_list(s, d):
    path = new_folder(s, "list")
    frame(s, d, "hashes").select(F.col("hash").alias("value")).coalesce(1).sortWithinPartitions("value").write.text(path)
    return path


register("S-4", lambda s, d: readers.list_versions(s, one_list(s, d), s.createDataFrame([], "list_name string, version string")).select("version", "state"), "select sha256(string_agg(hash || chr(10), '' order by hash)) \"version\", 'new' state from hashes", "hashes")
register("S-5", lambda s, d: readers.batch_status(s, one_list(s, d), s.createDataFrame([], "list_name string"), "rename").select("entries", "bad", "status"), "select count(*)::int entries, 0 bad, 'imported' status from hashes", "hashes")
register("S-3", lambda s, d: readers.pattern_list(s, written(frame(s, d, "documents").select(F.concat_ws("/", "lang", "source").alias("value")).distinct(), "patterns")).select("pattern", "is_regex"), "select distinct lang || '/' || source pattern, false is_regex from documents")
register("S-6", lambda s, d: readers.listing(s, listed(s, d)).select("file_path", "file_name", "size_bytes", "md5_hash", "deleted"), "select file_path, regexp_extract(file_path, '[^/]*$') file_name, size_bytes, md5 md5_hash, deleted from files", "files")


def body_line():
    return F.concat(F.lit("0|"), F.when(F.col("deleted"), F.lit("* ")).otherwise(F.lit("")), "file_path", F.lit("|"), F.col("id").cast("string"), F.lit("-128-1|r/rrwx|0|0|"), F.col("size_bytes").cast("string"), F.lit("|1600000000|1600000001|1600000002|"), (F.col("id") + 1500000000).cast("string"))


register("S-8", lambda s, d: readers.body_file(s, written(frame(s, d, "files").select(body_line().alias("value")), "body")).select("file_path", "inode", "size_bytes", F.unix_timestamp("created_ts").alias("created"), "deleted"), "select file_path, id inode, size_bytes, id + 1500000000 created, deleted from files", "files")
register("S-9", lambda s, d: readers.feature_file(s, written(frame(s, d, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit("\t"), "url", F.lit("\tcontext")).alias("value")), "features"), "domain").select("offset", "feature", "context"), "select page_id \"offset\", regexp_replace(trim(url), '^(http|https|ftp)://', '') feature, 'context' context from pages")
SWEPT = "https?://[a-zA-Z0-9][a-zA-Z0-9\\-._~:/?#\\[\\]@!$&''()*+,;=%]+"
register("S-10", lambda s, d: readers.urls_in_files(s, written(frame(s, d, "pages").select(F.concat(F.lit("\x01"), F.upper("url"), F.lit("\x02"), "url", F.lit(" ")).alias("value")), "raw")).select("url"),
         f"select u url from (select unnest([upper(url), url]) u from pages) where regexp_full_match(u, '{SWEPT}', 'i') and len(list_distinct(string_split(u, ''))) >= 10 and length(u) > 10 and length(u) < 2048")


def listed(s, d):
    path = new_folder(s, "listing")
    frame(s, d, "files").select(F.col("file_path").alias("Full Path"), F.col("size_bytes").alias("Size (bytes)"), F.col("md5").alias("MD5 hash"), F.when(F.col("deleted"), "yes").otherwise("no").alias("Is Deleted")).write.csv(path, header=True)
    return path


# -- sinks, read back
def through(spark, write, columns: str):
    path = new_folder(spark, "csv")
    write(path)
    return spark.read.csv(path, header=True, escape="\\").selectExpr(*columns.split("; "))


register("S-16", lambda s, d: through(s, lambda path: readers.export_timeline(frame(s, d, "timeline").withColumn("ref_table", F.lit("part")), frame(s, d, "associations"), path, ["click", "view"], ["medium"], "2024-01-05", "2024-01-09"), "timestamp; kind; cast(ref_id as bigint) as ref_id; coalesce(tags, '') as tags"),
         "select strftime(ts, '%Y-%m-%d %H:%M:%S') \"timestamp\", kind, ref_id, coalesce(tags, '') tags from timeline left join (select artifact_id, string_agg(distinct tag, ', ' order by tag) tags from associations where artifact_type = 'part' group by 1) on artifact_id = ref_id where kind in ('click', 'view') and confidence = 'medium' and ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-10'", "timeline", "associations")
register("S-17", lambda s, d: through(s, lambda path: readers.export_urls(frame(s, d, "urls"), frame(s, d, "matches"), frame(s, d, "associations"), path, "part"), "cast(id as bigint) as id; url; coalesce(matches, '') as matches; coalesce(tags, '') as tags"),
         "select id, url, coalesce(lists, '') matches, coalesce(tags, '') tags from urls left join (select id, string_agg(distinct list_name, ', ' order by list_name) lists from matches group by 1) using (id) left join (select artifact_id id, string_agg(distinct tag, ', ' order by tag) tags from associations where artifact_type = 'part' group by 1) using (id)", "urls", "matches", "associations")
register("S-18", lambda s, d: through(s, lambda path: readers.export_rows(frame(s, d, "files"), path, {"Path": "file_path", "Size": "size_bytes", "Deleted": "deleted"}, ["file_path"]), "Path as path; cast(Size as bigint) as size; cast(Deleted as boolean) as deleted"), "select file_path path, size_bytes size, deleted from files", "files")


def replaced(s, d):
    """Events of three evidences; then the first gets a smaller set, the second an empty one."""
    path, rows = new_folder(s, "events"), frame(s, d, "timeline").where("evidence_id < 9").selectExpr("evidence_id % 3 as evidence_id", "epoch", "kind")
    readers.replace_partition(rows, path, ["evidence_id"])
    readers.replace_partition(rows.where("evidence_id = 0 and kind = 'click'"), path, ["evidence_id"], [(0,), (1,)])
    return s.read.schema("epoch long, kind string, evidence_id long").parquet(path)


register("S-19", replaced, "select evidence_id % 3 evidence_id, epoch, kind from timeline where evidence_id < 9 and (evidence_id % 3 = 2 or evidence_id % 3 = 0 and kind = 'click')", "timeline")


def re_ingested(s, d):
    path, rows = new_folder(s, "runs"), frame(s, d, "events").selectExpr("user_id % 4 as run", "event_id", "event_type")
    for _ in range(2):
        readers.replace_partition(rows, path, ["run"])
    return s.read.schema("event_id long, event_type string, run long").parquet(path)


register("S-12", re_ingested, "select user_id % 4 run, event_id, event_type from events")


# -- streams, to their end
def streamed(s, d, feed, columns: str, by: list[str], schema: str):
    path = new_folder(s, "stream")
    feeds.run_sink(feed, path, f"{path}-checkpoint", by).awaitTermination()
    return s.read.schema(schema).parquet(path).select(*columns.split())


def arriving(s, d, table: str, files: int = 3):
    """A stream of a table in several files, one a micro-batch."""
    path, df = new_folder(s, "arriving"), s.read.parquet(f"{d}/{table}.parquet")
    df.repartition(files).write.parquet(path)
    return s.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


register("R-1", lambda s, d: streamed(s, d, feeds.matched_feed(arriving(s, d, "pages").selectExpr("page_id as id", "url"), RULES), "id list_name pattern", ["list_name"], "id long, pattern string, list_name string"), pattern_sql("url"), "urls")
register("R-2", lambda s, d: streamed(s, d, arriving(s, d, "events").selectExpr("user_id % 4 as run", "event_id"), "run event_id", ["run"], "event_id long, run long"), "select user_id % 4 run, event_id from events")


def daily(s, d):
    name = f"daily_{uuid.uuid4().hex}"
    feeds.daily_feed(arriving(s, d, "events").selectExpr("cast(ts as timestamp) as ts", "event_type as kind"), "400 days").writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", new_folder(s, "daily")).trigger(availableNow=True).start().awaitTermination()
    return s.table(name)  # a row for each day and kind


register("R-3", daily, "select ts::date \"day\", event_type kind, count(*) n from events group by 1, 2")


# SQL for queries that are registered without it
ORACLES["X-3"], ORACLES["X-4"] = ORACLES["X-3all"], ORACLES["X-4all"]
ORACLES["X-2"] = "select event_id id, k path, json_extract_string(props, '$.' || k) \"value\", null::varchar kind, null::varchar \"at\" from (select event_id, props, unnest(json_keys(props)) k from events)"


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
