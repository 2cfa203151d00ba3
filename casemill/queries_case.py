"""Registered queries of the operators that span several artifact tables, with the DuckDB SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from casemill.functions import browser as B
from casemill.functions import scalars as S
from casemill.operators import accounts, domains, drift, indicators, links, logs, matching, merging, similarity, stored_values, timeline
from casemill.plans.standins import SPELLINGS, VIEWS, frame, with_views
from casemill.queries import prints
from casemill.queries_sources import written
from casemill.sources import listings, readers
from casemill.streaming import feeds
from casemill.tables import new_folder

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, run, sql: str | None = None, *views: str) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = with_views(sql, *views) if views else sql


# -- J-22: downloads named after the last part of a URL, in any case, some of them with a domain that has no such URL
DOWNLOADED = "select id + 5000 as id, evidence_id, case when id % 11 = 0 then 'nowhere.example' else domain end as domain, case id % 4 when 0 then upper(regexp_extract(url, '([^/]*)$', 1)) when 1 then regexp_extract(url, '([^/]*/[^/]*)$', 1) when 2 then concat(regexp_extract(url, '([^/]*)$', 1), '%') else regexp_extract(url, '([^/]*)$', 1) end as filename from {urls}"
register("J-22link", lambda s, d: links.download_links(s.sql(DOWNLOADED, urls=frame(s, d, "urls")), frame(s, d, "copies")),
         f"select x.id, min(c.id) url_id from ({DOWNLOADED.format(urls='urls')}) x left join copies c on c.evidence_id = x.evidence_id and c.domain = x.domain and ends_with(lower(c.url), '/' || lower(x.filename)) group by 1", "copies")

# -- A-5: copies with tags as JSON lists, JSON strings, plain texts and other JSON, and notes
TAGGED = "select *, case id % 6 when 0 then '[\"b\",\"a\"]' when 1 then '\"c\"' when 2 then 'plain text' when 3 then '7' when 4 then null else '[]' end as tags, case when id % 3 = 0 then null else concat('n', cast(id % 4 as {string})) end as notes from {copies}"


def merge(s, d):
    rows = s.sql(TAGGED.replace("{string}", "string"), copies=frame(s, d, "copies"))
    linked = rows.selectExpr("id", "case when id % 2 = 0 then 'even' else 'third' end as list_name").where("id % 2 = 0 or id % 3 = 0")
    marks = rows.selectExpr("concat('t', id % 5) as tag", "'url' as artifact_type", "id as artifact_id")
    return merging.merged_urls(rows, linked, marks, ["url", "discovered_by"], None, ["history", "cache"])


MERGED = f"""with urls as ({{urls}}), copies as ({{copies}}), rows as ({TAGGED.format(string='varchar', copies='copies')}),
    scoped as (select *, min(id) over (partition by evidence_id, url, discovered_by) kept, count(*) over (partition by evidence_id, url, discovered_by) n from rows where discovered_by in ('history', 'cache')),
    pieces as (select kept, unnest(case when tags is null then [] when not json_valid(tags) then [tags] when json_type(tags) = 'ARRAY' then json_extract_string(tags, '$[*]') when json_type(tags) = 'VARCHAR' then [json_extract_string(tags, '$')] else [] end) tag from scoped where n > 1),
    united as (select kept, to_json(list_sort(list_distinct(list(tag))))::varchar tags from pieces group by 1),
    merged as (select kept id, min(first_seen) first_seen, max(last_seen) last_seen, string_agg(distinct source_path, ', ' order by source_path) source_path, string_agg(distinct notes, '; ' order by notes) notes, sum(coalesce(nullif(occurrences, 0), 1))::bigint occurrences from scoped where n > 1 group by 1) """
register("A-5merged", lambda s, d: merge(s, d).urls.select("id", "url", "first_seen", "last_seen", "source_path", "tags", "notes", "occurrences"),
         MERGED + "select r.id, r.url, coalesce(m.first_seen, r.first_seen) first_seen, coalesce(m.last_seen, r.last_seen) last_seen, case when m.id is null then r.source_path else m.source_path end source_path, case when m.id is null then r.tags else u.tags end tags, case when m.id is null then r.notes else m.notes end notes, case when m.id is null then r.occurrences else m.occurrences end occurrences from rows r left join merged m on m.id = r.id left join united u on u.kept = r.id where r.id not in (select id from scoped where id <> kept)")
register("A-5counts", lambda s, d: merge(s, d).counts, MERGED + "select count(*) total_before, count(*) filter (id = kept) total_after, count(*) filter (id <> kept) duplicates_removed, count(distinct kept) filter (n > 1) unique_urls_affected from scoped")
register("A-5matches", lambda s, d: merge(s, d).matches, MERGED + "select distinct coalesce(s.kept, r.id) id, case when r.id % 2 = 0 then 'even' else 'third' end list_name from rows r left join scoped s on s.id = r.id where r.id % 2 = 0 or r.id % 3 = 0")
register("A-5tags", lambda s, d: merge(s, d).associations, MERGED + "select distinct 't' || r.id % 5 tag, 'url' artifact_type, coalesce(s.kept, r.id) artifact_id from rows r left join scoped s on s.id = r.id")
for name in ("A-5merged", "A-5counts", "A-5matches", "A-5tags"):
    ORACLES[name] = ORACLES[name].replace("{urls}", VIEWS["urls"].format(**SPELLINGS["duckdb"])).replace("{copies}", VIEWS["copies"].format(**SPELLINGS["duckdb"]))

# -- J-14, J-15, J-16, J-8
VISITS = "select event_id as id, event_id % (select count(*) from {pages}) as place_id, event_id - user_id as from_visit, case event_type when 'purchase' then 7 when 'click' then 7 else 1 end as visit_type from {events}"


def visits(s, d):
    return s.sql(VISITS, pages=frame(s, d, "pages"), events=frame(s, d, "events"))


def places(s, d):
    return frame(s, d, "pages").selectExpr("page_id as id", "url")


CHAIN = f"select v.id visit_id, p.url download_url, p2.url referrer_url from ({VISITS.format(pages='pages', events='events')}) v join pages p on p.page_id = v.place_id join ({VISITS.format(pages='pages', events='events')}) v2 on v2.id = v.from_visit join pages p2 on p2.page_id = v2.place_id where v.visit_type = 7"
register("J-14chain", lambda s, d: links.download_referrers(visits(s, d), places(s, d)), CHAIN)
register("J-14map", lambda s, d: links.referrer_map(visits(s, d), places(s, d)), f"select download_url, arg_max(referrer_url, visit_id) referrer_url from ({CHAIN}) group by 1")
ANNOTATIONS = "select ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey as id, l_orderkey as place_id, l_linenumber % 4 as attribute_id, case l_linenumber % 4 when 1 then concat('file:///', l_partkey) when 2 then concat('{{\"state\":', l_suppkey % 5, ',\"endTime\":', l_partkey * 1000, ',\"fileSize\":', l_orderkey, '}}') else 'x' end as content from {lineitem}"


def annotated(s, d):
    kinds = frame(s, d, "nation").where("n_nationkey < 4").selectExpr("n_nationkey as id", "case n_nationkey when 1 then 'destination' when 2 then 'metadata' else n_name end as name")
    rows = links.annotated(frame(s, d, "orders").selectExpr("o_orderkey as id", "o_orderpriority as url"), s.sql(ANNOTATIONS, lineitem=frame(s, d, "lineitem")), kinds, {"target": "destination"}, {"meta": "metadata"})
    return links.download_metadata(rows, "meta").select("id", "url", "target", "state", F.unix_timestamp("ended").alias("ended"), "file_size")


register("J-15values", annotated, f"""
    with a as ({ANNOTATIONS.format(lineitem='lineitem')}), x as (select place_id, arg_max(content, id) filter (attribute_id = 1) target, arg_max(content, id) filter (attribute_id = 2) meta from a group by 1)
    select o_orderkey id, o_orderpriority url, target, (meta->>'state')::int state, (meta->>'endTime')::bigint // 1000 ended, (meta->>'fileSize')::bigint file_size from orders join x on place_id = o_orderkey where target is not null""")  # fmt: skip
HOPS = "select o_custkey as download, o_orderkey as place, concat('http://', o_orderpriority, '/', o_custkey % 7) as url from {orders}"
register("J-16urls", lambda s, d: links.chain_urls(s.sql(HOPS, orders=frame(s, d, "orders")), "download", "place", "url", "redirect"),
         f"select url, count(distinct download) downloads, min(place) first_place, 'redirect' discovered_by from ({HOPS.format(orders='orders')}) group by 1")
register("J-8status", lambda s, d: links.url_states(frame(s, d, "copies"), frame(s, d, "urls").where("id % 3 = 1").selectExpr("id as url_id", "case when id % 2 = 0 then 'completed' else 'failed' end as status")),
         "select url, domain, min(c.id) id, string_agg(distinct discovered_by, ',' order by discovered_by) sources, count(distinct discovered_by) source_count, arg_min(status, c.id) filter (status is not null) status from copies c left join (select id, case when id % 2 = 0 then 'completed' else 'failed' end status from urls where id % 3 = 1) using (id) group by 1, 2", "copies")

# -- near fingerprints with a value of a band that most of them share; pauses of one evidence with all rows
HOT_LO = "(vec_id * 7919) % 4096 * 3 + (vec_id % 50) * 1048576"


def crowded(s, d):
    """Hashes of which nine in ten have the same 16 bits in front."""
    text = F.concat(F.when(F.col("vec_id") % 10 < 9, F.lit("abcd0000")).otherwise(F.lower(F.lpad(F.hex(F.col("vec_id") * 104729), 8, "0"))), F.lower(F.lpad(F.hex(F.expr(HOT_LO)), 8, "0")))
    return frame(s, d, "embeddings").select(F.col("vec_id").alias("id"), text.alias("phash"))


CROWDED = f"(select vec_id id, case when vec_id % 10 < 9 then 2882338816::bigint else vec_id * 104729 end hi, ({HOT_LO})::bigint lo from embeddings)"
register("J-7hot", lambda s, d: similarity.near_pairs(crowded(s, d), 3, 20),
         f"with p as (select distinct hi, lo, lower(lpad(printf('%x', hi), 8, '0') || lpad(printf('%x', lo), 8, '0')) phash from {CROWDED}) select a.phash a, b.phash b, (bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)))::int distance from p a join p b on a.phash < b.phash and bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 3")
register("C-1sources", lambda s, d: similarity.cluster_sources(similarity.leader_clusters(prints(s, d), 12), frame(s, d, "embeddings").where("label = 1").selectExpr("vec_id as id")))
register("W-1one", lambda s, d: timeline.gaps(frame(s, d, "timeline").selectExpr("0 as evidence_id", "date_trunc('second', ts) as ts").where("day(ts) % 3 > 0"), 12, ["evidence_id"]).select("evidence_id", F.unix_timestamp("start").alias("start"), F.unix_timestamp("end").alias("end"), "hours"),
         "select 0 evidence_id, \"start\", \"end\", \"hours\" from (select lag(epoch) over (order by epoch) \"start\", epoch \"end\", round((epoch - lag(epoch) over (order by epoch)) / 3600.0, 2) \"hours\" from timeline where day(ts) % 3 > 0) where \"hours\" >= 12 order by \"end\" desc limit 20", "timeline")

# -- N-12: an entry for each event, those of others than the console with a second line
LOG = """select user_id % 5 as path, event_id as id, {month_day} as day, {clock} as clock, case event_type when 'error' then 'ERROR' else 'INFO' end as severity, event_id % 3 = 0 as console,
    concat('http://h', event_id % 7, '.example.com/a') as body, concat('https://s', user_id, '.example.org/x.js') as script from {events}"""
SPARK_LOG = {"month_day": "date_format(ts, 'MMdd')", "clock": "date_format(ts, 'HHmmss')", "events": "{events}"}
DUCK_LOG = LOG.format(month_day="strftime(ts, '%m%d')", clock="strftime(ts, '%H%M%S')", events="events")


def log_lines(s, d):
    rows = s.sql(LOG.format(**SPARK_LOG), events=frame(s, d, "events"))
    head = F.concat(F.lit("["), "day", F.lit("/"), "clock", F.when(F.col("id") % 2 == 0, F.lit(".123:11:22")).otherwise(F.lit("")), F.lit(":"), "severity", F.lit(":"), F.when(F.col("console"), F.lit("CONSOLE(3)")).otherwise(F.lit("backend_impl.cc(1037)")), F.lit("] "))
    both = F.when(F.col("console"), F.array(F.concat(head, F.lit('"see '), "body", F.lit(', now", source: '), "script", F.lit(". ("), F.col("id").cast("string"), F.lit(")")))).otherwise(
        F.array(F.concat(head, F.lit("GET "), "body", F.lit(";")), F.concat(F.lit("and "), "script", F.lit(": twice "), "body"))
    )
    return rows.select("path", "id", F.posexplode(both).alias("k", "text")).select("path", (F.col("id") * 2 + F.col("k")).alias("line"), "text")


register("N-12fields", lambda s, d: logs.debug_entries(log_lines(s, d)).select("path", "line", "date", "time", "milliseconds", "pid", "tid", "severity", "source", "console_url", "console_line", F.array_join("urls", " ").alias("urls")), f"""
    select path, id * 2 line, day "date", clock "time", case when id % 2 = 0 then '123' end "milliseconds", case when id % 2 = 0 then 11 end::bigint pid, case when id % 2 = 0 then 22 end::bigint tid, severity, case when console then 'CONSOLE(3)' else 'backend_impl.cc(1037)' end source,
    case when console then script end console_url, case when console then id end console_line, case when console then body else body || ' ' || script || ' ' || body end urls from ({DUCK_LOG})""")  # fmt: skip
register("N-12urls", lambda s, d: logs.debug_urls(logs.debug_entries(log_lines(s, d))).select("path", "url", "context", "severity", "source", "first_seen", "last_seen", "n"), f"""
    with uses as (select path, id * 10 + u.pos "at", u.url url, u.context context, severity, case when console then 'CONSOLE(3)' else 'backend_impl.cc(1037)' end source, day || '/' || clock seen from (select *, unnest(case when console then
    [struct_pack(pos := 0, url := script, context := 'console_source'), struct_pack(pos := 1, url := body, context := 'message_body')] else [struct_pack(pos := 0, url := body, context := 'message_body'), struct_pack(pos := 1, url := script, context := 'message_body'), struct_pack(pos := 2, url := body, context := 'message_body')] end) u from ({DUCK_LOG})))
    select path, url, arg_min(context, "at") context, arg_min(severity, "at") severity, arg_min(source, "at") source, arg_min(seen, "at") first_seen, arg_max(seen, "at") last_seen, count(*) n from uses group by 1, 2""")  # fmt: skip

# -- J-2 with lists of regular expressions, W-3 with a file name list
REGEX_LISTS = [("numbers", "/[0-9]{3}$"), ("numbers", "page=(\\d)\\b"), ("hosts", "^https?://(?:m|www)\\."), ("hosts", "example\\.(org|net)/(en|de)"), ("hosts", "[?]ref=.")]
REGEX_RULES = [(name, k, p, matching.url_rule(p, True)) for k, (name, p) in enumerate(REGEX_LISTS)]


def first_of(column: str, rules, table: str) -> str:
    """DuckDB SQL of the first expression of each list that fits a column."""
    cases = {name: " ".join(f"when regexp_matches({column}, '{p}', 'i') then '{p}'" for n, _, p, _ in rules if n == name) for name in sorted({r[0] for r in rules})}
    return " union all ".join(f"select id, '{name}' list_name, case {case} end pattern from {table}" for name, case in cases.items())


register("J-2regex", lambda s, d: matching.match_patterns(frame(s, d, "copies"), "url", REGEX_RULES), f"select * from ({first_of('url', REGEX_RULES, 'copies')}) where pattern is not null", "copies")
FILE_REGEXES = [(name, k, p, matching.url_rule(p, True)) for k, (name, p) in enumerate([("papers", "/en/f[0-9]*0\\.pdf$"), ("papers", "\\.PDF$"), ("packed", "src1[0-9]?/.*\\.(zip|gz)$")])]
register("W-3regex", lambda s, d: matching.match_patterns(frame(s, d, "files"), "file_path", FILE_REGEXES), f"select * from ({first_of('file_path', FILE_REGEXES, 'files')}) where pattern is not null", "files")


# -- J-4 with exact names, wildcards and regular expressions in one list
NAMES = "select 'known' as list_name, cast(doc_id * 10 as int) as idx, upper(concat('f', cast(doc_id as {string}), '.zip')) as pattern, false as is_regex from {documents} where doc_id % 3 = 0 union all select 'known', 5000, '*1.jpg', false union all select 'odd', 1, '^f[0-9]*7$', true union all select 'odd', 2, 'f?', false"


def named_files(s, d):
    return frame(s, d, "files").withColumn("file_name", F.regexp_extract("file_path", "([^/]*)$", 1))


register("J-4names", lambda s, d: matching.match_file_names(named_files(s, d), s.sql(NAMES.replace("{string}", "string"), documents=frame(s, d, "documents"))), f"""
    select id, list_name, arg_min(pattern, idx) pattern from (select n.id, list_name, idx, pattern from (select id, regexp_extract(file_path, '([^/]*)$', 1) file_name from files) n join ({NAMES.format(string='varchar', documents='documents')}) x on not is_regex and not contains(pattern, '*') and not contains(pattern, '?') and lower(pattern) = lower(file_name)
    union all select id, 'known', 5000, '*1.jpg' from files where file_path ilike '%/%1.jpg' union all select id, 'odd', 1, '^f[0-9]*7$' from files where regexp_matches(file_path, '/f[0-9]*7$', 'i') union all select id, 'odd', 2, 'f?' from files where regexp_matches(file_path, '/f.$', 'i')) group by 1, 2""", "files")  # fmt: skip


# -- S-10 in ranges: pages' URLs in one raw file, cut every 997 bytes
def raw_file(s, d):
    path = new_folder(s, "raw")
    frame(s, d, "pages").select("page_id", F.concat(F.lit("\x01"), "url", F.lit("\x02\xff"), F.upper("url"), F.lit(" x http://in.example.com/?u="), "url", F.lit(" ")).alias("value")).coalesce(1).sortWithinPartitions("page_id").select("value").write.text(path)
    return path


SWEPT = "https?://[a-zA-Z0-9][a-zA-Z0-9\\-._~:/?#\\[\\]@!$&''()*+,;=%]+"
register("S-10ranges", lambda s, d: readers.urls_in_files(s, raw_file(s, d), 997).select("offset", "url"), f"""
    with x as (select page_id, url, octet_length(encode(chr(1) || url || chr(2) || chr(255) || upper(url) || ' x http://in.example.com/?u=' || url || ' ')) + 1 size, octet_length(encode(url)) n from pages),
    p as (select *, sum(size) over (order by page_id) - size at0 from x), u as (select unnest([struct_pack(o := at0 + 1, u := url), struct_pack(o := at0 + n + 4, u := upper(url)), struct_pack(o := at0 + 2 * n + 7, u := 'http://in.example.com/?u=' || url)], recursive := true) from p)
    select o::bigint "offset", u url from u where regexp_full_match(u, '{SWEPT}', 'i') and len(list_distinct(string_split(u, ''))) >= 10 and length(u) > 10 and length(u) < 2048""")  # fmt: skip


# -- S-6, S-7: a third of the files in each of three listings
def listing_files(s, d):
    path, rows = new_folder(s, "listings"), frame(s, d, "files")
    size, gone = F.col("size_bytes").cast("string"), F.when(F.col("deleted"), "Yes").otherwise("No")
    name = F.regexp_extract("file_path", "([^/]*)$", 1)
    tab = rows.where("id % 3 = 0").select(name.alias("Filename"), F.col("file_path").alias("Full Path"), size.alias("Size (bytes)"), F.lit("2024-01-02 03:04:05").alias("Created"), F.lit("").alias("Modified"), F.lit("").alias("Accessed"), gone.alias("Is Deleted"))
    tab.repartition(2).write.csv(f"{path}/a", sep="\t", header=True, encoding="UTF-16LE")
    comma = rows.where("id % 3 = 1").select(F.concat(F.lit("x, "), name).alias("Name"), F.col("file_path").alias("Full Path"), size.alias("File Size"), F.lit("01/02/2024 03:04:05").alias("Created Date"), F.lit("").alias("Modified Date"), gone.alias("Deleted"))
    comma.write.csv(f"{path}/b", header=True)
    other = rows.where("id % 3 = 2").select(F.col("md5").alias("MD5 sum"), F.col("file_path").alias("Location path"), size.alias("Byte size"))
    other.write.csv(f"{path}/c", sep=";", header=True)
    return f"{path}/*/*.csv"


register("S-6files", lambda s, d: listings.listings(s, listing_files(s, d)).select("profile", "file_path", "file_name", "size_bytes", F.unix_timestamp("created_ts").alias("created"), "md5_hash", "deleted"), """
    select case id % 3 when 0 then 'tab' when 1 then 'comma' else 'generic' end profile, file_path, case when id % 3 = 1 then 'x, ' else '' end || regexp_extract(file_path, '([^/]*)$', 1) file_name, size_bytes, case when id % 3 < 2 then 1704164645 end created, case when id % 3 = 2 then md5 end md5_hash, case when id % 3 < 2 then deleted else false end deleted from files""", "files")  # fmt: skip
register("S-7profiles", lambda s, d: listings.profiles(s, listing_files(s, d)).select("encoding", "delimiter", "profile", "columns").distinct(),
         "select * from (values ('UTF-16LE', chr(9), 'tab', 'file_path,file_name,size_bytes,created_ts,modified_ts,accessed_ts,deleted'), ('UTF-8', ',', 'comma', 'file_path,file_name,size_bytes,created_ts,modified_ts,deleted'), ('UTF-8', ';', 'generic', 'file_path,size_bytes,md5_hash')) t(encoding, delimiter, profile, columns) where (select count(*) from documents) > 0")

# -- H-7 and A-7 by a table of ten thousand rules, some of which hold
RULES = "select concat('r', cast(p_partkey as {string}), '.', p_brand) as rule from {part} union all select distinct regexp_extract(url, '([a-z]+[.][a-z]+)[/?#]', 1) as rule from {pages} where page_id % 2 = 0 union all select '*.example.net' as rule union all select '!m.example.net' as rule"


def rules(s, d):
    lines = s.sql(RULES.replace("{string}", "string"), part=frame(s, d, "part"), pages=frame(s, d, "pages"))
    return domains.suffix_table(s, written(lines.selectExpr("rule as value"), "suffixes"))


SITED = f"""with urls as ({{urls}}), rules as (select distinct lower(rule) rule from ({RULES.format(string='varchar', part='part', pages='pages')}) where rule <> ''),
    hosts as (select distinct domain "host", string_split(lower(domain), '.') l from urls), ends as (select "host", l, k, array_to_string(l[-k:], '.') e from (select *, unnest(range(1, len(l) + 1)) k from hosts)),
    met as (select "host", l, max(case when exists (select 1 from rules where rule = '!' || e) then k - 1 end) x, max(case when exists (select 1 from rules where rule = e) then k end) p, max(case when k < len(l) and exists (select 1 from rules where rule = '*.' || e) then k + 1 end) w from ends group by 1, 2),
    sites as (select "host", array_to_string(l[-(coalesce(x, greatest(p, w), 1) + 1):], '.') site from met) """
register("H-7table", lambda s, d: domains.with_sites(frame(s, d, "urls"), "domain", rules(s, d)).select("id", "site"), SITED + "select id, site from urls join sites on \"host\" = domain")
register("A-7sub", lambda s, d: domains.site_summary(frame(s, d, "urls"), rules(s, d), 3), SITED + """, per as (select site, url, sum(coalesce(occurrences, 1))::bigint n, min(first_seen) f, max(last_seen) l from urls join sites on "host" = domain group by 1, 2),
    ranked as (select *, row_number() over (partition by site order by n desc, url) place from per)
    select site, count(*) urls, sum(n)::bigint occurrences, min(f) first_seen, max(l) last_seen, string_agg(url || ' (' || n || ')', chr(10) order by place) filter (place <= 3) sub_urls from ranked group by 1""")  # fmt: skip

for name in ("H-7table", "A-7sub"):
    ORACLES[name] = ORACLES[name].replace("{urls}", VIEWS["urls"].format(**SPELLINGS["duckdb"]))


# -- A-50: all kinds of drift
def nested_json(s, d):
    return frame(s, d, "events").select("event_type", F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), F.lit(',"inner":{"'), "event_type", F.lit('":{"deep":'), F.when(F.col("event_id") % 2 == 0, F.lit('"text"')).otherwise(F.lit("[1]")), F.lit('},"known":true}}')).alias("doc"))


def drifted(s, d):
    known = s.createDataFrame([("click",), ("view",)], "value string")
    keys = s.createDataFrame([("id",), ("inner",), ("inner.known",)], "path string")
    tables = {"events": nested_json(s, d), "regions": frame(s, d, "region"), "sqlite_stat": frame(s, d, "nation")}
    return drift.drift_report(tables, {"events": {"doc"}}, [("events", "event_type", known)], [("events", "doc", keys)])


register("A-50all", drifted, """
    select 'unknown_table' what, 'regions' source, 'regions' item, 'r_regionkey,r_name' detail, null::bigint n union all select 'unknown_column', 'events', 'event_type', 'string', null
    union all select 'unknown_enum_value', 'events.event_type', event_type, null, count(*) from events where event_type not in ('click', 'view') group by 3
    union all select 'unknown_json_key', 'events.doc', 'inner.' || event_type, 'dict <dict>', count(*) from events group by 3
    union all select 'unknown_json_key', 'events.doc', 'inner.' || event_type || '.deep', case when event_id % 2 = 0 then 'str text' else 'list <list>' end, count(*) from events group by 3, 4""")  # fmt: skip


# -- R-1: hashes arrive in three batches, the list grows before each; R-3: days close, late and repeated rows are left out
def in_turn(s, parts: list, start) -> None:
    """Tables that arrive one after the other, each in as many files as it has tasks: a run of the stream takes one as its next micro-batch.

    Batches without rows, which move the watermark on, come after the last table only.
    """
    path, idle = new_folder(s, "turns"), "spark.sql.streaming.noDataMicroBatches.enabled"
    before = s.conf.get(idle)
    try:
        for k, df in enumerate(parts):
            df.write.mode("append").parquet(path)
            s.conf.set(idle, str(k + 1 == len(parts)).lower())
            start(s.readStream.schema(parts[0].schema).parquet(path)).awaitTermination()
    finally:
        s.conf.set(idle, before)


def hash_matches(s, d):
    files, hashes = frame(s, d, "files"), frame(s, d, "hashes")
    versioned = hashes.withColumn("version", F.expr("conv(substr(hash, 1, 2), 16, 10) % 3").cast("long"))
    seen = []

    def entries():
        seen.append(1)
        return versioned.where(F.col("version") < len(seen))

    path = new_folder(s, "hash-matches")
    in_turn(s, [files.where(f"id % 3 = {k}").select("id", "md5", "sha1", "sha256") for k in range(3)], lambda feed: feeds.hash_feed(feed, entries, path, f"{path}-checkpoint"))
    return s.read.schema("id long, list_name string, hash string, batch_id long").parquet(f"{path}/matches").select("id", "list_name", "hash", "batch_id")


register("R-1hashes", hash_matches, """
    select id, list_name, coalesce(arg_min(hash, r)) hash, min(greatest(id % 3, version))::bigint batch_id from (select f.id, h.list_name, h.hash, case when f.md5 = h.hash then 0 else 1 end r, ('0x' || substr(h.hash, 1, 2))::int % 3 "version" from files f join hashes h on h.hash in (f.md5, f.sha256)) group by 1, 2""", "files", "hashes")  # fmt: skip
LATE = 3


def closed_days(s, d):
    events = frame(s, d, "events").selectExpr("event_id", "cast(ts as timestamp) as ts", "event_type as kind")
    bounds = events.where("event_id % 10 > 0").agg(F.max("ts").alias("newest"))
    dated = events.crossJoin(F.broadcast(bounds)).withColumn("late", (F.col("event_id") % 10 == 0) & (F.date_trunc("day", "ts") + F.expr("interval 1 day") <= F.col("newest") - F.expr(f"interval {LATE} days")))
    timely, late = dated.where("event_id % 10 > 0").drop("late", "newest"), dated.where("late").drop("late", "newest")
    first, second = timely.where("day(ts) <= 15"), timely.where("day(ts) > 15")
    again = first.where("event_id % 7 = 0").unionByName(second)  # delivered twice
    path = new_folder(s, "days")
    # rows are late by the watermark that the batch before began with, so a batch of repeated rows goes before the late ones
    in_turn(s, [first, again, second.where("event_id % 2 = 0"), late], lambda feed: feeds.daily_sink(feed, path, f"{path}-checkpoint", f"{LATE} days", ["event_id"]))
    return s.read.schema("day date, kind string, n long").parquet(path)


register("R-3closed", closed_days, f"""
    with timely as (select * from events where event_id % 10 > 0), edge as (select max(ts) - interval {LATE} days edge from timely)
    select ts::date "day", event_type kind, count(*) n from timely, edge where date_trunc('day', ts) + interval 1 day <= edge group by 1, 2""")  # fmt: skip


# -- X-1, X-5: stored values as JSON two levels deep, and as plain texts under keys of tokens
def stored(s, d):
    doc = F.concat(F.lit('{"user_id":"u'), F.col("user_id").cast("string"), F.lit('","time":'), (F.col("event_id") + 1_600_000_000).cast("string"), F.lit(',"inner":[{"pageUrl":"https://h'), F.col("event_id").cast("string"), F.lit('.example.com/a?x=1.","email":"U'), F.col("user_id").cast("string"), F.lit('@mail.org","refreshToken":"'), F.repeat(F.lit("ab"), 20), F.col("event_id").cast("string"), F.lit('"}]}'))
    plain = F.concat(F.repeat(F.lit("x"), 30), F.lit(" http%3A%2F%2Fe.example.org%2Fp "), F.col("event_id").cast("string"))
    return frame(s, d, "events").select(F.col("event_id").alias("id"), F.lit("o").alias("origin"), F.when(F.col("event_id") % 2 == 0, "state").otherwise("my_session").alias("key"), F.when(F.col("event_id") % 2 == 0, doc).otherwise(plain).alias("value"))


register("X-1artifacts", lambda s, d: stored_values.Analysis(stored(s, d)).everything, """
    with e as (select event_id id, event_id % 2 = 0 json, user_id u from events),
    rows as (select id, unnest(case when json then [struct_pack(kind := 'url', "type" := null::varchar, found := 'https://h' || id || '.example.com/a?x=1'), struct_pack(kind := 'url', "type" := null, found := 'https://h' || id || '.example.com/a?x=1'), struct_pack(kind := 'email', "type" := null, found := 'u' || u || '@mail.org'), struct_pack(kind := 'email', "type" := null, found := 'u' || u || '@mail.org'),
        struct_pack(kind := 'identifier', "type" := 'user_id', found := 'u' || u), struct_pack(kind := 'token', "type" := 'refresh_token', found := repeat('ab', 20) || id)]
        else [struct_pack(kind := 'url', "type" := null, found := 'http://e.example.org/p'), struct_pack(kind := 'token', "type" := 'session', found := repeat('x', 30) || ' http%3A%2F%2Fe.example.org%2Fp ' || id)] end, recursive := true), json from e)
    select id, 'o' origin, case when json then 'state' else 'my_session' end "key", kind, "type", found from rows""")
register("X-5risk", lambda s, d: stored_values.Analysis(stored(s, d)).tokens.select("id", "token_type", "risk", "token_hash", "issuer"), """
    select event_id id, case when event_id % 2 = 0 then 'refresh_token' else 'session' end token_type, case when event_id % 2 = 0 then 'high' else 'medium' end risk, sha256(case when event_id % 2 = 0 then repeat('ab', 20) || event_id else repeat('x', 30) || ' http%3A%2F%2Fe.example.org%2Fp ' || event_id end) token_hash, null::varchar issuer from events""")
register("X-1identifiers", lambda s, d: stored_values.Analysis(stored(s, d)).identifiers.select("id", "identifier_type", "name", "value", F.unix_timestamp("seen").alias("seen")), "select event_id id, 'user_id' identifier_type, 'user_id' \"name\", 'u' || user_id \"value\", event_id + 1600000000 seen from events where event_id % 2 = 0")

# -- F-25, A-47, F-23, F-10e: indicators and sites with rows for every rule
INDICATORS = """select l_orderkey * 10 + l_linenumber as id, case l_linenumber % 6 when 0 then 'system:installed_software' when 1 then 'execution:user_assist' when 2 then 'startup:run_key' when 3 then 'startup:run_once_key' when 4 then 'startup:bho' else 'startup:service' end as type,
    concat('n', l_suppkey % 7) as name, case l_linenumber % 6 when 0 then '' when 1 then concat('Prog', l_partkey, '.exe') when 4 then concat('clsid', l_partkey % 9) else concat('Run', l_partkey % 11) end as value,
    case l_returnflag when 'A' then concat('HKLM/Run/', l_partkey) when 'N' then concat('NTUSER.DAT/Run/', l_partkey) else concat('Users/HKCU/RunOnce/', l_partkey) end as path, l_linestatus as hive,
    concat('{open}"name":"Tool ', l_partkey % 13, '","publisher":"Maker ', l_suppkey % 3, '","size_kb":', l_partkey, ',"forensic_interest":', case when l_suppkey % 2 = 0 then 'true' else 'false' end, ',"decoded_path":"C:/Apps/', l_partkey % 5, '.exe","run_count":', l_orderkey, '{close}') as extra_json from {lineitem}"""


def found_indicators(s, d):
    text = INDICATORS.format(open="{{", close="}}", lineitem="{lineitem}")
    rows = s.sql(text, lineitem=frame(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")]))
    return rows


DUCK_INDICATORS = "with lines as (select l_orderkey, l_linenumber, min(l_partkey) l_partkey, min(l_suppkey) l_suppkey, min(l_returnflag) l_returnflag, min(l_linestatus) l_linestatus from lineitem group by 1, 2), ind as (" + INDICATORS.format(open="{", close="}", lineitem="lines") + ") "
register("F-25software", lambda s, d: indicators.installed_software(found_indicators(s, d), "MAKER 1", True).select("id", "name", "publisher", "size_kb"),
         DUCK_INDICATORS + "select id, extra_json->>'name' \"name\", extra_json->>'publisher' publisher, (extra_json->>'size_kb')::bigint size_kb from ind where type = 'system:installed_software' and extra_json->>'publisher' = 'Maker 1' and extra_json->>'forensic_interest' = 'true'")
register("F-25executions", lambda s, d: indicators.app_executions(found_indicators(s, d), "apps/3").select("id", "decoded_path", "run_count", "forensic_interest"),
         DUCK_INDICATORS + "select id, extra_json->>'decoded_path' decoded_path, (extra_json->>'run_count')::bigint run_count, extra_json->>'forensic_interest' = 'true' forensic_interest from ind where type = 'execution:user_assist' and extra_json->>'decoded_path' like '%Apps/3%'")
register("A-47runs", lambda s, d: indicators.run_entries(found_indicators(s, d)), DUCK_INDICATORS + """
    , r as (select *, case when path like 'HKLM%' then 'HKLM' else 'HKCU' end scope, type = 'startup:run_once_key' or contains(path, 'RunOnce') once from ind where type in ('startup:run_key', 'startup:run_once_key'))
    select arg_min("name", id) "name", arg_min("value", id) command, case when count(distinct scope) = 1 then min(scope) else 'HKLM+HKCU' end scope, arg_min(once, id) is_run_once, arg_min(path, id) path from r group by lower("name"), lower("value")""")
register("A-47helpers", lambda s, d: indicators.helper_objects(found_indicators(s, d)), DUCK_INDICATORS + "select \"value\" clsid, arg_min(path, id) path from ind where type = 'startup:bho' group by 1")
register("A-47services", lambda s, d: indicators.services(found_indicators(s, d)), DUCK_INDICATORS + "select id, \"name\", \"value\" command, path from ind where type = 'startup:service'")
SITES = "select c_custkey as id, c_nationkey % 2 as evidence_id, c_name as origin, c_custkey % 17 as total_keys, case c_custkey % 4 when 0 then null when 1 then '' else c_mktsegment end as tags, case when c_custkey % 5 = 0 then 'broken' else concat('[\"', c_mktsegment, '\"]') end as browsers from {customer}"
register("F-23tagged", lambda s, d: indicators.stored_sites(s.sql(SITES, customer=frame(s, d, "customer")), 1, None, True).select("id", "total_keys", F.array_join("browsers", ",").alias("browsers")),
         f"select id, total_keys, case when id % 5 = 0 then '' else tags end browsers from ({SITES.format(customer='customer')}) where evidence_id = 1 and tags <> ''")

# -- A-38, W-8, A-43, S-15
DISCOVERIES = "select l_orderkey * 10 + l_linenumber as id, 1 as evidence_id, l_partkey as image_id, case l_suppkey % 4 when 0 then 'filesystem_images' when 1 then 'cache_simple' when 2 then 'safari' else 'carver' end as discovered_by, l_orderkey % 50 as discovered_at, concat('/p/', l_orderkey) as fs_path, case when l_linenumber % 3 = 0 then '' else concat('http://i/', l_orderkey % 9) end as cache_url, case when l_linenumber % 2 = 0 then l_orderkey end as fs_crtime, case when l_linenumber % 3 > 0 then l_orderkey + 1 end as fs_mtime from {lines}"


def discoveries(s, d):
    return s.sql(DISCOVERIES, lines=frame(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey")))


DUCK_DISCOVERIES = "with lines as (select l_orderkey, l_linenumber, min(l_partkey) l_partkey, min(l_suppkey) l_suppkey from lineitem group by 1, 2), disc as (" + DISCOVERIES.format(lines="lines") + ") "
register("A-38view", lambda s, d: indicators.image_sources(discoveries(s, d)), DUCK_DISCOVERIES + """
    select evidence_id, image_id, arg_min(discovered_by, (discovered_at, discovered_by)) first_discovered_by, string_agg(distinct discovered_by, ',' order by discovered_by) sources, count(distinct discovered_by) source_count, count(*) total_discoveries, max(fs_path) filter (discovered_by = 'filesystem_images') fs_path,
    bool_or(discovered_by in ('cache_simple', 'safari')) has_browser_source, string_agg(distinct discovered_by, ',' order by discovered_by) filter (discovered_by in ('cache_simple', 'safari')) browser_sources from disc group by 1, 2""")
register("W-8urls", lambda s, d: indicators.image_urls(discoveries(s, d)).select("image_id", F.array_join("urls", " ").alias("urls"), "file_date"), DUCK_DISCOVERIES + """
    , u as (select image_id, string_agg(cache_url, ' ' order by at0, id0) urls from (select image_id, cache_url, min((discovered_at, id))[1] at0, min((discovered_at, id))[2] id0 from disc where cache_url <> '' group by 1, 2) group by 1),
    f as (select image_id, arg_min(coalesce(fs_crtime, fs_mtime), id) file_date from disc where discovered_by = 'filesystem_images' and coalesce(fs_crtime, fs_mtime) is not null group by 1)
    select image_id, coalesce(urls, '') urls, file_date from u full join f using (image_id)""")
register("A-43tabs", lambda s, d: indicators.tab_histories(frame(s, d, "documents").selectExpr("doc_id as id", "lang as title"), frame(s, d, "conversations").selectExpr("conv_id as tab_id")), "select doc_id id, lang title, count(conv_id) entries from documents left join conversations on conv_id = doc_id group by 1, 2")
FAMILY = {"regions": [], "nations": ["regions"], "customers": ["nations"], "orders": ["customers"]}


def purged(s, d):
    path = new_folder(s, "purge")
    for name, table, key in (("regions", "region", "r_regionkey"), ("nations", "nation", "n_nationkey"), ("customers", "customer", "c_custkey")):
        frame(s, d, table).selectExpr(f"{key} as id", f"{key} % 3 as evidence_id").write.partitionBy("evidence_id").parquet(f"{path}/{name}")
    removed = indicators.purge(s, path, FAMILY, 1)
    left = [s.read.parquet(f"{path}/{name}").agg(F.count("*").alias("kept")).select(F.lit(name).alias("name"), "kept") for name in ("regions", "nations", "customers")]
    return removed.join(left[0].union(left[1]).union(left[2]), "name", "left")


register("S-15purge", purged, "select * from (select 3 place, 'regions' \"name\", count(*) filter (r_regionkey % 3 = 1) removed, count(*) filter (r_regionkey % 3 <> 1) kept from region union all select 2, 'nations', count(*) filter (n_nationkey % 3 = 1), count(*) filter (n_nationkey % 3 <> 1) from nation union all select 1, 'customers', count(*) filter (c_custkey % 3 = 1), count(*) filter (c_custkey % 3 <> 1) from customer union all select 0, 'orders', 0, null)")

# -- H-3 with hints and ranges, H-14 with roots given at run time
def in_years(seconds: str) -> str:
    """H-2 in SQL: seconds up to the year 3000."""
    return f"case when {seconds} > 0 and {seconds} <= 32503680000 then {seconds} end"


def by_range(n: str) -> str:
    """H-3 in SQL: the epoch that the range of a whole number speaks for."""
    return f"case when {n} > 116444736000000000 then {in_years(f'(({n}) // 10000000 - 11644473600)')} when {n} > 11644473600000000 then {in_years(f'(({n}) // 1000000 - 11644473600)')} when {n} > 0 and {n} < 4102444800 then {n} when {n} > 1000000000000 then {in_years(f'(({n}) // 1000)')} end"


register("H-3hints", lambda s, d: frame(s, d, "orders").select("o_orderkey", *[F.unix_timestamp(S.hinted(F.col("o_orderkey") * 10_000_000 + F.lit(n), hint)).alias(name) for name, n, hint in (("filetime", 132_000_000_000_000_000, "filetime"), ("webkit", 13_000_000_000_000_000, "webkit"), ("by_filetime", 132_000_000_000_000_000, None), ("by_webkit", 13_000_000_000_000_000, None), ("by_millis", 1_600_000_000_000, None))], F.unix_timestamp(S.hinted(F.col("o_orderkey") + 1_500_000_000)).alias("by_seconds"), F.unix_timestamp(S.hinted(F.col("o_orderkey") % 40_000 + F.lit(0.25))).alias("by_days")), f"""
    select o_orderkey, {in_years("o_orderkey + 13200000000 - 11644473600")} filetime, {in_years("o_orderkey * 10 + 13000000000 - 11644473600")} webkit, {by_range("o_orderkey * 10000000 + 132000000000000000")} by_filetime, {by_range("o_orderkey * 10000000 + 13000000000000000")} by_webkit, {by_range("o_orderkey * 10000000 + 1600000000000")} by_millis, {by_range("o_orderkey + 1500000000")} by_seconds, (o_orderkey % 40000 - 25569) * 86400 + 21600 by_days from orders""")
ROOTED = "concat('C:\\\\Apps\\\\tool', cast(o_custkey % 20 as {string}), case o_orderkey % 3 when 0 then '/Cache/x' when 1 then 'x/Cache' else '/Google/Chrome/User Data/x' end)"
register("H-14roots", lambda s, d: B.in_roots(frame(s, d, "orders").selectExpr("o_orderkey as id", ROOTED.replace("{string}", "string") + " as path"), frame(s, d, "customer").where("c_custkey < 10").selectExpr("concat('c:/apps//TOOL', c_custkey, '/') as root")),
         "select o_orderkey id, case when o_orderkey % 3 = 2 then 'chrome' when o_orderkey % 3 = 0 and o_custkey % 20 < 10 and o_custkey % 20 in (select c_custkey from customer) then 'chromium_embedded' end browser from orders")


# -- N-1 in the second layout, N-9 with accounts and devices
def place_trees(s, d):
    place = "named_struct('type', 'text/x-moz-place', 'title', c_name, 'uri', concat('http://c/', c_custkey), 'guid', concat('g', c_custkey), 'dateAdded', c_custkey * 1000000)"
    return frame(s, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("id")).agg(F.to_json(F.expr(f"named_struct('type', 'text/x-moz-place-container', 'title', '', 'children', array(named_struct('type', 'text/x-moz-place-container', 'title', 'Menu', 'children', collect_list({place}))))")).alias("doc"))


register("N-1places", lambda s, d: accounts.place_bookmarks(place_trees(s, d)).select("id", "name", "url", "folder", "guid", F.unix_timestamp("added").alias("added")), "select c_nationkey::bigint id, c_name \"name\", 'http://c/' || c_custkey url, 'Bookmarks Menu' folder, 'g' || c_custkey guid, case when c_custkey > 0 then c_custkey end added from customer")


def preference_files(s, d):
    account = "named_struct('account_id', concat('a', c_custkey), 'email', concat('m', c_custkey, '@x.org'), 'full_name', c_name, 'hd', c_mktsegment, 'is_child_account', c_custkey % 2 = 0)"
    rows = frame(s, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("id")).agg(F.to_json(F.expr(f"named_struct('account_info', array_sort(collect_list({account})), 'google', named_struct('services', named_struct('username', concat('s', min(c_nationkey), '@x.org'), 'account_id', 'sid')), 'sync', named_struct('bookmarks', true, 'tabs', false, 'autofill', true, 'has_setup_completed', min(c_nationkey) % 2 = 0, 'last_synced_time', cast(13000000000000000 + min(c_nationkey) * 1000000 as string), 'devices', map(concat('dev', min(c_nationkey)), named_struct('name', 'Box', 'os', 'linux'))))")).alias("doc"))
    return rows


register("N-9accounts", lambda s, d: accounts.preference_accounts(preference_files(s, d)).select("id", "account_id", "email", "display_name", "hosted_domain", "is_child", "sync_enabled", "synced_types", F.unix_timestamp("last_sync").alias("last_sync")), """
    with a as (select c_nationkey::bigint id, 'a' || c_custkey account_id, 'm' || c_custkey || '@x.org' email, c_name display_name, c_mktsegment hosted_domain, c_custkey % 2 = 0 is_child from customer union all select distinct c_nationkey, 'sid', 's' || c_nationkey || '@x.org', '', '', false from customer)
    select *, id % 2 = 0 sync_enabled, case when id % 2 = 0 then 'autofill,bookmarks,has_setup_completed' else 'autofill,bookmarks' end synced_types, id + 13000000000 - 11644473600 last_sync from a""")
register("N-9devices", lambda s, d: accounts.preference_devices(preference_files(s, d)).select("id", "device_id", "name", "kind", "system", "account_id"), "select c_nationkey::bigint id, 'dev' || c_nationkey device_id, 'Box' \"name\", 'unknown' kind, 'linux' \"system\", min('a' || c_custkey) account_id from customer group by c_nationkey")


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
