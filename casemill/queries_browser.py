"""Registered queries of the browser, registry and report operators, each with the DuckDB SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from casemill.functions import browser as B
from casemill.functions import codes
from casemill.functions import scalars as S
from casemill.operators import artifacts, filters, matching, nested, records, system, tags, timeline
from casemill.operators.filters import TableSpec
from casemill.plans import plugins
from casemill.plans.standins import frame, with_views
from casemill.queries import ALL_OPS, event_rows, mapped_sql, mapped_table
from casemill.sources import readers

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, run, sql: str, *views: str) -> None:
    QUERIES[name] = run
    ORACLES[name] = with_views(sql, *views) if views else sql


def of(table: str, *exprs: str):
    return lambda s, d: frame(s, d, table).selectExpr(*exprs)


# -- paths and rules
PATHS = "concat('/Users/u', o_custkey, '/AppData/Local', case o_orderkey % 4 when 0 then '/Google/Chrome/User Data/Profile 2' when 1 then '/Microsoft/Edge Beta/User Data' when 2 then '//Tool/Default' else '/Other' end, case o_orderkey % 3 when 0 then '/History' when 1 then '/Network/Cookies' else '/Local Storage/leveldb/000003.log' end)"
FILES = of("orders", "o_orderkey", f"{PATHS} as path")
register("H-14", lambda s, d: FILES(s, d).select("o_orderkey", B.browser(F.col("path")).alias("browser"), B.profile(F.col("path")).alias("profile")),
         "select o_orderkey, case o_orderkey % 4 when 0 then 'chrome' when 1 then 'edge_beta' end browser, case when o_orderkey % 4 = 0 then 'Profile 2' else 'Default' end profile from orders")
PERMISSIONS = of("orders", "o_orderkey", "array(case o_orderkey % 4 when 0 then 'proxy' when 1 then 'tabs' when 2 then 'storage' else 'odd' end) as permissions", "case when o_custkey % 7 = 0 then array('*://a.example/*') end as hosts")
register("H-16", lambda s, d: PERMISSIONS(s, d).select("o_orderkey", B.extension_risk(F.col("permissions"), F.col("hosts")).alias("risk")),
         "select o_orderkey, case when o_orderkey % 4 = 0 then 'critical' when o_custkey % 7 = 0 or o_orderkey % 4 = 1 then 'high' when o_orderkey % 4 = 2 then 'medium' else 'low' end risk from orders")
SIGNAL = lambda s, d: FILES(s, d).withColumn("signal", B.signal(F.col("path"), S.file_name(F.col("path"))))
SIGNAL_SQL = "case o_orderkey % 3 when 0 then 'history' when 1 then 'cookies' else 'local_storage' end"
register("H-17", lambda s, d: SIGNAL(s, d).select("o_orderkey", "signal"), f"select o_orderkey, {SIGNAL_SQL} signal from orders")
ROOT_SQL = "concat('/Users/u', o_custkey, '/AppData/Local', case o_orderkey % 4 when 0 then '/Google/Chrome/User Data{a}' when 1 then '/Microsoft/Edge Beta/User Data' when 2 then '/Tool{b}' else '/Other' end)"
register("H-18", lambda s, d: SIGNAL(s, d).withColumn("root", B.profile_root(F.col("path"), F.col("signal"))).select("o_orderkey", "root", B.application_root(F.col("root")).alias("application")),
         f"select o_orderkey, {ROOT_SQL.format(a='/Profile 2', b='/Default')} root, {ROOT_SQL.format(a='', b='')} application from orders")
register("A-44roots", lambda s, d: records.roots(SIGNAL(s, d).withColumn("root", B.application_root(B.profile_root(F.col("path"), F.col("signal")))).where(B.browser(F.col("path")).isNull()), []),
         f"select {ROOT_SQL.format(a='', b='')} root, string_agg(distinct {SIGNAL_SQL}, ',' order by {SIGNAL_SQL}) signals, count(distinct {SIGNAL_SQL}) n from orders where o_orderkey % 4 >= 2 group by 1 having count(distinct {SIGNAL_SQL}) >= 2")
register("H-19", lambda s, d: of("part", "p_partkey", "concat(case p_size % 4 when 0 then 'Time Freeze ' when 1 then 'CCleaner ' else 'Plain ' end, p_name) as name", "case when p_size % 8 = 3 then 'Faronics Ltd' end as publisher")(s, d).select("p_partkey", B.software_kind(F.col("name"), F.col("publisher")).alias("kind"), B.program_kind(F.col("name")).alias("program")),
         "select p_partkey, case when p_size % 4 = 0 then 'system_restore' when p_size % 4 = 1 then 'anti_forensic' when p_size % 8 = 3 then 'forensic_interest' end kind, case when p_size % 4 = 1 then 'wiping_tool' end program from part")
BYTES = "concat('00000000', lpad(hex(o_custkey % 256), 2, '0'), '000000', case when o_orderkey % 2 = 0 then repeat('00', 64) else repeat('00', 8) end)"
register("H-20", lambda s, d: of("orders", "o_orderkey", "o_orderpriority", f"{BYTES} as digits")(s, d).select("o_orderkey", B.run_history(F.col("o_orderpriority"), F.col("digits")).alias("r")).select("o_orderkey", "r.path", "r.runs", "r.focus"),
         "select o_orderkey, translate(o_orderpriority, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm') path, case when o_orderkey % 2 = 0 then o_custkey % 256 else greatest(o_custkey % 256 - 5, 0) end runs, case when o_orderkey % 2 = 0 then 0::bigint end focus from orders")
register("H-23", lambda s, d: of("orders", "o_orderkey", "concat('^userContextId=', o_custkey, '&partitionKey=(https,', o_orderpriority, ')', case when o_orderkey % 2 = 0 then '&privateBrowsingId=x' else '&privateBrowsingId=1' end) as text")(s, d).select("o_orderkey", B.origin_attributes(F.col("text")).alias("r")).select("o_orderkey", "r.*"),
         "select o_orderkey, o_custkey::int user_context_id, case when o_orderkey % 2 = 1 then 1 end private_browsing_id, null::varchar first_party_domain, '(https,' || o_orderpriority || ')' partition_key from orders")
register("H-25", lambda s, d: of("orders", "o_orderkey", "case o_orderkey % 4 when 0 then concat('[\"', o_custkey, '\", ', \"'x']\") when 1 then '0' when 2 then '@dll' else o_orderstatus end as value", "case when o_orderkey % 8 = 1 then 'network:proxy_settings' else 'network:dns_server' end as kind", "concat('A/', o_custkey, '/App Paths/', o_orderstatus, '.exe/v') as path")(s, d).select("o_orderkey", B.network_value(F.col("value"), F.col("kind")).alias("value"), B.entry_name(F.col("kind"), F.col("kind"), F.lit(None).cast("string"), F.col("path")).alias("name"), B.app_path(F.col("path")).alias("program"), F.translate(B.profile_key(F.col("path")), "\\", "/").alias("key")),
         "select o_orderkey, case when o_orderkey % 4 = 0 then o_custkey || ', x' when o_orderkey % 8 = 1 then 'Disabled' when o_orderkey % 4 = 3 then o_orderstatus else '' end \"value\", 'v' \"name\", o_orderstatus || '.exe' program, 'A/' || o_custkey || '/App Paths/' || o_orderstatus || '.exe' \"key\" from orders")
register("X-11", lambda s, d: of("orders", "o_orderkey", "case when o_orderkey % 5 = 0 then concat('http://p/', o_orderkey) else '' end as url", "case when o_orderkey % 5 = 1 then concat('edge:?s=1&URL=https%3A%2F%2Fd%2F', o_orderkey, '&t=2') end as destination", "case when o_orderkey % 5 = 2 then concat('-url http://a/', o_orderkey, ' -x') end as arguments", "case when o_orderkey % 5 = 3 then concat('see HTTP://t/', o_orderkey) end as target")(s, d).select("o_orderkey", B.shortcut_url(*map(F.col, ("url", "destination", "arguments", "target"))).alias("found")),
         "select o_orderkey, case o_orderkey % 5 when 0 then 'http://p/' || o_orderkey when 1 then 'https://d/' || o_orderkey when 2 then 'http://a/' || o_orderkey when 3 then 'HTTP://t/' || o_orderkey end found from orders")
#: For each group of code tables its domains; codes are spread over known and unknown ones.
CODES = {"a": ("download_state", "download_danger", "download_interrupt"), "b": ("visit_type", "hidden"), "c": ("chromium_samesite", "chromium_priority", "chromium_source_scheme"), "d": ("firefox_samesite", "firefox_scheme_map"), "e": ("chromium_permission",), "f": ("firefox_permission", "expire_type"), "g": ("signed_state",), "h": ("icon_type",)}


def code_sql(domain: str) -> str:
    whens = " ".join(f"when {k} then '{v}'" for k, v in codes.LABELS[domain].items())
    rest = f"'{codes.DEFAULTS[domain]}'" if domain in codes.DEFAULTS else "'unknown_' || (o_orderkey % 55 - 2)"
    return f"case o_orderkey % 55 - 2 {whens} else {rest} end {domain}"


for part, domains_of in CODES.items():
    register(f"H-22{part}", lambda s, d, domains_of=domains_of: of("orders", "o_orderkey", "o_orderkey % 55 - 2 as code")(s, d).select("o_orderkey", *[codes.label(x, F.col("code")).alias(x) for x in domains_of]), f"select o_orderkey, {', '.join(map(code_sql, domains_of))} from orders")

# -- nested documents
NODE = "named_struct('type', 'url', 'name', o_orderstatus, 'url', concat('http://b/', o_orderkey), 'date_added', cast((o_orderkey + 13000000000) * 1000000 as string))"
TREES = lambda s, d: frame(s, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.to_json(F.expr(f"named_struct('roots', named_struct('bookmark_bar', named_struct('type', 'folder', 'name', 'bar', 'children', array(named_struct('type', 'folder', 'name', 'in', 'children', collect_list({NODE}))))))")).alias("doc"))
register("N-1", lambda s, d: nested.bookmarks(TREES(s, d)).select("id", "name", "url", "kind", "folder", F.unix_timestamp("added").alias("added")),
         "select o_custkey id, o_orderstatus \"name\", 'http://b/' || o_orderkey url, 'url' kind, 'Bookmarks Bar/bar/in' folder, o_orderkey + 13000000000 - 11644473600 added from orders union all select distinct o_custkey, 'bar', null, 'folder', 'Bookmarks Bar', null::bigint from orders union all select distinct o_custkey, 'in', null, 'folder', 'Bookmarks Bar/bar', null::bigint from orders")
MAPS = of("events", "event_id as id", "concat('{\"p\": {\"', event_type, '\": {\"https://h', user_id, ',*\": {\"setting\": ', case event_id % 3 when 0 then '1' when 1 then concat('{\"rawScore\": ', user_id, '}') else '\"x\"' end, ', \"last_modified\": \"', (event_id + 13000000000) * 1000000, '\"}}, \"flat\": 1}}') as doc")
register("N-2", lambda s, d: nested.engagement(MAPS(s, d), ["click", "view"], "$.p").select("id", "kind", "origin", "score", F.unix_timestamp("modified").alias("modified")), "select event_id id, event_type kind, 'https://h' || user_id || ',*' origin, user_id::double score, event_id + 13000000000 - 11644473600 modified from events where event_id % 3 = 1 and event_type in ('click', 'view')")
register("N-3", lambda s, d: nested.permissions(MAPS(s, d), "$.p").select("id", "kind", "origin", "code", "permission", F.unix_timestamp("modified").alias("modified")), "select event_id id, event_type kind, 'https://h' || user_id || ',*' origin, 1 code, 'allow' permission, event_id + 13000000000 - 11644473600 modified from events where event_id % 3 = 0")
STS = "named_struct('host', case when o_orderkey % 6 > 0 then concat('h', o_orderkey) else '' end, 'sts_observed', o_orderkey + 1500000000, 'expiry', o_orderkey + 1600000000, 'sts_include_subdomains', o_orderkey % 2 = 0)"
register("N-4", lambda s, d: nested.strict_transport(frame(s, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.to_json(F.expr(f"named_struct('sts', collect_list({STS}))")).alias("doc"))).select("id", "host", F.unix_timestamp("observed").alias("observed"), F.unix_timestamp("expires").alias("expires"), "mode", "subdomains"),
         "select o_custkey id, 'h' || o_orderkey host, o_orderkey + 1500000000 observed, o_orderkey + 1600000000 expires, 'force-https' \"mode\", o_orderkey % 2 = 0 subdomains from orders where o_orderkey % 6 > 0")
LISTS = lambda s, d: frame(s, d, "part").groupBy(F.col("p_size").alias("id")).agg(F.to_json(F.expr("named_struct('addons', collect_list(named_struct('id', cast(p_partkey as string), 'name', case when p_partkey % 3 > 0 then p_name else '' end)))")).alias("doc"))
register("N-5", lambda s, d: nested.with_metadata(nested.listed(LISTS(s, d), "$.addons", {"extension": "$.id", "name": "$.name"}).drop("pos"), frame(s, d, "part").where("p_partkey % 2 = 0").selectExpr("cast(p_partkey as string) as extension", "p_brand as name"), ["name"]),
         "select p_size id, p_partkey::varchar extension, case when p_partkey % 3 > 0 then p_name when p_partkey % 2 = 0 then p_brand end \"name\" from part")
register("N-7", lambda s, d: nested.form_fields(of("orders", "o_orderkey as id", "concat('{\"url\": \"http://u/', o_custkey, '\", \"formdata\": {\"id\": {\"a\": \"', o_orderstatus, '\", \"b\": \"\"}, \"xpath\": {\"/x\": ', o_custkey, '}}}') as doc")(s, d)),
         "select o_orderkey id, 'http://u/' || o_custkey url, 'id' field_type, 'a' \"name\", o_orderstatus \"value\" from orders union all select o_orderkey, 'http://u/' || o_custkey, 'xpath', '/x', o_custkey::varchar from orders where o_custkey <> 0")
SEEN = {"tab": "click", "history": "view", "closed": "error"}
register("N-8", lambda s, d: nested.session_urls({kind: of("events", "event_type", "concat(case when event_id % 4 = 0 then 'about:' else 'http://e/' end, user_id) as url", "case when event_id % 2 = 0 then event_type end as title", "event_id as seen")(s, d).where(F.col("event_type") == e) for kind, e in SEEN.items()}),
         "select 'http://e/' || user_id url, case when event_id % 2 = 0 then event_type else '' end title, event_id seen, case event_type when 'click' then 'tab' when 'view' then 'history' else 'closed' end source from events where event_id % 4 > 0 and event_type in ('click', 'view', 'error')")
DEVICES = lambda s, d: frame(s, d, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.to_json(F.expr("named_struct('sync', named_struct('devices', collect_list(named_struct('guid', c_custkey, 'info', named_struct('name', c_name)))))")).alias("doc"))
register("N-9", lambda s, d: nested.listed(DEVICES(s, d), "$.sync.devices", {"guid": "$.guid", "name": "$.info.name"}).drop("pos"), "select c_nationkey id, c_custkey::varchar guid, c_name \"name\" from customer")
STATES = of("orders", "case when o_orderkey % 9 = 0 then 'odd line' else concat_ws(char(9), concat('h', o_orderkey, ':HSTS'), '0', cast(19000 + o_custkey % 100 as string), concat(o_orderkey + 1600000000000, ',', o_orderkey % 2, ',1')) end as value")
register("N-10", lambda s, d: nested.security_states(STATES(s, d)).select("host", "kind", "score", F.unix_timestamp("accessed").alias("accessed"), F.unix_millis("expires").alias("expires"), "state", "mode", "subdomains"),
         "select 'h' || o_orderkey host, 'HSTS' kind, 0::bigint score, (19000 + o_custkey % 100) * 86400 accessed, o_orderkey + 1600000000000 expires, o_orderkey % 2 state, case when o_orderkey % 2 = 0 then 'force-https' else 'knockout' end \"mode\", 1::bigint subdomains from orders where o_orderkey % 9 > 0")
register("N-11", lambda s, d: nested.config_lines(of("orders", "o_orderkey", "case when o_orderkey % 5 = 0 then '# none' else concat('  Dir', o_orderkey % 3, '  v ', o_custkey, ' # c') end as value")(s, d)), "select o_orderkey, 'Dir' || o_orderkey % 3 directive, 'v ' || o_custkey setting from orders where o_orderkey % 5 > 0")
register("N-11guard", lambda s, d: of("orders", "o_orderkey", "concat('Guard in=g', o_custkey, case when o_orderkey % 2 = 0 then ' rsa_id=F' else '' end, ' sampled_on=2024-01-02T03:04:05') as line")(s, d).select("o_orderkey", nested.guard(F.col("line")).alias("g")).select("o_orderkey", "g.name", "g.fingerprint", F.unix_timestamp("g.sampled_on").alias("sampled")),
         "select o_orderkey, 'g' || o_custkey \"name\", case when o_orderkey % 2 = 0 then 'F' end fingerprint, 1704164645::bigint sampled from orders")
BLOCK = "array_join(array('n', concat('v', o_orderkey), concat(o_orderstatus, '/p'), '0', cast(30000000 as string), '0', '0', cast(o_orderkey % 4 as string)), char(10))"
register("N-13", lambda s, d: nested.cookie_blocks(frame(s, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.array_join(F.collect_list(F.expr(BLOCK)), "\n*\n").alias("text"))).withColumn("expires", F.unix_timestamp("expires")),
         "select o_custkey id, 'n' \"name\", 'v' || o_orderkey \"value\", o_orderstatus \"domain\", '/p' path, (30000000 * 4294967296 // 10000000 - 11644473600)::bigint expires, o_orderkey % 2 = 1 secure, o_orderkey % 4 >= 2 http_only from orders")
LINE = "concat_ws(char(9), o_orderstatus, 'TRUE', '/', case when o_orderkey % 2 = 0 then 'TRUE' else 'FALSE' end, cast(o_orderkey as string), 'n', concat('v', o_orderkey))"
register("N-13lines", lambda s, d: nested.cookie_lines(frame(s, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.concat(F.lit("# file\n"), F.array_join(F.collect_list(F.expr(LINE)), "\n")).alias("text"))).withColumn("expires", F.unix_timestamp("expires")),
         "select o_custkey id, 'n' \"name\", 'v' || o_orderkey \"value\", o_orderstatus \"domain\", '/' path, nullif(o_orderkey, 0) expires, o_orderkey % 2 = 0 secure, false http_only from orders")
register("N-14", lambda s, d: nested.shortcuts(of("orders", "concat('/Users/u/Favorites/', case when o_orderkey % 2 = 0 then 'a/b/' else '' end, o_orderkey, '.url') as path", "concat('[InternetShortcut]', char(10), case when o_orderkey % 3 = 0 then 'X=1' else concat('URL=http://f/', o_custkey) end) as text")(s, d)),
         "select '/Users/u/Favorites/' || case when o_orderkey % 2 = 0 then 'a/b/' else '' end || o_orderkey || '.url' path, o_orderkey::varchar title, 'http://f/' || o_custkey url, case when o_orderkey % 2 = 0 then 'a/b' else '' end folder from orders where o_orderkey % 3 > 0")

# -- operating system
INDICATORS = of("orders", "o_orderkey as id", "case o_orderkey % 4 when 0 then 'system:user_profile' when 1 then 'system:local_user' when 2 then 'system:user_account' else 'system:installed_software' end as type", "'x' as name",
                "case o_orderkey % 4 when 2 then concat('C:/Users/u', o_custkey) when 3 then o_orderpriority else case when o_custkey % 10 = 0 then 'Public' else concat('u', o_custkey) end end as value", "concat('P/', o_custkey, '/', o_orderkey) as path", "concat('{\"profile_path\": \"C:/', o_orderkey, '\", \"version\": \"', o_orderkey, '\", \"install_date\": \"d\", \"forensic_interest\": ', o_orderkey % 8 = 3, '}') as extra_json")
PEOPLE = "(select o_orderkey id, o_orderkey % 4 k, o_orderkey, o_custkey, case when o_custkey % 10 = 0 and o_orderkey % 4 < 2 then 'Public' else 'u' || o_custkey end username from orders where o_orderkey % 4 < 3)"
register("A-45", lambda s, d: system.users(INDICATORS(s, d)),
         f"select username, coalesce(arg_min(case when k = 2 then 'C:/Users/u' || o_custkey else 'C:/' || o_orderkey end, id) filter (where k <> 1), '') profile_path, coalesce(arg_min('P/' || o_custkey || '/' || o_orderkey, id) filter (where k <> 1), '') path, bool_or(k = 1) \"local\" from {PEOPLE} where username <> 'Public' group by 1")
register("A-46", lambda s, d: system.software(INDICATORS(s, d)),
         "select o_orderpriority \"name\", min(o_orderkey)::varchar \"version\", 'd' installed, null::varchar publisher, min(o_orderkey) % 8 = 3 interest, arg_min('P/' || o_custkey || '/' || o_orderkey, o_orderkey) path from orders where o_orderkey % 4 = 3 group by 1")
register("A-48", lambda s, d: system.network_profiles(of("lineitem", "l_orderkey * 10 + l_linenumber as id", "l_returnflag as type", "concat(l_linestatus, l_orderkey) as value", "concat('k', l_suppkey, '/', l_linenumber) as path")(s, d), ["A", "R"]),
         "select 'k' || l_suppkey profile, arg_max(l_linestatus || l_orderkey, l_orderkey * 10 + l_linenumber) filter (where l_returnflag = 'A') A, arg_max(l_linestatus || l_orderkey, l_orderkey * 10 + l_linenumber) filter (where l_returnflag = 'R') R from lineitem where l_returnflag in ('A', 'R') group by 1")
register("A-49", lambda s, d: system.facts(of("events", "event_id as id", "event_type as type", "cast(user_id as string) as value")(s, d), ("view", "click", "signup")), "select case event_type when 'view' then 0 when 'click' then 1 else 2 end place, event_type \"type\", arg_min(user_id::varchar, event_id) \"value\" from events where event_type in ('view', 'click', 'signup') group by 2, 1")
register("A-49runs", lambda s, d: system.executions(of("lineitem", "l_partkey as path", "l_linenumber as runs", "l_orderkey as last_run")(s, d)), "select l_partkey path, sum(l_linenumber)::bigint runs, max(l_orderkey) last_run from lineitem group by 1")

# -- joins, tags, sources, reports
register("J-17b", lambda s, d: artifacts.attached(frame(s, d, "events"), frame(s, d, "customer"), "user_id", "c_custkey", {"origin": "c_name"}).select("event_id", "origin"), "select event_id, c_name origin from events left join customer on user_id = c_custkey")
register("J-17c", lambda s, d: artifacts.attached(frame(s, d, "lineitem"), frame(s, d, "orders"), "l_orderkey", "o_orderkey", {"o_orderstatus": "o_orderstatus"}, "inner").select("l_orderkey", "l_linenumber", "o_orderstatus"), "select l_orderkey, l_linenumber, o_orderstatus from lineitem join orders on l_orderkey = o_orderkey")
NAME_RULES = [("known", 0, "Standard", "(?i)^standard"), ("known", 1, "Small", "(?i)small")]
register("J-20", lambda s, d: matching.known_names(of("part", "p_partkey as id", "p_brand as key", "p_type as label")(s, d), s.createDataFrame([("Brand#11", "eleven"), ("Brand#23", "other")], "key string, name string"), NAME_RULES),
         "select p_partkey id, case when p_brand = 'Brand#11' then 'eleven' when p_brand = 'Brand#23' then 'other' when p_type ilike 'standard%' then 'Standard' when p_type ilike '%small%' then 'Small' end \"name\" from part")
register("J-21", lambda s, d: matching.applications(of("orders", "o_orderkey as id", "lower(o_orderpriority) as appid")(s, d), s.createDataFrame([("1-URGENT", "First", "browsers"), ("2-HIGH", "Second", "tools")], "appid string, application string, category string")),
         "select o_orderkey id, lower(o_orderpriority) appid, case o_orderpriority when '1-URGENT' then 'First' when '2-HIGH' then 'Second' else 'Unknown' end application, case o_orderpriority when '1-URGENT' then 'browsers' when '2-HIGH' then 'tools' else 'unknown' end category, o_orderpriority = '1-URGENT' is_browser from orders")
#: The artifact types that carry tags; each is a residue class of the tagged customers here.
TAGGED = ("url", "image", "file_list", "cookie", "bookmark", "browser_download", "autofill", "credential", "session_tab", "site_permission", "media_playback")


def typed_tags(s, d):
    kind = F.get(F.array(*map(F.lit, TAGGED)), (F.col("artifact_id") % len(TAGGED)).cast("int"))
    return frame(s, d, "associations").where("artifact_type = 'customer'").select("tag", kind.alias("artifact_type"), "artifact_id")


for place, kind in enumerate(TAGGED):
    register(f"J-24a{kind}", lambda s, d, kind=kind: tags.tag_text(typed_tags(s, d), kind), f"select artifact_id id, string_agg(distinct tag, ', ' order by tag) tags from associations where artifact_type = 'customer' and artifact_id % {len(TAGGED)} = {place} group by 1", "associations")
register("F-11", lambda s, d: filters.matched(frame(s, d, "files").withColumn("kind", S.file_type(S.extension(F.col("file_path")))).where((F.col("kind") != "other") & F.col("source").ilike("%1%")), frame(s, d, "matches"), "unmatched").select("id", "kind", "source"),
         "select id, case id % 4 when 0 then 'image' when 1 then 'document' else 'archive' end kind, source from files where id % 4 < 3 and source ilike '%1%' and id not in (select id from matches)", "files", "matches")
COUNTED = ("orders", "events", "documents", "pages")
register("S-15", lambda s, d: readers.row_counts({t: frame(s, d, t) for t in COUNTED}), " union all ".join(f"select '{t}' \"name\", count(*) n from {t}" for t in COUNTED))
register("S-15purge", lambda s, d: readers.purged({"urls": frame(s, d, "urls")}, 1)["urls"].select("id", "evidence_id"), "select id, evidence_id from urls where evidence_id <> 1", "urls")

MAPPER = "U-1f"  # named at run time from the registry of sources
register("P-4", lambda s, d: event_rows(timeline.mapped(mapped_table(s, d, MAPPER), timeline.SOURCES[MAPPER])), mapped_sql(MAPPER))
STORES = {"local": "F", "session": "O", "indexed": "P"}
register("U-3", lambda s, d: records.store_rollup({k: frame(s, d, "orders").where(F.col("o_orderstatus") == v).select("o_custkey") for k, v in STORES.items()}, "o_custkey").select("o_custkey"), "select distinct o_custkey from orders where o_orderstatus in ('F', 'O', 'P')")


@plugins.producer("domains")
def domains(files):
    return files.groupBy("domain").agg(F.count("*").alias("n"))


@plugins.producer("schemes")
def schemes(files):
    return files.groupBy("scheme").agg(F.count("*").alias("n"))


register("P-1", lambda s, d: plugins.produced(frame(s, d, "urls"), ["domains", "schemes"]), "select domain, null scheme, count(*) n from urls group by 1 union all select null, scheme, count(*) from urls group by 2", "urls")
register("P-2", lambda s, d: plugins.hooked(frame(s, d, "urls").select("id", "domain"), {"domain": F.upper("domain")}), "select id, upper(domain) as domain from urls", "urls")
REPORT = plugins.Report(TableSpec("urls", {"domain": ALL_OPS}, ("n", "discovered_by")), lambda df: df.groupBy("discovered_by").agg(F.count("*").alias("n")))
register("P-3", lambda s, d: REPORT.run(frame(s, d, "urls"), [("domain", "LIKE", "%example%")], [("n", "DESC"), ("discovered_by", "ASC")]), "select discovered_by, count(*) n from urls where domain ilike '%example%' group by 1", "urls")


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
