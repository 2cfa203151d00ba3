"""Rules over paths, permissions, software names and stored binary values, all as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.functions import scalars as S

# Browsers by fragments of the lower-cased path, in the order in which they are tried.
BROWSERS = (
    ("chrome_canary", ("/google/chrome sxs/", "/google/chrome canary/", "google-chrome-canary")),
    ("chrome_beta", ("/google/chrome beta/", "google-chrome-beta")),
    ("chrome_dev", ("/google/chrome dev/", "google-chrome-unstable")),
    ("chrome", ("/google/chrome/", "google-chrome")),
    ("edge_canary", ("/microsoft/edge sxs/", "/microsoft/edge canary/", "microsoft-edge-canary")),
    ("edge_beta", ("/microsoft/edge beta/", "microsoft-edge-beta")),
    ("edge_dev", ("/microsoft/edge dev/", "microsoft-edge-dev")),
    ("edge", ("/microsoft/edge/", "microsoft-edge")),
    ("brave_nightly", ("brave-browser-nightly",)),
    ("brave_beta", ("brave-browser-beta",)),
    ("brave", ("/bravesoftware/brave-browser/", "/brave-browser")),
    ("opera_gx", ("opera gx", "operagx")),
    ("opera", ("/opera software/", "/.config/opera", "com.operasoftware.opera")),
    ("chromium", ("/chromium/", "appdata/local/chromium/user data")),
    ("vivaldi", ("vivaldi",)),
)
# Names of files and folders inside a profile, of profiles, and of folders that hold profiles.
IN_PROFILE = (
    "history", "cookies", "bookmarks", "preferences", "web data", "login data", "transportsecurity", "sync data", "media history",
    "extensions", "cache", "network", "local storage", "session storage", "indexeddb", "favicons", "top sites",
)
PROFILES = ("default", "guest profile", "system profile")
PROFILE_PARENTS = (
    "google-chrome", "google-chrome-beta", "google-chrome-unstable", "google-chrome-canary", "microsoft-edge", "microsoft-edge-beta", "microsoft-edge-dev",
    "microsoft-edge-canary", "chromium", "brave-browser", "brave-browser-beta", "brave-browser-nightly", "opera", "opera-gx",
)
# Extension permissions by risk, and host patterns of high risk.
RISKS = {
    "critical": ("<all_urls>", "webRequest", "webRequestBlocking", "nativeMessaging", "debugger", "proxy", "management", "privacy", "browsingData"),
    "high": ("tabs", "history", "cookies", "downloads", "bookmarks", "topSites", "sessions", "webNavigation", "clipboardRead", "clipboardWrite", "geolocation", "identity", "declarativeNetRequest", "declarativeNetRequestWithHostAccess", "scripting"),
    "medium": ("storage", "unlimitedStorage", "notifications", "alarms", "activeTab", "contextMenus", "background", "idle", "power", "system.cpu", "system.memory", "system.storage", "tabCapture", "desktopCapture", "pageCapture", "fontSettings"),
}
RISKY_HOSTS = ("<all_urls>", "*://*/*", "*://*.google.com/*", "*://*.facebook.com/*", "*://*.paypal.com/*", "*://*.amazon.com/*", "http://*/*", "https://*/*")
# Endings of paths by the signal that they are.
SIGNALS = {
    "cookies": ("/network/cookies", "/cookies"),
    "history": ("/history",),
    "web_data": ("/web data",),
    "preferences": ("/preferences",),
    "visited_links": ("/visited links",),
    "cache": ("/cache/cache_data/index", "/cache/index"),
}
# Software of interest, in order, and kinds of programs in the run history, in order.
SOFTWARE = ("deep freeze", "faronics", "shadow defender", "reboot restore", "rollback rx", "time freeze", "toolwiz time freeze", "returnil", "steadystate", "ccleaner", "evidence eliminator", "privazer", "bleachbit")
SOFTWARE_KINDS = (("system_restore", ("freeze", "rollback", "restore")), ("anti_forensic", ("cleaner", "eliminator", "privazer", "bleachbit")))
PROGRAMS = (
    ("tor", ("tor browser", "torbrowser")),
    ("wiping_tool", ("ccleaner", "bleachbit", "privazer", "evidence eliminator", "eraser")),
    ("encryption", ("veracrypt", "truecrypt", "bitlocker", "gpg4win", "axcrypt")),
    ("privacy", ("vpn", "protonvpn", "nordvpn", "windscribe", "mullvad")),
    ("file_sharing", ("utorrent", "bittorrent", "qbittorrent", "deluge", "transmission")),
    ("browser", ("chrome", "firefox", "iexplore", "msedge", "opera", "brave", "vivaldi", "safari")),
)


def holds(text: Column, fragments, test: str = "contains") -> Column:
    out = F.lit(False)
    for f in fragments:
        out = out | getattr(text, test)(f)
    return out


def first_rule(text: Column, rules, test: str = "contains") -> Column:
    """The name of the first rule with a fragment that fits; null if none does."""
    return F.coalesce(*[F.when(holds(text, fragments, test), name) for name, fragments in rules])


def slashed(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/+", "/")


def browser(path: Column) -> Column:
    """H-14: the browser and channel whose folder the path is in."""
    return first_rule(F.lower(slashed(path)), BROWSERS)


def embedded_browser(path: Column, roots: list[str]) -> Column:
    """H-14: browser(), else chromium_embedded for a path at or below one of the roots (found by A-44, or given); slashes and case do not count."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(slashed(c)), "/+", "/"), F.lit("/"))
    own = F.lit(False)
    for root in roots:
        if name := re.sub("/+", "/", root.lower().replace("\\", "/")).strip("/"):
            own = own | (plain(path) == name) | plain(path).startswith(f"{name}/")
    return F.coalesce(browser(path), F.when(own, "chromium_embedded"))


def in_roots(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """H-14: (id, browser) of paths (id, path) against a table of roots (column root) of any size: each path meets them by its own folders."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(slashed(F.col(c))), "/+", "/"), F.lit("/"))
    parts = F.split(plain("path"), "/")
    folders = paths.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("root"))
    known = roots.select(plain("root").alias("root")).where("root <> ''").distinct()
    below = folders.join(known, "root").select("id").distinct().withColumn("embedded", F.lit("chromium_embedded"))
    return paths.join(below, "id", "left").select("id", F.coalesce(browser(F.col("path")), "embedded").alias("browser"))


def profile(path: Column) -> Column:
    """H-14: the profile folder; Default where only its contents show."""
    parts = F.split(slashed(path), "/")
    low = F.transform(parts, F.lower)
    after = lambda k: F.when(F.lower(k).isin(*IN_PROFILE), "Default").otherwise(k)
    pairs = F.arrays_zip(parts.alias("here"), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))).alias("next"))
    at = lambda test: F.get(F.filter(pairs, lambda p: test(p["here"]) & p["next"].isNotNull()), 0)["next"]
    named = F.get(F.filter(parts, lambda p: F.lower(p).isin(*PROFILES) | F.lower(p).startswith("profile ")), 0)
    stable = F.coalesce(*[F.when(F.array_contains(parts, n), n) for n in ("Opera Stable", "Opera GX Stable")])
    bundled = F.arrays_overlap(parts, F.array(F.lit("com.operasoftware.Opera"), F.lit("com.operasoftware.OperaGX"))) | F.arrays_overlap(low, F.array(*map(F.lit, IN_PROFILE)))
    user_data, parent = at(lambda p: p == "User Data"), at(lambda p: F.lower(p).isin(*PROFILE_PARENTS))
    return F.coalesce(F.when(user_data.isNotNull(), after(user_data)), named, F.when(parent.isNotNull(), after(parent)), stable, F.when(bundled, "Default"))


def extension_risk(permissions: Column, hosts: Column) -> Column:
    """H-16: critical, high, medium or low; null arrays count as empty."""
    empty = F.array().cast("array<string>")
    permissions, hosts = F.coalesce(permissions, empty), F.coalesce(hosts, empty)
    every = F.concat(permissions, hosts)
    has = {risk: F.arrays_overlap(every, F.array(*map(F.lit, names))) for risk, names in RISKS.items()}
    wide = F.exists(hosts, lambda h: h.isin(*RISKY_HOSTS) | (h.startswith("*://") & h.endswith("/*")))
    return F.when(has["critical"], "critical").when(wide, "high").when(has["high"], "high").when(has["medium"], "medium").otherwise("low")


def signal(path: Column, name: Column) -> Column:
    """H-17: what kind of profile content a file is."""
    low, own = F.lower(slashed(path)), F.lower(name)
    by_name = F.when(own.isin("cookies", "history", "preferences"), own).when(own.isin("web data", "visited links"), F.regexp_replace(own, " ", "_"))
    storage = F.when(low.contains("/local storage/leveldb/") | (low.contains("/local storage/") & low.endswith(".localstorage")), "local_storage").when(low.contains("/session storage/"), "session_storage")
    return F.coalesce(first_rule(low, SIGNALS.items(), "endswith"), storage, by_name, F.when((own == "index") & holds(low, ("/cache/", "/leveldb/")), "cache"))


def profile_root(path: Column, kind: Column) -> Column:
    """H-18: the folder that holds the profile content of this kind."""
    whole = slashed(path)
    cut = lambda pattern: F.when(whole.rlike(pattern), F.rtrim(F.regexp_replace(whole, pattern, ""), F.lit("/")))
    out = F.when(kind == "cache", cut(r"(?i)/index$")).when(kind == "local_storage", cut(r"(?is)/local storage/.*$")).when(kind == "session_storage", cut(r"(?is)/session storage/.*$"))
    for name, endings in SIGNALS.items():
        if name != "cache":
            out = out.when(kind == name, cut(f"(?i)(?:{'|'.join(endings)})$"))
    return out


def application_root(root: Column) -> Column:
    """H-18: the profile root without its last part, if that names a profile."""
    last = F.lower(F.regexp_extract(root, "([^/]*)$", 1))
    return F.when(last.isin(*PROFILES) | last.startswith("profile "), F.rtrim(F.regexp_replace(root, "/?[^/]*$", ""), F.lit("/"))).otherwise(root)


def software_kind(name: Column, publisher: Column) -> Column:
    """H-19: by the first pattern that the name or the publisher holds; null for other software."""
    kind = lambda pattern: next((k for k, words in SOFTWARE_KINDS if any(w in pattern for w in words)), "forensic_interest")
    text = (F.lower(name), F.coalesce(F.lower(publisher), F.lit("")))
    return F.coalesce(*[F.when(text[0].contains(p) | text[1].contains(p), kind(p)) for p in SOFTWARE])


def program_kind(path: Column) -> Column:
    """H-19: the kind of a program in the run history."""
    return first_rule(F.lower(path), PROGRAMS)


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TURNED = LETTERS[13:] + LETTERS[:13]


def rot13(text: Column) -> Column:
    """H-20."""
    return F.translate(text, LETTERS + LETTERS.lower(), TURNED + TURNED.lower())


def little_endian(digits: Column, offset: int, size: int) -> Column:
    """The unsigned number of `size` bytes at a byte offset of a hex text."""
    turned = F.concat(*[F.substring(digits, 2 * (offset + k) + 1, 2) for k in range(size - 1, -1, -1)])
    return F.conv(turned, 16, 10).try_cast("long")


def run_history(name: Column, digits: Column) -> Column:
    """H-20: struct (path, runs, focus, focus_ms, last_run) of a value and its bytes as hex; 72 bytes or 16; else null."""
    long, short = F.length(digits) >= 144, F.length(digits) >= 32
    number = lambda offset: little_endian(digits, offset, 4)
    runs = F.when(long, number(4)).otherwise(F.greatest(number(4) - 5, F.lit(0)))
    last = S.from_filetime(F.when(long, little_endian(digits, 60, 8)).otherwise(little_endian(digits, 8, 8)))
    row = F.struct(rot13(name).alias("path"), runs.alias("runs"), F.when(long, number(8)).alias("focus"), F.when(long, number(12)).alias("focus_ms"), last.alias("last_run"))
    return F.when(short & (name != "") & (F.lower(name) != "(default)") & ~name.startswith("HRZR_"), row)


def origin_attributes(text: Column) -> Column:
    """H-23: struct (user_context_id, private_browsing_id, first_party_domain, partition_key); the last of a repeated key counts."""
    every = lambda key, value: F.regexp_extract_all(F.ltrim(text, F.lit("^")), F.lit(f"(?:^|(?<=&)){key}={value}(?=&|$)"), F.lit(1))
    last = lambda key, value: F.try_element_at(every(key, value), F.lit(-1))
    number = lambda key: last(key, r"\s*([+-]?\d+)\s*").try_cast("int")
    plain = lambda key: F.nullif(last(key, "([^&]*)"), F.lit(""))
    return F.struct(number("userContextId").alias("user_context_id"), number("privateBrowsingId").alias("private_browsing_id"), plain("firstPartyDomain").alias("first_party_domain"), plain("partitionKey").alias("partition_key"))


ADDRESSES = ("network:dhcp_ip", "network:dns_server", "network:default_gateway", "network:dhcp_server")


def network_value(value: Column, kind: Column) -> Column:
    """H-25: list brackets and quotes go, resource references and zero addresses are empty, the proxy switch is a word."""
    v = F.trim(value)
    items = F.transform(F.split(F.regexp_replace(v, r"^\[|\]$", ""), ","), lambda x: F.trim(F.trim(x), F.lit("'\"")))
    v = F.when(v.startswith("[") & v.endswith("]"), F.array_join(F.filter(items, lambda x: x != ""), ", ")).otherwise(v)
    zero = (v == "0") & (kind.isin("network:domain", *ADDRESSES))
    proxy = kind == "network:proxy_settings"
    return F.when(value.isNull() | v.startswith("@") | zero, "").when(proxy & (v == "0"), "Disabled").when(proxy & (v == "1"), "Enabled").otherwise(v)


def entry_name(name: Column, kind: Column, extra: Column, path: Column) -> Column:
    """H-25: the name if it is not just the type, else the JSON value_name, else the last part of the path."""
    filled = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(filled(F.when(name != F.coalesce(kind, F.lit("")), name)), filled(F.try_variant_get(F.try_parse_json(extra), "$.value_name", "string")), filled(F.regexp_extract(path, r"([^/\\]*)$", 1)), name, F.lit(""))


def profile_key(path: Column) -> Column:
    """H-25: the key path without its value name."""
    return F.coalesce(F.regexp_replace(F.regexp_replace(path, "/", r"\\"), r"\\[^\\]*$", ""), F.lit(""))


def app_path(path: Column) -> Column:
    """H-25: the program after App Paths in a key path."""
    return F.coalesce(F.regexp_extract(path, r"(?:^|[/\\])App Paths[/\\]([^/\\]*)", 1), F.lit(""))


LINK = r"""(?i)(https?://[^\s"<>']+)"""


def shortcut_url(url: Column, destination: Column, arguments: Column, target: Column) -> Column:
    """X-11: the URL property, else out of the destination (as it is, its url= parameter, anywhere in it), the arguments, the target."""
    filled = lambda c: F.nullif(c, F.lit(""))
    whole = lambda c: F.when(c.startswith("http://") | c.startswith("https://"), c)
    found = lambda c: filled(F.regexp_extract(c, LINK, 1))
    decoded = lambda c: F.coalesce(F.try_url_decode(c), c)
    parameter = decoded(filled(F.regexp_extract(F.regexp_replace(destination, r"^[^?]*\?", ""), "(?i)(?:^|&)url=([^&]*)", 1)))
    return F.coalesce(filled(url), whole(destination), whole(parameter), found(decoded(destination)), found(arguments), whole(target), found(target))
