"""N-9: accounts and devices of browsers' sync records; N-1: bookmark trees of the second layout."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.functions import scalars as S

# What the presence of a token says about a signed-in account; folder names of bookmark trees.
SYNC_TOKENS = {"sessionToken": "active_session", "keyFetchToken": "key_sync", "unwrapBKey": "encryption_enabled", "kSync": "sync_encryption_ready", "encryptedSendTabKeys": "send_tab_enabled"}
FOLDERS = {"menu": "Bookmarks Menu", "toolbar": "Bookmarks Toolbar", "unfiled": "Other Bookmarks", "mobile": "Mobile Bookmarks"}
CONTAINER, PLACE = "text/x-moz-place-container", "text/x-moz-place"


def _get(v: str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _text(v: str, path: str) -> Column:
    return F.coalesce(_get(v, path), F.lit(""))


def _flag(v: str, path: str) -> Column:
    return F.coalesce(_get(v, path, "boolean"), F.lit(False))


def _inside(rows: DataFrame, v: str, path: str, kind: str, *keep: str) -> DataFrame:
    """(keep, pos, key, e): the entries of the list or object at a path of a variant column."""
    found = rows.select(*keep, _get(v, path, "variant").alias("__in")).where(F.schema_of_variant("__in").startswith(kind))
    return found.lateralJoin(found.sparkSession.tvf.variant_explode(F.col("__in").outer()).select("pos", "key", F.col("value").alias("e"))).drop("__in")


def _parsed(docs: DataFrame) -> DataFrame:
    return docs.select("id", F.try_parse_json("doc").alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))


def preference_accounts(docs: DataFrame) -> DataFrame:
    """N-9: accounts of preference files (id, doc): those of the account list, and the one of the services section unless its email is among them.

    synced_types: the switches of the sync section that are on, in order of their names. Without a finished set-up sync is off.
    """
    files = _parsed(docs)
    listed = _inside(files, "v", "$.account_info", "ARRAY", "id").where(F.schema_of_variant("e").startswith("OBJECT"))
    own = listed.select(
        "id", "pos", _text("e", "$.account_id").alias("account_id"), _text("e", "$.email").alias("email"), F.coalesce(_get("e", "$.full_name"), _get("e", "$.given_name"), F.lit("")).alias("display_name"), _text("e", "$.gaia").alias("person_id"),
        _text("e", "$.hd").alias("hosted_domain"), _flag("e", "$.is_child_account").alias("is_child"), _flag("e", "$.is_under_advanced_protection").alias("protected"), F.lit(True).alias("allowed"),
    )
    services = files.select("id", F.lit(2**30).alias("pos"), _text("v", "$.google.services.account_id").alias("account_id"), _text("v", "$.google.services.username").alias("email"), F.lit("").alias("display_name"), _text("v", "$.google.services.last_gaia_id").alias("person_id"), F.lit("").alias("hosted_domain"), F.lit(False).alias("is_child"), F.lit(False).alias("protected"), F.coalesce(_get("v", "$.google.services.signin.allowed", "boolean"), F.lit(True)).alias("allowed"))
    other = services.where("email <> ''").join(own.select("id", "email").distinct(), ["id", "email"], "left_anti").select(*own.columns)
    on = _inside(files, "v", "$.sync", "OBJECT", "id").groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(F.when((F.schema_of_variant("e") == "BOOLEAN") & _get("e", "$", "boolean"), F.col("key")))), ",").alias("types"))
    sync = files.join(on, "id").select("id", "types", S.from_webkit(_get("v", "$.sync.last_synced_time").cast("long")).alias("last_sync"), _flag("v", "$.sync.has_setup_completed").alias("done"))
    rows = own.union(other).join(sync, "id", "left")
    return rows.select("id", "pos", "account_id", "email", "display_name", "person_id", "hosted_domain", "is_child", "protected", "last_sync", (F.col("allowed") & F.coalesce("done", F.lit(True))).alias("sync_enabled"), F.coalesce("types", F.lit("")).alias("synced_types"))


def preference_devices(docs: DataFrame) -> DataFrame:
    """N-9: (id, device_id, name, kind, system, version, last_updated, account_id, receives_tabs) of the devices of preference files.

    account_id: that of the file's first account.
    """
    found = _inside(_parsed(docs), "v", "$.sync.devices", "OBJECT", "id").where(F.schema_of_variant("e").startswith("OBJECT"))
    first = preference_accounts(docs).groupBy("id").agg(F.min_by("account_id", "pos").alias("account_id"))
    rows = found.join(first, "id", "left")
    return rows.select("id", F.col("key").alias("device_id"), F.coalesce(_get("e", "$.name"), F.lit("Unknown")).alias("name"), F.coalesce(_get("e", "$.type"), F.lit("unknown")).alias("kind"), _text("e", "$.os").alias("system"), _text("e", "$.chrome_version").alias("version"), S.from_webkit(_get("e", "$.last_updated_timestamp").cast("long")).alias("last_updated"), F.coalesce("account_id", F.lit("")).alias("account_id"), _flag("e", "$.send_tab_to_self_receiving_enabled").alias("receives_tabs"))


def signed_in_accounts(docs: DataFrame, tokens: dict[str, str] | None = None) -> DataFrame:
    """N-9: (id, account_id, email, display_name, profile_path, sync_enabled, synced_types) of signed-in user files (id, doc); files without email and id give none.

    synced_types: what the tokens that are there stand for (tokens: field -> name), and remote_commands for a device with commands.
    """
    files = _parsed(docs)
    present = [F.when(F.coalesce(_get("v", f"$.accountData.{field}"), F.to_json(_get("v", f"$.accountData.{field}", "variant")), F.lit("")).isin("", "false", "0", "null", "{}", "[]"), None).otherwise(F.lit(name)) for field, name in (tokens or SYNC_TOKENS).items()]
    commands = F.when(F.coalesce(F.to_json(_get("v", "$.accountData.device.availableCommands", "variant")), F.lit("{}")) != "{}", "remote_commands")
    rows = files.select("id", _text("v", "$.accountData.uid").alias("account_id"), _text("v", "$.accountData.email").alias("email"), _text("v", "$.accountData.displayName").alias("display_name"), F.coalesce(F.nullif(_get("v", "$.accountData.profilePath"), F.lit("")), _get("v", "$.profilePath"), F.lit("")).alias("profile_path"), _flag("v", "$.accountData.verified").alias("sync_enabled"), F.concat_ws(",", *present, commands).alias("synced_types"))
    return rows.where("account_id <> '' or email <> ''")


def signed_in_devices(docs: DataFrame) -> DataFrame:
    """N-9: (id, device_id, name, kind, account_id, push_expired, capabilities) of the device in signed-in user files."""
    files = _parsed(docs).select("id", _text("v", "$.accountData.uid").alias("account_id"), _get("v", "$.accountData.device", "variant").alias("d")).where(F.schema_of_variant("d").startswith("OBJECT") & (F.to_json("d") != "{}"))
    commands = _inside(files, "d", "$.availableCommands", "OBJECT", "id").groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("key")), ",").alias("capabilities"))
    return files.join(commands, "id", "left").select("id", _text("d", "$.id").alias("device_id"), _text("d", "$.name").alias("name"), F.coalesce(_get("d", "$.type"), F.lit("desktop")).alias("kind"), "account_id", _flag("d", "$.pushEndpointExpired").alias("push_expired"), F.coalesce("capabilities", F.lit("")).alias("capabilities"))


def place_rows(doc_id, text: str):
    """The bookmarks of one file in the second layout, in the order of the file."""
    try:
        root = json.loads(text or "")
    except (ValueError, RecursionError):
        return
    stack = [(root, "")] if isinstance(root, dict) else []
    whole = lambda x: x if isinstance(x, int) and not isinstance(x, bool) and 0 < x < 2**63 else None
    while stack:
        node, folder = stack.pop()
        kind, title = node.get("type") or "", node.get("title") or ""
        if kind == PLACE and node.get("uri"):
            yield {"id": doc_id, "name": title, "url": str(node["uri"]), "folder": folder, "guid": node.get("guid"), "added": whole(node.get("dateAdded")), "modified": whole(node.get("lastModified"))}
        if kind == CONTAINER:
            shown = FOLDERS.get(title.lower(), title)
            folder = f"{folder}/{shown}" if folder and shown else shown or folder
        children = node.get("children")
        stack += [(c, folder) for c in reversed(children if isinstance(children, list) else []) if isinstance(c, dict)]


def place_bookmarks(docs: DataFrame) -> DataFrame:
    """N-1: (id, name, url, folder, guid, added, modified) of bookmark trees of the second layout; a file is walked in a task."""
    schema = pa.schema([("id", pa.int64()), ("name", pa.string()), ("url", pa.string()), ("folder", pa.string()), ("guid", pa.string()), ("added", pa.int64()), ("modified", pa.int64())])

    def run(batches):
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = list(place_rows(doc_id, text))
                for k in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_pylist(rows[k : k + 10_000], schema)

    rows = docs.select(F.col("id").cast("long"), "doc").mapInArrow(run, "id long, name string, url string, folder string, guid string, added long, modified long")
    return rows.withColumns({c: S.from_prtime(F.col(c)) for c in ("added", "modified")})
