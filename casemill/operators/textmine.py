"""URLs, emails, tokens and identifiers out of free text and stored values."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.tables import table

# Patterns, false positives, noise prefixes.
URL = r"""https?://[^\s"'<>\]})\\,]+|https?%3[Aa]%2[Ff]%2[Ff][^\s"'<>\]})\\,]+"""
URLS = re.compile(f"(?i:{URL})", re.A)
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
JWT = r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*"
OAUTH = r"Ew[AB][A-Za-z0-9+/=_-]{50,}"
LONG = r"[A-Za-z0-9_-]{64,}"
NOT_EMAILS = ("example@example.com", "user@example.com", "test@test.com", "noreply@", "@example.", "@localhost")
NOISE = ("http://127.0.0.1", "http://localhost", "https://localhost", "http://0.0.0.0", "chrome://", "chrome-extension://", "moz-extension://", "edge://", "about:", "data:")
SCHEMES = ("http://", "https://", "ftp://", "file://")


def any_of(c: Column, test: str, values: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for v in values:
        out = out | getattr(c, test)(v)
    return out


def urls_in(text: Column) -> Column:
    """X-3: decoded and without closing punctuation."""
    found = F.regexp_extract_all(text, F.lit(f"(?i)({URL})"), F.lit(1))
    return F.transform(found, lambda u: F.rtrim(F.coalesce(F.when(u.ilike("%\\%3a\\%2f%"), F.try_url_decode(u)), u), F.lit(".,;:!?")))


def emails_in(text: Column) -> Column:
    """X-4."""
    found = F.when(text.contains("@"), F.regexp_extract_all(text, F.lit(f"({EMAIL})"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    return F.filter(found, lambda e: ~any_of(F.lower(e), "contains", NOT_EMAILS) & (F.length(F.substring_index(e, "@", -1)) >= 4))


def token_type(key: Column, value: Column) -> Column:
    """X-5: the kind of token that a stored value is, by its own form, then by its key; null below 20 characters."""
    name = F.lower(key)
    kind = (
        F.when(value.rlike(JWT), "jwt").when(value.rlike(OAUTH), "ms_oauth").when(name.contains("refresh"), "oauth_refresh").when(name.contains("access") & name.contains("token"), "oauth_access")
        .when(name.contains("session"), "session").when(name.contains("auth") | name.contains("token") | name.contains("bearer"), "auth_token").when(name.contains("api") & name.contains("key"), "api_key")
    )
    return F.when(F.length(value) >= 20, F.coalesce(kind, F.when(value.rlike(f"^{LONG}$"), "unknown")))


def tokens(values: DataFrame) -> DataFrame:
    """X-5, X-7: (origin, token_type, token_hash, value) once for each hash."""
    found = values.withColumn("token_type", token_type(F.col("key"), F.col("value"))).where("token_type is not null").withColumn("token_hash", F.sha2("value", 256))
    return found.groupBy("token_hash").agg(F.min(F.struct("origin", "key", "token_type", "value")).alias("t")).select("token_hash", "t.*")


CLAIMS = "iss string, sub string, aud string, iat long, exp long, email string, user_id string"


def jwt_claims(token: Column) -> Column:
    """X-6: the claims of a JWT as a struct; null where it can't be read."""
    body = F.translate(F.split(token, r"\.")[1], "-_", "+/")
    padded = F.rpad(body, (F.ceil(F.length(body) / 4) * 4).cast("int"), F.lit("="))
    return F.from_json(F.try_to_binary(padded, F.lit("base64")).cast("string"), CLAIMS)


def expired(claims: Column, now: int) -> Column:
    return claims["exp"] < now


def nearest_time(text: Column, at: Column) -> Column:
    """X-8: the timestamp text within 200 characters on both sides of the 1-based place: 13 digits, 10 digits, ISO."""
    start = F.greatest(at - 200, F.lit(1))
    near = F.substring(text, start, at + 200 - start)
    first = lambda p: F.nullif(F.regexp_extract(near, p, 1), F.lit(""))
    return F.coalesce(first(r"\b(1[0-9]{12})\b"), first(r"\b(1[0-9]{9})\b"), first(r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})"))


def url_times(rows: DataFrame) -> DataFrame:
    """X-8: (id, at, found) of rows (id, text): the 1-based place of every URL of the whole text, the timestamp near it."""

    def batch_of(held):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), (pa.int64(), pa.int32(), pa.string(), pa.int32()))], ["id", "at", "near", "inner"])

    def run(batches):
        held = []
        for batch in batches:
            for id_, text in zip(*(c.to_pylist() for c in batch.columns)):
                for m in URLS.finditer(text or ""):
                    a = m.start()
                    held.append((id_, a + 1, text[max(0, a - 200) : a + 200], min(a, 200) + 1))
                    if len(held) >= 10_000:  # the rows of many texts go on together
                        yield batch_of(held)
                        held = []
        if held:
            yield batch_of(held)

    windows = rows.select(F.col("id").cast("long").alias("id"), "text").mapInArrow(run, "id long, at int, near string, inner int")
    return windows.select("id", "at", nearest_time(F.col("near"), F.col("inner")).alias("found"))


def normal_feature(kind: Column, feature: Column) -> Column:
    """X-9."""
    f = F.trim(feature)
    plain = ~f.contains(" ")
    url = F.when(any_of(f, "startswith", SCHEMES), f).when(f.contains(".") & plain, F.concat(F.lit("http://"), f))
    email = F.when(f.contains("@") & plain, F.regexp_replace(f, "^mailto:", ""))
    domain = F.when(f.contains(".") & plain, F.regexp_replace(f, "^(?:http|https|ftp)://", ""))
    return F.when(feature != "", F.when(kind == "url", url).when(kind == "email", email).when(kind == "domain", domain).otherwise(f))


def is_noise(url: Column) -> Column:
    """X-10: few distinct characters, odd length, local or internal."""
    return (F.size(F.array_distinct(F.split(url, ""))) < 10) | (F.length(url) <= 10) | (F.length(url) >= 2048) | any_of(F.lower(url), "startswith", NOISE)


# Names of JSON fields that hold URLs, emails, identifiers and times.
URL_FIELDS = "url href link redirect referrer pageUrl uri redirectUrl returnUrl callbackUrl targetUrl sourceUrl imageUrl videoUrl contentUrl baseUrl requestUrl".split()
EMAIL_FIELDS = "email mail upn userPrincipalName user_email emailAddress email_address userEmail account preferred_username unique_name".split()
ID_FIELDS = {
    "user_id": "user_id userId uid sub subject oid", "device_id": "device_id deviceId did muid mid machine_id", "tracking_id": "tracking_id trackingId _ga _gid ga_id web_id webId client_id clientId",
    "visitor_id": "visitor_id visitorId", "session_id": "session_id sessionId sid",
}
TIME_FIELDS = "time timestamp date created modified previousRequestTime lastActiveTime lastUpdated visitTime accessTime requestTime expiration exp iat nbf createdAt updatedAt lastUsed created_at updated_at last_used expiresAt issuedAt expires_at issued_at lastAccess last_access".split()


def field_kind(name: Column) -> Column:
    """X-2: url, email or the kind of identifier that a field's name stands for; identifiers as they are spelt."""
    lower = F.lower(name)
    kind = F.when(lower.isin([f.lower() for f in URL_FIELDS]), "url").when(lower.isin([f.lower() for f in EMAIL_FIELDS]), "email")
    for value, names in ID_FIELDS.items():
        kind = kind.when(name.isin(names.split()), value)
    return kind


def json_fields(rows: DataFrame, column: str) -> DataFrame:
    """X-2: (id, path, value, kind, at) of the leaves of JSON objects and arrays at any depth; text that is no JSON gives none.

    kind is what the name of the field says (null for others), at the text of the first time field by name of the
    object that the leaf is in. The walk goes level by level until no value is nested; a level is a table.
    """
    current = rows.select("id", F.try_parse_json(column).alias("v"), F.lit("").alias("path"))
    current = current.where("v is not null and not is_variant_null(v)")
    out = None
    while True:
        nested = current.where(F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)"))
        if nested.isEmpty():
            break
        times = F.coalesce(*[F.try_variant_get("v", f"$.{f}", "string") for f in sorted(TIME_FIELDS)])
        each = nested.withColumn("at", F.when(F.schema_of_variant("v").startswith("OBJECT"), times))
        each = each.lateralJoin(each.sparkSession.tvf.variant_explode(F.col("v").outer()).select(F.col("pos"), F.col("key"), F.col("value").alias("inner")))
        path = F.when(F.col("key").isNull(), F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).when(F.col("path") == "", F.col("key")).otherwise(F.concat("path", F.lit("."), "key"))
        level = table(each.select("id", path.alias("path"), "key", "at", F.to_json("inner").alias("text"), F.try_variant_get("inner", "$", "string").alias("value")), "json-level")
        deeper = F.col("text").rlike(r"^[\[{]")
        leaves = level.where(~F.coalesce(deeper, F.lit(False))).select("id", "path", "value", field_kind(F.col("key")).alias("kind"), "at")
        out = leaves if out is None else out.unionByName(leaves)
        current = level.where(deeper).select("id", F.try_parse_json("text").alias("v"), "path")
    return out if out is not None else current.select("id", "path", *[F.lit(None).cast("string").alias(c) for c in ("value", "kind", "at")])


def analysed(values: DataFrame) -> DataFrame:
    """X-1: (origin, key, kind, found): URLs, emails and tokens of stored values, in one pass."""
    kinds = F.array(
        F.struct(F.lit("url").alias("kind"), urls_in(F.col("value")).alias("found")), F.struct(F.lit("email").alias("kind"), emails_in(F.col("value")).alias("found")),
        F.struct(F.lit("token").alias("kind"), F.filter(F.array(F.when(token_type(F.col("key"), F.col("value")).isNotNull(), F.col("value"))), lambda x: x.isNotNull()).alias("found")),
    )
    return values.select("origin", "key", F.explode(kinds).alias("k")).select("origin", "key", "k.kind", F.explode("k.found").alias("found"))
