"""X-1, X-5: what stored values (origin, key, value) hold: URLs, emails, tokens with their risk and claims, identifiers.

A value that is JSON is walked at any depth: the text fields of its objects are judged by their names. Every value is
searched as text besides. Both ways give rows of their own, with the place (context) that a row was found at.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.operators.textmine import EMAIL, JWT, LONG, OAUTH, TIME_FIELDS, URLS, emails_in, field_kind, nearest_time
from casemill.tables import table

# Words of a key that make its value worth a look as a token, and those that say what sort of token it is.
TOKEN_KEYS = ("token", "auth", "session", "jwt", "oauth", "access", "refresh", "credential", "secret", "apikey", "api_key", "bearer")
SORT_KEYS = ("token", "auth", "session", "bearer", "access", "refresh")
SHORTEST, LONG_VALUE = 20, 32
TIME_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")
#: Rows, or characters of their URLs, that go on to Spark together.
TOGETHER, CHARACTERS = 10_000, 1 << 22
CONTEXT_EMAILS = ("email", "upn", "userPrincipalName")


def holds(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(F.lower(text), F.lit(w))
    return out


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def moment(text: Column) -> Column:
    """A time as text: ISO forms, else a number of milliseconds (beyond 10**12) or seconds (beyond 10**9) in the years 2000 to 2050."""
    plain = F.regexp_replace(F.replace(text, F.lit("+00:00"), F.lit("Z")), "Z+$", "")
    iso = F.when(F.contains(text, F.lit("T")) | F.contains(text, F.lit("-")), F.coalesce(*[F.try_to_timestamp(plain, F.lit(f)) for f in TIME_FORMATS]))
    number = F.when(text.rlike(r"^\s*[+-]?[0-9.]+([eE][+-]?[0-9]+)?\s*$"), F.trim(text).cast("double"))
    seconds = F.when(number > 10**12, number / 1000).when(number > 10**9, number)
    return F.coalesce(iso, F.when((seconds >= 946_684_800) & (seconds < 2_556_144_000), F.timestamp_micros((seconds * 1_000_000).cast("long"))))


def cleaned_url(url: Column) -> Column:
    """Decoded where it is encoded, without closing punctuation; null if it is no URL with a host."""
    decoded = F.when(F.contains(F.lower(url), F.lit("%3a%2f%2f")), F.coalesce(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), url)).otherwise(url)
    plain = F.rtrim(decoded, F.lit(".,;:!?)]'\""))
    return let(plain, lambda u: F.when(u.rlike(r"^https?://[^/?#]"), u))


def token(key: Column, value: Column) -> Column:
    """X-5: (token_type, risk) of a value, by its own form, then by its key; null if it is none, or shorter than 20 characters."""
    name = F.lower(key)
    sort = lambda kind, risk: F.struct(F.lit(kind).alias("token_type"), F.lit(risk).alias("risk"))
    by_key = F.when(name.contains("refresh"), sort("refresh_token", "high")).when(name.contains("access"), sort("access_token", "high")).when(name.contains("session"), sort("session", "medium")).otherwise(sort("unknown", "low"))
    long = value.rlike(f"^{LONG}") | (F.length(value) > LONG_VALUE)
    kind = F.when(value.rlike(JWT), sort("jwt", "high")).when(value.rlike(OAUTH), sort("microsoft_oauth", "high")).when(holds(key, SORT_KEYS) & long, by_key)
    return F.when(F.length(value) >= SHORTEST, kind)


def _fields(values: DataFrame) -> DataFrame:
    """(id, origin, key, path, name, value, at, email) of the text fields of JSON objects; at, email: of the object they are in."""
    current = values.select("id", "origin", "key", F.col("value").alias("text"), F.try_parse_json("value").alias("v"), F.lit("").alias("path"))
    # the fields that tell an object's time and email, read in one pass over its text
    told = ", ".join(f"`{f}` string" for f in dict.fromkeys((*sorted(TIME_FIELDS), *CONTEXT_EMAILS)))
    keep, out = ("id", "origin", "key"), None
    while True:
        nested = current.where(F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)"))
        if out is not None and nested.isEmpty():
            return out
        is_object = F.schema_of_variant("v").startswith("OBJECT")
        times = F.filter(F.array(*[F.col(f"told.{f}") for f in sorted(TIME_FIELDS)]), lambda t: t.isNotNull())
        email = F.coalesce(*[F.nullif(F.col(f"told.{f}"), F.lit("")) for f in CONTEXT_EMAILS])
        each = nested.withColumn("told", F.when(is_object, F.from_json("text", told)))
        each = each.withColumns({"at": F.get(F.filter(F.transform(times, moment), lambda t: t.isNotNull()), 0), "email": email}).drop("told", "text")
        each = each.lateralJoin(each.sparkSession.tvf.variant_explode(F.col("v").outer()).select("pos", F.col("key").alias("name"), F.col("value").alias("inner")))
        path = F.when(F.col("name").isNull(), F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).when(F.col("path") == "", F.col("name")).otherwise(F.concat("path", F.lit("."), "name"))
        kind = F.schema_of_variant("inner")
        level = table(each.select(*keep, path.alias("path"), "name", "at", "email", F.when(kind == "STRING", F.try_variant_get("inner", "$", "string")).alias("value"), F.when(kind.rlike("^(OBJECT|ARRAY)"), F.to_json("inner")).alias("json")), "stored-fields")
        found = level.where("value is not null and name is not null").select(*keep, "path", "name", "value", "at", "email")
        out = found if out is None else out.unionByName(found)
        current = level.where("json is not null").select(*keep, F.col("json").alias("text"), F.try_parse_json("json").alias("v"), "path")


def _url_uses(values: DataFrame) -> DataFrame:
    """(id, origin, key, raw, near, inner): every URL in the texts, and the text around it with its 1-based place in that."""

    names, kinds = ("id", "origin", "key", "raw", "near", "inner"), (pa.int64(), *[pa.string()] * 4, pa.int32())

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], list(names))

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for id_, origin, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                for m in URLS.finditer(text or ""):
                    a = m.start()
                    held.append((id_, origin, key, m.group(), text[max(0, a - 200) : a + 200], min(a, 200) + 1))
                    size += len(held[-1][3])
                    if len(held) >= TOGETHER or size >= CHARACTERS:  # the rows of many texts go on together
                        yield batch_of(held)
                        held, size = [], 0
        if held:
            yield batch_of(held)

    return values.select(F.col("id").cast("long"), "origin", "key", "value").mapInArrow(run, "id long, origin string, key string, raw string, near string, inner int")


class Analysis:
    """X-1: the artifacts of stored values (id, origin, key, value); each property is a table of its own."""

    def __init__(self, values: DataFrame):
        self.values = values.select(F.col("id").cast("long").alias("id"), F.col("origin").cast("string").alias("origin"), F.coalesce(F.col("key").cast("string"), F.lit("")).alias("key"), "value").where("value <> ''")
        self.fields = _fields(self.values).withColumn("kind", field_kind(F.col("name")))

    @property
    def urls(self) -> DataFrame:
        """(id, origin, key, url, seen, context)."""
        named = self.fields.where("kind = 'url'").select("id", "origin", "key", cleaned_url(F.col("value")).alias("url"), F.col("at").alias("seen"), F.concat(F.lit("json:"), "path").alias("context"))
        swept = _url_uses(self.values).select("id", "origin", "key", cleaned_url(F.col("raw")).alias("url"), let(nearest_time(F.col("near"), F.col("inner")), moment).alias("seen"), F.concat(F.lit("regex:key="), "key").alias("context"))
        return named.unionByName(swept).where("url is not null")

    @property
    def emails(self) -> DataFrame:
        """(id, origin, key, email, context)."""
        named = self.fields.where(F.col("kind") == "email").where(F.col("value").rlike(f"^{EMAIL}")).select("id", "origin", "key", F.lower("value").alias("email"), F.concat(F.lit("json:"), "path").alias("context"))
        swept = self.values.select("id", "origin", "key", F.explode(emails_in(F.col("value"))).alias("email")).select("id", "origin", "key", F.lower("email").alias("email"), F.concat(F.lit("regex:key="), "key").alias("context"))
        return named.unionByName(swept)

    @property
    def identifiers(self) -> DataFrame:
        """(id, origin, key, identifier_type, name, value, seen)."""
        return self.fields.where("kind not in ('url', 'email')").select("id", "origin", "key", F.col("kind").alias("identifier_type"), "name", "value", F.col("at").alias("seen"))

    @property
    def tokens(self) -> DataFrame:
        """(id, origin, key, token_type, risk, token_hash, value, issuer, subject, audience, issued, expires, email, user_id): once for each value and hash."""
        named = self.fields.select("id", "origin", "key", F.col("name").alias("by"), "value", "email", F.lit(0).alias("way"))
        whole = self.values.where(holds(F.col("key"), TOKEN_KEYS)).select("id", "origin", "key", F.col("key").alias("by"), "value", F.lit(None).cast("string").alias("email"), F.lit(1).alias("way"))
        found = named.unionByName(whole).withColumn("t", token(F.col("by"), F.col("value"))).where("t is not null")
        once = found.groupBy("id", "origin", "key", F.sha2("value", 256).alias("token_hash")).agg(F.min(F.struct("way", "by", "t", "value", "email")).alias("x")).select("id", "origin", "key", "token_hash", "x.*")
        jwt = F.when(F.col("t.token_type") == "jwt", F.regexp_extract("value", JWT, 0))
        claims = F.from_json(F.try_to_binary(_padded(jwt), F.lit("base64")).cast("string"), "iss string, sub string, aud string, iat string, exp string, email string, upn string, preferred_username string, unique_name string, oid string")
        rows = once.withColumn("c", claims)
        people = F.coalesce(*[F.nullif(F.col(f"c.{c}"), F.lit("")) for c in ("email", "upn", "preferred_username", "unique_name")])
        audience = F.coalesce(F.array_join(F.from_json("c.aud", "array<string>"), ", "), F.col("c.aud"))
        return rows.select(
            "id", "origin", "key", "t.token_type", "t.risk", "token_hash", "value", F.col("c.iss").alias("issuer"), F.col("c.sub").alias("subject"), audience.alias("audience"),
            moment(F.col("c.iat")).alias("issued"), moment(F.col("c.exp")).alias("expires"), F.coalesce(people, F.when(F.col("t.token_type") == "microsoft_oauth", F.col("email"))).alias("email"),
            F.coalesce(*[F.nullif(F.col(f"c.{c}"), F.lit("")) for c in ("sub", "oid")]).alias("user_id"),
        )

    @property
    def everything(self) -> DataFrame:
        """(id, origin, key, kind, type, found): all artifacts in one table; type: of identifiers and tokens."""
        parts = [
            self.urls.select("id", "origin", "key", F.lit("url").alias("kind"), F.lit(None).cast("string").alias("type"), F.col("url").alias("found")), self.emails.select("id", "origin", "key", F.lit("email"), F.lit(None).cast("string"), "email"),
            self.identifiers.select("id", "origin", "key", F.lit("identifier"), "identifier_type", "value"), self.tokens.select("id", "origin", "key", F.lit("token"), "token_type", "value"),
        ]
        return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def _padded(jwt: Column) -> Column:
    body = F.translate(F.split(jwt, r"\.")[1], "-_", "+/")
    return F.rpad(body, (F.ceil(F.length(body) / 4) * 4).cast("int"), F.lit("="))


def expired_tokens(tokens: DataFrame, now) -> DataFrame:
    """X-5: tokens with whether they had expired at a time; null without an expiry."""
    return tokens.withColumn("is_expired", F.col("expires") < now)
