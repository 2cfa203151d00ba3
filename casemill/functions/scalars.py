"""Scalar functions over timestamps, URLs, paths and codes, all as Column expressions."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

LAST_SECOND = 32_503_680_000  # start of the year 3000
WEBKIT_OFFSET, COCOA_OFFSET = 11_644_473_600, 978_307_200
NO_CODE = "unknown"

# File extensions by type.
FILE_TYPES = {
    "image": "jpg jpeg png gif webp bmp tiff tif svg ico",
    "video": "mp4 webm avi mov mkv flv wmv m4v",
    "audio": "mp3 wav ogg m4a flac aac wma",
    "document": "pdf doc docx xls xlsx ppt pptx txt rtf odt ods odp",
    "archive": "zip rar 7z tar gz bz2 xz tgz",
}
# Core page transitions by number and their qualifier flags.
TRANSITIONS = ("LINK", "TYPED", "AUTO_BOOKMARK", "AUTO_SUBFRAME", "MANUAL_SUBFRAME", "GENERATED", "AUTO_TOPLEVEL", "FORM_SUBMIT", "RELOAD", "KEYWORD", "KEYWORD_GENERATED")
QUALIFIERS = {
    0x00800000: "FORWARD_BACK",
    0x01000000: "FROM_ADDRESS_BAR",
    0x02000000: "HOME_PAGE",
    0x04000000: "FROM_API",
    0x08000000: "CHAIN_START",
    0x10000000: "CHAIN_END",
    0x20000000: "CLIENT_REDIRECT",
    0x40000000: "SERVER_REDIRECT",
    0x80000000: "IS_REDIRECT_MASK",
}
# Suffixes of two labels under which names are registered.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "co.nz", "co.jp", "com.br", "co.za", "co.in", "com.cn", "com.mx", "co.kr")
# Magic bytes of images, as hex.
MAGIC = (("FFD8FF", "jpeg"), ("89504E470D0A1A0A", "png"), ("474946383761", "gif"), ("474946383961", "gif"), ("424D", "bmp"), ("00000100", "ico"), ("49492A00", "tiff"), ("4D4D002A", "tiff"))


def from_seconds(x: Column) -> Column:
    """H-2: Unix seconds; null outside (0, year 3000]."""
    return F.when((x > 0) & (x <= LAST_SECOND), F.timestamp_seconds(x))


def from_webkit(x: Column) -> Column:
    """H-1: microseconds since 1601."""
    return F.when(x > 0, from_seconds((x - WEBKIT_OFFSET * 1_000_000) / 1_000_000))


def from_prtime(x: Column) -> Column:
    """H-2: microseconds since 1970."""
    return from_seconds(x / 1_000_000)


def from_millis(x: Column) -> Column:
    return from_seconds(x / 1000)


def from_cocoa(x: Column) -> Column:
    """H-2: seconds since 2001; zero and negative ones count."""
    return F.when(x + COCOA_OFFSET <= LAST_SECOND, F.timestamp_seconds(x + COCOA_OFFSET))


def from_filetime(x: Column) -> Column:
    """H-3: 100 nanoseconds since 1601."""
    return F.when(x > 0, from_seconds(x / 10_000_000 - WEBKIT_OFFSET))


def from_ole_days(x: Column) -> Column:
    """H-3: days since 1899-12-30."""
    return F.when(x > 0, F.timestamp_seconds((x - 25_569) * 86_400))


def from_fat(date: Column, time: Column) -> Column:
    """H-3: the 16-bit date and time of FAT."""
    bits = lambda c, shift, mask: F.shiftright(c, shift).bitwiseAND(F.lit(mask))
    text = F.format_string("%04d-%02d-%02d %02d:%02d:%02d", bits(date, 9, 127) + 1980, bits(date, 5, 15), bits(date, 0, 31), bits(time, 11, 31), bits(time, 5, 63), bits(time, 0, 31) * 2)
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))


def detected(x: Column) -> Column:
    """H-3: the epoch that the magnitude speaks for."""
    return F.when(x > 10**16, F.when(x > 10**17, from_filetime(x)).otherwise(from_webkit(x))).when(x > 10**14, from_prtime(x)).when(x > 10**11, from_millis(x)).otherwise(from_seconds(x))


#: H-3: where the ranges of the epochs begin and end. Fixed values.
FILETIME_1970, WEBKIT_1970, UNIX_2100 = 116_444_736_000_000_000, 11_644_473_600_000_000, 4_102_444_800


def hinted(x: Column, hint: str | None = None) -> Column:
    """H-3: a number in the epoch that the hint names (filetime, ole, webkit, unix), else the one that its range speaks for.

    Zero is no time, nor is what comes after the year 3000 (OLE days and hinted Unix seconds have no such end). Without a hint: whole numbers are FILETIME or WebKit values beyond their 1970, Unix seconds up to 2100, or
    else milliseconds; numbers with a fraction below 100,000 are OLE days; others are no time.
    """
    known = {"filetime": from_filetime, "ole": from_ole_days, "webkit": from_webkit, "unix": lambda c: F.timestamp_micros((c.cast("double") * 1_000_000).cast("long"))}
    if hint is not None:
        return F.when(x != 0, known[hint](x))
    whole = x.cast("double") == F.floor(x.cast("double"))
    n = x.cast("long")
    by_range = F.when(n > FILETIME_1970, from_filetime(n)).when(n > WEBKIT_1970, from_webkit(n)).when((n > 0) & (n < UNIX_2100), from_seconds(n)).when(n > 10**12, from_millis(n))
    return F.when(whole, by_range).when((x > 0) & (x < 100_000), from_ole_days(x))


LISTING_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "MM/dd/yyyy HH:mm:ss", "dd.MM.yyyy HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "MM/dd/yyyy hh:mm:ss a", "dd-MMM-yyyy HH:mm:ss", "yyyy-MM-dd")


def parsed(text: Column) -> Column:
    """H-4: the first of the listing formats that fits; text without a zone is UTC."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in LISTING_FORMATS])


def one_decimal(x: Column) -> Column:
    """A double from 0 on with one decimal, rounded by its exact binary value, ties to even.

    The fraction of a double is exact. It is held against the doubles next to 0.05, 0.15 and so on, of which it is
    known whether they are above or below those.
    """
    whole = F.floor(x)
    rest, tenths = x - whole, whole * 10
    for k in range(10):
        edge, near = Fraction(2 * k + 1, 20), (2 * k + 1) / 20
        up = Fraction(near) > edge or Fraction(near) == edge and k % 2 == 1
        tenths = tenths + F.when(rest >= near if up else rest > near, 1).otherwise(0)
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def duration_text(seconds: Column) -> Column:
    """H-5: hours, days or weeks with one decimal."""
    hours = seconds / 3600
    return F.when(hours < 24, F.concat(one_decimal(hours), F.lit(" hours"))).when(hours < 168, F.concat(one_decimal(hours / 24), F.lit(" days"))).otherwise(F.concat(one_decimal(hours / 168), F.lit(" weeks")))


def span_text(seconds: Column) -> Column:
    """H-5: "1h 1m 1s" without the parts that are 0; "0s" for none and for negative ones."""
    whole = F.greatest(seconds, F.lit(0)).cast("long")
    parts = [(F.floor(whole / 3600), "h"), (F.floor(whole % 3600 / 60), "m"), (whole % 60, "s")]
    text = F.concat_ws(" ", *[F.when(n > 0, F.concat(n.cast("string"), F.lit(unit))) for n, unit in parts])
    return F.when(seconds.isNotNull(), F.when(text == "", "0s").otherwise(text))


#: Date and time texts that are read beside ISO.
DATE_FORMATS = ("yyyy-MM-dd", "dd.MM.yyyy", "MM/dd/yyyy")
TIME_FORMATS = ("", " HH:mm", " HH:mm:ss", " HH:mm:ss.SSSSSS", " HH:mm:ss.SSS")


def local_date_text(text: Column, form: str = "eu", time: bool = True, seconds: bool = True) -> Column:
    """H-5: a date or time as dd.MM.yyyy (eu) or MM/dd/yyyy (us), with its time where it has one; what can't be read stays.

    The wall-clock time is kept, whatever the offset behind it. Null is the empty text.
    """
    value = F.trim(F.coalesce(text, F.lit("")))
    plain = F.regexp_replace(F.regexp_replace(value, " UTC$", ""), r"^(.{10,}?)(?:Z|[+-]\d{2}:?\d{2}(?::\d{2})?)$", "$1")
    plain = F.regexp_replace(plain, r"^(\d{4}-\d{2}-\d{2})T", "$1 ")
    at = F.coalesce(*[F.try_to_timestamp(plain, F.lit(d + t)) for d in DATE_FORMATS for t in TIME_FORMATS])
    date = "dd.MM.yyyy" if form == "eu" else "MM/dd/yyyy"
    clock = " HH:mm:ss" if seconds else " HH:mm"
    shown = F.when(F.lit(time) & value.contains(":"), F.date_format(at, date + clock)).otherwise(F.date_format(at, date))
    return F.coalesce(shown, value)


def size_text(n: Column) -> Column:
    """H-5: bytes in the largest unit below 1024."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(n >= 1024**k, F.concat(one_decimal(n / 1024**k), F.lit(f" {unit}"))).otherwise(out)
    return out


def scheme(url: Column) -> Column:
    """H-6."""
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def domain(url: Column) -> Column:
    """H-6: the authority, with user and port where given."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def registered_domain(host: Column, suffixes: list[str] | None = None) -> Column:
    """H-7: the label before the public suffix, with it.

    suffixes: the rules of a public suffix list ("co.uk", "*.ck", "!www.ck"), read from its file by the caller; without
    one, the last label and a few common suffixes of two labels count. The longest rule wins, exceptions before all.
    """
    name = F.lower(F.regexp_replace(host, r":[0-9]+$", ""))
    labels = F.split(name, r"\.")
    n = F.size(labels)
    rules = {r.lower().strip().lstrip(".") for r in (SUFFIXES if suffixes is None else suffixes)} - {""}
    tail = lambda k: F.array_join(F.slice(labels, -k, k), ".")
    longest = max((r.count(".") + 1 for r in rules), default=1)
    size = F.lit(1)  # labels of the suffix
    for k in range(1, longest + 1):
        plain = sorted(r for r in rules if r[0] not in "!*" and r.count(".") + 1 == k)
        wild = sorted(r[2:] for r in rules if r.startswith("*.") and r.count(".") + 1 == k)
        fits = tail(k).isin(plain) if plain else F.lit(False)
        fits = fits | (tail(k - 1).isin(wild) if wild else F.lit(False))
        size = F.when((n >= k) & fits, k).otherwise(size)
    for k in range(2, longest + 2):
        if except_for := sorted(r[1:] for r in rules if r.startswith("!") and r.count(".") + 1 == k):
            size = F.when((n >= k) & tail(k).isin(except_for), k - 1).otherwise(size)
    own = F.array_join(F.slice(labels, F.greatest(n - size, F.lit(1)), F.least(size + 1, n)), ".")
    return F.when(host.rlike(r"^[0-9.]+(:[0-9]+)?$") | (n < 2), F.lower(host)).otherwise(own)


def without_www(host: Column) -> Column:
    """H-8."""
    return F.regexp_replace(host, r"^[wW]{3}\.", "")


def extension(url: Column) -> Column:
    """H-9: of the last path component, with its dot; none for a leading or a trailing one."""
    return F.lower(F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"[^/.][^/]*?(\.[^/.]+)$", 1))


def file_type(ext: Column) -> Column:
    """H-9: by extension, else other."""
    out = F.lit("other")
    for kind, names in FILE_TYPES.items():
        out = F.when(ext.isin(*[f".{n}" for n in names.split()]), kind).otherwise(out)
    return out


def file_name(path: Column) -> Column:
    """H-11."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def inode(text: Column) -> Column:
    """H-11: the first number of a-b-c."""
    return F.try_to_number(F.regexp_extract(text, r"^(\d+)", 1), F.lit("9999999999999999999")).cast("long")


def glob_regex(pattern: str, whole: bool = True) -> str:
    """H-12: * stays within a path component, ** does not; ? and [classes]."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[" and (j := pattern.find("]", i + 2)) > 0:
            inner = pattern[i + 1 : j]
            out, i = out + "[" + ("^" + inner[1:] if inner[0] == "!" else inner).replace("\\", "\\\\") + "]", j + 1
            continue
        out += {"*": "[^/]*", "?": "[^/]"}.get(c, c if c.isalnum() or c in "_/- " else "\\" + c)
        i += 1
    return f"(?i)^{out}$" if whole else f"(?i){out}"


def fnmatch_regex(pattern: str) -> str:
    """The anchored pattern of URL and file-name lists, where * and ? match any character."""
    return glob_regex(pattern.replace("*", "**")).replace("[^/]", ".")


def normal_path(path: Column) -> Column:
    """H-13."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^[A-Za-z]:", ""), "/+", "/")


def user_of_path(path: Column) -> Column:
    """H-13."""
    return F.nullif(F.regexp_extract(normal_path(path), r"(?i)/(?:users|home|documents and settings)/([^/]+)", 1), F.lit(""))


def transition_core(code: Column) -> Column:
    """H-21: the core type of a transition."""
    core = code.bitwiseAND(F.lit(255))
    name = F.get(F.array(*[F.lit(t) for t in TRANSITIONS]), core.cast("int"))
    return F.when(code.isNull(), "UNKNOWN").otherwise(F.coalesce(name, F.concat(F.lit("UNKNOWN_"), core.cast("string"))))


def transition(code: Column) -> Column:
    """H-21: the core type and the flags that are set, joined by bars."""
    core = code.bitwiseAND(F.lit(255))
    name = F.coalesce(F.get(F.array(*[F.lit(t) for t in TRANSITIONS]), core.cast("int")), F.concat(F.lit("CORE_"), core.cast("string")))
    flags = [F.when(code.bitwiseAND(F.lit(bit)) != 0, flag) for bit, flag in QUALIFIERS.items()]
    return F.when(code.isNull(), "UNKNOWN").otherwise(F.concat_ws("|", name, *flags))


def image_type(content: Column) -> Column:
    """H-15: by the first bytes."""
    head = F.hex(F.substring(content, 1, 12))
    out = F.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp")
    for magic, name in MAGIC:
        out = out.when(head.startswith(magic), name)
    return out


def note(template: str, columns: dict[str, Column]) -> Column:
    """H-24: the template with its {names} filled in; a missing value stays as its name in braces."""
    parts, rest = [], template
    while "{" in rest:
        text, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(text), F.coalesce(columns[name].cast("string"), F.lit("{" + name + "}")) if name in columns else F.lit("{" + name + "}")]
    return F.concat(*parts, F.lit(rest))


def truth(text: Column) -> Column:
    """H-24: yes, true, 1, y, t in any case."""
    return F.coalesce(F.lower(F.trim(text)).isin("yes", "true", "1", "y", "t"), F.lit(False))
