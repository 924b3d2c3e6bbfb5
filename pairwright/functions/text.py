"""Scalar functions over card and protocol text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unicode_trim(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def unescape(x: Column) -> Column:
    r"""``\n`` and ``\N`` are line feeds, any other escaped character is itself, a last backslash stays."""
    # A line feed first becomes an escaped character like others, so no place-holder is needed.
    escaped = F.regexp_replace(x, r"\G((?:(?s:[^\\]++)|(?s:\\[^nN]))*+)\\[nN]", "$1\\\\\n")
    return F.regexp_replace(escaped, r"(?s)\\(.)", "$1")


def components(x: Column) -> Column:
    """Parts between unescaped semicolons, still escaped."""
    return F.transform(F.regexp_extract_all(F.concat(x, F.lit(";")), F.lit(r"((?s:\\.|[^;\\])*+\\?);"), F.lit(1)), lambda p: p)


def canonical_value(x: Column) -> Column:
    r"""``\N`` written ``\n``; other escape pairs are left alone, read from the left."""
    return F.regexp_replace(x, r"\G((?:(?s:[^\\]++)|(?s:\\[^N]))*+)\\N", r"$1\\n")


def canonical_date(x: Column) -> Column:
    """Dates without separators (``--MM-DD`` keeps its first two), times without colons; other text as a value."""
    at = F.instr(x, "T")
    date = F.when(at > 0, F.substring(x, F.lit(1), at - 1)).otherwise(x)
    time = F.when(at > 0, F.concat(F.lit("T"), F.replace(F.substr(x, at + 1), F.lit(":"), F.lit("")))).otherwise("")
    plain = F.when(date.startswith("--"), F.concat(F.lit("--"), F.replace(F.substr(date, F.lit(3)), F.lit("-"), F.lit("")))).otherwise(F.replace(date, F.lit("-"), F.lit("")))
    return F.when(x.rlike("^[0-9:TZ+-]*$"), F.concat(plain, time)).otherwise(canonical_value(x))


def quote_if_needed(x: Column) -> Column:
    return F.when(x.rlike("[,;:]"), F.concat(F.lit('"'), x, F.lit('"'))).otherwise(x)


def hex_digest(x: Column) -> Column:
    """A 64-digit hex hash in lower case, null if it isn't one."""
    return F.when(x.rlike("^[0-9a-fA-F]{64}$"), F.lower(x))


def looks_like_contact_point(x: Column) -> Column:
    return x.contains("@") | (x.rlike("[0-9]") & x.rlike(r"(?U)^[0-9\s+\-().]*$"))


def collapse(x: Column) -> Column:
    """Control characters removed, white space collapsed and trimmed."""
    return unicode_trim(F.regexp_replace(F.regexp_replace(x, r"\p{Cc}", ""), r"(?U)\s+", " "))


def display_name(x: Column) -> Column:
    """Control characters removed, white space collapsed; null when empty or a contact point."""
    clean = collapse(x)
    return F.when((clean != "") & ~looks_like_contact_point(clean), clean)


def normalize_phone(x: Column) -> Column:
    """Digits, with a plus only if that is the first character that isn't blank; null without digits."""
    digits = F.regexp_replace(x, "[^0-9]", "")
    return F.when(digits != "", F.concat(F.when(x.rlike(r"(?U)^\s*\+"), "+").otherwise(""), digits))


def normalize_email(x: Column) -> Column:
    clean = F.lower(unicode_trim(unescape(x)))
    return F.when(clean != "", clean)


def restore_crlf(x: Column) -> Column:
    return F.regexp_replace(x, r"(?<!\r)\n", "\r\n")


def xml_escape(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def mint_href(collection: Column, uid: Column) -> Column:
    """The name a new record gets: the same for every retry."""
    return F.concat(F.regexp_replace(collection, "/+$", ""), F.lit("/"), F.substring(F.sha2(uid.cast("binary"), 256), 1, 32), F.lit(".vcf"))


def status_class(code: Column, with_href: Column | None = None) -> Column:
    """The error class of an HTTP status. 412 is a failed precondition of a record; without one it is permanent. No status
    at all is a transport error, which is transient."""
    named = F.lit(True) if with_href is None else with_href
    return (
        F.when(code.isNull(), "transient")
        .when(code == 401, "unauthorized")
        .when((code == 412) & named, "precondition_failed")
        .when(code.isin(429, 503), "rate_limited")
        .when((code >= 500) & (code <= 599), "transient")
        .otherwise("permanent")
    )


def http_date(x: Column, now: Column) -> Column:
    """The time of an HTTP date in one of its three forms; a year of two digits is the one that is at most 50 years ahead of *now*."""
    # The zone is part of the pattern, so the session's own doesn't matter.
    read = lambda part, form: F.try_to_timestamp(F.concat(part, F.lit(" +0000")), F.lit(f"{form} Z"))
    fixed = F.when(x.rlike(r"^[A-Za-z]{3}, \d{2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} GMT$"), read(F.substring(x, 6, 20), "dd MMM yyyy HH:mm:ss"))
    day = F.regexp_extract(x, r"^[A-Za-z]+day, (\d{2}-[A-Za-z]{3}-)\d{2} \d{2}:\d{2}:\d{2} GMT$", 1)
    short = F.regexp_extract(x, r"-(\d{2}) (\d{2}:\d{2}:\d{2}) GMT$", 1)
    clock = F.regexp_extract(x, r"(\d{2}:\d{2}:\d{2}) GMT$", 1)
    year = F.when(short != "", F.floor(F.year(now) / 100) * 100 + short.try_cast("int")).cast("int")
    year = F.when(year > F.year(now) + 50, year - 100).otherwise(year)
    older = F.when(day != "", read(F.concat(day, F.lpad(year.cast("string"), 4, "0"), F.lit(" "), clock), "dd-MMM-yyyy HH:mm:ss"))
    plain = F.regexp_replace(F.regexp_extract(x, r"^[A-Za-z]{3} ([A-Za-z]{3} [ \d]\d \d{2}:\d{2}:\d{2} \d{4})$", 1), " +", " ")
    return F.coalesce(fixed, older, F.when(plain != "", read(plain, "MMM d HH:mm:ss yyyy")))


def retry_after(x: Column, now: Column, cap: int = 3600) -> Column:
    """Seconds to wait: digits (too many of them: the cap) or an ``http_date`` (past: 0), at most *cap*; else null."""
    clean = unicode_trim(x)
    number = F.when(F.length(clean) > 9, F.lit(cap).cast("long")).otherwise(F.least(F.lit(cap).cast("long"), F.try_to_number(clean, F.lit("999999999")).cast("long")))
    date = http_date(clean, now)
    wait = F.greatest(F.lit(0).cast("long"), F.least(F.lit(cap).cast("long"), F.unix_timestamp(date) - F.unix_timestamp(now)))
    return F.when(clean.rlike("^[0-9]+$"), number.cast("long")).when(date.isNotNull(), wait)


def backoff_seconds(attempts: Column, base: int = 120, cap: int = 86_400) -> Column:
    """The base doubled per further attempt, up to the cap."""
    return F.least(F.lit(float(cap)), F.lit(float(base)) * F.pow(F.lit(2.0), attempts - 1)).cast("long")


def photo_size(base64_chars: Column) -> Column:
    """Bytes that a run of base64 characters stands for, estimated."""
    return F.floor(base64_chars * 3 / 4).cast("long")
