"""Contact cards: parsing, canonical form, hashes, identity and rewriting as column expressions.

A parsed card is ``array<struct<grp, name, params: array<struct<name, vals>>, value>>``; all in JVM functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.functions import text as T

CANONICAL_VERSION = 2
#: Properties that never count, dates, and parameters whose values have no case; fixed values.
VOLATILE = ("REV", "PRODID", "VND-63-SENSITIVE-CONTENT-CONFIG")
DATES = ("BDAY", "ANNIVERSARY")
CASELESS = ("TYPE", "ENCODING", "VALUE", "CHARSET")
_OUTSIDE_QUOTES = '(?=(?:[^"]*"[^"]*")*[^"]*$)'
_TOKEN = "[A-Za-z0-9_-]+"


def let(value: Column, body) -> Column:
    """*body* of a value that is computed once; a plain Python variable would repeat the expression at each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def logical_lines(raw: Column) -> Column:
    """Unfolded lines of a card's bytes; null where a line is not UTF-8. Folds may split a character."""
    latin = F.regexp_replace(F.decode(raw, "ISO-8859-1"), "^\u00ef\u00bb\u00bf", "")
    whole = F.regexp_replace(latin, "(?<=[^\\r\\n])\\r?\\n(?:\\r?\\n)*[ \\t]", "")
    kept = F.filter(F.transform(F.split(whole, "\n"), lambda x: F.regexp_replace(x, "\r$", "")), lambda x: x != "")
    return F.transform(kept, lambda x: F.try_validate_utf8(F.encode(x, "ISO-8859-1")))


def parse_line(line: Column) -> Column:
    """One property, or null where the line is not ``[group.]name(;param)*:value``."""
    grammar = '(?s)^((?:[^":]++|"[^"]*+")*+):(.*)$'
    named = f"^(?:({_TOKEN})\\.)?({_TOKEN})$"
    unquote = lambda v: F.regexp_replace(v, '^"(.*)"$', "$1")
    param = lambda p: F.when(
        F.instr(p, "=") > 0,
        F.struct(F.regexp_extract(p, "^([^=]*)=", 1).alias("name"), F.transform(F.split(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1), "," + _OUTSIDE_QUOTES), unquote).alias("vals")),
    ).otherwise(F.struct(F.lit("TYPE").alias("name"), F.array(unquote(p)).alias("vals")))

    def prop(parts: Column) -> Column:
        label = F.get(parts, F.lit(0))
        params = F.transform(F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p != ""), param)
        fields = (
            F.nullif(F.regexp_extract(label, named, 1), F.lit("")).alias("grp"),
            F.regexp_extract(label, named, 2).alias("name"),
            params.alias("params"),
            F.regexp_extract(line, grammar, 2).alias("value"),
        )
        return F.when(label.rlike(named), F.struct(*fields))

    head = F.when(line.rlike(grammar), F.regexp_extract(line, grammar, 1))
    return let(F.split(head, ";" + _OUTSIDE_QUOTES), prop)


def parse(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add props, uid, error (a code, null for a good card) and error_line (of a line that is not UTF-8 or malformed, from
    1, among the unfolded ones) to rows with a card's bytes."""
    df = df.withColumn("_lines", logical_lines(F.col(raw)))
    df = df.withColumn("_props", F.transform("_lines", parse_line)).withColumn("_names", F.transform("_props", lambda p: F.upper(p["name"])))
    first = F.get("_props", F.lit(0))
    is_begin = (F.upper(first["name"]) == "BEGIN") & (F.upper(T.unicode_trim(first["value"])) == "VCARD") & first["grp"].isNull()
    begins = F.size(F.filter("_names", lambda n: n == "BEGIN"))
    ends = F.array_position("_names", F.lit("END"))
    version = T.unicode_trim(F.get(F.filter("_props", lambda p: F.upper(p["name"]) == "VERSION"), F.lit(0))["value"])
    uid = T.unicode_trim(F.get(F.filter("_props", lambda p: F.upper(p["name"]) == "UID"), F.lit(0))["value"])
    error = (
        F.when(F.exists("_lines", lambda x: x.isNull()), "not_utf8")
        .when(F.exists("_props", lambda p: p.isNull()), "malformed_line")
        .when((F.size("_props") == 0) | ~F.coalesce(is_begin, F.lit(False)), "missing_begin")
        .when(begins > 1, "nested_begin")
        .when(ends == 0, "missing_end")
        .when(ends < F.size("_names"), "after_end")
        .when(version.isNull(), "missing_version")
        .when(version != "3.0", "unsupported_version")
        .when(F.coalesce(uid, F.lit("")) == "", "missing_uid")
    )
    bad = F.when(error == "not_utf8", F.array_position(F.transform("_lines", lambda x: x.isNull()), F.lit(True))).when(error == "malformed_line", F.array_position(F.transform("_props", lambda p: p.isNull()), F.lit(True)))
    out = df.withColumns({"error": error, "error_line": bad})
    return out.withColumns({"props": F.when(F.col("error").isNull(), F.col("_props")), "uid": F.when(F.col("error").isNull(), uid)}).drop("_lines", "_props", "_names")


def canonical_line(p: Column) -> Column:
    """NAME;PARAM=values:value without the group, in the one spelling that compares equal."""
    is_date = F.upper(p["name"]).isin(*DATES)
    tidy = lambda n, v: F.when(n.isin(*CASELESS), F.when((n == "ENCODING") & (F.upper(v) == "BASE64"), "B").otherwise(F.upper(v))).otherwise(v)
    params = F.transform(p["params"], lambda q: F.struct(F.upper(q["name"]).alias("name"), F.transform(q["vals"], lambda v: tidy(F.upper(q["name"]), v)).alias("vals")))
    params = F.filter(params, lambda q: ~(is_date & (q["name"] == "VALUE") & F.forall(q["vals"], lambda v: F.upper(v) == "DATE")))

    def joined(params: Column) -> Column:
        names = F.array_sort(F.array_distinct(F.transform(params, lambda q: q["name"])))

        def merged(n: Column) -> Column:
            vals = F.flatten(F.transform(F.filter(params, lambda q: q["name"] == n), lambda q: q["vals"]))
            vals = let(vals, lambda v: F.when(n.isin(*CASELESS), F.array_sort(F.array_distinct(v))).otherwise(v))
            return F.concat(F.lit(";"), n, F.lit("="), F.array_join(F.transform(vals, T.quote_if_needed), ","))

        return F.array_join(F.transform(names, merged), "")

    head = F.when(F.size(p["params"]) > 0, let(params, joined)).otherwise("")
    value = F.when(is_date, T.canonical_date(p["value"])).otherwise(T.canonical_value(p["value"]))
    return F.concat(F.upper(p["name"]), head, F.lit(":"), value)


def canonical_form(props: Column, without: tuple[str, ...] = ()) -> Column:
    """The text whose hash says whether a card has changed in meaning; *without* may name PHOTO and UID."""
    dropped = VOLATILE + tuple(without)
    lines = F.transform(F.filter(props, lambda p: ~F.upper(p["name"]).isin(*dropped)), lambda p: F.struct(F.lower(p["grp"]).alias("grp"), canonical_line(p).alias("line")))

    def sorted_lines(lines: Column) -> Column:
        plain = F.transform(F.filter(lines, lambda x: x["grp"].isNull()), lambda x: x["line"])
        labels = F.array_distinct(F.transform(F.filter(lines, lambda x: x["grp"].isNotNull()), lambda x: x["grp"]))
        buckets = F.array_sort(F.transform(labels, lambda g: F.array_sort(F.transform(F.filter(lines, lambda x: x["grp"] == g), lambda x: x["line"]))))
        grouped = F.flatten(F.transform(buckets, lambda b, i: F.transform(b, lambda x: F.concat(F.lit("G"), (i + 1).cast("string"), F.lit("."), x))))
        return F.array_sort(F.concat(plain, grouped))

    body = F.transform(let(lines, sorted_lines), lambda x: F.concat(x, F.lit("\n")))
    return F.concat(F.lit(f"CANONICAL:{CANONICAL_VERSION}\n"), F.array_join(body, ""))


def canonical_hash(props: Column, without: tuple[str, ...] = ()) -> Column:
    return F.sha2(canonical_form(props, without).cast("binary"), 256)


def values_of(props: Column, name: str) -> Column:
    return F.transform(F.filter(props, lambda p: F.upper(p["name"]) == name), lambda p: p["value"])


def identity(props: Column) -> Column:
    """struct(name, org): first usable FN, else N in reading order, unless it is a contact point; first ORG part. Each is
    on one line: no control characters, single blanks."""
    fn = F.get(F.filter(F.transform(values_of(props, "FN"), lambda v: T.collapse(T.unescape(v))), lambda v: v != ""), F.lit(0))
    n = F.transform(T.components(F.get(values_of(props, "N"), F.lit(0))), T.unescape)
    in_order = F.transform(F.array(*[F.lit(i) for i in (3, 1, 2, 0, 4)]), lambda i: F.coalesce(F.get(n, i), F.lit("")))
    org = T.collapse(T.unescape(F.get(T.components(F.get(values_of(props, "ORG"), F.lit(0))), F.lit(0))))
    return F.struct(T.display_name(F.coalesce(fn, F.array_join(in_order, " "))).alias("name"), F.nullif(org, F.lit("")).alias("org"))


def match_keys(props: Column) -> Column:
    """struct(name, emails, phones, org), lower case, arrays sorted and distinct."""
    tidy = lambda x: F.array_sort(F.array_distinct(F.filter(x, lambda v: v.isNotNull())))
    keys = lambda who: F.struct(
        F.lower(who["name"]).alias("name"),
        tidy(F.transform(values_of(props, "EMAIL"), T.normalize_email)).alias("emails"),
        tidy(F.transform(values_of(props, "TEL"), T.normalize_phone)).alias("phones"),
        F.lower(who["org"]).alias("org"),
    )
    return let(identity(props), keys)


def tokens(keys: Column) -> Column:
    """Contact points as tagged tokens, so that an email never equals a phone."""
    return F.concat(F.transform(keys["emails"], lambda v: F.concat(F.lit("e:"), v)), F.transform(keys["phones"], lambda v: F.concat(F.lit("p:"), v)))


def members(props: Column) -> Column:
    """Uids a group card lists."""
    listed = F.filter(values_of(props, "X-ADDRESSBOOKSERVER-MEMBER"), lambda v: F.lower(v).startswith("urn:uuid:"))
    return F.transform(listed, lambda v: F.substr(v, F.lit(10)))


def is_group(props: Column) -> Column:
    return F.exists(F.concat(values_of(props, "X-ADDRESSBOOKSERVER-KIND"), values_of(props, "KIND")), lambda v: F.lower(T.unicode_trim(v)) == "group")


def photo(props: Column) -> Column:
    """struct(kind, bytes, uri, hash) of the first PHOTO: inline, uri, unreadable; null without one."""
    p = F.get(F.filter(props, lambda x: F.upper(x["name"]) == "PHOTO"), F.lit(0))
    has = lambda name, values: F.exists(p["params"], lambda q: (F.upper(q["name"]) == name) & F.exists(q["vals"], lambda v: F.upper(v).isin(*values)))
    data = F.try_to_binary(F.regexp_replace(p["value"], "[ \\t\\r\\n\\f]", ""), F.lit("base64"))
    inline = has("ENCODING", ("B", "BASE64"))
    is_uri = has("VALUE", ("URI",)) | F.lower(p["value"]).rlike("^https?://")
    kind = F.when(inline & data.isNotNull(), "inline").when(~inline & is_uri, "uri").otherwise("unreadable")
    return F.when(p.isNotNull(), F.struct(kind.alias("kind"), F.when(kind == "inline", data).alias("bytes"), F.when(kind == "uri", p["value"]).alias("uri"), F.when(kind == "inline", F.sha2(data, 256)).alias("hash")))


def photo_bytes(props: Column) -> Column:
    """Bytes that a card's embedded photos take, estimated from their base64 characters; null without one."""
    embedded = F.filter(props, lambda p: (F.upper(p["name"]) == "PHOTO") & F.exists(p["params"], lambda q: (F.upper(q["name"]) == "ENCODING") & F.exists(q["vals"], lambda v: F.upper(v).isin("B", "BASE64"))))
    chars = F.aggregate(embedded, F.lit(0).cast("long"), lambda n, p: n + F.length(F.regexp_replace(p["value"], "[ \\t\\r\\n\\f=]", "")))
    return F.when(F.size(embedded) > 0, T.photo_size(chars))


def strip_photo(raw: Column) -> Column:
    """The card's bytes without its embedded photos; one that is an address stays, as does every other byte."""
    latin = F.decode(raw, "ISO-8859-1")
    line = "(?imd)^(?:[a-z0-9_-]+\\.)?photo(?=[^:\\n]*;encoding=(?:b|base64)[;:\\r\\n])[;:][^\\n]*\\n(?:[ \\t][^\\n]*\\n)*"
    return F.encode(F.regexp_replace(latin, line, ""), "ISO-8859-1")


def without_photos(raw: Column) -> Column:
    """The card's bytes without PHOTO lines and their folds; every other byte stays."""
    latin = F.decode(raw, "ISO-8859-1")
    return F.encode(F.regexp_replace(latin, "(?imd)^(?:[a-z0-9_-]+\\.)?photo[;:][^\\n]*\\n(?:[ \\t][^\\n]*\\n)*", ""), "ISO-8859-1")


def with_inline_photo(raw: Column, data: Column) -> Column:
    """The card with one embedded photo before END, folded at 75 characters, in the line ending of END."""
    bare = F.decode(without_photos(raw), "ISO-8859-1")
    eol = F.when(bare.rlike("(?i)END:VCARD\\r\\n"), "\r\n").otherwise("\n")
    magic = F.hex(F.substring(data, 1, 4))
    kind = F.when(magic.startswith("FFD8FF"), ";TYPE=JPEG").when(magic == "89504E47", ";TYPE=PNG").when(magic == "47494638", ";TYPE=GIF").otherwise("")
    line = F.concat(F.lit("PHOTO;ENCODING=b"), kind, F.lit(":"), F.regexp_replace(F.base64(data), "[\\r\\n]", ""))
    rest = F.regexp_replace(F.substr(line, F.lit(76)), "(.{1,74})", "\n $1")
    folded = F.concat(F.replace(F.concat(F.substring(line, 1, 75), rest), F.lit("\n"), eol), eol)
    at = F.regexp_instr(bare, F.lit("(?imd)^END:VCARD"))
    return F.encode(F.concat(F.substring(bare, F.lit(1), at - 1), folded, F.substr(bare, at)), "ISO-8859-1")


def with_uid(raw: Column, uid: Column) -> Column:
    """The first UID line becomes [group.]UID:<uid>; its parameters and folds go, its line ending stays."""
    latin = F.decode(raw, "ISO-8859-1")
    line = "(?imd)^((?:[a-z0-9_-]+\\.)?uid)[;:][^\\r\\n]*(?:\\r?\\n[ \\t][^\\r\\n]*)*"
    at = F.regexp_instr(latin, F.lit(line))
    found = F.regexp_substr(latin, F.lit(line))
    label = F.regexp_extract(latin, line, 1)
    bytes_uid = F.decode(uid.cast("binary"), "ISO-8859-1")
    new = F.concat(F.substring(latin, F.lit(1), at - 1), label, F.lit(":"), bytes_uid, F.substr(latin, at + F.length(found)))
    return F.when(at > 0, F.encode(new, "ISO-8859-1")).otherwise(raw)


_PHOTO_LINES = "(?imd)^(?:[a-z0-9_-]+\\.)?photo[;:][^\\n]*\\n(?:[ \\t][^\\n]*\\n)*"


def with_photos_of(raw: Column, other: Column) -> Column:
    """The card with the other card's PHOTO lines before END; unchanged if it has one itself or the other has none."""
    own, theirs = F.decode(raw, "ISO-8859-1"), F.decode(other, "ISO-8859-1")
    lines = F.array_join(F.regexp_extract_all(theirs, F.lit(f"({_PHOTO_LINES})"), F.lit(1)), "")
    at = F.regexp_instr(own, F.lit("(?imd)^END:VCARD"))
    merged = F.encode(F.concat(F.substring(own, F.lit(1), at - 1), lines, F.substr(own, at)), "ISO-8859-1")
    return F.when(own.rlike(_PHOTO_LINES) | (lines == ""), raw).otherwise(merged)


def with_member_uids(raw: Column, aliases: Column) -> Column:
    """A group card with the members that *aliases* (map of old uid to new) names renamed; such a line comes back
    unfolded, every other byte stays, and a card without one of them is returned as it is."""
    latin = F.decode(raw, "ISO-8859-1")
    line = "(?imd)^((?:[a-z0-9_-]+\\.)?x-addressbookserver-member[^:\\r\\n]*:urn:uuid:)([^\\r\\n]*(?:\\r?\\n[ \\t][^\\r\\n]*)*)"
    heads = F.regexp_extract_all(latin, F.lit(line), F.lit(1))
    tails = F.regexp_extract_all(latin, F.lit(line), F.lit(2))
    gaps = F.split(latin, line)
    plain = lambda t: F.regexp_replace(t, "\\r?\\n[ \\t]", "")
    renamed = F.transform(tails, lambda t: F.coalesce(F.try_element_at(aliases, plain(t)), t))
    whole = F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(heads, i), F.lit("")), F.coalesce(F.get(renamed, i), F.lit(""))))
    hit = F.exists(tails, lambda t: F.try_element_at(aliases, plain(t)).isNotNull())
    return F.when(hit, F.encode(F.array_join(whole, ""), "ISO-8859-1")).otherwise(raw)
