"""Card parsing, canonical form and rewriting."""

from pyspark.sql import functions as F

from pairwright.functions import cards
from pairwright.functions import text as T

GROUP = b"""BEGIN:VCARD
VERSION:3.0
PRODID:-//any//EN
N:Book Club
FN:Book Club
X-ADDRESSBOOKSERVER-KIND:group
X-ADDRESSBOOKSERVER-MEMBER:urn:uuid:4F1B6B2A-8C1E-4D6F-9E5A-0B1C2D3E4F50
X-ADDRESSBOOKSERVER-MEMBER:urn:uuid:9A8B7C6D-5E4F-4A3B-8C2D-1E0F9A8B7C6D
REV:2026-09-01T12:00:00Z
UID:0D9C8B7A-6F5E-4D3C-2B1A-0F9E8D7C6B5A
END:VCARD
"""


def card(*lines: str, uid: str = "u1", eol: str = "\r\n") -> bytes:
    return (eol.join(["BEGIN:VCARD", "VERSION:3.0", f"UID:{uid}", *lines, "END:VCARD"]) + eol).encode()


def parsed(spark, *raws):
    return cards.parse(spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(raws)], "i int, raw binary")).orderBy("i")


def test_known_hash(spark):
    df = parsed(spark, GROUP).select(cards.canonical_hash(F.col("props")).alias("h"), cards.members(F.col("props")).alias("m"), cards.is_group(F.col("props")).alias("g"))
    row = df.first()
    assert row.h == "9a854fa75aeaace24707742972c2c18ec3d35e8a08e1fb113bb426e1c7dfecb4"
    assert len(row.m) == 2 and row.g


def test_equal_in_meaning(spark):
    a = card("FN:Ann", "item1.EMAIL;type=WORK;TYPE=pref:a@b.c", "item1.X-ABLabel:x", "BDAY;VALUE=date:1980-04-01", "NOTE:one\\Ntwo", "PHOTO;ENCODING=BASE64:QUJD")
    b = card("NOTE:one\\ntwo", "photo;encoding=b:QUJD", "x9.X-ABLabel:x", "x9.EMAIL;TYPE=PREF,WORK:a@b.c", "bday:19800401", "fn:Ann", "REV:now", eol="\n")
    c = card("NOTE:one\\\\Ntwo", "FN:Ann")
    h = [r.h for r in parsed(spark, a, b, c).select(cards.canonical_hash(F.col("props")).alias("h")).collect()]
    assert h[0] == h[1] != h[2]


def test_folds_and_errors(spark):
    folded = "BEGIN:VCARD\r\nVERSION:3.0\r\nUID:u\r\nFN:caf\u00e9".encode()[:-1] + b"\r\n \xa9 ole\r\n\r\nEND:VCARD\r\n"
    bad = [
        b"FN:x\nEND:VCARD\n",
        card("nonsense"),
        card("FN:x").replace(b"END:VCARD\r\n", b""),
        card("FN:x") + b"FN:y\r\n",
        card("FN:x").replace(b"VERSION:3.0", b"VERSION:4.0"),
        card("FN:x", uid=" "),
        card("FN:\xff").replace("\xff".encode(), b"\xff"),
        card("BEGIN:VCARD"),
    ]
    rows = parsed(spark, folded, *bad).select("error", cards.values_of(F.col("props"), "FN").alias("fn")).collect()
    assert rows[0].error is None and rows[0].fn == ["caf\u00e9 ole"]
    assert [r.error for r in rows[1:]] == ["missing_begin", "malformed_line", "missing_end", "after_end", "unsupported_version", "missing_uid", "not_utf8", "nested_begin"]


def test_identity_and_keys(spark):
    a = card("FN:Dr. Jane\\, Q", "ORG:Example;Research", "EMAIL: Jane@X.org ", "TEL:+1 (555) 010", "TEL:none", 'EMAIL;X="a:b;c":jane@x.org')
    b = card("FN:+1 555 010", "N:Doe;John;M.;Mr.;Jr.")
    c = card("N:Doe;John;M.;Mr.;Jr.")
    rows = parsed(spark, a, b, c).select(cards.match_keys(F.col("props")).alias("k"), cards.identity(F.col("props")).alias("w")).collect()
    k = rows[0].k
    assert (k.name, k.emails, k.phones, k.org) == ("dr. jane, q", ["jane@x.org"], ["+1555010"], "example")
    assert rows[1].w.name is None and rows[2].w.name == "Mr. John M. Doe Jr."


def test_photos_and_uid(spark):
    a = card("FN:x", "PHOTO;ENCODING=b:QUJD", "NOTE:n")
    df = parsed(spark, a).select("raw", cards.photo(F.col("props")).alias("p"), cards.without_photos(F.col("raw")).alias("bare"))
    df = df.withColumn("again", cards.with_inline_photo(F.col("raw"), F.unhex(F.lit("FFD8FF" + "00" * 120)))).withColumn("re", cards.with_uid(F.col("raw"), F.lit("new")))
    r = df.first()
    assert r.p.kind == "inline" and bytes(r.p.bytes) == b"ABC"
    assert bytes(r.bare) == card("FN:x", "NOTE:n") and bytes(r.re) == card("FN:x", "PHOTO;ENCODING=b:QUJD", "NOTE:n", uid="new")
    lines = bytes(r.again).split(b"\r\n")
    at = [i for i, x in enumerate(lines) if x.startswith(b"PHOTO;ENCODING=b;TYPE=JPEG:")][0]
    assert len(lines[at]) == 75 and len(lines[at + 1]) == 75 and lines[at + 1][:1] == b" "
    back = parsed(spark, bytes(r.again)).select(cards.photo(F.col("props")).alias("p")).first()
    assert bytes(back.p.bytes) == bytes.fromhex("FFD8FF" + "00" * 120)


def test_photo_lines_and_members_are_rewritten(spark):
    a, b = card("FN:x"), card("PHOTO;ENCODING=b:QUJD\r\n REVG", "FN:y", "item1.PHOTO:z")
    g = GROUP.replace(b"MEMBER:urn:uuid:9A8B", b"MEMBER:URN:UUID:9A\n 8B")
    df = spark.createDataFrame([(bytearray(a), bytearray(b), bytearray(g))], "a binary, b binary, g binary")
    names = F.create_map(F.lit("9A8B7C6D-5E4F-4A3B-8C2D-1E0F9A8B7C6D"), F.lit("NEW"))
    r = df.select(
        cards.with_photos_of(F.col("a"), F.col("b")).alias("x"),
        cards.with_photos_of(F.col("b"), F.col("b")).alias("same"),
        cards.with_member_uids(F.col("g"), names).alias("g"),
        cards.with_member_uids(F.col("a"), names).alias("none"),
    ).first()
    assert bytes(r.x) == card("FN:x", "PHOTO;ENCODING=b:QUJD\r\n REVG", "item1.PHOTO:z") and bytes(r.same) == b and bytes(r.none) == a
    assert bytes(r.g) == GROUP.replace(b"MEMBER:urn:uuid:9A8B7C6D-5E4F-4A3B-8C2D-1E0F9A8B7C6D", b"MEMBER:URN:UUID:NEW")


def test_text(spark):
    f = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert f(T.unescape(F.lit("a\\nb\\\\nc\\,d\\"))) == "a\nb\\nc,d\\"
    assert f(T.unescape(F.lit("a\ue0ffb\\N$1\\;c"))) == "a\ue0ffb\n$1;c"
    at = F.to_timestamp(F.lit("1994-11-06 08:40:00"))
    assert [f(T.retry_after(F.lit(x), at)) for x in ("Sunday, 06-Nov-94 08:49:37 GMT", "Sun Nov  6 08:49:37 1994", "Sun, 06 Nov 1994 08:49:37 GMT", "Sunday, 06-Nov-45 08:49:37 GMT", "Sun Nov 06 08:49:37 94")] == [577, 577, 577, 0, None]
    assert f(T.components(F.lit(r"a\;b;c;"))) == [r"a\;b", "c", ""]
    assert f(T.canonical_date(F.lit("--05-30"))) == "--0530" and f(T.canonical_date(F.lit("1980-04-01T16:37:00Z"))) == "19800401T163700Z"
    assert f(T.canonical_value(F.lit("a\\\\N\\N"))) == "a\\\\N\\n"
    now = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    got = [f(T.retry_after(F.lit(x), now)) for x in ("5", "99999999999999999999", "Mon, 01 Jan 2024 00:01:00 GMT", "Mon, 01 Jan 2020 00:01:00 GMT", "x")]
    assert got == [5, 3600, 60, 0, None]
    assert [f(T.backoff_seconds(F.lit(n))) for n in (1, 2, 10, 11, 5000)] == [120, 240, 61440, 86400, 86400]
    assert f(T.restore_crlf(F.lit("a\nb\r\nc"))) == "a\r\nb\r\nc"


def test_any_order_of_properties_has_one_hash(spark):
    import random

    rng = random.Random(6)
    lines = ["FN:Ann", "item1.EMAIL;type=WORK:a@b.c", "item1.X-ABLabel:x", "item2.EMAIL:a@b.c", "item2.X-ABLabel:a", r"NOTE:x\;y", "TEL;TYPE=a,b:1", "ORG:o;p"]
    cards_ = []
    for _ in range(25):
        order = rng.sample(lines, len(lines))
        swap = rng.random() < 0.5
        order = [x.replace("item1", "item9").replace("item2", "item1").replace("item9", "item2") if swap else x for x in order]
        cards_.append(card(*order, eol=rng.choice(["\n", "\r\n"])))
    rows = parsed(spark, *cards_).select(cards.canonical_hash(F.col("props")).alias("h")).collect()
    assert len({r.h for r in rows}) == 1 and rows[0].h is not None
