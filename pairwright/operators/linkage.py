"""Record linkage: pair what both sides hold without a common state, refuse what is ambiguous.

Sides are frames (id, ...); contact points and other tokens are arrays without nulls. A switchboard number on a hundred
thousand cards costs some rows per card, never one per pair: who shares a token with whom is counted by pairs for tokens
with few holders only, and by inclusion and exclusion over sets of the others (``overlap``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from pairwright.functions import subsets
from pairwright.functions.shared import cut

#: A token that more records of the other side hold is heavy: its holders are counted, not listed.
HEAVY = 32
#: Records of so many heavy tokens are counted by all subsets of them at any size of the tables, of more if the tables are large.
WIDE = 8
#: Heavy tokens that one long tells apart.
BITS = 64
#: Most frequent tokens, whose sets are counted apart; rows of a token that are counted together; heavy tokens that one task numbers.
TOP, SLICE, DENSE = 12, 1 << 17, 1 << 16


def pair_uid(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pass 1, the same uid on both sides: adopt where the content is equal, else a baseline conflict."""
    a, b = left.select("uid", F.col("hash").alias("lh")), right.select("uid", F.col("hash").alias("rh"))
    return a.join(b, "uid").select("uid", F.when(F.col("lh").eqNullSafe(F.col("rh")), "adopt").otherwise("conflict").alias("op"))


def content_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pass 2 candidates: equal content hash."""
    return left.select(F.col("id").alias("l"), "hash").join(right.select(F.col("id").alias("r"), "hash"), "hash").select("l", "r")


def content_match(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pass 2 without a row per pair: per content hash both sides' counts, and l, r where each is the other's only one.

    A hash that thousands of records share costs one row, as the counts combine map-side.
    """
    none = F.lit(None).cast(left.schema["id"].dataType)
    both = left.select("hash", F.col("id").alias("l"), none.alias("r")).unionByName(right.select("hash", none.alias("l"), F.col("id").alias("r")))
    per = both.groupBy("hash").agg(F.count("l").alias("n_left"), F.count("r").alias("n_right"), F.min("l").alias("l"), F.min("r").alias("r"))
    single = (F.col("n_left") == 1) & (F.col("n_right") == 1)
    return per.withColumns({"l": F.when(single, F.col("l")), "r": F.when(single, F.col("r"))})


def content_candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per left record that has any: its candidates by content; with a single one, how many claim that one."""
    per = content_match(left, right).filter("n_left > 0 AND n_right > 0")
    count = F.when(F.col("n_right") == 1, F.col("n_left")).otherwise(F.col("n_right"))
    return left.select("id", "hash").join(per.select("hash", count.alias("candidates")), "hash").select("id", "candidates")


def _subsets(df: DataFrame, widest: int) -> DataFrame:
    """(key, set, ...) of all subsets of one token or more of the sorted arrays ``heavy`` of up to *widest*; of a thousand a row at once."""
    low = F.expr("shiftleft(1L, least(size(heavy), 10)) - 1")
    masks = df.filter(F.size("heavy") <= widest).withColumn("hi", F.explode(F.expr("sequence(0L, shiftleft(1L, greatest(size(heavy) - 10, 0)) - 1)")))
    masks = masks.withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), low))).withColumn("m", F.expr("shiftleft(hi, 10) + lo")).filter("m > 0")
    return masks.select("*", F.expr("filter(heavy, (x, i) -> (shiftright(m, i) & 1) = 1)").alias("set")).drop("heavy", "hi", "lo", "m")


def _top_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """(top, n) of what sets of the TOP most frequent tokens add: so few that all their subsets are counted."""
    top = F.expr(f"filter(heavy, x -> x < {TOP})").alias("heavy")
    own, theirs = left.select(top).distinct().withColumn("key", F.col("heavy")), right.groupBy(top).agg(F.sum("holders").alias("holders"))
    held = _subsets(theirs, TOP).groupBy("set").agg(F.sum("holders").alias("holders"))
    sign = F.when(F.size("set") % 2 == 1, F.col("holders")).otherwise(-F.col("holders"))
    return cut(_subsets(own, TOP).join(held.hint("merge"), "set").groupBy(F.col("key").alias("top")).agg(F.sum(sign).alias("n")))


def _compared(left: DataFrame, right: DataFrame, widest: int) -> DataFrame:
    """(id, n) for pairs of which one record has more than *widest* heavy tokens: a row per pair of different sets."""
    own = cut(left.groupBy("heavy").agg(F.count(F.lit(1)).alias("_")).select("heavy", F.monotonically_increasing_id().alias("key")))
    theirs = cut(right.withColumn("other", F.monotonically_increasing_id()))
    wide, t = F.size("heavy") > widest, F.explode("heavy").alias("t")
    ours, others = own.select("key", wide.alias("wide"), t), theirs.select("other", "holders", wide.alias("wide_too"), t)
    some = ours.filter("wide").join(others.hint("merge"), "t").unionByName(ours.filter("NOT wide").join(others.filter("wide_too").hint("merge"), "t"))
    by_set = some.select("key", "other", "holders").distinct().groupBy("key").agg(F.sum("holders").alias("n"))
    by_set = own.join(by_set.hint("merge"), "key").select("heavy", "n")
    return left.join(by_set.hint("merge"), "heavy").select("id", "n")


def _heavy_overlap(left: DataFrame, right: DataFrame, many: int) -> DataFrame:
    """(id, n, first), a record in several rows, over heavy tokens alone, of *left* (id, heavy) and *right* (heavy, holders,
    least), whose records with the same tokens are one row.

    Tokens are numbers in order of their holders, the most first. Each right record that shares tokens with a left one is
    counted by inclusion and exclusion over the shared ones. A set of them is counted where its last token is: each record
    goes there with its tokens before that one, so rows are as many as tokens, and the subsets, of which there are far
    more, are made inside the tasks and never exchanged (``subsets.meet``). A token that a large part of all records hold
    has few tokens before it; sets of the TOP first ones are counted apart. Of a token in more than SLICE rows, sets are
    dealt out by their token before the last, left records by their ids. The least id needs no sets.

    Where a record has so many heavy tokens that comparing it with the other side's distinct records is less work than
    all its subsets, it is compared.

    The joins name their method: an exploded table is far larger than the file Spark would judge it by, and would go
    through the driver as a broadcast.
    """
    sizes = [df.agg(F.count(F.lit(1)), F.max(F.size("heavy"))).first() for df in (left, right)]
    # A record meets few of the other side's sets by each token: a sixteenth of them stands for that.
    widest = max(WIDE, max(n for n, _ in sizes).bit_length() - 5)
    narrow = F.size("heavy") <= widest
    counted = F.sum(F.when(F.col("narrow"), F.col("holders")).otherwise(0)).alias("holders"), F.count_if("narrow").alias("sets"), F.min("least").alias("least")
    held = cut(right.select("holders", "least", narrow.alias("narrow"), F.explode("heavy").alias("t")).groupBy("t").agg(*counted))
    claims = left.filter(narrow).select(F.explode("heavy").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("claims"))
    by_token = cut(held.join(claims.hint("merge"), "t", "left").select("t", "sets", F.coalesce("claims", F.lit(0)).alias("claims")))
    held = F.broadcast(held) if many <= DENSE else held.hint("merge")
    single = F.when(F.col("narrow") & (F.col("t") >= TOP), F.col("holders")).otherwise(0)
    out = left.select("id", narrow.alias("narrow"), F.explode("heavy").alias("t")).join(held, "t").select("id", single.alias("n"), F.col("least").alias("first"))
    none = F.lit(None).cast(right.schema["least"].dataType).alias("first")
    if max(n or 0 for _, n in sizes) > widest:
        out = out.unionByName(_compared(left, right, widest).withColumn("first", none))
    left, right = left.filter(narrow), right.filter(narrow)
    top = F.expr(f"filter(heavy, x -> x < {TOP})").alias("top")
    out = out.unionByName(left.select("id", top).join(F.broadcast(_top_overlap(left, right)), "top").select("id", "n", none))

    keys = ["mine", "id", "holders"]
    each = lambda df: df.select(*keys, F.posexplode("heavy").alias("i", "t"), "heavy").filter(f"i > 0 AND t >= {TOP}").select(*keys, "t", F.expr("slice(heavy, 1, i)").alias("prefix"))
    own = each(left.withColumns({"mine": F.lit(True), "holders": F.lit(0).cast("long")}))
    theirs = each(right.withColumns({"mine": F.lit(False), "id": F.lit(None).cast(left.schema["id"].dataType)}))
    large = by_token.filter((F.col("sets") > SLICE) | (F.col("claims") > SLICE))
    if large.isEmpty():
        rows = own.unionByName(theirs).select("*", F.lit(0).alias("part"), F.lit(1).alias("parts"), F.lit(0).alias("salt"))
    else:
        often = lambda n: F.greatest(F.ceil(n), F.lit(1)).cast("int")
        large = F.broadcast(large.select("t", often(F.col("sets") / SLICE).alias("parts"), often(F.col("claims") / F.greatest("sets", F.lit(SLICE))).alias("salts")))
        part = F.explode(F.expr("array_distinct(transform(prefix, x -> cast(x % parts as int)))")).alias("part")
        dealt = lambda df, salt: df.join(large, "t", "left").fillna(1, ["parts", "salts"]).select(*keys, "t", "prefix", "parts", "salts", part).select(*keys, "t", "prefix", "part", "parts", salt.alias("salt"))
        rows = dealt(own, F.pmod(F.hash("id"), "salts")).unionByName(dealt(theirs, F.explode(F.expr("sequence(0, salts - 1)"))))
    total = by_token.agg(F.coalesce(F.sum(F.col("sets") + F.col("claims")), F.lit(0))).first()[0]
    unit = ["t", "part", "salt"]
    rows = rows.repartition(total // subsets.ROWS + 1, *unit).sortWithinPartitions(*unit, "mine")
    met = rows.mapInArrow(subsets.meet, StructType([left.schema["id"], StructField("n", LongType())]))
    return out.unionByName(met.select("id", "n", none))


def overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, n, first) for the left records (id, tokens) that share a token with a right one: with how many, and the least
    id of them. A record may be several rows. Tokens are split by how many right rows hold them, which is counted beforehand.

    Light tokens, of HEAVY holders at most, send each left record a list of their holders: so many ids per left token at
    most. Heavy ones are counted by ``_heavy_overlap``. A pair that shares tokens of both kinds is in both, so the lists
    leave out holders that have a heavy token in common with the record: each row carries its heavy tokens as bits. Of
    more than 64 heavy tokens some share a bit; those pairs are then compared by the tokens themselves.
    """
    right = right.select(F.col("id").alias("r"), "tokens")
    each = lambda df, *keys: df.select(*keys, F.explode(F.array_distinct("tokens")).alias("t"))
    l, r = each(left, "id"), each(right, "r")
    # Hashes are shorter to exchange than tokens; those that several tokens share only make a few candidates more.
    number = F.hash("t").alias("h")
    often = cut(r.groupBy(number).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HEAVY).select("h"))
    many = 0
    if not often.isEmpty():
        heavy = cut(r.withColumn("h", number).join(often, "h", "left_semi").groupBy("t").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HEAVY))
        many = heavy.count()
    if not many:
        held = r.repartition("t").groupBy("t").agg(F.collect_list("r").alias("rs"))
        return _listed(l.join(held.hint("merge"), "t").select("id", "rs"))
    few = many <= DENSE
    heavy = cut((heavy.coalesce(1) if few else heavy).orderBy(F.desc("n")).select("t", F.monotonically_increasing_id().cast("int" if few else "long").alias("number")))
    bit = F.expr(f"shiftleft(1L, cast(number % {BITS} as int))")
    all_heavy = r.join(heavy, "t", "left_anti").isEmpty()
    kept = [F.sort_array(F.collect_set("number")).alias("heavy")] + [F.bit_or(bit).alias("bits")] * (not all_heavy)
    own, theirs = (df.join(heavy, "t").groupBy(key).agg(*kept) for df, key in ((l, "id"), (r, "r")))
    own, theirs = cut(own), theirs if all_heavy else cut(theirs)
    by_heavy = _heavy_overlap(own.select("id", "heavy"), cut(theirs.groupBy("heavy").agg(F.count(F.lit(1)).alias("holders"), F.min("r").alias("least"))), many)
    total = lambda df: df.groupBy("id").agg(F.sum("n").cast("long").alias("n"), F.min("first").alias("first"))
    if all_heavy:
        return total(by_heavy)
    l, r = (
        each(df.join(sets.select(key, "bits").hint("merge"), key, "left"), key, F.coalesce("bits", F.lit(0)).alias("bits")).join(heavy, "t", "left_anti")
        for df, sets, key in ((left, own, "id"), (right, theirs, "r"))
    )
    held = r.repartition("t").groupBy("t").agg(F.collect_list("r").alias("rs"), F.collect_list("bits").alias("theirs"))
    met = l.join(held.hint("merge"), "t")
    light = _listed(met.select("id", F.expr("filter(rs, (x, i) -> (theirs[i] & bits) = 0)").alias("rs")))
    if many > BITS:
        unsure = met.select("id", F.explode(F.expr("filter(rs, (x, i) -> (theirs[i] & bits) <> 0)")).alias("r")).distinct()
        unsure = unsure.join(own.select("id", "heavy").hint("merge"), "id").join(theirs.select("r", F.col("heavy").alias("heavy_too")).hint("merge"), "r").filter("NOT arrays_overlap(heavy, heavy_too)")
        light = light.unionByName(unsure.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("first")))
    return total(light.unionByName(by_heavy))


def _listed(lists: DataFrame) -> DataFrame:
    """(id, n, first) of the distinct elements of a record's lists (id, rs); whole rows are exchanged, as no two lists of a record meet before."""
    rs = F.array_distinct(F.flatten(F.collect_list("rs")))
    sets = lists.filter("size(rs) > 0").repartition("id").groupBy("id").agg(rs.alias("rs"))
    return sets.select("id", F.size("rs").cast("long").alias("n"), F.array_min("rs").alias("first"))


def identity_tokens(df: DataFrame) -> DataFrame:
    """(id, tokens) by which records match on identity: the name with each contact point, or, without any, the name with
    the organization. Rows are (id, name, tokens, org); one without a name has none."""
    named = lambda kind, x: F.concat(F.lit(kind), F.length("name").cast("string"), F.lit(":"), F.col("name"), F.lit("|"), x)
    by_org = F.when(F.col("org").isNotNull(), F.array(named("o", F.col("org"))))
    none = F.expr("cast(array() as array<string>)")
    keys = F.when(F.col("name").isNull(), none).when(F.size("tokens") > 0, F.transform("tokens", lambda t: named("t", t))).otherwise(F.coalesce(by_org, none))
    return df.select("id", keys.alias("tokens"))


def loose_tokens(df: DataFrame) -> DataFrame:
    """(id, tokens) by which records may be the same: the name, each contact point, or, without any, the organization."""
    some = lambda cond, kind, x: F.when(cond & x.isNotNull(), F.array(F.concat(F.lit(kind), x))).otherwise(F.expr("cast(array() as array<string>)"))
    bare = F.size("tokens") == 0
    return df.select("id", F.concat(some(F.lit(True), "n:", F.col("name")), F.transform("tokens", lambda t: F.concat(F.lit("t:"), t)), some(bare, "o:", F.col("org"))).alias("tokens"))


def contested(own: DataFrame, reverse: DataFrame) -> DataFrame:
    """(id, candidates) of ``overlap`` results both ways: how many, or, with a single one, how many claim that one."""
    claims = reverse.select(F.col("id").alias("first"), F.col("n").alias("claims"))
    return own.join(claims, "first", "left").select("id", F.when(F.col("n") == 1, F.col("claims")).otherwise(F.col("n")).alias("candidates"))


def identity_match(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per left record with a match on identity: n, first (the least), and accepted: each is the other's only one."""
    a, b = identity_tokens(left), identity_tokens(right)
    back = overlap(b, a).filter("n = 1").select(F.col("id").alias("first"), F.col("first").alias("only"))
    return overlap(a, b).join(back, "first", "left").select("id", "n", "first", F.coalesce((F.col("n") == 1) & (F.col("only") == F.col("id")), F.lit(False)).alias("accepted"))


def may_be_same(left: DataFrame, right: DataFrame) -> DataFrame:
    """``overlap`` by the looser test: the same name, or a shared contact point, or, where neither has any, the same
    organization."""
    return overlap(loose_tokens(left), loose_tokens(right))


def matches(left: DataFrame, right: DataFrame) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """``overlap`` results from left to right and from right to left: twin (nameless records by contact point) and alike
    (by identity)."""
    bare = [x.filter("name IS NULL").select("id", "tokens") for x in (left, right)]
    keys = [identity_tokens(x) for x in (left, right)]
    return {"twin": overlap(*bare), "alike": overlap(*keys)}, {"twin": overlap(*bare[::-1]), "alike": overlap(*keys[::-1])}


def settle(side: DataFrame, other: DataFrame, known_other: DataFrame, content_left: DataFrame, found: tuple[dict[str, DataFrame], dict[str, DataFrame]] | None = None) -> DataFrame:
    """What becomes of one side's leftovers (id, name, tokens, org), in this order of rules.

    ``content_left`` (id, candidates) are refused content candidates: ambiguous. A nameless record is ambiguous when it
    shares a contact point with a nameless leftover of the other side, or a likely duplicate of the known cards there
    that it shares one with; otherwise it is created. A named record without a namesake on the other side is created,
    else ambiguous with the number of its matches on identity (0: the name alone). Numbers follow ``contested``, those of
    likely duplicates count all. *found* are the ``matches`` from *side* to *other* and back, where they are known.
    """
    own, back = found or matches(side, other)
    twins = contested(own["twin"], back["twin"]).withColumnRenamed("candidates", "twins")
    alike = contested(own["alike"], back["alike"]).withColumnRenamed("candidates", "alike")
    dupes = overlap(side.filter("name IS NULL"), known_other).select("id", F.col("n").alias("dupes"))
    namesakes = side.filter("name IS NOT NULL").select("id", "name").join(other.filter("name IS NOT NULL").select("name").distinct(), "name", "left_semi").select("id", F.lit(True).alias("namesake"))
    out = side.select("id", "name").join(content_left.select("id", "candidates"), "id", "left")
    for df in (twins, dupes, namesakes, alike):
        out = out.join(df, "id", "left")
    named = F.col("name").isNotNull()
    rules: list[tuple[Column, str, Column]] = [
        (F.col("candidates").isNotNull(), "ambiguous", F.col("candidates")),
        (~named & F.col("twins").isNotNull(), "ambiguous", F.col("twins")),
        (~named & F.col("dupes").isNotNull(), "likely_duplicate", F.col("dupes")),
        (~named | F.col("namesake").isNull(), "create", F.lit(0)),
    ]
    outcome, count = F.lit("ambiguous"), F.coalesce("alike", F.lit(0))
    for cond, name, n in reversed(rules):
        outcome, count = F.when(cond, name).otherwise(outcome), F.when(cond, n).otherwise(count)
    return out.select("id", outcome.alias("outcome"), count.cast("long").alias("candidates"))


def same_cycle_duplicates(created: DataFrame) -> DataFrame:
    """(id, candidates) of nameless records to be created that share a token with named ones created on the same side."""
    return overlap(created.filter("name IS NULL"), created.filter("name IS NOT NULL")).select("id", F.col("n").alias("candidates"))


def synced_duplicates(rows: DataFrame) -> DataFrame:
    """Rows (idx, name, tokens) without a name and the least other idx that shares a token; of two that name each other
    only the first reports.

    The least other one is the least of a token, or the second least where that is the row itself.
    """
    each = rows.select("idx", "name", F.explode(F.array_distinct("tokens")).alias("t"))
    least = each.groupBy("t").agg(F.min("idx").alias("m1"))
    second = each.join(least, "t").filter("idx <> m1").groupBy("t").agg(F.min("idx").alias("m2"))
    best = each.filter("name IS NULL").join(least, "t").join(second, "t", "left")
    best = best.groupBy("idx").agg(F.min(F.when(F.col("m1") != F.col("idx"), F.col("m1")).otherwise(F.col("m2"))).alias("j")).filter("j IS NOT NULL")
    back = best.select(F.col("idx").alias("j"), F.col("j").alias("back"))
    return best.join(back, "j", "left").filter("NOT (j < idx AND back <=> idx)").select("idx", F.col("j").alias("other"))
