"""One reconciliation cycle as a DataFrame program: both sides' snapshots and the stored state in, a plan out.

A snapshot row is (href, etag, kind, uid, hash, content, name, tokens, org): ``hash`` is the card's hash without its
photo, ``content`` the one without its uid as well; ``members``, the uids a group lists, may follow. A state row is (id,
uid, left_href, right_href, stored_hash, name, tokens, org); ``hash_version`` and ``recomputed_hash`` may follow.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.functions.cards import CANONICAL_VERSION
from pairwright.functions.shared import cut
from pairwright.operators import classify, guards, linkage, merge3, photos, report
from pairwright.plans import pictures as pictures_

CARD = "uid string, href string, hash string, content string, name string, tokens array<string>, org string"
OPS = "stage int, ord long, uid string, op string, on string, winner string, origin string, other_uid string, pass string, relinked long, hash string"
SIDES = ("left", "right")


@dataclass
class CyclePlan:
    ops: DataFrame  # OPS, in the order of (stage, ord, uid); ord is the state row's id, null for records without one
    held: DataFrame  # (uid, reason)
    skips: DataFrame  # (side, uid, href, outcome, candidates)
    diagnostics: DataFrame  # (side, diag, uid, with_uid, href)
    open_cards: dict[str, DataFrame]  # by side: cards that no state row knows
    left: DataFrame  # the left snapshot
    state: DataFrame
    photos: DataFrame | None = None  # rows as from ``pictures.merge``, where the plan was made with photos

    def guard(self) -> DataFrame:
        """(side, records, deletes, limit, blocked), two rows: whether the plan deletes too much of a side to be applied."""
        gone = self.ops.filter("op IN ('delete', 'forget')").select("uid", "op", "on")
        return guards.mass_deletions(self.state.select("uid").join(gone, "uid", "left"), [])

    def report(self, stripped: DataFrame | None = None) -> DataFrame:
        """(section, seq, line) of all sections; *stripped* (uid) are the photos that the cycle's writes left out."""
        return _report(self.ops, self.skips, self.diagnostics, self.open_cards, self.left, self.state, stripped)


def with_defaults(left: DataFrame, right: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The inputs with the columns that may be left out."""
    cards = [x if "members" in x.columns else x.withColumn("members", F.expr("cast(array() as array<string>)")) for x in (left, right)]
    more = {"hash_version": F.lit(CANONICAL_VERSION), "recomputed_hash": F.lit(None).cast("string")}
    return cards[0], cards[1], state.withColumns({c: e for c, e in more.items() if c not in state.columns})


def known_cards(snapshot: DataFrame, state: DataFrame) -> DataFrame:
    """(id, tokens): every card that a side holds, one per uid: a fetched one (first by href) before the stored one."""
    fetched = snapshot.filter("kind = 'fetched' AND uid IS NOT NULL").select("uid", "tokens", F.struct(F.lit(0).alias("late"), "href").alias("rank"))
    both = fetched.unionByName(state.select("uid", "tokens", F.struct(F.lit(1).alias("late"), F.lit("").alias("href")).alias("rank")))
    return both.groupBy(F.col("uid").alias("id")).agg(F.min_by("tokens", "rank").alias("tokens"))


def plan_cycle(left: DataFrame, right: DataFrame, state: DataFrame, winner: str = "left", replayed: DataFrame | None = None, failed_photos: DataFrame | None = None, pictures: pictures_.Pictures | None = None) -> CyclePlan:
    """Decide every record's op; what is ambiguous or suspicious is held or skipped, never guessed.

    *replayed* (old_uid, uid) are re-creations that an earlier cycle left unfinished, *failed_photos* (uid, href, reason)
    left cards whose photo could not be fetched; *pictures* brings those itself and joins photos to the ops. Only two booleans reach the driver: whether either side has entries
    that may be any record. What several later steps read is written once; otherwise every pass would repeat all before it.
    """
    left, right, state = with_defaults(left, right, state)
    snaps, sides, open_cards, diags = dict(zip(SIDES, (left, right), strict=True)), {}, {}, []
    none = F.lit(None).cast("string")
    holds = None
    for name in SIDES:
        known = state.select(F.col(f"{name}_href").alias("href"), "uid").filter("href IS NOT NULL")
        rows = cut(classify.classify(snaps[name], known))
        seen = classify.resolve(rows, state.select("uid"))
        own = rows.select(F.explode("holds").alias("uid"), F.coalesce("diag", F.lit("unreadable_or_waiting")).alias("reason"))
        own = own.unionByName(seen.filter("outcome = 'duplicate'").select("uid", F.lit("duplicate_uid").alias("reason")))
        holds = own if holds is None else holds.unionByName(own)
        diags.append(rows.filter("kind = 'unreadable' OR diag IS NOT NULL").select(F.lit(name).alias("side"), F.coalesce("diag", F.lit("unreadable")).alias("diag"), F.col("uid"), F.col("state_uid").alias("with_uid"), "href"))
        diags.append(seen.filter("outcome = 'duplicate'").select(F.lit(name).alias("side"), F.lit("duplicate_uid").alias("diag"), "uid", none.alias("with_uid"), none.alias("href")))
        one = rows.filter("appears_as IS NOT NULL").select(F.col("appears_as").alias("uid"), "href", "kind", "hash", "content", "name", "tokens", "org", "members")
        sides[name] = one.join(seen.filter("outcome = 'tracked'").select("uid"), "uid", "left_semi"), classify.uncertain(rows).first()["uncertain"]
        open_cards[name] = one.join(seen.filter("outcome = 'unsynced'").select("uid"), "uid", "left_semi")
    if pictures is not None:
        failed_photos = pictures.failed
    if failed_photos is not None:
        blocked = photos.blocked(snaps["left"], failed_photos)
        holds = holds.unionByName(blocked.select("uid", F.lit("photo_unavailable").alias("reason")))
        diags.append(blocked.select(F.lit("left").alias("side"), F.lit("photo_unavailable").alias("diag"), "uid", none.alias("with_uid"), "href"))
    held = cut(holds.groupBy("uid").agg(F.min("reason").alias("reason")))

    free = state.join(held, "uid", "left_anti")
    stale = F.col("hash_version") != CANONICAL_VERSION
    free = free.withColumns({"stored_hash": merge3.baseline_hash(F.col("stored_hash"), F.col("hash_version"), F.coalesce("recomputed_hash", "stored_hash")), "hash_stale": stale})
    rows = merge3.statuses(free.select("id", "uid", "stored_hash", "hash_stale", "name", "tokens", "org"), sides["left"][0], sides["right"][0])
    decided = cut(classify.defer(merge3.decide(rows, winner), sides["left"][1], sides["right"][1]))
    shown = None
    if pictures is not None:
        decided, shown = (cut(x) for x in pictures_.merge(decided, pictures, winner))
    crossed = cut(guards.cross_deletes(decided.filter("op = 'delete'").select(F.col("id").alias("seq"), "on", "name", "tokens", "org")))
    op = lambda df, stage, **cols: df.select(F.lit(stage).alias("stage"), *[(cols[f.name] if f.name in cols else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema if f.name not in ("stage", "uid")], "uid").select(*schema.names)  # noqa: E731, E501
    schema = state.sparkSession.createDataFrame([], OPS).schema
    clash = F.col("op") == "conflict"
    merged = F.when(F.col("on") == "right", F.coalesce("left_hash", "stored_hash")).when(F.col("on") == "left", F.coalesce("right_hash", "stored_hash")).otherwise(F.coalesce("left_hash", "right_hash", "stored_hash"))
    ops = decided.filter("op IS NOT NULL").join(crossed.select(F.col("seq").alias("id")), "id", "left_anti")
    ops = op(ops, 0, ord=F.col("id"), op=F.col("op"), on=F.col("on"), winner=F.col("winner"), origin=F.when(clash, "sync"), hash=F.when(F.col("content"), merged))
    uid_of = decided.select(F.col("id").alias("seq"), "uid", "on")
    partner = uid_of.select(F.col("seq").alias("partner"), F.col("uid").alias("with_uid"))
    crossed = crossed.join(uid_of, "seq").join(partner, "partner")
    late = decided.filter("size(deferred) > 0")
    diags.append(crossed.select(F.col("on").alias("side"), F.lit("delete_held").alias("diag"), "uid", "with_uid", none.alias("href")))
    diags.append(late.select(F.explode("deferred").alias("side"), F.lit("deletion_deferred").alias("diag"), "uid", none.alias("with_uid"), none.alias("href")))
    diags.append(decided.filter("diag IS NOT NULL").select(F.col("on").alias("side"), "diag", "uid", none.alias("with_uid"), none.alias("href")))
    held = held.unionByName(crossed.select("uid", F.lit("cross_delete").alias("reason"))).unionByName(late.select("uid", F.lit("deferred").alias("reason")))

    a, b = (cut(open_cards[s].join(held.select("uid").distinct(), "uid", "left_anti")) for s in SIDES)
    loser = F.lit("right" if winner == "left" else "left")
    same = cut(linkage.pair_uid(a, b))
    hashes = a.select("uid", F.col("hash").alias("lh")).join(b.select("uid", F.col("hash").alias("rh")), "uid")
    paired = same.join(hashes, "uid").withColumn("merged", F.when(~clash | F.lit(winner == "left"), F.col("lh")).otherwise(F.col("rh")))
    ops = ops.unionByName(op(paired, 1, op=F.col("op"), on=F.when(clash, loser), winner=F.when(clash, F.lit(winner)), origin=F.when(clash, "baseline"), hash=F.col("merged")))
    a, b = (x.join(same.select("uid"), "uid", "left_anti") for x in (a, b))

    ids = lambda x: x.withColumn("id", F.col("uid"))
    key = lambda x: x.filter("content IS NOT NULL").select(F.col("uid").alias("id"), F.col("content").alias("hash"))
    matched = cut(linkage.content_match(key(a), key(b)).filter("l IS NOT NULL").select(F.col("l").alias("uid"), "r"))
    refused = {"left": linkage.content_candidates(key(a), key(b)), "right": linkage.content_candidates(key(b), key(a))}
    with_hash = lambda pairs: pairs.join(a.select("uid", F.col("hash").alias("lh")), "uid")
    twins = with_hash(matched)
    ops = ops.unionByName(op(twins, 2, op=F.lit("recreate"), other_uid=F.col("r"), on=F.lit("right"), hash=F.col("lh"), **{"pass": F.lit("content")}))
    rest = a.join(matched.select("uid"), "uid", "left_anti"), b.join(matched.select(F.col("r").alias("uid")), "uid", "left_anti")
    alike = cut(linkage.identity_match(ids(rest[0]), ids(rest[1])).filter("accepted").select(F.col("id").alias("uid"), F.col("first").alias("r")))
    same_person = with_hash(alike).join(b.select(F.col("uid").alias("r"), F.col("hash").alias("rh")), "r")
    ops = ops.unionByName(
        op(same_person, 3, op=F.lit("recreate"), other_uid=F.col("r"), on=F.lit("right"), winner=F.lit(winner), hash=F.col("lh" if winner == "left" else "rh"), **{"pass": F.lit("identity")})
    )
    final = cut(rest[0].join(alike.select("uid"), "uid", "left_anti")), cut(rest[1].join(alike.select(F.col("r").alias("uid")), "uid", "left_anti"))

    found = tuple({k: cut(x) for k, x in way.items()} for way in linkage.matches(*(ids(x) for x in final)))
    skips = None
    for stage, s, o, own, other in ((4, "left", "right", *final), (5, "right", "left", *final[::-1])):
        out = cut(linkage.settle(ids(own), ids(other), known_cards(snaps[o], state), refused[s].join(own.select(F.col("uid").alias("id")), "id", "left_semi"), found if s == "left" else found[::-1]))
        made = own.join(out.filter("outcome = 'create'").select(F.col("id").alias("uid")), "uid", "left_semi")
        twice = linkage.same_cycle_duplicates(ids(made))
        new = made.join(twice.select(F.col("id").alias("uid")), "uid", "left_anti")
        ops = ops.unionByName(op(new, stage, op=F.lit("create"), on=F.lit(o), hash=F.col("hash")))
        skip = out.filter("outcome <> 'create'").unionByName(twice.select("id", F.lit("likely_duplicate").alias("outcome"), "candidates"))
        skip = skip.join(own.select(F.col("uid").alias("id"), "href"), "id").select(F.lit(s).alias("side"), F.col("id").alias("uid"), "href", "outcome", "candidates")
        skips = skip if skips is None else skips.unionByName(skip)

    ops, skips = cut(ops), cut(skips)
    aliases = ops.filter("op = 'recreate'").select(F.col("other_uid").alias("old_uid"), "uid")
    aliases = report.relink_aliases(aliases, replayed if replayed is not None else aliases.limit(0))
    groups = open_cards["right"].filter("size(members) > 0").select(F.col("uid").alias("id"), "members")
    relinked = report.relink_groups(groups, aliases).filter("relinked > 0").select(F.col("id").alias("uid"), F.col("relinked").alias("n"))
    copied = (F.col("op") == "create") & (F.col("on") == "left") & F.col("n").isNotNull()
    ops = ops.join(relinked, "uid", "left").withColumns({"op": F.when(copied, "copy_group").otherwise(F.col("op")), "relinked": F.when(copied, F.col("n"))}).select(*schema.names)
    diagnostics = diags[0]
    for d in diags[1:]:
        diagnostics = diagnostics.unionByName(d)
    return CyclePlan(cut(ops), held, skips, diagnostics, open_cards, snaps["left"], state, shown)


def _report(ops: DataFrame, skips: DataFrame, diagnostics: DataFrame, open_cards: dict[str, DataFrame], left: DataFrame, state: DataFrame, stripped: DataFrame | None = None) -> DataFrame:
    cards = None
    for s in SIDES:
        own = open_cards[s].select("uid", "name", "members", F.lit(s).alias("from_side"))
        cards = own if cards is None else cards.unionByName(own)
    cards = cards.groupBy("uid").agg(F.max_by(F.struct("name", "members"), "from_side").alias("x")).select("uid", "x.*")
    named = ops.join(cards, "uid", "left").withColumn("no_name", F.col("name").isNull())
    known = report.known_after(state.select("uid").unionByName(left.filter("kind = 'fetched' AND uid IS NOT NULL").select("uid")), ops)
    to_left = (F.col("op").isin("create", "copy_group") & (F.col("on") == "left")) | (F.col("op") == "conflict") & (F.col("winner") == "right") | (F.col("op") == "recreate")
    groups = named.filter(to_left & (F.size("members") > 0)).select(F.col("uid").alias("id"), "members")
    twins = linkage.synced_duplicates(state.select(F.col("id").alias("idx"), "name", "tokens"))
    uid = state.select(F.col("id").alias("idx"), "uid")
    twins = twins.join(uid, "idx").join(uid.select(F.col("idx").alias("other"), F.col("uid").alias("like_uid")), "other")
    return report.all_sections(named, skips, diagnostics, report.unmapped_members(groups, known).select(F.col("id").alias("uid")), twins.select("uid", "like_uid"), stripped)


def demo_inputs(spark, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers as both sides' records, each in one of many situations by its key; every 12th is a group on the right."""
    from pairwright.sources.tables import table

    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("n"))
    k = F.col("k")

    def side(s: str, other_uid: int, edited: int, gone: int):
        uid = F.concat(F.lit("u"), k, F.when(k % other_uid == 0, s).otherwise(""))
        text = F.when(k % edited == 0, F.concat(F.col("n"), F.lit(s))).otherwise(F.col("n"))
        return c.filter(k % gone != 0).select(
            F.concat(F.lit(f"/{s}/"), k).alias("href"),
            F.lit("e").alias("etag"),
            F.when(k % 97 == 0, "held").when(k % 101 == 0, "unreadable").otherwise("fetched").alias("kind"),
            F.when((k % 97 != 0) & (k % 101 != 0), uid).alias("uid"),
            F.md5(F.concat(uid, text).cast("binary")).alias("hash"),
            F.md5(text.cast("binary")).alias("content"),
            F.when(k % 11 != 0, F.col("n")).alias("name"),
            F.array(F.concat(F.lit("p:"), F.expr("k div 3"))).alias("tokens"),
            F.lit(None).cast("string").alias("org"),
            F.when((k % 12 == 0) & F.lit(s == "r"), F.array(F.concat(F.lit("u"), k - 4, F.lit("r")), F.concat(F.lit("u"), k + 1))).otherwise(F.expr("cast(array() as array<string>)")).alias("members"),
        )

    # Rows of keys 96 to 104 are tracked although their entries are held or unreadable; elsewhere such an entry would defer all deletes.
    state = c.filter((k % 5 < 3) | (k % 97 == 0) | (k % 101 == 0)).select(
        k.alias("id"), F.concat(F.lit("u"), k).alias("uid"), F.concat(F.lit("/l/"), k).alias("left_href"), F.concat(F.lit("/r/"), k).alias("right_href"),
        F.md5(F.concat(F.lit("u"), k, F.col("n")).cast("binary")).alias("stored_hash"), F.col("n").alias("name"), F.array(F.concat(F.lit("p:"), F.expr("k div 3"))).alias("tokens"), F.lit(None).cast("string").alias("org"),
    )
    return side("l", 10**9, 7, 13), side("r", 4, 9, 17), state


def cycle_plan(spark, sf_dir: str) -> DataFrame:
    return plan_cycle(*demo_inputs(spark, sf_dir)).ops


def cycle_skips(spark, sf_dir: str) -> DataFrame:
    return plan_cycle(*demo_inputs(spark, sf_dir)).skips


def cycle_diagnostics(spark, sf_dir: str) -> DataFrame:
    return plan_cycle(*demo_inputs(spark, sf_dir)).diagnostics


def cycle_guard(spark, sf_dir: str) -> DataFrame:
    return plan_cycle(*demo_inputs(spark, sf_dir)).guard()


def cycle_report(spark, sf_dir: str) -> DataFrame:
    return plan_cycle(*demo_inputs(spark, sf_dir)).report()


QUERIES = {f.__name__: f for f in (cycle_plan, cycle_skips, cycle_diagnostics, cycle_guard, cycle_report)}
