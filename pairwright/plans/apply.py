"""Applying a cycle's plan: ops become guarded writes, then state rows, journal, history and failures.

Ops touch records of their own only, so all first writes go out together, then all second and third ones of ops whose
earlier writes were accepted. An error that concerns the whole account ends the cycle: no op after the first one that
meets it runs, and only synced records' ops are held.

What a write would destroy is stored before it: the history of conflicts before a loser is overwritten, the new card of a
re-creation before its old one is deleted (``WriteAhead``, one commit per step that needs it). The state comes after the
writes; a cycle that dies in between is planned anew from what the servers list, and the next one carries out what the
journal still holds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.functions import cards
from pairwright.functions.cards import CANONICAL_VERSION
from pairwright.functions.shared import cut
from pairwright.functions.text import mint_href
from pairwright.operators import cdc, failures, sinks, statestore
from pairwright.operators.statestore import StateStore
from pairwright.plans import pictures as pictures_
from pairwright.sources.connector import SIDES, Connector, FrameServer, ListingFailed

STATE = "id long, uid string, left_href string, left_etag string, right_href string, right_etag string, stored_hash string, hash_version int, name string, tokens array<string>, org string, last_seen_at long"
FAILURES = "side string, href string, uid string, op string, etag string, attempts long, first_at long, next_retry_at long, reason string"
OUTCOMES = "stage int, ord long, uid string, side string, href string, method string, outcome string, etag string"
JOURNAL = "uid string, left_href string, old_right_href string, old_right_uid string, new_right_href string, body binary"


@dataclass
class Applied:
    server: DataFrame | None  # (side, href, etag, body) after the writes, where the server was a table
    outcomes: DataFrame  # (stage, ord, uid, op, on, reason), reason null for an op that is done; ops that didn't run are missing
    written: DataFrame  # (uid, side, href, etag) of accepted puts
    conflicts: DataFrame  # (uid, origin, winner, left_body, right_body), for the history
    journal: DataFrame  # JOURNAL rows of re-creations that are not finished
    aborted: bool
    changes: DataFrame  # (uid, side, change): what accepted puts did to photos
    read: DataFrame  # (uid, found, kind, uri): left cards read back after a photo was set there


def snapshot_cards(entries: DataFrame) -> DataFrame:
    """A snapshot for ``plan_cycle`` from entries (href, etag, kind, body); a body that is no card makes it unreadable. A side
    is kept; ``photo`` (kind, uri, hash) is the card's photo without its bytes."""
    out = cards.parse(entries, "body")
    keys, p = cards.match_keys(F.col("props")), cards.photo(F.col("props"))
    read = F.col("kind") == "fetched"
    when = lambda x: F.when(read & F.col("error").isNull(), x)
    none = F.expr("cast(array() as array<string>)")
    return out.select(
        *[c for c in entries.columns if c == "side"],
        "href",
        "etag",
        F.when(read & F.col("error").isNotNull(), "unreadable").otherwise(F.col("kind")).alias("kind"),
        when(F.col("uid")).alias("uid"),
        when(cards.canonical_hash(F.col("props"), ("PHOTO",))).alias("hash"),
        when(cards.canonical_hash(F.col("props"), ("PHOTO", "UID"))).alias("content"),
        when(keys["name"]).alias("name"),
        F.coalesce(when(cards.tokens(keys)), none).alias("tokens"),
        when(keys["org"]).alias("org"),
        F.coalesce(when(F.when(cards.is_group(F.col("props")), cards.members(F.col("props")))), none).alias("members"),
        when(F.when(p.isNotNull(), F.struct(p["kind"].alias("kind"), p["uri"].alias("uri"), p["hash"].alias("hash")))).alias("photo"),
    )


def plan_writes(ops: DataFrame, own: DataFrame, collections: dict[str, str], rewritten: DataFrame | None = None, photo_rows: DataFrame | None = None, data: DataFrame | None = None) -> DataFrame:
    """(uid, step, side, method, href, if_match, body, change) of all ops; state-only ops write nothing.

    *own* are both sides' cards (side, uid, href, etag, body), *rewritten* (uid, body) relinked groups. A group is put on
    the right first, then created on the left; a re-creation puts the winner on the left where the right one wins,
    deletes the old right card, and creates the new one. No card's photo goes along with its content: what is overwritten
    keeps its own unless *photo_rows* (of ``pictures.merge``) say otherwise, with the bytes in *data* (side, uid, data).
    """
    of = lambda s, p: own.filter(F.col("side") == s).select(F.col("uid").alias(f"{p}_uid"), F.struct("href", "etag", "body").alias(p))
    j = pictures_.actions(ops, photo_rows, data).join(of("left", "l").withColumnRenamed("l_uid", "uid"), "uid", "left").join(of("right", "r").withColumnRenamed("r_uid", "uid"), "uid", "left")
    j = j.join(of("right", "old").withColumnRenamed("old_uid", "other_uid"), "other_uid", "left")
    fresh = rewritten if rewritten is not None else ops.sparkSession.createDataFrame([], "uid string, body binary")
    j = j.join(fresh.select("uid", F.col("body").alias("relinked_body")), "uid", "left")
    op, to_left = F.col("op"), F.col("on") == "left"
    write = lambda step, side, method, href, etag, put=(F.lit(None), F.lit(None)): F.struct(F.lit(step).alias("step"), side.alias("side"), F.lit(method).alias("method"), href.alias("href"), etag.alias("if_match"), put[0].cast("binary").alias("body"), put[1].cast("string").alias("change"))  # noqa: E731, E501
    photo = lambda content, target, action, to: pictures_.body(content, target, action, F.when(to == "left", F.col("right_data")).otherwise(F.col("left_data")), to == "left")
    none = F.lit(None).cast("string")
    left, right = F.lit("left"), F.lit("right")
    minted = F.when(to_left, mint_href(F.lit(collections["left"]), F.col("uid"))).otherwise(mint_href(F.lit(collections["right"]), F.col("uid")))
    target, other = F.when(to_left, F.col("l")).otherwise(F.col("r")), F.when(to_left, F.col("r")).otherwise(F.col("l"))
    source = F.when(F.coalesce("photo_only", F.lit(False)), target["body"]).otherwise(other["body"])
    still = F.lit(None).cast("string")
    main = photo(source, F.when(op.isin("update", "conflict"), target["body"]), F.col("action"), F.col("on"))
    # The second write is over the op's source card.
    counter = F.when(F.col("counter_side").isNotNull(), write(2, F.col("counter_side"), "put", other["href"], other["etag"], photo(other["body"], other["body"], F.col("counter_action"), F.col("counter_side"))))
    group = F.coalesce("relinked_body", "r.body")
    won = F.when((F.col("pass") == "identity") & (F.col("winner") == "left"), F.col("l.body")).otherwise(cards.with_uid(F.col("old.body"), F.col("uid")))
    writes = (
        F.when(op.isin("create", "resurrect"), F.array(write(1, F.col("on"), "put", minted, none, main)))
        .when(op.isin("update", "conflict"), F.array(write(1, F.col("on"), "put", target["href"], target["etag"], main), counter))
        .when(op == "delete", F.array(write(1, F.col("on"), "delete", target["href"], target["etag"])))
        .when(op == "copy_group", F.array(write(1, right, "put", F.col("r.href"), F.col("r.etag"), (group, F.lit("kept"))), write(2, left, "put", mint_href(F.lit(collections["left"]), F.col("uid")), none, photo(group, none.cast("binary"), F.col("action"), left))))
        .when(
            op == "recreate",
            F.array(
                F.when((F.col("pass") == "identity") & (F.col("winner") == "right"), write(1, left, "put", F.col("l.href"), F.col("l.etag"), photo(won, F.col("l.body"), still, left))),
                write(2, right, "delete", F.col("old.href"), F.col("old.etag")),
                write(3, right, "put", mint_href(F.lit(collections["right"]), F.col("uid")), none, photo(won, F.col("old.body"), still, right)),
            ),
        )
    )
    return j.select("stage", "ord", "uid", "op", F.explode(writes).alias("w")).filter("w IS NOT NULL").select("stage", "ord", "uid", "op", "w.*")


class WriteAhead:
    """What a step's writes would destroy, committed to *store* before the step; ``version`` is the store's last one."""

    def __init__(self, store: StateStore, version: int | None, cycle_id: str) -> None:
        self.store, self.version, self.cycle_id = store, version, cycle_id

    def conflicts(self, rows: DataFrame) -> None:
        """The history grows by *rows* (uid, origin, winner, left_body, right_body)."""
        if not rows.isEmpty():
            held = self.store.read("conflicts", self.version)
            new = sinks.append_conflicts(held, rows, self.cycle_id) if held is None else sinks.new_conflicts(held, rows, self.cycle_id)
            self.version = self.store.commit({}, self.version, append={"conflicts": new})

    def journal(self, rows: DataFrame) -> None:
        """The journal's rows of these uids are replaced by *rows* (JOURNAL)."""
        if not rows.isEmpty():
            held = self.store.read("pending", self.version)
            self.version = self.store.commit({"pending": rows if held is None else statestore.replace(held, rows, ["uid"])}, self.version)


def apply_plan(
    ops: DataFrame, own: DataFrame, server: DataFrame | Connector, collections: dict[str, str], errors: DataFrame | None = None, rewritten: DataFrame | None = None, log: WriteAhead | None = None,
    photo_rows: DataFrame | None = None, data: DataFrame | None = None,
) -> Applied:
    """Run the ops of a plan step by step.

    *server* is a connector, or a table (side, href, etag, body) with the *errors* (side, href, error) it answers. With
    *log*, history and journal are stored before the writes they guard; without one they are the caller's to store. *data* and
    *photo_rows* as for ``plan_writes``: a left card that a photo was set on is read back, as servers replace or drop photos.
    """
    table = isinstance(server, DataFrame)
    book = FrameServer(server, collections, errors) if table else server
    writes = cut(plan_writes(ops, own, collections, rewritten, photo_rows, data))
    of_side = lambda s: own.filter(F.col("side") == s).select("uid", F.col("href").alias(f"{s}_href"), F.col("body").alias(f"{s}_body"))
    fought = ops.filter("op = 'conflict' OR op = 'recreate' AND pass = 'identity'").withColumn("right_uid", F.coalesce("other_uid", "uid"))
    fought = fought.join(of_side("left"), "uid", "left").join(of_side("right").withColumnRenamed("uid", "right_uid"), "right_uid", "left")
    fought = cut(fought.select("stage", "ord", "uid", F.coalesce("origin", F.lit("baseline")).alias("origin"), "winner", "left_body", "right_body"))
    fresh = writes.filter("op = 'recreate' AND step = 3").select("uid", F.col("href").alias("new_right_href"), "body")
    again = ops.filter("op = 'recreate'").select("uid", F.col("other_uid").alias("old_right_uid")).join(fresh, "uid").join(of_side("left").drop("left_body"), "uid")
    again = again.join(of_side("right").select(F.col("uid").alias("old_right_uid"), F.col("right_href").alias("old_right_href")), "old_right_uid")
    again = cut(again.select("uid", "left_href", "old_right_href", "old_right_uid", "new_right_href", "body"))
    if log:
        log.conflicts(fought.drop("stage", "ord"))
    told = None
    for step in (1, 2, 3):
        w = writes.filter(F.col("step") == step).drop("step", "op", "change")
        if told is not None:
            w = w.join(told.filter("outcome <> 'done'").select("uid"), "uid", "left_anti")
        w = cut(w)
        if w.isEmpty():
            told = told if told is not None else ops.sparkSession.createDataFrame([], OUTCOMES)
            continue
        if log and step == 2:
            log.journal(again.join(w.filter("method = 'delete'").select("uid"), "uid", "left_semi"))
        done = book.write(w)
        if told is not None and not done.filter("outcome = 'not_run'").isEmpty():
            # The first steps of these ops are done; the next cycle finds out how they stand.
            told = told.join(done.filter("outcome = 'not_run'").select("uid"), "uid", "left_anti")
        told = cut(done if told is None else told.unionByName(done))
    changes = cut(told.filter("outcome = 'done' AND method = 'put'").select("uid", "side", "href").join(writes.filter("method = 'put'").select("uid", "side", "href", "change"), ["uid", "side", "href"]))
    told, read = read_back(book, told, changes)
    late = told.filter("outcome = 'not_run'").select("uid")
    fatal = told.filter(failures.is_fatal(F.col("outcome"))).agg(F.min(F.struct("stage", "ord", "uid")).alias("p")).first()["p"]
    run = ops.join(late, "uid", "left_anti")
    if fatal is not None:  # ops that write nothing don't run after it either
        upto = F.struct(F.lit(fatal["stage"]).alias("stage"), F.lit(fatal["ord"]).cast("long").alias("ord"), F.lit(fatal["uid"]).alias("uid"))
        run = run.filter((F.struct("stage", "ord", "uid") <= upto) | ~F.col("op").isin("adopt", "refresh", "forget"))
    told = told.filter("outcome <> 'not_run'")
    bad = told.filter("outcome <> 'done'").groupBy("uid").agg(F.min("outcome").alias("error"))
    outcomes = run.join(bad, "uid", "left").select("stage", "ord", "uid", "op", "on", "origin", "pass", F.when(F.col("error").isNotNull(), failures.reason(F.col("error"))).alias("reason"))
    written = told.filter("outcome = 'done' AND method = 'put'").select("uid", "side", "href", "etag")
    began = told.filter("method = 'delete' AND outcome = 'done'").select("uid")
    journal = again.join(began, "uid", "left_semi").join(written.filter("side = 'right'").select("uid"), "uid", "left_anti")
    conflicts = fought.join(run.select("uid"), "uid", "left_semi").drop("stage", "ord")
    return Applied(book.cards if table else None, cut(outcomes), written, conflicts, journal, fatal is not None, changes, read)


def read_back(book: Connector, told: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(*told* with the etags found, (uid, found, kind, uri)) of the left cards that *changes* set a photo on.

    A card that is gone right after its write makes its op fail; where reading fails as a whole the photos are taken as set.
    """
    wrote = changes.filter("side = 'left' AND change = 'set'").select("uid", "side", "href")
    none = told.sparkSession.createDataFrame([], "uid string, found boolean, kind string, uri string")
    if wrote.isEmpty():
        return told, none
    try:
        got = cut(book.fetch(wrote.select("side", "href")).select("side", "href", F.col("etag").alias("new_etag"), "body"))
    except ListingFailed:
        return told, none
    seen = cards.parse(wrote.join(got, ["side", "href"], "left").withColumnRenamed("uid", "id"), "body")
    p = cards.photo(F.col("props"))
    seen = cut(seen.select(F.col("id").alias("uid"), F.col("new_etag").isNotNull().alias("found"), p["kind"].alias("kind"), p["uri"].alias("uri")))
    gone = wrote.join(seen.filter("NOT found").select("uid"), "uid", "left_semi").select("side", "href", F.lit(True).alias("gone"))
    told = told.join(got.select("side", "href", "new_etag"), ["side", "href"], "left").join(gone, ["side", "href"], "left")
    put = F.col("method") == "put"
    told = told.withColumns({"etag": F.when(put, F.coalesce("new_etag", "etag")).otherwise(F.col("etag")), "outcome": F.when(put & F.col("gone"), "permanent").otherwise(F.col("outcome"))})
    return cut(told.select(*[x.split()[0] for x in OUTCOMES.split(", ")])), seen


def next_state(state: DataFrame, ops: DataFrame, applied: Applied, own: DataFrame) -> DataFrame:
    """The state rows after a cycle: those of finished ops updated, added or dropped, all others as they were.

    *own* as for ``apply_plan`` with name, tokens and org; new rows get ids after the greatest one, in the order of uids.
    """
    done = ops.join(applied.outcomes.filter("reason IS NULL").select("uid"), "uid", "left_semi")
    gone = done.filter("op IN ('delete', 'forget')").select("uid")
    kept = done.filter("op NOT IN ('delete', 'forget')").select("uid", "op", "on", "hash")
    for s in SIDES:
        card = own.filter(F.col("side") == s).select("uid", F.col("href").alias(f"{s}_c_href"), F.col("etag").alias(f"{s}_c_etag"))
        put = applied.written.filter(F.col("side") == s).groupBy("uid").agg(F.max("href").alias(f"{s}_w_href"), F.max("etag").alias(f"{s}_w_etag"))
        kept = kept.join(card, "uid", "left").join(put, "uid", "left")
        read = (F.col("op") != "refresh") | F.col("on").isin(s, "both")
        for part in ("href", "etag"):
            kept = kept.withColumn(f"{s}_n_{part}", F.coalesce(f"{s}_w_{part}", F.when(read, F.col(f"{s}_c_{part}"))))
    keys = own.filter("name IS NOT NULL OR size(tokens) > 0 OR org IS NOT NULL").groupBy("uid").agg(F.min_by(F.struct("name", "tokens", "org"), "side").alias("keys"))
    kept = kept.join(keys, "uid", "left").select("uid", "hash", "keys", *[f"{s}_n_{p}" for s in SIDES for p in ("href", "etag")], F.lit(True).alias("hit"))
    j = state.join(gone, "uid", "left_anti").join(kept, "uid", "full_outer")
    fresh = F.col("hash").isNotNull()
    rows = j.select(
        "id",
        "uid",
        *[F.coalesce(f"{s}_n_{p}", f"{s}_{p}").alias(f"{s}_{p}") for s in SIDES for p in ("href", "etag")],
        F.coalesce("hash", "stored_hash").alias("stored_hash"),
        F.when(fresh, F.lit(CANONICAL_VERSION)).otherwise(F.col("hash_version")).cast("int").alias("hash_version"),
        *[F.when(fresh & F.col("keys").isNotNull(), F.col(f"keys.{c}")).otherwise(F.col(c)).alias(c) for c in ("name", "org")],
        F.coalesce(F.when(fresh, F.col("keys.tokens")), "tokens", F.expr("cast(array() as array<string>)")).alias("tokens"),
        "last_seen_at",
    )
    top = state.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))  # one row
    new = rows.filter("id IS NULL").crossJoin(top).withColumn("id", F.col("top") + 1 + F.monotonically_increasing_id()).drop("top")
    return rows.filter("id IS NOT NULL").unionByName(new)


def next_failures(stored: DataFrame, ops: DataFrame, applied: Applied, own: DataFrame, at: int, base: int = 120) -> DataFrame:
    """FAILURES after a cycle: cards of failed ops recorded under the op's uid with the time of their next try (*base* seconds
    later, doubled per further failure), those of finished ops cleared. After an error that ended the cycle only synced
    records' ops hold their cards."""
    bad = applied.outcomes.filter("reason IS NOT NULL")
    if applied.aborted:
        last = applied.outcomes.agg(F.max(F.struct("stage", "ord", "uid")).alias("p"))
        bad = bad.crossJoin(last).filter((F.struct("stage", "ord", "uid") < F.col("p")) | failures.holds_on_abort(F.col("op"), F.col("origin"))).drop("p")
    right_uid = ops.select("uid", F.coalesce("other_uid", "uid").alias("right_uid"))
    card = lambda s, uid: own.filter(F.col("side") == s).select(F.col("uid").alias(uid), F.struct("href", "etag").alias(s))
    failed = bad.join(right_uid, "uid").join(card("left", "uid"), "uid", "left").join(card("right", "right_uid"), "right_uid", "left")
    events = failures.cards_to_hold(failed.select("uid", "op", "on", "origin", "left", "right"), applied.written.join(bad.select("uid"), "uid", "left_semi")).filter("href IS NOT NULL")
    events = cut(events.join(bad.select("uid", "reason"), "uid").withColumn("at", F.lit(at).cast("long")))
    done = applied.outcomes.filter("reason IS NULL").select("uid").join(right_uid, "uid")
    clear = own.join(done.select("uid").unionByName(done.select(F.col("right_uid").alias("uid"))).distinct(), "uid", "left_semi").select("side", "href")
    left = stored.join(clear, ["side", "href"], "left_anti")
    counted = failures.record(left, events, base)
    who = events.select("side", "href", F.col("uid").alias("e_uid"), F.col("op").alias("e_op"), F.col("at").alias("e_at"))
    before = left.select("side", "href", "uid", "op", "next_retry_at")
    out = counted.join(before, ["side", "href"], "left").join(who, ["side", "href"], "left")
    again = F.coalesce(F.col("e_at") + F.col("wait_s"), "next_retry_at").alias("next_retry_at")
    return out.select("side", "href", F.coalesce("e_uid", "uid").alias("uid"), F.coalesce("e_op", "op").alias("op"), "etag", "attempts", "first_at", again, "reason")


def finish(store, expect: int | None, plan, applied: Applied, own: DataFrame, at: int, listing: DataFrame, held: DataFrame, tokens: dict[str, str], cycle_id: str, base: int = 120, photos: DataFrame | None = None) -> int:
    """Commit all that a cycle learned as one version of *store*: contacts, failures, conflicts and journal always; skips,
    resolved failures, times of last sight, sync tokens and held deletes only where the cycle was not cut short.

    *listing* and *held* are (side, href), *photos* the photo rows after the cycle. Conflicts and journal rows that a ``WriteAhead`` has stored are not added again.
    """
    from pairwright.operators.report import held_delete_uids

    spark = plan.ops.sparkSession
    read = lambda name, schema: found if (found := store.read(name, expect)) is not None else spark.createDataFrame([], schema)
    state = next_state(read("contacts", STATE), plan.ops, applied, own)
    failed = next_failures(read("failures", FAILURES), plan.ops, applied, own, at, base)
    tables = {"contacts": state, "failures": failed, "conflicts": sinks.append_conflicts(store.read("conflicts", expect), applied.conflicts, cycle_id)}
    if photos is not None:
        tables["photos"] = photos
    done = applied.outcomes.filter("op = 'recreate' AND reason IS NULL").select("uid")
    tables["pending"] = statestore.replace(read("pending", JOURNAL), applied.journal, ["uid"]).join(done, "uid", "left_anti")
    unique = {"contacts": [["uid"], ["left_href"], ["right_href"]], "failures": [["side", "href"]], "pending": [["uid"]], "photos": [["uid"]]}
    if applied.aborted:
        return store.commit(tables, expect, unique=unique)
    again = applied.outcomes.filter("reason IS NOT NULL").select("uid")
    still = failed.filter(F.col("first_at") == at).unionByName(failed.join(again, "uid", "left_semi")).select("side", "href").distinct()
    over = failures.resolved(failed.select("side", "href"), still, listing, held)
    tables["failures"] = failed.join(over, ["side", "href"], "left_anti")
    seen = cdc.seen_rows(state, listing, "left").unionByName(cdc.seen_rows(state, listing, "right")).distinct().withColumn("last_seen_at", F.lit(at).cast("long"))
    tables["contacts"] = statestore.last_seen(state, seen, "uid", "last_seen_at")
    tables["skips"] = plan.skips.withColumn("skipped_at", F.lit(at).cast("long"))
    tables["held_deletes"] = held_delete_uids(plan.diagnostics)
    return store.commit(tables, expect, meta={"tokens": tokens, "cycle": cycle_id}, unique=unique)
