"""A whole cycle against two servers: replay, idle test, listing, plan, guard, apply, finish.

The guard decides before any write. What a cycle may leave behind is safe at every point: history and journal are stored
before the writes they guard, the state after them, and the next cycle carries out what the journal still holds.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.functions import cards
from pairwright.functions.shared import cut
from pairwright.operators import cdc, failures, statestore
from pairwright.operators.statestore import StateStore
from pairwright.plans import apply, pictures
from pairwright.plans.cycle import CyclePlan, plan_cycle
from pairwright.sources.connector import SIDES, Connector, ListingFailed, TokenRejected

ALIASES = "old_uid string, uid string"


@dataclass
class Cycle:
    outcome: str  # idle, dry_run, blocked, applied, aborted or failed
    version: int | None  # the store's version afterwards
    plan: CyclePlan | None = None
    guard: DataFrame | None = None  # (side, records, deletes, limit, blocked)
    applied: apply.Applied | None = None
    error: str | None = None  # the class of the listing error of a failed cycle

    def report(self) -> DataFrame:
        """The plan's report, with the photos that its writes left out."""
        left_out = self.applied.changes.filter("side = 'left' AND change = 'stripped'").select("uid") if self.applied else None
        return self.plan.report(left_out)

    @property
    def settled(self) -> bool:
        """Whether a reset that this cycle was asked for has taken effect."""
        return self.outcome in ("idle", "applied")


@dataclass
class Stored:
    """One version of the state, or nothing of it but the journal."""

    version: int | None
    contacts: DataFrame
    failures: DataFrame
    pending: DataFrame
    held_deletes: DataFrame
    photos: DataFrame  # pictures.PHOTOS
    tokens: dict[str, str]


def load(store: StateStore, forget: bool = False) -> Stored:
    """All tables of the newest version; *forget* stands for a reset without doing it."""
    version = store.version()

    def read(name: str, schema: str) -> DataFrame:
        found = None if forget and name not in statestore.KEPT else store.read(name, version)
        return store.spark.createDataFrame([], schema) if found is None else found

    tokens = {} if forget else store.meta(version).get("tokens", {})
    return Stored(version, read("contacts", apply.STATE), read("failures", apply.FAILURES), read("pending", apply.JOURNAL), read("held_deletes", "uid string"), read("photos", pictures.PHOTOS), tokens)


def list_sides(server: Connector) -> DataFrame:
    """(side, href, etag) of both sides, written once."""
    both = None
    for s in SIDES:
        own = server.listing(s).select(F.lit(s).alias("side"), "href", "etag")
        both = own if both is None else both.unionByName(own)
    return cut(both)


def replay(store: StateStore, server: Connector, stored: Stored) -> DataFrame:
    """(old_uid, uid) of re-creations that an earlier cycle left unfinished, after carrying out what is left of them.

    A card that neither side of the right server has any more is put from the journal. Rows whose work is done leave the
    journal; a refused put keeps its row for the next cycle. Each put creates, so running it twice is refused, not doubled.
    """
    pending = stored.pending
    if pending.isEmpty():
        return store.spark.createDataFrame([], ALIASES)
    actions = cut(statestore.replay_journal(pending.withColumn("id", F.col("uid")), list_sides(server)))
    rows = pending.join(actions.drop("id"), "uid")
    puts = cut(rows.filter("action = 'put'").select(F.lit(0).alias("stage"), F.lit(None).cast("long").alias("ord"), "uid", F.lit("right").alias("side"), F.col("new_right_href").alias("href"), F.lit("put").alias("method"), F.lit(None).cast("string").alias("if_match"), "body"))
    over = rows.filter("action <> 'put'").select("uid")
    if not puts.isEmpty():
        over = over.unionByName(server.write(puts).filter("outcome IN ('done', 'precondition_failed')").select("uid"))
    aliases = cut(rows.filter("alias").select(F.col("old_right_uid").alias("old_uid"), "uid"))
    stored.pending = pending.join(cut(over), "uid", "left_anti")
    stored.version = store.commit({"pending": stored.pending}, stored.version)
    stored.pending = store.read("pending", stored.version)
    return aliases


def with_due(failed: DataFrame, listing: DataFrame, now: int) -> DataFrame:
    """Stored failures with ``due`` and ``held``: a card waits until its stored time unless it has changed; all cards of a uid
    wait for each other."""
    j = failed.join(listing.select("side", "href", F.col("etag").alias("listed")), ["side", "href"], "left")
    j = j.withColumns({"due": cdc.due(F.lit(now), F.col("next_retry_at"), F.col("listed"), F.col("etag")), "key": F.concat_ws(":", "side", "href")})
    return cdc.held(j).drop("key", "listed")


def tracking(stored: Stored) -> DataFrame:
    """The state rows with ``photo_tracked``."""
    rows = stored.photos.filter("tracked").select("uid", F.lit(True).alias("photo_tracked"))
    return stored.contacts.join(rows, "uid", "left").withColumn("photo_tracked", F.coalesce("photo_tracked", F.lit(False)))


def is_idle(server: Connector, stored: Stored, now: int) -> tuple[bool, dict[str, str]]:
    """Whether nothing is to be done, and fresh tokens. A rejected or missing token means that it isn't known."""
    spark = stored.contacts.sparkSession
    fresh = {s: t for s in SIDES if (t := server.token(s)) is not None}
    if set(stored.tokens) != set(SIDES) or set(fresh) != set(SIDES):
        return False, fresh
    deltas = None
    try:
        for s in SIDES:
            own = server.changes_since(s, stored.tokens[s]).select(F.lit(s).alias("side"), "href", "etag")
            deltas = own if deltas is None else deltas.unionByName(own)
    except TokenRejected:
        return False, fresh
    deltas = cut(deltas)
    # A card without a change is listed as it failed; a changed one makes a delta anyway.
    waiting = with_due(stored.failures, stored.failures.select("side", "href", "etag"), now)
    state = tracking(stored).select("uid", "left_href", "right_href", "photo_tracked")
    ends = spark.createDataFrame([(s, stored.tokens[s], True) for s in SIDES], "side string, token string, supports_sync boolean")
    return cdc.idle_facts(state, waiting, stored.pending, ends, deltas, stored.held_deletes).first()["idle"], fresh


def snapshots(server: Connector, stored: Stored, listing: DataFrame, now: int) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """(snapshots by side, own cards (side, uid, href, etag, name, tokens, org, photo, body), held (side, href))."""
    held = cut(with_due(stored.failures, listing, now).filter("held").select("side", "href").join(listing.select("side", "href"), ["side", "href"], "left_semi"))
    wanted = cdc.fetch_lists(listing, tracking(stored)).select("side", "href")
    wanted = cut(wanted.join(held, ["side", "href"], "left_anti"))
    answers = server.fetch(wanted)
    rows = None
    for s in SIDES:
        of = lambda df: df.filter(F.col("side") == s).drop("side")  # noqa: B023, E731
        one = cdc.build_snapshot(of(listing), of(held), of(wanted), of(answers)).select(F.lit(s).alias("side"), "*")
        rows = one if rows is None else rows.unionByName(one)
    rows = cut(rows)
    read = cut(apply.snapshot_cards(rows))  # both sides are parsed in one pass
    known = None
    for s in SIDES:
        one = stored.contacts.select(F.lit(s).alias("side"), F.col(f"{s}_href").alias("href"), "uid")
        known = one if known is None else known.unionByName(one)
    own = read.filter("kind = 'fetched' AND uid IS NOT NULL").select("side", "uid", "href", "etag", "name", "tokens", "org", "photo").join(rows.select("side", "href", "body"), ["side", "href"])
    quiet = rows.filter("kind = 'unchanged'").select("side", "href", "etag").join(known, ["side", "href"])
    return {s: read.filter(F.col("side") == s).drop("side") for s in SIDES}, cut(own.unionByName(quiet, allowMissingColumns=True)), held


def relinked_bodies(plan: CyclePlan, own: DataFrame, aliases: DataFrame) -> DataFrame:
    """(uid, body) of groups to be copied with their members' new uids. Each group's own aliases are gathered, never all."""
    groups = plan.ops.filter("op = 'copy_group'").select("uid").join(plan.open_cards["right"].select("uid", "members"), "uid")
    hits = groups.select("uid", F.explode("members").alias("old_uid")).join(aliases.select("old_uid", F.col("uid").alias("new")), "old_uid").distinct()
    names = hits.groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("old_uid", "new"))).alias("names"))
    bodies = own.filter("side = 'right'").select("uid", "body").join(names, "uid")
    return cut(bodies.select("uid", cards.with_member_uids(F.col("body"), F.col("names")).alias("body")))


def run_cycle(store: StateStore, server: Connector, now: int, mode: str = "sync", reset: bool = False, winner: str = "left", base: int = 120) -> Cycle:
    """One cycle of *mode* sync or dry_run at *now* (seconds); *base* are the seconds before a first further try.

    A sync carries out what the journal holds, ends as idle where nothing has changed, lists and plans, and applies the plan
    unless the guard blocks it. A dry run replays, writes and stores nothing. *reset* plans as if nothing were stored but
    history and journal; a sync forgets it for good. A blocked plan touches neither server nor store.
    """
    if mode not in ("sync", "dry_run"):
        raise ValueError(f"unknown mode {mode}")
    dry = mode == "dry_run"
    if reset and not dry:
        store.reset()
    stored = load(store, forget=reset and dry)
    try:
        aliases = store.spark.createDataFrame([], ALIASES) if dry else replay(store, server, stored)
        if not dry:
            idle, fresh = is_idle(server, stored, now)
            if idle:
                return Cycle("idle", store.commit({}, stored.version, meta={"tokens": fresh}))
        tokens = {s: t for s in SIDES if (t := server.token(s)) is not None}  # before the listing: what comes later is seen again
        listing = list_sides(server)
    except ListingFailed as e:
        if e.error in failures.REDISCOVER:
            server.forget(e.side)
        return Cycle("failed", store.version(), error=e.error)
    snaps, own, held = snapshots(server, stored, listing, now)
    shown = pictures.look(own.select("side", "uid", "href", "photo"), stored.photos, server.pictures)
    plan = plan_cycle(snaps["left"], snaps["right"], stored.contacts, winner, aliases, pictures=shown)
    guard = plan.guard()
    if dry:
        return Cycle("dry_run", stored.version, plan, guard)
    if not guard.filter("blocked").isEmpty():
        return Cycle("blocked", stored.version, plan, guard)
    every = aliases.unionByName(plan.ops.filter("op = 'recreate'").select(F.col("other_uid").alias("old_uid"), "uid"))
    cycle_id = f"{now}-{uuid.uuid4().hex}"
    log = apply.WriteAhead(store, stored.version, cycle_id)
    collections = {s: server.collection(s) for s in SIDES}
    done = apply.apply_plan(plan.ops, own.select("side", "uid", "href", "etag", "body"), server, collections, rewritten=relinked_bodies(plan, own, every), log=log, photo_rows=plan.photos, data=pictures.bytes_to_copy(shown, own, plan.ops, plan.photos))
    after = pictures.next_photos(shown, plan.photos, plan.ops, done.outcomes, done.changes.select("uid", "side", "change"), done.read)
    version = apply.finish(store, log.version, plan, done, own, now, listing.select("side", "href"), held, tokens, cycle_id, base, after)
    return Cycle("aborted" if done.aborted else "applied", version, plan, guard, done)


class Cycles:
    """Cycles for ``loop.poll``: each call runs one; a reset stays asked for until a cycle is idle or applied."""

    def __init__(self, store: StateStore, server: Connector, clock, reset: bool = False, winner: str = "left", base: int = 120) -> None:
        self.store, self.server, self.clock, self.reset, self.winner, self.base = store, server, clock, reset, winner, base
        self.last: Cycle | None = None

    def __call__(self) -> None:
        self.last = run_cycle(self.store, self.server, int(self.clock()), "sync", self.reset, self.winner, self.base)
        self.reset = self.reset and not self.last.settled
