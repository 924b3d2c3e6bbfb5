"""Whole cycles against recorded servers: modes, outcomes, retry times, and no card lost wherever a cycle stops."""

import pytest
from pyspark.sql import functions as F

from pairwright.functions import cards
from pairwright.operators.statestore import Repeated, StateStore
from pairwright.plans import apply, runner
from pairwright.sources.connector import CARDS, RecordedServers
from tests.test_cycle import COLLECTIONS, quick, vcard


@pytest.fixture(autouse=True, scope="module")
def few_partitions(spark):
    yield from quick(spark)


class Stopped(Exception):
    pass


class Fragile(RecordedServers):
    """Servers whose cycle dies before or after one of its writes (counted from 1)."""

    def __init__(self, *args):
        super().__init__(*args)
        self.before, self.after, self.n = 0, 0, 0

    def write(self, writes):
        self.n += 1
        if self.n == self.before:
            raise Stopped
        out = super().write(writes)
        if self.n == self.after:
            raise Stopped
        return out

    def die(self, before=0, after=0):
        self.n, self.before, self.after = 0, before, after


def made(spark, folder, rows, kind=RecordedServers):
    server = kind(spark, f"{folder}/servers", COLLECTIONS)
    server.put(spark.createDataFrame([(s, f"/{s[0]}/{u}", "0", vcard(u, *x)) for s, u, *x in rows], CARDS))
    return server, StateStore(spark, f"{folder}/state")


def held_bodies(server, store):
    """Names and numbers of all cards that are on a server, in the history or in the journal."""
    found = {bytes(r.body) for r in server.cards().collect()}
    for name, columns in (("conflicts", ("left_body", "right_body")), ("pending", ("body",))):
        table = store.read(name)
        for r in table.collect() if table is not None else []:
            found |= {bytes(r[c]) for c in columns if r[c] is not None}
    lines = lambda b: frozenset(x for x in b.decode().split("\r\n") if x.startswith(("FN", "TEL", "NOTE")))
    return {lines(b) for b in found}


def test_no_card_is_lost_wherever_a_cycle_stops(spark, tmp_path):
    rows = [
        ("left", "clash", "Cleo", "+5"), ("right", "clash", "Cleo B", "+5"), ("left", "moved", "Moe", "+3"), ("right", "m2", "Moe", "+3"),
        ("left", "id1", "Ida", "+4", "NOTE:one"), ("right", "id2", "ida", "+4", "NOTE:two"), ("right", "g", "Friends", None, "X-ADDRESSBOOKSERVER-KIND:group", "X-ADDRESSBOOKSERVER-MEMBER:urn:uuid:m2"),
    ]
    server, store = made(spark, tmp_path, rows, Fragile)
    all_cards = held_bodies(server, store)
    run = lambda now: runner.run_cycle(store, server, now)
    server.die(before=1)
    with pytest.raises(Stopped):
        run(1)
    assert {r.uid for r in store.read("conflicts").collect()} == {"clash", "id1"} and store.read("contacts") is None and held_bodies(server, store) == all_cards
    server.die(after=1)  # losers are overwritten, and the relinked group is on the right
    with pytest.raises(Stopped):
        run(2)
    assert all_cards <= held_bodies(server, store)
    server.die(after=2)  # old cards are deleted, the new ones are not there yet
    with pytest.raises(Stopped):
        run(3)
    assert {r.uid for r in store.read("pending").collect()} == {"moved", "id1"} and all_cards <= held_bodies(server, store)
    assert server.cards().filter("side = 'right' AND href IN ('/r/m2', '/r/id2')").count() == 0
    server.die(before=2)  # the first write is the journal's
    try:
        run(4)
    except Stopped:
        pass
    assert store.read("pending").count() == 0 and all_cards <= held_bodies(server, store)
    server.die()
    outcomes = []
    while "idle" not in outcomes and len(outcomes) < 6:
        outcomes.append(run(5 + len(outcomes)).outcome)
    assert outcomes[-1] == "idle" and all_cards <= held_bodies(server, store)
    parsed = cards.parse(server.cards(), "body").select("side", "uid", "body").collect()
    by = {}
    for r in parsed:
        by.setdefault(r.side, {})[r.uid] = bytes(r.body)
    assert set(by["left"]) == set(by["right"]) == {"clash", "moved", "id1", "g"} and by["left"]["clash"] == by["right"]["clash"]
    assert all(b"urn:uuid:moved" in by[s]["g"] and b"m2" not in by[s]["g"] for s in by)


def test_modes_guard_and_reset(spark, tmp_path):
    rows = [(s, f"u{i}", f"N{i}", f"+{i}") for i in range(13) for s in ("left", "right")]
    server, store = made(spark, tmp_path, rows)
    versions = lambda: (store.version(), server.store.version())
    done = runner.run_cycle(store, server, 2)
    assert done.outcome == "applied" and done.settled and versions() == (1, 1)
    assert {(r.uid, r.last_seen_at) for r in store.read("contacts").collect()} == {(f"u{i}", 2) for i in range(13)}
    again = runner.run_cycle(store, server, 3)  # pairs that are new are read once more, for their photos
    assert again.outcome == "applied" and {r.op for r in again.plan.ops.collect()} == {"refresh"} and versions() == (2, 1) and store.read("photos").filter("tracked").count() == 13
    again = runner.run_cycle(store, server, 4)
    assert again.outcome == "idle" and again.plan is None
    server.put(server.cards().filter("side = 'right' OR href = '/l/u0'"))  # thirteen cards are gone on the left
    before = versions()
    blocked = runner.run_cycle(store, server, 5)
    assert blocked.outcome == "blocked" and versions() == before and not blocked.settled
    assert {(r.side, r.blocked) for r in blocked.guard.collect()} == {("left", False), ("right", True)}
    dry = runner.run_cycle(store, server, 6, "dry_run", reset=True)
    assert versions() == before and {r.op for r in dry.plan.ops.collect()} == {"adopt", "create"}
    cycles = runner.Cycles(store, server, lambda: 7, reset=True)
    server.unlisted["right"] = "transient"
    cycles()
    assert cycles.last.outcome == "failed" and cycles.last.error == "transient" and server.forgotten == ["right"] and cycles.reset
    cycles()
    assert cycles.last.outcome == "applied" and not cycles.reset and server.cards().filter("side = 'left'").count() == 13


def test_failed_cards_come_back_at_their_stored_time(spark, tmp_path):
    server, store = made(spark, tmp_path, [("left", "a", "Ann", "+1"), ("right", "a", "Ann", "+1"), ("left", "b", "Bob", "+2")])
    minted = spark.range(1).select(apply.mint_href(F.lit("/r/"), F.lit("b")).alias("href")).first().href
    server.refuses = lambda: spark.createDataFrame([("right", minted, "permanent")], "side string, href string, error string")
    rows = lambda: {(r.side, r.uid, r.attempts, r.first_at, r.next_retry_at, r.reason) for r in store.read("failures").collect()}
    assert runner.run_cycle(store, server, 1000).outcome == "applied" and rows() == {("left", "b", 1, 1000, 1120, "rejected")}
    assert runner.run_cycle(store, server, 1060).outcome == "applied" and rows() == {("left", "b", 1, 1000, 1120, "rejected")}
    assert runner.run_cycle(store, server, 1130).outcome == "applied" and rows() == {("left", "b", 2, 1000, 1370, "rejected")}
    assert runner.run_cycle(store, server, 1200).outcome == "idle" and rows() == {("left", "b", 2, 1000, 1370, "rejected")}
    server.refuses = None
    assert runner.run_cycle(store, server, 1400).outcome == "applied" and not rows()
    assert server.cards().filter("side = 'right'").count() == 2


def test_repeated_keys_and_gone_versions(spark, tmp_path):
    store = StateStore(spark, str(tmp_path / "s"))
    rows = lambda *x: spark.createDataFrame(list(x), "uid string, href string")
    store.commit({"t": rows(("a", "1"), ("b", None), ("c", None))}, None, unique={"t": [["uid"], ["href"]]})
    with pytest.raises(Repeated):
        store.commit({"t": rows(("a", "1"), ("b", "1"))}, 1, unique={"t": [["uid"], ["href"]]})
    assert store.version() == 1 and store.read("t").count() == 3 and store.readable(1)
    store.commit({"t": rows(("z", "9"))}, 1)
    store.commit({"t": rows(("y", "9"))}, 2)
    store.vacuum(1)
    assert not store.readable(1) and store.readable(3)
