"""Photos in whole cycles: against a plain planner over every case, and on servers that replace what they are given."""

import base64
import hashlib
import itertools

import pytest
from pyspark.sql import functions as F

from pairwright.functions import cards
from pairwright.operators import merge3
from pairwright.operators.statestore import StateStore
from pairwright.plans import pictures, runner
from pairwright.sources.connector import CARDS, RecordedServers
from tests.test_cycle import COLLECTIONS, quick, vcard

HOST = "https://pics.org/"


@pytest.fixture(autouse=True, scope="module")
def few_partitions(spark):
    yield from quick(spark)


def sha(data):
    return hashlib.sha256(bytes(data)).hexdigest()


def inline(data):
    return "PHOTO;ENCODING=b:" + base64.b64encode(data).decode()


def at(name):
    return f"PHOTO;VALUE=uri:{HOST}{name}"


# ---- the plain planner ----


def plain_photo(status, op, on, diag, state, now, winner):
    """What one record's photo does: (op, on, diag, action, counter side, counter action)."""
    tracked = bool(state and state["tracked"])
    photo, unread, missing = {}, "unchanged" in status.values(), False
    for s in ("left", "right"):
        if status[s] in ("same", "changed"):
            got = now.get(s)
            if got is not None and not got["available"]:
                missing = True
            photo[s] = (got["now_hash"], got["has_bytes"]) if got else (None, False)
        elif status[s] == "unchanged":
            photo[s] = (state[f"{s}_hash"] if state else None, False)
        else:
            photo[s] = (None, False)
    if missing or not (tracked or not unread):
        return op, on, diag, None, None, None
    carry = lambda s: "remove" if photo[s][0] is None else "set" if photo[s][1] else "keep"
    act = {"left": "keep", "right": "keep"}
    lh, rh = photo["left"][0], photo["right"][0]
    if not tracked:
        if lh and not rh:
            act["right"] = carry("left")
        elif rh and not lh:
            act["left"] = carry("right")
    else:
        ln, rn = lh != state["left_hash"], rh != state["right_hash"]
        if ln and rn:
            if lh != rh:
                act["right" if winner == "left" else "left"] = carry(winner)
        elif ln:
            act["right"] = carry("left")
        elif rn:
            act["left"] = carry("right")
    other = {"left": "right", "right": "left"}
    if op in ("update", "conflict"):
        o = other[on]
        second = act[o] != "keep" and status[o] in ("same", "changed")
        return op, on, diag, act[on], o if second else None, act[o] if second else None
    if op == "resurrect":
        return op, on, diag, "copy", None, None
    if op in (None, "refresh") and diag is None and "deleted" not in status.values():
        to = "left" if act["left"] != "keep" else "right" if act["right"] != "keep" else None
        if to and status[to] == "unchanged":
            return None, to, "unread_target", None, None, None
        if to:
            return "update", to, diag, act[to], None, None
    return op, on, diag, None, None, None


@pytest.mark.parametrize("winner", ["left", "right"])
def test_every_case_matches_the_plain_planner(spark, winner):
    decided, now, stored, want = [], [], [], {}
    views = [None, ("h0", True, True), ("h1", True, True), ("h1", False, True), (None, False, False)]
    states = [None, (False, None, None), (True, None, None), (True, "h0", "h0"), (True, "h0", None), (True, "h1", "h2")]
    for n, (ls, rs, lv, rv, st) in enumerate(itertools.product(merge3.STATUSES, merge3.STATUSES, views, views, states)):
        uid, status = f"u{n}", {"left": ls, "right": rs}
        op, on, diag = merge3.DECISIONS[ls, rs]
        on = ("right" if winner == "left" else "left") if op == "conflict" else on
        decided.append((uid, op, on, diag, ls, rs))
        held = {}
        for s, v in (("left", lv), ("right", rv)):
            if v and status[s] in ("same", "changed"):
                held[s] = {"now_hash": v[0], "has_bytes": v[1], "available": v[2]}
                now.append((s, uid, v[0], None, v[1], v[2]))
        state = {"tracked": st[0], "left_hash": st[1], "right_hash": st[2]} if st else None
        if st:
            stored.append((uid, st[0], None, st[1], st[2], False))
        want[uid] = plain_photo(status, op, on, diag, state, held, winner)
    p = pictures.Pictures(spark.createDataFrame(now, "side string, uid string, now_hash string, now_uri string, has_bytes boolean, available boolean"), None, spark.createDataFrame(stored, pictures.PHOTOS), None)
    moved, rows = pictures.merge(spark.createDataFrame(decided, "uid string, op string, on string, diag string, left_status string, right_status string"), p, winner)
    got = {r.uid: (r.op, r.on, r.diag, r.action, r.counter_side, r.counter_action) for r in moved.join(rows, "uid").collect()}
    assert len(got) == 16 * 150 and got == want


# ---- whole cycles ----


class Album(RecordedServers):
    """The left keeps photos at addresses of its own: an embedded one comes back as a new address."""

    drops = False

    def write(self, writes):
        out = super().write(writes)
        rows, album = [], [tuple(r) for r in self.album.collect()]
        parsed = cards.parse(self.cards(), "body")
        for r in parsed.select("side", "href", "etag", "body", cards.photo(F.col("props")).alias("p")).collect():
            body = bytes(r.body)
            if r.side == "left" and r.p is not None and r.p.kind == "inline":
                name = f"{HOST}{sha(r.p.bytes)[:12]}-{len(album)}"
                album.append((name, 200, r.p.bytes))
                bare = [x for x in body.decode().replace("\r\n ", "").split("\r\n") if not x.startswith("PHOTO")]
                body = "\r\n".join(bare[:-2] + ([] if self.drops else [f"PHOTO;VALUE=uri:{name}"]) + bare[-2:]).encode()
            rows.append((r.side, r.href, r.etag, bytearray(body)))
        self.album = self.spark.createDataFrame(album, self.album.schema)
        if not out.filter("outcome = 'done'").isEmpty():
            self.put(self.spark.createDataFrame(rows, CARDS))
        return out


def servers(spark, folder, rows, album):
    frame = spark.createDataFrame([(HOST + n, s, d) for n, s, d in album], "uri string, status int, data binary")
    server = Album(spark, f"{folder}/servers", COLLECTIONS, None, frame, "pics.org")
    server.put(spark.createDataFrame([(s, f"/{s[0]}/{u}", "0", vcard(u, n, t, *more)) for s, u, n, t, *more in rows], CARDS))
    return server, StateStore(spark, f"{folder}/state")


def faces(server):
    """(name, what the photo's bytes hash to) of all cards, by side and uid."""
    album = {r.uri: sha(r.data) for r in server.album.collect() if r.data is not None}
    parsed = cards.parse(server.cards(), "body").select("side", "uid", cards.photo(F.col("props")).alias("p"), F.get(cards.values_of(F.col("props"), "FN"), F.lit(0)).alias("fn"))
    return {(r.side, r.uid): (r.fn, None if r.p is None else r.p.hash or album.get(r.p.uri)) for r in parsed.collect()}


def until_idle(store, server, now):
    seen = []
    while "idle" not in seen and len(seen) < 6:
        seen.append(runner.run_cycle(store, server, now + len(seen)).outcome)
    assert seen[-1] == "idle", seen
    return len(seen)


def edit(server, side, href, body):
    rows = server.cards().withColumns({"body": F.when((F.col("side") == side) & (F.col("href") == href), F.lit(bytes(body))).otherwise(F.col("body")), "etag": F.when((F.col("side") == side) & (F.col("href") == href), F.concat("etag", F.lit("+"))).otherwise(F.col("etag"))})
    server.put(rows)


def test_photos_follow_their_records(spark, tmp_path):
    one, two, three, four, large = b"\xff\xd8\xff one", b"\x89PNG two", b"three", b"four", b"x" * 300_000
    rows = [
        ("left", "gap_r", "A", "+1", at("one")), ("right", "gap_r", "A", "+1"), ("left", "gap_l", "B", "+2"), ("right", "gap_l", "B", "+2", inline(two)),
        ("left", "differ", "C", "+3", at("one")), ("right", "differ", "C", "+3", inline(two)), ("left", "new_l", "D", "+4", at("three")), ("right", "new_r", "E", "+5", inline(four)),
        ("right", "large", "F", "+6", inline(large)), ("left", "gone", "G", "+7", at("missing")), ("left", "clash", "H", "+8", at("one")), ("right", "clash", "H H", "+8", inline(two)),
    ]
    server, store = servers(spark, tmp_path, rows, [("one", 200, one), ("three", 200, three), ("missing", 404, None)])
    began = runner.run_cycle(store, server, 1)
    lines = {(r.section, r.line.split()[0]) for r in began.report().filter("section IN ('photos_stripped', 'photos_unavailable')").collect()}
    assert ("photos_stripped", "uid=large") in lines and any(s == "photos_unavailable" for s, _ in lines)
    until_idle(store, server, 2)
    got = faces(server)
    want = {"gap_r": one, "gap_l": two, "new_l": three, "new_r": four}
    for u, data in want.items():
        assert got["left", u][1] == got["right", u][1] == sha(data), u
    assert (got["left", "differ"][1], got["right", "differ"][1]) == (sha(one), sha(two))
    assert got["left", "large"][1] is None and got["right", "large"][1] == sha(large) and ("right", "gone") not in got
    assert got["left", "clash"] == ("H", sha(one)) and got["right", "clash"] == ("H", sha(two))  # the content's winner doesn't take the photo along
    kept = {r.uid: r for r in store.read("photos").collect()}
    assert set(kept) == set(want) | {"differ", "large", "clash"} and all(r.tracked for r in kept.values())
    assert kept["large"].stripped and kept["large"].left_hash is None and kept["new_r"].left_uri.startswith(HOST) and kept["new_r"].left_hash == sha(four)
    # One side removes its photo, the other changes one, and a record changes on one side while its photo does on the other.
    minted = {(r.side, r.uid): r.href for r in cards.parse(server.cards(), "body").collect()}
    server.album = server.album.union(spark.createDataFrame([(HOST + "five", 200, b"five"), (HOST + "six", 200, b"six")], server.album.schema))
    edit(server, "right", minted["right", "gap_r"], vcard("gap_r", "A", "+1"))
    edit(server, "left", minted["left", "gap_l"], vcard("gap_l", "B", "+2", at("five")))
    edit(server, "right", minted["right", "new_l"], vcard("new_l", "D D", "+4", inline(three)))
    edit(server, "left", minted["left", "new_l"], vcard("new_l", "D", "+4", at("six")))
    first = runner.run_cycle(store, server, 20)
    ops = {r.uid: (r.op, r.on) for r in first.plan.ops.collect()}
    assert (ops["gap_r"], ops["gap_l"], ops["new_l"]) == (("update", "left"), ("update", "right"), ("update", "left"))
    assert [(r.uid, r.action, r.counter_side, r.counter_action) for r in first.plan.photos.filter("counter_side IS NOT NULL").collect()] == [("new_l", "keep", "right", "set")]
    got = faces(server)
    assert got["left", "gap_r"][1] is None and got["right", "gap_r"][1] is None and got["right", "gap_l"][1] == sha(b"five")
    assert until_idle(store, server, 21) <= 3
    got = faces(server)
    assert got["left", "new_l"] == got["right", "new_l"] == ("D D", sha(b"six"))


def test_a_dropped_photo_is_not_taken_as_removed(spark, tmp_path):
    server, store = servers(spark, tmp_path, [("right", "a", "A", "+1", inline(b"one")), ("left", "b", "B", "+2"), ("right", "b", "B", "+2", inline(b"two"))], [])
    server.drops = True
    until_idle(store, server, 1)
    got = faces(server)
    assert got["left", "a"][1] is None and got["right", "a"][1] == sha(b"one") and got["right", "b"][1] == sha(b"two")
    assert {(r.uid, r.left_hash, r.stripped) for r in store.read("photos").collect()} == {("a", None, True), ("b", None, True)}
