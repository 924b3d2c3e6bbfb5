"""A whole cycle against the plain planner: plan, skips, diagnostics, guard, report; and its application."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pairwright.functions.shared import cut
from pairwright.operators import report
from pairwright.operators.statestore import StateStore
from pairwright.plans import apply, cycle
from tests import plain_cycle

SF = "/root/testdata/sf0.001"
SNAP = "href string, etag string, kind string, uid string, hash string, content string, name string, tokens array<string>, org string, members array<string>"
STATE = "id long, uid string, left_href string, right_href string, stored_hash string, name string, tokens array<string>, org string"


@pytest.fixture(autouse=True, scope="module")
def few_partitions(spark):
    """A cycle is many small jobs here, which take longer to compile than to run."""
    yield from quick(spark)


def quick(spark):
    wanted = {"spark.sql.shuffle.partitions": "1", "spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def made_up(seed):
    """Both sides and the state of some hundred records with many clashes of every kind."""
    rng = random.Random(seed)
    left, right, state = [], [], []
    for k in range(140):
        name = None if rng.random() < 0.3 else f"n{rng.randrange(50)}"
        tokens = sorted({f"p:{rng.randrange(60)}" for _ in range(rng.randrange(4))})
        org = rng.choice([None, "a", "b"])
        content = f"c{rng.randrange(90)}"
        row = {"name": name, "tokens": tokens, "org": org}
        known = rng.random() < 0.4
        if known:
            state.append({"id": 1000 - k, "uid": f"u{k}", "left_href": f"/l/{k}", "right_href": f"/r/{k}", "stored_hash": "h0", **row})
        for side, out in (("l", left), ("r", right)):
            if rng.random() < 0.7:
                own = f"u{k}" if known or rng.random() < 0.6 else f"{side}{k}"
                uid = rng.choice([own] * 24 + [f"u{k + 1}"])
                kind = rng.choice(["fetched"] * 6 + (["unchanged", "unchanged", "held", "unreadable"] if known else []))
                card = {"hash": rng.choice(["h0", "h0", "h1", "h2"]), "content": content, **row} if kind == "fetched" else {"hash": None, "content": None, "name": None, "tokens": [], "org": None}
                members = [f"{rng.choice('lru')}{rng.randrange(140)}" for _ in range(rng.randrange(5))] if rng.random() < 0.3 and kind == "fetched" else []
                out.append({"href": f"/{side}/{k}", "etag": "e", "kind": kind, "uid": uid if kind == "fetched" else None, **card, "members": members})
    return left, right, state


def frames(spark, left, right, state):
    return spark.createDataFrame(left, SNAP), spark.createDataFrame(right, SNAP), spark.createDataFrame(state, STATE)


def check(plan, want):
    ops, skips, diags, held = want
    rows = plan.ops.collect()
    assert Counter(tuple(r) for r in rows) == Counter(tuple(o[k] for k in plain_cycle.OP) for o in ops)
    assert Counter(tuple(r) for r in plan.skips.select("side", "uid", "href", "outcome", "candidates").collect()) == Counter(skips)
    assert Counter(tuple(r) for r in plan.diagnostics.select("side", "diag", "uid", "with_uid", "href").collect()) == Counter(diags)
    assert {r.uid for r in plan.held.collect()} == set(held)


@pytest.mark.parametrize(("seed", "winner"), [(1, "left"), (2, "right")])
def test_plan_matches_plain_planner(spark, seed, winner):
    data = made_up(seed)
    want = plain_cycle.plan(*data, winner)
    check(cycle.plan_cycle(*frames(spark, *data), winner), want)
    assert {o["op"] for o in want[0]} >= {"refresh", "update", "conflict", "resurrect", "adopt", "create"} and want[1] and want[2]


def test_demo_plan_guard_and_report(spark):
    data = [[r.asDict() for r in df.collect()] for df in cycle.demo_inputs(spark, SF)]
    want = plain_cycle.plan(*data)
    plan = cycle.plan_cycle(*cycle.demo_inputs(spark, SF))
    check(plan, want)
    ops, skips, diags, _ = want
    deletes = {s: sum(o["op"] == "forget" or o["op"] == "delete" and o["on"] == s for o in ops) for s in ("left", "right")}
    limit = max(10, len(data[2]) * 20 // 100)
    assert {r.side: (r.records, r.deletes, r.limit, r.blocked) for r in plan.guard().collect()} == {s: (len(data[2]), n, limit, n > limit) for s, n in deletes.items()}
    lines = plan.report().collect()
    per = Counter(r.section for r in lines)
    assert per["in_sync"] == sum(o["op"] == "adopt" for o in ops) and per["copies"] == sum(o["op"] in ("create", "copy_group") for o in ops)
    assert per["skipped"] + per["likely_duplicates"] == len(skips) and per["held"] == sum(d[1] in ("uid_changed", "duplicate_uid") for d in diags)
    assert per["held_deletes"] == sum(d[1] == "delete_held" for d in diags) and per["unreadable"] == sum(d[1] == "unreadable" for d in diags)
    known = {r["uid"] for r in data[2]} | {e["uid"] for e in data[0] if e["kind"] == "fetched"}
    for o in ops:
        if o["op"] in ("create", "resurrect") and o["on"] == "left" or o["op"] == "copy_group":
            known.add(o["uid"])
        elif o["op"] in ("delete", "forget"):
            known.discard(o["uid"])
    members = {e["uid"]: e["members"] for e in data[1] if e["kind"] == "fetched"} | {e["uid"]: e["members"] for e in data[0] if e["kind"] == "fetched" and e["members"]}
    unmapped = {o["uid"] for o in ops if (o["on"] == "left" and o["op"] in ("create", "copy_group") or o["op"] == "recreate") and set(members.get(o["uid"], [])) - known}
    assert {r.line.split()[0][4:] for r in lines if r.section == "unmapped_groups"} == unmapped
    counts = report.error_counts(plan.ops.limit(0), plan.diagnostics, plan.skips).first()
    assert counts.skipped == len(skips) and counts.held_deletes == per["held_deletes"] and counts.left_errors == sum(d[0] == "right" and d[1] in ("unreadable", "uid_changed", "duplicate_uid") for d in diags)
    held = {r.uid for r in report.held_delete_uids(plan.diagnostics).collect()}
    assert held == {d[2] for d in diags if d[1] in ("delete_held", "deletion_deferred")}


def test_known_cards_take_fetched_ones_first(spark):
    """A tracked card that gained a phone number this cycle counts with it, and no longer with its old one."""
    card = lambda s, uid, **x: {"href": f"/{s}/{uid}", "etag": "e", "kind": "fetched", "uid": uid, "hash": "h", "content": uid, "name": uid, "tokens": [], "org": None, "members": []} | x
    state = [{"id": 1, "uid": "t", "left_href": "/l/t", "right_href": "/r/t", "stored_hash": "h", "name": "t", "tokens": ["p:old"], "org": None}]
    left = [card("l", "t"), card("l", "new", name=None, tokens=["p:new"]), card("l", "old", name=None, tokens=["p:old"])]
    right = [card("r", "t", tokens=["p:new"])]
    plan = cycle.plan_cycle(*frames(spark, left, right, state))
    assert [(r.uid, r.outcome, r.candidates) for r in plan.skips.collect()] == [("new", "likely_duplicate", 1)]
    assert {r.uid for r in plan.ops.filter("op = 'create'").collect()} == {"old"}


def test_stale_hashes_and_failed_photos(spark):
    card = lambda s, uid, kind="fetched", h="new": {"href": f"/{s}/{uid}", "etag": "e", "kind": kind, "uid": uid if kind == "fetched" else None, "hash": h, "content": uid, "name": uid, "tokens": [], "org": None, "members": []}
    state = [{"id": k, "uid": u, "left_href": f"/l/{u}", "right_href": f"/r/{u}", "stored_hash": "old", "name": u, "tokens": [], "org": None} for k, u in enumerate("abc")]
    data = frames(spark, [card("l", "a"), card("l", "b", "unchanged"), card("l", "c")], [card("r", "a"), card("r", "b", "unchanged"), card("r", "c")], state)
    stale = data[2].withColumns({"hash_version": F.lit(1), "recomputed_hash": F.lit("new")})
    failed = spark.createDataFrame([("c", "transient")], "uid string, reason string")
    plan = cycle.plan_cycle(data[0], data[1], stale, failed_photos=failed)
    assert {(r.uid, r.op, r.on, r.hash) for r in plan.ops.collect()} == {("a", "refresh", "both", None), ("b", "refresh", None, "new")}
    assert [(r.uid, r.diag, r.href) for r in plan.diagnostics.collect()] == [("c", "photo_unavailable", "/l/c")]


COLLECTIONS = {"left": "/l/", "right": "/r/"}


def vcard(uid, name, tel, *more):
    lines = ["BEGIN:VCARD", "VERSION:3.0", f"UID:{uid}", *([f"FN:{name}"] if name else []), *([f"TEL:{tel}"] if tel else []), *more, "END:VCARD", ""]
    return bytearray("\r\n".join(lines).encode())


def entries(server, side, failed=None):
    rows = server.filter(F.col("side") == side)
    return apply.snapshot_cards(rows.select("href", "etag", F.lit("fetched").alias("kind"), "body"))


def one_cycle(spark, store, server, errors=None, at=0):
    version = store.version()
    state = found if (found := store.read("contacts", version)) is not None else spark.createDataFrame([], apply.STATE)
    server = cut(server)
    snaps = {s: cut(entries(server, s)) for s in ("left", "right")}
    plan = cycle.plan_cycle(snaps["left"], snaps["right"], state)
    own = None
    for s in snaps:
        rows = snaps[s].select(F.lit(s).alias("side"), "uid", "href", "etag", "name", "tokens", "org").join(server.filter(F.col("side") == s).select("href", "body"), "href")
        own = rows if own is None else own.unionByName(rows)
    own = cut(own.filter("uid IS NOT NULL"))
    done = apply.apply_plan(plan.ops, own.select("side", "uid", "href", "etag", "body"), server, COLLECTIONS, errors)
    listing = server.select("side", "href")
    apply.finish(store, version, plan, done, own, at, listing, listing.limit(0), {"left": f"t{at}", "right": f"t{at}"}, f"c{at}")
    return plan, done


def test_cycles_converge_on_recorded_servers(spark, tmp_path):
    left = [("a", "Ann", "+1"), ("b", "Bob", "+2"), ("moved", "Moe", "+3"), ("id1", "Ida", "+4"), ("clash", "Cleo", "+5")]
    right = [("a", "Ann", "+1"), ("m2", "Moe", "+3"), ("id2", "ida", "+4"), ("clash", "Cleo B", "+5"), ("z", "Zoe", "+6")]
    rows = [(s, f"/{s[0]}/{u}", "0", vcard(u, n, t, *(["NOTE:other"] if u == "id2" else []))) for s, side in (("left", left), ("right", right)) for u, n, t in side]
    server = spark.createDataFrame(rows, "side string, href string, etag string, body binary")
    store = StateStore(spark, str(tmp_path / "store"))
    plan, done = one_cycle(spark, store, server, at=1)
    assert {(r.uid, r.op, r.on) for r in plan.ops.collect()} == {("a", "adopt", None), ("clash", "conflict", "right"), ("moved", "recreate", "right"), ("id1", "recreate", "right"), ("b", "create", "right"), ("z", "create", "left")}
    assert all(r.reason is None for r in done.outcomes.collect()) and not done.aborted
    assert {r.uid for r in store.read("contacts").collect()} == {"a", "b", "moved", "id1", "clash", "z"} and store.read("pending").count() == 0
    assert {(r.uid, r.origin, r.winner, bytes(r.right_body) == bytes(vcard("clash", "Cleo B", "+5"))) for r in store.read("conflicts").collect()} == {("clash", "baseline", "left", True), ("id1", "baseline", "left", False)}
    bodies = {(r.side, r.uid): r.hash for s in ("left", "right") for r in entries(done.server, s).withColumn("side", F.lit(s)).collect()}
    assert len(bodies) == 12 and all(bodies["left", u] == bodies["right", u] for _, u in bodies)
    idle, _ = one_cycle(spark, store, done.server, at=2)
    assert {r.op for r in idle.ops.collect()} <= {"refresh"} and not idle.skips.count()
    # One side edits, the other deletes; one write is refused, then the account locks.
    minted = {r.uid: r.href for r in entries(done.server, "right").collect()}
    edited = done.server.filter("href NOT IN ('/l/a')").withColumn("body", F.when(F.col("href") == "/l/b", F.lit(bytes(vcard("b", "Bobby", "+2")))).when(F.col("href") == "/l/clash", F.lit(bytes(vcard("clash", "Cleopatra", "+5")))).otherwise(F.col("body")))
    edited = edited.withColumn("etag", F.when(F.col("href").isin("/l/b", "/l/clash"), "9").otherwise(F.col("etag")))
    errors = spark.createDataFrame([("right", minted["b"], "permanent")], "side string, href string, error string")
    plan, done = one_cycle(spark, store, edited, errors, at=3)
    assert {r.uid: r.reason for r in done.outcomes.filter("op <> 'refresh'").collect()} == {"a": None, "b": "rejected", "clash": None}
    assert {(r.side, r.href, r.uid, r.op, r.attempts, r.reason) for r in store.read("failures").collect()} == {("left", "/l/b", "b", "update", 1, "rejected")}
    assert "a" not in {r.uid for r in store.read("contacts").collect()} and store.meta()["tokens"]["left"] == "t3"
    fatal = spark.createDataFrame([("right", minted["b"], "unauthorized")], "side string, href string, error string")
    _, done = one_cycle(spark, store, done.server, fatal, at=4)
    assert done.aborted and store.meta()["tokens"]["left"] == "t3"
    assert {(r.href, r.attempts, r.reason) for r in store.read("failures").collect()} == {("/l/b", 2, "unauthorized")}
    assert store.read("conflicts").count() == 2
