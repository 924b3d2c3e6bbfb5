"""Merge matrix, a whole cycle, the state store, sinks, streams and protocol payloads."""

import json
import re

import pytest
from pyspark.sql import functions as F

from pairwright.functions import subsets
from pairwright.operators import cdc, failures, linkage, merge3, report, sinks, statestore
from pairwright.plans import cycle
from pairwright.sources import protocol
from pairwright.streaming import loop


def test_matrix(spark):
    rows = [(a, b, "x", "y", False) for a in merge3.STATUSES for b in merge3.STATUSES]
    df = merge3.decide(spark.createDataFrame(rows, "left_status string, right_status string, left_hash string, right_hash string, hash_stale boolean"), "right")
    got = {(r.left_status, r.right_status): (r.op, r.on, r.diag) for r in df.collect()}
    want = dict(merge3.DECISIONS)
    want["changed", "changed"] = ("conflict", "left", None)
    assert got == want and len(got) == 16


def card(uid, side="l", **x):
    base = {"href": f"/{side}/{uid}", "etag": "e", "kind": "fetched", "uid": uid, "hash": f"h{uid}", "content": f"c{uid}", "name": f"N {uid}", "tokens": [], "org": None} | x
    return tuple(base[k] for k in ("href", "etag", "kind", "uid", "hash", "content", "name", "tokens", "org"))


SNAP = "href string, etag string, kind string, uid string, hash string, content string, name string, tokens array<string>, org string"
STATE = "id long, uid string, left_href string, right_href string, stored_hash string, name string, tokens array<string>, org string"


def test_cycle(spark):
    left = [
        card("same"), card("clash", hash="1"), card("moved"), card("ann", name="Ann", tokens=["p:1"]), card("new"), card("two", content="dup"), card("three", content="dup"),
        card("edit", hash="edited"), card("dupe", href="/l/d1"), card("dupe", href="/l/d2"), card("anon", name=None, tokens=["p:9"]), card("anon2", name=None, tokens=["p:7"]), card("known7", tokens=["p:7"]),
    ]
    right = [
        card("same", "r"), card("clash", "r", hash="2"), card("m2", "r", content="cmoved"), card("bob", "r", name="Ann", tokens=["p:1"]), card("four", "r", content="dup"),
        card("edit", "r", hash="old"), card("nine", "r", tokens=["p:9"]), card("gone", "r", hash="s"),
    ]
    state = [(1, "edit", "/l/edit", "/r/edit", "old", "E", [], None), (2, "gone", "/l/gone", "/r/gone", "s", "G", [], None), (3, "lost", "/l/lost", "/r/lost", "s", "L", [], None)]
    plan = cycle.plan_cycle(spark.createDataFrame(left, SNAP), spark.createDataFrame(right, SNAP), spark.createDataFrame(state, STATE))
    ops = {r.uid: (r.stage, r.op, r.on, r.other_uid) for r in plan.ops.collect()}
    assert ops == {
        "edit": (0, "update", "right", None), "gone": (0, "delete", "right", None), "lost": (0, "forget", None, None),
        "same": (1, "adopt", None, None), "clash": (1, "conflict", "right", None), "moved": (2, "recreate", "right", "m2"), "ann": (3, "recreate", "right", "bob"),
        "new": (4, "create", "right", None), "known7": (4, "create", "right", None), "nine": (5, "create", "left", None),
    }
    assert {r.uid: (r.side, r.outcome) for r in plan.skips.collect()} == {
        "two": ("left", "ambiguous"), "three": ("left", "ambiguous"), "four": ("right", "ambiguous"), "anon": ("left", "likely_duplicate"), "anon2": ("left", "likely_duplicate"),
    }
    assert {(r.uid, r.reason) for r in plan.held.collect()} == {("dupe", "duplicate_uid")}


def test_cycle_is_idle_once_applied(spark):
    cards = [card(u) for u in "abc"]
    state = [(i, u, f"/l/{u}", f"/r/{u}", f"h{u}", u, [], None) for i, u in enumerate("abc")]
    snap = spark.createDataFrame(cards, SNAP).withColumn("kind", F.lit("unchanged"))
    plan = cycle.plan_cycle(snap, snap.withColumn("href", F.replace("href", F.lit("/l/"), F.lit("/r/"))), spark.createDataFrame(state, STATE))
    assert plan.ops.count() == plan.held.count() == plan.skips.count() == 0


def test_unknown_entries_defer_deletes(spark):
    state = [(1, "a", "/l/a", "/r/a", "s", "A", [], None)]
    left = spark.createDataFrame([card("x", kind="unreadable")], SNAP).withColumn("uid", F.lit(None).cast("string"))
    right = spark.createDataFrame([card("a", "r", hash="s")], SNAP)
    plan = cycle.plan_cycle(left, right, spark.createDataFrame(state, STATE))
    assert plan.ops.count() == 0 and {(r.uid, r.reason) for r in plan.held.collect()} == {("a", "deferred")}


def test_no_pair_blowup_in_plans(spark):
    df = spark.createDataFrame([(1, "n", ["p:1"], "o", "h")], "id long, name string, tokens array<string>, org string, hash string")
    for out in (linkage.identity_match(df, df), linkage.may_be_same(df, df), linkage.overlap(df, df), linkage.content_match(df, df)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_one_number_on_very_many_cards(spark):
    """A hundred thousand cards a side that share a number would be ten billion pairs; here they are counted."""
    n = 100_000
    side = lambda s: spark.range(n).select(F.col("id"), F.array(F.lit("p:0"), F.concat(F.lit(s), F.col("id") % 1000)).alias("tokens"), F.lit("same").alias("name"), F.lit(None).cast("string").alias("org"))
    out = linkage.overlap(side("e:"), side("e:")).agg(F.count(F.lit(1)), F.min("n"), F.max("n"), F.max("first")).first()
    assert tuple(out) == (n, n, n, 0)
    assert linkage.identity_match(side("l:"), side("r:")).filter(f"n = {n} AND NOT accepted").count() == n
    rows = side("l:").select(F.col("id").alias("idx"), F.when(F.col("id") == 0, "n").alias("name"), "tokens")
    assert tuple(linkage.synced_duplicates(rows).agg(F.count(F.lit(1)), F.max("other")).first()) == (n - 1, 0)


def test_one_number_on_very_many_wide_cards(spark):
    """A hundred thousand cards a side of twelve tokens, of which all share one and two each share the rest."""
    n = 100_000
    own = [F.concat(F.lit(f"{k}:"), F.col("id") % 50_000) for k in range(11)]
    side = spark.range(n).select("id", F.array(F.lit("p:0"), *own).alias("tokens"))
    assert tuple(linkage.overlap(side, side).agg(F.count(F.lit(1)), F.min("n"), F.max("n"), F.max("first")).first()) == (n, n, n, 0)


@pytest.mark.parametrize("heavy", [0, 5, 14, 32])
def test_overlap_of_wide_records(spark, monkeypatch, heavy):
    import random

    monkeypatch.setattr(linkage, "HEAVY", heavy)
    rng = random.Random(3)
    rows = [[(i, rng.sample([f"t{k}" for k in range(60)], rng.choice([0, 1, 3, 7, 8, 9, 20]))) for i in range(70)] for _ in range(2)]
    a, b = (spark.createDataFrame(r, "id long, tokens array<string>") for r in rows)
    want = {i: [j for j, y in rows[1] if set(x) & set(y)] for i, x in rows[0]}
    assert {r.id: (r.n, r.first) for r in linkage.overlap(a, b).collect()} == {i: (len(js), js[0]) for i, js in want.items() if js}


def test_overlap_sends_no_exploded_table_through_the_driver(spark, monkeypatch):
    """Subsets of heavy tokens are many times their file; Spark judged them by it and broadcast them."""
    monkeypatch.setattr(linkage, "HEAVY", 5)
    df = spark.range(400).select("id", F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.concat(F.lit("t"), (F.col("id") * (k + 1)) % 17)).alias("tokens"))
    out = linkage.overlap(df, df)
    lines = out._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    for n, x in enumerate(lines):
        if "BroadcastExchange" in x:
            below = next((m for m in range(n + 1, len(lines)) if depth[m] <= depth[n]), len(lines))
            assert not any("Generate" in y for y in lines[n:below]), lines[n]
    want = {r.id: set(r.tokens) for r in df.collect()}
    assert {r.id: (r.n, r.first) for r in out.collect()} == {i: (len(js), min(js)) for i, x in want.items() if (js := [j for j, y in want.items() if x & y])}


@pytest.mark.parametrize("bits", [1, 4, 64])
@pytest.mark.parametrize("heavy", [5, 32])
def test_overlap_of_heavy_tokens_that_share_a_bit(spark, monkeypatch, heavy, bits):
    """Records come in several rows here, and a pair may share tokens of both kinds; no row per pair is exchanged for the clear ones."""
    import random

    monkeypatch.setattr(linkage, "HEAVY", heavy)
    monkeypatch.setattr(linkage, "BITS", bits)
    rng = random.Random(5)
    names = [f"t{k}" for k in range(12)] + [f"u{k}" for k in range(120)]
    rows = [[(i % 80, [rng.choice(names[:12] if rng.random() < 0.3 else names) for _ in range(rng.choice([0, 1, 2]))]) for i in range(160)] for _ in range(2)]
    held = [{i: {t for j, x in side if j == i for t in x} for i in range(80)} for side in rows]
    out = linkage.overlap(*(spark.createDataFrame(r, "id long, tokens array<string>") for r in rows))
    want = {i: [j for j, y in held[1].items() if x & y] for i, x in held[0].items()}
    assert {r.id: (r.n, r.first) for r in out.collect()} == {i: (len(js), js[0]) for i, js in want.items() if js}
    if bits == 64:
        assert not re.search(r"hashpartitioning\(id#\d+L?, r#", out._jdf.queryExecution().executedPlan().toString())


def shuffled_rows(spark):
    jvm, context = spark._jvm, spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty(60_000)
    stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_overlap_exchanges_no_subsets(spark):
    """Records of eight heavy tokens have 255 sets of them each, which are counted inside the tasks."""
    import random

    rng, n = random.Random(9), 2000
    rows = [[(i, rng.sample([f"t{k}" for k in range(60)], 8)) for i in range(n)] for _ in range(2)]
    before = shuffled_rows(spark)
    got = {r.id: (r.n, r.first) for r in linkage.overlap(*(spark.createDataFrame(r, "id long, tokens array<string>") for r in rows)).collect()}
    assert shuffled_rows(spark) - before < 2 * n * 8 * 6
    held = [(j, set(y)) for j, y in rows[1]]
    for i, x in rows[0][::40]:
        js = [j for j, y in held if not y.isdisjoint(x)]
        assert got[i] == (len(js), js[0])
    assert len(got) == n


@pytest.mark.parametrize(("top", "size", "dense"), [(0, 4, 1 << 16), (2, 9, 3), (12, 1 << 17, 3)])
def test_overlap_deals_out_frequent_tokens(spark, monkeypatch, top, size, dense):
    """Tokens of few holders on one side and many on the other; some too frequent for one place, more of them than are numbered at once."""
    import random

    for name, value in {"HEAVY": 2, "TOP": top, "SLICE": size, "DENSE": dense}.items():
        monkeypatch.setattr(linkage, name, value)
    rng = random.Random(11)
    pick = lambda names: rng.sample(names, rng.choice([0, 1, 3, 6, 8])) + ["all"] * (rng.random() < 0.9)
    names = [f"t{k}" for k in range(20)]
    rows = [[(f"l{i:03}", pick(names[:8] if i % 2 else names)) for i in range(90)], [(i, pick(names[4:] if i % 3 else names)) for i in range(60)]]
    out = linkage.overlap(spark.createDataFrame(rows[0], "id string, tokens array<string>"), spark.createDataFrame(rows[1], "id long, tokens array<string>"))
    want = {i: [j for j, y in rows[1] if set(x) & set(y)] for i, x in rows[0]}
    assert {r.id: (r.n, r.first) for r in out.collect()} == {i: (len(js), js[0]) for i, js in want.items() if js}


@pytest.mark.parametrize(("rows", "step"), [(1, 1), (7, 40), (1 << 18, 1 << 21)])
def test_sets_are_counted_in_bounded_steps(rows, step):
    """Rows of two units in batches of three, taken and counted in pieces of any size."""
    import pyarrow as pa

    units = {5: ([(0, 1), (0, 1), (2, 3, 4), (1, 2, 3, 4)], [(1,), (0, 1, 2), (2, 3, 4), (0, 3)]), 9: ([(0,)] * 5 + [(0, 5, 7)], [(5, 7), (0, 7), (8,)])}
    made = [(t, 0, 1, 0, mine, 100 * t + i if mine else None, 1, x) for t, sides in units.items() for mine, side in zip((False, True), sides) for i, x in enumerate(side)]
    names = ["t", "part", "parts", "salt", "mine", "id", "holders", "prefix"]
    batches = pa.Table.from_pylist([dict(zip(names, r)) for r in made]).to_batches(max_chunksize=3)
    got = {r["id"]: r["n"] for b in subsets.meet(iter(batches), rows, step) for r in b.to_pylist()}
    want = {100 * t + i: sum(bool(set(x) & set(y)) for y in theirs) for t, (theirs, mine) in units.items() for i, x in enumerate(mine)}
    assert got == {i: -n for i, n in want.items() if n}


def test_multiget_cards_reads_its_rows_once(spark):
    requested = spark.createDataFrame([(0, 0, "/b/%41.vcf")], "doc_id long, ord int, href string")
    body = '<d:multistatus xmlns:d="DAV:"><d:response><d:href>http://h/b/A.vcf</d:href><d:status>HTTP/1.1 404 X</d:status></d:response></d:multistatus>'
    payloads = spark.createDataFrame([(0, 7, 207, body)], "doc_id long, call long, status int, body string")
    out = protocol.multiget_cards(protocol.multiget_rows(requested, payloads, "http://h/b/"))
    assert "EvalPython" not in out._jdf.queryExecution().executedPlan().toString()
    assert [(r.call, r.href, r.outcome) for r in out.collect()] == [(7, "/b/A.vcf", "missing")]


@pytest.mark.parametrize(
    ("href", "path"),
    [("/b/%41%2f%25%7e.vcf", "/b/A%2F%25~.vcf"), ("http://h:80/b/x", "/b/x"), ("//h/b", "/b"), ("/b/../c/./d", "/c/d"), ("http://h/b/../c", "/b/../c"), ("/b/%c3%a9", "/b/%C3%A9"), ("/b/%ff", "/b/%ff"), ("/b/%zz", "/b/%25zz"), ("/b/x?y#z", "/b/x"), ("/b/c;", "/b/c"), ("x", "/b/x"), ("http://h", ""), ("/...", "/...")],
)
def test_one_spelling_of_hrefs(href, path):
    assert protocol.canonical_path("http://h/b/", href) == path


def test_state_store(spark, tmp_path):
    store = statestore.StateStore(spark, str(tmp_path / "s"))
    assert store.version() is None and store.read("contacts") is None
    one = spark.createDataFrame([(1, "a")], "id long, uid string")
    assert store.commit({"contacts": one, "conflicts": one}, None) == 1
    assert store.commit({"contacts": one.union(one)}, 1) == 2 and store.read("contacts").count() == 2 and store.read("contacts", 1).count() == 1
    with pytest.raises(RuntimeError):
        store.commit({"contacts": one}, 1)
    with pytest.raises(RuntimeError):
        statestore.StateStore(spark, store.path).commit({"contacts": one}, None)
    assert store.commit({"listing": one}, 2) == 3 and store.read("contacts").count() == 2  # carried forward
    assert store.commit({}, 3, append={"conflicts": one}, meta={"batch": 7}) == 4 and store.read("conflicts").count() == 2 and store.meta() == {"batch": 7}
    assert store.reset() == 5 and store.read("contacts") is None and store.read("conflicts").count() == 2 and store.meta() == {}
    assert len(store.vacuum(1)) == 3 and store.read("conflicts").count() == 2
    assert statestore.require_unique(one.union(one), ["uid"]).count() == 1


def test_a_refused_writer_changes_nothing(spark, tmp_path):
    store = statestore.StateStore(spark, str(tmp_path / "s"))
    store.commit({"contacts": spark.range(3).toDF("id")}, None)
    store.commit({"contacts": spark.range(10).toDF("id")}, 1)
    with pytest.raises(statestore.Moved):  # it read version 1 and writes 99 rows
        statestore.StateStore(spark, store.path).commit({"contacts": spark.range(99).toDF("id")}, 1)
    assert store.version() == 2 and store.read("contacts").count() == 10
    late = statestore.StateStore(spark, store.path)
    late.manifests.number = lambda: 1  # both looked before either wrote
    with pytest.raises(statestore.Moved):
        late.commit({"contacts": spark.range(99).toDF("id")}, 1)
    assert store.version() == 2 and store.read("contacts").count() == 10


def test_stream_batches_are_folded_once(spark, tmp_path):
    src, store = str(tmp_path / "in"), statestore.StateStore(spark, str(tmp_path / "store"))
    for n, status in enumerate((200, 404, 404, 200)):  # the listing is empty in between
        spark.createDataFrame([(n, 1, "a", status, f"e{n}" if status == 200 else None)], loop.PAGES).coalesce(1).write.mode("append").parquet(src)
        q = loop.keep_snapshot(loop.change_stream(spark, src), store, str(tmp_path / "ck"), compact_after=2)
        q.awaitTermination(60)
        q.stop()
        assert loop.snapshot(store).count() == (status == 200)
    assert store.version() == 4 and store.meta() == {"batch": 3} and len(store.folders("changes")) < 3


def test_guarded_writes(spark):
    server = spark.createDataFrame([("a", "1", "A"), ("b", "1", "B"), ("c", "1", "C")], "href string, etag string, body string")
    writes = [("a", "put", "1", "A2"), ("b", "put", None, "x"), ("c", "delete", "0", None), ("d", "put", None, "D"), ("e", "delete", "1", None), ("f", "put", None, "z" * 50)]
    new, out = sinks.apply_writes(server, spark.createDataFrame(writes, "href string, op string, if_match string, body string"), 40)
    assert {r.href: r.outcome for r in out.collect()} == {"a": "done", "b": "precondition_failed", "c": "precondition_failed", "d": "done", "e": "done", "f": "too_large"}
    assert {r.href: r.body for r in new.collect()} == {"a": "A2", "b": "B", "c": "C", "d": "D"}


def test_stream_keeps_the_latest(spark, tmp_path):
    src, store = str(tmp_path / "in"), statestore.StateStore(spark, str(tmp_path / "store"))
    batches = [[(1, 1, "a", 200, "1"), (1, 2, "b", 200, "1")], [(2, 1, "a", 404, None), (2, 2, "c", 200, "9"), (2, 3, "b", 200, "2")]]
    for rows in batches:
        spark.createDataFrame(rows, loop.PAGES).coalesce(1).write.mode("append").parquet(src)
        q = loop.keep_snapshot(loop.change_stream(spark, src), store, str(tmp_path / "ck"))
        q.awaitTermination(60)
        q.stop()
    assert {(r.href, r.etag) for r in loop.snapshot(store).collect()} == {("b", "2"), ("c", "9")} and store.meta() == {"batch": 1} and len(store.folders("changes")) == 2


def test_poll_loop():
    now, runs = [0.0], []

    def run():
        runs.append(now[0])
        if len(runs) == 2:
            raise ValueError
        return 500 if len(runs) == 1 else None

    n = loop.poll(run, 10, lambda: len(runs) >= 3, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    assert n == 3 and runs == [0.0, 500.0, 560.0]


BODY = """<?xml version="1.0"?><d:multistatus xmlns:d="DAV:" xmlns:c="urn:ietf:params:xml:ns:carddav">
<d:response><d:href>/b/</d:href><d:propstat><d:prop><d:resourcetype><d:collection/><c:addressbook/></d:resourcetype></d:prop><d:status>HTTP/1.1 200 OK</d:status></d:propstat></d:response>
<d:response><d:href>/b/1</d:href><d:propstat><d:prop><d:getetag>"x"</d:getetag><c:address-data>A
B</c:address-data></d:prop><d:status>HTTP/1.1 200 OK</d:status></d:propstat><d:propstat><d:prop/><d:status>HTTP/1.1 404 No</d:status></d:propstat></d:response>
<d:response><d:href>/b/2</d:href><d:status>HTTP/1.1 404 Not Found</d:status></d:response><d:sync-token>t1</d:sync-token></d:multistatus>"""


def test_payloads(spark):
    bad = ["<!DOCTYPE x><a/>", "<a/>", "<a", None]
    rows = protocol.multistatus(spark.createDataFrame([(i, b) for i, b in enumerate([BODY, *bad])], "doc_id long, body string")).orderBy("doc_id", "ord").collect()
    assert [r.error for r in rows] == [None] * 3 + ["dtd", "root", "malformed", "malformed"]
    assert rows[0].is_addressbook and rows[1].etag == '"x"' and rows[1].address_data == "A\r\nB" and rows[1].propstat_error == 404 and rows[2].status == 404 and rows[2].sync_token == "t1"
    one = spark.createDataFrame([("https://h/a%20b/C+d%2f%C3%A9",), ("x%FF/y",), (None,)], "h string").select(protocol.canonical_paths("https://h/base/", F.col("h")).alias("p")).collect()
    assert [r.p for r in one] == ["/a%20b/C+d%2F%C3%A9", "/base/x%FF/y", None]
    dump = protocol.dump_rows(spark.createDataFrame([("b", "1", "B"), ("a", "2", "A")], "href string, etag string, vcard string")).orderBy("ord").collect()
    assert [json.loads(r.card)["href"] for r in dump] == ["a", "b"] and [r.ord for r in dump] == [0, 1]


def test_failures_and_report(spark, tmp_path):
    ev = [("k", "a", 1), ("k", "a", 2), ("k", None, 3), ("k", None, 4), ("k", "a", 5)]
    h = failures.replay_history(spark.createDataFrame(ev, "k string, etag string, at int"), ["k"], ["at"]).orderBy("at").collect()
    assert [(r.attempts, r.first_at) for r in h] == [(1, 1), (2, 1), (1, 3), (2, 3), (1, 5)]
    ops = [(1, "u1", "adopt", None, None, None), (2, "u2", "recreate", None, None, "identity"), (3, "u3", "create", "left", None, None)]
    lines = report.sections(spark.createDataFrame(ops, "seq int, uid string, op string, on string, origin string, pass string"))
    report.write_report(lines, str(tmp_path / "report"))
    text = [r.value for r in spark.read.text(str(tmp_path / "report")).collect()]
    assert text[0].startswith("in_sync 1, conflicts 0, reuid 0, by_identity 1") and text[1:] == ["In sync:", "  uid=u1", "Paired by identity:", "  uid=u2", "To copy:", "  uid=u3 to left"]


def test_delta_rules(spark):
    rows = [(1, 1, "/b/x", 200, "1", "t1"), (1, 2, "/b/y", 404, None, "t1"), (1, 3, "/b/z", 200, "1", "t1"), (2, 1, "/b/x", 200, None, "t2"), (2, 2, "/b/y", 404, None, "t2"), (2, 3, "/b/y", 200, None, "t2"), (2, 4, "/b/z", 404, None, "t2")]
    pages = spark.createDataFrame(rows, "page int, ord int, href string, status int, etag string, token string")
    got = {r.href: (r.kind, r.etag) for r in cdc.latest_changes(pages).collect()}
    assert got == {"/b/x": ("changed", "1"), "/b/y": ("removed", None), "/b/z": ("removed", None)}  # members without an etag are no observation
    more = pages.unionByName(spark.createDataFrame([(1, 9, "/b/", 507, None, "t1"), (2, 8, "/b/sub/", 200, "1", "t2")], pages.schema))
    assert {r.href for r in cdc.members(more, "/b").collect()} == {"/b/x", "/b/y", "/b/z"}
    assert tuple(cdc.delta_pages(more, "/b").first()) == (2, True, "t2", None)
    assert tuple(cdc.delta_pages(more.filter("page = 1"), "/b").first()) == (1, False, "t1", None)
    assert tuple(cdc.delta_pages(more.filter("page = 1"), "/b", 1).first()) == (1, False, None, "permanent")
    assert cdc.delta_pages(more.withColumn("token", F.lit(None).cast("string")), "/b").first().error == "permanent"
    codes = spark.createDataFrame([(403, "<d:error><d:valid-sync-token/></d:error>", True), (409, "<valid-sync-token></valid-sync-token>", True), (403, "<d:valid-sync-token/>", False), (500, "<d:valid-sync-token/>", True), (400, None, True)], "c int, b string, t boolean")
    assert [r[0] for r in codes.select(cdc.token_rejected(F.col("c"), F.col("b"), F.col("t"))).collect()] == [True, True, False, False, False]
    ends = spark.createDataFrame([("a", True, "t", False), ("b", True, "t", True), ("c", True, None, False), ("d", False, None, False), ("e", True, None, True)], "side string, supports_sync boolean, token string, rejected boolean")
    assert {r.side: r.listing for r in cdc.choose_listing(ends).collect()} == {"a": "delta", "b": "full", "c": "full", "d": "etags", "e": "permanent"}


def test_idle(spark):
    state = spark.createDataFrame([("a", "/l/a", "/r/a", False), ("b", "/l/b", "/r/b", False), ("c", "/l/c", "/r/c", False), ("d", "/l/d", "/r/d", True)], "uid string, left_href string, right_href string, photo_tracked boolean")
    failed = spark.createDataFrame([("left", "/x", "a", False), ("right", "/r/b", None, False)], "side string, href string, uid string, due boolean")
    ends = spark.createDataFrame([("left", "t", True), ("right", "t", True)], "side string, token string, supports_sync boolean")
    none, held = spark.createDataFrame([], "href string"), spark.createDataFrame([("c",)], "uid string")
    facts = lambda **x: cdc.idle_facts(**({"state": state, "failures": failed, "journal": none, "endpoints": ends, "deltas": none, "held_deletes": held} | x)).first()
    assert facts().idle and not facts(held_deletes=held.limit(0)).idle and facts(held_deletes=held.limit(0)).untracked == 1
    assert not facts(journal=held).idle and not facts(endpoints=ends.limit(1)).idle and not facts(deltas=spark.createDataFrame([("h",)], "href string")).idle
    assert not facts(failures=failed.withColumn("due", F.lit(True))).idle
    listing = spark.createDataFrame([("left", "/l/a"), ("left", "/l/a"), ("right", "/r/b")], "side string, href string")
    assert [r.uid for r in cdc.seen_rows(state, listing, "left").collect()] == ["a"]


def test_store_operations(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id long, uid string")
    left, told = statestore.delete_rows(rows, spark.createDataFrame([("a",), ("z",)], "uid string"), ["uid"])
    assert [r.id for r in left.collect()] == [2] and {r.uid: r.found for r in told.collect()} == {"a": True, "z": False}
    assert [r.id for r in statestore.newest_first(rows).collect()] == [3, 2, 1] and [r.id for r in statestore.newest_first(rows, F.lit("a")).collect()] == [3, 1]
    assert [r.id for r in statestore.in_order(rows.sort(F.desc("id"))).collect()] == [1, 2, 3]
    ends = spark.createDataFrame([("left", 1, "t", "u"), ("right", 4, None, "v")], "side string, version long, token string, url string")
    table, told = statestore.set_token(ends, spark.createDataFrame([("left", "t"), ("right", "n"), ("else", "x")], "side string, token string"))
    assert {r.side: (r.version, r.token, r.url) for r in table.collect()} == {"left": (1, "t", "u"), "right": (5, "n", "v")}
    assert {r.side: r.outcome for r in told.collect()} == {"left": "unchanged", "right": "written", "else": "not_found"}
    bad = spark.createDataFrame([("left", "read", 1), ("up", "read", 1), ("left", "x", 1), ("left", "read", 0), ("left", "read", None)], "side string, op string, attempts int")
    assert [r.corrupt for r in statestore.decode(bad, "failures").collect()] == [None, "side", "op", "attempts", "attempts"]


def test_cards_held_after_a_failure(spark):
    res = lambda s, u: (f"/{s}/{u}", "1")
    ops = [("c", "create", "right", None), ("d", "delete", "left", None), ("r", "recreate", "right", None), ("b", "conflict", "right", "baseline"), ("s", "conflict", "right", "sync"), ("f", "refresh", None, None)]
    failed = spark.createDataFrame([(*o, res("l", o[0]), res("r", o[0])) for o in ops], "uid string, op string, on string, origin string, left struct<href:string,etag:string>, right struct<href:string,etag:string>")
    written = spark.createDataFrame([("r", "right", "/r/r", None), ("c", "right", "/r/new", "9"), ("f", "left", "/l/f", "9")], "uid string, side string, href string, etag string")
    got = {(r.uid, r.side, r.href, r.etag, r.op) for r in failures.cards_to_hold(failed, written).collect()}
    assert got == {
        ("c", "left", "/l/c", "1", "create"), ("c", "right", "/r/new", "9", "create"), ("d", "left", "/l/d", "1", "delete"), ("r", "left", "/l/r", "1", "update"), ("r", "right", "/r/r", None, "update"),
        ("b", "left", "/l/b", "1", "update"), ("b", "right", "/r/b", "1", "update"), ("s", "left", "/l/s", "1", "update"),
    }


def test_windowed_failures_count_late_events(spark, tmp_path):
    src = str(tmp_path / "ev")
    rows = [("2024-01-01 10:00:00", "a", "1"), ("2024-01-01 23:00:00", "a", "2"), ("2024-01-02 01:00:00", "b", "1"), ("2024-01-01 22:30:00", "a", "0")]
    spark.createDataFrame(rows, "ts string, href string, etag string").select(F.to_timestamp("ts").alias("ts"), "href", "etag").write.parquet(src)
    stream = spark.readStream.schema("ts timestamp, href string, etag string").parquet(src)
    q = loop.event_counts(stream).writeStream.format("memory").queryName("late_failures").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(60)
    got = {(str(r.window.start)[:10], r.href, r.failures, r.etag) for r in spark.table("late_failures").collect()}
    assert got == {("2024-01-01", "a", 3, "2"), ("2024-01-02", "b", 1, "1")}
