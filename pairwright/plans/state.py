"""Queries over state, failures, photos and text functions, on inputs derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairwright.functions import cards
from pairwright.functions import text as T
from pairwright.operators import cdc, failures, photos, statestore
from pairwright.sources import protocol
from pairwright.sources.tables import table


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("etag"), F.col("event_id").alias("at"), "ts")


def failure_history(spark, sf_dir):
    return failures.replay_history(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "attempts", "first_at", "wait_s")


def failure_attempts(spark, sf_dir):
    hist = failures.replay_history(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"])
    return failures.current(hist, ["user_id"], ["ts", "event_id"]).select("user_id", "etag", "attempts", "first_at", "wait_s")


def retry_times(spark, sf_dir):
    """Per user the failure row with the time of its next try, and what holds back at the last event's time: users in fours share a uid."""
    t = table(spark, sf_dir, "events")
    hist = failures.replay_history(t.select("user_id", "event_id", F.col("event_type").alias("etag"), F.unix_timestamp("ts").alias("at"), "ts"), ["user_id"], ["ts", "event_id"])
    rows = failures.current(hist, ["user_id"], ["ts", "event_id"]).withColumn("next_retry_at", F.col("at") + F.col("wait_s"))
    rows = rows.crossJoin(t.agg((F.unix_timestamp(F.max("ts")) - 600).alias("now")))  # one row
    k = F.col("user_id")
    listed = F.when(k % 7 == 0, "changed").otherwise(F.col("etag"))
    rows = rows.withColumns({"due": cdc.due(F.col("now"), F.col("next_retry_at"), listed, F.col("etag")), "key": k, "uid": F.when(k % 5 != 0, F.expr("user_id div 4"))})
    return cdc.held(rows).select("user_id", "attempts", "first_at", "next_retry_at", "due", "held")


def failure_record(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    stored = o.filter("o_orderkey % 3 <> 0").select(F.lit("left").alias("side"), k.alias("href"), F.when(k % 5 != 0, "a").alias("etag"), (k % 4 + 1).alias("attempts"), F.lit(1).alias("first_at"), F.lit("transient").alias("reason"))
    events = o.filter("o_orderkey % 2 = 0").select(F.lit("left").alias("side"), k.alias("href"), F.when(k % 7 != 0, "a").alias("etag"), F.lit(9).alias("at"), failures.reason(F.when(k % 4 == 0, "permanent").otherwise("store_busy")).alias("reason"))
    return failures.record(stored, events)


def failures_resolved(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.lit("left").alias("side"), F.col("o_orderkey").alias("href"))
    return failures.resolved(o, o.filter("href % 4 = 0"), o.filter("href % 3 <> 0"), o.filter("href % 5 = 0"))


def backoff(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.backoff_seconds(F.col("p_size")).alias("wait_s"), (F.col("p_size") >= failures.PERSISTENT).alias("persistent"))


def state_upsert(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    stored = c.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("uid"), F.lit(1).cast("long").alias("version"), F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name"))
    changes = o.groupBy(F.col("o_custkey").alias("uid")).agg(F.max("o_orderpriority").alias("segment"), F.min(F.lit(None).cast("string")).alias("name"))
    return statestore.upsert(stored, changes, ["uid"], ["segment", "name"])


def update_versioned(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    stored = c.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 3).alias("version"), F.col("c_mktsegment").alias("segment"))
    updates = c.select((F.col("c_custkey") * 2).alias("id"), (F.col("c_custkey") % 2).alias("version"), F.lit("new").alias("segment"))
    new, refused = statestore.update_versioned(stored, updates, ["segment"])
    return new.join(refused, "id", "full_outer").select("id", F.coalesce("version", F.lit(-1)).alias("version"), "segment", "reason")


def last_seen_max(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    stored = c.select(F.col("c_custkey").alias("uid"), (F.col("c_custkey") % 400).alias("seen"))
    return statestore.last_seen(stored, o.select(F.col("o_custkey").alias("uid"), F.dayofyear("o_orderdate").cast("long").alias("seen")), "uid", "seen")


def journal_replace(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("uid"), F.col("c_name").alias("card"))
    return statestore.replace(c, c.filter("uid % 4 = 0").withColumn("card", F.concat("card", F.lit("!"))), ["uid"])


def endpoint_upsert(spark, sf_dir):
    n = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    stored = n.filter("c_custkey % 5 <> 0").select(k.alias("side"), F.concat(F.lit("u"), k).alias("url"), F.lit("h1").alias("host"), F.lit("t").alias("token"))
    found = n.filter("c_custkey % 2 = 0").select(k.alias("side"), F.concat(F.lit("u"), k, F.when(k % 3 == 0, "x").otherwise("")).alias("url"), F.lit("h2").alias("host"))
    return statestore.endpoint_upsert(stored, found)


def replay_journal(spark, sf_dir):
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    pending = c.select(k.alias("id"), F.col("c_name").alias("uid"), F.concat(F.lit("l"), k).alias("left_href"), F.concat(F.lit("o"), k).alias("old_right_href"), F.concat(F.lit("n"), k).alias("new_right_href"))
    listed = c.filter("c_custkey % 2 = 0").select(F.lit("left").alias("side"), F.concat(F.lit("l"), k).alias("href"))
    listed = listed.unionByName(c.filter("c_custkey % 3 = 0").select(F.lit("right").alias("side"), F.concat(F.lit("o"), k).alias("href")))
    return statestore.replay_journal(pending, listed.unionByName(c.filter("c_custkey % 5 = 0").select(F.lit("right").alias("side"), F.concat(F.lit("n"), k).alias("href"))))


def _photo_rows(spark, sf_dir):
    v, h = F.col("vec_id"), lambda m, n: F.when(F.col("vec_id") % m != 0, F.concat(F.lit("p"), (F.expr(f"vec_id div {n}")) % 3))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        (v % 3 != 0).alias("tracked"),
        h(5, 2).alias("left_hash"),
        h(4, 3).alias("right_hash"),
        h(7, 4).alias("left_recorded"),
        h(6, 5).alias("right_recorded"),
        (v % 11 != 0).alias("left_bytes"),
        (v % 13 != 0).alias("right_bytes"),
    )


def photo_decide(spark, sf_dir):
    return photos.decide(_photo_rows(spark, sf_dir)).select("vec_id", "left_action", "right_action")


def photo_next_state(spark, sf_dir):
    rows = photos.decide(_photo_rows(spark, sf_dir), "right").withColumn("stripped", F.col("vec_id") % 2 == 0)
    fit = F.col("vec_id") % 10 != 0
    for s in ("left", "right"):
        rows = rows.withColumn(f"{s}_change", F.when(F.col(f"{s}_action") != "keep", photos.apply_action(F.col(f"{s}_action"), F.col(f"{s}_hash").isNotNull(), fit if s == "left" else F.lit(True))))
    return photos.next_state(rows).select("vec_id", "left_change", "right_change", "next_left_hash", "next_right_hash", "next_stripped")


def photo_merge(spark, sf_dir):
    """Customers' plan rows with photo actions by key."""
    from pairwright.plans import merge

    k = F.col("uid")
    rows = merge.three_way_matrix(spark, sf_dir).withColumns(
        {
            "tracked": k % 3 != 0,
            "left_action": F.when(k % 5 == 0, "set").when(k % 5 == 1, "remove").otherwise("keep"),
            "right_action": F.when(k % 7 == 0, "set").otherwise("keep"),
        }
    )
    return photos.merge_ops(rows).select("uid", "op", "on", "diag", "photo_action", "counter_side", "counter_action")


def cycle_photos(spark, sf_dir):
    """Customers' photos, read, recorded, or not at hand, joined to their plan rows as a cycle does it."""
    from pairwright.plans import merge, pictures

    decided = merge.three_way_matrix(spark, sf_dir)
    k, of = F.col("uid"), decided.select("uid")
    h = lambda n: F.concat(F.lit("p"), F.expr(f"uid div {n} % 3"))
    now = lambda s, none, n, bare, away: of.filter(k % none != 0).select(F.lit(s).alias("side"), "uid", h(n).alias("now_hash"), F.lit(None).cast("string").alias("now_uri"), (k % bare != 0).alias("has_bytes"), (k % away != 0).alias("available"))
    stored = of.filter(k % 4 != 0).select("uid", (k % 3 != 0).alias("tracked"), F.lit(None).cast("string").alias("left_uri"), F.when(k % 5 != 0, h(2)).alias("left_hash"), F.when(k % 7 != 0, h(3)).alias("right_hash"), F.lit(False).alias("stripped"))
    shown = pictures.Pictures(now("left", 6, 4, 11, 13).unionByName(now("right", 8, 5, 9, 14)), of, stored, of)
    moved, rows = pictures.merge(decided, shown, "left")
    return moved.select("uid", "op", "on", "diag").join(rows.select("uid", "action", "counter_side", "counter_action", "open"), "uid")


def photo_downloads(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    uri = lambda m: F.concat(F.lit("https://h/"), (k % m))
    fetched = o.select(k.alias("uid"), F.when(k % 9 != 0, uri(500)).alias("uri"))
    state = o.filter("o_orderkey % 50 <> 0").select(k.alias("uid"), (k % 70 != 0).alias("photo_tracked"), F.when(k % 60 == 0, "other").otherwise(uri(500)).alias("photo_uri"), F.when(k % 80 != 0, "h").alias("photo_hash"))
    return photos.downloads(fetched, state)


def _card_photos(spark, sf_dir):
    """Orders as cards with a photo of each kind, tracked or not, and what was downloaded."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    kind = F.when(k % 5 == 0, "inline").when(k % 5 == 1, "unreadable").when(k % 5 < 4, "uri")
    rows = o.select(F.when(k % 2 == 0, "left").otherwise("right").alias("side"), k.cast("string").alias("uid"), kind.alias("kind"), F.when(k % 5 == 0, F.concat(F.lit("h"), k)).alias("hash"), F.when((k % 5 == 2) | (k % 5 == 3), F.concat(F.lit("https://h/"), k % 300)).alias("uri"))
    state = o.filter("o_orderkey % 7 <> 0").select(k.cast("string").alias("uid"), (k % 3 != 0).alias("photo_tracked"), F.concat(F.lit("https://h/"), F.when(k % 11 == 0, k % 299).otherwise(k % 300)).alias("photo_uri"), F.when(k % 13 != 0, F.concat(F.lit("s"), k)).alias("photo_hash"))
    down = spark.range(300).filter("id % 4 <> 0").select(F.concat(F.lit("https://h/"), "id").alias("uri"), F.when(F.col("id") % 6 != 0, F.concat(F.lit("d"), "id")).alias("hash"))
    return rows, state, down


def photo_current(spark, sf_dir):
    return photos.current(*_card_photos(spark, sf_dir))


def photo_copies(spark, sf_dir):
    """Copies of those cards to the other side."""
    now = photos.current(*_card_photos(spark, sf_dir))
    k = F.col("uid").cast("long")
    ops = now.select("uid", F.when(k % 17 == 0, "update").when(k % 19 == 0, "copy_group").otherwise("create").alias("op"), F.when(F.col("side") == "left", "right").otherwise("left").alias("on"))
    return photos.attach_to_copies(ops, now.withColumn("fits", k % 10 != 5))


def photo_blocked(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    entries = o.select(F.concat(F.lit("/l/"), k).alias("href"), F.when(k % 4 == 0, "held").otherwise("fetched").alias("kind"), F.when(k % 4 != 0, k).alias("uid"))
    return photos.blocked(entries, o.filter("o_orderkey % 6 = 1").select(k.alias("uid"), F.when(k % 5 == 0, "too_large").otherwise("transient").alias("reason")))


def photo_recorded(spark, sf_dir):
    v = F.col("vec_id")
    state = table(spark, sf_dir, "embeddings").select(v.alias("uid"), F.when(v % 3 != 0, F.concat(F.lit("l"), v)).alias("left_photo_hash"), F.when(v % 4 == 0, F.concat(F.lit("u"), v)).alias("left_photo_uri"), F.when(v % 5 != 0, F.concat(F.lit("r"), v)).alias("right_photo_hash"))
    return photos.recorded(state)


def photo_fit(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", photos.fits(F.col("o_orderkey") % 1000, (F.col("o_orderkey") * 37) % 300_000).alias("fits"))


def hex_hashes(spark, sf_dir):
    k = F.col("o_orderkey")
    digest = F.sha2(k.cast("string").cast("binary"), 256)
    raw = F.when(k % 4 == 0, F.upper(digest)).when(k % 4 == 1, F.substring(digest, 1, 63)).when(k % 4 == 2, F.concat(F.substring(digest, 1, 63), F.lit("g"))).otherwise(digest)
    return table(spark, sf_dir, "orders").select("o_orderkey", T.hex_digest(raw).alias("hash"))


def row_decode(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k, F.when(k % 7 == 0, "middle").otherwise("left").alias("side"), F.when(k % 5 == 0, F.lit(None)).otherwise("read").alias("op"), (k % 3).alias("attempts"))
    return statestore.decode(rows, "failures").select("o_orderkey", "corrupt")


def token_set(spark, sf_dir):
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    stored = c.filter("c_custkey % 4 <> 0").select(k.alias("side"), (k % 3).alias("version"), F.when(k % 5 != 0, F.lit("t")).alias("token"))
    table_, told = statestore.set_token(stored, c.filter("c_custkey % 2 = 0").select(k.alias("side"), F.when(k % 6 == 0, "t").otherwise("n").alias("token")))
    return table_.join(told, "side", "full_outer")


def rows_deleted(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    kept, told = statestore.delete_rows(o.select("o_orderkey", F.col("o_custkey").alias("uid")), c.select((F.col("c_custkey") * 3).alias("uid")), ["uid"])
    return kept.groupBy("uid").agg(F.count(F.lit(1)).alias("kept")).join(told, "uid", "full_outer")


def status_class(spark, sf_dir):
    code = (200 + F.col("o_orderkey") % 400).cast("int")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.status_class(code).alias("class"), failures.is_fatal(T.status_class(code)).alias("fatal"), failures.reason(T.status_class(code)).alias("reason"))


def retry_after(spark, sf_dir):
    k = F.col("o_orderkey")
    raw = F.when(k % 4 == 0, (k * 7 % 5000).cast("string")).when(k % 4 == 1, F.lit("soon")).when(k % 4 == 2, F.lit("123456789012345")).otherwise(F.concat(F.lit(" "), (k % 60).cast("string")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(T.retry_after(raw, F.to_timestamp(F.lit("2024-01-01 00:00:00"))), F.lit(-1)).alias("wait_s"))


def collection_pick(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    rows = c.select(F.col("c_nationkey").alias("principal"), F.col("c_custkey").alias("ord"), F.concat(F.lit("/book/"), (F.col("c_custkey") % 40)).alias("path"))
    return protocol.select_collection(rows, "7").select("principal", "ord", "path")


def mint_href(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", T.mint_href(F.lit("/dav/book/"), F.col("c_name")).alias("href"))


def dump_sorted(spark, sf_dir):
    n = table(spark, sf_dir, "customer").select(F.col("c_name").alias("href"), F.concat(F.lit("e"), "c_custkey").alias("etag"), F.concat(F.lit("FN:"), "c_name").alias("vcard"))
    return protocol.dump_rows(n)


def text_forms(spark, sf_dir):
    """Scalar text functions over the whole texts of documents."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.md5(T.unescape(F.replace(t, F.lit("a"), F.lit("\\n"))).cast("binary")).alias("unescaped"),
        F.md5(T.canonical_value(F.replace(t, F.lit("e"), F.lit("\\N"))).cast("binary")).alias("canonical"),
        F.md5(T.restore_crlf(t).cast("binary")).alias("crlf"),
        F.md5(T.xml_escape(t).cast("binary")).alias("escaped"),
        T.normalize_phone(t).alias("phone"),
        T.looks_like_contact_point(t).alias("contact_point"),
    )


def canonical_dates(spark, sf_dir):
    at = F.col("o_orderdate").cast("timestamp_ntz")
    k = F.col("o_orderkey")
    raw = F.when(k % 3 == 0, F.date_format(at, "yyyy-MM-dd")).when(k % 3 == 1, F.concat(F.lit("--"), F.date_format(at, "MM-dd"))).otherwise(F.concat(F.date_format(at, "yyyy-MM-dd"), F.lit("T"), F.date_format(at, "HH:mm:ss"), F.lit("Z")))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.canonical_date(raw).alias("date"), T.quote_if_needed(raw).alias("quoted"))


def canonical_hash(spark, sf_dir):
    """Cards written untidily from customers; equal in meaning to the tidy form whose hash the oracle takes."""
    c = table(spark, sf_dir, "customer")
    lines = ["BEGIN:VCARD", "VERSION:3.0", "REV:2020", "uid:{k}", "fn:{n}", "item7.X-ABLabel:b", "item7.TEL;type=voice;TYPE=\"CELL\",cell:+{k}", "bday;value=date:1980-04-01", "END:VCARD", ""]
    parts = [F.lit(x) for x in "\r\n".join(lines).replace("{k}", "\0k\0").replace("{n}", "\0n\0").split("\0")]
    raw = F.concat(*[F.col("c_custkey").cast("string") if i % 2 and i in (1, 5) else F.col("c_name") if i % 2 else p for i, p in enumerate(parts)]).cast("binary")
    out = cards.parse(c.select("c_custkey", raw.alias("raw")))
    return out.select("c_custkey", "uid", cards.canonical_hash(F.col("props")).alias("hash"), cards.match_keys(F.col("props"))["phones"][0].alias("phone"))


QUERIES = {
    f.__name__: f
    for f in (
        failure_history, failure_attempts, retry_times, failure_record, failures_resolved, backoff, state_upsert, update_versioned, last_seen_max, journal_replace, endpoint_upsert, replay_journal, photo_decide,
        photo_next_state, photo_merge, cycle_photos, photo_downloads, photo_current, photo_copies, photo_blocked, photo_recorded, photo_fit, hex_hashes, row_decode, token_set, rows_deleted, status_class, retry_after, collection_pick, mint_href, dump_sorted, text_forms, canonical_dates, canonical_hash,
    )
}

_HIST = """
SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS attempts, first_value(event_id) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS first_at FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM (
    SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS fresh FROM events))
"""
_WAIT = "least(86400, 120 * pow(2, {} - 1))::BIGINT"
_CARRY = "CASE WHEN {s}_hash IS NULL THEN 'remove' WHEN {s}_bytes THEN 'set' ELSE 'keep' END"
_H = "CASE WHEN vec_id % {} <> 0 THEN 'p' || (vec_id // {} % 3) END"


def _photo_sql(winner: str) -> str:
    return f"""
SELECT *, CASE WHEN tracked AND rn AND (NOT ln OR (NOT eq AND '{winner}' = 'right')) OR NOT tracked AND right_hash IS NOT NULL AND left_hash IS NULL THEN {_CARRY.format(s="right")} ELSE 'keep' END AS left_action,
       CASE WHEN tracked AND ln AND (NOT rn OR (NOT eq AND '{winner}' = 'left')) OR NOT tracked AND left_hash IS NOT NULL AND right_hash IS NULL THEN {_CARRY.format(s="left")} ELSE 'keep' END AS right_action
FROM (SELECT *, left_hash IS DISTINCT FROM left_recorded AS ln, right_hash IS DISTINCT FROM right_recorded AS rn, left_hash IS NOT DISTINCT FROM right_hash AS eq FROM (
  SELECT vec_id, vec_id % 3 <> 0 AS tracked, {_H.format(5, 2)} AS left_hash, {_H.format(4, 3)} AS right_hash, {_H.format(7, 4)} AS left_recorded, {_H.format(6, 5)} AS right_recorded,
         vec_id % 11 <> 0 AS left_bytes, vec_id % 13 <> 0 AS right_bytes FROM embeddings))
"""


_CURRENT = """
SELECT *, CASE WHEN kind = 'inline' THEN hash WHEN kind = 'uri' AND side = 'left' THEN coalesce(known, down) WHEN kind = 'uri' THEN sha256(uri) WHEN kind = 'unreadable' THEN sha256(uid) END AS now_hash,
       CASE WHEN kind = 'uri' AND side = 'left' AND (known IS NOT NULL OR down IS NOT NULL) THEN uri END AS now_uri,
       coalesce(kind = 'inline' OR kind = 'uri' AND side = 'left' AND known IS NULL AND down IS NOT NULL, false) AS has_bytes,
       NOT coalesce(kind = 'uri' AND side = 'left' AND known IS NULL AND down IS NULL, false) AS available
FROM (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'left' ELSE 'right' END AS side, o_orderkey::VARCHAR AS uid,
             CASE o_orderkey % 5 WHEN 0 THEN 'inline' WHEN 1 THEN 'unreadable' WHEN 2 THEN 'uri' WHEN 3 THEN 'uri' END AS kind, CASE WHEN o_orderkey % 5 = 0 THEN 'h' || o_orderkey END AS hash,
             CASE WHEN o_orderkey % 5 IN (2, 3) THEN 'https://h/' || (o_orderkey % 300) END AS uri,
             CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 13 <> 0 AND (o_orderkey % 11 <> 0 OR o_orderkey % 299 = o_orderkey % 300) THEN 's' || o_orderkey END AS known,
             CASE WHEN o_orderkey % 300 % 4 <> 0 AND o_orderkey % 300 % 6 <> 0 THEN 'd' || (o_orderkey % 300) END AS down FROM orders)
"""

ORACLE = {
    "failure_history": f"SELECT user_id, event_id, attempts, first_at, {_WAIT.format('attempts')} AS wait_s FROM ({_HIST})",
    "failure_attempts": f"""SELECT user_id, event_type AS etag, attempts, first_at, {_WAIT.format('attempts')} AS wait_s
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM ({_HIST})) WHERE n = 1""",
    "retry_times": f"""
        WITH h AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM ({_HIST})),
             f AS (SELECT h.user_id, attempts, floor(epoch(e.ts))::BIGINT AS first_at, floor(epoch(h.ts))::BIGINT + {_WAIT.format('attempts')} AS next_retry_at FROM h JOIN events e ON e.event_id = h.first_at WHERE n = 1),
             d AS (SELECT *, (SELECT floor(epoch(max(ts)))::BIGINT - 600 FROM events) >= next_retry_at OR user_id % 7 = 0 AS due FROM f)
        SELECT user_id, attempts, first_at, next_retry_at, due, NOT bool_and(due) OVER (PARTITION BY CASE WHEN user_id % 5 <> 0 THEN 'u' || (user_id // 4) ELSE 'k' || user_id END) AS held FROM d""",
    "failure_record": f"""
        SELECT 'left' AS side, k AS href, CASE WHEN hit THEN ee ELSE se END AS etag, attempts, CASE WHEN hit AND NOT again THEN 9 ELSE 1 END AS first_at,
               CASE WHEN hit THEN CASE WHEN k % 4 = 0 THEN 'rejected' ELSE 'internal' END ELSE 'transient' END AS reason, {_WAIT.format('attempts')} AS wait_s
        FROM (SELECT *, CASE WHEN NOT hit THEN k % 4 + 1 WHEN again THEN k % 4 + 2 ELSE 1 END::BIGINT AS attempts FROM (
          SELECT *, stored AND ee IS NOT DISTINCT FROM se AS again FROM (
            SELECT o_orderkey AS k, o_orderkey % 3 <> 0 AS stored, o_orderkey % 2 = 0 AS hit, CASE WHEN o_orderkey % 7 <> 0 THEN 'a' END AS ee, CASE WHEN o_orderkey % 5 <> 0 THEN 'a' END AS se FROM orders) WHERE stored OR hit))""",
    "failures_resolved": "SELECT 'left' AS side, o_orderkey AS href FROM orders WHERE o_orderkey % 4 <> 0 AND NOT (o_orderkey % 3 <> 0 AND o_orderkey % 5 = 0)",
    "backoff": f"SELECT p_partkey, {_WAIT.format('p_size')} AS wait_s, p_size >= 3 AS persistent FROM part",
    "state_upsert": """
        WITH s AS (SELECT c_custkey AS uid, c_mktsegment AS seg, c_name AS name FROM customer WHERE c_custkey % 3 <> 0), c AS (SELECT o_custkey AS uid, max(o_orderpriority) AS new FROM orders GROUP BY 1)
        SELECT uid, CASE WHEN s.seg IS NULL THEN 1 WHEN new IS NOT NULL AND new <> s.seg THEN 2 ELSE 1 END::BIGINT AS version, coalesce(new, s.seg) AS segment, s.name FROM s FULL JOIN c USING (uid)""",
    "update_versioned": """
        WITH s AS (SELECT c_custkey AS id, c_custkey % 3 AS v, c_mktsegment AS seg FROM customer), u AS (SELECT c_custkey * 2 AS id, c_custkey % 2 AS uv FROM customer)
        SELECT id, CASE WHEN v IS NULL THEN -1 WHEN v = uv THEN v + 1 ELSE v END AS version, CASE WHEN v = uv THEN 'new' ELSE seg END AS segment,
               CASE WHEN uv IS NULL THEN NULL WHEN v IS NULL THEN 'not_found' WHEN v <> uv THEN 'conflict' END AS reason FROM s FULL JOIN u USING (id)""",
    "last_seen_max": """
        SELECT c_custkey AS uid, greatest(c_custkey % 400, coalesce(m, 0)) AS seen FROM customer LEFT JOIN (SELECT o_custkey, max(dayofyear(o_orderdate)) AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey""",
    "journal_replace": "SELECT c_custkey AS uid, c_name || CASE WHEN c_custkey % 4 = 0 THEN '!' ELSE '' END AS card FROM customer",
    "endpoint_upsert": """
        SELECT c_custkey AS side, 'u' || c_custkey || CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 0 THEN 'x' ELSE '' END AS url, CASE WHEN c_custkey % 2 = 0 THEN 'h2' ELSE 'h1' END AS host,
               CASE WHEN c_custkey % 5 <> 0 AND NOT (c_custkey % 2 = 0 AND c_custkey % 3 = 0) THEN 't' END AS token FROM customer WHERE c_custkey % 5 <> 0 OR c_custkey % 2 = 0""",
    "replay_journal": """
        SELECT c_custkey AS id, c_name AS uid, c_custkey % 3 <> 0 AS alias, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 5 = 0 THEN 'done' WHEN c_custkey % 2 = 0 THEN 'put' ELSE 'drop' END AS action FROM customer""",
    "photo_decide": f"SELECT vec_id, left_action, right_action FROM ({_photo_sql('left')})",
    "photo_next_state": f"""
        SELECT vec_id, lc AS left_change, rc AS right_change, CASE WHEN lc IS NULL THEN left_hash WHEN lc = 'set' THEN right_hash END AS next_left_hash,
               CASE WHEN rc IS NULL THEN right_hash WHEN rc = 'set' THEN left_hash END AS next_right_hash,
               CASE WHEN lc IS NULL THEN vec_id % 2 = 0 AND NOT ln ELSE lc = 'stripped' END AS next_stripped
        FROM (SELECT *, CASE left_action WHEN 'remove' THEN 'removed' WHEN 'set' THEN CASE WHEN vec_id % 10 <> 0 THEN 'set' ELSE 'stripped' END END AS lc,
                     CASE right_action WHEN 'remove' THEN 'removed' WHEN 'set' THEN 'set' END AS rc FROM ({_photo_sql('right')}))""",
    "photo_downloads": """
        SELECT DISTINCT 'https://h/' || (o_orderkey % 500) AS uri FROM orders WHERE o_orderkey % 9 <> 0 AND (o_orderkey % 50 = 0 OR o_orderkey % 70 = 0 OR o_orderkey % 60 = 0 OR o_orderkey % 80 = 0)""",
    "photo_current": f"SELECT side, uid, kind, hash, uri, now_hash, now_uri, has_bytes, available FROM ({_CURRENT})",
    "photo_copies": f"""
        SELECT uid, op, "on", CASE WHEN copies THEN CASE WHEN open AND now_hash IS NOT NULL THEN CASE WHEN "on" = 'left' AND k % 10 = 5 THEN 'stripped' ELSE 'set' END ELSE 'none' END END AS change,
               CASE WHEN copies THEN open END AS tracked, CASE WHEN open THEN CASE WHEN "on" = 'right' THEN now_hash WHEN k % 10 <> 5 THEN now_hash END END AS left_hash,
               CASE WHEN open AND "on" = 'right' THEN now_uri END AS left_uri, CASE WHEN open THEN now_hash END AS right_hash, coalesce(open AND now_hash IS NOT NULL AND "on" = 'left' AND k % 10 = 5, false) AS stripped
        FROM (SELECT *, op <> 'update' AS copies, op <> 'update' AND available AND (now_hash IS NULL OR has_bytes) AS open FROM (
          SELECT *, CASE WHEN k % 17 = 0 THEN 'update' WHEN k % 19 = 0 THEN 'copy_group' ELSE 'create' END AS op, CASE side WHEN 'left' THEN 'right' ELSE 'left' END AS "on" FROM ({_CURRENT})))""",
    "photo_blocked": """
        SELECT o_orderkey AS uid, '/l/' || o_orderkey AS href, CASE WHEN o_orderkey % 5 = 0 THEN 'too_large' ELSE 'transient' END AS reason FROM orders WHERE o_orderkey % 6 = 1 AND o_orderkey % 4 <> 0""",
    "photo_recorded": """
        SELECT 'left' AS side, vec_id AS uid, 'l' || vec_id AS now_hash, CASE WHEN vec_id % 4 = 0 THEN 'u' || vec_id END AS now_uri, false AS has_bytes FROM embeddings WHERE vec_id % 3 <> 0
        UNION ALL SELECT 'right', vec_id, 'r' || vec_id, NULL, false FROM embeddings WHERE vec_id % 5 <> 0""",
    "hex_hashes": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 IN (0, 3) THEN sha256(o_orderkey::VARCHAR) END AS hash FROM orders",
    "row_decode": "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'side' WHEN o_orderkey % 5 = 0 THEN 'op' WHEN o_orderkey % 3 = 0 THEN 'attempts' END AS corrupt FROM orders",
    "token_set": """
        SELECT side, CASE WHEN here THEN version + (wanted AND new IS DISTINCT FROM token)::INT END AS version, CASE WHEN wanted AND here THEN new ELSE token END AS token,
               CASE WHEN wanted THEN CASE WHEN NOT here THEN 'not_found' WHEN new IS NOT DISTINCT FROM token THEN 'unchanged' ELSE 'written' END END AS outcome
        FROM (SELECT c_custkey AS side, c_custkey % 4 <> 0 AS here, c_custkey % 2 = 0 AS wanted, c_custkey % 3 AS version, CASE WHEN c_custkey % 4 <> 0 AND c_custkey % 5 <> 0 THEN 't' END AS token,
                     CASE WHEN c_custkey % 6 = 0 THEN 't' ELSE 'n' END AS new FROM customer) WHERE here OR wanted""",
    "rows_deleted": """
        WITH a AS (SELECT c_custkey * 3 AS uid FROM customer), n AS (SELECT o_custkey AS uid, count(*) AS n FROM orders GROUP BY 1)
        SELECT uid, CASE WHEN a.uid IS NULL THEN n END AS kept, CASE WHEN a.uid IS NOT NULL THEN n IS NOT NULL END AS found FROM a FULL JOIN n USING (uid)""",
    "photo_fit": """
        SELECT o_orderkey, o_orderkey % 1000 + e + ceil(e / 74) * 3 + 40 <= 280000 AS fits FROM (SELECT o_orderkey, ceil((o_orderkey * 37 % 300000) / 3) * 4 AS e FROM orders)""",
    "status_class": """
        SELECT k AS o_orderkey, class, class IN ('transient', 'rate_limited', 'unauthorized') AS fatal, CASE class WHEN 'permanent' THEN 'rejected' ELSE class END AS reason FROM (
          SELECT o_orderkey AS k, CASE WHEN c = 401 THEN 'unauthorized' WHEN c = 412 THEN 'precondition_failed' WHEN c IN (429, 503) THEN 'rate_limited' WHEN c BETWEEN 500 AND 599 THEN 'transient' ELSE 'permanent' END AS class
          FROM (SELECT o_orderkey, 200 + o_orderkey % 400 AS c FROM orders))""",
    "retry_after": """
        SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN least(3600, o_orderkey * 7 % 5000) WHEN 1 THEN -1 WHEN 2 THEN 3600 ELSE o_orderkey % 60 END::BIGINT AS wait_s FROM orders""",
    "collection_pick": """
        SELECT principal, ord, path FROM (
          SELECT c_nationkey AS principal, c_custkey AS ord, '/book/' || (c_custkey % 40) AS path, row_number() OVER (PARTITION BY c_nationkey ORDER BY (c_custkey % 40 <> 7)::INT, c_custkey) AS n FROM customer) WHERE n = 1""",
    "mint_href": "SELECT c_custkey, '/dav/book/' || left(sha256(c_name), 32) || '.vcf' AS href FROM customer",
    "dump_sorted": """
        SELECT (row_number() OVER (ORDER BY c_name)) - 1 AS ord, '{"href":"' || c_name || '","etag":"e' || c_custkey || '","vcard":"FN:' || c_name || '"}' AS card FROM customer""",
    "text_forms": r"""
        SELECT doc_id, md5(replace(text, 'a', chr(10))) AS unescaped, md5(replace(text, 'e', '\n')) AS canonical, md5(replace(text, chr(10), chr(13) || chr(10))) AS crlf,
               md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;')) AS escaped,
               CASE WHEN regexp_replace(text, '[^0-9]', '', 'g') <> '' THEN CASE WHEN text LIKE '+%' THEN '+' ELSE '' END || regexp_replace(text, '[^0-9]', '', 'g') END AS phone,
               contains(text, '@') AS contact_point FROM documents""",
    "canonical_dates": """
    SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y%m%d') WHEN 1 THEN '--' || strftime(o_orderdate, '%m%d') ELSE strftime(o_orderdate, '%Y%m%dT%H%M%SZ') END AS date,
           CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN '--' || strftime(o_orderdate, '%m-%d') ELSE '"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') || '"' END AS quoted FROM orders""",
    "canonical_hash": """
        SELECT c_custkey, c_custkey::VARCHAR AS uid, sha256('CANONICAL:2' || chr(10) || 'BDAY:19800401' || chr(10) || 'BEGIN:VCARD' || chr(10) || 'END:VCARD' || chr(10) || 'FN:' || c_name || chr(10)
               || 'G1.TEL;TYPE=CELL,VOICE:+' || c_custkey || chr(10) || 'G1.X-ABLABEL:b' || chr(10) || 'UID:' || c_custkey || chr(10) || 'VERSION:3.0' || chr(10)) AS hash, '+' || c_custkey AS phone FROM customer""",
}


def _photo_merge_sql(rows: str, more: str = "") -> str:
    """The merge of photo actions la and ra into plan *rows* with known, lf and rf (whether a side was read)."""
    return f"""
SELECT {more} uid, CASE WHEN dest IS NULL THEN op WHEN NOT blind THEN 'update' END AS op, coalesce(dest, "on") AS "on", CASE WHEN blind THEN 'unread_target' ELSE diag END AS diag,
       CASE WHEN writes THEN CASE "on" WHEN 'left' THEN la ELSE ra END WHEN op = 'resurrect' AND known THEN 'copy' WHEN dest IS NOT NULL AND NOT blind THEN CASE dest WHEN 'left' THEN la ELSE ra END END AS photo_action,
       CASE WHEN writes AND "on" = 'left' AND ra <> 'keep' AND rf THEN 'right' WHEN writes AND "on" = 'right' AND la <> 'keep' AND lf THEN 'left' END AS counter_side,
       CASE WHEN writes AND "on" = 'left' AND ra <> 'keep' AND rf THEN ra WHEN writes AND "on" = 'right' AND la <> 'keep' AND lf THEN la END AS counter_action
FROM (SELECT *, CASE dest WHEN 'left' THEN NOT lf WHEN 'right' THEN NOT rf END AS blind FROM (
  SELECT *, known AND op IN ('update', 'conflict') AS writes,
         CASE WHEN known AND (op IS NULL OR op = 'refresh') AND diag IS NULL AND 'deleted' NOT IN (left_status, right_status) THEN CASE WHEN la <> 'keep' THEN 'left' WHEN ra <> 'keep' THEN 'right' END END AS dest
  FROM ({rows})))
"""


def _photo_merge_rows() -> str:
    from pairwright.plans import merge

    return f"""SELECT *, uid % 3 <> 0 OR 'unchanged' NOT IN (left_status, right_status) AS known, CASE uid % 5 WHEN 0 THEN 'set' WHEN 1 THEN 'remove' ELSE 'keep' END AS la,
               CASE WHEN uid % 7 = 0 THEN 'set' ELSE 'keep' END AS ra, left_status IN ('same', 'changed') AS lf, right_status IN ('same', 'changed') AS rf FROM ({merge.ORACLE["three_way_matrix"]})"""


def _cycle_photos_sql() -> str:
    from pairwright.plans import merge

    rows = f"""
SELECT *, CASE WHEN fine AND to_l THEN CASE WHEN rh IS NULL THEN 'remove' WHEN rb THEN 'set' ELSE 'keep' END ELSE 'keep' END AS la,
       CASE WHEN fine AND to_r THEN CASE WHEN lh IS NULL THEN 'remove' WHEN lb THEN 'set' ELSE 'keep' END ELSE 'keep' END AS ra FROM (
  SELECT *, CASE WHEN tracked THEN rh IS DISTINCT FROM rrec AND lh IS NOT DISTINCT FROM lrec ELSE rh IS NOT NULL AND lh IS NULL END AS to_l,
         CASE WHEN tracked THEN lh IS DISTINCT FROM lrec AND (rh IS NOT DISTINCT FROM rrec OR lh IS DISTINCT FROM rh) ELSE lh IS NOT NULL AND rh IS NULL END AS to_r FROM (
    SELECT *, CASE WHEN lf THEN CASE WHEN uid % 6 <> 0 THEN 'p' || uid // 4 % 3 END WHEN left_status = 'unchanged' THEN lrec END AS lh, lf AND uid % 6 <> 0 AND uid % 11 <> 0 AS lb,
           CASE WHEN rf THEN CASE WHEN uid % 8 <> 0 THEN 'p' || uid // 5 % 3 END WHEN right_status = 'unchanged' THEN rrec END AS rh, rf AND uid % 8 <> 0 AND uid % 9 <> 0 AS rb,
           NOT (lf AND uid % 6 <> 0 AND uid % 13 = 0 OR rf AND uid % 8 <> 0 AND uid % 14 = 0) AS fine, tracked OR 'unchanged' NOT IN (left_status, right_status) AS known FROM (
      SELECT *, uid % 4 <> 0 AND uid % 3 <> 0 AS tracked, CASE WHEN uid % 4 <> 0 AND uid % 5 <> 0 THEN 'p' || uid // 2 % 3 END AS lrec, CASE WHEN uid % 4 <> 0 AND uid % 7 <> 0 THEN 'p' || uid // 3 % 3 END AS rrec,
             left_status IN ('same', 'changed') AS lf, right_status IN ('same', 'changed') AS rf FROM ({merge.ORACLE["three_way_matrix"]}))))"""
    return f"""
SELECT uid, op, "on", diag, CASE WHEN fine THEN photo_action END AS action, counter_side, counter_action,
       fine AND known AND coalesce(op, 'refresh') IN ('refresh', 'update', 'conflict') AND diag IS NULL AND 'deleted' NOT IN (left_status, right_status) AS open
FROM ({_photo_merge_sql(rows, "fine, known, left_status, right_status,")})"""


ORACLE["cycle_photos"] = _cycle_photos_sql()
ORACLE["photo_merge"] = _photo_merge_sql(_photo_merge_rows())
