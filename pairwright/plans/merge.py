"""Queries over change capture, classification and the three-way merge, on inputs derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.operators import cdc, classify, guards, merge3, report
from pairwright.sources.tables import table


def _cells(spark, sf_dir: str) -> DataFrame:
    """Customers in the 16 cells of both sides' statuses, by key."""
    k = F.col("c_custkey")
    pick = lambda n: F.element_at(F.array(*[F.lit(s) for s in merge3.STATUSES]), (n + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(
        k.alias("uid"),
        F.col("c_nationkey").alias("book"),
        pick(k % 4).alias("left_status"),
        pick(F.expr("c_custkey div 4") % 4).alias("right_status"),
        F.concat(F.lit("h"), (F.expr("c_custkey div 16") % 3)).alias("left_hash"),
        F.concat(F.lit("h"), (F.expr("c_custkey div 16") % 2)).alias("right_hash"),
        (k % 5 == 0).alias("hash_stale"),
    )


_CELLS = """
SELECT c_custkey AS uid, c_nationkey AS book,
       (['unchanged', 'same', 'changed', 'deleted'])[c_custkey % 4 + 1] AS left_status,
       (['unchanged', 'same', 'changed', 'deleted'])[c_custkey // 4 % 4 + 1] AS right_status,
       'h' || (c_custkey // 16 % 3) AS left_hash, 'h' || (c_custkey // 16 % 2) AS right_hash, c_custkey % 5 = 0 AS hash_stale
FROM customer
"""


def _plan_sql(winner: str) -> str:
    loser = "right" if winner == "left" else "left"
    return f"""
SELECT *, CASE WHEN op = 'conflict' THEN '{winner}' END AS winner FROM (
  SELECT *,
    CASE WHEN eq OR stale THEN 'refresh' WHEN both_changed THEN 'conflict'
         WHEN left_status = 'deleted' AND right_status = 'deleted' THEN 'forget'
         WHEN left_status = 'deleted' THEN CASE right_status WHEN 'changed' THEN 'resurrect' ELSE 'delete' END
         WHEN right_status = 'deleted' THEN CASE left_status WHEN 'changed' THEN 'resurrect' ELSE 'delete' END
         WHEN 'changed' IN (left_status, right_status) THEN CASE WHEN 'same' IN (left_status, right_status) THEN 'update' END
         WHEN 'same' IN (left_status, right_status) THEN 'refresh' END AS op,
    CASE WHEN eq THEN 'both' WHEN both_changed THEN '{loser}'
         WHEN left_status = 'deleted' AND right_status = 'deleted' THEN NULL
         WHEN left_status = 'deleted' THEN CASE right_status WHEN 'changed' THEN 'left' ELSE 'right' END
         WHEN right_status = 'deleted' THEN CASE left_status WHEN 'changed' THEN 'right' ELSE 'left' END
         WHEN left_status = 'same' AND right_status = 'same' THEN 'both'
         WHEN left_status = 'changed' THEN 'right' WHEN right_status = 'changed' THEN 'left'
         WHEN left_status = 'same' THEN 'left' WHEN right_status = 'same' THEN 'right' END AS "on",
    eq OR stale OR both_changed OR ('changed' IN (left_status, right_status) AND ('same' IN (left_status, right_status) OR 'deleted' IN (left_status, right_status))) AS content,
    CASE WHEN 'changed' IN (left_status, right_status) AND 'unchanged' IN (left_status, right_status) THEN 'unread_target' END AS diag
  FROM (SELECT *, left_status = 'changed' AND right_status = 'changed' AS both_changed,
               left_status = 'changed' AND right_status = 'changed' AND left_hash = right_hash AS eq,
               left_status = 'unchanged' AND right_status = 'unchanged' AND hash_stale AS stale FROM ({_CELLS})))
"""


def _plan(spark, sf_dir, winner="left"):
    return merge3.decide(_cells(spark, sf_dir), winner)


def three_way_matrix(spark, sf_dir):
    return _plan(spark, sf_dir).select("uid", "left_status", "right_status", "op", "on", "content", "winner", "diag")


def conflict_winner(spark, sf_dir):
    return _plan(spark, sf_dir, "right").filter("op = 'conflict'").select("uid", "on", "winner", "left_hash", "right_hash")


def mass_delete_guard(spark, sf_dir):
    return guards.mass_deletions(_plan(spark, sf_dir), ["book"])


def deferral(spark, sf_dir):
    out = classify.defer(_plan(spark, sf_dir), True, False)
    return out.select("uid", "op", F.array_join("deferred", ",").alias("deferred"))


def cycle_summary(spark, sf_dir):
    ops = _plan(spark, sf_dir).filter("op IS NOT NULL").withColumns({"put_left": F.lit(False), "counter_side": F.when(F.col("uid") % 7 == 0, "left").when(F.col("uid") % 11 == 0, "right")})
    return report.summary(ops)


def _absent(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("uid"), "text")
    left = d.filter("uid % 3 <> 2").select("uid", F.md5(F.col("text").cast("binary")).alias("hash"))
    right = d.filter("uid % 3 <> 1").select("uid", F.md5(F.when(F.col("uid") % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit("."))).cast("binary")).alias("hash"))
    return left, right


_ABSENT = """
WITH l AS (SELECT doc_id AS uid, md5(text) AS lh FROM documents WHERE doc_id % 3 <> 2),
     r AS (SELECT doc_id AS uid, md5(CASE WHEN doc_id % 2 = 0 THEN text ELSE text || '.' END) AS rh FROM documents WHERE doc_id % 3 <> 1)
"""


def absent_state(spark, sf_dir):
    return merge3.absent_state(*_absent(spark, sf_dir))


def report_sections(spark, sf_dir):
    ops = absent_state(spark, sf_dir).select(F.col("uid").alias("seq"), F.col("uid").cast("string").alias("uid"), "op", "on", "origin", F.lit(None).cast("string").alias("pass"))
    return report.sections(ops)


def side_status(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uid"), F.col("o_custkey").cast("string").alias("stored_hash"))
    side = lambda gone, cut_at, extra: o.filter(f"uid % {gone} <> 0").select(
        "uid", F.when(F.col("uid") % cut_at == 0, "unchanged").otherwise("fetched").alias("kind"), F.when(F.col("uid") % extra == 0, F.concat("stored_hash", F.lit("x"))).otherwise(F.col("stored_hash")).alias("hash")
    )
    return merge3.statuses(o, side(7, 3, 4), side(5, 2, 6)).select("uid", "left_status", "right_status")


def changes_latest_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    pages = e.select(
        F.col("user_id").alias("href"),
        F.dayofyear("ts").alias("page"),
        F.col("event_id").alias("ord"),
        F.when(F.col("event_id") % 5 == 0, 404).otherwise(200).alias("status"),
        F.when(~(F.col("event_id") % 9).isin(0, 3, 4), F.concat("event_type", F.lit("-"), F.col("event_id"))).alias("etag"),  # a third are no observation
    )
    return cdc.latest_changes(pages)


def etag_listing(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return cdc.etag_listing(o.select(F.col("o_custkey").alias("href"), F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") % 13 == 0).alias("is_collection"), F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("e"), "o_orderkey")).alias("etag")))


def fetch_list(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    etag = lambda m: F.concat(F.lit("e"), F.col("k"), F.when(F.col("k") % m == 0, "x").otherwise(""))
    listing = None
    for s, gone, m in (("left", 7, 5), ("right", 11, 3)):
        part = c.filter(f"k % {gone} <> 0").select(F.lit(s).alias("side"), F.concat(F.lit(s[0]), F.col("k")).alias("href"), etag(m).alias("etag"))
        listing = part if listing is None else listing.unionByName(part)
    e = F.concat(F.lit("e"), F.col("k"))
    state = c.select(F.col("k").alias("id"), F.concat(F.lit("l"), "k").alias("left_href"), e.alias("left_etag"), F.concat(F.lit("r"), "k").alias("right_href"), e.alias("right_etag"), (F.col("k") % 13 != 0).alias("photo_tracked"))
    return cdc.fetch_lists(listing, state)


def held_groups(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    due = cdc.due(F.expr("timestamp_ntz'2024-01-20 00:00:00'"), F.col("ts"), F.col("event_type"), F.when(F.col("event_id") % 40 != 0, F.col("event_type")))
    return cdc.held(e.select(F.col("event_id").alias("key"), F.when(F.col("event_id") % 17 != 0, F.concat("user_id", F.lit("-"), F.expr("event_id div 100"))).alias("uid"), due.alias("due"))).select("key", "due", "held")


def snapshot_build(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("href"), F.concat(F.lit("e"), F.col("o_orderkey")).alias("etag"))
    answers = o.filter("href % 6 <> 0").select("href", F.concat("etag", F.lit("n")).alias("etag"), F.concat(F.lit("body"), "href").alias("body"))
    return cdc.build_snapshot(o, o.filter("href % 11 = 0"), o.filter("href % 4 = 0 OR href % 6 = 0"), answers)


def multiget_match(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("href"))
    asked = o.select("href", F.col("href").alias("ord"))
    code = F.element_at(F.array(*[F.lit(x) for x in (200, 200, 404, 410, 500, 403, 207)]), (F.col("href") % 7 + 1).cast("int"))
    got = o.filter("href % 9 <> 0").select("href", code.alias("status"), F.when(F.col("href") % 10 != 0, "e").alias("etag"), F.lit("b").alias("body"))
    return cdc.match_answers(asked, got)


def _entries(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    kind = F.when(k % 11 == 0, "held").when(k % 13 == 0, "unreadable").when(k % 3 == 0, "unchanged").otherwise("fetched")
    entries = o.select(k.alias("href"), kind.alias("kind"), F.when(kind == "fetched", F.when(k % 10 == 0, k + 1).otherwise(k)).alias("uid"))
    return entries, o.filter("o_orderkey % 7 <> 0").select(k.alias("href"), k.alias("uid"))


_ENTRIES = """
WITH e AS (
  SELECT href, kind, CASE WHEN kind = 'fetched' THEN CASE WHEN href % 10 = 0 THEN href + 1 ELSE href END END AS uid
  FROM (SELECT o_orderkey AS href, CASE WHEN o_orderkey % 11 = 0 THEN 'held' WHEN o_orderkey % 13 = 0 THEN 'unreadable' WHEN o_orderkey % 3 = 0 THEN 'unchanged' ELSE 'fetched' END AS kind FROM orders)
), s AS (SELECT o_orderkey AS href, o_orderkey AS uid FROM orders WHERE o_orderkey % 7 <> 0),
c AS (
  SELECT e.href, e.kind, e.uid, s.uid AS state_uid, coalesce(e.kind = 'fetched' AND s.uid IS NOT NULL AND e.uid <> s.uid, false) AS moved FROM e LEFT JOIN s USING (href)
), a AS (
  SELECT *, CASE WHEN moved THEN NULL WHEN kind = 'fetched' THEN uid WHEN kind = 'unchanged' THEN state_uid END AS appears_as,
         CASE WHEN kind IN ('held', 'unreadable') AND state_uid IS NOT NULL THEN [state_uid] WHEN moved THEN [state_uid, uid] ELSE [] END AS holds,
         state_uid IS NULL AND kind IN ('held', 'unreadable', 'unchanged') AS uncertain, CASE WHEN moved THEN 'uid_changed' END AS diag FROM c
)
"""


def _classified(spark, sf_dir):
    entries, state = _entries(spark, sf_dir)
    out = entries.withColumn("uid", F.col("uid").cast("string"))
    return classify.classify(out, state.withColumn("uid", F.col("uid").cast("string"))), state.withColumn("uid", F.col("uid").cast("string"))


def classify_side(spark, sf_dir):
    return _classified(spark, sf_dir)[0].select("href", "kind", "appears_as", F.array_join("holds", ",").alias("holds"), "uncertain", "diag")


def resolve_uids(spark, sf_dir):
    out = classify.resolve(*_classified(spark, sf_dir))
    return out.withColumn("href", F.col("href").cast("string"))


def uncertain_side(spark, sf_dir):
    return classify.uncertain(_classified(spark, sf_dir)[0])


def known_cards(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    fetched = o.select(F.col("o_custkey").alias("uid"), F.col("o_orderpriority").alias("name"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("href"))
    state = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("uid"), F.col("c_name").alias("name"))
    return classify.known_cards(fetched, state)


def cross_delete_hold(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        k.alias("seq"),
        F.when(k % 2 == 0, "left").otherwise("right").alias("on"),
        F.when(k % 6 != 0, F.concat(F.lit("n"), F.expr("c_custkey div 3"))).alias("name"),
        F.when(k % 4 != 0, F.array(F.concat(F.lit("p:"), F.expr("c_custkey div 5")))).otherwise(F.expr("cast(array() as array<string>)")).alias("tokens"),
        F.when(k % 3 != 0, F.concat(F.lit("o"), F.expr("c_custkey div 16"))).alias("org"),
    )
    return guards.cross_deletes(rows)


QUERIES = {
    f.__name__: f
    for f in (
        three_way_matrix, conflict_winner, mass_delete_guard, deferral, cycle_summary, absent_state, report_sections, side_status, changes_latest_wins, etag_listing, fetch_list,
        held_groups, snapshot_build, multiget_match, classify_side, resolve_uids, uncertain_side, known_cards, cross_delete_hold,
    )
}

_P, _PR = _plan_sql("left"), _plan_sql("right")
_SUM = "count(*) FILTER (WHERE {})::BIGINT"
ORACLE = {
    "three_way_matrix": f'SELECT uid, left_status, right_status, op, "on", content, winner, diag FROM ({_P})',
    "conflict_winner": f"""SELECT uid, "on", winner, left_hash, right_hash FROM ({_PR}) WHERE op = 'conflict'""",
    "mass_delete_guard": f"""
        SELECT book, records, lim AS "limit", side, deletes, deletes > lim AS blocked FROM (
          SELECT book, count(*) AS records, greatest(10, count(*) * 20 // 100) AS lim,
                 count(*) FILTER (WHERE op = 'forget' OR op = 'delete' AND "on" = 'left') AS l, count(*) FILTER (WHERE op = 'forget' OR op = 'delete' AND "on" = 'right') AS r FROM ({_P}) GROUP BY book
        ), LATERAL (SELECT unnest(['left', 'right']) AS side, unnest([l, r]) AS deletes)""",
    "deferral": f"""SELECT uid, CASE WHEN left_status <> 'deleted' THEN op END AS op, CASE WHEN left_status = 'deleted' THEN 'left' ELSE '' END AS deferred FROM ({_P})""",
    "cycle_summary": f"""
        SELECT {", ".join(f'''
          {_SUM.format(f"op = 'resurrect' AND " + '"on"' + f" = '{s}'")} AS {s}_added,
          {_SUM.format(f"op = 'update' AND " + '"on"' + f" = '{s}'")} + {_SUM.format(f"counter = '{s}'")} AS {s}_updated,
          {_SUM.format(f"op = 'delete' AND " + '"on"' + f" = '{s}'")} AS {s}_removed,
          {_SUM.format(f"op = 'conflict' AND " + '"on"' + f" = '{s}'")} AS {s}_conflicts''' for s in ("left", "right"))},
          0::BIGINT AS adopted, {_SUM.format("op = 'refresh'")} AS refreshed, {_SUM.format("op = 'forget'")} AS forgotten
        FROM (SELECT *, CASE WHEN uid % 7 = 0 THEN 'left' WHEN uid % 11 = 0 THEN 'right' END AS counter FROM ({_P}) WHERE op IS NOT NULL)""",
    "absent_state": f"""{_ABSENT}
        SELECT uid, CASE WHEN lh IS NULL OR rh IS NULL THEN 'create' WHEN lh = rh THEN 'adopt' ELSE 'conflict' END AS op,
               CASE WHEN rh IS NULL THEN 'right' WHEN lh IS NULL THEN 'left' WHEN lh <> rh THEN 'right' END AS "on", CASE WHEN lh <> rh THEN 'baseline' END AS origin
        FROM l FULL JOIN r USING (uid)""",
    "report_sections": f"""{_ABSENT}
        SELECT CASE WHEN lh IS NULL OR rh IS NULL THEN 'copies' WHEN lh = rh THEN 'in_sync' ELSE 'conflicts' END AS section, uid AS seq,
               'uid=' || uid || CASE WHEN rh IS NULL THEN ' to right' WHEN lh IS NULL THEN ' to left' ELSE '' END AS line FROM l FULL JOIN r USING (uid)""",
    "side_status": """
        SELECT o_orderkey AS uid,
               CASE WHEN o_orderkey % 7 = 0 THEN 'deleted' WHEN o_orderkey % 3 = 0 THEN 'unchanged' WHEN o_orderkey % 4 = 0 THEN 'changed' ELSE 'same' END AS left_status,
               CASE WHEN o_orderkey % 5 = 0 THEN 'deleted' WHEN o_orderkey % 2 = 0 THEN 'unchanged' WHEN o_orderkey % 6 = 0 THEN 'changed' ELSE 'same' END AS right_status FROM orders""",
    "changes_latest_wins": """
        SELECT href, kind, CASE WHEN kind = 'changed' THEN etag END AS etag FROM (
          SELECT user_id AS href, CASE WHEN event_id % 5 = 0 THEN 'removed' ELSE 'changed' END AS kind, event_type || '-' || event_id AS etag,
                 row_number() OVER (PARTITION BY user_id ORDER BY dayofyear(ts) DESC, event_id DESC) AS n FROM events
          WHERE event_id % 5 = 0 OR event_id % 9 NOT IN (0, 3, 4)) WHERE n = 1""",
    "etag_listing": """
        SELECT o_custkey AS href, 'e' || max(o_orderkey) AS etag FROM orders WHERE o_orderkey % 13 <> 0 AND o_orderkey % 5 <> 0 GROUP BY 1""",
    "fetch_list": """
        WITH k AS (SELECT c_custkey AS k, c_custkey % 7 <> 0 AS ll, c_custkey % 11 <> 0 AS rl, c_custkey % 13 = 0 AS untracked FROM customer),
             f AS (SELECT *, ll AND k % 5 = 0 AS lc, rl AND k % 3 = 0 AS rc FROM k)
        SELECT 'left' AS side, 'l' || k AS href, CASE WHEN lc THEN 'changed' ELSE 'paired' END AS why FROM f WHERE lc OR (ll AND (rc OR NOT rl OR untracked))
        UNION ALL SELECT 'right', 'r' || k, CASE WHEN rc THEN 'changed' ELSE 'paired' END FROM f WHERE rc OR (rl AND (lc OR NOT ll OR untracked))""",
    "held_groups": """
        SELECT key, due, NOT bool_and(due) OVER (PARTITION BY grp) AS held FROM (
          SELECT event_id AS key, ts <= TIMESTAMP '2024-01-20 00:00:00' OR event_id % 40 = 0 AS due,
                 CASE WHEN event_id % 17 <> 0 THEN 'u' || user_id || '-' || (event_id // 100) ELSE 'k' || event_id END AS grp FROM events)""",
    "snapshot_build": """
        SELECT o_orderkey AS href, CASE WHEN kind = 'fetched' THEN 'e' || o_orderkey || 'n' ELSE 'e' || o_orderkey END AS etag, kind, CASE WHEN kind = 'fetched' THEN 'body' || o_orderkey END AS body
        FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'held' WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN 'fetched' ELSE 'unchanged' END AS kind FROM orders) WHERE kind IS NOT NULL""",
    "multiget_match": """
        SELECT o_orderkey AS href, CASE WHEN o_orderkey % 9 = 0 OR c IN (404, 410) THEN 'missing' WHEN c BETWEEN 200 AND 299 THEN CASE WHEN o_orderkey % 10 = 0 THEN 'permanent' ELSE 'found' END
               WHEN c >= 500 THEN 'transient' ELSE 'permanent' END AS outcome, o_orderkey // 50 AS batch
        FROM (SELECT o_orderkey, ([200, 200, 404, 410, 500, 403, 207])[o_orderkey % 7 + 1] AS c FROM orders)""",
    "classify_side": f"""{_ENTRIES} SELECT href, kind, appears_as::VARCHAR AS appears_as, array_to_string(holds, ',') AS holds, uncertain, diag FROM a""",
    "resolve_uids": f"""{_ENTRIES}, h AS (SELECT DISTINCT unnest(holds) AS uid FROM a), v AS (
          SELECT appears_as AS uid, count(*) AS n, min(href) AS href FROM a WHERE appears_as IS NOT NULL AND appears_as NOT IN (SELECT uid FROM h) GROUP BY 1)
        SELECT uid::VARCHAR AS uid, n, CASE WHEN n = 1 THEN href::VARCHAR END AS href, CASE WHEN n > 1 THEN 'duplicate' WHEN uid IN (SELECT uid FROM s) THEN 'tracked' ELSE 'unsynced' END AS outcome FROM v""",
    "uncertain_side": f"""{_ENTRIES} SELECT bool_or(uncertain) AS uncertain FROM a""",
    "known_cards": """
        SELECT uid, name, from_state FROM (
          SELECT *, row_number() OVER (PARTITION BY uid ORDER BY from_state, href) AS n FROM (
            SELECT o_custkey AS uid, o_orderpriority AS name, lpad(o_orderkey::VARCHAR, 12, '0') AS href, 0 AS from_state FROM orders
            UNION ALL SELECT c_custkey, c_name, '', 1 FROM customer)) WHERE n = 1""",
    "cross_delete_hold": """
        WITH d AS (SELECT c_custkey AS seq, c_custkey % 2 AS s, CASE WHEN c_custkey % 6 <> 0 THEN c_custkey // 3 END AS name, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey // 5 END AS tok,
                          CASE WHEN c_custkey % 3 <> 0 THEN c_custkey // 16 END AS org FROM customer)
        SELECT a.seq, min(b.seq) AS partner FROM d a JOIN d b ON a.s <> b.s AND (a.name = b.name OR a.tok = b.tok OR (a.tok IS NULL AND b.tok IS NULL AND a.org = b.org)) GROUP BY a.seq""",
}
