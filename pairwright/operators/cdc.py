"""Change capture: listings, deltas, fetch lists, held groups and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


MAX_PAGES = 100


def latest_changes(pages: DataFrame) -> DataFrame:
    """Merge delta pages (page, ord, href, status, etag) to one row per href: the latest observation wins.

    404 is a removal; a member without an etag that is not a removal is no observation, so what came before it stays.
    One aggregation, combined map-side.
    """
    kind = F.when(F.col("status") == 404, "removed").when(F.col("etag").isNotNull(), "changed")
    seen = pages.withColumn("kind", kind).filter("kind IS NOT NULL")
    last = seen.groupBy("href").agg(F.max_by(F.struct("kind", "etag"), F.struct("page", "ord")).alias("x"))
    return last.select("href", "x.kind", F.when(F.col("x.kind") == "changed", F.col("x.etag")).alias("etag"))


def members(rows: DataFrame, collection: str) -> DataFrame:
    """Listed members: without the collection itself and without subcollections, whose paths end in a slash."""
    return rows.filter((F.regexp_replace("href", "/+$", "") != collection.rstrip("/")) & ~F.col("href").endswith("/"))


def delta_pages(pages: DataFrame, collection: str, limit: int = MAX_PAGES) -> DataFrame:
    """Whether a delta is complete, as one row (pages, complete, token, error), from all rows of its pages (page, ord,
    href, status, etag, token).

    507 on the collection says that another page follows, from that page's token on; a page without a token, or more
    than *limit* pages, is permanent.
    """
    own = F.regexp_replace("href", "/+$", "") == collection.rstrip("/")
    per = pages.groupBy("page").agg(F.max("token").alias("token"), F.coalesce(F.max(own & (F.col("status") == 507)), F.lit(False)).alias("more"))
    out = per.agg(F.count(F.lit(1)).alias("pages"), F.max_by("token", "page").alias("token"), F.max_by("more", "page").alias("more"), F.max(F.col("token").isNull()).alias("blind"))
    error = F.when(F.col("blind"), "permanent").when(F.col("more") & (F.col("pages") >= limit), "permanent")
    return out.select("pages", (~F.coalesce("more", F.lit(True)) & error.isNull()).alias("complete"), F.when(error.isNull(), F.col("token")).alias("token"), error.alias("error"))


def token_rejected(status: Column, body: Column, sent: Column) -> Column:
    """400, 403 or 409 with the valid-sync-token precondition, where a token was sent at all."""
    return F.coalesce(sent & status.isin(400, 403, 409) & F.coalesce(body, F.lit("")).rlike("<([A-Za-z0-9_-]+:)?valid-sync-token[\\s/>]"), F.lit(False))


def choose_listing(endpoints: DataFrame) -> DataFrame:
    """How to list each side of (side, supports_sync, token, rejected): 'delta' from its token, 'full' (a delta without a
    token) or 'etags'. A rejected token starts over without one; a rejection without a token is permanent."""
    how = F.when(~F.col("supports_sync"), "etags").when(F.col("token").isNull() & F.col("rejected"), "permanent").when(F.col("token").isNull() | F.col("rejected"), "full").otherwise("delta")
    return endpoints.select("side", how.alias("listing"))


def etag_listing(members: DataFrame) -> DataFrame:
    """(href, etag) of a full listing: no collections, no members without etag, one row per href."""
    return members.filter("NOT is_collection AND etag IS NOT NULL").groupBy("href").agg(F.max_by("etag", "ord").alias("etag"))


def changed(listing: DataFrame, state: DataFrame) -> DataFrame:
    """Listed rows (href, etag, ...) that the state doesn't have under the same etag."""
    return listing.join(state.select("href", "etag"), ["href", "etag"], "left_anti")


def fetch_lists(listing: DataFrame, state: DataFrame) -> DataFrame:
    """What to read: (side, href, why).

    *listing* is (side, href, etag); *state* is (id, left_href, left_etag, right_href, right_etag, photo_tracked). A row
    whose other side was touched, or whose photo is untracked, is read on this side too where it is listed. Both rest
    on the first lists only, so nothing cascades.
    """
    sides = ("left", "right")
    per_side = None
    first: dict[str, DataFrame] = {}
    for s in sides:
        listed = listing.filter(F.col("side") == s).select("href", "etag")
        first[s] = changed(listed, state.select(F.col(f"{s}_href").alias("href"), F.col(f"{s}_etag").alias("etag"))).select("href")
    rows = state
    for s in sides:
        listed = listing.filter(F.col("side") == s).select(F.col("href").alias(f"{s}_href"), F.lit(True).alias(f"{s}_listed"))
        touched = first[s].select(F.col("href").alias(f"{s}_href"), F.lit(True).alias(f"{s}_first"))
        rows = rows.join(listed, f"{s}_href", "left").join(touched, f"{s}_href", "left")
    for s, o in (sides, sides[::-1]):
        other_touched = F.coalesce(F.col(f"{o}_first"), F.lit(False)) | F.col(f"{o}_listed").isNull()
        more = rows.filter(F.col(f"{s}_listed") & F.col(f"{s}_first").isNull() & (other_touched | ~F.col("photo_tracked")))
        both = first[s].select(F.lit(s).alias("side"), "href", F.lit("changed").alias("why")).unionByName(more.select(F.lit(s).alias("side"), F.col(f"{s}_href").alias("href"), F.lit("paired").alias("why")))
        per_side = both if per_side is None else per_side.unionByName(both)
    return per_side


def due(now: Column, next_retry: Column, listed_etag: Column, stored_etag: Column) -> Column:
    """A failure may be tried again: its time has come or the record has changed since."""
    return (now >= next_retry) | ~listed_etag.eqNullSafe(stored_etag)


def held(failures: DataFrame) -> DataFrame:
    """Failures that hold their record back: all of a uid's rows are held unless all are due; without a uid a row stands
    alone. Input: (key, uid, due), key unique."""
    group = F.coalesce(F.concat(F.lit("u:"), F.col("uid").cast("string")), F.concat(F.lit("k:"), F.col("key").cast("string")))
    return failures.withColumn("held", ~F.min("due").over(W.partitionBy(group)))


def build_snapshot(listing: DataFrame, held_hrefs: DataFrame, wanted: DataFrame, answers: DataFrame) -> DataFrame:
    """Complete membership: held, fetched or unchanged; wanted rows that the server no longer has are left out."""
    out = listing.join(held_hrefs.select("href", F.lit(True).alias("h")).distinct(), "href", "left")
    out = out.join(wanted.select("href", F.lit(True).alias("w")).distinct(), "href", "left")
    out = out.join(answers.select("href", F.col("etag").alias("a_etag"), "body", F.lit(True).alias("a")), "href", "left")
    kind = F.when(F.col("h"), "held").when(F.col("w") & F.col("a"), "fetched").when(F.col("w"), None).otherwise("unchanged")
    return out.withColumn("kind", kind).filter("kind IS NOT NULL").select("href", F.when(F.col("kind") == "fetched", F.col("a_etag")).otherwise(F.col("etag")).alias("etag"), "kind", F.when(F.col("kind") == "fetched", F.col("body")).alias("body"))


def match_answers(requested: DataFrame, answers: DataFrame, batch: int = 50) -> DataFrame:
    """Requested hrefs (ord, href) with their answer: found, missing (404, 410, none), transient (5xx) or permanent.

    Stray answers fall away. ``batch`` numbers the requests in groups of that size.
    """
    out = requested.join(answers, "href", "left")
    outcome = (
        F.when(F.col("status").isNull() | F.col("status").isin(404, 410), "missing")
        .when(F.col("status").between(200, 299), F.when(F.col("etag").isNull() | F.col("body").isNull(), "permanent").otherwise("found"))
        .when(F.col("status") >= 500, "transient")
        .otherwise("permanent")
    )
    return out.select("href", outcome.alias("outcome"), F.floor(F.col("ord") / batch).cast("long").alias("batch"))


def idle_facts(state: DataFrame, failures: DataFrame, journal: DataFrame, endpoints: DataFrame, deltas: DataFrame, held_deletes: DataFrame) -> DataFrame:
    """One row (untracked, journal, due_failures, tokens, deltas, idle): whether there is nothing to do.

    A row without a tracked photo counts unless it waits: its delete was held last cycle, or a failure of its uid or
    hrefs is not due yet. *state* is (uid, left_href, right_href, photo_tracked), *failures* (side, href, uid, due),
    *endpoints* (side, token, supports_sync), *deltas* (href), *held_deletes* (uid).
    """
    waiting = failures.filter("NOT due")
    open_rows = state.filter("NOT photo_tracked").join(held_deletes.select("uid").distinct(), "uid", "left_anti").join(waiting.select("uid").distinct(), "uid", "left_anti")
    for s in ("left", "right"):
        open_rows = open_rows.join(waiting.filter(F.col("side") == s).select(F.col("href").alias(f"{s}_href")).distinct(), f"{s}_href", "left_anti")
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    both = n(open_rows, "untracked")
    for df, name in ((journal, "journal"), (failures.filter("due"), "due_failures"), (endpoints.filter("token IS NOT NULL AND supports_sync"), "tokens"), (deltas, "deltas")):
        both = both.crossJoin(n(df, name))  # one row each
    return both.withColumn("idle", F.expr("untracked = 0 AND journal = 0 AND due_failures = 0 AND tokens = 2 AND deltas = 0"))


def seen_rows(state: DataFrame, listing: DataFrame, side: str) -> DataFrame:
    """The uids whose record a side has listed."""
    return state.select("uid", F.col(f"{side}_href").alias("href")).join(listing.filter(F.col("side") == side).select("href").distinct(), "href", "left_semi").select("uid")
