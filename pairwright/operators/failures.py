"""Failures per record: attempts, backoff, reasons, what to hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairwright.functions.text import backoff_seconds

PERSISTENT = 3
#: Reasons by error class; any other error is internal. Fixed values.
REASONS = {
    "missing_uid": "missing_uid",
    "unsupported_version": "unsupported_version",
    "not_utf8": "invalid_card",
    "malformed_line": "invalid_card",
    "missing_begin": "invalid_card",
    "nested_begin": "invalid_card",
    "missing_end": "invalid_card",
    "after_end": "invalid_card",
    "missing_version": "invalid_card",
    "precondition_failed": "precondition_failed",
    "rate_limited": "rate_limited",
    "transient": "transient",
    "unauthorized": "unauthorized",
    "too_large": "too_large",
    "permanent": "rejected",
    "duplicate_uid": "duplicate_uid",
    "uid_changed": "uid_changed",
}
#: Listing errors after which a side is looked up anew.
REDISCOVER = ("permanent", "transient")
#: Errors that end a cycle; all others are a record's own.
FATAL = ("transient", "rate_limited", "unauthorized", "store_busy", "store_lost")


def reason(error: Column) -> Column:
    """The category a failure is stored under; never server text, which may hold card content."""
    known = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, error), F.lit("internal"))


def is_fatal(error: Column) -> Column:
    return error.isin(*FATAL)


def needs_discovery(error: Column) -> Column:
    """Whether a side whose listing failed with this error class is looked up anew before the next cycle."""
    return F.coalesce(error.isin(*REDISCOVER), F.lit(False))


def holds_on_abort(op: Column, origin: Column) -> Column:
    """Whether an op that an account-wide error ended holds its cards: only a synced record's. One card of an unsynced pair,
    held alone, would make the other look unique and be copied back."""
    return op.isin("update", "delete", "resurrect") | F.coalesce((op == "conflict") & (origin == "sync"), F.lit(False))


def replay_history(events: DataFrame, key: list[str], order: list[str], base: int = 120, cap: int = 86_400) -> DataFrame:
    """The failure rows after a history of events (*key*, etag, at, ...): an equal etag (null-safe) counts one up,
    another restarts at 1.

    Runs of equal etags are islands, so the whole history is one window pass instead of a loop over events.
    """
    w = W.partitionBy(*key).orderBy(*order)
    out = events.withColumn("_new", F.when((F.row_number().over(w) == 1) | ~F.lag("etag").over(w).eqNullSafe(F.col("etag")), 1).otherwise(0))
    out = out.withColumn("_island", F.sum("_new").over(w))
    island = W.partitionBy(*key, "_island").orderBy(*order)
    out = out.withColumns({"attempts": F.row_number().over(island).cast("long"), "first_at": F.first("at").over(island)})
    out = out.withColumn("wait_s", backoff_seconds(F.col("attempts"), base, cap))
    return out.drop("_new", "_island")


def current(history: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row per key, combined map-side."""
    rest = [c for c in history.columns if c not in key]
    return history.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x")).select(*key, "x.*")


def record(failures: DataFrame, events: DataFrame, base: int = 120, cap: int = 86_400) -> DataFrame:
    """Upsert one event per (side, href) into failures (side, href, etag, attempts, first_at, reason)."""
    e = events.select("side", "href", F.col("etag").alias("e_etag"), F.col("at").alias("e_at"), F.col("reason").alias("e_reason"), F.lit(True).alias("hit"))
    j = failures.join(e, ["side", "href"], "full_outer")
    again = F.col("attempts").isNotNull() & F.col("etag").eqNullSafe(F.col("e_etag"))
    hit = F.coalesce("hit", F.lit(False))
    attempts = F.when(~hit, F.col("attempts")).when(again, F.col("attempts") + 1).otherwise(1).cast("long")
    return j.select(
        "side",
        "href",
        F.when(hit, F.col("e_etag")).otherwise(F.col("etag")).alias("etag"),
        attempts.alias("attempts"),
        F.when(hit & ~again, F.col("e_at")).otherwise(F.col("first_at")).alias("first_at"),
        F.when(hit, F.col("e_reason")).otherwise(F.col("reason")).alias("reason"),
        backoff_seconds(attempts, base, cap).alias("wait_s"),
    )


def resolved(stored: DataFrame, failed_again: DataFrame, listed: DataFrame, held: DataFrame) -> DataFrame:
    """Stored failures (side, href) that did not fail again and are unlisted or not held."""
    key = ["side", "href"]
    kept = held.select(*key).join(listed.select(*key), key, "left_semi")
    return stored.join(failed_again.select(*key), key, "left_anti").join(kept, key, "left_anti")


def cards_to_hold(failed: DataFrame, written: DataFrame) -> DataFrame:
    """What failed ops hold: (uid, side, href, etag, op).

    *failed* is (uid, op, on, origin, left struct<href,etag>, right struct<href,etag>); an op holds the card it read
    from, a pairing op both cards, a deletion its target, state-only ops none. *written* (uid, side, href, etag) are
    cards an op wrote before it failed; they are held at their new etag, under the op's uid too.
    """
    op = F.col("op")
    source = F.when(op.isin("create", "update", "resurrect", "conflict"), F.when(F.col("on") == "left", "right").otherwise("left")).when(op == "copy_group", "right").when(op == "delete", F.col("on"))
    pair = (op == "recreate") | ((op == "conflict") & (F.col("origin") == "baseline"))
    sides = F.when(pair, F.array(F.lit("left"), F.lit("right"))).when(source.isNotNull(), F.array(source))
    kind = F.when(op.isin("create", "resurrect", "copy_group"), "create").when(op == "delete", "delete").otherwise("update")
    held = failed.select("uid", kind.alias("op"), "left", "right", F.explode(sides).alias("side"))
    card = F.when(F.col("side") == "left", F.col("left")).otherwise(F.col("right"))
    held = held.select("uid", "op", "side", card["href"].alias("href"), card["etag"].alias("etag"), F.lit(0).alias("new"))
    late = written.join(failed.filter(~op.isin("adopt", "refresh", "forget")).select("uid", kind.alias("op")), "uid").select("uid", "op", "side", "href", "etag", F.lit(1).alias("new"))
    both = held.unionByName(late)
    return both.groupBy("uid", "op", "side", "href").agg(F.max_by(F.struct("etag"), "new").alias("x")).select("uid", "side", "href", "x.etag", "op")
