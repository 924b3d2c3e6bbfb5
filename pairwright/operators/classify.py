"""Side classification: which listed entries are tracked, unsynced, held or ambiguous."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def classify(entries: DataFrame, state: DataFrame) -> DataFrame:
    """Entries (href, kind 'unchanged'|'fetched'|'held'|'unreadable', uid of a fetched card) against state (href, uid).

    Adds state_uid, appears_as (the uid it stands for), holds (uids it keeps back), uncertain (it may be any record)
    and diag. A card that names another uid at a known href holds both.
    """
    out = entries.join(state.select("href", F.col("uid").alias("state_uid")), "href", "left")
    blind = F.col("kind").isin("held", "unreadable")
    known = F.col("state_uid").isNotNull()
    moved = (F.col("kind") == "fetched") & known & (F.col("uid") != F.col("state_uid"))
    return out.withColumns(
        {
            "appears_as": F.when(moved, None).when(F.col("kind") == "fetched", F.col("uid")).when((F.col("kind") == "unchanged") & known, F.col("state_uid")),
            "holds": F.when(blind & known, F.array("state_uid")).when(moved, F.array("state_uid", "uid")).otherwise(F.expr("cast(array() as array<string>)")),
            "uncertain": ~known & (blind | (F.col("kind") == "unchanged")),
            "diag": F.when(moved, F.lit("uid_changed")),
        }
    )


def resolve(classified: DataFrame, state: DataFrame) -> DataFrame:
    """Appearances by uid, held ones dropped: outcome duplicate (several hrefs), tracked or unsynced."""
    held = classified.select(F.explode("holds").alias("uid")).distinct()
    seen = classified.filter("appears_as IS NOT NULL").groupBy(F.col("appears_as").alias("uid")).agg(F.count(F.lit(1)).alias("n"), F.min("href").alias("href"), F.max("kind").alias("kind"))
    seen = seen.join(held, "uid", "left_anti").join(state.select("uid", F.lit(True).alias("known")).distinct(), "uid", "left")
    outcome = F.when(F.col("n") > 1, "duplicate").when(F.col("known"), "tracked").otherwise("unsynced")
    return seen.select("uid", "n", F.when(F.col("n") == 1, F.col("href")).alias("href"), outcome.alias("outcome"))


def uncertain(classified: DataFrame) -> DataFrame:
    """One row: whether any entry of the side may be any record."""
    return classified.agg(F.coalesce(F.max("uncertain"), F.lit(False)).alias("uncertain"))


def defer(plan: DataFrame, left_uncertain: bool, right_uncertain: bool) -> DataFrame:
    """Rows deleted on an uncertain side wait: op goes, deferred lists the sides."""
    sides = [(F.lit(u) & (F.col(f"{s}_status") == "deleted"), s) for s, u in (("left", left_uncertain), ("right", right_uncertain))]
    deferred = F.filter(F.array(*[F.when(c, F.lit(s)) for c, s in sides]), lambda x: x.isNotNull())
    out = plan.withColumn("deferred", deferred)
    return out.withColumn("op", F.when(F.size("deferred") == 0, F.col("op")))


def known_cards(fetched: DataFrame, state_cards: DataFrame) -> DataFrame:
    """One card per uid: a fetched one (first by href) before the stored one."""
    both = fetched.select("uid", "name", "href", F.lit(0).alias("from_state")).unionByName(state_cards.select("uid", "name", F.lit("").alias("href"), F.lit(1).alias("from_state")))
    return both.groupBy("uid").agg(F.min_by(F.struct("name", "from_state"), F.struct("from_state", "href")).alias("x")).select("uid", "x.*")
