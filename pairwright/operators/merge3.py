"""Three-way merge: what two sides' statuses against the stored state call for.

A record's status on a side is ``unchanged`` (listed, not read again), ``same`` (read, content as stored),
``changed`` (read, content differs) or ``deleted`` (no longer listed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ("unchanged", "same", "changed", "deleted")
#: (left, right) -> (op, side it is done on, diagnostic). Fixed values; "both" refreshes either side's version.
DECISIONS: dict[tuple[str, str], tuple[str | None, str | None, str | None]] = {
    ("unchanged", "unchanged"): (None, None, None),
    ("unchanged", "same"): ("refresh", "right", None),
    ("unchanged", "changed"): (None, "left", "unread_target"),
    ("unchanged", "deleted"): ("delete", "left", None),
    ("same", "unchanged"): ("refresh", "left", None),
    ("same", "same"): ("refresh", "both", None),
    ("same", "changed"): ("update", "left", None),
    ("same", "deleted"): ("delete", "left", None),
    ("changed", "unchanged"): (None, "right", "unread_target"),
    ("changed", "same"): ("update", "right", None),
    ("changed", "changed"): ("conflict", None, None),
    ("changed", "deleted"): ("resurrect", "right", None),
    ("deleted", "unchanged"): ("delete", "right", None),
    ("deleted", "same"): ("delete", "right", None),
    ("deleted", "changed"): ("resurrect", "left", None),
    ("deleted", "deleted"): ("forget", None, None),
}


def other(side: Column) -> Column:
    return F.when(side == "left", "right").otherwise("left")


def _pick(left: Column, right: Column, part: int) -> Column:
    out = None
    for (a, b), row in DECISIONS.items():
        if row[part] is not None:
            cond = (left == a) & (right == b)
            out = F.when(cond, F.lit(row[part])) if out is None else out.when(cond, F.lit(row[part]))
    return out


def decide(rows: DataFrame, winner: str = "left") -> DataFrame:
    """Add op, on (side), content (the stored content is replaced too), winner and diag to rows with left_status,
    right_status, left_hash, right_hash and hash_stale (the stored hash is of an old version).

    Both sides changed to the same content is a refresh, else a conflict whose winner is pushed to the other side.
    """
    left, right = F.col("left_status"), F.col("right_status")
    both = (left == "changed") & (right == "changed")
    equal = F.coalesce(both & F.col("left_hash").eqNullSafe(F.col("right_hash")), F.lit(False))
    stale = (left == "unchanged") & (right == "unchanged") & F.coalesce(F.col("hash_stale"), F.lit(False))
    conflict = both & ~equal
    return rows.withColumns(
        {
            "op": F.when(equal | stale, F.lit("refresh")).otherwise(_pick(left, right, 0)),
            "on": F.when(equal, F.lit("both")).when(conflict, other(F.lit(winner))).otherwise(_pick(left, right, 1)),
            "content": equal | stale | F.coalesce(_pick(left, right, 0).isin("update", "resurrect"), F.lit(False)) | conflict,
            "winner": F.when(conflict, F.lit(winner)),
            "diag": _pick(left, right, 2),
        }
    )


def status(listed: Column, fetched: Column, found_hash: Column, stored_hash: Column) -> Column:
    """A record's status on one side; hashes compare null-safe."""
    return F.when(~F.coalesce(listed, F.lit(False)), "deleted").when(~F.coalesce(fetched, F.lit(False)), "unchanged").when(found_hash.eqNullSafe(stored_hash), "same").otherwise("changed")


def baseline_hash(stored_hash: Column, hash_version: Column, recomputed: Column, version: int = 2) -> Column:
    """The stored hash, or the one recomputed from the stored card where it is of another version."""
    return F.when(hash_version == version, stored_hash).otherwise(recomputed)


def statuses(state: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """State rows (uid, stored_hash, ...) with left_status, right_status and both hashes, from each side's tracked
    rows (uid, kind 'unchanged' or 'fetched', hash)."""
    side = lambda df, s: df.select("uid", F.col("kind").alias(f"{s}_kind"), F.col("hash").alias(f"{s}_hash"))
    out = state.join(side(left, "left"), "uid", "left").join(side(right, "right"), "uid", "left")
    return out.withColumns({f"{s}_status": status(F.col(f"{s}_kind").isNotNull(), F.col(f"{s}_kind") == "fetched", F.col(f"{s}_hash"), F.col("stored_hash")) for s in ("left", "right")})


def absent_state(left: DataFrame, right: DataFrame, winner: str = "left") -> DataFrame:
    """Records that no state row knows: create on the other side, adopt (equal content) or baseline conflict."""
    a, b = left.select("uid", F.col("hash").alias("left_hash")), right.select("uid", F.col("hash").alias("right_hash"), F.lit(True).alias("in_right"))
    out = a.withColumn("in_left", F.lit(True)).join(b, "uid", "full_outer")
    pair = F.col("in_left") & F.col("in_right")
    return out.select(
        "uid",
        F.when(F.col("in_right").isNull() | F.col("in_left").isNull(), "create").when(F.col("left_hash").eqNullSafe(F.col("right_hash")), "adopt").otherwise("conflict").alias("op"),
        F.when(F.col("in_right").isNull(), "right").when(F.col("in_left").isNull(), "left").when(F.col("left_hash").eqNullSafe(F.col("right_hash")), None).otherwise("right" if winner == "left" else "left").alias("on"),
        F.when(F.coalesce(pair, F.lit(False)) & ~F.col("left_hash").eqNullSafe(F.col("right_hash")), F.lit("baseline")).alias("origin"),
    )
