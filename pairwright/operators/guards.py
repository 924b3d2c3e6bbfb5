"""Checks that hold back suspicious deletions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.operators.linkage import may_be_same

FLOOR, PERCENT = 10, 20


def mass_deletions(plan: DataFrame, group: list[str], floor: int = FLOOR, percent: int = PERCENT) -> DataFrame:
    """Per group of plan rows (op, on) and side: deletions against the limit max(floor, percent of rows, rounded down).

    Forgetting a record counts on both sides.
    """
    per = plan.groupBy(*group).agg(
        F.count(F.lit(1)).alias("records"), *[F.sum(F.when(((F.col("op") == "delete") & (F.col("on") == s)) | (F.col("op") == "forget"), 1).otherwise(0)).alias(s) for s in ("left", "right")]
    )
    per = per.withColumn("limit", F.greatest(F.lit(floor), F.expr(f"records * {percent} div 100")))
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("deletes")) for s in ("left", "right")]))
    return per.select(*group, "records", "limit", sides.alias("x")).select(*group, "records", "limit", "x.side", "x.deletes", (F.col("x.deletes") > F.col("limit")).alias("blocked"))


def cross_deletes(deletes: DataFrame) -> DataFrame:
    """Deletions (seq, on, name, tokens, org) that may be one record under two ids, deleted once on each side.

    Each is held and names its first partner in the order of seq.
    """
    rows = deletes.withColumn("id", F.col("seq"))
    left, right = (rows.filter(F.col("on") == s) for s in ("left", "right"))
    both = may_be_same(left, right).unionByName(may_be_same(right, left))
    return both.select(F.col("id").alias("seq"), F.col("first").alias("partner"))
