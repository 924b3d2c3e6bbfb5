"""Mixing sources to target weights by weighted fair queueing.

Each document, in a seeded shuffle of its source, gets a virtual finish time: the source's words up to and with
it, divided by the source's target. A source whose target is larger than itself goes round again, up to
``max_repeats`` times. One global order by finish time, cut where the total budget is used up, is the mix: at any
cut every source has had its share.

Defined cases: a null text has size 0 and is never taken; a null source is a source of its own, last in order;
documents of size 0 are taken 0 times; ties in the shuffle fall to doc_id and then to equal rows, which are
interchangeable; an empty table gives an empty mix. Rows that agree in doc_id, source and size share one place in
the order's tie-break only; every row is queued and counted by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairwright.llm.common import cut, prefix_sum, row_key, words

SEED = "mix-1"
MAX_REPEATS = 3


def _ordered(source: Column) -> Column:
    """A string that sorts sources in code point order with null last."""
    return F.concat(F.when(source.isNull(), "1").otherwise("0"), F.coalesce(source, F.lit("")))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(so, source_size, target, before, budget), one row per source, from rows (source, size).

    Sources in code point order, null last, weigh *weights* in turn and share the sum of all sizes. A target stops at
    ``max_repeats`` times its source; the rest is shared again by weight. With sources sorted by that bound over the
    weight, a source is bounded exactly when its share is too large with all before it bounded; so one pass over the
    table of sources, which holds one row per source after aggregation, finds the final shares.
    """
    each = sizes.groupBy(_ordered(F.col("source")).alias("so")).agg(F.sum("size").alias("source_size"))
    in_turn = W.orderBy("so")
    before = in_turn.rowsBetween(W.unboundedPreceding, -1)
    turn = F.row_number().over(in_turn) - 1
    each = each.withColumns(
        {
            "rank": turn,
            "w": F.element_at(F.array(*[F.lit(w) for w in weights]), (turn % len(weights) + 1).cast("int")).cast("long"),
            "before": F.coalesce(F.sum("source_size").over(before), F.lit(0)),
            "budget": F.sum("source_size").over(W.partitionBy()),
            "bound": F.col("source_size") * max_repeats,
        }
    ).withColumn("ratio", F.col("bound").cast("double") / F.col("w"))
    by = W.orderBy("ratio", "rank")
    each = each.withColumns(
        {
            "left": F.col("budget") - F.coalesce(F.sum("bound").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
            "weights": F.sum("w").over(by.rowsBetween(0, W.unboundedFollowing)),
        }
    ).withColumn("bounded", F.expr("bound * weights < left * w"))
    each = each.withColumn("first", F.min(F.expr("IF(bounded, NULL, struct(ratio, rank, left, weights))")).over(W.partitionBy()))
    return each.select("so", "source_size", F.expr("IF(bounded, cast(bound as double), w * first.left / first.weights)").alias("target"), "before", "budget")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, source, k2 (a hash of the text), size, source_size, target, repeats, taken."""
    sizes = cut(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            row_key()[1],
            F.size(words(F.col("text"))).cast("long").alias("size"),
        )
    )
    plan = cut(targets(sizes, weights, max_repeats))
    shuffled = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    # Joined by a key with one row per source: broadcast below spark.sql.autoBroadcastJoinThreshold, else a skew-split join.
    joined = sizes.withColumns({"so": _ordered(F.col("source")), "turn": shuffled}).join(plan, "so")
    queued = prefix_sum(joined, ["so", "turn", "size", "k2"], "size", "upto")
    queued = cut(queued.withColumns({"in_source": F.col("upto") - F.col("before"), "id": F.monotonically_increasing_id()}))
    rounds = queued.filter("size > 0").withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))))
    rounds = rounds.select("id", "so", "turn", "size", "budget", F.expr("cast(round * source_size + in_source as double) / target").alias("finish"))
    running = prefix_sum(rounds, ["finish", "so", "turn", "size", "id"], "size", "used")
    taken = running.filter("used <= budget").groupBy("id").agg(F.count(F.lit(1)).alias("repeats"))
    out = queued.join(taken, "id", "left").withColumn("repeats", F.coalesce("repeats", F.lit(0)).cast("int"))
    return out.select("doc_id", "source", "k2", "size", "source_size", "target", "repeats", (F.col("repeats") * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes, with their own columns and ``repeats``, the times each is taken."""
    own = [F.col(f"`{c}`") for c in docs.columns if c != "repeats"]
    keyed = docs.select(F.struct(*own).alias("row"), F.col("doc_id").cast("long").alias("m_id"), F.col("source").cast("string").alias("m_source"), row_key()[1].alias("m_key"))
    same = W.partitionBy("m_id", "m_key", "m_source")
    keyed = keyed.withColumn("m_nth", F.row_number().over(same.orderBy(F.lit(0))))
    got = mix(docs, **options).select(F.col("doc_id").alias("g_id"), F.col("k2").alias("g_key"), F.col("source").alias("g_source"), "repeats")
    got = got.withColumn("g_nth", F.row_number().over(W.partitionBy("g_id", "g_key", "g_source").orderBy(F.col("repeats").desc()))).filter("repeats > 0")
    on = F.col("m_id").eqNullSafe(F.col("g_id")) & (F.col("m_key") == F.col("g_key")) & F.col("m_source").eqNullSafe(F.col("g_source")) & (F.col("m_nth") == F.col("g_nth"))
    return keyed.join(got, on).select("row.*", "repeats")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = """
WITH z AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS so,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> ''))::BIGINT AS size
  FROM documents
), s AS (
  SELECT so, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY so) - 1 AS rank FROM z GROUP BY so
), b AS (
  SELECT *, rank % 3 + 1 AS w, 3 * source_size AS bound, (sum(source_size) OVER ())::BIGINT AS budget,
         coalesce(sum(source_size) OVER (ORDER BY so ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM s
), f AS (
  SELECT *, (budget - coalesce(sum(bound) OVER (ORDER BY bound::DOUBLE / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS lft,
         (sum(w) OVER (ORDER BY bound::DOUBLE / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS ws FROM b
), c AS (
  SELECT *, bound * ws < lft * w AS bounded FROM f
), t AS (
  SELECT so, source_size, budget, CASE WHEN bounded THEN bound::DOUBLE ELSE (w * first_value(lft) OVER o)::DOUBLE / (first_value(ws) OVER o)::DOUBLE END AS target
  FROM c WINDOW o AS (ORDER BY bounded, bound::DOUBLE / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), q AS (
  SELECT doc_id, size, t.*, md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')) AS turn,
         (sum(size) OVER (PARTITION BY z.so ORDER BY md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), size ROWS UNBOUNDED PRECEDING))::BIGINT AS in_source
  FROM z JOIN t USING (so)
), r AS (
  SELECT doc_id, turn, so, size, budget, (round * source_size + in_source)::DOUBLE / target AS finish FROM q, (VALUES (0), (1), (2)) v(round) WHERE size > 0
), u AS (
  SELECT doc_id, size, budget, (sum(size) OVER (ORDER BY finish, so, turn, size ROWS UNBOUNDED PRECEDING))::BIGINT AS used FROM r
), k AS (
  SELECT doc_id, sum(size)::BIGINT AS taken FROM u WHERE used <= budget GROUP BY doc_id
)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(k.taken, 0)::BIGINT AS taken FROM q LEFT JOIN k ON q.doc_id IS NOT DISTINCT FROM k.doc_id
"""
