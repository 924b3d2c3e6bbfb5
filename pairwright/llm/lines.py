"""Line dedup: repeated line runs found by prefix doubling over line ids (DataFrame functions only).

Lines become ids, and the suffixes of every document's id sequence are ranked by their first 1, 2, 4, ... lines:
a rank names a pair of ranks of half the length, in sorted order, so each level is the suffix array cut at that
depth. Only lines and pairs that occur twice or more keep a rank; all others are unique and drop out.

A run counts when its lines hold ``min_words`` words or more. The suffixes that agree on the shortest such run
from a line on (or up to it) form one longest-common-prefix interval, named by two overlapping ranks; its first
occurrence in the order (doc_id, text hash, line) stays and the run is deleted at all others. Each maximal repeated
run is the union of such intervals.

Defined cases: a null text has no lines and stays null; an empty text is one empty line; lines are exact strings;
runs don't cross documents but may repeat within one; rows without doc_id come first in the order; rows that agree
in doc_id and text are one document and get one result, unless ``row`` tells them apart: then all but the least row are
later copies; extra columns are kept; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairwright.llm.common import cut, partitions, row_key, words

MIN_WORDS = 5
KEY = ["k1", "k2"]


def _ranked(pairs: DataFrame, by: list[str], name: str) -> DataFrame:
    """Ids in sorted order for the combinations of *by* that occur twice or more."""
    n = partitions(pairs.sparkSession)
    twice = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*by)
    return cut(twice.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn(name, F.monotonically_increasing_id()))


def removed_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(k1, k2, j) of the lines that are later copies, j from 0."""
    line = F.posexplode(F.split("text", "\n"))
    base = docs.select(*row_key(), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL").select(*KEY, line.alias("j", "line"))
    base = cut(base.select(*KEY, "j", F.unhex(F.md5(F.col("line").cast("binary"))).alias("h"), F.size(words(F.col("line"))).alias("nw")))
    ids = _ranked(base, ["h"], "r0")
    rows = base.join(ids, "h").select(*KEY, "j", "nw", "r0").repartition(*[F.col(k) for k in KEY]).dropDuplicates([*KEY, "j"])
    doc = W.partitionBy(*KEY).orderBy("j")
    rows = rows.withColumn("island", F.col("j") - F.row_number().over(doc))
    rows = rows.withColumn("c", F.sum("nw").over(W.partitionBy(*KEY, "island").orderBy("j").rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("b", F.col("c") - F.col("nw"))
    ahead = W.partitionBy(*KEY, "island").orderBy("b").rangeBetween(0, min_words - 1)
    behind = W.partitionBy(*KEY, "island").orderBy("c").rangeBetween(1 - min_words, 0)
    rows = rows.withColumns({"to": F.max("j").over(ahead), "to_c": F.max("c").over(ahead), "since": F.min("j").over(behind), "since_b": F.min("b").over(behind)})
    rows = rows.withColumns(
        {
            "m_ahead": F.when(F.col("to_c") >= F.col("b") + min_words, F.col("to") - F.col("j") + 1),
            "m_behind": F.when(F.col("since_b") <= F.col("c") - min_words, F.col("j") - F.col("since") + 1),
        }
    )
    rows = cut(rows.select(*KEY, "j", "r0", "m_ahead", "m_behind"))
    longest = rows.agg(F.max(F.greatest("m_ahead", "m_behind")).alias("m")).first()["m"] or 1

    level, width = 0, 1
    while width * 2 <= longest:
        half = W.partitionBy(*KEY).orderBy("j").rangeBetween(width, width)
        # Plain columns a, b hold the two halves; a line without a partner has no rank at the new level.
        paired = rows.withColumns({"a": F.col(f"r{level}"), "z": F.max(f"r{level}").over(half)})
        level, width = level + 1, width * 2
        ranks = _ranked(paired.filter("a IS NOT NULL AND z IS NOT NULL").select("a", "z"), ["a", "z"], f"r{level}")
        rows = cut(paired.join(ranks, ["a", "z"], "left").drop("a", "z"))

    spans = F.array_distinct(F.array(F.struct(F.col("j").alias("p"), F.col("m_ahead").alias("m")), F.struct((F.col("j") - F.col("m_behind") + 1).alias("p"), F.col("m_behind").alias("m"))))
    runs = rows.select(*KEY, F.explode(spans).alias("s")).select(*KEY, "s.p", "s.m").filter("m IS NOT NULL")
    runs = runs.withColumn("level", F.floor(F.log2(F.col("m").cast("double"))).cast("int"))
    ranks = F.array(*[F.col(f"r{i}") for i in range(level + 1)])
    # A run of 2^i lines is one rank; any other is two that overlap.
    left = rows.select(*KEY, F.col("j").alias("p"), ranks.alias("at_p"))
    runs = runs.join(left, [*KEY, "p"]).withColumn("ra", F.expr("get(at_p, level)")).drop("at_p").filter("ra IS NOT NULL")
    runs = runs.withColumn("q", F.expr("p + m - cast(shiftleft(1L, level) as int)"))
    if longest > 2:
        right = rows.select(*KEY, F.col("j").alias("q"), ranks.alias("at_q"))
        split = runs.filter("q <> p").join(right, [*KEY, "q"]).withColumn("rb", F.expr("get(at_q, level)")).drop("at_q").filter("rb IS NOT NULL")
        runs = runs.filter("q = p").withColumn("rb", F.col("ra")).unionByName(split)
    else:
        runs = runs.withColumn("rb", F.col("ra"))
    runs = cut(runs.select(*KEY, "p", "m", "ra", "rb"))
    # Written apart, so that the join deals its rows anew and can split those of a very common line.
    first = cut(runs.groupBy("m", "ra", "rb").agg(F.min(F.struct(*KEY, "p")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    later = runs.join(first, ["m", "ra", "rb"]).filter(F.struct(*KEY, "p") > F.col("first")).select(*KEY, F.col("p").alias("j"), (F.col("p") + F.col("m")).alias("end"), F.lit(False).alias("is_line"))
    lines = rows.select(*KEY, "j", F.lit(None).cast("int").alias("end"), F.lit(True).alias("is_line"))
    reach = F.max("end").over(W.partitionBy(*KEY).orderBy("j").rangeBetween(W.unboundedPreceding, 0))
    return lines.unionByName(later).withColumn("reach", reach).filter("is_line AND reach > j").select(*KEY, "j")


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, row: str | None = None) -> DataFrame:
    """*docs* with later copies of repeated runs deleted from ``text``, and n_lines, n_removed, n_runs.

    The lines to delete travel as 64-line bit masks and meet each text once. *row* names a column that is distinct in
    every row and the same whenever it is read; it is not returned. Of rows that agree in doc_id and text the least one
    comes first, so the others are one later run from end to end and go as a whole if they hold *min_words* words.
    """
    gone = removed_lines(docs, min_words)
    bits = F.expr("shiftleft(1L, j % 64)")
    chunk = gone.groupBy(*KEY, F.expr("j div 64").cast("int").alias("c")).agg(F.bit_or(bits).alias("bits"))
    doc = chunk.groupBy(*KEY).agg(F.collect_list(F.struct("c", "bits")).alias("chunks"))
    doc = doc.withColumn("masks", F.expr("transform(sequence(0, array_max(chunks).c), i -> coalesce(get(filter(chunks, x -> x.c = i), 0).bits, 0L))"))
    if row is not None:
        copies = docs.filter("text IS NOT NULL").groupBy(*[k.alias(name) for k, name in zip(row_key(), KEY)]).agg(F.min(f"`{row}`").alias("first"), F.count(F.lit(1)).alias("n"))
        both = doc.select(*KEY, "masks").unionByName(copies.filter("n > 1").drop("n"), allowMissingColumns=True)
        doc = both.groupBy(*KEY).agg(F.first("masks", ignorenulls=True).alias("masks"), F.first("first", ignorenulls=True).alias("first"))
    doc = doc.select(F.col("k1").alias("g1"), F.col("k2").alias("g2"), "masks", *(["first"] if row is not None else []))
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed", "n_runs", row)]
    at = [F.col(f"`{row}`").alias("at")] if row is not None else []
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), *at, *row_key(), F.split(F.col("text").cast("string"), "\n").alias("lines"))
    held = held.join(doc.hint("shuffle_hash"), F.col("k1").eqNullSafe(F.col("g1")) & (F.col("k2") == F.col("g2")), "left")
    if row is not None:
        later = F.when(F.col("at") > F.col("first"), F.size(words(F.col("row.text"))) >= min_words)
        whole = F.expr("transform(sequence(0, cast((size(lines) - 1) div 64 as int)), i -> -1L)")
        held = held.withColumn("masks", F.when(later, whole).otherwise(F.col("masks")))
    gone_at = "coalesce(shiftright(get(masks, cast({i} div 64 as int)), cast({i} % 64 as int)) & 1L, 0L)"
    held = held.withColumn("flags", F.expr(f"IF(masks IS NULL, NULL, transform(sequence(0, size(lines) - 1), i -> {gone_at.format(i='i')}))"))
    out = held.select(
        "row",
        F.expr("CASE WHEN masks IS NULL THEN row.text ELSE array_join(filter(lines, (x, i) -> get(flags, i) = 0L), '\n') END").alias("kept"),
        F.expr("coalesce(cast(size(lines) as bigint), 0L)").alias("n_lines"),
        F.expr("coalesce(aggregate(flags, 0L, (a, x) -> a + x), 0L)").alias("n_removed"),
        F.expr("coalesce(aggregate(transform(flags, (x, i) -> IF(x = 1L AND coalesce(get(flags, i - 1), 0L) = 0L, 1L, 0L)), 0L, (a, x) -> a + x), 0L)").alias("n_runs"),
    )
    return out.select(*[F.col("kept").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in own], "n_lines", "n_removed", "n_runs")


def query(spark, sf_dir: str) -> DataFrame:
    place = F.struct("_metadata.file_path", "_metadata.row_index").alias("_row")
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", place), row="_row")
    kept = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", F.length(kept).cast("long").alias("n_chars_kept"), F.md5(kept.cast("binary")).alias("kept_md5"))


ORACLE = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, string_split(text, chr(10)) AS ls FROM documents
), l AS (
  SELECT rid, doc_id, j, ls[j] AS line, len(list_filter(regexp_split_to_array(ls[j], '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) AS nw
  FROM (SELECT rid, doc_id, ls, unnest(range(1, len(ls) + 1)) AS j FROM d)
), c AS (
  SELECT *, sum(nw) OVER (PARTITION BY rid ORDER BY j) AS c FROM l
), w AS (
  SELECT a.rid, a.j AS lo, min(b.j) AS hi FROM c a JOIN c b ON a.rid = b.rid AND b.j >= a.j AND b.c >= a.c - a.nw + 5 GROUP BY 1, 2
  UNION
  SELECT a.rid, max(b.j) AS lo, a.j AS hi FROM c a JOIN c b ON a.rid = b.rid AND b.j <= a.j AND b.c - b.nw <= a.c - 5 GROUP BY 1, 3
), x AS (
  SELECT w.rid, lo, hi, row_number() OVER (PARTITION BY array_to_string(ls[lo:hi], chr(10)) ORDER BY doc_id, lo) AS nth FROM w JOIN d USING (rid)
), g AS (
  SELECT DISTINCT rid, unnest(range(lo, hi + 1)) AS j FROM x WHERE nth > 1
), r AS (
  SELECT rid, sum(CASE WHEN prev IS DISTINCT FROM j - 1 THEN 1 ELSE 0 END) AS n_runs, count(*) AS n FROM (SELECT rid, j, lag(j) OVER (PARTITION BY rid ORDER BY j) AS prev FROM g) GROUP BY rid
), k AS (
  SELECT rid, string_agg(line, chr(10) ORDER BY j) AS t FROM c ANTI JOIN g USING (rid, j) GROUP BY rid
)
SELECT doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(n, 0)::BIGINT AS n_removed, coalesce(n_runs, 0)::BIGINT AS n_runs,
       length(coalesce(t, ''))::BIGINT AS n_chars_kept, md5(coalesce(t, '')) AS kept_md5
FROM d LEFT JOIN r USING (rid) LEFT JOIN k USING (rid)
"""
